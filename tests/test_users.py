import pytest
from conftest import values
from pyspark.sql import functions as F

from tallyline.functions import columns as C
from tallyline.operators import members, reviews, users
from tallyline.sources import feeds

USERS = "user_id long, name string, email string, excluded boolean"


@pytest.fixture()
def people(table):
    return table([(n, f"user {n}", "one@example.edu", n < 5) for n in range(10)] + [(10, None, None, False)], USERS)


def test_search(people):
    assert users.search(people, "user", "name").count() == 10
    assert users.search(people, "one", "email").count() == 10
    assert users.search(people, "o", "both").count() == 10
    assert users.search(people, "USER 3", "both").count() == 0
    assert values(users.search(people, "USER 3", "both", ignore_case=True), "user_id") == [(3,)]
    with pytest.raises(ValueError):
        users.search(people, "x", "login")


def test_exclusion(people):
    assert users.excluded(people).count() == 5
    assert users.excluded(users.exclude_search(people, "user", "both")).count() == 10
    ids = people.where("user_id < 3").select("user_id")
    assert users.excluded(users.set_excluded_ids(people, ids, False)).count() == 2


def test_labels(people):
    assert values(users.labels(people.where("user_id IN (1, 10)"))) == [(1, "user 1 (one@example.edu)"), (10, "Overall")]


def test_percent_text(table):
    rows = table([(0.4,), (1.0,), (99.999,), (None,)], "p double")
    assert [r[0] for r in rows.select(C.percent_text(F.col("p"))).collect()] == ["<1", "1.00", "100.00", None]


def test_resolution(table):
    known = table([(5, "a", "x@e", False), (3, "b", "x@e", False), (7, "c", None, False)], USERS)
    who = table([("a", "x@e"), ("c", None), ("new", "x@e")], "name string, email string")
    assert values(users.resolve_strict(who, known, "d.edu"), "name", "user_id") == [("a", 5), ("c", 7), ("new", None)]
    assert values(users.resolve_weak(who, known, "d.edu"), "name", "user_id") == [("a", 3), ("c", 7), ("new", 3)]


def test_new_users_are_distinct_and_numbered_above_the_known(table):
    known = table([(5, "a", "x@e", False), (9, "c", None, False)], USERS)
    raw = table([("a", "x@e"), ("c", None), ("b", None), ("b", "b@d.edu"), ("e", "x@e"), (None, None)], "name string, email string")
    strict = users.new_users(raw, known, "d.edu")
    assert values(strict, "name", "email") == [("b", "b@d.edu"), ("e", "x@e")]
    assert values(users.new_users(raw, known, "d.edu", weak=True), "name", "email") == [("b", "b@d.edu")]
    ids = [row["user_id"] for row in strict.collect()]
    assert min(ids) > 9 and len(set(ids)) == 2


def test_many_new_users_get_unique_ids(spark, table):
    raw = spark.range(20000).select(F.concat(F.lit("n"), "id").alias("name"), F.lit("same@e").alias("email"))
    added = users.new_users(raw, table([], USERS), "d.edu")
    assert added.select("user_id").distinct().count() == 20000


def test_created_users_keep_a_flag_set_before_any_commit(table):
    base = table([(1, "a", "x", False), (2, "n", None, False)], USERS)
    rows = table([("b", "y", True), ("a", "x", True), ("n", None, True)], "name string, email string, excluded boolean")
    made = users.create(base, rows)
    assert values(made, "name", "excluded") == [("a", False), ("b", True), ("n", False)]


def test_remap_twenty_users_to_one(spark, table):
    history = spark.range(20).select("id", F.col("id").alias("author_id"), F.col("id").alias("committer_id"))
    notes = spark.range(20).select("id", F.col("id").alias("commenter_id"))
    requests = spark.range(20).select("id", F.col("id").alias("opened_by"), F.when(F.col("id") > 9, F.col("id")).alias("merged_by"))
    mapping = table([(n, 0) for n in range(1, 20)], "old_user_id long, new_user_id long")
    assert users.mapping_problems(mapping).count() == 0
    c, n, r = users.remap_all(history, notes, requests, mapping)
    assert values(c.select("author_id").distinct()) == [(0,)]
    assert c.select("committer_id").distinct().count() == 20
    assert values(n.select("commenter_id").distinct()) == [(0,)]
    assert values(r.select("opened_by", "merged_by").distinct()) == [(0, 0), (0, None)]


def test_mapping_problems(table):
    mapping = table([(1, 2), (2, 3), (4, 5), (4, 6), (7, 7)], "old_user_id long, new_user_id long")
    assert values(users.mapping_problems(mapping)) == [
        (1, "new user is replaced too"),
        (4, "replaced more than once"),
        (7, "new user is replaced too"),
    ]


def test_alias_groups(people):
    assert values(users.alias_groups(people).select("email", "n_names").distinct()) == [("one@example.edu", 10)]


def test_members_and_teams(table):
    ids = "repo_id long, author_id long"
    history = table([(1, 1), (1, 2), (1, 3), (2, 1)], ids)
    people = table([(1, "a", "a", False), (2, "b", "b", True), (3, "c", "c", False), (4, "d", "d", False), (5, "e", "e", False)], USERS)
    requests = table([(9, 2, 4, 5)], "pr_id long, repo_id long, opened_by long, merged_by long")
    notes = table([(9, 3), (9, 3)], "pr_id long, commenter_id long")
    found = members.repository_members(history, requests, notes, people)
    assert values(found, "repo_id", "user_id") == [(1, 1), (1, 3), (2, 1), (2, 3), (2, 4)]
    repositories = table([(1, "r1"), (2, "r2")], "repo_id long, repository_name string")
    teams = table([(1, 1)], "repo_id long, user_id long")
    assert values(members.users_outside_team(history, teams, people)) == [(1, 3)]
    report = members.fetch_report(repositories, history, teams, people)
    assert values(report, "kind", "repository_name") == [
        ("duplicate users", "r1"),
        ("fetched", None),
        ("unable to check", "r2"),
    ]
    assert values(reviews.opened_by(requests, people.where("user_id = 4")), "pr_id") == [(9,)]


def test_repeated_comments_are_kept(spark, table):
    from tallyline.schemas import RAW_PULL_REQUESTS

    page = '{"repo_id":1,"number":7,"page":%d,"state":"open","user":{"name":"a"},"created_at":"2024-01-01T00:00:00Z","title":"t%d","comments":[{"user":{"name":"b"},"body":"+1"}],"review_comments":[{"user":{"name":"c"},"body":"+1"}]}'
    raw = feeds.parse_json(table([(page % (n, n),) for n in (1, 2)], "value string"), RAW_PULL_REQUESTS)
    assert feeds.ingest_pr_comments(raw).count() == 4
    assert values(feeds.ingest_pull_requests(raw), "number", "title", "closed_at", "merged_by_name") == [(7, "t1", None, None)]
    assert values(feeds.review_identities(raw), "name") == [("a",), ("b",), ("c",)]
