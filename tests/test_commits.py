from datetime import datetime

import pytest
from conftest import values

from tallyline.functions import columns as C
from tallyline.operators import commits, rows
from tallyline.plans import fetch
from tallyline.schemas import COMMITS
from tallyline.sources import feeds
from pyspark.sql import functions as F

SMALL = "commit_id long, repo_id long, sha1 string, commit_date timestamp_ntz, seq long"
SEEN = "repo_id long, sha1 string, seq long, branch string, message string"


def test_parents(table):
    raw = table([(1, []), (2, ["a"]), (3, ["a", "b"]), (4, ["a", "b", "c"]), (5, None)], "commit_id long, parents array<string>")
    found = commits.parent_fields(raw)
    assert values(found) == [(1, False, None), (2, False, "a"), (3, True, None), (4, False, None), (5, False, None)]
    assert values(commits.single_parent(found), "commit_id") == [(2,)]


def test_window_needs_both_ends_and_includes_them(table):
    days = [datetime(2021, 8, 8, 23, 59, 59), datetime(2021, 8, 9), datetime(2021, 8, 11), datetime(2021, 8, 11, 0, 0, 1)]
    rows = table([(n, 1, str(n), day, n) for n, day in enumerate(days)], SMALL)
    inside = commits.in_window(rows, "2021-08-09T00:00:00Z", "2021-08-11T00:00:00Z")
    assert values(inside, "commit_id") == [(1,), (2,)]
    assert commits.in_window(rows, "2021-08-09T00:00:00Z", None).count() == 4
    shifted = commits.in_window(rows, "2021-08-09T02:00:00+02:00", "2021-08-11T02:00:00+02:00")
    assert values(shifted, "commit_id") == [(1,), (2,)]
    with pytest.raises(ValueError):
        commits.in_window(rows, "2021-08-09T00:00:00", "2021-08-11T00:00:00")


def test_window_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([], COMMITS).write.parquet(str(tmp_path / "c"))
    found = commits.in_window(rows.scan(spark, str(tmp_path / "c"), COMMITS), "2021-08-09T00:00:00Z", "2021-08-11T00:00:00Z")
    plan = found.select("commit_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(commit_date" in plan
    assert "commit_message" not in plan


def test_instants_do_not_depend_on_the_session_zone(spark, table):
    raw = table([("2021-03-28T01:30:00Z",), ("2021-03-28T03:30:00+02:00",), ("never",)], "text string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert values(raw.select(C.utc_instant(F.col("text")))) == [
                (None,),
                (datetime(2021, 3, 28, 1, 30),),
                (datetime(2021, 3, 28, 1, 30),),
            ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_line_totals(table):
    files = table([(1, 3, 0, 3), (1, 0, 0, 0), (2, 0, 0, 0)], "commit_id long, lines_added long, lines_deleted long, lines_changed long")
    totals = commits.line_totals(table([(1,), (2,), (3,)], "commit_id long"), files)
    assert values(totals) == [(1, 3, 0, 3, 1), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0)]


def test_commits_without_files_stay(table):
    found = commits.with_files(table([(1,), (2,)], "commit_id long"), table([(1, "a"), (1, "b")], "commit_id long, filename string"))
    assert values(found) == [(1, "a"), (1, "b"), (2, None)]


def test_first_sighting_and_branches(table):
    seen = table([(1, "a", 2, "dev", "late"), (1, "a", 1, "main", "early"), (2, "a", 5, "main", "other"), (1, "a", 3, "dev", "again")], SEEN)
    assert values(commits.first_sightings(seen)) == [(1, "a", 1, "main", "early"), (2, "a", 5, "main", "other")]
    assert values(commits.branches(seen)) == [(1, "a", "dev"), (1, "a", "main"), (2, "a", "main")]
    assert values(commits.repository_branches(seen)) == [(1, "dev"), (1, "main"), (2, "main")]


def test_latest_breaks_ties_by_sha(table):
    day = datetime(2021, 1, 1)
    found = commits.latest(table([(1, 1, "a", day, 1), (2, 1, "b", day, 2), (3, 2, "z", day, 3)], SMALL))
    assert values(found, "repo_id", "sha1") == [(1, "b"), (2, "z")]


def test_high_water_mark_includes_its_own_date(table):
    day = [datetime(2021, 1, n) for n in (1, 2, 3)]
    stored = table([(1, 1, "a", day[1], 1)], SMALL)
    feed = table([(0, 1, "old", day[0], 1), (0, 1, "a", day[1], 2), (0, 1, "b", day[1], 3), (0, 1, "b", day[1], 4), (0, 2, "c", day[0], 5)], SMALL)
    assert values(fetch.since_high_water_mark(feed, stored), "sha1") == [("a",), ("b",), ("b",), ("c",)]
    assert values(fetch.new_commits(feed, stored), "sha1", "seq") == [("b", 3), ("c", 5)]
    assert values(fetch.new_commits(feed, stored, all_history=True), "sha1") == [("b",), ("c",), ("old",)]


def test_validation(table):
    bad = table(
        [(None, None, "m", "s", 1), (1, None, None, "s", 1), (None, 1, "m", None, 1), (1, 1, "m", "s", None), (1, None, "m", "s", 1)],
        "author_id long, committer_id long, commit_message string, sha1 string, repo_id long",
    )
    assert values(commits.validate(bad), "problem") == sorted(
        [("no author or committer",), ("no message",), ("no sha",), ("no repository",), (None,)], key=repr
    )


def test_upsert_and_delete(table):
    base = table([(1, "a"), (2, "b")], "id long, v string")
    new = table([(2, "c"), (3, "d")], "id long, v string")
    assert values(rows.upsert(base, new, ["id"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert values(rows.delete(base, new, ["id"])) == [(1, "a")]
    assert rows.delete_all(base).count() == 0
    assert values(rows.exists(base, new, "id")) == [(2, True), (3, False)]
    assert values(rows.lookup_one(base, "id", 1)) == [(1, "a")]


def test_feed_from_json(spark, tmp_path):
    from tallyline.schemas import RAW_COMMITS

    (tmp_path / "feed.json").write_text(
        '{"repo_id":1,"seq":1,"sha":"a","branch":"main","author":{"name":"A","email":null},"message":"m",'
        '"date":"2021-08-09T00:00:00Z","parents":["p"],"url":"u","files":[{"filename":"A.java","additions":2,'
        '"deletions":0,"changes":2,"blob_url":null,"patch":"@@"},{"filename":"b.md","additions":0,"deletions":0,"changes":0}]}\n'
        '{"repo_id":1,"seq":2,"sha":"a","branch":"dev","author":{"name":"B"},"message":"n","parents":["p"],"url":"u"}\n'
    )
    raw = feeds.read_json(spark, str(tmp_path / "feed.json"), RAW_COMMITS)
    [row] = feeds.ingest_commits(raw).collect()
    assert (row["author_name"], row["lines_added"], row["files_changed"], row["parent"]) == ("A", 2, 1, "p")
    assert values(feeds.ingest_commit_files(raw), "filename", "url") == [("A.java", None), ("b.md", None)]
    assert values(commits.branches(feeds.branch_sightings(raw)), "branch") == [("dev",), ("main",)]


def test_a_record_without_place_or_date_is_kept_whole(table):
    feed = table([(1, "a", None, "late", None), (1, "a", 5, "first", None), (1, "b", None, "only", None)], "repo_id long, sha1 string, seq long, message string, commit_date timestamp_ntz")
    assert values(commits.first_sightings(feed), "sha1", "message") == [("a", "first"), ("b", "only")]
    stored = table([(1, "z", datetime(2021, 1, 1))], "repo_id long, sha1 string, commit_date timestamp_ntz")
    assert values(fetch.new_commits(feed, stored), "sha1") == [("a",), ("b",)]
