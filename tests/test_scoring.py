import random
from collections import defaultdict
from datetime import datetime

import pytest
from conftest import values
from pyspark.sql import functions as F

from tallyline.operators import commits, scoring
from tallyline.plans import contributions

COMMITS = "commit_id long, repo_id long, sha1 string, parent string, is_merge_commit boolean, author_id long, commit_date timestamp_ntz, commit_message string, url string"
CHANGES = "commit_id long, filename string, change_op string, entity_type string, unique_name string"
USERS = "user_id long, name string, email string, excluded boolean"


def commit(n, author, repo=1, parent="p", merge=False, day=1):
    return (n, repo, f"c{n}", parent, merge, author, datetime(2021, 8, day), "m", "u")


def change(n, kind, file="src/A.java", op="INSERT"):
    return (n, file, op, kind, "x")


@pytest.mark.parametrize(
    "kinds,score",
    [
        (["CLASS", "METHOD", "FIELD"], 135),
        (["CLASS", "METHOD", "FIELD", "ANNOTATION", "JAVADOC"], 139),
        (["CLASS", "ANNOTATION", "JAVADOC"], 104),
    ],
)
def test_score_of_a_file(table, kinds, score):
    rows = table([change(1, kind) for kind in kinds], CHANGES)
    assert values(scoring.file_change_scores(rows)) == [(1, "src/A.java", score, len(kinds))]


def test_score_of_two_files(table):
    rows = [change(1, kind) for kind in ("CLASS", "METHOD", "FIELD")]
    rows += [change(1, kind, "src/B.java") for kind in ("CLASS", "ANNOTATION", "JAVADOC")]
    scores = scoring.commit_scores(table([commit(1, 7)], COMMITS), table(rows, CHANGES))
    assert values(scores, "score") == [(239,)]


def two_users(table, excluded):
    history = table([commit(1, 1, parent=None), commit(2, 1), commit(3, 2), commit(4, 2, merge=True, parent=None)], COMMITS)
    rows = [change(2, k) for k in ("CLASS", "METHOD", "FIELD")] + [change(3, "METHOD", op="UPDATE"), change(4, "CLASS")]
    rows += [change(3, "CLASS", op="DELETE"), change(3, "CLASS", "src/view/B.java"), change(3, "CLASS", "notes.md")]
    users = table([(1, "A", "a@x", False), (2, "B", "b@x", excluded)], USERS)
    return history, table(rows, CHANGES), users


def test_percentages_of_two_users(table):
    rows = scoring.contribution_percent(*two_users(table, False))
    assert values(rows, "user_id", "score", "percent") == [(1, 135, 84.375), (2, 25, 15.625)]


def test_excluded_user_leaves_the_percentages_but_not_the_file_shares(table):
    history, rows, users = two_users(table, True)
    result = contributions.summary(table([(1, "r", "o")], "repo_id long, repository_name string, organisation_name string"), history, rows, users)
    assert values(result["users"], "user_id", "score", "percent") == [(1, 135, 100.0)]
    assert values(result["shares"], "file", "user_id", "share") == [("A.java", 1, 135 / 160), ("A.java", 2, 25 / 160)]
    assert values(result["matrix"], "file", "user_id", "share") == [("A.java", 1, 135 / 160)]
    assert result["repositories"].count() == 1


def test_zero_totals_give_null_and_users_without_code_stay(table):
    history = table([commit(1, 1), commit(2, 2)], COMMITS)
    rows = table([change(1, "CLASS", op="DELETE")], CHANGES)
    users = table([(1, "A", "a", False), (2, "B", "b", False)], USERS)
    percents = scoring.contribution_percent(history, rows, users)
    assert values(percents, "user_id", "score", "percent") == [(1, 0, None), (2, 0, None)]
    shares = scoring.file_user_shares(history, rows)
    assert values(shares, "file", "user_id", "score", "share") == [("A.java", 1, 0, None)]
    matrix = scoring.file_user_matrix(scoring.file_scores(history, rows), scoring.shown_users(history, users))
    assert values(matrix, "file", "user_id") == [("A.java", None), (None, 1), (None, 2)]


def test_no_covered_commit_gives_an_empty_result(table):
    history, rows, users = two_users(table, False)
    nothing = commits.in_window(history, "1999-01-01T00:00:00Z", "1999-02-01T00:00:00Z")
    result = scoring.contribution_percent(nothing, rows, users)
    assert result.count() == 0
    assert result.columns == scoring.contribution_percent(history, rows, users).columns


def test_gui_files_are_dropped_by_substring_and_java_files_kept_by_suffix(table):
    names = ["src/ui/A.java", "src/Guide.java", "build/X.java", "view.java", "Ui.java", "foojava", "a.md", "a.java.txt"]
    rows = table([change(1, "CLASS", name) for name in names], CHANGES)
    assert values(scoring.analysable_changes(rows), "filename") == [("Ui.java",), ("foojava",)]
    assert scoring.analysable_changes(rows, exclude_gui=False).count() == 6


def test_same_base_names_merge(table):
    rows = table([change(1, "CLASS", "a/A.java"), change(2, "METHOD", "b/A.java")], CHANGES)
    shares = scoring.file_user_shares(table([commit(1, 1), commit(2, 2)], COMMITS), rows)
    assert values(shares, "file", "user_id", "share") == [("A.java", 1, 0.8), ("A.java", 2, 0.2)]


def test_dense_chart(table):
    rows = table([change(1, "CLASS"), change(2, "METHOD"), change(2, "FIELD", "B.java")], CHANGES)
    history = table([commit(1, 1), commit(2, 2)], COMMITS)
    users = table([(1, "A", "a", False), (2, "B", "b", False)], USERS)
    matrix = scoring.file_user_matrix(scoring.file_scores(history, rows), scoring.shown_users(history, users))
    wide = scoring.pivot_users(matrix, [1, 2])
    assert values(wide, "file", "user_1", "user_2") == [("A.java", 0.8, 0.2), ("B.java", 0.0, 1.0)]


def test_users_with_commits_newest_first(table):
    history = table([commit(1, 1, day=1), commit(2, 1, day=3), commit(3, 1, day=2)], COMMITS)
    users = table([(1, "A", "a", False)], USERS)
    percents = scoring.contribution_percent(history, table([change(1, "CLASS")], CHANGES), users)
    rows = scoring.users_with_commits(percents, history).collect()
    assert [row["sha1"] for row in rows] == ["c2", "c3", "c1"]
    assert {row["score"] for row in rows} == {100}


def test_skewed_history_against_brute_force(spark, table):
    """One repository, one author and one commit hold most rows."""
    rng = random.Random(3)
    history, rows = [], []
    weight = {"CLASS": 100, "METHOD": 25, "FIELD": 10, "JAVADOC": 1, "IF_STATEMENT": 3}
    for n in range(300):
        hot = rng.random() < 0.4
        history.append(commit(n, 1 if hot else rng.randrange(2, 9), 1 if hot else rng.randrange(2, 5)))
    for _ in range(4000):
        n = 5 if rng.random() < 0.4 else rng.randrange(300)
        rows.append(change(n, rng.choice(list(weight)), f"src/F{rng.randrange(4)}.java", rng.choice(["INSERT", "UPDATE", "DELETE"])))
    score, per_file = defaultdict(int), defaultdict(int)
    owner = {c[0]: (c[1], c[5]) for c in history}
    for key in owner.values():
        score[key] += 0
    for n, file, op, kind, _ in rows:
        points = 0 if op == "DELETE" else weight[kind]
        score[owner[n]] += points
        per_file[(owner[n][0], file[4:], owner[n][1])] += points
    h, r = table(history, COMMITS), table(rows, CHANGES)
    assert values(scoring.user_scores(h, r)) == sorted(((*key, total) for key, total in score.items()), key=repr)
    found = scoring.file_user_shares(h, r).select("repo_id", "file", "user_id", "score")
    assert values(found) == sorted(((*key, total) for key, total in per_file.items()), key=repr)
    levels = scoring.summary_levels(h, r)
    for level in (1, 2, 3):
        assert levels.where(F.col("level") == level).agg(F.sum("score")).first()[0] == sum(score.values())


def test_scores_are_computed_once_for_scores_and_totals(table):
    plan = scoring.contribution_percent(*two_users(table, False))
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()
