"""F10 to F13: what the summary documents of round 3 cost."""

from tallyline.catalog import all_queries
from tallyline.sources import pages


def plan(found):
    return found._jdf.queryExecution().executedPlan().toString()


def test_changes_are_not_joined_with_their_files(spark):
    """The first change of a file came from a join of all changes with all files, on the whole key of a file."""
    found = all_queries()["summary_json"](spark, "/root/testdata/sf0.001")
    assert plan(found).count("Exchange ") <= 25
    assert plan(found).count("Join ") <= 13


def test_the_first_of_a_files_changes_is_told_by_name(table):
    commits = table([(1, 7, 1), (2, 7, 1)], "commit_id long, repo_id long, author_id long")
    rows = [
        (1, "A.java", "DELETE", "FIELD", "a"), (1, "A.java", "UPDATE", "METHOD", "b"), (1, "A.java", "INSERT", "METHOD", "c"),
        (1, "A.java", "INSERT", "METHOD", "c"), (1, "B.java", "UPDATE", "FIELD", "a"), (2, "A.java", "DELETE", "FIELD", "a"),
    ]
    changes = table(rows, "commit_id long, filename string, change_op string, entity_type string, unique_name string")
    found = pages._detail(commits, changes, ["repo_id"]).where("change_op <> 'DELETE'").collect()
    assert {(r.commit_id, r.filename, r.what) for r in found if r.is_first} == {(1, "A.java", "INSERT METHOD c"), (1, "B.java", "UPDATE FIELD a")}
    assert len(found) == 3
