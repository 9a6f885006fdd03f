import json
import os
from datetime import datetime

from conftest import values
from pyspark.sql import functions as F

from tallyline.plans import batch, contributions
from tallyline.sources import config, pages

REPOSITORIES = "repo_id long, repository_name string, organisation_name string"
COMMITS = (
    "commit_id long, repo_id long, sha1 string, parent string, is_merge_commit boolean, author_id long, "
    "commit_date timestamp_ntz, commit_message string, url string, lines_added long, lines_removed long, lines_changed long"
)
CHANGES = "commit_id long, filename string, change_op string, entity_type string, unique_name string"
USERS = "user_id long, name string, email string, excluded boolean"


def history(table):
    rows = [
        (1, 1, "a", "p", False, 1, datetime(2021, 1, 1, 12), 'say "hi"', "u1", 1, 2, 3),
        (2, 1, "b", "p", False, 2, datetime(2021, 2, 1), "m2", "u2", 0, 0, 0),
        (3, 1, "c", "p", False, 1, datetime(2021, 3, 1), None, "u3", 0, 0, 0),
        (4, 2, "d", "p", False, 1, datetime(2021, 3, 1), "m4", "u4", 0, 0, 0),
        (5, 2, "e", None, False, 2, datetime(2021, 3, 1), "root", "u5", 0, 0, 0),
    ]
    changes = [
        (1, "src/A.java", "INSERT", "CLASS", "A"),
        (1, "src/A.java", "INSERT", "FIELD", "A.x : int"),
        (1, "src/A.java", "INSERT", "RETURN_STATEMENT", "return 1;"),
        (1, "src/A.java", "INSERT", "RETURN_STATEMENT", "return 1;"),
        (1, "src/ui/B.java", "INSERT", "CLASS", "B"),
        (2, "src/A.java", "UPDATE", "METHOD", "A.f()"),
        (3, "src/A.java", "DELETE", "METHOD", "A.g()"),
        (4, "src/C.java", "INSERT", "METHOD", "C.h()"),
    ]
    users = [(1, "Ann", "ann@e", False), (2, "Ann", "ann@e", False)]
    names = [(1, "proj-1", "org"), (2, "proj-2", "org"), (3, "other", "org"), (4, "proj-1", "elsewhere")]
    return table(names, REPOSITORIES), table(rows, COMMITS), table(changes, CHANGES), table(users, USERS)


def test_config_file(spark, tmp_path):
    path = tmp_path / "run.json"
    path.write_text(
        json.dumps(
            {
                "organisation": "org",
                "repositories": [
                    {"exactMatch": True, "name": "proj-1", "excludeGUI": True, "startDate": "2021-01-01T00:00:00Z", "endDate": "2021-02-01T00:00:00Z"},
                    {"exactMatch": False, "name": "proj", "excludeGUI": False},
                    {"exactMatch": True, "name": "gone"},
                ],
            },
            indent=2,
        )
    )
    found = config.read_batch_config(spark, str(path))
    assert values(found, "run_id", "name", "exact_match", "exclude_gui", "end_date") == [
        (0, "proj-1", True, True, "2021-02-01T00:00:00Z"),
        (1, "proj", False, False, None),
        (2, "gone", True, False, None),
    ]


def matchers(table):
    return table(
        [
            (0, "org", True, "proj-1", True, "2021-01-01T00:00:00Z", "2021-02-01T00:00:00Z"),
            (1, "org", False, "proj", False, "2021-01-01T00:00:00Z", None),
            (2, "org", True, "gone", False, None, None),
            (3, "org", False, "", True, None, None),
        ],
        "run_id int, organisation string, exact_match boolean, name string, exclude_gui boolean, start_date string, end_date string",
    )


def test_matching_and_report(table):
    repositories, *_ = history(table)
    found = batch.match_repositories(matchers(table), repositories)
    assert values(found, "run_id", "repo_id") == [(0, 1), (1, 1), (1, 2), (3, 1), (3, 2), (3, 3)]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    rows = batch.report(matchers(table), repositories)
    assert values(rows.where("status = 'failed'"), "repository_name", "reason") == [("gone", "Repository not found")]
    assert values(batch.report_counts(rows), "status", "n_runs", "n_repositories") == [("failed", 1, 1), ("succeeded", 6, 3)]


def test_each_run_has_its_own_window_and_gui_option(table):
    repositories, commits, changes, users = history(table)
    matched = batch.match_repositories(matchers(table), repositories)
    found = batch.user_percent(matched, commits, changes, users)
    assert values(found, "run_id", "repo_id", "user_id", "score") == [
        (0, 1, 1, 116),
        (0, 1, 2, 25),
        (1, 1, 1, 216),
        (1, 1, 2, 25),
        (1, 2, 1, 25),
        (3, 1, 1, 116),
        (3, 1, 2, 25),
        (3, 2, 1, 25),
    ]
    shares = batch.file_shares(matched, commits, changes)
    assert values(shares.where("run_id = 1 AND file = 'B.java'"), "user_id", "share") == [(1, 1.0)]
    assert shares.where("run_id = 0 AND file = 'B.java'").count() == 0


def test_a_batch_of_one_equals_a_single_summary(table):
    repositories, commits, changes, users = history(table)
    one = batch.user_percent(batch.match_repositories(matchers(table), repositories).where("run_id = 3"), commits, changes, users)
    single = contributions.summary(repositories, commits, changes, users)["users"]
    assert values(one.select("repo_id", "user_id", "score", "percent")) == values(single.select("repo_id", "user_id", "score", "percent"))


def expected_document():
    user = {
        "contributionsScore": 116,
        "contributionsScorePercent": 11600 / 141,
        "binnedChangesCounts": {"Class additions": 1, "Field additions": 1, "Other additions": 2},
        "commits": [
            {"date": 1614556800.0, "lines_added": 0, "lines_removed": 0, "lines_changed": 0, "commit_message": None, "url": "u3"},
            {"date": 1609502400.0, "lines_added": 1, "lines_removed": 2, "lines_changed": 3, "commit_message": 'say "hi"', "url": "u1"},
        ],
        "changes": [
            {
                "fileName": "src/A.java",
                "score": 116,
                "binnedChangesCounts": {"Class additions": 1, "Field additions": 1, "Other additions": 2},
                "allChanges": [
                    {"change": "INSERT CLASS A", "count": 1},
                    {"change": "INSERT FIELD A.x : int", "count": 1},
                    {"change": "INSERT RETURN_STATEMENT return 1;", "count": 2},
                ],
            },
            {"fileName": "src/A.java", "score": 0, "binnedChangesCounts": {}, "allChanges": []},
        ],
    }
    other = {
        "contributionsScore": 25,
        "contributionsScorePercent": 2500 / 141,
        "binnedChangesCounts": {"Method updates": 1},
        "commits": [{"date": 1612137600.0, "lines_added": 0, "lines_removed": 0, "lines_changed": 0, "commit_message": "m2", "url": "u2"}],
        "changes": [
            {
                "fileName": "src/A.java",
                "score": 25,
                "binnedChangesCounts": {"Method updates": 1},
                "allChanges": [{"change": "UPDATE METHOD A.f()", "count": 1}],
            }
        ],
    }
    return {
        "repo": "proj-1",
        "startDate": 1609459200.0,
        "endDate": 1640995200.0,
        "changesPerUser": {"Ann (ann@e) #1": user, "Ann (ann@e) #2": other},
        "changesPerFile": {"A.java": {"Ann (ann@e) #1": 116 / 141, "Ann (ann@e) #2": 25 / 141}},
    }


def read_documents(path):
    found = {}
    for folder in sorted(os.listdir(path)):
        if "=" in folder:
            names = sorted(name for name in os.listdir(os.path.join(path, folder)) if name.startswith("part-"))
            found[folder.split("=")[1]] = "".join(open(os.path.join(path, folder, name)).read() for name in names)
    return found


def test_documents(table, tmp_path):
    lines = contributions.documents(*history(table), "2021-01-01T00:00:00Z", "2022-01-01T00:00:00Z")
    pages.write_documents(lines, str(tmp_path / "out"), ["repo_id"])
    found = read_documents(tmp_path / "out")
    assert sorted(found) == ["1", "2"]
    assert json.loads(found["1"]) == expected_document()
    assert list(json.loads(found["2"])["changesPerUser"]) == ["Ann (ann@e)"]


def test_pages(table, tmp_path):
    lines = contributions.documents(*history(table))
    (tmp_path / "page.html").write_text("<script>var a = DATA;</script>\n<script>var b = DATA;</script>")
    template = pages.read_template(lines.sparkSession, str(tmp_path / "page.html"))
    page = pages.page_lines(lines, template, "DATA", ["repo_id"])
    pages.write_documents(page, str(tmp_path / "out"), ["repo_id"], ["place", *pages.SORT])
    text = read_documents(tmp_path / "out")["1"]
    first, second = (part.split(";</script>")[0] for part in text.replace("\n", "").split("= ")[1:])
    assert json.loads(first) == json.loads(second)
    assert json.loads(first)["startDate"] is None


def test_a_large_document_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(20000).select(
        F.lit(1).alias("repo_id"), *(F.lit(0 if n in ("section", "part", "item") else "").alias(n) for n in pages.SORT[:-1]),
        F.lpad(F.col("id").cast("string"), 9, "0").alias("c"), F.col("id").cast("string").alias("text"),
    ).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages.write_documents(rows, str(tmp_path / "out"), ["repo_id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = [n for n in os.listdir(tmp_path / "out" / "document=1") if n.startswith("part-")]
    assert len(parts) > 1
    assert read_documents(tmp_path / "out")["1"].split() == [str(n) for n in range(20000)]


MATCHERS = "run_id int, organisation string, exact_match boolean, name string, exclude_gui boolean, start_date string, end_date string"


def test_one_repository_in_two_runs_gives_two_documents(table, tmp_path):
    repositories, commits, changes, users = history(table)
    matchers = table(
        [(0, "org", True, "proj-1", True, None, None), (1, "org", False, "proj", False, "2021-02-01T00:00:00Z", "2021-12-31T00:00:00Z")],
        MATCHERS,
    )
    lines = batch.documents(batch.match_repositories(matchers, repositories), commits, changes, users)
    pages.write_documents(lines, str(tmp_path / "out"), batch.GROUP)
    found = {name: json.loads(text) for name, text in read_documents(tmp_path / "out").items()}
    assert sorted(found) == ["0-1", "1-1", "1-2"]
    assert found["0-1"]["startDate"] is None and found["1-1"]["startDate"] == 1612137600.0
    assert found["0-1"]["changesPerUser"]["Ann (ann@e) #1"]["contributionsScore"] == 116
    assert found["1-1"]["changesPerUser"]["Ann (ann@e) #1"]["contributionsScore"] == 0


def test_wrong_options_fail_by_name(table):
    repositories, commits, changes, users = history(table)
    day = "2021-01-01T00:00:00Z"
    matchers = table(
        [
            (0, "org", None, "proj-1", False, None, None),
            (1, "org", True, "proj-1", False, "2021-08-09", "2022-01-01T00:00:00Z"),
            (2, "org", True, "proj-1", False, day, "2021-13-45T00:00:00Z"),
            (3, "org", True, "proj-1", False, day, "2021-06-01T02:00:00+02:00"),
            (4, "org", True, "gone", False, None, None),
        ],
        MATCHERS,
    )
    assert values(batch.report(matchers, repositories), "run_id", "status", "reason") == [
        (0, "failed", "exactMatch is missing"),
        (1, "failed", "startDate is no instant: 2021-08-09"),
        (2, "failed", "endDate is no instant: 2021-13-45T00:00:00Z"),
        (3, "succeeded", None),
        (4, "failed", "Repository not found"),
    ]
    matched = batch.match_repositories(matchers, repositories)
    assert values(batch.user_percent(matched, commits, changes, users).select("run_id").distinct()) == [(3,)]
