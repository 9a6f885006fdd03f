"""Acceptance cases of change extraction: pairs of texts, their changes and scores."""

from collections import Counter

import pytest
from conftest import values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyline.operators import changes, scoring

FIELD = "public class Shelf {\n  private String label;\n%s}\n"

CASES = {
    "hash code": (FIELD % "", FIELD % "public int hashCode() { int p = 3; return p * label.hashCode(); }", 0, []),
    "equals": (FIELD % "", FIELD % "@Override public boolean equals(Object o) { return o == this; }", 0, []),
    "getter": (FIELD % "", FIELD % "public String getLabel() { return this.label; }", 0, []),
    "setter": (FIELD % "", FIELD % "public void setLabel(String s) { label = s; }", 0, []),
    "setter of a test": (FIELD % "", FIELD % "@Before public void setUp() { label = make(); }", 0, []),
    "getter with logic": (
        FIELD % "",
        FIELD % "public String getLabel() { int width = measure(7); return pad(width); }",
        34,
        ["METHOD_INVOCATION", "VARIABLE_DECLARATION_STATEMENT", "RETURN_STATEMENT", "METHOD"],
    ),
    "setter with logic": (
        FIELD % "",
        FIELD % "void setLabel(String s) { label = s.trim(); if (label.isEmpty()) throw new Empty(); }",
        37,
        ["THROW_STATEMENT", "THEN_STATEMENT", "IF_STATEMENT", "ASSIGNMENT", "METHOD"],
    ),
    "class content": (
        "public class Shelf {}",
        FIELD % "long area(int w) { final long h = 3L; long a = w * h; return a; }",
        44,
        ["VARIABLE_DECLARATION_STATEMENT"] * 2 + ["RETURN_STATEMENT", "METHOD", "FIELD"],
    ),
    "nested class": (
        FIELD % "",
        FIELD
        % """static class Row {
          int width; long depth;
          int free(Row next) { int gap = next.start(); return gap - width; }
        }
        private boolean full;""",
        192,
        ["CONSTRUCTOR_INVOCATION", "METHOD_INVOCATION", "VARIABLE_DECLARATION_STATEMENT", "RETURN_STATEMENT"]
        + ["METHOD"] * 2
        + ["FIELD"] * 3
        + ["CLASS"],
    ),
    "methods": (
        FIELD % "int same() { return 4; }",
        FIELD % "long more(long n) { log(n); long half = n / 2; return half; } int same() { return 5; }",
        37,
        ["METHOD_INVOCATION", "VARIABLE_DECLARATION_STATEMENT", "RETURN_STATEMENT", "METHOD", "RETURN_STATEMENT"],
    ),
    "no old file": (
        "",
        FIELD % "long area(int w) { final long h = 3L; long a = w * h; return a; }",
        144,
        ["VARIABLE_DECLARATION_STATEMENT"] * 2 + ["RETURN_STATEMENT", "METHOD", "FIELD", "CLASS"],
    ),
    "first user, singleton": (
        "",
        """public class One {
          static One only;
          static One getInstance() { if (only == null) { only = new One(); } return only; }
        }""",
        147,
        ["ASSIGNMENT", "THEN_STATEMENT", "IF_STATEMENT", "RETURN_STATEMENT", "METHOD", "FIELD", "CLASS"],
    ),
    "first user, comment": (
        "",
        "public class Two { int a; int b; void go() { /* well */ a = 1; b = 2; } }",
        152,
        ["BLOCK_COMMENT", "ASSIGNMENT", "ASSIGNMENT", "METHOD", "FIELD", "FIELD", "CLASS"],
    ),
    "second user, tests": (
        "",
        """public class OneTest {
          One one;
          @Before public void setUp() { one = One.getInstance(); }
          @Test public void first() { assertEquals(1, one.a()); }
          @Test public void second() { assertEquals(2, one.b()); }
        }""",
        172,
        ["METHOD_INVOCATION", "ANNOTATION"] * 2 + ["METHOD", "METHOD", "FIELD", "CLASS"],
    ),
    "deletions": (FIELD % "int gone() { return 1; }", FIELD % "", 0, []),
    "layout only": (FIELD % "int a() { return 1; }", FIELD % "int a()\n{\n return 1;\n}", 0, []),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(1, name, "S.java", old, new) for name, (old, new, _, _) in CASES.items()]
    rows.append((1, "broken", "S.java", "class A {}", "class A { /* open"))
    pairs = spark.createDataFrame(rows, "repo_id long, sha1 string, filename string, old_text string, new_text string")
    return pairs, changes.extract_changes(pairs).cache()


@pytest.mark.parametrize("name", CASES)
def test_case(found, name):
    _, _, score, expected = CASES[name]
    rows = scoring.score_changes(found[1].where(F.col("sha1") == name)).collect()
    assert sum(row["score"] for row in rows) == score
    assert Counter(row["entity_type"] for row in rows if row["change_op"] != "DELETE") == Counter(expected)


def test_an_update_keeps_the_old_name(found):
    rows = found[1].where("sha1 = 'methods' AND change_op = 'UPDATE'")
    assert values(rows, "entity_type", "unique_name") == [("RETURN_STATEMENT", "return 4;")]


def test_names_of_a_nested_class(found):
    rows = found[1].where("sha1 = 'nested class' AND entity_type IN ('METHOD', 'CLASS', 'FIELD', 'CONSTRUCTOR_INVOCATION')")
    assert {name for (name,) in values(rows, "unique_name")} == {
        "super();",
        "Shelf.Row.Row()",
        "Shelf.Row.free(Row)",
        "Shelf.Row.width : int",
        "Shelf.Row.depth : long",
        "Shelf.full : boolean",
        "Shelf.Row",
    }


def test_one_unreadable_file_leaves_the_rest(found):
    pairs, rows = found
    assert values(changes.quarantine(pairs)) == [(1, "broken", "S.java", 1, "unterminated comment or text block")]
    assert rows.where("sha1 = 'broken'").count() == 0
    assert rows.count() > 0


def test_missing_and_renamed_files_have_an_empty_old_text(table):
    files = table([(1, "c2", "c1", "New.java"), (1, "c2", "c1", "Kept.java")], "repo_id long, sha1 string, parent string, filename string")
    revisions = table(
        [(1, "c1", "Old.java", "o"), (1, "c2", "New.java", "n"), (1, "c1", "Kept.java", "a"), (1, "c2", "Kept.java", "b")],
        "repo_id long, sha1 string, filename string, text string",
    )
    pairs = changes.pair_file_revisions(files, revisions)
    assert values(pairs, "filename", "old_text", "new_text") == [("Kept.java", "a", "b"), ("New.java", "", "n")]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(*[st.lists(st.sampled_from(["a", "b  b", "b b", " c", "", "d"]), max_size=8)] * 2), min_size=1, max_size=5))
def test_line_diff_against_brute_force(spark, texts):
    rows = [(n, "\n".join(old), "\n".join(new)) for n, (old, new) in enumerate(texts)]
    pairs = spark.createDataFrame(rows, "id long, old_text string, new_text string")
    expected = []
    for n, (old, new) in enumerate(texts):
        before, after = (Counter(" ".join(line.split()) for line in side if line.strip()) for side in (old, new))
        expected += [(n, line, "INSERT", count) for line, count in (after - before).items()]
        expected += [(n, line, "DELETE", count) for line, count in (before - after).items()]
    assert values(changes.diff_revision_lines(pairs, ["id"])) == sorted(expected, key=repr)


def test_many_texts_in_small_batches(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("commit_id"),
        F.lit("A.java").alias("filename"),
        F.lit("").alias("old_text"),
        F.when(F.col("id") % 10 == 3, "class A { /*").otherwise(F.concat(F.lit("class A { int f"), "id", F.lit("; }"))).alias("new_text"),
    )
    found = changes.extract_changes(rows, ["commit_id", "filename"])
    assert found.count() == 2 * 2700
    assert found.select("commit_id").distinct().count() == 2700
    names = found.where("entity_type = 'FIELD' AND commit_id < 6")
    assert values(names, "commit_id", "unique_name") == [(n, f"A.f{n} : int") for n in (0, 1, 2, 4, 5)]


def test_equal_entities_cancel_before_the_shuffle(found):
    pairs, _ = found
    frame = changes.extract_changes(pairs)
    plan = [line.strip(" :+-*()0123456789") for line in frame._jdf.queryExecution().executedPlan().toString().splitlines()]
    deepest = max(n for n, line in enumerate(plan) if line.startswith("Exchange"))
    assert "partial_sum" in plan[deepest + 1]
