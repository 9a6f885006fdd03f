"""what is equal on both sides of a file cancels before it leaves the reader, and one exchange serves the pairing."""

from pyspark.sql import functions as F

from tallyline.operators import changes

OLD = "class A { int a; void f() { go(); go(); stop(); } static class B { int b; } void g() { x(); } }"
NEW = "class A { int a; void f() { go(); stop(); halt(); } static class B { int b; } void h() { x(); } }"


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "repo_id long, sha1 string, filename string, old_text string, new_text string")


def quick(pairs):
    return changes.extract_changes(changes.marked(pairs), whole="whole")


def test_equal_entities_do_not_leave_the_reader(spark):
    pairs = pairs_of(spark, [(1, "a", "A.java", OLD, OLD), (1, "b", "A.java", OLD, NEW)])
    found = changes.scan_pairs(pairs.withColumn("whole", F.lit(False)), whole="whole")
    names = {(row.sha1, row.unique_name) for row in found.collect()}
    assert names >= {("b", "go();"), ("b", "halt();"), ("b", "A.g()"), ("b", "A.h()")}
    assert not names & {("a", "go();"), ("b", "stop();"), ("b", "A.a : int"), ("b", "A")}
    assert sorted(quick(pairs).collect()) == sorted(changes.extract_changes(pairs).collect())


def test_pairs_of_equal_keys_are_compared_together(spark):
    other = "class A { void f() { stop(); halt(); go(); } void z() { y(); } static class B { B() { super(); } } }"
    rows = [(None, "a", "A.java", OLD, NEW), (None, "a", "A.java", NEW, OLD), (None, "a", "A.java", OLD, other), (2, "a", None, other, NEW)]
    pairs = pairs_of(spark, rows)
    assert sorted(quick(pairs).collect(), key=str) == sorted(changes.extract_changes(pairs).collect(), key=str)


def test_two_exchanges_behind_the_reader(spark):
    pairs = pairs_of(spark, [(1, "b", "A.java", OLD, NEW)])
    plan = changes.extract_changes(pairs)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("MapInArrow")[0].count("Exchange ") == 2
