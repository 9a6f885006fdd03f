"""What the findings of round 3 asked for."""

import pytest
from pyspark.sql import functions as F

from tallyline.catalog import all_queries
from tallyline.operators import changes, spread


def tasks_with_rows(frame):
    return frame.select(F.spark_partition_id().alias("task")).distinct().count()


def test_texts_of_one_file_are_read_by_many_tasks(spark):
    """a table in one partition, as a file with one row group is."""
    text = F.concat(F.lit("class A { int f"), F.col("id").cast("string"), F.lit("; }"))
    revisions = spark.range(0, 400, 1, 1).select(F.col("id").cast("string").alias("sha1"), text.alias("text"))
    found = changes.extract_entities(revisions)
    assert tasks_with_rows(found) > 4
    assert found.count() == 800
    for more in (changes.without_boilerplate(found), changes.synthesise_nested_constructors(found)):
        assert tasks_with_rows(more) > 4


def test_texts_of_one_key_are_read_by_many_tasks(spark):
    """pairs whose keys are equal."""
    text = F.concat(F.lit("class A { int f"), F.col("id").cast("string"), F.lit("; }"))
    pairs = spark.range(0, 400, 1, 1).select(
        F.lit(1).cast("bigint").alias("repo_id"), F.lit("a").alias("sha1"), F.lit("A.java").alias("filename"),
        F.lit("class A {").alias("old_text"), text.alias("new_text"),
    )
    broken = changes.quarantine(pairs)
    assert tasks_with_rows(broken) > 4
    assert broken.count() == 400
    assert broken.select("side", "error").distinct().collect() == [(-1, "braces do not match")]


@pytest.mark.parametrize(
    "text", ["/**/ class A { /***/ int a; /** b */ void f() { /* c */ } // d\n}", 'class A { String s = """ x " """; }']
)
def test_kinds_of_comments_are_told_by_their_first_characters(spark, text):
    rows = changes.extract_entities(spark.createDataFrame([(text,)], "text string")).orderBy("ordinal").collect()
    comments = [row.entity_type for row in rows if row.entity_type.endswith(("COMMENT", "JAVADOC"))]
    assert comments == (["BLOCK_COMMENT", "JAVADOC", "JAVADOC", "BLOCK_COMMENT", "LINE_COMMENT"] if "/**/" in text else [])


def test_people_of_a_fetch_are_found_once(spark):
    """the plan of the new users stood in the plan of every role again, 64 exchanges in all."""
    found = all_queries()["fetched_members"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") < 40


def test_a_key_has_few_copies(spark):
    """a copy for each of 16 salts filled the sort of a task."""
    rows = spark.range(100).withColumnRenamed("id", "key")
    joined = spread.join_one(rows, rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), ["key"], ["key"])
    assert spread.SALTS <= 4
    assert joined.count() == 100
