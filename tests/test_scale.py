"""A key that holds a third of the rows must not end up in one task."""

import contextlib
import re

import pytest
from pyspark.sql import functions as F

from tallyline.operators import commits, scoring, users
from tallyline.operators.spread import join_one

ROWS = 60000


@contextlib.contextmanager
def small_limits(spark):
    """The limits of adaptive execution scaled down to the size of a test."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(frame):
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def largest_task(frame):
    """Rows of the task that makes most of them."""
    return frame.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]


def hot(spark, others):
    """Keys of which 0 holds a third of the rows."""
    return spark.range(0, ROWS, 1, 8).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % others).alias("key")
    )


def test_files_of_a_hot_commit_are_split(spark):
    files = hot(spark, 997).select(F.col("key").alias("commit_id"), F.concat(F.lit("src/"), F.md5(F.col("id").cast("string"))).alias("filename"))
    history = spark.range(2000).select(F.col("id").alias("commit_id"))
    with small_limits(spark):
        found = commits.with_files(history, files)
        assert "skewed" in final_plan(found)
    assert found.count() == ROWS + 2000 - 997


def test_commits_of_a_hot_user_are_split(spark):
    history = hot(spark, 997).select(
        F.lit(1).cast("bigint").alias("repo_id"), F.col("key").alias("author_id"), F.md5(F.col("id").cast("string")).alias("sha1"),
        F.lit("2021-01-01").cast("timestamp_ntz").alias("commit_date"), F.md5(F.col("id").cast("string")).alias("commit_message"), F.lit("u").alias("url"),
    )
    percents = spark.range(997).select(F.lit(1).cast("bigint").alias("repo_id"), F.col("id").alias("user_id"), F.lit(1).alias("score"), F.lit(0.1).alias("percent"))
    with small_limits(spark):
        found = scoring.users_with_commits(percents, history)
        plan = final_plan(found)
    assert "skewed" in plan and "rangepartitioning" in plan
    assert found.count() == ROWS


def test_users_of_a_hot_repository_are_spread(spark):
    scores = hot(spark, 97).select(F.col("key").alias("repo_id"), F.col("id").alias("user_id"), F.lit(2).alias("score"))
    people = spark.range(ROWS).select(F.col("id").alias("user_id"), F.lit(False).alias("excluded"))
    with small_limits(spark):
        found = scoring.score_percent(scores, people)
        assert largest_task(found) < ROWS / 4
    assert found.agg(F.round(F.sum("percent"), 6)).first()[0] == 9700.0


def test_aliases_of_a_hot_address_are_spread(spark):
    people = hot(spark, 997).select(F.col("id").alias("user_id"), F.md5(F.col("id").cast("string")).alias("name"), F.col("key").cast("string").alias("email"))
    with small_limits(spark):
        found = users.alias_groups(people)
        assert largest_task(found) < ROWS / 4
    assert found.count() == ROWS


def test_spread_join_equals_a_plain_join(spark):
    rows = hot(spark, 97)
    one_each = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("key % 2 = 0")
    for how in ("inner", "left"):
        found, plain = join_one(rows, one_each, ["key"], ["id"], how), rows.join(one_each, "key", how)
        assert found.exceptAll(plain.select(found.columns)).count() == 0
        assert found.count() == plain.count()


@pytest.mark.parametrize("operator", [commits.latest, commits.first_sightings, commits.branches, commits.calendar_days])
def test_grouping_reduces_before_the_shuffle(spark, operator):
    history = hot(spark, 97).select(
        F.col("key").alias("repo_id"), F.col("key").cast("string").alias("sha1"), F.col("id").alias("commit_id"), F.col("id").alias("seq"),
        F.lit("2021-01-01").cast("timestamp_ntz").alias("commit_date"), F.lit("main").alias("branch"),
        F.lit(1).alias("lines_added"), F.lit(1).alias("lines_removed"), F.lit(1).alias("lines_changed"),
    )
    plan = final_plan(operator(history))
    assert "Window" not in plan and "collect_" not in plan
    assert len(re.findall(r"(?:Hash|Sort)Aggregate\(", plan.split("Initial Plan")[0])) == 2
