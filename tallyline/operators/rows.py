"""Whole-table operations that every domain table shares.

Operations that change a table return the new table; the caller writes it as a
new snapshot.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def count_rows(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_rows"))


def lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return rows.join(keys.select(key), key, "left_semi")


def lookup_one(rows: DataFrame, key: str, value: object) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


def exists(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Each distinct key with the answer to whether the table has it."""
    known = rows.select(key).distinct().withColumn("found", F.lit(True))
    return keys.select(key).distinct().join(known, key, "left").select(
        key, F.coalesce("found", F.lit(False)).alias("found")
    )


def by_example(rows: DataFrame, example: Mapping[str, object]) -> DataFrame:
    """Rows equal to every non-null field of the example."""
    wanted: Column = F.lit(True)
    for name, value in example.items():
        if value is not None:
            wanted = wanted & (F.col(name) == F.lit(value))
    return rows.where(wanted)


def upsert(rows: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the same key are overwritten, the others added. ``updates`` holds each key once."""
    return rows.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def delete_all(rows: DataFrame) -> DataFrame:
    return rows.limit(0)
