"""Batch run configuration: which repositories to summarise, and how."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BATCH_CONFIG


def read_batch_config(spark: SparkSession, path: str) -> DataFrame:
    return matchers(spark.read.schema(BATCH_CONFIG).json(path, multiLine=True))


def matchers(config: DataFrame) -> DataFrame:
    """One row per entry of ``repositories``; ``run_id`` is its position in the file."""
    return config.select("organisation", F.posexplode("repositories").alias("run_id", "r")).select(
        "run_id",
        "organisation",
        F.col("r.exactMatch").alias("exact_match"),
        "r.name",
        F.coalesce("r.excludeGUI", F.lit(False)).alias("exclude_gui"),
        F.col("r.startDate").alias("start_date"),
        F.col("r.endDate").alias("end_date"),
    )
