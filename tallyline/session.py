"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Joins on a repository, an author or a commit may meet a key that holds much of
# the data. Adaptive execution splits such a partition over several tasks and
# turns a join into a broadcast only after it has measured the shuffled side.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def builder(app_name: str = "tallyline") -> SparkSession.Builder:
    out = SparkSession.builder.appName(app_name)
    for key, value in ADAPTIVE.items():
        out = out.config(key, value)
    return out


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tallyline-")
    jvm = spark.sparkContext._jvm
    return f"{base.rstrip('/')}/tallyline-{jvm.java.util.UUID.randomUUID()}"


# For rows of hundreds of kilobytes: else a page takes a hundred of them, a row group thousands, and their
# readers and writers hold as much at a time.
LARGE_VALUES = {"parquet.page.row.count.limit": "4", "parquet.block.row.count.limit": "8"}


def stored(rows: DataFrame, **options: str) -> DataFrame:
    """Writes rows that several results read to the shared folder, and reads them from there.

    The plan is cut and the rows survive the loss of executors. ``options`` are
    the writer's; rows with values of many kilobytes need ``LARGE_VALUES``.
    """
    path = shared_dir(rows.sparkSession)
    rows.write.options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
