"""Connected components of a table of links, by joins and grouping only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.session import stored


def _stars(links: DataFrame) -> DataFrame:
    """One large-star step, then one small-star step (Kiveris et al., 2014) over links (a > b)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    large = large.where("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("low"))
    small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return small.unionByName(least.withColumnRenamed("low", "b")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Smallest reachable value of every value that has a link: columns ``node``, ``root``.

    Links with a null or with equal ends say nothing and are ignored; repeated
    links count once; no links give no rows. Each round writes its links to the
    shared folder, so the plan stays short and lost executors cost one round.
    """
    links = links.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    links = stored(links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct())
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before, links = now, stored(_stars(links))
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
