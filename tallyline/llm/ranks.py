"""Ranks over a whole table without bringing it together anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.session import stored


def ranked(rows: DataFrame, able: Column, percent: int, score: str, tie: str) -> DataFrame:
    """Adds ``rank``, from 1, for the highest ``percent`` of the rows that are ``able``; null for all others.

    Order is by descending ``score``, an integer, then ascending ``tie``. Counts
    of the distinct scores say which score is the last to be drawn; only the rows
    from there on are sorted, by range, and each is numbered within its range
    and gets the size of the ranges before it. ``rows`` must give the same rows
    whenever they are read, e.g. as a written table.
    """
    per_score = rows.where(able).groupBy(score).agg(F.count("*").alias("_n"))
    wanted = F.expr(f"sum(_n) OVER () * {percent} div 100")
    above = F.sum("_n").over(Window.orderBy(F.desc(score))) - F.col("_n")
    # distinct scores are few, whatever the number of rows
    cut = per_score.select(score, wanted.alias("_wanted"), above.alias("_above")).where("_above < _wanted")
    last = cut.agg(F.min(score).alias("last"), F.max("_wanted").alias("wanted")).first()
    out = rows.withColumn("rank", F.lit(None).cast("long"))
    if last["last"] is None:
        return out
    near = able & (F.col(score) >= last["last"])
    # equal rows may not fall into one range: where a row was read from tells them apart
    place = F.monotonically_increasing_id().alias("_place")
    within = rows.where(near).select("*", place).orderBy(F.desc(score), tie, "_place").drop("_place")
    at = F.monotonically_increasing_id()
    within = stored(
        within.select(*rows.columns, F.shiftright(at, 33).alias("_range"), at.bitwiseAND((1 << 33) - 1).alias("_at"))
    )
    sizes = within.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("_before") + F.col("_at") + 1
    placed = within.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    drawn = placed.select(*rows.columns, F.when(rank <= last["wanted"], rank).alias("rank"))
    return out.where(F.coalesce(~near, F.lit(True))).unionByName(drawn)
