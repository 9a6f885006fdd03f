"""Labelled texts for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row belongs to the fold that nothing may be learnt from; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def learnable(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """The label of every id that may be learnt from: ``id``, ``label`` (0 or 1), of several the largest."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    return known.groupBy("id").agg(F.max("label").alias("label"))


def sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """At most ``per_class`` learnable texts of each label: columns ``id``, ``text``, ``label``.

    The rows with the smallest hashes of their ids are taken, so the sample does
    not depend on the order or layout of the tables. Held-out ids, null ids, null
    labels and labels without a text are left out; of several labels of one id
    the largest counts. The sample is bounded by ``2 * per_class`` labels, which
    may therefore be broadcast.
    """
    known = learnable(labels, label, id_col)
    order = F.xxhash64("id"), F.col("id")
    parts = [known.where(F.col("label") == n).orderBy(*order).limit(per_class) for n in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(parts[0].unionByName(parts[1])), "id").select("id", "text", "label")
