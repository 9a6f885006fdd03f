"""A join of many rows with the one row of their key, for keys that may hold much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A power of 2, so that a salt is some bits of the hash and never NULL. Every key is copied as often, and copies
# pack so well that a merged shuffle partition holds very many, so there are only as many as a hot key needs.
SALTS = 4


def join_one(
    rows: DataFrame, one_each: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Joins ``rows`` with ``one_each``, which an aggregation made and which holds each key once.

    Joined by the key alone, Spark keeps the partitioning of the aggregation, and
    adaptive execution cannot split a hot key next to it. Rows of a key are
    therefore spread by a hash of the ``spread`` columns, against a copy of their
    counterpart each; both sides are shuffled for the join, so that a part that is
    still too large is split further.
    """
    salted = rows.withColumn("_salt", F.xxhash64(*spread).bitwiseAND(SALTS - 1))
    salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
    copies = one_each.withColumn("_salt", F.explode(salts))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
