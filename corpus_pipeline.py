"""A training-data pipeline over ``documents``: each stage reads what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import bpe, decontam, line_dedup, simhash, toxicity
from tallyline.llm.queries import PATTERN, RANKS, table, toxicity_score
from tallyline.session import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic; the network learns from the given documents and labels."""
    score = toxicity_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("text"))
    return docs.where(score < toxicity.CUT)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; a document of which no word is left goes, if it lost any line.

    ``n_chars`` becomes the length of what is left.
    """
    found = line_dedup.dedup(docs, n_col="__removed", least_words=1)
    found = found.where((F.col("__removed") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    columns = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return found.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    found = simhash.near_duplicates(docs, shingle=3, radius=2)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(keep, docs.doc_id.eqNullSafe(keep["__id"]), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which any benchmark window occurs go."""
    found = decontam.mark(docs, table(spark, sf_dir, "benchmark"), out="__leak")
    return found.where(F.col("__leak.n_hit") == 0).drop("__leak")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their number and whether they decode to the text."""
    coded = docs.select("doc_id", "text", bpe.round_trip(F.col("text"), RANKS, PATTERN).alias("__coded"))
    same = F.col("__coded.raw") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    count = (F.octet_length("__coded.tokens") / 4).cast("long")
    return coded.select("doc_id", count.alias("n_tokens"), F.col("__coded.tokens").alias("tokens"), same.alias("decodes"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]
# No SQL for the network, SimHash or BPE: tests run the stages on planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
