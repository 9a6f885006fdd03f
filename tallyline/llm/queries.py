"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import (
    bpe,
    collocations,
    decontam,
    importance,
    line_dedup,
    lm,
    maxscore,
    quality,
    quality_rules,
    secret_scan,
    simhash,
    toxicity,
    training,
    url_filter,
)

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, training.held_out("doc_id", 7, 2))


def maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", maxscore.quantised(F.col("embedding"), 64).alias("vector"))
    return maxscore.top_k(rows.where("vec_id % 20 = 0"), rows, k=20)


def fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), least_words=1)
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    return found.select(
        "doc_id", "n_removed", lines.alias("n_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


def quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", training.held_out("doc_id").alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.CUT).cast("int"))


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(f"found.{kind}").cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.written(F.col("found.base")), 256).alias("base_sha256"),
        secret_scan.written(F.col("found.spans")).alias("spans"),
    )


def toxicity_score(docs: DataFrame, labels: DataFrame, text: Column) -> Column:
    model = toxicity.learn(docs, labels)
    return toxicity.score(text, docs.sparkSession.sparkContext.broadcast(model))


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = toxicity_score(docs, table(spark, sf_dir, "labels"), F.col("text"))
    scored = docs.select("doc_id", training.held_out("doc_id").alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.CUT).cast("int"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = docs.select("doc_id", bpe.round_trip(F.col("text"), RANKS, PATTERN).alias("coded"))
    return coded.select(
        "doc_id",
        (F.octet_length("coded.tokens") / 4).cast("long").alias("n_tokens"),
        F.sha2("coded.tokens", 256).alias("ids_sha256"),
        F.sha2("coded.raw", 256).alias("decoded_sha256"),
    )


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    found = url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), bad=bad)
    return found.select("page_id", "host", "path", "rule", "verdict")


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.mark(docs, table(spark, sf_dir, "benchmark"), out="leak")
    ids = F.array_join(F.array_sort(F.transform("leak.items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "leak.n_words",
        "leak.n_hit",
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, sf_dir, "benchmark"), order=1, buckets=10_000, least_words=20, percent=10, seed=2024)


def adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", "lang", "source", quality_rules.measured(F.col("text")).alias("counts"))
    judged = quality_rules.judge(counted, by=("lang", "source")).select("doc_id", "counts.*", "failed")
    return judged.select(
        "doc_id", *quality_rules.COUNTS[:5], quality_rules.base_failed().alias("base_failed"),
        (~quality_rules.base_failed() & (F.size("failed") == 0)).alias("kept"),
        F.array_join("failed", ",").alias("failed_rules"),
    )


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return collocations.collocations(docs, longest=5, least=100, top=2000, covered=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": lm_scoring,
    "op2_maxscore_top_k": maxscore_top_k,
    "op3_line_dedup": fuzzy_lines,
    "op4_quality_ranking": quality_ranking,
    "op5_simhash_near_dedup": simhash_groups,
    "op6_secret_scan": secrets,
    "op7_toxicity": toxic_documents,
    "op8_byte_bpe": byte_bpe,
    "op9_url_filter": url_verdicts,
    "op10_decontamination": benchmark_leaks,
    "op11_importance_resampling": importance_resampling,
    "op12_quality_rules": adaptive_rules,
    "op13_collocations": phrase_collocations,
}
