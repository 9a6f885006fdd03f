"""Importance resampling towards a target distribution (Xie et al., 2023), on hashed runs of words.

Texts of a batch are joined with a separator between them, one regex pass over
the bytes finds all words, and a search in the texts' offsets says whose a word
is; runs that would cross into the next text are masked before they are counted.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.arrow import chunks
from tallyline.llm.ranks import ranked
from tallyline.session import stored

# Digits, a-z and every byte of a non-ASCII character make words.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SEPARATOR = b"\x00"
_SPAN = np.dtype([("start", np.int64), ("stop", np.int64), ("crc", np.uint32)])
BUCKETS = 10_000
ORDER = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
CHUNK_BYTES = 4 << 20
SCALE = 1000  # gains, weights and noise are in thousandths


def _lowered(texts: pa.Array) -> list[bytes]:
    """UTF-8 texts with A-Z lower-cased."""
    raw = pc.fill_null(texts, "").cast(pa.binary()).to_pylist()
    return [text.lower() for text in raw]  # bytes.lower changes A-Z only


def features(texts: pa.Array, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run length up to ``order``: the text that each run lies in, and its bucket."""
    texts = _lowered(texts)
    joined = _SEPARATOR.join(texts)
    offsets = np.cumsum([0, *(len(text) + 1 for text in texts[:-1])]) if texts else np.zeros(0, np.int64)
    found = ((m.start(), m.end(), zlib.crc32(m.group())) for m in _WORD.finditer(joined))
    spans = np.fromiter(found, _SPAN)
    owner = np.searchsorted(offsets, spans["start"], side="right") - 1
    crc, starts, stops = spans["crc"], spans["start"].tolist() if order > 1 else [], spans["stop"].tolist() if order > 1 else []
    for size in range(1, order + 1):
        if size > 1:  # a run's checksum goes on from that of the run without its last word
            last = (b" " + joined[a:b] for a, b in zip(starts[size - 1 :], stops[size - 1 :], strict=True))
            crc = np.fromiter(map(zlib.crc32, last, crc[:-1].tolist()), np.uint32, max(len(spans) - size + 1, 0))
        first, end = owner[: len(crc)], owner[size - 1 :]
        within = first == end
        yield first[within], crc[within] % np.uint32(buckets)


def bucket_counts(texts: DataFrame, text_col: str, order: int, buckets: int) -> DataFrame:
    """How many runs of all texts fall into each bucket: columns ``bucket``, ``n``; buckets without a run have no row.

    Each task sums up its own texts, so it passes on no more than ``buckets`` rows.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in chunks(batch.column(0), CHUNK_BYTES):
                for _, bucket in features(part, order, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": seen, "n": total[seen]})

    rows = texts.select(F.col(text_col).cast("string")).mapInArrow(counts, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, order: int, buckets: int, text_col: str, target_text: str) -> np.ndarray:
    """The gain of every bucket: SCALE times the log ratio of its add-one shares in target and documents, floored."""
    counted = bucket_counts(docs, text_col, order, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).alias("t"))
    wanted = bucket_counts(target, target_text, order, buckets).select("bucket", F.lit(0).alias("s"), F.col("n").alias("t"))
    totals = counted.unionByName(wanted).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    s, t = [0] * buckets, [0] * buckets
    for row in totals.collect():  # at most one row a bucket
        s[row.bucket], t[row.bucket] = row.s, row.t
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    ratio = ((float(b + 1) * all_s) / (float(a + 1) * all_t) for a, b in zip(s, t, strict=True))
    return np.array([math.floor(SCALE * math.log(x)) for x in ratio], np.int64)


def weighed(text: Column, gain: np.ndarray, order: int) -> Column:
    """Struct n_words, n_features, weight of one text, ``gain`` holding a number for every bucket."""
    buckets = len(gain)

    @F.arrow_udf("n_words long, n_features long, weight long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            words, runs, sums = [], [], []
            for part in chunks(batch, CHUNK_BYTES):
                n = len(part)
                count, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for size, (owner, bucket) in enumerate(features(part, order, buckets), 1):
                    here = np.bincount(owner, minlength=n)
                    if size == 1:
                        words.append(here)
                    count += here
                    # sums stay far below 2^53, where doubles are exact
                    total += np.bincount(owner, gain[bucket], n).astype(np.int64)
                runs.append(count)
                sums.append(total)
            none = np.zeros(0, np.int64)
            words, runs, sums = (np.concatenate([none, *x]) for x in (words, runs, sums))
            weight = np.where(runs > 0, sums // np.maximum(runs, 1), 0)
            yield pa.StructArray.from_arrays([pa.array(x) for x in (words, runs, weight)], ["n_words", "n_features", "weight"])

    return of(text)


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise of a row, from the hash of its id, floored to thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    order: int = ORDER, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """Draws ``percent`` of the texts with at least ``least_words`` words, likelier the more they resemble ``target``.

    One row per text: ``id_col``, n_features, weight, score, rank. Scores are
    weights with Gumbel noise, so the highest are a sample without replacement;
    ``rank`` counts from 1 by descending score, ties by ascending id, and is null
    for what is not drawn. Null and empty texts have no features and weight 0;
    equal rows are texts of their own and take neighbouring ranks; a null id has
    noise of its own and comes first among ties; an empty target leaves every
    weight to the documents' own shares; an empty table gives no rows. Only the
    gains, one number a bucket, go through the driver.
    """
    gain = gains(docs, target, order, buckets, text_col, target_text)
    marked = docs.select(F.col(id_col).alias("id"), weighed(F.col(text_col).cast("string"), gain, order).alias("w"))
    scored = marked.select(
        "id", "w.n_words", "w.n_features", "w.weight", (F.col("w.weight") + noise("id", seed)).alias("score")
    )
    scored = stored(scored)
    able = F.col("n_words") >= least_words
    drawn = ranked(scored, able, percent, "score", "id")
    return drawn.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
