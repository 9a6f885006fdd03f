"""Quality rules whose thresholds adapt to each language and source.

Every text is measured once. The measures of a group go into quantile sketches
with buckets of bounded relative error (DDSketch: Masson, Rim and Lee, 2019),
that is counts per logarithmic bucket: they add up in any order, so a hot source
is summed in every task first, and the sketches of a language's sources merge
into that of the language. A group's limits are fences around its quartiles; the
limits are joined to the texts, and a text beyond a limit fails.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.arrow import buffers, chunks
from tallyline.llm.columns import small
from tallyline.operators.spread import join_one
from tallyline.session import stored

CHUNK_BYTES = 4 << 20
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated windows
WINDOW = 3
ACCURACY = 0.01  # relative error of a sketch
LEAST_TEXTS = 100  # a group with fewer texts takes the limits of its language, and that those of all texts
REACH = 3.0  # how many spreads a fence lies beyond its quartile
SMALL_GROUPS = 100_000  # groups whose limits, some 100 bytes each, may be broadcast

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """A share of two counts, and how far apart its quartiles count at least.

    Without a least spread, one repeated line would fail a short text of a group
    in which most texts repeat none.
    """

    name: str
    part: str
    whole: str
    least_spread: float
    low: bool = False  # whether too little is as bad as too much


RULES = (
    Rule("word_length", "word_chars", "n_words", 0.5, low=True),
    Rule("symbols", "n_symbols", "n_words", 0.02),
    Rule("dup_lines", "n_dup_lines", "n_lines", 0.15),
    Rule("repeats", "n_repeat_words", "n_words", 0.1),
)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the stretches of ``values`` between consecutive places ``at``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _ids(texts: np.ndarray, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Numbers for the strings between starts and stops, equal for equal strings of one text."""
    size = stops - starts
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[stops] -= 1
    data = raw[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(size)])
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    number = strings.dictionary_encode().indices.to_numpy().astype(np.int64)
    return np.unique(number * (int(texts.max(initial=0)) + 1) + texts, return_inverse=True)[1]


def counts(texts: pa.Array) -> list[np.ndarray]:
    """The counts of every text, in the order of ``COUNTS``."""
    raw, at = buffers(texts)
    n = len(texts)
    space, symbol = _SPACE[raw], _sums(_SYMBOL[raw], at)
    # words: stretches without separators; texts end every word
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge[:-1] == -1), np.flatnonzero(edge[1:] == 1) + 1
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    cut = np.unique(inner[~space[inner] & ~space[inner - 1]]) if len(raw) else inner
    starts, stops = np.union1d(starts, cut), np.union1d(stops, cut)
    owner = np.searchsorted(at, starts, side="right") - 1
    words = np.bincount(owner, minlength=n)
    chars = _sums(~space & ((raw & 0xC0) != 0x80), at)

    # words in windows that occur again in the text
    word = _ids(owner, raw, starts, stops)
    window = word[: max(len(word) - WINDOW + 1, 0)]
    for k in range(1, WINDOW):
        following = word[k : k + len(window)]
        window = np.unique(window * (int(word.max(initial=0)) + 1) + following, return_inverse=True)[1]
    within = owner[: len(window)] == owner[WINDOW - 1 :] if len(window) else np.zeros(0, bool)
    again = (np.bincount(window[within], minlength=len(window)) > 1)[window] & within
    edges = np.zeros(len(word) + 1, np.int64)
    edges[: len(window)] += again
    edges[WINDOW : WINDOW + len(window)] -= again
    repeated = np.bincount(owner[np.cumsum(edges[:-1]) > 0], minlength=n)

    # lines with a word that an earlier line of the text equals
    breaks = np.flatnonzero(raw == 0x0A)
    line_starts = np.union1d(at[:-1], breaks + 1)
    line_stops = np.concatenate([line_starts[1:], [len(raw)]])
    filled = np.searchsorted(starts, line_stops) > np.searchsorted(starts, line_starts)
    line_starts, line_stops = line_starts[filled], line_stops[filled]
    line_owner = np.searchsorted(at, line_starts, side="right") - 1
    line_stops = line_stops - (raw[line_stops - 1] == 0x0A) if len(line_stops) else line_stops
    line = _ids(line_owner, raw, line_starts, line_stops)
    lines = np.bincount(line_owner, minlength=n)
    firsts = np.unique(line, return_index=True)[1]
    dup = lines - np.bincount(line_owner[firsts], minlength=n)
    return [words, chars, symbol, dup, repeated, lines]


def measured(text: Column) -> Column:
    """A struct of ``COUNTS`` for each text; null counts as empty."""

    @F.arrow_udf(", ".join(f"{name} long" for name in COUNTS))
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [counts(part) for part in chunks(batch, CHUNK_BYTES)]
            columns = [np.concatenate([np.zeros(0, np.int64), *column]) for column in zip(*parts, strict=True)]
            columns = columns or [np.zeros(0, np.int64)] * len(COUNTS)
            yield pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], list(COUNTS))

    return measure(text.cast("string"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


GAMMA = (1 + ACCURACY) / (1 - ACCURACY)


def bucket(value: Column) -> Column:
    """The sketch bucket of a value that is not negative: all values of one are within ``ACCURACY``; NULL for 0."""
    return F.when(value > 0, F.ceil(F.log(value) / math.log(GAMMA)))


def middle(of: Column) -> Column:
    return F.when(of.isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), of) / (GAMMA + 1))


def share(rule: Rule) -> Column:
    return F.col(rule.part) / F.col(rule.whole)


def sketches(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of every rule's shares per group: columns of ``by``, rule, bucket, n. Only texts with words count."""
    kinds = F.array(*(F.struct(F.lit(r.name).alias("rule"), bucket(share(r)).alias("bucket")) for r in RULES))
    one = rows.where("n_words > 0").select(*by, F.explode(kinds).alias("k")).select(*by, "k.rule", "k.bucket")
    return one.groupBy(*by, "rule", "bucket").agg(F.count("*").alias("n"))


def merged(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups: buckets add up."""
    return found.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def limits(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group: its texts, and the fences ``<rule>_low``, ``<rule>_high``.

    The quantile q is the bucket of the text with floor(q (n - 1)) texts before it.
    """
    group = Window.partitionBy(*by, "rule")
    upto = F.sum("n").over(group.orderBy(F.asc_nulls_first("bucket")))
    placed = found.select(*by, "rule", "bucket", upto.alias("upto"), F.sum("n").over(group).alias("texts"))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(q * (F.col("texts") - 1)), F.struct("upto", "bucket")))
    rows = placed.groupBy(*by, "rule").agg(F.max("texts").alias("texts"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    q1, q3 = middle(F.col("q1.bucket")), middle(F.col("q3.bucket"))
    out = []
    for rule in RULES:
        here = F.col("rule") == rule.name
        reach = REACH * F.greatest(q3 - q1, F.lit(rule.least_spread))
        out.append(F.max(F.when(here, q3 + reach)).alias(f"{rule.name}_high"))
        if rule.low:
            out.append(F.max(F.when(here, q1 - reach)).alias(f"{rule.name}_low"))
    return rows.groupBy(*by).agg(F.max("texts").alias("texts"), *out)


def judge(rows: DataFrame, by: Sequence[str] = ("lang", "source"), counts_col: str = "counts") -> DataFrame:
    """Adds ``failed``, the names of the rules that a text breaks, to rows with a struct of ``measured`` counts.

    ``rows`` are written to the shared folder once. ``by`` goes from coarse to
    fine. A null group value is a group of its own. Groups with fewer than
    ``LEAST_TEXTS`` texts that have words take the limits of the next coarser
    group, the coarsest those of all texts, whatever their number. Texts without
    words break no rule here. Ties lie in one bucket; repeated rows count as
    often as they occur; an empty table gives no rows. Columns with other names
    pass through; of those that this step names itself (``failed``) the old goes.
    """
    by = list(by)
    names = [f"__{n}" for n in range(len(by))]
    rows = stored(rows.drop("failed"))
    keyed = rows.select(*(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(n) for n, c in zip(names, by, strict=True)), f"{counts_col}.*")
    finest = stored(sketches(keyed, names))
    fences = limits(finest, names)
    level, columns = finest, [f"{r.name}_{end}" for r in RULES for end in (("low", "high") if r.low else ("high",))]
    enough = F.col("texts") >= LEAST_TEXTS
    for size in range(len(names) - 1, -1, -1):
        level = merged(level, names[:size])
        coarse = limits(level, names[:size]).select(*names[:size], F.col("texts").alias("_texts"), *(F.col(c).alias(f"_{c}") for c in columns))
        if size:
            fences = join_one(fences, coarse, names[:size], [names[-1]], "left")
        else:
            whole = coarse.first()  # one row
            fences = fences.withColumns({f"_{c}": F.lit(None if whole is None else whole[f"_{c}"]).cast("double") for c in columns})
            fences = fences.withColumn("_texts", F.lit(0 if whole is None else whole["_texts"]))
        fences = fences.select(
            *names, F.when(enough, F.col("texts")).otherwise(F.col("_texts")).alias("texts"),
            *(F.when(enough, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in columns),
        )
    return joined(rows, stored(fences), names, by, counts_col)


def joined(rows: DataFrame, fences: DataFrame, names: list[str], by: list[str], counts_col: str) -> DataFrame:
    """Every text next to its group's limits, and what it breaks."""
    keys = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in by]
    packed = rows.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), F.struct(*rows.columns).alias("row"))
    near = small(fences, SMALL_GROUPS)
    if near is fences:  # too many groups to broadcast
        placed = join_one(packed, fences, names, ["row"], "left")
    else:
        placed = packed.join(near, names, "left")
    of = lambda name: F.col(f"row.{counts_col}.{name}")
    broken = []
    for rule in RULES:
        value = of(rule.part) / of(rule.whole)
        beyond = value > F.col(f"{rule.name}_high")
        if rule.low:
            beyond |= value < F.col(f"{rule.name}_low")
        broken.append(F.when((of("n_words") > 0) & beyond, rule.name))
    return placed.select("row.*", F.array_compact(F.array(*broken)).alias("failed"))
