"""Secret scans with column functions only: patterns, and entropy of sliding windows over candidate strings."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.columns import let

# Fixed values of the three base kinds.
_EITHER = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
ASSIGN = _EITHER + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

WINDOW = 20
# Character classes of candidate strings: name, alphabet, candidate pattern, and the bits per character that a window needs.
HEX_DIGITS = "0123456789abcdefABCDEF"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASSES = (("entropy_hex", HEX_DIGITS, "[0-9A-Fa-f]{20,}", 3.0), ("entropy_base64", BASE64, "[A-Za-z0-9+/_=-]{20,}", 3.85))
# Allow-list: candidates that contain one of these are no secrets.
ALLOWED = (
    "^[^0-9]*$",  # words without any digit
    "^[^A-Za-z]*$",  # numbers, dates, rules of dashes
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # unique ids
    "EXAMPLE|[Ee]xample|0123456789|abcdefghij|ABCDEFGHIJ",  # documentation and alphabets
    "^[a-z]+([-_/][a-z0-9]{1,8})+$",  # paths and slugs of plain words
)
SCALE = 1 << 20
ORDER = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
_RUN = 1000  # matches whose positions are summed up at a time


def window_bits(count: int) -> int:
    """count * log2(count) as a whole number, so that sums of it are exact."""
    return round(count * math.log2(count) * SCALE) if count else 0


def most_sum(bits: float, window: int = WINDOW) -> int:
    """A window has at least so many bits per character if its counts' ``window_bits`` sum to this at most."""
    return math.floor((math.log2(window) - bits) * window * SCALE)


def positions(text: Column, pattern: str) -> Column:
    """Every leftmost non-overlapping match as array<struct<start, stop, found>>, in code points.

    Starts are sums of the lengths of what lies between the matches, in runs of
    bounded length, so a text with very many matches stays cheap.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(
        found, F.split(text, pattern, -1), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"), m.alias("found"))
    )
    parts = F.filter(parts, lambda p: p.found.isNotNull())
    none = F.array().cast("array<struct<start: int, stop: int, found: string>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def one(state: Column, p: Column) -> Column:
        start = state.at + p.gap
        stop = start + p["size"]
        span = F.struct(start.alias("start"), stop.alias("stop"), p.found.alias("found"))
        return F.struct(stop.alias("at"), F.array_append(state.out, span).alias("out"))

    def moved(state: Column, run: Column) -> Column:
        spans = F.transform(run.out, lambda x: F.struct(
            (x.start + state.at).alias("start"), (x.stop + state.at).alias("stop"), x.found.alias("found")
        ))
        return F.struct((state.at + run.at).alias("at"), F.concat(state.out, spans).alias("out"))

    def joined(p: Column) -> Column:
        number = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _RUN).cast("int"))
        runs = F.transform(number, lambda n: F.aggregate(F.slice(p, n * _RUN + 1, _RUN), begin, one))
        return F.aggregate(runs, begin, moved).out

    return F.when(text.rlike(pattern), let(parts, joined)).otherwise(none)


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(
        x.start.alias("start"), F.lit(ORDER.index(kind)).alias("rank"), x.stop.alias("stop"), F.lit(kind).alias("kind")
    ))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the base kinds, each array<struct<start, stop, found>>. ``text`` may not be null."""
    long = lambda least: lambda x: F.length(x.found) >= least
    value = lambda x: F.length(F.regexp_extract(x.found, ASSIGN, 2)) >= LEAST_VALUE
    return {
        "assign": F.filter(positions(text, ASSIGN), value),
        # runs of these classes are matched whole, so shorter ones can be left out by the pattern itself
        "access": F.filter(positions(text, ACCESS), long(LEAST_ACCESS)),
        "hex": positions(text, HEX[:-1] + f"{{{LEAST_HEX},}}"),
    }


def hot_window(word: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """First and last start (from 0) of windows of at least ``bits`` per character; null if there are none.

    One pass carries the counts of the alphabet's characters in the window and
    the sum over them: a step changes two counts, and the sum by their difference.
    """
    worth = F.array(*[F.lit(window_bits(n)) for n in range(window + 2)])
    at = lambda counts, n: F.get(counts, n)
    code = lambda i: F.instr(F.lit(alphabet), F.substring(word, i, F.lit(1))) - 1

    def change(counts: Column, n: Column, by: int) -> tuple[Column, Column]:
        old = at(counts, n)
        return F.transform(counts, lambda c, k: F.when(k == n, c + by).otherwise(c)), at(worth, old + by) - at(worth, old)

    def step(state: Column, i: Column) -> Column:
        left, less = change(state.counts, code(i - window), -1)
        left = F.when(i > window, left).otherwise(state.counts)
        less = F.when(i > window, less).otherwise(F.lit(0))
        counts, more = change(left, code(i), 1)
        total = state.total + less + more
        hot = (i >= window) & (total <= most_sum(bits, window))
        return F.struct(
            counts.alias("counts"),
            total.alias("total"),
            F.when(hot & state["first"].isNull(), i - window).otherwise(state["first"]).alias("first"),
            F.when(hot, i - window).otherwise(state["last"]).alias("last"),
        )

    begin = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
        F.lit(0).alias("total"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )
    done = F.aggregate(F.sequence(F.lit(1), F.length(word)), begin, step)
    return let(done, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last")))


def entropy_spans(text: Column, name: str, alphabet: str, pattern: str, bits: float, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Spans of candidate strings from their first to their last hot window, without what the allow-list names."""
    listed = lambda x: reduce(or_, [x.found.rlike(rule) for rule in allowed], F.lit(False))
    found = F.filter(positions(text, pattern), lambda x: ~listed(x))
    if name != "entropy_hex":
        found = F.filter(found, lambda x: ~x.found.rlike("^[0-9A-Fa-f]*$"))
    marked = F.transform(found, lambda x: F.struct(x.start.alias("start"), hot_window(x.found, alphabet, bits).alias("hot")))
    return F.transform(
        F.filter(marked, lambda x: x.hot["first"].isNotNull()),
        lambda x: F.struct((x.start + x.hot["first"]).alias("start"), (x.start + x.hot["last"] + WINDOW).alias("stop")),
    )


def written(spans: Column) -> Column:
    """kind:start:stop, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.stop)), ",")


def scan(docs: DataFrame, text_col: str = "text", out: str = "found", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Adds a struct ``out`` of arrays: ``assign``, ``access``, ``hex`` (start, stop, found), ``base`` and ``spans``.

    ``base`` are those three, ``spans`` also those added by entropy, as (start, rank,
    stop, kind) by start, then kind. An added span that meets a base span is left out,
    base spans always stay. Null and empty texts have none. Repeated rows and other
    columns stay (a column named ``out`` is replaced).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.struct(*[spans.alias(kind) for kind, spans in base_spans(text).items()])
    more = F.struct(*[entropy_spans(text, *kind, allowed).alias(kind[0]) for kind in CLASSES])
    docs = docs.withColumn(out, F.struct(base.alias("base"), more.alias("more")))
    found = F.col(out)
    known = F.concat(*[_kind(found.base[kind], kind) for kind in ORDER[:3]])
    added = F.concat(*[_kind(found.more[kind], kind) for kind in ORDER[3:]])
    apart = F.filter(added, lambda x: ~F.exists(known, lambda b: (b.start < x.stop) & (x.start < b.stop)))
    spans = F.array_sort(F.concat(known, apart))
    return docs.withColumn(out, F.struct(
        *[found.base[kind].alias(kind) for kind in ORDER[:3]], F.array_sort(known).alias("base"), spans.alias("spans")
    ))
