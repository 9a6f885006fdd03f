"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

A text is lower-cased and every byte that is no word byte becomes a space, by a
byte table, so byte positions stay those of the original. Words joined by one
space are then scanned once; a match's place in that string gives its word
numbers, and those give the original place.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.session import stored

# Digits, a-z and every byte of a non-ASCII character make words.
_WORD_BYTES = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_TABLE = bytes(b if b in _WORD_BYTES else 0x20 for b in _LOWER)
WINDOW = 10
SHARD_BYTES = 16 << 20
_RANGES = "array<struct<start: int, stop: int>>"
_HITS = f"struct<n_words: bigint, n_hit: bigint, items: array<bigint>, runs: {_RANGES}, spans: {_RANGES}>"
_RANGE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_ARROW_HITS = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("runs", _RANGE), ("spans", _RANGE)]
)


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def windows(text: str | None, size: int = WINDOW) -> Iterator[bytes]:
    """Every run of ``size`` words; all words of a shorter text; nothing for one without words."""
    found = word_list(text)
    for start in range(max(1, len(found) - size + 1)) if found else ():
        yield b" ".join(found[start : start + size])


def automaton(items: list[tuple[int, str]], size: int = WINDOW) -> ahocorasick.Automaton | None:
    """Maps every window, with a space on either side, to its word count and item ids. None without windows."""
    owners: dict[bytes, set[int]] = {}
    for item, text in items:
        for window in windows(text, size):
            owners.setdefault(window, set()).add(item)
    if not owners:
        return None
    out = ahocorasick.Automaton()
    for window, ids in owners.items():
        out.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, len(window), tuple(sorted(ids))))
    out.make_automaton()
    return out


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of hit words start, and where they stop (exclusive)."""
    padded = np.concatenate([[False], hit, [False]])
    return np.flatnonzero(~padded[:-1] & padded[1:]), np.flatnonzero(padded[:-1] & ~padded[1:])


def _ranges(starts: np.ndarray, stops: np.ndarray) -> list[dict]:
    return [{"start": a, "stop": b} for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def scan(text: str | None, found: ahocorasick.Automaton | None, before: dict | None = None) -> dict:
    """Hit words, items and original spans of one text, together with what other automata hit ``before``."""
    raw = (text or "").encode()
    table = raw.translate(_TABLE)
    split = table.split()
    out = before or {"n_words": len(split), "n_hit": 0, "items": [], "runs": [], "spans": []}
    if not split or found is None:
        return out
    line = f" {b' '.join(split).decode('latin-1')} "
    matches = list(found.iter(line))
    if not matches:
        return out
    words_before = np.cumsum(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
    edges, items = np.zeros(len(split) + 1, np.int64), set(out["items"])
    for run in out["runs"]:
        edges[run["start"]] += 1
        edges[run["stop"]] -= 1
    for end, (count, length, ids) in matches:
        first = int(words_before[end - length - 1]) - 1  # the match starts at the space before its first word
        edges[first] += 1
        edges[first + count] -= 1
        items.update(ids)
    hit = np.cumsum(edges[:-1]) > 0
    first, stop = _runs(hit)
    starts, stops = _runs(np.frombuffer(table, np.uint8) != 0x20)
    # characters before each byte: bytes that do not continue a character
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return {
        "n_words": len(split),
        "n_hit": int(hit.sum()),
        "items": sorted(items),
        "runs": _ranges(first, stop),
        "spans": _ranges(points[starts[first]], points[stops[stop - 1]]),
    }


def shards(items: DataFrame, id_col: str, text_col: str, most_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Benchmark texts in parts of bounded size, by the hash of the id; one part of them is in memory at a time."""
    items = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).where(
        "item is not null and text is not null"
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // most_bytes))
    for part in range(parts):
        yield [(row.item, row.text) for row in items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()]


def mark(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    out: str = "leak",
) -> DataFrame:
    """Adds a struct column ``out``: n_words, n_hit, items (sorted ids), spans (code points, end exclusive).

    ``runs`` are the hit word numbers. The benchmark's size is measured. Up to
    ``shard_bytes`` of it become one automaton, broadcast once, and each text is
    scanned once. A larger benchmark is dealt to automata of at most about that
    size, which take their turns: one part is broadcast, the hits so far are
    written to the shared folder and the next part adds to them, so nothing is
    dropped and no task holds more than one part. Null and empty texts have no
    words; items with a null id or text give no windows; an empty benchmark hits
    nothing; items with equal texts all count; other columns of ``docs`` stay (a
    column named ``out`` is replaced).
    """
    context = docs.sparkSession.sparkContext
    docs = docs.withColumn(out, F.lit(None).cast(_HITS))
    for number, part in enumerate(shards(items, item_id, item_text, shard_bytes)):
        docs = stored(docs) if number else docs
        docs = docs.withColumn(out, _hits(context.broadcast(part), size)(F.col(text_col), F.col(out)))
    return docs


def _hits(items: Broadcast, size: int):
    @F.arrow_udf(_HITS)
    def hits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        built = automaton(items.value, size)
        for texts, before in batches:
            rows = [scan(text.as_py(), built, old.as_py()) for text, old in zip(texts, before, strict=True)]
            yield pa.array(rows, _ARROW_HITS)

    return hits
