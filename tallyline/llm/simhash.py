"""SimHash near-duplicates: 64-bit fingerprints, compared exactly tile by tile.

A tile holds the fingerprints whose four 16-bit parts have the same population
counts. If two fingerprints differ in r bits, the counts of their parts differ
by r at most in sum, so a tile is compared only with tiles that near; all others
are skipped without looking at a row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.components import components
from tallyline.session import stored

SEED = 42
PARTS = 4  # parts of a fingerprint whose population counts make its tile
TILE_ROWS = 1 << 16
_STEP = 1 << 14  # shingles whose hashes are held at a time
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the shingles' XXH64 hashes, as an unsigned number; 0 without words."""
    words = (text or "").encode().lower().split()  # for bytes: A-Z only, and the six ASCII separators
    if not words:
        return 0
    line = b" ".join(words)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    count = max(1, len(words) - shingle + 1)
    first, stop = starts[:count], starts[min(shingle, len(words)) :] - 1
    ones = np.zeros(64, np.int64)
    for at in range(0, count, _STEP):
        spans = zip(first[at : at + _STEP].tolist(), stop[at : at + _STEP].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans], "<u8")
        columns = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):  # how often each byte value occurs there says how often each bit is set
            ones[8 * k : 8 * k + 8] += np.bincount(columns[:, k], minlength=256) @ _BITS
    return sum(1 << bit for bit in np.flatnonzero(2 * ones > count).tolist())


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text as a signed 64-bit integer. Null and blank texts: 0."""

    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        found = np.array([text_fingerprint(value.as_py(), shingle) for value in texts], np.uint64)
        return pa.array(found.view(np.int64), pa.int64())

    return prints(text)


def _near_tiles(parts: int, radius: int) -> list[int]:
    """Differences between tile numbers of tiles that may hold a pair within the radius, and are higher."""
    steps = itertools.product(range(-radius, radius + 1), repeat=parts)
    shifts = {sum(s << (8 * n) for n, s in enumerate(step)) for step in steps if sum(map(abs, step)) <= radius}
    return sorted(s for s in shifts if s > 0)


def _tile(print_col: str, parts: int) -> Column:
    width = 64 // parts
    mask = (1 << width) - 1
    out = F.lit(0).cast("bigint")
    for n in range(parts):
        bits = F.bit_count(F.shiftrightunsigned(print_col, n * width).bitwiseAND(F.lit(mask)))
        out = out + F.shiftleft(bits.cast("bigint"), 8 * n)
    return out


class _Tile:
    """Compares the rows of one tile with each other and with rows from near tiles, block by block.

    Only pairs that join what was apart before come out, so a tile with a large
    group of near copies gives as many links as it has rows, not their square.
    """

    def __init__(self, radius: int, step: int = 1024):
        self.radius, self.step, self.parent = radius, step, {}
        self.home: list[np.ndarray] | np.ndarray = []

    def add(self, rows: np.ndarray) -> None:
        self.home.append(rows)

    def close(self) -> list[tuple[int, int]]:
        """All rows of the tile are here: compares them with each other."""
        if isinstance(self.home, list):
            self.home = np.concatenate(self.home) if self.home else np.zeros(0, np.uint64)
            return self._compare(self.home, True)
        return []

    def visit(self, rows: np.ndarray) -> list[tuple[int, int]]:
        return self.close() + self._compare(rows, False)

    def _compare(self, other: np.ndarray, same: bool) -> list[tuple[int, int]]:
        out = []
        for i in range(0, len(self.home), self.step):
            mine = self.home[i : i + self.step]
            for j in range(i if same else 0, len(other), self.step):
                yours = other[j : j + self.step]
                rows, cols = np.nonzero(np.bitwise_count(mine[:, None] ^ yours[None, :]) <= self.radius)
                if not len(rows):
                    continue
                # each column joins its first row; each row joins one column of every first row it shares columns with
                met, at = np.unique(cols, return_index=True)
                first = np.zeros(len(yours), np.int64)
                first[met] = rows[at]
                shared, at = np.unique(first[cols] * self.step + rows, return_index=True)
                out += self._join(mine[first[met]], yours[met])
                out += self._join(mine[shared % self.step], yours[cols[at]])
        return out

    def _root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def _join(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            if (x := self._root(a)) != (y := self._root(b)):
                self.parent[max(x, y)] = min(x, y)
                out.append((a, b))
        return out


def _compare(radius: int):
    """Rows come ordered by tile and chunk, those at home first; a tile's home rows are held, visitors pass by."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            ends = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        key, tile = None, _Tile(radius)
        for rows in batches:
            where, visits, prints = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("tile", "visits", "print"))
            chunk = rows.column("chunk").to_numpy()
            cuts = np.flatnonzero((np.diff(where) != 0) | (np.diff(chunk) != 0) | (np.diff(visits) != 0)) + 1
            found = []
            for start, stop in itertools.pairwise([0, *cuts.tolist(), len(where)]):
                if start == stop:
                    continue
                if key != (now := (where[start], chunk[start])):
                    found += tile.close()
                    key, tile = now, _Tile(radius)
                part = prints[start:stop].view(np.uint64)
                if visits[start]:
                    found += tile.visit(part)
                else:
                    tile.add(part)
            yield batch(found)
        yield batch(tile.close())

    return links


def links(prints: DataFrame, print_col: str, radius: int, parts: int = PARTS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints of at most ``radius`` differing bits, enough to connect all of them.

    A tile of more than ``tile_rows`` rows is cut into chunks, each compared with
    all rows of near tiles and of the other chunks, so no task holds more of one
    tile. Nulls take no part.
    """
    prints = prints.select(F.col(print_col).alias("print")).where("print is not null").distinct()
    prints = prints.select("print", _tile("print", parts).alias("tile"))
    # at most (64 / parts + 1) ** parts rows
    tiles = prints.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("chunks"))
    shifts = F.array([F.lit(s).cast("bigint") for s in _near_tiles(parts, radius)])
    home = prints.join(tiles, "tile").withColumn("chunk", F.pmod(F.xxhash64("print"), "chunks").cast("int"))
    others = home.where("chunk + 1 < chunks").withColumn("chunk", F.explode(F.expr("sequence(chunk + 1, chunks - 1)")))
    near = prints.select("print", F.explode(F.transform(shifts, lambda s: F.col("tile") + s)).alias("tile"))
    near = near.join(tiles, "tile").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    columns = ["tile", "chunk", "visits", "print"]
    rows = home.withColumn("visits", F.lit(0)).select(columns)
    rows = rows.unionByName(near.unionByName(others, True).withColumn("visits", F.lit(1)).select(columns))
    rows = rows.repartition("tile", "chunk").sortWithinPartitions("tile", "chunk", "visits")
    return rows.mapInArrow(_compare(radius), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2,
    parts: int = PARTS, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """One row per document: ``id_col``, ``print`` (signed 64 bit), ``component`` (smallest reachable id).

    Equal fingerprints are one vertex, so a group of copies of any size costs one
    comparison. Null and blank texts have fingerprint 0 and are linked like any
    other. Rows with a null id get the smallest id they reach, or null if there
    is none; repeated rows stay repeated; an empty table gives no rows.
    """
    found = stored(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("print")))
    distinct = stored(found.groupBy("print").agg(F.min("id").alias("low")))
    roots = components(links(distinct, "print", radius, parts, tile_rows), "a", "b")
    linked = roots.join(distinct, roots.node == distinct.print).select("node", "root", "low")
    least = linked.groupBy("root").agg(F.min("low").alias("component"))
    linked = roots.join(least, "root").select(F.col("node").alias("print"), "component")
    known = distinct.join(linked, "print", "left")
    known = known.select("print", F.coalesce("component", "low").alias("component"))
    return found.join(known, "print").select(F.col("id").alias(id_col), "print", "component")
