"""Exact top-k inner products by MaxScore over impact postings.

A vector's components are its terms. The postings of a term are split by sign,
so that for a query component the list of the same sign raises scores and the
other list only lowers them and never needs to be traversed first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 1 << 14
QUERY_ROWS = 1 << 12
BLOCK_ROWS = 1 << 12  # rows of a shard with bounds of their own
_PROBES = 8  # components probed between two looks at what is still competitive
_TOGETHER = 128  # queries that traverse the columns of a block together
_DENSE = 8  # a list of more than one row in so many is a column


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component; null for a vector that is null or holds a null or non-finite one."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return F.when(vector.isNotNull() & ~bad, whole)


class Postings:
    """The postings of one block of rows: per component, what the rows of either sign have.

    A list that many rows are in is a column with zeros for the others, and such columns
    are traversed for many queries at once; any other list names its rows.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        width = values.shape[1]
        self.lists: dict[bool, dict] = {True: {}, False: {}}
        self.place = {True: np.full(width, -1), False: np.full(width, -1)}
        columns = []
        for t, column in enumerate(values.T):
            for sign, part in ((True, np.maximum(column, 0)), (False, np.minimum(column, 0))):
                rows = np.flatnonzero(part)
                if len(rows) * _DENSE > len(ids):
                    self.place[sign][t] = len(columns)
                    columns.append(part)
                elif len(rows):
                    self.lists[sign][t] = (rows, part[rows])
        self.columns = np.array(columns, values.dtype).reshape(len(columns), len(ids))
        high = np.maximum(values, 0).max(axis=0, initial=0)
        low = np.minimum(values, 0).min(axis=0, initial=0)
        self.most = {True: high, False: -low}

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The most that each component can add to a score here."""
        return np.abs(query) * np.where(query > 0, self.most[True], self.most[False])

    def search(self, query: np.ndarray, own: int | None, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores that may be among the best k: every row scoring at least ``least``, best k if more."""
        return next(self.searches(np.asarray(query)[None], [own], [least], k))

    def searches(
        self, queries: np.ndarray, own: Sequence[int | None], least: Sequence[int], k: int
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What ``search`` gives for each of a few queries, whose essential columns are traversed together."""
        weights, splits = np.zeros((len(queries), len(self.columns)), self.values.dtype), []
        for weight, query, floor in zip(weights, queries, least, strict=True):
            bounds = self.bounds(query)
            order = np.argsort(bounds, kind="stable")
            reach = np.cumsum(bounds[order])  # what the components up to each one can add together
            spare = int(np.searchsorted(reach, floor, side="left"))  # these alone stay below: non-essential
            essential = order[spare:]
            for place in self.place.values():  # the list of the sign that adds, and of the other
                dense = essential[place[essential] >= 0]
                weight[place[dense]] = query[dense]
            splits.append((bounds, essential, order[:spare][::-1], reach[spare - 1] if spare else 0))
        scored = weights @ self.columns
        for query, mine, floor, scores, split in zip(queries, own, least, scored, splits, strict=True):
            yield self._best(query, mine, floor, k, scores, *split)

    def _best(
        self, query: np.ndarray, own: int | None, least: int, k: int, scores: np.ndarray,
        bounds: np.ndarray, essential: np.ndarray, rest: np.ndarray, left: int,
    ) -> tuple[np.ndarray, np.ndarray]:
        """The best rows of a query, whose ``essential`` columns are in ``scores`` and whose others can add ``left``."""
        if not len(essential):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        for lists in self.lists.values():
            for t in essential if lists else ():
                if t in lists and query[t]:
                    rows, part = lists[t]
                    scores[rows] += part * query[t]
        alive = np.flatnonzero(scores >= least - left)
        scores = scores[alive]
        # non-essential components from the largest bound down, for rows that can still reach the k-th score
        for at in range(0, len(rest), _PROBES):
            terms = rest[at : at + _PROBES]
            scores = scores + self.values[alive[:, None], terms] @ query[terms]
            left -= bounds[terms].sum()
            still = scores >= least - left
            alive, scores = alive[still], scores[still]
        if own is not None:
            others = self.ids[alive] != own
            alive, scores = alive[others], scores[others]
        if len(alive) > k:
            high = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            alive, scores = alive[high], scores[high]
        best = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive][best], scores[best].astype(np.int64)


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for n, row in enumerate(rows):
        out[n, : len(row)] = row
    return out


def _search(k: int, block_rows: int):
    def best(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        out = []
        width = max(max(map(len, frame.vector), default=0) for frame in (queries, docs))
        docs = docs.sort_values("id", kind="stable")
        ids, values, asked = docs.id.to_numpy(np.int64), _matrix(docs.vector, width), _matrix(queries.vector, width)
        # floats add up whole numbers exactly, and the narrower the faster, as long as every sum stays below 2 ** 24, or 2 ** 53
        largest = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (values, asked)]
        most = largest[0] * largest[1] * max(width, 1)
        kind = np.float32 if max(most, *largest) < 2.0**23 else np.float64 if most < 2.0**52 else np.int64
        values, asked = values.astype(kind), asked.astype(kind)
        blocks = [Postings(ids[n : n + block_rows], values[n : n + block_rows]) for n in range(0, len(ids), block_rows)]
        for start in range(0, len(asked), _TOGETHER):
            some, own = asked[start : start + _TOGETHER], queries.id.to_numpy(np.int64)[start : start + _TOGETHER]
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(some)
            for block in blocks:
                # until k rows are known, every row may be among them
                least = [int(scores[-1]) if len(scores) == k else np.iinfo(np.int64).min // 4 for _, scores in best]
                for n, (more, their) in enumerate(block.searches(some, own, least, k)):
                    top, scores = np.concatenate([best[n][0], more]), np.concatenate([best[n][1], their])
                    order = np.lexsort((top, -scores))[:k]
                    best[n] = top[order], scores[order]
            out += [pd.DataFrame({"query_id": mine, "vec_id": top, "score": scores}) for mine, (top, scores) in zip(own, best, strict=True)]
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return best


def top_k(
    queries: DataFrame, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "vector", k: int = 20,
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k rows of the highest inner product with each query: query_id, rank (from 1), vec_id, score.

    Vectors are arrays of integers; a shorter one counts as padded by zeros. Ties
    go to the smaller id; a row with the query's own id is no candidate; repeated
    ids are rows of their own, but one query (its smallest vector); rows with a null id or vector take no part; without
    rows there is no result. Every block of queries meets every shard of rows in a
    task of bounded size, which starts a block of rows with the k-th score so far;
    each then gives k rows per query at most, and these are merged by rank.
    """
    clean = lambda frame: frame.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")
    ).where("id is not null and vector is not null")
    queries, rows = clean(queries).groupBy("id").agg(F.min("vector").alias("vector")), clean(rows)
    shards = max(1, math.ceil(rows.count() / shard_rows))
    blocks = max(1, math.ceil(queries.count() / query_rows))
    part = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = queries.withColumn("block", part(blocks)).withColumn("shard", each(shards))
    rows = rows.withColumn("shard", part(shards)).withColumn("block", each(blocks))
    found = queries.groupBy("block", "shard").cogroup(rows.groupBy("block", "shard"))
    found = found.applyInPandas(_search(k, block_rows), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
