"""N-gram scoring of texts with a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing (MacKay and Peto, 1995):
P(w | h) = (c(hw) + mu P(w | h')) / (c(h) + mu), h' being h without its first
word, down to (c(w) + 1) / (N + V + 1) for a single word. As an automaton, each
seen context is a state; a seen n-gram is an arc with its log-probability; what a
state has no arc for goes along its failure arc, weighted mu / (c(h) + mu), to the
state of h'.

The automaton grows with the corpus, so it is never built as a whole. Texts are
cut into blocks of bounded size. A block asks for the counts of its own distinct
n-grams, dealt by hash over all tasks; equal n-grams of a block ask once, so a
word as common as it may be is one question per block. From the answers each
block builds the part of the automaton that its texts walk on, and walks it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.arrow import chunks, words
from tallyline.session import LARGE_VALUES, stored

ORDER = 2
MU = 100.0
BLOCK_BYTES = 2 << 20
BUCKET_KEYS = 1 << 20  # n-grams that a task sums up at a time, about
_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = 256  # tokens walked one after another; segments of a block are walked together


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes, in order."""
    x = (left * _ODD) ^ (right + (left >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers for the tokens of each text, its start and end included; where each text starts; the numbers' hashes."""
    ids, at, vocabulary = words(texts)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) for w in vocabulary), np.uint64, len(vocabulary))
    starts = at + 2 * np.arange(len(at))
    out = np.empty(starts[-1], np.int64)
    inside = np.ones(len(out), bool)
    inside[starts[:-1]] = inside[starts[1:] - 1] = False
    out[inside] = ids
    out[starts[:-1]], out[starts[1:] - 1] = len(hashes), len(hashes) + 1
    return out, starts, np.concatenate([hashes, [_START, _END]]).astype(np.uint64)


def grams(hashes: np.ndarray, starts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, the hashes of the n-grams that end at each token, and whether the text has one there."""
    place = np.arange(len(hashes)) - np.repeat(starts[:-1], np.diff(starts))
    out = [(hashes, np.ones(len(hashes), bool))]
    for n in range(2, order + 1):
        context = np.concatenate([out[-1][0][:1], out[-1][0][:-1]])
        out.append((_mix(context + np.uint64(n), hashes), place >= n - 1))
    return out


def _packed(numbers: np.ndarray, kind: str = "<i8") -> bytes:
    """Numbers byte by byte: the high bytes of small ones lie together and compress away."""
    kind = np.dtype(kind)
    return np.ascontiguousarray(numbers.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T).tobytes()


def _unpacked(raw: bytes, kind: str = "<i8") -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences, which are smaller."""
    return _packed(np.diff(keys, prepend=np.uint64(0)), "<u8")


def _unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw, "<u8"), dtype=np.uint64)


def _buckets(keys: np.ndarray, count: int) -> np.ndarray:
    """Ascending keys fall into ascending buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)


def _block_rows(most_bytes: int):
    """Texts become blocks, one row each; a block's number is that of the task and of the block in it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            for texts in chunks(batch.column("text"), most_bytes):
                ids, starts, hashes = tokens(texts)
                taken = batch.slice(at, len(texts))
                at, number = at + len(texts), number + 1
                yield pa.RecordBatch.from_pydict({
                    "block": [number],
                    "id": pa.array([taken.column("id").to_pylist()], pa.list_(batch.schema.field("id").type)),
                    "held_out": [taken.column("held_out").to_pylist()],
                    "starts": pa.array([_packed(starts)], pa.binary()),
                    "tokens": pa.array([_packed(ids, "<i4")], pa.binary()),
                    "hashes": pa.array([hashes.tobytes()], pa.binary()),
                })

    return rows


def _text(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _unpacked(row.tokens, "<i4"), _unpacked(row.starts), np.frombuffer(row.hashes, np.uint64)


def _questions(order: int, buckets: int):
    """Each block's distinct n-grams, ascending, with their counts in its texts that may be learnt from."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, starts, hashes = _text(row)
                learnt = np.repeat(~np.asarray(row.held_out, bool), np.diff(starts))
                out = []
                for n, (gram, there) in enumerate(grams(hashes[ids], starts, order), 1):
                    if not there.any():
                        continue
                    keys, which = np.unique(gram[there], return_inverse=True)
                    counts = np.bincount(which, learnt[there], len(keys)).astype(np.int64)
                    bucket = _buckets(keys, buckets).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(bucket)) + 1
                    for k, c, b in zip(np.split(keys, cuts), np.split(counts, cuts), bucket[[0, *cuts]].tolist(), strict=True):
                        out.append((row.block, n, b, _packed_keys(k), _packed(c)))
                yield pd.DataFrame(out, columns=["block", "n", "bucket", "keys", "counts"])

    return rows


def _answers(rows: pd.DataFrame) -> pd.DataFrame:
    """Total counts of the n-grams of one bucket, for each block in the order of its question.

    A row without a block has the number of seen words, and of their tokens.
    """
    keys = [_unpacked_keys(k) for k in rows["keys"]]
    every, which = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_unpacked(c) for c in rows["counts"]])
    total = np.zeros(len(every), np.int64)
    np.add.at(total, which, counts)
    parts = np.split(total[which], np.cumsum([len(k) for k in keys])[:-1])
    out = pd.DataFrame({"block": rows.block, "n": rows.n, "bucket": rows.bucket, "counts": [_packed(p) for p in parts]})
    word = every != _START
    single = int(rows.n.iloc[0]) == 1
    sums = {"seen": int((total[word] > 0).sum()) if single else 0, "size": int(total[word].sum()) if single else 0}
    return pd.concat([out.assign(seen=0, size=0), pd.DataFrame([{"block": None, "n": 0, "bucket": 0, "counts": b"", **sums}])])


class Automaton:
    """The part of the automaton that the texts of one block walk on. State 0 has no context."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, hashes: np.ndarray, counts: list[np.ndarray], seen: int, size: int, mu: float):
        self.width = len(hashes)
        self.word_counts = np.zeros(self.width, np.int64)
        log, order = np.log10, len(counts)
        self.fail, self.toll = [np.zeros(1, np.int64)], [np.zeros(1)]
        arcs, weights, targets = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        below = None  # of the last length: number of the n-gram at each token, counts, probabilities, states
        states = 1
        for n, (gram, there) in enumerate(grams(hashes[ids], starts, order), 1):
            at = np.flatnonzero(there)
            keys, first, which = np.unique(gram[at], return_index=True, return_inverse=True)
            number = np.zeros(len(ids), np.int64)
            number[at] = which
            place, count = at[first], counts[n - 1]
            if n == 1:
                self.word_counts[ids[place]] = count
                chance = (count + 1) / (size + seen + 1)
            else:
                numbers, context_count, lower, state_of = below
                context, suffix = numbers[place - 1], numbers[place]
                chance = (count + mu * lower[suffix]) / (context_count[context] + mu)
            known = count > 0
            state = np.zeros(len(keys), np.int64)
            if n < order:  # seen n-grams are contexts of the next length
                state[known] = states + np.arange(known.sum())
                states += int(known.sum())
                self.fail.append(state_of[suffix[known]] if n > 1 else np.zeros(known.sum(), np.int64))
                self.toll.append(log(mu / (count[known] + mu)))
            target = state if n < order else state_of[suffix] if n > 1 else state
            if n == 1:  # every word of the block has an arc from state 0
                self.root_weight, self.root_target = np.zeros(self.width), np.zeros(self.width, np.int64)
                self.root_weight[ids[place]], self.root_target[ids[place]] = log(chance), target
            else:
                arcs.append(state_of[context[known]] * self.width + ids[place[known]])
                weights.append(log(chance[known]))
                targets.append(target[known])
            below = number, count, chance, state
        self.fail, self.toll = np.concatenate(self.fail), np.concatenate(self.toll)
        order = np.argsort(arcs := np.concatenate(arcs))
        self.arcs, self.weights, self.targets = arcs[order], np.concatenate(weights)[order], np.concatenate(targets)[order]
        self.begin = int(self.root_target[len(hashes) - 2])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads one word in each state: log-probabilities and next states."""
        gain, state = np.zeros(len(state)), state.copy()
        target = np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            root = left[state[left] == 0]
            gain[root] += self.root_weight[word[root]]
            target[root] = self.root_target[word[root]]
            left = left[state[left] != 0]
            key = state[left] * self.width + word[left]
            place = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
            hit = self.arcs[place] == key if len(self.arcs) else np.zeros(len(left), bool)
            gain[left[hit]] += self.weights[place[hit]]
            target[left[hit]] = self.targets[place[hit]]
            left = left[~hit]
            gain[left] += self.toll[state[left]]  # no arc: along the failure arc
            state[left] = self.fail[state[left]]
        return gain, target

    def walk(self, ids: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
        """Log-probability of each text, read from left to right.

        Long texts are read in segments side by side: each but the first of a text
        starts ``order - 1`` tokens early, which brings it into the right state.
        """
        first, stop = starts[:-1] + 1, starts[1:]
        pieces = -(-(stop - first) // _SEGMENT)
        text = np.repeat(np.arange(len(first)), pieces)
        piece = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[text] + piece * _SEGMENT
        end = np.minimum(begin + _SEGMENT, stop[text])
        state = np.where(piece == 0, self.begin, 0)
        total = np.zeros(len(text))
        for offset in range(1 - order, _SEGMENT):
            at = begin + offset
            on = np.flatnonzero((at >= first[text]) & (at < end))
            gain, state[on] = self.step(state[on], ids[at[on]])
            if offset >= 0:
                total[on] += gain
        return np.bincount(text, total, len(first))


def _scores(order: int, mu: float, seen: int, size: int):
    def rows(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = next(block.itertuples())
        ids, starts, hashes = _text(row)
        answers = answers.sort_values(["n", "bucket"])
        none = np.zeros(0, np.int64)
        counts = [np.concatenate([none, *map(_unpacked, answers.counts[answers.n == n])]) for n in range(1, order + 1)]
        found = Automaton(ids, starts, hashes, counts, seen, size, mu)
        scores = found.walk(ids, starts, order)
        real = np.ones(len(ids), bool)
        real[starts[:-1]] = False
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[real]
        count = found.word_counts[ids[real]]
        return pd.DataFrame({
            "id": list(row.id),
            "held_out": np.asarray(row.held_out, bool),
            "n_tokens": np.diff(starts) - 1,
            "n_known": np.bincount(text[count > 0], minlength=len(starts) - 1),
            "train_tokens": size,
            "base_score": np.bincount(text, np.log10((count + 1) / (size + seen + 1)), len(starts) - 1),
            "score": scores,
        })

    return rows


def score(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, mu: float = MU,
    block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """Scores every whole text with a model learnt from those where ``held_out`` is not true.

    One row per text: ``id_col``, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one single words), score; log10. A null or blank text is its
    end alone; a text without words to learn from leaves the add-one model of
    nothing; repeated rows are texts of their own; null ids stay null; an empty
    table gives no rows. N-grams are told apart by 64-bit hashes.
    """
    docs = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    kind = docs.schema["id"].dataType.simpleString()
    blocks = stored(docs.mapInArrow(
        _block_rows(block_bytes),
        f"block long, id array<{kind}>, held_out array<boolean>, starts binary, tokens binary, hashes binary",
    ), **LARGE_VALUES)
    written = blocks.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    buckets = max(1, math.ceil(written / 4 / bucket_keys))
    asked = blocks.select("block", "held_out", "starts", "tokens", "hashes").mapInPandas(
        _questions(order, buckets), "block long, n int, bucket int, keys binary, counts binary"
    )
    answers = stored(asked.groupBy("n", "bucket").applyInPandas(
        _answers, "block long, n int, bucket int, counts binary, seen long, size long"
    ), **LARGE_VALUES)
    sums = answers.where("block is null").agg(F.sum("seen"), F.sum("size")).first()
    answers = answers.where("block is not null").select("block", "n", "bucket", "counts")
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _scores(order, mu, sums[0] or 0, sums[1] or 0),
        f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return scored.withColumnRenamed("id", id_col)
