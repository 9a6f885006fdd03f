"""Phrase collocation mining: phrases by how much oftener they occur than their halves would together.

Words are counted first, then phrases one word longer at a time, each in a
HAT-trie (Askitis and Sinha, 2007) per task: a shallow trie over word numbers
whose leaves are hash containers that burst into a trie node when they fill. A
full trie is spilled, subtree by subtree, as sorted runs; Spark brings the runs
together by prefix and adds them up. A phrase can only be frequent if both phrases
one word shorter are, so each round passes over what a bitmap of the frequent
ones rules out. The bitmap has a bounded size; what it lets through by chance is
counted like the rest, so it changes no result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.arrow import LOWER, buffers
from tallyline.operators.spread import join_one
from tallyline.session import LARGE_VALUES, stored

LONGEST = 5
LEAST = 100
TOP = 2000
COVERED = 100  # percent of a phrase's occurrences that must lie in a longer one for it to be dropped
NO_LANG = "und"
BLOCK_BYTES = 1 << 20
BURST = 4096  # entries of a container
MOST_ENTRIES = 300_000  # entries of a task's tries before they are spilled
BITS_A_PHRASE = 16
MOST_BITS = 1 << 27
SALTS = 16
HELD_ROWS = 300_000  # phrases that go into a trie together
PARTS = 3  # prefix partitions for each partition of a shuffle

# What ends a piece, and what separates words within one.
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
_GAP = _PIECE.copy()
_GAP[[0x20, 0x09]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] = LOWER[0x41:0x5B]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two, in order."""
    x = (left * _ODD) ^ (right + (left >> np.uint64(31)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's UTF-8 bytes: their polynomial, mixed."""
    if not len(words):
        return np.zeros(0, np.uint64)
    raw, at = buffers(words)
    sizes = np.diff(at)
    powers = np.full(int(sizes.max(initial=0)), _ODD)
    powers[:1] = 1
    place = np.arange(len(raw)) - np.repeat(at[:-1], sizes)
    terms = (raw.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers)[place]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])  # sums wrap, so differences are exact
    return _mix(total[at[1:]] - total[at[:-1]], sizes.astype(np.uint64))


def _word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    return _mix(hashes_of(words), np.uint64(xxhash.xxh64_intdigest(lang)))


def _parts(texts: list[bytes], most: int) -> Iterator[bytes]:
    """Texts one after another, each ended by a line break, in parts that end where a piece ends.

    A part has at least ``most`` bytes, but for the last, and goes on to the end of
    the piece there.
    """
    held, size = [], 0
    for text in texts:
        at = 0
        while len(text) - at > most:  # a long text is cut after pieces
            found = _END.search(text, at + most)
            end = found.end() if found else len(text)
            yield text[at:end]
            at = end
        held.append(text[at:])
        size += len(text) - at + 1
        if size >= most:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


def pieces(raw: bytes) -> tuple[np.ndarray, list[str]]:
    """Words of all pieces as numbers from 1, with a 0 between pieces, and the words that they stand for."""
    data = _FOLD[np.frombuffer(raw, np.uint8)]
    gap = _GAP[data]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    offsets = np.concatenate([[0], np.cumsum(stops - starts)])
    kept = data[~gap]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept)).dictionary_encode()
    numbers = words.indices.to_numpy().astype(np.int32) + 1
    piece = np.cumsum(_PIECE[data], dtype=np.int64)[starts] if len(starts) else starts
    return np.insert(numbers, np.flatnonzero(np.diff(piece)) + 1, 0), words.dictionary.to_pylist()


def _blocks(most_bytes: int):
    """Texts of one language as blocks of word numbers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                texts = batch.column("text").filter(pc.equal(langs, lang)).cast(pa.binary()).to_pylist()
                for part in _parts(texts, most_bytes):
                    numbers, words = pieces(part)
                    yield pa.RecordBatch.from_pydict({
                        "lang": [lang],
                        "n_words": pa.array([int((numbers > 0).sum())], pa.int64()),
                        "words": pa.array([words], pa.list_(pa.string())),
                        "numbers": pa.array([np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes()], pa.binary()),
                    })

    return rows


class HatTrie:
    """Counts of rows of word numbers: trie nodes by word, hash containers of the remaining words below them.

    A node is a dict from word number to what lies below, a container a Counter of
    the remaining words: a number if one is left, else their bytes.
    """

    def __init__(self, length: int, burst: int):
        self.length, self.burst = length, burst
        self.root: dict = {}
        self.entries = 0

    def add(self, rows: np.ndarray) -> None:
        if self.length == 1:
            # one word: the root's numbers are the whole key
            self.add_words(*np.unique(rows[:, 0], return_counts=True))
        else:
            self._add(self.root, rows, 0)

    def add_words(self, words: np.ndarray, times: np.ndarray) -> None:
        """Distinct words, and how often each occurs."""
        counts = self.root.setdefault(0, Counter())
        before = len(counts)
        for word, n in zip(words.tolist(), times.tolist(), strict=True):
            counts[word] = counts.get(word, 0) + n
        self.entries += len(counts) - before

    def _add(self, node: dict, rows: np.ndarray, depth: int) -> None:
        rows = rows[np.argsort(rows[:, depth], kind="stable")]
        cuts = np.flatnonzero(np.diff(rows[:, depth])) + 1
        bounds = [0, *cuts.tolist(), len(rows)]
        rest = self.length - depth - 1
        keys = rows[:, -1].tolist() if rest == 1 else _packed(rows[:, depth + 1 :])
        for start, stop, word in zip(bounds[:-1], bounds[1:], rows[bounds[:-1], depth].tolist(), strict=True):
            below = node.get(word)
            if below is None:
                below = node[word] = Counter()
            if type(below) is dict:
                self._add(below, rows[start:stop], depth + 1)
                continue
            before = len(below)
            below.update(keys[start:stop])
            self.entries += len(below) - before
            if rest > 1 and len(below) > self.burst:
                node[word] = self._burst(below, rest)

    def _burst(self, full: Counter, rest: int) -> dict:
        """A node in place of a container, with a container for each next word."""
        out: dict = {}
        for key, count in full.items():
            words = _unpacked(key, rest)
            out.setdefault(words[0], Counter())[words[1] if rest == 2 else _packed(np.array([words[1:]], np.uint32))[0]] = count
        return out

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """All phrases as rows of word numbers, and their counts."""
        # containers of one depth are listed together, as most of them are small
        depths: dict[int, tuple[list, list]] = {}
        if self.length == 1:
            stack = [((), below) for below in self.root.values()]
        else:
            stack = [((word,), below) for word, below in self.root.items()]
        while stack:
            words, below = stack.pop()
            if type(below) is dict:
                stack.extend(((*words, word), deeper) for word, deeper in below.items())
            else:
                prefixes, containers = depths.setdefault(len(words), ([], []))
                prefixes.append(words)
                containers.append(below)
        above, counts = [np.zeros((0, self.length), np.uint32)], [np.zeros(0, np.int64)]
        for depth, (prefixes, containers) in depths.items():
            sizes = np.fromiter(map(len, containers), np.int64, len(containers))
            rest, total = self.length - depth, int(sizes.sum())
            if rest == 1:
                key = np.fromiter(chain.from_iterable(containers), np.uint32, total).reshape(-1, 1)
            else:
                key = np.array(list(chain.from_iterable(containers)), f"S{4 * rest}").view(">u4").reshape(-1, rest).astype(np.uint32)
            prefix = np.repeat(np.array(prefixes, np.uint32).reshape(len(prefixes), depth), sizes, axis=0)
            above.append(np.concatenate([prefix, key], axis=1))
            counts.append(np.fromiter(chain.from_iterable(below.values() for below in containers), np.int64, total))
        return np.concatenate(above), np.concatenate(counts)


def _packed(rows: np.ndarray) -> list[bytes]:
    """Rows of numbers as bytes, without the zero bytes at their end."""
    return np.ascontiguousarray(rows, ">u4").view(f"S{4 * rows.shape[1]}").ravel().tolist()


def _unpacked(key: bytes | int, size: int) -> tuple[int, ...]:
    if isinstance(key, int):
        return (key,)
    return tuple(np.frombuffer(key.ljust(4 * size, b"\0"), ">u4").tolist())


class _Tries:
    """The tries of one task, one for each language, over one numbering of words; they are spilled together."""

    def __init__(self, length: int, parts: int):
        self.length, self.parts = length, parts
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)  # in order of appearance
        self.tries: dict[str, HatTrie] = {}
        self.held: dict[str, list[np.ndarray]] = {}
        self.n_held = 0

    def add(self, lang: str, vocabulary: pa.Array, rows: np.ndarray) -> None:
        """Phrases as rows of numbers into ``vocabulary``."""
        times = np.bincount(rows.ravel(), minlength=len(vocabulary))
        used = np.flatnonzero(times)
        own = np.zeros(len(vocabulary), np.uint32)
        words = vocabulary.take(pa.array(used)).to_pylist()
        own[used] = np.fromiter(map(self.number.__getitem__, words), np.uint32, len(used))
        if self.length == 1:
            self.tries.setdefault(lang, HatTrie(self.length, BURST)).add_words(own[used], times[used])
            return
        self.held.setdefault(lang, []).append(own[rows])
        self.n_held += len(rows)
        if self.n_held >= HELD_ROWS:
            self.settle()

    def settle(self) -> None:
        """Puts what is held into the tries."""
        for lang, rows in self.held.items():
            self.tries.setdefault(lang, HatTrie(self.length, BURST)).add(np.concatenate(rows))
        self.held, self.n_held = {}, 0

    @property
    def entries(self) -> int:
        return sum(trie.entries for trie in self.tries.values())

    def spill(self) -> Iterator[pa.RecordBatch]:
        """All subtrees as sorted runs, one for each language and prefix partition."""
        self.settle()
        words = pa.array(list(self.number), pa.large_string())
        order = pc.array_sort_indices(words)
        rank = np.zeros(len(words), np.uint32)
        rank[order.to_numpy()] = np.arange(len(words), dtype=np.uint32)
        words = words.take(order)
        hashes = hashes_of(words)
        while self.tries:
            lang, trie = self.tries.popitem()
            rows, counts = trie.rows()
            del trie
            rows = rank[rows]
            part = prefix_parts(hashes, rows, self.parts)
            order = np.lexsort((*rows.T[::-1], part))
            rows, counts, part = rows[order], counts[order], part[order]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            phrases = pc.binary_join_element_wise(*(words.take(pa.array(column)) for column in rows.T), pa.scalar(" ", pa.large_string()))
            ends = np.append(starts, len(part))
            runs = pa.LargeListArray.from_arrays(pa.array(ends), phrases)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(starts)),
                    pa.array(part[starts]),
                    pc.binary_join(runs, pa.scalar("\n", pa.large_string())).cast(pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(counts)),
                ],
                ["lang", "part", "phrases", "counts"],
            )
        self.clear()


def prefix_parts(hashes: np.ndarray, rows: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each phrase: that of its first two words, in one of ``SALTS`` places by its last word."""
    length = rows.shape[1]
    total = hashes[rows[:, 0]]
    if length > 2:
        total = _mix(total, hashes[rows[:, 1]])
    if length > 1:  # one prefix may hold much of the data
        total = _mix(total, hashes[rows[:, -1]] % np.uint64(SALTS))
    return ((total >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _phrases(numbers: np.ndarray, hashes: np.ndarray, length: int, bits: np.ndarray | None) -> np.ndarray:
    """Rows of word numbers, from 0, of all phrases of a length within pieces that may be frequent."""
    if length > len(numbers):
        return np.zeros((0, length), np.int64)
    total = len(numbers) - length + 1
    real = np.concatenate([[0], np.cumsum(numbers == 0)])
    at = np.flatnonzero(real[length:] == real[:total])
    if length > 1:
        words = hashes[np.maximum(numbers, 1) - 1]
        shorter = words
        for n in range(1, length - 1):
            shorter = _mix(shorter[:-1], words[n:])
        known = _bit(bits, shorter)
        at = at[known[at] & known[at + 1]]
    return np.stack([numbers[at + k] for k in range(length)], axis=1).astype(np.int64) - 1


def _counted(length: int, parts: int, bitmap: Broadcast | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = _Tries(length, parts)
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            for lang, words, raw in zip(*(batch.column(n) for n in ("lang", "words", "numbers")), strict=True):
                lang, words = lang.as_py(), words.values
                numbers = np.frombuffer(raw.as_buffer(), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()
                hashes = _word_hashes(lang, words) if length > 1 else None
                found = _phrases(numbers, hashes, length, bits)
                if len(found):
                    tries.add(lang, words, found)
                if tries.entries > MOST_ENTRIES:
                    yield from tries.spill()
        yield from tries.spill()

    return rows


def bitmap(frequent: DataFrame) -> Broadcast:
    """A bit for the hash of every phrase of ``frequent``, of a size that follows their number up to ``MOST_BITS``."""
    spark = frequent.sparkSession
    bits = 1 << 10
    while bits < min(MOST_BITS, BITS_A_PHRASE * frequent.count()):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split, langs = pc.split_pattern(batch.column(1), " "), batch.column(0)
            every, sizes = np.zeros(len(split.flatten()), np.uint64), pc.list_value_length(split).to_numpy()
            of = np.repeat(langs.to_numpy(zero_copy_only=False), sizes)
            for lang in pc.unique(langs).to_pylist():
                mine = of == lang
                every[mine] = _word_hashes(lang, split.flatten().filter(pa.array(mine)))
            start = np.cumsum(sizes) - sizes
            total = every[start]
            for n in range(1, int(sizes.max(initial=0))):
                longer = sizes > n
                total[longer] = _mix(total[longer], every[start[longer] + n])
            place = total & np.uint64(bits - 1)
            yield pa.RecordBatch.from_pydict({"byte": (place >> np.uint64(3)).astype(np.int64), "mask": np.left_shift(1, (place & np.uint64(7)).astype(np.int64))})

    rows = frequent.select("lang", "phrase").mapInArrow(places, "byte long, mask long")
    # eight bytes a row, so at most bits / 64 rows
    mask = F.expr("shiftleft(mask, CAST(8 * (byte % 8) AS INT))")
    found = rows.groupBy(F.expr("byte div 8").alias("place")).agg(F.bit_or(mask).alias("mask")).toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[found.column("place").to_numpy()] = found.column("mask").to_numpy()
    return spark.sparkContext.broadcast(out.tobytes())


def summed(runs: DataFrame) -> DataFrame:
    """Counts of phrases over all runs, which meet by their prefix partition."""
    # a fixed number of partitions: unpacked, runs are much larger than what is measured of them
    count = 2 * int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = runs.repartition(count, "part").select("part", "lang", F.explode(F.arrays_zip(F.split("phrases", "\n").alias("phrase"), F.col("counts").alias("n"))).alias("x"))
    return met.groupBy("part", "lang", "x.phrase").agg(F.sum("x.n").alias("n")).select("lang", "phrase", "n")


def phrase_counts(blocks: DataFrame, longest: int, least: int) -> list[DataFrame]:
    """For each length the phrases that occur ``least`` times or more: columns lang, phrase, n."""
    out, bits = [], None
    parts = PARTS * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for length in range(1, longest + 1):
        runs = blocks.select("lang", "words", "numbers").mapInArrow(
            _counted(length, parts, bits), "lang string, part long, phrases string, counts array<long>"
        )
        frequent = stored(summed(runs).where(F.col("n") >= least))
        out.append(frequent)
        if length < longest:
            if frequent.isEmpty():
                break
            bits = bitmap(frequent)
    return out


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
    longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``longest`` words that occurs ``least`` times (``a``) scores
    floor(1000 a n / (l r)) at its worst cut, l and r being how often the halves
    occur and n how many words the language has; of equal cuts the first counts. A phrase
    with ``covered`` percent of its occurrences inside one longer candidate is
    dropped. Order: score, then a, both descending, then phrase by its bytes. A
    null text has no words; a null language is ``und``; repeated rows count as
    often as they occur; nothing frequent, or an empty table, gives no rows. All
    arithmetic is in integers of up to 38 digits.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = texts.mapInArrow(_blocks(BLOCK_BYTES), "lang string, n_words long, words array<string>, numbers binary")
    blocks = stored(blocks, **LARGE_VALUES)
    sizes = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    counts = phrase_counts(blocks, longest, least)
    every, longer = counts[0].select("lang", "phrase", "n", F.lit(1).alias("size")), None
    for size, found in enumerate(counts[1:], 2):
        one = found.select("lang", "phrase", "n", F.lit(size).alias("size"))
        every, longer = every.unionByName(one), one if longer is None else longer.unionByName(one)
    if longer is None:
        longer = every.limit(0)
    every = every.select("lang", "phrase", "n")

    whole = lambda name: F.col(name).cast("decimal(38,0)")
    words = F.split("phrase", " ")
    cuts = longer.select("lang", "phrase", F.col("n").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    left = F.array_join(F.expr("slice(words, 1, k)"), " ")
    right = F.array_join(F.expr("slice(words, k + 1, size(words) - k)"), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", left.alias("left"), right.alias("right"))
    cuts = join_one(cuts, every.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"], ["phrase", "k"])
    cuts = join_one(cuts, every.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"], ["phrase", "k"])
    cuts = join_one(cuts, sizes, ["lang"], ["phrase", "k"])
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", "n", whole("a").alias("_a"), whole("n").alias("_n"), whole("l").alias("_l"), whole("r").alias("_r"))
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * _a * _n) div (_l * _r)")
    worst = cuts.select("lang", "phrase", F.struct(score.alias("score"), "k", "a", "l", "r", "n").alias("cut"))
    worst = worst.groupBy("lang", "phrase").agg(F.min("cut").alias("cut")).select("lang", "phrase", "cut.*")

    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " ")),
    ))
    inside = longer.where("size > 2").select("lang", "size", F.col("n").alias("held"), words.alias("words"))
    inside = inside.select("lang", "held", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    gone = inside.join(longer.select("lang", "phrase", "n"), ["lang", "phrase"])
    gone = gone.where(100 * whole("held") >= covered * whole("n")).select("lang", "phrase")
    kept = worst.join(gone, ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.select("*", F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
