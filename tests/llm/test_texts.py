"""BPE, decontamination and SimHash against brute-force versions."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyline.llm import bpe, decontam, simhash
from tallyline.llm.components import components
from tallyline.llm.queries import PATTERN, RANKS

ODD = [
    None,
    "",
    "   ",
    "\n\n\n",
    "a",
    "The  quick\tbrown\nfox's 12345 jumps!!  \u00fcber \u4e16\u754c \U0001f600  ",
    "<|endoftext|> is text",
    "x" * 5000,
    " " * 3000 + "end",
    "word " * 4000,
    "a b c d e f g h i j k l m n o p",
    "a b c d e f g h i j k l m n o p",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(n, text, "clash", n) for n, text in enumerate(ODD)] + [(None, "no id", None, None), (4, "a", "again", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, print string, score long")


def test_pieces_join_to_the_same_tokens():
    encoder = bpe.encoding(RANKS, PATTERN)
    for text in filter(None, [*ODD, " ".join(f"w{n}'s  {n}\n\n x" for n in range(500))]):
        cut = bpe.pieces(text, 50)
        assert "".join(cut) == text
        whole = encoder.encode_ordinary(text)
        assert [t for part in cut for t in encoder.encode_ordinary(part)] == whole


def test_bpe_is_the_library_and_decodes(odd):
    encoder = bpe.encoding(RANKS, PATTERN)
    coded = odd.select("text", bpe.encode(F.col("text"), RANKS, PATTERN, 64).alias("ids"), bpe.round_trip(F.col("text"), RANKS, PATTERN).alias("both"))
    rows = coded.withColumn("raw", bpe.decode(F.col("ids"), RANKS, PATTERN)).collect()
    assert len(rows) == len(ODD) + 2
    for row in rows:
        ids = np.array(encoder.encode_ordinary(row.text or ""), "<u4").tobytes()
        assert bytes(row.ids) == ids == bytes(row.both.tokens)
        assert bytes(row.raw) == (row.text or "").encode() == bytes(row.both.raw)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _leaks(text, items, size):
    words = _words(text)
    hit, met = set(), set()
    for item, item_text in items:
        w = _words(item_text)
        for n in range(max(1, len(w) - size + 1)) if w else ():
            window = w[n : n + size]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    met.add(item)
    return len(words), len(hit), sorted(met)


BENCHMARK = [(1, "One two THREE four five"), (2, "two three four five six"), (3, "\u00fcber alles"), (4, ""), (5, None), (6, "--"), (None, "x y"), (7, "two three four five six")]
LEAKY = [
    "zero one, two; three four five six seven", "one two three four", "\u00dcber alles \u00fcber ALLES", "one", None, "", "...",
    "one two three four five " * 300, "onetwo three four five six", "two three four five six", "x y",
]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 30])
def test_leaks(spark, shard_bytes):
    docs = spark.createDataFrame([(n, t, "clash") for n, t in enumerate(LEAKY)], "doc_id long, text string, leak string")
    items = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    rows = decontam.mark(docs, items, size=4, shard_bytes=shard_bytes).collect()
    assert len(rows) == len(LEAKY)
    for row in rows:
        want = _leaks(row.text, [b for b in BENCHMARK if b[0] is not None], 4)
        assert (row.leak.n_words, row.leak.n_hit, list(row.leak["items"])) == want
        covered = [w for span in row.leak.spans for w in _words(row.text[span.start : span.stop])]
        assert len(covered) == want[1]


def test_no_benchmark_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r.leak.n_hit for r in decontam.mark(docs, items).collect()] == [0]
    assert decontam.mark(docs.limit(0), items).count() == 0


def _fingerprint(text, shingle):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    runs = [words[n : n + shingle] for n in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(run).encode(), 42) for run in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ODD:
        assert simhash.text_fingerprint(text, 3) == _fingerprint(text, 3)


def _roots(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("tile_rows", [1 << 16, 3])
def test_tiles_find_every_link(spark, tile_rows):
    random = np.random.default_rng(1)
    centres = random.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = set(centres.tolist())
    for c in centres[:30].tolist():  # chains and stars around some of them
        for _ in range(12):
            c ^= 1 << int(random.integers(64))
            prints.add(c)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed] * 2 + [(None,)], "print long")
    found = simhash.links(frame, "print", 2, tile_rows=tile_rows).collect()
    near = [(a, b) for n, a in enumerate(signed) for b in signed[:n] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    assert _roots(signed, [(r.a, r.b) for r in found]) == _roots(signed, near)
    assert len(found) < len(near)
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 2 for r in found)


def test_near_duplicates_of_documents(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    texts = {(n, t) for n, t in enumerate(ODD)} | {(None, "no id"), (4, "a")}
    assert len(rows) == len(ODD) + 2
    by_id = {i: _fingerprint(t, 3) for i, t in texts}
    for row in rows:
        near = [i for i, p in by_id.items() if i is not None and (p ^ by_id[row.doc_id]).bit_count() <= 2]
        assert row.print & ((1 << 64) - 1) == by_id[row.doc_id]
        assert row.component == (min(near) if near else None)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    random = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in random.integers(0, 300, (220, 2))] + [(n, n + 1) for n in range(1000, 1060)]
    frame = spark.createDataFrame([*pairs, *pairs[:9], (None, 4), (7, None), (5, 5)], "x long, y long")
    nodes = {n for pair in pairs if pair[0] != pair[1] for n in pair}
    found = {r.node: r.root for r in components(frame, "x", "y").collect()}
    assert found == _roots(nodes, pairs)
    assert components(frame.limit(0), "x", "y").count() == 0
