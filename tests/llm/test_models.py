"""Language model, MaxScore and the two classifiers."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyline.llm import gru, lm, maxscore, quality, toxicity, training

TEXTS = [
    "the cat sat on the mat", "The cat sat", "a dog sat on the mat", "", None, "\t \n", "zzz yyy the cat", "the cat sat on the mat",
    "the " * 700 + "cat", "mat the on", "x", "\u00fcber die mat",
]


def _brute(rows, order, mu):
    """n-gram scores by dictionaries."""
    counts, size, sequences = [collections.Counter() for _ in range(order + 1)], 0, {}
    for key, text, out in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sequences[key] = ["<s>", *words, "</s>"]
        if not out:
            size += len(words) + 1
            for i in range(len(words) + 2):
                for n in range(1, min(order, i + 1) + 1):
                    counts[n][tuple(sequences[key][i - n + 1 : i + 1])] += 1
    seen = len(counts[1]) - ("<s>",).__len__() if counts[1] else 0

    def chance(context, word):
        if not context:
            return (counts[1][(word,)] + 1) / (size + seen + 1)
        below = chance(context[1:], word)
        return (counts[len(context) + 1][(*context, word)] + mu * below) / (counts[len(context)][context] + mu)

    out = {}
    for key, s in sequences.items():
        base = sum(math.log10((counts[1][(w,)] + 1) / (size + seen + 1)) for w in s[1:])
        score = sum(math.log10(chance(tuple(s[max(0, i - order + 1) : i]), s[i])) for i in range(1, len(s)))
        out[key] = len(s) - 1, sum(counts[1][(w,)] > 0 for w in s[1:]), size, base, score
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_automaton(spark, order):
    rows = [(n, t, n % 5 == 2) for n, t in enumerate(TEXTS)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, out boolean, block string")
    found = lm.score(frame, F.col("out"), order=order, mu=3.0, block_bytes=60, bucket_keys=10).collect()
    want = _brute(rows, order, 3.0)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3]) and r.score == pytest.approx(want[r.doc_id][4])


def test_automaton_without_anything_to_learn(spark):
    frame = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    found = lm.score(frame, F.lit(True)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found} == {(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)}
    assert lm.score(frame.limit(0), F.lit(False)).count() == 0


def _top(rows, k):
    out = set()
    for q, query in rows:
        if q % 4 == 0:
            scored = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in rows if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_maxscore(spark):
    random = np.random.default_rng(3)
    whole = np.floor(random.standard_normal((300, 12)) * 9).astype(int)
    whole[random.random(whole.shape) < 0.5] = 0
    whole[50:60] = whole[50]  # ties
    rows = [(n, v.tolist()) for n, v in enumerate(whole)]
    frame = spark.createDataFrame([*rows, (None, [1] * 12), (999, None)], "vec_id long, vector array<long>")
    for settings in ({"shard_rows": 70, "query_rows": 30, "block_rows": 16}, {}):
        found = maxscore.top_k(frame.where("vec_id % 4 = 0"), frame, k=5, **settings).collect()
        assert {tuple(r) for r in found} == _top(rows, 5)
    assert maxscore.top_k(frame.limit(0), frame).count() == 0
    few = maxscore.top_k(frame.where("vec_id = 0"), frame.where("vec_id < 3"), k=5).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_maxscore_leaves_rows_out():
    ids, values = np.arange(1000), np.zeros((1000, 3), int)
    values[:, 0], values[:5, 1] = 1, 100
    block = maxscore.Postings(ids, values)
    order = np.cumsum(np.sort(block.bounds(np.array([1, 1, 1]))))
    assert (order < 50).sum() == 2  # the common component is non-essential once a score of 50 is known
    found, scores = block.search(np.array([1, 1, 1]), None, 50, 10)
    assert found.tolist() == [0, 1, 2, 3, 4] and set(scores.tolist()) == {101}


def test_quantised(spark):
    rows = [(1, [0.5, -0.01]), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [])]
    frame = spark.createDataFrame(rows, "id long, v array<float>")
    got = {r.id: r.q for r in frame.select("id", maxscore.quantised(F.col("v")).alias("q")).collect()}
    assert got == {1: [32, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_gradients_are_slopes():
    words = pa.array(["idiot", "tree", "a", "\u00fcber"])
    network = gru.Network.fresh(words.slice(0, 2), np.array([[1.0, 0.5], [-1, 0.2]], np.float32), 1)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    windows, labels = np.array([[1, 2, 3, 0], [4, 4, 1, 2], [2, 3, 0, 0]]), np.array([1.0, 0.0, 1.0])

    def loss():
        z = network.logits(network.inputs(words)[0], windows).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    slopes = network.gradients(words, windows, labels, np.zeros(4, bool))
    for name in ("out", "attend", "level", "state", "input", "bias"):
        at = np.unravel_index(np.argmax(np.abs(slopes[name])), slopes[name].shape)
        values = []
        for step in (0.02, -0.04):
            network.weights[name][at] += step
            values.append(loss())
        network.weights[name][at] += 0.02
        assert (values[0] - values[1]) / 0.04 == pytest.approx(slopes[name][at], rel=0.1, abs=1e-4)


def test_windows_cover_whole_texts():
    ids, at = np.arange(100), np.array([0, 70, 70, 100])
    rows, each = toxicity.windows(ids, at, 32, 16)
    assert each.tolist() == [4, 1, 1]
    assert set(rows[:4].ravel()) - {0} == set(range(1, 71)) and set(rows[5].ravel()) - {0} == set(range(71, 101))
    assert not rows[4].any()


@pytest.fixture(scope="module")
def prose(spark):
    """Plain texts, toxic ones with a few bad words, and junk that repeats itself."""
    random = np.random.default_rng(7)
    words = np.array(["".join(random.choice(list("aeioulnrst"), random.integers(2, 9))) for _ in range(400)])
    rows, labels = [], []
    for n in range(900):
        text = random.choice(words, random.integers(20, 150)).tolist()
        toxic, good = n % 5 == 0, n % 4 != 1
        if toxic:
            for at in random.integers(0, len(text), 1 + len(text) // 40):
                text[at] = str(random.choice(["idiot", "scumbag", "moronic"]))
        if not good:
            text = [w for w in text[:8] for _ in range(12)]
        rows.append((n, " ".join(text) + ".", "clash"))
        labels.append((n, int(good), int(toxic and good)))
    rows += [(5000, None, None), (5001, "", ""), (5002, "word " * 30000, "long"), (None, "idiot", "no id"), (3, rows[3][1], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = [*labels, (7777, 1, 1), (None, 0, 1), (5, None, None), (labels[2][0], 0, 0)]
    return docs, spark.createDataFrame(known, "doc_id long, quality int, toxic int"), {r[0]: r for r in labels}


def _held(key):
    return zlib.crc32(str(key).encode()) % 4 == 2


def test_quality_on_held_out(prose):
    docs, labels, truth = prose
    model = quality.learn(docs, labels)
    rows = docs.select("doc_id", quality.score(F.col("text"), model).alias("s")).collect()
    assert len(rows) == 905 and all(0 <= r.s <= 1 for r in rows)
    held = [(r.s >= quality.CUT, truth[r.doc_id][1] == 1) for r in rows if r.doc_id in truth and _held(r.doc_id)]
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.97


def test_toxicity_on_held_out(spark, prose):
    docs, labels, truth = prose
    model = spark.sparkContext.broadcast(toxicity.learn(docs, labels))
    rows = docs.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()
    assert len(rows) == 905 and all(0 <= r.s <= 1 for r in rows)
    held = [(r.s >= toxicity.CUT, truth[r.doc_id][2] == 1) for r in rows if r.doc_id in truth and _held(r.doc_id)]
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.95


def test_toxicity_line_is_placed_on_whole_texts(spark, monkeypatch):
    """Texts of thousands of words: the line sees the highest of all windows, and tells them apart at any length."""
    random = np.random.default_rng(2)
    rows = []
    for n in range(160):
        text = random.choice([f"plain{k}" for k in range(200)], int(random.choice([40, 3000]))).tolist()
        if n % 2:  # toxic words in one place, which most picked windows miss if the text is long
            at = int(random.integers(len(text) - 30))
            text[at : at + 30] = random.choice([f"vile{k}" for k in range(10)], 30).tolist()
        rows.append((n, " ".join(text), n % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    seen, line = [], toxicity._line
    monkeypatch.setattr(toxicity, "_line", lambda highest, *rest: seen.append(np.array(highest)) or line(highest, *rest))
    model = toxicity.learn(docs, labels)
    learnt = [r for r in rows if not _held(r[0])]
    assert np.allclose(seen[0], toxicity.replace(model, slope=1.0, level=0.0).highest(pa.array([r[1] for r in learnt])), atol=1e-4)
    held = [r for r in rows if _held(r[0])]
    for long in (False, True):
        some = [r for r in held if (len(r[1].split()) > 1000) == long]
        scores = model.scores(pa.array([r[1] for r in some]))
        assert len(some) > 5 and np.mean([(x >= toxicity.CUT) == (r[2] == 1) for x, r in zip(scores, some)]) >= 0.9


def test_sample_is_bounded_and_leaves_the_fold_out(prose):
    docs, labels, _ = prose
    rows = training.sample(docs, labels, "toxic", 40).collect()
    assert len({r.id for r in rows if r.label == 1}) <= 40 and not any(_held(r.id) for r in rows)


@pytest.mark.parametrize("label", [None, 0, 1])
def test_one_label_only(spark, label):
    docs = spark.createDataFrame([(0, "a b"), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([] if label is None else [(0, label, label)], "doc_id long, quality int, toxic int")
    good = docs.select(quality.score(F.col("text"), quality.learn(docs, labels)).alias("s")).collect()
    assert all((r.s >= quality.CUT) == (label != 0) for r in good)
    model = spark.sparkContext.broadcast(toxicity.learn(docs, labels))
    assert all((r.s >= toxicity.CUT) == (label == 1) for r in docs.select(toxicity.score(F.col("text"), model).alias("s")).collect())
    empty = docs.limit(0)
    assert empty.select(quality.score(F.col("text"), quality.learn(empty, labels.limit(0)))).count() == 0
