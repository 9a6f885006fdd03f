"""The finding on the pipeline's driver memory, round 3."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tallyline.llm import toxicity


def test_training_counts_words_a_text_at_a_time():
    """All words of all windows were sorted at once in the driver."""
    random = np.random.default_rng(2)
    names = np.array([f"w{n}" for n in range(300)], object)
    texts = [[" ".join(random.choice(names, toxicity.LENGTH)) for _ in range(32)] for _ in range(600)]
    labels = np.arange(600) % 2
    texts = pa.array(texts, pa.list_(pa.string()))
    tracemalloc.start()
    toxicity.fit(texts, labels, steps=1, batch=32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * 600 * 32 * toxicity.LENGTH  # bytes for each word


def test_driver_does_not_train(spark, monkeypatch):
    """Training held the windows, the counts and the gradients in the driver; now one task does."""
    rows = [(n, ("bad " if n % 2 else "good ") * 40 + f"w{n}") for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n, _ in rows], "doc_id long, toxic int")
    want = toxicity.learn(docs, labels)

    def fit(*_):
        raise AssertionError("the driver trains")

    monkeypatch.setattr(toxicity, "fit", fit)
    model = toxicity.learn(docs, labels)
    assert model.level == want.level
    assert all((model.network.weights[name] == value).all() for name, value in want.network.weights.items())
