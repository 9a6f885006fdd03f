"""What the findings of round 3 asked for."""

import numpy as np
from pyspark.sql import functions as F

from tallyline.llm import quality, training


def test_quality_learns_from_all_labelled_texts(spark, monkeypatch):
    """at most 3,000 texts of each label were learnt from."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 9 != 0).cast("int").alias("quality"))
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, *more: seen.append(rows) or fit(rows, *more))
    quality.learn(docs, labels)
    learnable = docs.where(~training.held_out("doc_id")).count()
    assert learnable > 6000 and seen[0].count() == learnable


def test_quality_fit_counts_all_pairs(spark):
    """weights and threshold against the sum over all pairs, listed."""
    random = np.random.default_rng(5)
    values = random.normal(size=(600, quality.FEATURES)).astype(np.float32)
    labels = (values[:, 0] + 0.5 * values[:, 1] + random.normal(size=600) > -1).astype(int)
    rows = spark.createDataFrame(list(zip(labels.tolist(), values.tolist())), "label int, row array<float>")
    model = quality.fit(rows, float((labels == 0).mean()), ridge=0.01)
    scaled = (values - model.centre) / model.scale
    assert np.allclose(scaled.mean(axis=0), 0, atol=1e-5) and np.allclose(scaled.std(axis=0), 1, atol=1e-4)
    apart = (scaled[labels == 1][:, None] - scaled[labels == 0][None]).reshape(-1, quality.FEATURES)
    wrong = 1 / (1 + np.exp(apart @ model.weights))
    slope = apart.T @ wrong / len(apart) - 0.01 * model.weights
    assert np.abs(slope).max() < 0.005
    utility = model.utilities(values)
    assert (utility < model.threshold).sum() in range((labels == 0).sum() - 1, (labels == 0).sum() + 2)
