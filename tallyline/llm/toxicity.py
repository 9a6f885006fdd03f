"""Toxicity of whole texts: a bidirectional recurrent network over all overlapping windows of words."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.arrow import PLAIN, chunks, words
from tallyline.llm.gru import Network, train
from tallyline.llm.training import sample
from tallyline.session import stored

PER_CLASS = 1500  # texts of each label that are learnt from
WINDOWS = 32  # windows of each of them, evenly spread over the text
LENGTH, STRIDE = 32, 16
VOCABULARY = 20_000
LEAST_TEXTS = 5  # texts of the sample that a word of the vocabulary is in
CUT = 0.3
_CHUNK = 4 << 20


def windows(ids: np.ndarray, at: np.ndarray, length: int = LENGTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts whose word numbers (from 0) are given in a row: numbers from 1, 0 for no word.

    A window starts at every ``stride``-th word until one reaches the text's end;
    a text without words has one window without words. Returns the windows and
    the number of windows of each text.
    """
    count = np.diff(at)
    each = np.maximum(1, -(-(count - length) // stride) + 1)
    text = np.repeat(np.arange(len(count)), each)
    number = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    place = (at[:-1][text] + number * stride)[:, None] + np.arange(length)
    inside = place < at[1:][text][:, None]
    padded = np.concatenate([ids.astype(np.int32) + 1, np.zeros(1, np.int32)])
    return np.where(inside, padded[np.minimum(place, len(ids))], 0), each


@dataclass(frozen=True)
class Model:
    """The network, and the line that takes a text's highest logit to its score."""

    network: Network
    slope: float
    level: float

    def highest(self, texts: pa.Array) -> np.ndarray:
        """Highest logit of all windows of each text."""
        ids, at, vocabulary = words(texts, PLAIN)
        rows, each = windows(ids, at)
        logits = self.network.logits(self.network.inputs(vocabulary)[0], rows)
        return np.maximum.reduceat(logits, np.cumsum(each) - each)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.highest(texts) + self.level, -40, 40)))


def _spread(most: int):
    """At most ``most`` windows of a text, evenly spread, each as its words joined by a space."""

    @F.arrow_udf("array<string>")
    def some(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            ids, at, vocabulary = words(pa.array([text.as_py() or ""], pa.string()), PLAIN)
            rows, _ = windows(ids, at)
            picked = np.unique(np.linspace(0, len(rows) - 1, most).astype(int)) if len(rows) > most else range(len(rows))
            names = np.array(["", *vocabulary.to_pylist()], object)
            out.append([" ".join(names[row[row > 0]]) for row in rows[picked]])
        return pa.array(out, pa.list_(pa.string()))

    return some


def fit(texts: pa.Array, labels: np.ndarray, steps: int = 150, batch: int = 512, seed: int = 3) -> Model:
    """Learns from the windows of labelled texts; ``texts`` holds a list of them for each.

    A toxic text need not be toxic in every window. First all its windows count;
    then only the windows that score above what clean texts reach (if there are any).
    One text in five is kept aside, for ``learn`` to place the score's ``CUT``; until
    then the line leaves logits as they are. With one label only, every score says
    what the labels say.
    """
    if not (labels == 1).any() or not (labels == 0).any():
        side = 5.0 if len(labels) and labels[0] == 1 else -5.0
        return Model(Network.fresh(pa.array([], pa.string()), np.zeros((0, 2)), seed), 0.0, side)
    each = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), each)
    ids, at, vocabulary = words(texts.flatten().cast(pa.string()))
    rows = np.zeros((len(owner), LENGTH), np.int32)
    width = np.diff(at)
    rows[np.arange(LENGTH) < width[:, None]] = ids + 1
    aside = _aside(len(texts))
    learnt = ~aside[owner]
    vocabulary_size = len(vocabulary)
    toxic, clean = np.zeros((2, vocabulary_size + 1), np.int64)
    for text, (stop, own) in enumerate(zip(np.cumsum(each), each)):  # a text at a time, as all together take much memory
        if not aside[text]:
            (toxic if labels[text] == 1 else clean)[np.unique(rows[stop - own : stop])] += 1
    toxic, clean = toxic[1:], clean[1:]
    common = np.argsort(-(toxic + clean), kind="stable")[:VOCABULARY]
    common = common[(toxic + clean)[common] >= LEAST_TEXTS]
    # two hints for each word: the log odds of the texts it is in, smoothed, and how far they are from chance
    share, both = (labels[~aside] == 1).mean(), (toxic + clean)[common]
    odds = np.log((toxic[common] + 5 * share) / (clean[common] + 5 * (1 - share)) * (1 - share) / share)
    chance = (toxic[common] - both * share) / np.sqrt(both * share * (1 - share) + 1)
    hints = np.stack([odds / 4, np.clip(chance, -10, 10) / 5], axis=1)
    network = Network.fresh(vocabulary.take(pa.array(common)), hints.astype(np.float32), seed)
    target = labels[owner]
    train(network, vocabulary, rows[learnt], target[learnt], steps, batch, 0.01, seed)
    inputs = network.inputs(vocabulary)[0]
    logits = network.logits(inputs, rows)
    reached = np.quantile(logits[(target == 0) & learnt], 0.999)
    sure = (target == 0) | (logits >= reached)
    sure |= not (sure & learnt & (target == 1)).any()
    train(network, vocabulary, rows[learnt & sure], target[learnt & sure], steps, batch, 0.005, seed + 1)
    return Model(network, 1.0, 0.0)


def _aside(count: int) -> np.ndarray:
    return np.arange(count) % 5 == 4


def _line(highest: np.ndarray, labels: np.ndarray, aside: np.ndarray) -> tuple[float, float]:
    """Slope and level that put ``CUT`` where texts kept aside are told apart best, in the middle of that gap."""
    use = aside if len(set(labels[aside].tolist())) == 2 else np.ones(len(labels), bool)
    order = np.argsort(highest[use], kind="stable")
    logit, label = highest[use][order], labels[use][order]
    # errors if everything from each place on were toxic; a clean text called toxic counts twice
    wrong = np.concatenate([[0], np.cumsum(label == 1)]) + 2 * ((label == 0).sum() - np.concatenate([[0], np.cumsum(label == 0)]))
    best = np.flatnonzero(wrong == wrong.min())
    edges = np.concatenate([[logit[0] - 1], logit, [logit[-1] + 1]])
    gap = best[np.argmax(edges[best + 1] - edges[best])]
    middle = float(edges[gap] + edges[gap + 1]) / 2
    return 1.0, float(np.log(CUT / (1 - CUT)) - middle)


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, most_windows: int = WINDOWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """Fits on at most ``per_class`` texts of each label and ``most_windows`` windows of each: a bound on what the task that trains gets.

    The line is placed on the highest of all windows of these texts, which is what texts are judged by.
    """
    chosen = sample(docs, labels, label, per_class, id_col, text_col)
    chosen = stored(chosen.select("id", "label", "text", _spread(most_windows)(F.col("text")).alias("windows")))
    order = "id", "windows", "text"
    ordered = chosen.coalesce(1).sortWithinPartitions(*order).select("label", "windows")
    model = pickle.loads(ordered.mapInArrow(_fitted, "model binary").first()["model"])
    if model.slope == 0:
        return model
    whole = _each(docs.sparkSession.sparkContext.broadcast(model), Model.highest)
    found = chosen.select(*order, "label", whole(F.col("text")).alias("highest")).orderBy(*order).select("label", "highest").toArrow()
    labels, highest = (found.column(name).to_numpy() for name in ("label", "highest"))
    return replace(model, **dict(zip(("slope", "level"), _line(highest, labels, _aside(len(labels))))))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (label, windows) of one task: the driver gets no texts and does not train."""
    found = pa.Table.from_batches(batches, pa.schema([("label", pa.int32()), ("windows", pa.list_(pa.string()))]))
    model = fit(found.column("windows").combine_chunks(), found.column("label").to_numpy())
    yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})


def _each(model: Broadcast, read: Callable[[Model, pa.Array], np.ndarray]):
    """A number of the model for each whole text."""

    @F.arrow_udf("double")
    def numbers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [read(model.value, part) for part in chunks(texts, _CHUNK)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return numbers


def score(text: Column, model: Broadcast) -> Column:
    """Score of a whole text, 0 to 1: its highest window. Null counts as empty; an empty text has one empty window."""
    return _each(model, Model.scores)(text)
