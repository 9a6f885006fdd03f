"""Document quality by Bradley-Terry ranking: utilities learnt from preference pairs.

A document's utility is linear in features of its whole text. For each pair of
a preferred and a rejected document the probability of the preference is the
logistic function of the difference of their utilities. All pairs of labelled
documents count, through sums over bins of equal utility. The threshold is the
quantile of utilities that the labels' share of rejected documents marks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.arrow import buffers, chunks, words
from tallyline.llm.training import held_out, learnable
from tallyline.session import stored

BINS = 512
CUT = 0.7
_CHUNK = 4 << 20
# Byte classes that are counted; every class is a byte set.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\x0b\x0c\r",
    "line": b"\n",
    "stop": b".,;:'\"-()?",
    "shout": b"!",
    "bar": b"|",
    "mark": b"#$%&*+/<=>@[\\]^_`{}~",
    "other": bytes(range(0x80, 0x100)),
}
_CLASS = np.zeros(256, np.uint8)
for _n, _members in enumerate(_CLASSES.values(), 1):
    _CLASS[list(_members)] = _n
FEATURES = 2 * len(_CLASSES) + 7


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of a column over each text's range."""
    total = np.concatenate([[0.0], np.cumsum(flags, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def features(texts: pa.Array) -> np.ndarray:
    """Shares of byte classes, word lengths and repetition of whole texts; a row of zeros for an empty one."""
    raw, at = buffers(texts)
    size = np.maximum(np.diff(at), 1)
    kinds = len(_CLASSES) + 1
    kind = np.repeat(np.arange(len(texts)) * kinds, np.diff(at)) + _CLASS[raw]
    shares = np.bincount(kind, minlength=len(texts) * kinds).reshape(-1, kinds)[:, 1:] / size[:, None]
    ids, starts, vocabulary = words(texts)
    count = np.diff(starts)
    least = np.maximum(count, 1)
    owner = np.repeat(np.arange(len(texts)), count)
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])
    seen = np.sort(owner * np.int64(len(vocabulary) + 1) + ids)
    new = np.ones(len(seen), bool)
    new[1:] = seen[1:] != seen[:-1]
    distinct = np.bincount(seen[new] // (len(vocabulary) + 1), minlength=len(texts))
    lengths = pc.utf8_length(vocabulary).to_numpy()[ids]
    extra = [
        distinct / least,
        # distinct words against what is usual for so many words
        np.log1p(distinct) / np.log1p(least),
        _per_text(same, starts) / least,
        _per_text(lengths, starts) / least / 10,
        _per_text(lengths == 1, starts) / least,
        np.log1p(count) / 10,
        (count == 0).astype(np.float64),
    ]
    out = np.concatenate([shares, np.sqrt(shares), np.stack(extra, axis=1)], axis=1)
    out[np.diff(at) == 0] = 0
    return out


@dataclass(frozen=True)
class Model:
    """Utility weights, and the line that takes utilities to scores with the threshold at ``CUT``."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def utilities(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.centre) / self.scale) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        line = self.slope * (self.utilities(rows) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(line, -40, 40)))


def _one_label(good: bool) -> Model:
    """With one class only there are no pairs: all utilities are equal and every score says what the labels say."""
    return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), -1.0 if good else 1.0, 1.0)


def _steady(numbers: np.ndarray) -> np.ndarray:
    """Nine digits, so that the order in which tasks' sums arrive does not show."""
    return np.array([float(f"{x:.9g}") for x in numbers])


def _added(rows: DataFrame, read: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``read(labels, features)`` over all rows; a task sends one vector of ``size`` numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                values = batch.column("row").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                total += read(batch.column("label").to_numpy(zero_copy_only=False), values.reshape(-1, FEATURES))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], ["at", "value"])

    found = rows.select("label", "row").mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    found, out = found.toArrow(), np.zeros(size)
    out[found.column("at").to_numpy()] = found.column("value").to_numpy()
    return out


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each label: how many rows, the sums of their features, and of the features' products."""

    def read(labels: np.ndarray, values: np.ndarray) -> np.ndarray:
        parts = [values[labels == n] for n in (0, 1)]
        return np.concatenate([[len(x), *x.sum(axis=0), *(x.T @ x).ravel()] for x in parts])

    found = _added(rows, read, 2 * (1 + FEATURES + FEATURES**2)).reshape(2, -1)
    return found[:, 0], found[:, 1 : 1 + FEATURES], found[:, 1 + FEATURES :].reshape(2, FEATURES, FEATURES)


def _binned(rows: DataFrame, model: Model, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each label and bin of utilities within ``reach``: how many rows, the sums of utilities and of scaled features."""

    def read(labels: np.ndarray, values: np.ndarray) -> np.ndarray:
        scaled = (values - model.centre) / model.scale
        utility = scaled @ model.weights
        place = np.clip((utility / reach + 1) * (BINS / 2), 0, BINS - 1).astype(np.int64) + labels * BINS
        each = np.column_stack([np.ones(len(utility)), utility, scaled])
        width = each.shape[1]
        return np.bincount((place[:, None] * width + np.arange(width)).ravel(), each.ravel(), minlength=2 * BINS * width)

    found = _added(rows, read, 2 * BINS * (2 + FEATURES)).reshape(2, BINS, -1)
    return found[:, :, 0], found[:, :, 1], found[:, :, 2:]


def _preferences(
    counts: np.ndarray, utility: np.ndarray, sums: np.ndarray, products: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of all pairs of a preferred and a rejected row, its gradient, and about its second derivatives.

    Rows of one bin count with their mean utility. Their spread around the bin's
    mean features is taken to be that of the whole label, for the second derivatives only.
    """
    pairs = counts[0].sum() * counts[1].sum()
    some = [counts[n] > 0 for n in (0, 1)]
    (bad, good), (x_bad, x_good) = [counts[n][some[n]] for n in (0, 1)], [sums[n][some[n]] for n in (0, 1)]
    mean = [utility[n][some[n]] / counts[n][some[n]] for n in (0, 1)]
    apart = mean[1][:, None] - mean[0][None, :]
    both = good[:, None] * bad[None, :]
    wrong = 1 / (1 + np.exp(np.clip(apart, -40, 40)))
    loss = (both * np.logaddexp(0, -apart)).sum() / pairs
    slope = ((wrong @ bad) @ x_good - (wrong.T @ good) @ x_bad) / pairs
    bend = wrong * (1 - wrong)
    curve = np.zeros((FEATURES, FEATURES))
    for n, count, x, weight in ((1, good, x_good, bend @ bad), (0, bad, x_bad, bend.T @ good)):
        centres = x / count[:, None]
        spread = (products[n] - centres.T @ x) / count.sum()
        curve += (centres * (weight * count)[:, None]).T @ centres + (weight * count).sum() * spread
    cross = x_good.T @ bend @ x_bad
    return float(loss), -slope, (curve - cross - cross.T) / pairs


def fit(rows: DataFrame, share: float, ridge: float = 1e-3, rounds: int = 30) -> Model:
    """Learns from all pairs of a preferred and a rejected row: columns ``label`` (0 or 1) and ``row`` (features).

    Each round is one pass over the rows. Tasks add up the rows by bins of their
    utility, and bins take the place of rows in the sum over all pairs, so that no
    pair is listed. ``share`` is the share of rejected rows in the labels.
    """
    number, total, products = _moments(rows)
    if not number.all():
        return _one_label(bool(number[1]) or not number[0])
    centre = _steady(total.sum(axis=0) / number.sum())
    # sums of products around the centre
    products = products - np.einsum("ni,j->nij", total, centre) - np.einsum("i,nj->nij", centre, total)
    products += number[:, None, None] * np.outer(centre, centre)
    variance = np.einsum("nii->i", products) / number.sum()
    scale = _steady(np.sqrt(np.maximum(variance, 0)) + 1e-6)
    products = products / np.outer(scale, scale)
    spread = products.sum(axis=0) / number.sum()

    def at(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        reach = 6 * np.sqrt(max(weights @ spread @ weights, 0)) + 1e-3
        loss, slope, curve = _preferences(*_binned(rows, Model(centre, scale, weights, 0.0, 1.0), reach), products)
        return loss + ridge / 2 * weights @ weights, slope + ridge * weights, curve + ridge * np.eye(FEATURES)

    weights = np.zeros(FEATURES)
    loss, slope, curve = at(weights)
    step = -np.linalg.solve(curve, slope)
    for _ in range(rounds):  # Newton steps, halved while they lead too far
        if -slope @ step < 1e-4 * loss:  # twice what is left to gain
            break
        ahead = at(weights + step)
        if ahead[0] > loss + 1e-12:
            step = step / 2
            continue
        weights = weights + step
        loss, slope, curve = ahead
        step = -np.linalg.solve(curve, slope)
    model = Model(centre, scale, np.round(weights, 4), 0.0, 1.0)
    return replace(model, threshold=float(_steady([_threshold(rows, model, number, share)])[0]))


def _threshold(rows: DataFrame, model: Model, number: np.ndarray, share: float) -> float:
    """The quantile of all labelled rows; each class weighs as much as it does in the labels.

    A gap between the classes belongs to neither: there the middle of it is taken.
    """

    @F.arrow_udf("double")
    def utility(found: pa.Array) -> pa.Array:
        values = found.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.array(model.utilities(values.reshape(-1, FEATURES)), pa.float64())

    known = stored(rows.select("label", utility("row").alias("utility")))
    ends = {r.label: r for r in known.groupBy("label").agg(F.min("utility").alias("low"), F.max("utility").alias("high")).collect()}
    if ends[0].high < ends[1].low:
        return (ends[0].high + ends[1].low) / 2
    least, most = min(r.low for r in ends.values()), max(r.high for r in ends.values())
    weight = np.array([share / number[0], (1 - share) / number[1]])
    below, width = 0.0, (most - least) / BINS
    for _ in range(4):  # each round looks into the bin in which the one before has found the quantile
        if width <= 0:
            break
        place = F.floor((F.col("utility") - least) / width).cast("int")
        inside = known.where(F.col("utility").between(least, least + BINS * width))
        counted = inside.groupBy(F.least(place, F.lit(BINS - 1)).alias("place"), "label").count().collect()
        total = np.zeros(BINS)
        for r in counted:
            total[r.place] += weight[r.label] * r["count"]
        reached = below + np.cumsum(total)
        found = min(int(np.searchsorted(reached, share - 1e-12)), BINS - 1)
        below = reached[found] - total[found]
        least, width = least + found * width, width / BINS
    edge = least + BINS * width
    low = F.max(F.when(F.col("utility") <= edge, F.col("utility"))).alias("low")
    sides = known.agg(low, F.min(F.when(F.col("utility") > edge, F.col("utility"))).alias("high")).first()
    low, high = sides.low if sides.low is not None else edge, sides.high if sides.high is not None else edge
    return (low + high) / 2


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on all learnable texts that have a label; the driver gets sums only.

    Features are read before the join, so that no text is shuffled.
    """
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(id_col).alias("id"), _features()(F.col(text_col)).alias("row"))
    rows = stored(rows.join(learnable(labels, label, id_col), "id").select("label", "row"))
    known = labels.where(~held_out(id_col) & F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return fit(rows, 1 - known if known is not None else 0.0)


def _features():
    @F.arrow_udf("array<float>")
    def rows(texts: pa.Array) -> pa.Array:
        found = [row for part in chunks(texts, _CHUNK) for row in features(part).tolist()]
        return pa.array(found, pa.list_(pa.float32()))

    return rows


def score(text: Column, model: Model) -> Column:
    """Score of a whole text, 0 to 1; ``CUT`` is the threshold. Null counts as empty; an empty text has a score too."""

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [model.scores(features(part)) for part in chunks(texts, _CHUNK)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return scores(text)
