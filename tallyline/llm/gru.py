"""A bidirectional gated recurrent network with attention pooling, in numpy.

Each word comes in as its own vector (for words of the vocabulary; others share
one) next to the mean vector of its character trigrams. Both directions read a
window of words; attention over all positions pools their states into one logit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyline.llm.arrow import buffers

WORD, CHAR, HIDDEN, BUCKETS = 2, 8, 8, 1 << 12
DECAY = 0.1
HIDE = 0.3  # share of words that a training batch sees without their own vector
BLANK, UNKNOWN, KNOWN = 0, 1, 2  # rows of the word vectors: no word, words outside the vocabulary, the first known
_SLICE = 1 << 11
_HALVES = np.repeat(np.array([0.5, 1], np.float32), [2 * HIDDEN, HIDDEN])


def trigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams of every word with its ends marked, and where each word's start."""
    raw, at = buffers(pc.binary_join_element_wise(pa.scalar("\x01"), words, pa.scalar("\x02\x02"), pa.scalar("")))
    code = raw.astype(np.uint32)
    mixed = (code[:-2] * np.uint32(65599 * 65599 % (1 << 32)) + code[1:-1] * np.uint32(65599) + code[2:]) if len(code) > 2 else code[:0]
    mixed = (mixed * np.uint32(2654435769)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    count = np.diff(at) - 2
    starts = np.concatenate([[0], np.cumsum(count)])
    inside = np.ones(len(mixed), bool)
    ends = at[1:-1]  # a trigram that starts in the last two bytes of a word would reach into the next
    inside[ends - 1] = inside[ends - 2] = False
    return mixed[inside].astype(np.int64), starts


@dataclass
class Network:
    """Weights by name, and the vocabulary whose words have vectors of their own."""

    vocabulary: pa.Array
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, vocabulary: pa.Array, hints: np.ndarray, seed: int) -> Network:
        """Random weights; a word's vector is its row of hints and is not trained."""
        random = np.random.default_rng(seed)
        normal = lambda *shape: (random.standard_normal(shape) * 0.3).astype(np.float32)
        vectors = np.zeros((len(vocabulary) + KNOWN, WORD), np.float32)
        vectors[KNOWN:] = hints
        return cls(vocabulary, {
            "word": vectors,
            "char": normal(BUCKETS, CHAR) * 0.1,
            "input": normal(2, WORD + CHAR, 3 * HIDDEN),
            "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "state": normal(2, HIDDEN, 3 * HIDDEN),
            "attend": normal(2 * HIDDEN),
            "out": normal(2 * HIDDEN),
            "level": np.zeros(1, np.float32),
        })

    def inputs(self, words: pa.Array, hide: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """A row of inputs for no word, then one for each of the words, and what ``gradients`` needs to go back."""
        place = pc.index_in(words, value_set=self.vocabulary)
        rows = np.concatenate([[BLANK], pc.fill_null(pc.add(place, KNOWN), UNKNOWN).to_numpy(zero_copy_only=False)])
        if hide is not None:
            rows[1:][hide] = UNKNOWN
        buckets, at = trigrams(words)
        means = np.zeros((len(rows), CHAR), np.float32)
        if len(words):
            means[1:] = np.add.reduceat(self.weights["char"][buckets], at[:-1], axis=0) / np.diff(at)[:, None]
        vectors = self.weights["word"][rows]
        return np.concatenate([vectors, means], axis=1), (rows, buckets, at)

    def _gates(self, inputs: np.ndarray, d: int) -> np.ndarray:
        """What a row of inputs adds to the gates. A gate is (1 + tanh) / 2, so their halves are kept."""
        return (inputs @ self.weights["input"][d] + self.weights["bias"][d]) * _HALVES

    def logits(self, inputs: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """One logit for each window, a row of numbers of inputs."""
        out = np.zeros(len(windows), np.float32)
        gates = [self._gates(inputs, d) for d in (0, 1)]  # once for each distinct word
        for at in range(0, len(windows), _SLICE):
            part = windows[at : at + _SLICE]
            states = np.empty((part.shape[1], 2 * HIDDEN, len(part)), np.float32)
            for d in (0, 1):
                self._read(np.ascontiguousarray(gates[d][part].transpose(1, 2, 0)), d, states)
            out[at : at + _SLICE] = self._pool(states)[0]
        return out

    def _read(self, gates: np.ndarray, d: int, states: np.ndarray, trail: list | None = None) -> None:
        """Runs one direction over (position, gate, window); fills its half of the states."""
        matrix = np.ascontiguousarray((self.weights["state"][d] * _HALVES).T)
        state = np.zeros((HIDDEN, gates.shape[2]), np.float32)
        for t in range(len(gates)) if d == 0 else range(len(gates) - 1, -1, -1):
            side = matrix @ state
            both = gates[t, : 2 * HIDDEN] + side[: 2 * HIDDEN]
            np.tanh(both, out=both)
            both += 1
            both *= 0.5
            keep, reset = both[:HIDDEN], both[HIDDEN:]
            new = reset * side[2 * HIDDEN :]
            new += gates[t, 2 * HIDDEN :]
            np.tanh(new, out=new)
            before, state = state, new + keep * (state - new)
            states[t, d * HIDDEN : (d + 1) * HIDDEN] = state
            if trail is not None:
                trail.append((t, before, keep, reset, new, side[2 * HIDDEN :]))

    def _pool(self, states: np.ndarray) -> tuple[np.ndarray, ...]:
        tilt = np.einsum("h,thb->tb", self.weights["attend"], states)
        tilt = np.exp(tilt - tilt.max(axis=0))
        share = tilt / tilt.sum(axis=0)
        pooled = np.einsum("tb,thb->hb", share, states)
        return self.weights["out"] @ pooled + self.weights["level"][0], share, pooled

    def gradients(self, words: pa.Array, windows: np.ndarray, labels: np.ndarray, hide: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss of one batch, by backpropagation through time.

        Words marked in ``hide`` come in without their own vector, as if unknown.
        """
        w, (size, length) = self.weights, windows.shape
        inputs, (rows, buckets, at) = self.inputs(words, hide)
        out = {}
        states, trails = np.empty((length, 2 * HIDDEN, size), np.float32), ([], [])
        for d in (0, 1):
            self._read(np.ascontiguousarray(self._gates(inputs, d)[windows].transpose(1, 2, 0)), d, states, trails[d])
        logit, share, pooled = self._pool(states)
        wrong = ((0.5 + 0.5 * np.tanh(logit / 2) - labels) / size).astype(np.float32)
        out["out"], out["level"] = pooled @ wrong, wrong.sum(keepdims=True)
        back = w["out"][:, None] * wrong
        towards = np.einsum("thb,hb->tb", states, back)
        towards = share * (towards - (share * towards).sum(axis=0))
        out["attend"] = np.einsum("tb,thb->h", towards, states)
        wanted = share[:, None] * back + towards[:, None] * w["attend"][:, None]
        owner = windows.T.ravel()
        order = np.argsort(owner, kind="stable")
        met, starts = np.unique(owner[order], return_index=True)
        by_word = np.zeros_like(inputs)
        out["state"], out["input"], out["bias"] = (np.zeros_like(w[name]) for name in ("state", "input", "bias"))
        for d in (0, 1):
            carry = np.zeros((HIDDEN, size), np.float32)
            slopes = np.empty((length, 3 * HIDDEN, size), np.float32)
            for t, before, keep, reset, new, side in reversed(trails[d]):
                carry = carry + wanted[t, d * HIDDEN : (d + 1) * HIDDEN]
                fresh = carry * (1 - keep) * (1 - new * new)
                slope = slopes[t]
                slope[:HIDDEN] = carry * (before - new) * keep * (1 - keep)
                slope[HIDDEN : 2 * HIDDEN] = fresh * side * reset * (1 - reset)
                slope[2 * HIDDEN :] = fresh
                inner = slope.copy()
                inner[2 * HIDDEN :] *= reset
                out["state"][d] += before @ inner.T
                carry = carry * keep + w["state"][d] @ inner
            # slopes of a word's gates add up over its places, then go on to its inputs
            flat = slopes.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)[order]
            gathered = np.add.reduceat(flat, starts, axis=0)
            out["input"][d] = inputs[met].T @ gathered
            out["bias"][d] = gathered.sum(axis=0)
            by_word[met] += gathered @ w["input"][d].T
        count = np.diff(at)
        parts = np.repeat(by_word[1:, WORD:] / count[:, None], count, axis=0)
        out["char"] = np.stack([np.bincount(buckets, parts[:, k], BUCKETS) for k in range(CHAR)], axis=1)
        return out


def train(network: Network, words: pa.Array, windows: np.ndarray, labels: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> None:
    """Adam over batches with as many windows of either label. ``windows`` count ``words`` from 1; 0 is no word."""
    random = np.random.default_rng(seed)
    sides = [np.flatnonzero(labels == n) for n in (0, 1)]
    first = {name: np.zeros_like(value) for name, value in network.weights.items()}
    second = {name: np.zeros_like(value) for name, value in network.weights.items()}
    for step in range(1, steps + 1):
        chosen = np.concatenate([random.choice(side, batch // 2) for side in sides])
        used, local = np.unique(windows[chosen], return_inverse=True)
        local = local.reshape(len(chosen), -1)
        if used[0] != 0:
            local = local + 1
        present = words.take(pa.array(used[used > 0] - 1))
        hide = random.random(len(present)) < HIDE
        found = network.gradients(present, local, labels[chosen].astype(np.float32), hide)
        for name, slope in found.items():
            first[name] += 0.1 * (slope - first[name])
            second[name] += 0.001 * (slope * slope - second[name])
            fair = np.sqrt(second[name] / (1 - 0.999**step)) + 1e-7
            pull = DECAY * network.weights[name] if name == "char" else 0
            network.weights[name] -= (rate * (first[name] / (1 - 0.9**step) / fair + pull)).astype(np.float32)
