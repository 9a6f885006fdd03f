"""Helpers for Arrow columns of texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def chunks(texts: pa.Array, most_bytes: int) -> Iterator[pa.Array]:
    """Consecutive slices of at most so many bytes; a longer text is a slice of its own. Null becomes empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text starts (one more entry than texts)."""
    texts = pa.concat_arrays([texts])
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_SEPARATORS = [0x20, *range(0x09, 0x0E)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER[_SEPARATORS] = 0x20
# the same with every other ASCII character that is no letter or digit as a separator
PLAIN = LOWER.copy()
PLAIN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def words(texts: pa.Array, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between the separators x20 and x09-x0D, after lower-casing A-Z.

    ``table`` takes ASCII bytes to what they count as. Returns the words as numbers, where each text's words start (one more entry
    than texts), and the distinct words that the numbers stand for.
    """
    raw, at = buffers(texts)
    plain = pa.py_buffer(table[raw])
    texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at), plain).cast(pa.string())
    lists = pc.ascii_split_whitespace(texts)
    at = lists.offsets.to_numpy().astype(np.int64)
    found = lists.flatten().dictionary_encode()
    ids, vocabulary = found.indices.to_numpy(), found.dictionary
    empty = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py()
    at -= at[0]
    if empty >= 0:
        real = ids != empty
        at = np.concatenate([[0], np.cumsum(real)])[at]
        ids = ids[real]
    return ids, at, vocabulary
