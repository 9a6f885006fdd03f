"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

# Between a character that is no white space and a single space before another
# such character, the split pattern always ends one match and starts the next:
# only the start of a match may be a space, and no look-ahead reaches across.
_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
PIECE_CHARS = 1 << 16


@lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file, read once in each Python worker."""
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """Cuts a long text where the split pattern cannot match across.

    A piece ends at the first safe boundary after ``most`` characters; a run
    without any stays whole, so joining the pieces' tokens gives the text's.
    """
    out, start = [], 0
    while len(text) - start > most and (cut := _BOUNDARY.search(text, start + most)):
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def encode(text: Column, ranks: str, pattern: str, most: int = PIECE_CHARS) -> Column:
    """Token ids as little-endian unsigned 32-bit integers in one binary value.

    Null and empty texts give an empty value. Text that looks like a special
    token is ordinary text.
    """

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        encoder = encoding(ranks, pattern)

        def one(value: str) -> bytes:
            found = [encoder.encode_to_numpy(p, disallowed_special=()) for p in pieces(value, most)]
            return np.concatenate(found).astype("<u4").tobytes()

        return pa.array([one(x) if (x := value.as_py()) else b"" for value in texts], pa.binary())

    return ids(text)


def decode(tokens: Column, ranks: str, pattern: str) -> Column:
    """The bytes that ids written by ``encode`` stand for; a cut inside a character stays as it is. Null gives empty."""

    @F.arrow_udf("binary")
    def raw(values: pa.Array) -> pa.Array:
        encoder = encoding(ranks, pattern)
        numbers = (np.frombuffer(value.as_py() or b"", "<u4").tolist() for value in values)
        return pa.array([encoder.decode_bytes(x) for x in numbers], pa.binary())

    return raw(tokens)


def round_trip(text: Column, ranks: str, pattern: str, most: int = PIECE_CHARS) -> Column:
    """Struct of ``tokens`` (as ``encode``) and ``raw`` (their decoded bytes) from one Python step."""

    @F.arrow_udf("struct<tokens: binary, raw: binary>")
    def both(texts: pa.Array) -> pa.Array:
        encoder = encoding(ranks, pattern)
        tokens, raw = [], []
        for value in texts:
            found = [encoder.encode_to_numpy(p, disallowed_special=()) for p in pieces(value.as_py() or "", most)]
            ids = np.concatenate(found).astype("<u4")
            tokens.append(ids.tobytes())
            raw.append(encoder.decode_bytes(ids.tolist()))
        return pa.StructArray.from_arrays([pa.array(tokens, pa.binary()), pa.array(raw, pa.binary())], ["tokens", "raw"])

    return both(text)
