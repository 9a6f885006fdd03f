"""op13_collocations: words are hashed, numbered and counted by block, not one at a time."""

from collections import Counter

import numpy as np
import pyarrow as pa

from tallyline.llm import collocations


def test_hashes_follow_the_bytes_of_a_word():
    words = ["a", "b", "ab", "ba", "a\0", "\0a", "", "über", "x" * 5000, "x" * 4999]
    found = collocations.hashes_of(pa.array(words))
    assert len(set(found.tolist())) == len(words)
    again = collocations.hashes_of(pa.array(["z", *words, "z"], pa.large_string()).slice(1, len(words)))
    assert found.tolist() == again.tolist()
    assert len(collocations.hashes_of(pa.array([], pa.string()))) == 0
    many = collocations.hashes_of(pa.array([f"w{n}" for n in range(100_000)]))
    assert len(np.unique(many)) == 100_000
    assert np.bincount((many & np.uint64(63)).astype(int)).max() < 2000
    assert not set(collocations._word_hashes("en", pa.array(words)).tolist()) & set(found.tolist())


def test_words_are_added_with_their_counts():
    tries = collocations._Tries(1, 4)
    for words, numbers in ((["x", "y"], [0, 1, 0, 0]), (["unused", "y", "z"], [1, 2, 2])):
        tries.add("en", pa.array(words), np.array(numbers).reshape(-1, 1))
    assert not tries.held and tries.entries == 3 and sorted(tries.number) == ["x", "y", "z"]
    total = Counter()
    for run in (row for batch in tries.spill() for row in batch.to_pylist()):
        total.update(dict(zip(run["phrases"].split("\n"), run["counts"], strict=True)))
    assert total == {"x": 3, "y": 2, "z": 2}
    assert list(tries.spill()) == []
