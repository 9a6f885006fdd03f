"""op2_maxscore_top_k: the essential columns of a block are traversed for many queries at once, in the narrowest exact numbers."""

import numpy as np
import pandas as pd
import pytest

from tallyline.llm import maxscore


def best(ids, values, query, own, k):
    scores = values @ query
    order = [n for n in np.lexsort((ids, -scores)) if ids[n] != own][:k]
    return ids[order].tolist(), scores[order].tolist()


def test_queries_are_searched_together():
    random = np.random.default_rng(7)
    values = np.floor(random.standard_normal((500, 20)) * 30).astype(np.int64)
    values[:, 5:12][random.random((500, 7)) < 0.97] = 0  # lists that name their rows
    ids = np.arange(500)
    block = maxscore.Postings(ids, values)
    assert 0 < len(block.columns) < 40 and block.lists[True] and block.lists[False]
    asked = values[::25]
    least = [best(ids, values, query, n, 7)[1][-1] for n, query in zip(ids[::25], asked)]
    found = list(block.searches(asked, ids[::25], least, 7))
    assert [(i.tolist(), s.tolist()) for i, s in found] == [best(ids, values, q, n, 7) for n, q in zip(ids[::25], asked)]


@pytest.mark.parametrize(("largest", "kind"), [(64, np.float32), (1 << 20, np.float64), (1 << 30, np.int64)])
def test_sums_stay_exact(monkeypatch, largest, kind):
    kinds = []
    make = maxscore.Postings
    monkeypatch.setattr(maxscore, "Postings", lambda ids, values: kinds.append(values.dtype) or make(ids, values))
    random = np.random.default_rng(1)
    values, ids = random.integers(-largest, largest + 1, (300, 5)), np.arange(300)
    values[0, 0] = largest
    rows = pd.DataFrame({"id": ids, "vector": list(values)})
    found = maxscore._search(4, 64)(rows.iloc[:150:10], rows)
    assert set(kinds) == {np.dtype(kind)}
    for n in ids[:150:10]:
        mine = found[found.query_id == n]
        assert (mine.vec_id.tolist(), mine.score.tolist()) == best(ids, values, values[n], n, 4)
