"""Tiles of the exact search against whole sorts."""

import numpy as np
import pandas as pd
import pytest

from loftline.operators import retrieval


@pytest.mark.parametrize("k", [1, 3, 7, 50])
@pytest.mark.parametrize("negatives", [True, False])
def test_tiles_equal_a_whole_sort(k, negatives, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 4)
    rng = np.random.default_rng(k)
    refs = rng.integers(-2, 3, (40, 3)).astype(float)  # many equal directions
    refs[refs.any(1) == 0] = 1.0
    asked = rng.integers(-2, 3, (11, 3)).astype(float)
    asked[asked.any(1) == 0] = 1.0
    ids = rng.permutation(40) + 100
    block = pd.DataFrame({"query_id": np.arange(11), "vector": list(asked)})
    found = pd.concat(retrieval._scores(block, k, negatives)([pd.DataFrame({"ref_id": ids, "vector": list(refs)})]))
    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + retrieval.vectors.EPSILON)
    sim = np.round(unit(asked) @ unit(refs).T, retrieval.DIGITS)
    sim = sim if negatives else np.maximum(sim, 0)
    for q in range(11):
        want = sorted(zip(-sim[q], ids, strict=True))[:k]
        got = found[found.query_id == q]
        assert list(got.ref_id) == [r for _, r in want] and np.allclose(got.score, [-s for s, _ in want])
