"""Eigenvectors of the similarity of vectors, without pairs, against those of the pairs."""

import numpy as np
import pytest

from tracekit.operators import models as M
from tracekit.operators import spectral


def test_without_pairs(spark):
    draw = np.random.default_rng(4)
    middles = draw.normal(0, 1, (3, 6))
    x = (np.repeat(middles, 12, axis=0) + draw.normal(0, 0.2, (36, 6))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(99, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    cosine = unit @ unit.T
    upper = cosine[np.triu_indices(36, 1)]
    w = (cosine + 1) / 2 if upper.min() < 0 else cosine.copy()
    np.fill_diagonal(w, 0)
    d = w.sum(axis=1)
    size, basis = np.linalg.eigh(w / np.sqrt(d[:, None] * d))
    ends = M.cosine_bounds(df, "id", "v").first()
    assert tuple(ends) == pytest.approx((upper.min(), upper.max()))
    vectors, values = spectral.cosine_eigenvectors(df, "id", "v", ends[0], ends[1], 2, rounds=8)
    got = {r.id: r.x for r in vectors.collect()}
    assert sorted(got) == list(range(36)) and values == pytest.approx(size[::-1][:2], abs=1e-3)
    for c in range(2):
        assert abs(np.array([got[i][c] for i in range(36)]) @ basis[:, -1 - c]) == pytest.approx(1, abs=1e-2)
