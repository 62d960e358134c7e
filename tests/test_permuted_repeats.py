"""Chance of a decoder: all repeats by one look at the vectors, the same as a plain re-statement."""

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracekit.operators import kernels
from tracekit.operators import models as M


def hashed(*parts: int) -> int:
    return int(md5("-".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def plain(made: kernels.Features, x: np.ndarray, y: list[int | None], repeats: int, n: int) -> dict[tuple[int, int], float]:
    """Rows are named by their place."""
    z, out = made.of(x), {}
    for k in range(repeats):
        mixed: dict = dict(zip(sorted(range(len(y)), key=lambda i: (hashed(17, k, i), i)), y, strict=True))
        fold = {}
        for one in {v for v in y if v is not None}:
            mine = sorted((i for i in mixed if mixed[i] == one), key=lambda i: (hashed(5, i), i))
            fold |= {i: at % n for at, i in enumerate(mine)}
        rows = np.array(sorted(fold))
        t, f = np.array([mixed[i] for i in rows]), np.array([fold[i] for i in rows])
        for g in range(n):
            a, sign = z[rows[f != g]], np.where(t[f != g, None] == np.arange(max(t) + 1), 1.0, -1.0)
            w = np.linalg.solve(a.T @ a + np.eye(a.shape[1]), a.T @ sign)
            out[k, g] = (np.argmax(z[rows[f == g]] @ w, axis=1) == t[f == g]).mean()
    return out


@pytest.mark.parametrize("model", ["kernel", "linear"])
@pytest.mark.parametrize("held", [128, 6])
def test_repeats_share_a_pass(spark, monkeypatch, model, held):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 5))
    y = [None if i % 40 == 7 else int(v) for i, v in enumerate(draw.integers(0, 3, 400))]
    df = spark.createDataFrame([(i, y[i], x[i].tolist()) for i in range(400)], "id long, y int, x array<double>").repartition(4)
    ran, summed = [], kernels.fold_sums

    def counted(*args):
        ran.append(1)
        return summed(*args)

    monkeypatch.setattr(kernels, "fold_sums", counted)
    monkeypatch.setattr(kernels, "HELD", held, raising=False)
    got = {(r.repeat, r.fold): r.accuracy for r in M.permuted_accuracy(df, "id", "y", "x", 5, 3, model).collect()}
    assert len(ran) == (1 if held == 128 else 3)  # five repeats of three folds
    made = kernels.radial(df, "x") if model == "kernel" else kernels.Features(None, None)
    want = plain(made, x, y, 5, 3)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_no_row_is_lost(spark, monkeypatch):
    seen, told = [], kernels.repeated
    monkeypatch.setattr(kernels, "repeated", lambda dealt, *a, **b: seen.append(dealt) or told(dealt, *a, **b), raising=False)
    rows = [(i // 3, i % 2, [float(i % 2), float(i % 7)]) for i in range(90)]
    out = M.permuted_accuracy(spark.createDataFrame(rows, "id long, y int, x array<double>"), "id", "y", "x", 4, 3, "kernel")
    assert out.count() == 12
    each = seen[0].select(F.explode(F.arrays_zip("_f", "_y")).alias("e")).groupBy("e._f", "e._y").count().collect()
    assert {(r._f, r._y): r["count"] for r in each} == {(f, y): 15 for f in range(12) for y in range(2)}
