"""The nearest decoder: all folds and numbers of neighbours by one look at the pairs, the same as brute force."""

import numpy as np
import pytest

from tracekit.operators import models as M


def rows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, many of them copies or of zeros, and labels."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(n, 6)).astype(np.float32)
    x[: n // 3] = x[0]
    x[n // 3 : n // 3 + 5] = 0
    x[n // 2 : n // 2 + 9] *= np.float32(2.0)
    return x, draw.integers(0, 4, n)


def told(s: np.ndarray, y: np.ndarray, k: int) -> int:
    best = y[np.lexsort((np.arange(s.size), -s))][:k].tolist()
    return min(set(best), key=lambda a: (-best.count(a), a))


def cosines(x: np.ndarray) -> np.ndarray:
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1), 1e-300)[:, None]
    return np.round(unit @ unit.T, 9)


@pytest.mark.parametrize("blocks", [(1, 1), (3, 2)])
def test_all_folds_at_once(spark, monkeypatch, blocks):
    x, y = rows(600)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(len(y))], "id long, y int, x array<float>").repartition(5)
    dealt = M.folds(df, "id", "y", 3)
    fold = {r.id: r.fold for r in dealt.collect()}
    f = np.array([fold[i] for i in range(len(y))])
    ran, look = [], M._most_alike

    def looked(ask, known, most, asked, trained, width):
        ran.append(most)
        return look(ask, known, most, asked if blocks[0] == 1 else 1000 * blocks[0], trained if blocks[1] == 1 else 4000 * blocks[1], width)

    monkeypatch.setattr(M, "_most_alike", looked)
    values = [1, 3, 9]
    got = {(r.neighbours, r.fold): (r.n, r.accuracy, r.error) for r in M.nearest_folds(dealt, "id", "y", "x", values).collect()}
    s = cosines(x)
    for k in values:
        p = np.array([told(s[i, f != f[i]], y[f != f[i]], k) for i in range(len(y))])
        for g in range(3):
            off = np.abs(p - y)[f == g]
            assert got[k, g] == (off.size, (off == 0).mean(), np.median(off))
    best = {r.neighbours: r.best for r in M.grid_search(df, "id", "y", "x", values, 3, "nearest", "neighbours").collect()}
    assert best == {float(k): max(got[k, g][1] for g in range(3)) for k in values}
    assert ran == [9, 9]  # one look for each call


def test_nearest_to_other_rows(spark):
    x, y = rows(200)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(len(y))], "id long, y int, x array<float>")
    got = {r.id: r.predicted for r in M.nearest(df.where("id % 4 > 0"), df.where("id % 4 = 0"), "id", "y", "x", 5).collect()}
    s, train = cosines(x), np.arange(200) % 4 > 0
    assert got == {i: told(s[i, train], y[train], 5) for i in range(0, 200, 4)}


def test_few_training_rows(spark):
    df = spark.createDataFrame([(i, i % 2, [1.0, float(i)]) for i in range(5)], "id long, y int, x array<double>")
    assert {r.id: r.predicted for r in M.nearest(df.where("id < 2"), df.where("id >= 2"), "id", "y", "x", 5).collect()} == {2: 0, 3: 0, 4: 0}


def test_copies_beyond_those_that_count_stay_out_of_tasks(spark):
    df = spark.range(3000).selectExpr("id as i", "0 as f", "id % 3 as y", "array(1d, 2d) as x")
    ask = spark.range(1).selectExpr("id as i", "1 as f", "0L as y", "1L as n", "array(2d, 1d) as x")
    out = M._most_alike(ask, df, 5, 1, 3000, 2).collect()
    assert [s.i for s in out[0].best] == [0, 1, 2, 3, 4]
