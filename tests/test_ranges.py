"""Series cut into small ranges against the plain forms, with one series that has most rows."""

import random

import numpy as np
import pytest

from tracekit.operators import alignment as A
from tracekit.operators import ranges as R
from tracekit.operators import windows as W

DRAW = random.Random(3)


@pytest.fixture(scope="module")
def series(spark):
    rows = [(e, i, DRAW.choice([DRAW.gauss(0, 1), 2.0])) for e, n in ((1, 700), (2, 1), (3, 40), (4, 9)) for i in range(n)]
    DRAW.shuffle(rows)
    return spark.createDataFrame(rows, "e int, i long, v double").repartition(5)


def told(df, *columns):
    return sorted((tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=str)


def test_places(spark, series):
    assert told(R.numbered_series(series, ["e"], ["i"]), "e", "i", "_i") == told(series.withColumn("_i", series.i), "e", "i", "_i")
    whole = R.numbered_series(series.limit(0), ["e"], ["i"])
    assert whole.count() == 0 and "_i" in whole.columns


@pytest.mark.parametrize("size", [7, 64, 1 << 18])
def test_windows(series, size):
    assert told(R.running_mean(series, ["e"], "i", "v", 4, size=size), "e", "i", "mean") == told(W.running_mean(series, ["e"], "i", "v", 4), "e", "i", "mean")
    kernel = [0.1, 0.5, 0.3, 0.1]
    assert told(R.weighted(series, ["e"], "i", "v", kernel, -1, size=size), "e", "i", "smooth") == told(W.weighted(series, ["e"], "i", "v", kernel, -1), "e", "i", "smooth")


def test_quantiles():
    x = np.array([DRAW.choice([DRAW.gauss(0, 1), float("nan"), 1.0]) for _ in range(300)])
    for before, after in ((0, 0), (5, 4), (3, 10), (400, 400)):
        got = R.quantile_of(x, before, after, 0.2)
        for k in range(x.size):
            w = x[max(0, k - before) : k + after + 1]
            w = w[~np.isnan(w)]
            assert got[k] == pytest.approx(np.quantile(w, 0.2)) if w.size else np.isnan(got[k])


def plain_baseline(rows, half, q):
    out = []
    for e in {r[0] for r in rows}:
        v = [r[2] for r in sorted(r for r in rows if r[0] == e)]
        padded = [v[0]] * half + v + [v[-1]] * half
        out += [(e, i, round(float(np.quantile(padded[i : i + 2 * half], q)), 8)) for i in range(len(v))]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [16, 1 << 18])
def test_baselines_and_scores(series, size):
    rows = [tuple(r) for r in series.collect()]
    assert told(R.rolling_baseline(series, ["e"], "i", "v", 12, 0.1, size=size), "e", "i", "baseline") == plain_baseline(rows, 6, 0.1)
    got = {(r.e, r.i): r.z for r in R.sliding_zscore(series, ["e"], "i", "v", 5, size=size).collect()}
    for e in (1, 2, 3, 4):
        v = np.array([r[2] for r in sorted(r for r in rows if r[0] == e)])
        near = [v[max(0, i - 5) : i + 5] for i in range(v.size)]
        sd = np.array([x.std() for x in near])
        usual = sd[sd > 0].mean() if (sd > 0).any() else None
        for i in range(v.size):
            s = sd[i] if sd[i] > 0 else usual
            assert got[e, i] == (pytest.approx((v[i] - np.quantile(near[i], 0.2)) / s) if s else None)


@pytest.mark.parametrize("size", [7, 1 << 18])
def test_carried(spark, size):
    rows = [(e if e else None, i, DRAW.random() if DRAW.random() < 0.05 else None, DRAW.choice("ab") if DRAW.random() < 0.3 else None) for e, n in ((1, 300), (0, 50), (3, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "e int, i long, v double, s string").repartition(4)
    assert told(R.carried(df, ["e"], ["i"], ["v", "s"], size), "e", "i", "v", "s") == told(W.carried(df, ["e"], "i", ["v", "s"]), "e", "i", "v", "s")


@pytest.mark.parametrize("how", ["backward", "forward", "nearest"])
def test_asof(spark, how):
    left = [(1, DRAW.randrange(500) / 2, n) for n in range(300)] + [(2, 5.0, 999), (9, 1.0, 1000)]
    right = [(1, float(DRAW.randrange(250)), DRAW.random()) for _ in range(40)] + [(2, 5.0, 1.5), (2, 5.0, 0.5), (3, 1.0, 1.0)]
    a, b = spark.createDataFrame(left, "e int, t double, n int"), spark.createDataFrame(right, "e int, t double, v double")
    want = told(A.asof(a, b, ["e"], "t", "v", how), "e", "t", "n", "t_found", "v")
    for size in (9, 1 << 18):
        assert told(R.asof(a, b, ["e"], "t", "v", how, size), "e", "t", "n", "t_found", "v") == want
