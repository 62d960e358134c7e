"""Kernel machines and spectra against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracekit.operators import kernels, spectral
from tracekit.operators import models as M

DRAW = np.random.default_rng(5)


@pytest.fixture(scope="module")
def rings(spark):
    """Two rings, one in the other: no line tells them apart."""
    turn, y = DRAW.uniform(0, 2 * np.pi, 240), np.arange(240) % 2
    x = np.stack([np.cos(turn), np.sin(turn)], axis=1) * (1 + 1.5 * y)[:, None] + DRAW.normal(0, 0.15, (240, 2))
    return spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(240)], "id long, label int, x array<double>"), x, y


def test_rings(rings):
    df, _, _ = rings
    told = {m: M.cross_validated(df, "id", "label", "x", 5, m).agg(F.avg("accuracy")).first()[0] for m in ("kernel", "linear")}
    assert told["kernel"] >= 0.97 and told["linear"] <= 0.7


def test_machine_is_that_of_numpy(rings):
    """The solved machine on the same features, and its answers against the exact kernel's."""
    df, x, y = rings
    made = kernels.radial(df, "x", 512, 1.0)
    train, test = np.arange(240) < 160, np.arange(240) >= 160
    z = made.of(x)
    t = np.where(y[:, None] == np.arange(2), 1.0, -1.0)
    w = np.linalg.solve(z[train].T @ z[train] + np.eye(513) / 10, z[train].T @ t[train])
    got = {r.id: r.predicted for r in kernels.predictions(df.where("id < 160"), df.where("id >= 160"), "label", "x", 10.0, True, 512, 1.0).collect()}
    assert [got[i] for i in np.flatnonzero(test)] == np.argmax(z[test] @ w, axis=1).tolist()
    exact = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(axis=2))
    alpha = np.linalg.solve(exact(x[train], x[train]) + np.eye(160) / 10, t[train])
    same = np.argmax(exact(x[test], x[train]) @ alpha, axis=1) == np.array([got[i] for i in np.flatnonzero(test)])
    assert same.mean() >= 0.95 and np.abs(z[:, :-1] @ z[:, :-1].T - exact(x, x)).mean() < 0.05


def test_grid_shares_what_one_value_gives(rings):
    df, _, _ = rings
    values = [10 ** (-3 + 6 * i / 29) for i in range(30)]
    told = M.grid_search(df, "id", "label", "x", values, 3)
    rows = told.collect()
    assert told.columns == ["C", "best"] and len(rows) == 30 and [r.best for r in rows] == sorted((r.best for r in rows), reverse=True)
    one = M.cross_validated(df, "id", "label", "x", 3, "kernel", C=values[20]).agg(F.max("accuracy")).first()[0]
    assert {round(r.C, 9): r.best for r in rows}[round(values[20], 9)] == one
    assert M.cross_validated(df, "id", "label", "x", 3, "kernel").count() == 3


def test_chance_of_the_kernel(rings):
    df, _, _ = rings
    told = M.permuted_accuracy(df, "id", "label", "x", 3, 3, "kernel")
    assert told.count() == 9 and 0.35 < told.agg(F.avg("accuracy")).first()[0] < 0.65


def test_eigenvectors(spark):
    n = 24
    w = np.abs(DRAW.normal(0, 1, (n, n))) * (1 + 6 * (np.arange(n)[:, None] // 8 == np.arange(n) // 8))
    w = np.triu(w, 1)
    pairs = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i in range(n) for j in range(i + 1, n)], "a long, b long, similarity double")
    w = w + w.T
    d = w.sum(axis=1)
    size, basis = np.linalg.eigh(w / np.sqrt(d[:, None] * d))
    vectors, values = spectral.eigenvectors(pairs, 3)
    x = np.array([r.x for r in vectors.orderBy("id").collect()])
    assert values == pytest.approx(size[::-1][:3], abs=1e-5)
    for c in range(3):
        assert abs(x[:, c] @ basis[:, -1 - c]) == pytest.approx(1, abs=1e-3)
    out, accuracy = M.match_labels(spectral.clusters(pairs, 3).withColumn("block", F.floor(F.col("id") / 8)), "block", "cluster")
    assert accuracy == 1


def test_series_spectra(spark):
    draw = random.Random(2)
    long = [(1, i, float(np.sin(2 * np.pi * 0.7 * i / 10)) + draw.gauss(0, 0.1)) for i in range(20000)]
    rows = [*long, (2, 0, 5.0), (3, 0, 1.0), (3, 1, None), (3, 2, 2.0), (4, 0, 2.0), (4, 1, 2.0)]
    out = {r.e: r for r in spectral.spectral_features(spark.createDataFrame(rows, "e int, i long, v double"), ["e"], "i", "v", 10.0, 2.0).collect()}
    assert out[1].dominant == pytest.approx(0.7, abs=1e-3) and out[1].snr > 10
    assert out[2].dominant == 10.0 and out[2].snr is None and out[4].dominant == 5.0 and len(out) == 4
    x = np.array([v for _, _, v in long[:37]])
    n = x.size
    slow = [abs(sum((x[i] - x.mean()) * np.exp(-2j * np.pi * f * i / n) for i in range(n))) ** 2 for f in range(1, n // 2 + 1)]
    assert spectral.series_spectrum(x, 10.0, 2.0, 16)[0] == (int(np.argmax(np.round(slow, 6))) + 1) * 10.0 / n
