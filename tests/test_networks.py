"""Networks: slopes, early stop and what is learned; regions and hulls of drawn shapes."""

import numpy as np
import pytest

from tracekit.operators import frames, networks
from tracekit.operators import models as M

DRAW = np.random.default_rng(9)


@pytest.fixture(scope="module")
def cross(spark):
    """Label 1, a fifth of the rows, where both inputs have one sign: no line tells that."""
    x = DRAW.normal(0, 1, (1500, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    keep = (y == 0) | (DRAW.random(1500) < 0.25)
    x, y = x[keep], y[keep]
    return spark.createDataFrame([(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, y int, x array<double>").repartition(4)


def test_slopes():
    net = networks.Network([(DRAW.normal(0, 1, (3, 4)), DRAW.normal(0, 1, 4)), (DRAW.normal(0, 1, (4, 1)), np.zeros(1))], np.zeros(3), np.ones(3), [])
    x, y, weight = DRAW.normal(0, 1, (20, 3)), DRAW.integers(0, 2, 20), DRAW.random(20)
    told = networks.gradients(net, x, y, weight)
    flat = [w for layer in net.layers for w in layer]
    for w, g in zip(flat, told, strict=True):
        at = tuple(0 for _ in w.shape)
        was, step = w[at], 1e-6
        w[at] = was + step
        up = networks._loss(net.probability(x), y, weight)
        w[at] = was - step
        down = networks._loss(net.probability(x), y, weight)
        w[at] = was
        assert g[at] == pytest.approx((up - down) / (2 * step), rel=1e-4, abs=1e-6)


def test_it_learns_and_stops(cross):
    net = networks.train(cross, "x", "y", (8, 4), rounds=250, patience=5, rate=0.2)
    assert len(net.losses) < 250 and len(net.losses) - 1 - int(np.argmin(net.losses)) == 5  # five rounds without a better one
    assert min(net.losses) < 0.6 * net.losses[0]
    told = M.score_new(net, cross, "x").collect()
    right = [[r.accepted == bool(r.y) for r in told if r.y == c] for c in (0, 1)]
    assert min(np.mean(x) for x in right) > 0.85 and all(0 <= r.score <= 1 for r in told)


def test_scorer_by_logistic_regression(cross):
    told = M.score_new(M.train_scorer(cross, "x", "y"), cross, "x", 0.4).collect()
    assert all(r.accepted == (r.score >= 0.4) for r in told) and len(told) == cross.count()


def drawn(text):
    return np.array([(y, x) for y, row in enumerate(text.split()) for x, c in enumerate(row) if c == "#"])


def test_regions():
    found = frames.regions(drawn("##..# .#..# ..#.. ..... #...."))
    assert [len(r) for r in found] == [4, 2, 1] and found[0].tolist() == [[0, 0], [0, 1], [1, 1], [2, 2]]


@pytest.mark.parametrize("text, want", [("### ### ###", 1.0), ("#", 1.0), ("####", 1.0), ("#.# #.# ###", 7 / 9), (".#. ### .#.", 1.0), ("#.. #.. ###", 5 / 6)])
def test_solidity(text, want):
    assert frames.solidity(drawn(text)) == pytest.approx(want)


def test_first_region_of_footprints(spark):
    rows = [(1, 0, 0, 9.0), (1, 0, 1, 9.0), (1, 7, 7, 9.0), (1, 3, 3, 0.1), (2, 4, 4, 1.0)]
    out = {r.e: r for r in frames.region_features(spark.createDataFrame(rows, "e int, y int, x int, w double"), ["e"], 64).collect()}
    assert (out[1].regions, out[1].area, out[1].solidity, out[1].cx) == (2, 2, 1.0, 0.5) and (out[2].regions, out[2].area) == (1, 1)
