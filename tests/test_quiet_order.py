"""Quiet stretches whose statistics must not hang on the order in which tasks meet."""

import random

import numpy as np

from tracekit.operators import peaks as P


def test_same_samples_are_the_same_stretch(spark):
    draw = random.Random(7)
    lists = [[draw.randrange(1, 49000) / 100 for _ in range(40)] for _ in range(200)]
    samples = spark.createDataFrame([(e, i, v) for e, x in enumerate(lists) for i, v in enumerate(x)], "entity int, frame int, value double").repartition(8)
    # with far=20 and near=5 both peaks have the samples 0 to 14 before them: one kind of stretch only
    peaks = spark.createDataFrame([(e, p) for e in range(len(lists)) for p in (15, 20)], "entity int, frame int")
    out = P.quiet_zscore(samples, peaks, ["entity"], "frame", "value", far=20, near=5)
    assert out.where("z is not null").count() == 0


def test_samples_are_added_in_order(spark):
    draw = random.Random(8)
    lists = [[draw.randrange(1, 49000) / 100 for _ in range(40)] for _ in range(100)]
    samples = spark.createDataFrame([(e, i, v) for e, x in enumerate(lists) for i, v in enumerate(x)], "entity int, frame int, value double").repartition(8)
    peaks = spark.createDataFrame([(e, p) for e in range(len(lists)) for p in (12, 35)], "entity int, frame int")

    def stretch(x):
        mean = d = 0.0
        for n, v in enumerate(x):
            new = mean + (v - mean) / (n + 1)
            d, mean = d + (v - new) * (v - mean), new
        total = 0.0
        for v in x:
            total += v
        return np.sqrt(d / len(x)), total / len(x)

    got = {(r.entity, r.frame): r.z for r in P.quiet_zscore(samples, peaks, ["entity"], "frame", "value", far=20, near=5).collect()}
    for e, x in enumerate(lists):
        s, m = min((stretch(x[:12]), stretch(x[15:30])))
        assert [got[e, i] for i in range(40)] == [(v - m) / s for v in x]
