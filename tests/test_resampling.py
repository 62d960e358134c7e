"""Draws by array index against draws by rows, and split keys against whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from tracekit.operators import groups as G
from tracekit.operators import resampling as R
from tracekit.operators import testing as X
from tracekit.operators import tuning as T

DRAW = random.Random(12)


def rows_of(df, places=9):
    return sorted(tuple(round(v, places) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def laps(spark):
    """Two sessions; entity 0 of the first has most spikes; a lap has one frame, and one frame has no lap."""
    frames = [(s, f, f // 9 if f < 44 else 9, (f * (s + 3)) % 6) for s in (0, 1) for f in range(45)] + [(0, 99, None, 1)]
    spikes = [(s, e, DRAW.randrange(45)) for s in (0, 1) for e in range(3) for _ in range(8)] + [(0, 0, DRAW.randrange(45)) for _ in range(60)] + [(0, 1, 99), (1, 2, 1000)]
    return spark.createDataFrame(spikes, "session int, entity int, frame int"), spark.createDataFrame(frames, "session int, frame int, lap int, bin int")


def plain_shuffles(spikes, frames, n, seed):
    from collections import Counter
    from hashlib import md5

    laps, at = {}, {}
    for s, f, lap, b in sorted((x for x in frames if x[2] is not None), key=lambda x: x[1]):
        own = laps.setdefault((s, lap), [])
        at[s, f] = (lap, len(own))
        own.append(b)
    out = Counter()
    for s, e, f in spikes:
        for d in range(1, n + 1):
            if (s, f) in at:
                lap, i = at[s, f]
                own = laps[s, lap]
                off = int(md5(f"{seed}-{d}-{s}-{lap}".encode()).hexdigest()[:8], 16) % len(own)
                out[s, d, e, own[(i - off) % len(own)]] += 1
    return sorted((*k, v) for k, v in out.items())


def test_shuffles(spark, laps):
    spikes, frames = laps
    want = plain_shuffles([tuple(r) for r in spikes.collect()], [tuple(r) for r in frames.collect()], 12, 7)
    assert rows_of(T.circular_shuffles(spikes, frames, 12, k=("session",))) == want


@pytest.mark.parametrize("told", ["bins", "peaks", "limits"])
def test_split_entities(spark, laps, told):
    spikes, frames = laps
    whole, split = (rows_of(R.shuffled_counts(spikes, frames, 15, k=("session",), told=told, p=0.8, big=big)) for big in (1 << 20, 10))
    assert whole == split and len(whole) > 5


def test_lap_arrays_are_joined_where_they_are_many(spark, laps, monkeypatch):
    spikes, frames = laps
    want = rows_of(R.shuffled_counts(spikes, frames, 5, k=("session",)))
    monkeypatch.setattr(R, "SENT", 3)
    assert rows_of(R.shuffled_counts(spikes, frames, 5, k=("session",))) == want


def test_limits_are_the_percentiles_of_rows(spark, laps):
    spikes, frames = laps
    k = ("session",)
    frames = frames.where("lap is not null")
    real = T.raw_rates(spikes, frames, T.occupancy(frames, 0.1, k), k)
    by_rows = T.null_percentile(real, T.circular_shuffles(spikes, frames, 40, k=k), 40, 0.9, k)
    assert rows_of(T.shuffle_tested(real, spikes, frames, 40, 0.9, k=k).select(*by_rows.columns)) == rows_of(by_rows)


def test_bootstrap_of_large_keys(spark):
    rows = [(k, DRAW.choice("ab"), i, DRAW.choice([DRAW.gauss(0, 1), None, 3.0])) for k in range(4) for i in range(5 + 30 * (k == 1))] + [(9, "a", 0, 1.0)]
    df = spark.createDataFrame(rows, "k int, g string, i int, v double")
    whole, split = (rows_of(G.bootstrap_sd(df, ["k"], "g", "v", "i", "a", "b", 20, big=big)) for big in (1 << 20, 8))
    assert whole == split and 9 not in {r[0] for r in whole} and len(whole) >= 3


def test_permutations_of_long_series(spark):
    rows = [(k, i, DRAW.gauss(0, 1)) for k, n in enumerate((1, 3, 10, 47)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    whole, split = (rows_of(X.permuted_bins(df, ["k"], "i", "v", 5, 20, big=big).fillna(-1.0), 6) for big in (1 << 20, 5))
    assert whole == split and len(whole) == 1 + 3 + 5 + 5


def test_empty_tables(spark, laps):
    spikes, frames = laps
    assert R.shuffled_counts(spikes.limit(0), frames, 5, k=("session",)).count() == 0
    assert R.shuffled_counts(spikes, frames.limit(0), 5, k=("session",)).count() == 0
    assert T.peak_z_p(spikes.limit(0).withColumn("real", F.lit(1)).select("session", "entity", "real"), spikes, frames, 5, k=("session",)).count() == 0
