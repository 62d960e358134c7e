"""Shuffles told by marks, laps in groups with entities in parts."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracekit.operators import resampling as R


@pytest.fixture(scope="module")
def clocks(spark):
    frames = spark.range(400).select(F.col("id").alias("frame"), (F.col("id") % 9).alias("lap"), (F.xxhash64("id") % 7 + 7).cast("int").alias("bin"))
    spikes = spark.range(900).select((F.col("id") % 5 * (F.col("id") % 2)).alias("entity"), (F.col("id") * 7 % 410).alias("frame"))
    return spikes, frames


def test_marks_tell_of_all_draws(clocks):
    spikes, frames = clocks
    want = defaultdict(list)
    for r in R.shuffled_counts(spikes, frames, 12).collect():
        want[r.entity, r.bin] += zip(r.draws, r.counts, strict=True)
    got = {(r.entity, r.bin): (r.reached, r.total, r.most, r.mark) for r in R.shuffled_counts(spikes, frames, 12, told="marks").collect()}
    assert got == {k: (len(v), sum(c for _, c in v), max(c for _, c in v), sum(d * c for d, c in v)) for k, v in want.items()} and len(got) > 20


@pytest.mark.parametrize("told", ["marks", "limits"])
def test_laps_in_groups_and_entities_in_parts(clocks, told):
    spikes, frames = clocks
    rows = lambda **how: sorted(tuple(r) for r in R.shuffled_counts(spikes, frames, 12, told=told, p=0.8, **how).collect())
    assert rows() == rows(sent=100) == rows(sent=100, big=50)
