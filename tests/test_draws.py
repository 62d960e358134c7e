"""Hashes of whole arrays of messages, and permutations and bootstraps that are dealt to tasks by their work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracekit.operators import groups as G
from tracekit.operators import resampling as R
from tracekit.operators import testing as X


@pytest.mark.parametrize("most", [3, 1 << 13])
def test_hashes_of_arrays_are_those_of_messages(monkeypatch, most):
    monkeypatch.setattr(R, "_AT_ONCE", most)
    heads = [b"", b"7-", b"13-entity-a-", *(b"%d-" % i for i in range(20)), b"x" * 40]
    ends = [b"", *(b"%d" % j for j in range(15)), "é".encode(), b"y" * 15, b"y" * 16, b"z" * 70]
    got = R.drawn(heads, ends)
    assert (got == np.array([R.draws(h.decode(), ends) for h in heads])).all()
    assert R.drawn([], ends).shape == (0, len(ends)) and R.drawn(heads, []).shape == (len(heads), 0)


def test_work_is_dealt_by_draws_and_not_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(R, "parts_of", lambda df, work, least=1: min(6, work))
    df = spark.range(600).select((F.col("id") % 50).alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), F.rand(3).alias("v"))
    for out in (X.permuted_bins(df, ["k"], "o", "v", 4, 10), G.bootstrap_sd(df.withColumn("k", F.col("o") % 25), ["k"], "g", "v", "o", "a", "b", 10)):
        tasks = out.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 3
