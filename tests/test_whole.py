"""Queries over all sessions and all frames."""

from pyspark.sql import functions as F

from test_queries import SF
from tracekit.plans import QUERIES


def test_all_sessions(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert QUERIES["a9_qc_mask"](spark, SF).count() == lines
    assert {r.session for r in QUERIES["a12_cluster_summary"](spark, SF).collect()} == set(range(1, 8))


def test_halves_are_even(spark):
    frames = {r.half: r.n for r in QUERIES["i8_split_halves"](spark, SF).groupBy("half").agg(F.count_distinct("frame").alias("n")).collect()}
    assert frames == {0: 250, 1: 250}
