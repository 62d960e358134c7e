"""Samples of 0 inside a peak's waveform are samples."""

from tracekit.operators import peaks as P


def test_zeros_of_the_series_are_counted(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 5.0, 0.0, 2.0])], "k int, o int, v double")
    at = spark.createDataFrame([(1, 1)], "k int, o int")
    (r,) = P.peak_shapes(df, at, ["k"], "o", "v", 2, before=2, after=5).collect()
    assert r.waveform == [0.0, 5.0, 0.0, 2.0] + [0.0] * 4 and r.samples == 4
