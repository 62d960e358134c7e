"""Curves by bin and tables of counts: distances, confusion metrics, error bars, positions of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def curve_distances(a: DataFrame, b: DataFrame, key: str, at: str, v: str) -> DataFrame:
    """(key, diff, euclid, dot, correlation_distance) of two curves of each key, over the bins that both have.

    The last is 1 - Pearson; where a curve is constant it is 0 if both are equal everywhere, else 1.
    """
    both = a.select(key, at, F.col(v).alias("p")).join(b.select(key, at, F.col(v).alias("q")), [key, at])
    d = F.col("p") - F.col("q")
    flat = (F.min("p") == F.max("p")) | (F.min("q") == F.max("q"))
    away = F.when(flat, F.when(F.max(F.abs(d)) == 0, 0.0).otherwise(1.0)).otherwise(1 - F.corr("p", "q"))
    return both.groupBy(key).agg(F.sum(d).alias("diff"), F.sqrt(F.sum(d * d)).alias("euclid"), F.avg(F.col("p") * F.col("q")).alias("dot"), away.alias("correlation_distance"))


def confusion_metrics(pairs: DataFrame, true: str, predicted: str) -> DataFrame:
    """(class, n, precision, recall, f1) from counts by pair of classes; 0 where nothing was predicted or known."""
    n = pairs.groupBy(true, predicted).agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col(true) == F.col(predicted), F.col("n")).otherwise(0))
    known = n.groupBy(F.col(true).alias("class")).agg(F.sum("n").alias("n"), hit.alias("hits"))
    told = n.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("told"))
    both = known.join(told, "class", "left").withColumn("told", F.coalesce("told", F.lit(0)))
    precision = F.when(F.col("told") > 0, F.col("hits") / F.col("told")).otherwise(0.0)
    f1 = 2 * F.col("hits") / (F.col("told") + F.col("n"))
    return both.select("class", "n", precision.alias("precision"), (F.col("hits") / F.col("n")).alias("recall"), f1.alias("f1"))


def error_bars(df: DataFrame, keys: list[str], x: str, v: str, base: tuple[int, int] | None = None) -> DataFrame:
    """(keys, x, mean, sem, n), less the mean of the rows with base[0] <= x < base[1] if given."""
    out = df.groupBy(*keys, x).agg(F.avg(v).alias("mean"), (F.stddev_pop(v) / F.sqrt(F.count(v))).alias("sem"), F.count(v).alias("n"))
    if base is None:
        return out
    low = df.where((F.col(x) >= base[0]) & (F.col(x) < base[1])).groupBy(*keys).agg(F.avg(v).alias("_base"))
    return out.join(low, keys, "left").withColumn("mean", F.col("mean") - F.coalesce("_base", F.lit(0.0))).drop("_base")


def field_class(peak: Column, low: int = 10, high: int = 90, middle: tuple[int, int] | None = None) -> Column:
    """``start`` from ``high`` on or up to ``low``; ``mid`` within ``middle``; ``place`` elsewhere."""
    out = F.when((peak >= high) | (peak <= low), "start")
    return (out.when(peak.between(*middle), "mid") if middle else out).otherwise("place")


def selected(df: DataFrame, column: str, selection: str) -> DataFrame:
    """Rows whose whole-number column is in a selection such as ``1,3-5``, ends included; ``all`` keeps all."""
    if selection.strip() == "all":
        return df
    keep = F.lit(False)
    for part in selection.split(","):
        low, _, high = part.strip().partition("-")
        keep = keep | F.col(column).between(int(low), int(high or low))
    return df.where(keep)


def curve_products(a: DataFrame, b: DataFrame, key: str, at: str, v: str) -> DataFrame:
    """(key, at, diff, product) of two curves of each key, over the bins that both have."""
    both = a.select(key, at, F.col(v).alias("p")).join(b.select(key, at, F.col(v).alias("q")), [key, at])
    return both.select(key, at, (F.col("p") - F.col("q")).alias("diff"), (F.col("p") * F.col("q")).alias("product"))


def accuracy(pairs: DataFrame, true: str, predicted: str) -> DataFrame:
    """One row: the number of pairs and the share of equal ones."""
    return pairs.agg(F.count("*").alias("n"), F.avg((F.col(true) == F.col(predicted)).cast("double")).alias("accuracy"))
