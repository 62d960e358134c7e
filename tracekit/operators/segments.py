"""Runs, laps and epochs, and rows assigned to them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, k: list[str], o: str, flag: str) -> DataFrame:
    """(k, start, stop, length) of each unbroken run of rows with a true ``flag``, o being whole numbers in steps of 1."""
    on = df.where(flag).withColumn("_g", F.col(o) - F.row_number().over(Window.partitionBy(*k).orderBy(o)))
    return on.groupBy(*k, "_g").agg(F.min(o).alias("start"), F.max(o).alias("stop"), F.count("*").alias("length")).drop("_g")


def laps_by_reset(df: DataFrame, k: list[str], o: str, v: str, drop: float = 0.5) -> DataFrame:
    """df with lap, counted from 0, a new one wherever v falls by at least ``drop``."""
    w = Window.partitionBy(*k).orderBy(o)
    return df.withColumn("_r", (F.coalesce(F.lag(v).over(w) - F.col(v), F.lit(0.0)) >= drop).cast("int")).withColumn("lap", F.sum("_r").over(w)).drop("_r")


def lap_epochs(df: DataFrame, k: list[str], o: str) -> DataFrame:
    return df.groupBy(*k, "lap").agg(F.min(o).alias("start"), F.max(o).alias("stop"), F.count("*").alias("length"))


def long_epochs(epochs: DataFrame, least: float) -> DataFrame:
    return epochs.where(F.col("stop") - F.col("start") > least)


def complement(epochs: DataFrame, k: list[str], end: str, least: float = 0.0) -> DataFrame:
    """(k, start, stop) of the gaps between epochs from 0 to the value of column ``end``, longer than ``least``."""
    before = F.coalesce(F.lag("stop").over(Window.partitionBy(*k).orderBy("start")), F.lit(0.0))
    gaps = epochs.select(*k, before.alias("start0"), F.col("start").alias("stop0"))
    tail = epochs.groupBy(*k).agg(F.max("stop").alias("start0"), F.max(end).alias("stop0"))
    return gaps.union(tail).where(F.col("stop0") - F.col("start0") > least).select(*k, F.col("start0").alias("start"), F.col("stop0").alias("stop"))


def assigned(events: DataFrame, segments: DataFrame, k: list[str], ident: list[str], t: str, width: float, start: str = "start", stop: str = "stop", name: str = "segment") -> DataFrame:
    """events with the largest ``name`` of the segments of their key that hold ``t`` (both ends included), null if none; (k, ident) tells events apart.

    A range join as an equi join: segments are exploded into cells of ``width``, so no nested loop is needed however many there are.
    """
    cell = "_cell"
    cells = segments.select(*k, start, stop, name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))).alias(cell))
    placed = events.select(*k, *ident, t, F.floor(F.col(t) / width).alias(cell))
    hit = placed.join(cells, [*k, cell]).where(F.col(t).between(F.col(start), F.col(stop))).groupBy(*k, *ident).agg(F.max(name).alias(name))
    return events.join(hit, [*k, *ident], "left")


def epoch_means(df: DataFrame, epochs: DataFrame, k: list[str], ident: list[str], t: str, v: str, width: float) -> DataFrame:
    """(k, segment, mean): NaN skipped, epochs without rows left out."""
    inside = assigned(df, epochs, k, ident, t, width).where("segment is not null")
    return inside.groupBy(*k, "segment").agg(F.avg(F.when(~F.isnan(v), F.col(v))).alias("mean"))


def onset_windows(epochs: DataFrame, k: list[str], half: float, least: float) -> DataFrame:
    """start -+ half of epochs longer than ``least`` that begin more than ``least`` after the one before; the first of a key is left out."""
    gap = F.col("start") - F.lag("stop").over(Window.partitionBy(*k).orderBy("start"))
    return epochs.withColumn("_g", gap).where((F.col("_g") > least) & (F.col("stop") - F.col("start") > least)).select(*k, (F.col("start") - half).alias("lo"), (F.col("start") + half).alias("hi"))


def labelled_halves(df: DataFrame, k: list[str], o: str, first: str, second: str) -> DataFrame:
    i, n = F.row_number().over(Window.partitionBy(*k).orderBy(o)), F.count("*").over(Window.partitionBy(*k))
    return df.withColumn("context", F.when(i <= F.floor(n / 2), first).otherwise(second))


def laps_by_coverage(df: DataFrame, k: list[str], o: str, v: str, bins: int, least: float, drop: float = 0.5) -> DataFrame:
    """(k, lap, start, stop, visited): laps whose positions v, from 0 to 1, visit at least the share ``least`` of ``bins`` bins, numbered from 1 in order."""
    seen = laps_by_reset(df, k, o, v, drop).groupBy(*k, F.col("lap").alias("_lap")).agg(F.min(o).alias("start"), F.max(o).alias("stop"), F.count_distinct(F.floor(F.col(v) * bins)).alias("visited"))
    kept = seen.where(F.col("visited") >= least * bins)
    return kept.withColumn("lap", F.row_number().over(Window.partitionBy(*k).orderBy("_lap"))).drop("_lap")


def membership_counts(events: DataFrame, segments: DataFrame, k: list[str], ident: list[str], t: str, width: float) -> DataFrame:
    """(k, segment, n): events in each segment, those in none under segment 0."""
    return assigned(events, segments, k, ident, t, width).groupBy(*k, F.coalesce("segment", F.lit(0)).alias("segment")).agg(F.count("*").alias("n"))


def binned_means(df: DataFrame, k: list[str], o: str, v: str, bins: int) -> DataFrame:
    """(k, bin, mean) over ``bins`` stretches of equal length of each series."""
    i, n = F.row_number().over(Window.partitionBy(*k).orderBy(o)) - 1, F.count("*").over(Window.partitionBy(*k))
    return df.select(*k, v, i.alias("_i"), n.alias("_n")).groupBy(*k, F.expr(f"cast(_i * {bins} div _n as int)").alias("bin")).agg(F.avg(v).alias("mean"))


def laps_by_falls(df: DataFrame, k: list[str], o: str, v: str, height: float = 0.5, distance: int = 50) -> DataFrame:
    """(k, lap, start, stop) from positions, o counting from 0: v over its maximum falls by at least ``height`` at the end of a lap, the steepest fall within ``distance`` samples; laps from 0, the last one up to the last sample."""
    from tracekit.operators.peaks import find_peaks

    whole = Window.partitionBy(*k)
    level = df.select(*k, o, F.try_divide(F.col(v).cast("double"), F.max(v).over(whole)).alias("_v")).withColumn("_f", F.col("_v") - F.coalesce(F.lead("_v").over(whole.orderBy(o)), F.lit(0.0)))
    ends = find_peaks(level, k, o, "_f", height, distance, None).select(*k, F.col(o).alias("stop"))
    last = df.groupBy(*k).agg(F.max(o).alias("stop"))
    both = ends.union(last).distinct()
    w = whole.orderBy("stop")
    return both.select(*k, (F.row_number().over(w) - 1).alias("lap"), F.coalesce(F.lag("stop").over(w) + 1, F.lit(0)).alias("start"), "stop")


def laps_by_visits(df: DataFrame, k: list[str], o: str, v: str, drop: float = -0.5, bins: int = 100, least: float = 0.5) -> DataFrame:
    """(k, lap, start, stop, visited): runs in which v never falls under ``drop`` from one sample to the next, with the sample at their end, that visit at least the share ``least`` of ``bins`` bins of [0, 1); kept ones are numbered from 1."""
    w = Window.partitionBy(*k).orderBy(o)
    up = df.select(*k, o, v, (F.lead(v).over(w) - F.col(v)).alias("_d"))
    run = runs(up.withColumn("_on", F.coalesce(F.col("_d") >= drop, F.lit(False))), k, o, "_on").select(*k, "start", (F.col("stop") + 1).alias("stop"))
    held = run.select(*k, "start", "stop", F.explode(F.sequence("start", "stop")).alias(o)).join(df.select(*k, o, v), [*k, o])
    seen = held.groupBy(*k, "start", "stop").agg(F.count_distinct(F.least(F.floor(F.col(v) * bins), F.lit(bins - 1))).alias("visited")).where(F.col("visited") >= least * bins)
    return seen.select(*k, F.row_number().over(Window.partitionBy(*k).orderBy("start")).alias("lap"), "start", "stop", "visited")


def epochs_by_speed(df: DataFrame, k: list[str], o: str, t: str, pos: str, smooth: int, least: float | None = None, most: float | None = None, duration: float = 0.0, trim: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(k, start, stop) in time: stretches of movement (speed at least ``least``) or rest (at most ``most``) longer than ``duration``, then cut by the trims at both ends, and what is no longer than ``duration`` then left out.

    pos is a turn's part from 0 to 1; speed is the size of the wrapped angle from one sample to the next over the time, averaged over 2 * smooth + 1 samples.
    """
    from tracekit.functions.scalars import angle_difference
    from tracekit.operators.windows import running_mean

    w = Window.partitionBy(*k).orderBy(o)
    turn = F.lit(2 * math.pi)
    step = F.try_divide(F.abs(angle_difference(F.lead(pos).over(w) * turn, F.col(pos) * turn)), F.lead(t).over(w) - F.col(t))
    fast = running_mean(df.select(*k, o, t, step.alias("_s")).withColumn("_s", F.coalesce("_s", F.last("_s", ignorenulls=True).over(w))), k, o, "_s", smooth, out="_m")
    on = F.lit(True)
    if least is not None:
        on = on & (F.col("_m") >= least)
    if most is not None:
        on = on & (F.col("_m") <= most)
    run = runs(fast.withColumn("_on", F.coalesce(on, F.lit(False))), k, o, "_on")
    at = fast.select(*k, F.col(o).alias("_o"), F.col(t).alias("_t"))
    ends = run.join(at.withColumnsRenamed({"_o": "start", "_t": "_a"}), [*k, "start"]).join(at.withColumnsRenamed({"_o": "stop", "_t": "_b"}), [*k, "stop"])
    long = ends.where(F.col("_b") - F.col("_a") > duration).select(*k, (F.col("_a") + trim[0]).alias("start"), (F.col("_b") - trim[1]).alias("stop"))
    return long.where(F.col("stop") - F.col("start") > duration)


def rounded_epochs(epochs: DataFrame, step: float = 0.1) -> DataFrame:
    """Epochs with starts moved back, and stops on, to whole steps."""
    return epochs.withColumns({"start": F.floor(F.col("start") / step) * step, "stop": F.ceil(F.col("stop") / step) * step})


def state_means(df: DataFrame, k: list[str], v: str, context: str, state: str, window: str) -> DataFrame:
    """(k, context, slice, n, mean): v over each context, each context and state (true and false), and each context within onset windows."""
    part = F.explode(F.filter(F.array(F.lit("all"), F.when(F.col(state), "on").otherwise("off"), F.when(F.col(window), "onset")), lambda x: x.isNotNull()))
    return df.select(*k, context, v, part.alias("slice")).groupBy(*k, context, "slice").agg(F.count("*").alias("n"), F.avg(v).alias("mean"))
