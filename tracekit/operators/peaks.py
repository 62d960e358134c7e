"""Peaks of keyed series: transients by iterated thresholds, peak shapes, quiet baselines, smoothing and prominence.

df has key columns k, an order column o that counts samples from 0 in steps of 1, and a value column v.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracekit.operators import windows as W
from tracekit.sources.scratch import written


def transients(df: DataFrame, k: list[str], o: str, v: str, m: int = 15, times: float = 3.0, timeout: float = 3.0, first: int = 30, rounds: int = 3) -> DataFrame:
    """(k, o): starts of transients. The first samples take the value of sample ``first``; where the running mean over 2m+1 samples
    rises by more than ``times`` the deviation of its differences, the steepest rise that has no steeper one within ``timeout * m`` is a peak.

    Then, ``rounds`` times, differences from 3m before to 2m after each peak are masked and the search is repeated on what is left. Peaks are written
    after each round, which cuts the lineage. A series of n samples has n - 1 differences; null and NaN differences count as masked.
    """
    smooth = W.running_mean(W.filled_leading(df.select(*k, o, v), k, o, v, first), k, o, v, m, out="_m")
    rise = smooth.withColumn("_d", F.lead("_m").over(Window.partitionBy(*k).orderBy(o)) - F.col("_m")).where("_d is not null").select(*k, o, F.col("_d").alias("d"))
    rise = written(rise, "rises")
    peaks = None
    for _ in range(rounds + 1):
        left = rise
        if peaks is not None:
            masked = peaks.select(*k, F.explode(F.sequence(F.col(o) - 3 * m, F.col(o) + 2 * m)).alias(o)).distinct()
            left = rise.join(masked, [*k, o], "left_anti")
        limit = left.where(~F.isnan("d")).groupBy(*k).agg((F.stddev_pop("d") * times).alias("_t"))
        fall = left.join(limit, k).withColumn("_x", -F.col("d"))
        size = rise.groupBy(*k).agg((F.max(o) + 1).alias("_n"))
        low = W.minima_candidates(fall.join(size, k), k, o, "_x", below=-F.col("_t"), n="_n").select(*k, o, "_x")
        found = W.kept_apart(low, k, o, "_x", timeout * m).select(*k, o)
        peaks = written(found if peaks is None else peaks.union(found).distinct(), "peaks")
    return peaks


def peak_shapes(df: DataFrame, peaks: DataFrame, k: list[str], o: str, v: str, reach: int, before: int = 100, after: int = 300) -> DataFrame:
    """(k, o, top, top_at, low, amplitude, waveform, samples) of each peak: the largest sample from it on within ``reach``, its place (the first on ties), the smallest within half of that before it, their difference, and
    the samples from ``before`` to ``after``, moved to the front where the series begins later, zeros at the end up to before + after + 1; ``samples`` of it are the series', zeros among them.

    Each peak meets the samples around it by an equi join on their places.
    """
    half = round(reach / 2)
    near = peaks.select(*k, F.col(o).alias("_p"), F.explode(F.sequence(F.col(o) - max(before, half), F.col(o) + max(after, reach) - 1)).alias(o))
    both = near.join(df.select(*k, o, v), [*k, o]).withColumn("_off", F.col(o) - F.col("_p"))
    up, down, wave = F.col("_off").between(0, reach - 1), F.col("_off").between(-half, -1), F.col("_off").between(-before, after - 1)
    out = both.groupBy(*k, "_p").agg(
        F.max(F.when(up, F.col(v))).alias("top"),
        F.max_by(o, F.when(up, F.struct(F.col(v), -F.col(o)))).alias("top_at"),
        F.min(F.when(down, F.col(v))).alias("low"),
        F.sort_array(F.collect_list(F.when(wave, F.struct(F.col(o).alias("i"), F.col(v).alias("x"))))).alias("_w"),
    )
    size = before + after + 1
    shape = F.concat(F.col("_w.x"), F.array_repeat(F.lit(0.0), F.lit(size) - F.size("_w")))
    return out.select(*k, F.col("_p").alias(o), "top", "top_at", "low", (F.col("top") - F.col("low")).alias("amplitude"), shape.alias("waveform"), F.size("_w").alias("samples"))


def _in_order(o: str, v: str) -> Column:
    """The values of a group in the order of o."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(o).alias("o"), F.col(v).alias("v")))), lambda x: x["v"])


def _mean(values: str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def _deviation(values: str) -> Column:
    """The population deviation, one value after another."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("d"))

    def step(s: Column, x: Column) -> Column:
        mean = s["m"] + (x - s["m"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("m"), (s["d"] + (x - mean) * (x - s["m"])).alias("d"))

    return F.aggregate(values, start, step, lambda s: F.sqrt(s["d"] / s["n"]))


def quiet_zscore(df: DataFrame, peaks: DataFrame, k: list[str], o: str, v: str, far: int = 299, near: int = 99, out: str = "z") -> DataFrame:
    """v less the mean, over the deviation, of quiet stretches: those before peaks, from ``far`` to ``near`` samples ahead of them (from the start to an early peak), whose deviation is in the lowest tenth of their range.

    Deviations of 0 don't count. Null where a series has no quiet stretch, or only one kind of them. Samples of a stretch are added up in their order, as the last bit of a sum
    decides between halves to round and between equal stretches; a stretch has at most ``far`` of them.
    """
    late = F.col(o) >= far
    ask = peaks.select(*k, F.col(o).alias("_p"), F.explode(F.sequence(F.when(late, F.col(o) - far).otherwise(0), F.when(late, F.col(o) - near - 1).otherwise(F.greatest(F.col(o) - 1, F.lit(0))))).alias(o))
    both = ask.where(F.col(o) < F.col("_p")).join(df.select(*k, o, F.col(v).cast("double").alias("_v")).where("_v is not null"), [*k, o])
    each = both.groupBy(*k, "_p").agg(_in_order(o, "_v").alias("_x")).select(*k, "_p", _mean("_x").alias("_m"), _deviation("_x").alias("_s")).where("_s > 0")
    w = Window.partitionBy(*k)
    span = F.max("_s").over(w) - F.min("_s").over(w)
    lowest = each.withColumn("_b", F.when(span > 0, F.floor((F.col("_s") - F.min("_s").over(w)) / span * 10))).where("_b = 0")
    base = lowest.groupBy(*k).agg(_in_order("_p", "_m").alias("_m"), _in_order("_p", "_s").alias("_s")).select(*k, _mean("_m").alias("_m"), _mean("_s").alias("_s"))
    return df.join(base, k, "left").withColumn(out, (F.col(v) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def polynomial_weights(width: int, order: int) -> np.ndarray:
    """Row i: what each of ``width`` samples adds to the value at i of the polynomial that fits them best."""
    x = np.vander(np.arange(width) - width // 2, order + 1, increasing=True).astype(float)
    return x @ np.linalg.pinv(x)


def polynomial_smooth(df: DataFrame, k: list[str], o: str, v: str, width: int = 11, order: int = 3, log: bool = False, out: str = "smooth") -> DataFrame:
    """Each sample's value on the polynomial through the ``width`` samples around it; of the first and last half window, on that through the first and last ``width`` samples. Null in shorter series.

    With ``log``, of log(v - min) + 1; where that is not finite, the smallest finite value of the series.
    """
    weights, half = polynomial_weights(width, order), width // 2
    if log:
        low = F.min(v).over(Window.partitionBy(*k))
        df = df.withColumn("_v", F.when(F.col(v) > low, F.log(F.col(v) - low) + 1))
    else:
        df = df.withColumn("_v", F.col(v).cast("double"))
    counted = df.withColumn("_n", F.count("*").over(Window.partitionBy(*k)))
    mid = W.weighted(counted, k, o, "_v", [float(x) for x in weights[half]], -half, "_s", missing=None)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in weights])
    def edge(first: bool) -> DataFrame:
        j = F.col(o) if first else F.col(o) - F.col("_n") + width
        rows = counted.where((j >= 0) & (j < width) & (F.col("_n") >= width)).select(*k, "_n", j.cast("int").alias("_j"), "_v")
        at = F.explode(F.sequence(F.lit(0 if first else width - half), F.lit(half - 1 if first else width - 1)))
        rows = rows.withColumn("_i", at)
        value = F.sum(F.element_at(F.element_at(table, F.col("_i") + 1), F.col("_j") + 1) * F.col("_v"))
        told = rows.groupBy(*k, "_n", "_i").agg(F.when(F.count("_v") == width, value).alias("_e"))
        return told.select(*k, (F.col("_i") if first else F.col("_i") + F.col("_n") - width).alias(o), "_e")

    both = mid.join(edge(True).union(edge(False)), [*k, o], "left")
    inner = (F.col(o) >= half) & (F.col(o) < F.col("_n") - half)
    value = F.when(F.col("_n") >= width, F.when(inner, F.col("_s")).otherwise(F.col("_e")))
    told = both.withColumn(out, value)
    if log:
        told = told.withColumn(out, F.coalesce(out, F.min(out).over(Window.partitionBy(*k))))
    return told.drop("_v", "_n", "_s", "_e")


def _find(x: np.ndarray, height: float | None, distance: int, prominence: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and prominences of the maxima of one series."""
    n = x.size
    change = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if n else np.zeros(0, int)
    ends = np.append(change[1:], n) - 1
    inner = np.arange(1, change.size - 1)
    top = inner[(x[change[inner]] > x[change[inner - 1]]) & (x[change[inner]] > x[change[inner + 1]])] if inner.size else inner
    at = (change[top] + ends[top]) // 2
    if height is not None:
        at = at[x[at] >= height]
    if distance > 1 and at.size:
        kept = np.ones(at.size, dtype=bool)
        for j in np.argsort(x[at], kind="stable")[::-1]:  # from the highest on; of equal ones the last
            if kept[j]:
                near = np.arange(np.searchsorted(at, at[j] - distance, side="right"), np.searchsorted(at, at[j] + distance))
                kept[near[near != j]] = False
        at = at[kept]

    def lowest(step: int) -> np.ndarray:
        """The smallest sample between each place and the next higher one on one side."""
        low = np.empty(n)
        stack: list[tuple[float, float]] = []
        for i in range(n)[::step]:
            m = x[i]
            while stack and stack[-1][0] <= x[i]:
                m = min(m, stack.pop()[1])
            low[i] = m
            stack.append((x[i], m))
        return low

    if not at.size:
        return at, np.zeros(0)
    prom = x[at] - np.maximum(lowest(1)[at], lowest(-1)[at])
    if prominence is not None:
        at, prom = at[prom >= prominence], prom[prom >= prominence]
    return at, prom


def find_peaks(df: DataFrame, k: list[str], o: str, v: str, height: float | None = 0.1, distance: int = 1, prominence: float | None = 0.15) -> DataFrame:
    """(k, o, value, prominence) of the maxima, of a plateau the middle one, that reach the height, have no higher one closer than ``distance``, and stand out by the prominence.

    A series is one recording and is looked at as a whole, the series of a batch after one another; a null sample ends a rise and a fall.
    """

    first = F.row_number().over(Window.partitionBy(*k).orderBy(o)) == 1
    rows = df.select(*k, o, v).repartition(*k).sortWithinPartitions(*k, o).select(first.alias("_new"), *k, o, F.col(v).cast("double").alias("_v"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in W.whole_groups(batches):
            x = table.column("_v").to_numpy()
            low = np.where(np.isnan(x), -np.inf, x)
            ends = [*np.flatnonzero(table.column("_new").to_numpy()).tolist(), x.size]
            found = [(a, *_find(low[a:b], height, distance, prominence)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            at = np.concatenate([a + i for a, i, _ in found])
            out = table.select([*k, o]).take(pa.array(at)).append_column("value", pa.array(x[at])).append_column("prominence", pa.array(np.concatenate([p for _, _, p in found])))
            yield from out.to_batches()

    shape = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*k, o])
    return rows.mapInArrow(told, f"{shape}, value double, prominence double")


def peak_pipeline(df: DataFrame, k: list[str], o: str, v: str, baseline: dict | None = None, smooth: dict | None = None, algorithm: str = "differences", **options: float) -> DataFrame:
    """Peaks (k, o) of v after an optional rolling baseline and an optional polynomial smoothing, with the parameters as columns: transients (``differences``), or maxima of the series scaled to 0..1 (``maxima``)."""
    used, name = df.select(*k, o, F.col(v).cast("double").alias("_v")), "_v"
    if baseline is not None:
        used = W.rolling_baseline(used, k, o, name, baseline["width"], baseline["q"], out="_b").withColumn("_v", F.try_divide("_v", "_b")).drop("_b")
    if smooth is not None:
        used = polynomial_smooth(used, k, o, name, smooth["width"], smooth["order"], out="_p").withColumn("_v", F.col("_p")).drop("_p")
    ways: dict[str, Callable[[], DataFrame]] = {"differences": lambda: transients(used, k, o, name, **options), "maxima": lambda: find_peaks(_scaled(used, k), k, o, name, **options).select(*k, o)}
    found = ways[algorithm]()
    noted = {"algorithm": algorithm} | {f"baseline_{a}": b for a, b in (baseline or {}).items()} | {f"smooth_{a}": b for a, b in (smooth or {}).items()} | options
    return found.select(*k, o, *[F.lit(b).alias(a) for a, b in noted.items()])


def _scaled(df: DataFrame, k: list[str]) -> DataFrame:
    w = Window.partitionBy(*k)
    low, high = F.min("_v").over(w), F.max("_v").over(w)
    return df.withColumn("_v", F.when(high > low, (F.col("_v") - low) / (high - low)).otherwise(0.0))
