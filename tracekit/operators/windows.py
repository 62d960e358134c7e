"""Windowed signals of keyed series: df has key columns k, an order column o and a value column v.

All frames are bounded unless a running state is the point, so a partition is one series and rows stream through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracekit.operators import ranges


def _by(k: list[str], o: str) -> WindowSpec:
    return Window.partitionBy(*k).orderBy(o)


def numbered(df: DataFrame, k: list[str], o: list[str], out: str = "frame") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*k).orderBy(*o)) - 1)


def running_mean(df: DataFrame, k: list[str], o: str, v: str, m: int, mode: str = "edge", out: str = "mean") -> DataFrame:
    """Centred mean of 2m+1 samples. Beyond the ends stand the first and last sample (edge), zeros (zero) or the series' mean (mean); a series no longer than the window has its mean."""
    if m == 0:
        return df.withColumn(out, F.col(v).cast("double"))
    whole = Window.partitionBy(*k)
    i, n = F.row_number().over(_by(k, o)) - 1, F.count("*").over(whole)
    total = F.sum(v).over(_by(k, o).rowsBetween(-m, m))
    before, after = F.greatest(F.lit(0), F.lit(m) - i), F.greatest(F.lit(0), i + F.lit(m + 1) - n)
    first, last = F.min_by(v, o).over(whole), F.max_by(v, o).over(whole)
    pad = {"edge": before * first + after * last, "zero": F.lit(0.0), "mean": (before + after) * F.avg(v).over(whole)}[mode]
    return df.withColumn(out, F.when(n <= 2 * m + 1, F.avg(v).over(whole)).otherwise((total + pad) / (2 * m + 1)))


def difference(df: DataFrame, k: list[str], o: str, v: str, boundary: str = "none", out: str = "diff") -> DataFrame:
    """First difference: null at the first row (none), 0 there (zero), 0 at the last (append), or the last repeated (repeat)."""
    w = _by(k, o)
    back, ahead = F.col(v) - F.lag(v).over(w), F.lead(v).over(w) - F.col(v)
    value = {"none": back, "zero": F.coalesce(back, F.lit(0.0)), "append": F.coalesce(ahead, F.lit(0.0)), "repeat": F.coalesce(ahead, back)}[boundary]
    return df.withColumn(out, value)


def sigma_threshold(df: DataFrame, k: list[str], o: str, v: str, times: float = 3.0) -> DataFrame:
    """(k, threshold): ``times`` the population deviation of the first differences."""
    return difference(df, k, o, v).groupBy(*k).agg((F.stddev_pop("diff") * times).alias("threshold"))


def minima_candidates(df: DataFrame, k: list[str], o: str, v: str, below: float | Column, n: str | None = None) -> DataFrame:
    """Local minima among the rows under ``below``, o counting samples from 0. Where such a run of rows ends its edge counts as a rise, but not at the ends of the series; of a plateau the first row counts.

    ``n`` names a column with the length of the series, if rows may be missing. A run that begins with sample 1 counts as beginning with the series.
    """
    w = _by(k, o)
    size = F.col(n) if n else F.max(o).over(Window.partitionBy(*k)) + 1
    low = df.withColumn("_size", size).where((F.col(v) < below) & ~F.isnan(F.col(v).cast("double")))
    before, after = F.lag(o).over(w), F.lead(o).over(w)
    left = F.when(before.isNull(), F.when(F.col(o) > 1, -1).otherwise(1)).when(F.col(o) - before > 1, -1).otherwise(F.signum(F.col(v) - F.lag(v).over(w)))
    right = F.when(after.isNull(), F.when(F.col("_size") - F.col(o) > 1, 1).otherwise(-1)).when(after - F.col(o) > 1, 1).otherwise(F.signum(F.lead(v).over(w) - F.col(v)))
    low = low.withColumn("_l", left).withColumn("_r", right)
    turn = F.first(F.when(F.col("_r") != 0, F.col("_r")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return low.withColumn("_r", turn).where("_l < 0 and _r > 0").drop("_l", "_r", "_size")


def sliding_zscore(df: DataFrame, k: list[str], o: str, v: str, half: int, out: str = "z") -> DataFrame:
    """(v - 20th percentile) / deviation over [i - half, i + half); a zero deviation is taken as the mean of the others."""
    return ranges.sliding_zscore(df, k, o, v, half, out)


def rolling_baseline(df: DataFrame, k: list[str], o: str, v: str, width: int, q: float, out: str = "baseline") -> DataFrame:
    """The quantile over [i - width/2, i + width/2), beyond the ends copies of the first and last sample."""
    return ranges.rolling_baseline(df, k, o, v, width, q, out)


def baselined(df: DataFrame, k: list[str], o: str, v: str, width: int = 500, q: float = 0.05, log: bool = False, from_zero: bool = False, out: str = "relative") -> DataFrame:
    """v over its rolling baseline, or less it with ``log``; with ``from_zero``, of v less its minimum."""
    if from_zero:
        df = df.withColumn(v, F.col(v) - F.min(v).over(Window.partitionBy(*k)))
    both = rolling_baseline(df, k, o, v, width, q, "_base")
    return both.withColumn(out, F.col(v) - F.col("_base") if log else F.try_divide(F.col(v).cast("double"), F.col("_base"))).drop("_base")


def weighted(df: DataFrame, k: list[str], o: str, v: str, kernel: list[float], first: int, out: str = "smooth", missing: float | None = 0.0) -> DataFrame:
    """Sum of kernel[j] * v[i + first + j]; beyond the ends, and for nulls, ``missing`` (null: the sum is null)."""
    w = _by(k, o)
    near = [F.lead(v, first + j).over(w) if first + j >= 0 else F.lag(v, -(first + j)).over(w) for j in range(len(kernel))]
    terms = [(x if missing is None else F.coalesce(x, F.lit(missing))) * F.lit(y) for x, y in zip(near, kernel, strict=True)]
    total: Column = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn(out, total)


def trimmed_convolution(df: DataFrame, k: list[str], o: str, v: str, kernel: list[float], out: str = "smooth") -> DataFrame:
    """The full convolution cut to the series' length: len(kernel) // 2 values go in front. Null in series no longer than the kernel."""
    back = len(kernel) // 2
    both = weighted(df, k, o, v, kernel[::-1], back - len(kernel) + 1, "_c")
    return both.withColumn(out, F.when(F.count("*").over(Window.partitionBy(*k)) > len(kernel), F.col("_c"))).drop("_c")


def decayed(df: DataFrame, k: list[str], o: str, v: str, kernel: list[float], first: int = 50, out: str = "smooth") -> DataFrame:
    """The filter of the kernel, centred on its middle, zero beyond the ends, and then the first samples replaced by sample ``first``."""
    return filled_leading(weighted(df, k, o, v, kernel, -(len(kernel) // 2), out), k, o, out, first)


def dejittered(df: DataFrame, k: list[str], o: str, t: str, millis: str, window: int = 200, least: float = 0.02, out: str = "t_adjusted") -> DataFrame:
    """t less what it is ahead of a second clock in milliseconds, where that is over ``least`` more than its running mean over 2 * window + 1 samples."""
    whole = Window.partitionBy(*k)
    ahead = F.col(t) - ((F.col(millis) - F.min_by(millis, o).over(whole)) / 1000 + F.min_by(t, o).over(whole))
    both = running_mean(df.withColumn("_a", ahead), k, o, "_a", window, out="_m").withColumn("_a", F.col("_a") - F.col("_m"))
    return both.withColumn(out, F.when(F.col("_a") > least, F.col(t) - F.col("_a")).otherwise(F.col(t))).drop("_a", "_m")


def frame_clock(frames: DataFrame, sync: DataFrame, k: list[str], t: str, on: str, from_zero: bool = False, out: str = "t_frame") -> DataFrame:
    """t of each frame after the time of the sync pulse ``on`` of its series; with ``from_zero``, t counts from the first frame and the last frame is left out."""
    both = frames.join(sync.select(*k, on), k)
    if not from_zero:
        return both.withColumn(out, F.col(t) + F.col(on)).drop(on)
    whole = Window.partitionBy(*k)
    last = F.row_number().over(whole.orderBy(F.desc(t))) == 1
    zero = both.withColumn("_z", F.min(t).over(whole)).withColumn("_last", last)
    return zero.where("not _last").withColumn(out, F.col(t) - F.col("_z") + F.col(on)).drop(on, "_z", "_last")


def filled_leading(df: DataFrame, k: list[str], o: str, v: str, n: int) -> DataFrame:
    """The first n samples replaced by sample n; a shorter series stays."""
    i = F.row_number().over(_by(k, o)) - 1
    both = df.withColumn("_i", i)
    nth = F.max(F.when(F.col("_i") == n, F.col(v))).over(Window.partitionBy(*k))
    return both.withColumn(v, F.when(F.col("_i") < n, F.coalesce(nth, F.col(v))).otherwise(F.col(v))).drop("_i")


def velocity(df: DataFrame, k: list[str], o: str, v: str, scale: float = 30.0, out: str = "velocity") -> DataFrame:
    return difference(df, k, o, v, "repeat", "_d").withColumn(out, F.abs("_d") * scale).drop("_d")


def rising_edges(df: DataFrame, k: list[str], o: str, v: str) -> DataFrame:
    """Rows whose rise (the first from 0) is over half the largest one."""
    d = df.withColumn("_d", F.col(v) - F.coalesce(F.lag(v).over(_by(k, o)), F.lit(0.0)))
    return d.withColumn("_m", F.max("_d").over(Window.partitionBy(*k))).where("_d > _m / 2").drop("_d", "_m")


def carried(df: DataFrame, k: list[str], o: str, columns: list[str]) -> DataFrame:
    """Nulls replaced by the last value before them."""
    w = _by(k, o).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def without_regress(df: DataFrame, k: list[str], o: str, t: str) -> DataFrame:
    """Without rows whose time is under a time before."""
    w = _by(k, o).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_m", F.max(t).over(w)).where(f"_m is null or {t} >= _m").drop("_m")


def lag1_autocorrelation(df: DataFrame, k: list[str], o: str, v: str) -> DataFrame:
    """(k, r): correlation of neighbours, 0 for a constant series."""
    n = df.withColumn("_n", F.lead(v).over(_by(k, o)))
    return n.groupBy(*k).agg(F.coalesce(F.nanvl(F.corr(v, "_n"), F.lit(0.0)), F.lit(0.0)).alias("r"))


def repaired_resets(df: DataFrame, k: list[str], o: str, v: str, drop: float = 100.0) -> DataFrame:
    """From the left, a sample that stands before a fall of more than ``drop`` and under the one before it is put on the line through the two before, as they are by then (of the second sample: through the last and the first).

    Falls are judged on the values as given. Samples to look at that are no more than two apart hang together: such a stretch is mended in order by an aggregate over its values, and all other samples stay as they are.
    """
    w = _by(k, o)
    look = F.coalesce(F.col(v) - F.lead(v).over(w) > drop, F.lit(False)) & (F.row_number().over(w) > 1)
    both = df.withColumn("_c", look).withColumn("_p", F.lag(v, 1).over(w)).withColumn("_q", F.coalesce(F.lag(v, 2).over(w), F.max_by(v, o).over(Window.partitionBy(*k))))
    both = both.withColumn("_in", F.col("_c") | (F.coalesce(F.lag("_c").over(w), F.lit(False)) & F.coalesce(F.lead("_c").over(w), F.lit(False))))
    both = both.withColumn("_g", F.sum((~F.col("_in")).cast("int")).over(w))
    each = F.struct(F.col(o).alias("o"), F.col(v).cast("double").alias("v"), F.col("_p").cast("double").alias("p"), F.col("_q").cast("double").alias("q"), F.col("_c").alias("c"))
    run = both.where("_in").groupBy(*k, "_g").agg(F.sort_array(F.collect_list(each)).alias("_r"))
    start = F.struct(F.element_at("_r", 1)["q"].alias("q"), F.element_at("_r", 1)["p"].alias("p"), F.array().cast(f"array<struct<o: {df.schema[o].dataType.simpleString()}, v: double>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = F.when(x["c"] & (x["v"] < s["p"]), s["p"] + (s["p"] - s["q"])).otherwise(x["v"])
        return F.struct(s["p"].alias("q"), new.alias("p"), F.concat(s["out"], F.array(F.struct(x["o"].alias("o"), new.alias("v")))).alias("out"))

    mended = run.select(*k, F.explode(F.aggregate("_r", start, step, lambda s: s["out"])).alias("_m")).select(*k, F.col("_m.o").alias(o), F.col("_m.v").alias("_v"))
    return df.join(mended, [*k, o], "left").withColumn(v, F.coalesce("_v", F.col(v).cast("double"))).drop("_v")


def survivors(at: np.ndarray, value: np.ndarray, gap: float, island: np.ndarray | None = None) -> np.ndarray:
    """Which candidates at rising places stay when pairs of neighbours closer than ``gap`` meet in rounds: of each pair of a round the larger leaves, of equal ones the first. Only those of one ``island``, numbers in order, meet.

    Of two close neighbours one leaves, so a round at least halves each chain of them. All islands take their rounds at once.
    """
    left = np.arange(at.size)
    while left.size > 1:
        a, b = left[:-1], left[1:]
        close = at[b] - at[a] < gap
        if island is not None:
            close &= island[a] == island[b]
        i = np.flatnonzero(close)
        if not i.size:
            break
        stays = np.ones(left.size, dtype=bool)
        stays[np.where(value[b[i]] > value[a[i]], i + 1, i)] = False
        left = left[stays]
    out = np.zeros(at.size, dtype=bool)
    out[left] = True
    return out


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task in tables of many whole groups; the first column tells where a group begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column(0).to_numpy(zero_copy_only=False))
        if starts.size:  # the last group may go on in the next batch
            done = pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
            if done.num_rows:
                yield done.combine_chunks()
            held, batch = [], batch.slice(starts[-1])
        held.append(batch)
    if held and (done := pa.Table.from_batches(held)).num_rows:
        yield done.combine_chunks()


def kept_apart(df: DataFrame, k: list[str], o: str, v: str, gap: float) -> DataFrame:
    """Of sparse candidates, as long as two neighbours are closer than ``gap``, the larger of each such pair goes, of equal ones the first; all pairs of a round at once.

    Candidates ``gap`` or more apart don't touch each other, so a task needs whole islands only; it thins those of a batch together.
    """
    names, schema = df.columns, df.schema
    by = Window.partitionBy(*k).orderBy(o)
    new = F.coalesce(F.col(o) - F.lag(o).over(by) >= gap, F.lit(True))
    islands = df.withColumn("_new", new).withColumn("_island", F.sum(F.col("_new").cast("int")).over(by))
    rows = islands.repartition(*k, "_island").sortWithinPartitions(*k, "_island", o).select("_new", *names)

    def thinned(table: pa.Table) -> Iterator[pa.RecordBatch]:
        stays = survivors(table.column(o).to_numpy(), table.column(v).to_numpy(), gap, np.cumsum(table.column("_new").to_numpy()))
        yield from table.select(names).filter(pa.array(stays)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches):
            yield from thinned(held)

    return rows.mapInArrow(run, schema)


def every_nth(df: DataFrame, k: list[str], o: str, n: int) -> DataFrame:
    """The first row of each series and each n-th one after it."""
    return numbered(df, k, [o], "_i").where(F.col("_i") % n == 0).drop("_i")


def maximum_scaled(df: DataFrame, k: list[str], v: str, out: str = "scaled") -> DataFrame:
    """v over its largest value in each series; where that is 0, v stays."""
    top = F.max(v).over(Window.partitionBy(*k))
    return df.withColumn(out, F.when(top != 0, F.col(v) / top).otherwise(F.col(v)))


def without_extreme_series(df: DataFrame, k: list[str], v: str, limit: float) -> DataFrame:
    """Without whole series that reach ``limit`` in size. Keys to drop are found by an aggregate, so no series is gathered."""
    return df.join(df.groupBy(*k).agg(F.max(F.abs(v)).alias("_m")).where(F.col("_m") >= limit).select(*k), k, "left_anti")
