"""Series cut into ranges: windows, quantiles, carried values and as-of joins of a series of any length in many tasks.

Rows are numbered within their series by one range sort over (keys, order): a series may span many partitions, and only the rows that a partition adds to the series it begins with
are told to the driver. A range is ``size`` rows in a row. What looks at neighbours gets copies of the rows within reach of a range (its halo); what looks back without
bound gets what the ranges before it end with.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracekit.operators.resampling import _arrow, _groups
from tracekit.sources.scratch import written

#: Rows of a range.
SIZE = 1 << 18


def numbered_series(df: DataFrame, k: list[str], o: list[str], out: str = "_i") -> DataFrame:
    """df with the place of each row in its series, from 0: a range sort, with the counts of series that go on from one partition to the next."""
    rows = written(df.orderBy(*k, *o).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    w = Window.partitionBy("_part", *k)
    rows = rows.withColumn("_first", F.min("_id").over(w))
    key = F.to_json(F.struct(F.lit(1).alias("a"), *k)) if k else F.lit("")
    # a row a partition: its first and last series, and the rows of its last one
    each = rows.groupBy("_part").agg(F.min_by(key, "_id").alias("head"), F.max_by(key, "_id").alias("tail"), (F.max("_id") - F.max_by("_first", "_id") + 1).alias("n")).orderBy("_part").collect()
    before, carry, last = [], 0, None
    for r in each:
        before.append((int(r["_part"]), carry if r["head"] == last else 0))
        carry = r["n"] + (carry if r["head"] == r["tail"] == last else 0)
        last = r["tail"]
    told = {p: n for p, n in before if n}
    start = F.col("_first") == F.shiftleft("_part", 33)
    more = F.coalesce(F.create_map(*[F.lit(x) for pair in told.items() for x in pair])[F.col("_part")], F.lit(0)) if told else F.lit(0)
    return rows.withColumn(out, F.col("_id") - F.col("_first") + F.when(start, more).otherwise(0)).drop("_id", "_part", "_first")


def in_ranges(df: DataFrame, i: str, before: int, after: int, size: int = SIZE) -> DataFrame:
    """df (.., i) with ``_range`` and ``_own``: each row in its own range, and a copy (not own) in every range that lies within reach: rows up to ``before`` ahead of it and ``after`` behind it look at it."""
    at = lambda c: F.floor(c / F.lit(size))
    seen = F.sequence(at(F.greatest(F.col(i) - after, F.lit(0))), at(F.col(i) + before))
    return df.withColumn("_range", F.explode(seen)).withColumn("_own", F.col("_range") == at(F.col(i)))


def by_ranges(df: DataFrame, k: list[str], o: str, before: int, after: int, run: Callable[[DataFrame, list[str]], DataFrame], size: int = SIZE) -> DataFrame:
    """``run`` (rows, keys), an operator that looks no further than ``before`` rows back and ``after`` ahead, over the ranges of each series. Ranges past a series' end are those of copies alone and go."""
    rows = in_ranges(numbered_series(df, k, [o]), "_i", before, after, size)
    return run(rows, [*k, "_range"]).where("_own").drop("_own", "_range", "_i")


def quantile_of(values: np.ndarray, before: int, after: int, q: float) -> np.ndarray:
    """The quantile, as a line between ranks, over the values from ``before`` back to ``after`` ahead of each; NaN counts as missing. The window is a sorted ring, so each step costs a search in it."""
    out = np.full(values.size, np.nan)
    ring: list[float] = []
    x = values.tolist()
    for k in range(min(after, values.size)):
        if x[k] == x[k]:
            insort(ring, x[k])
    for k in range(values.size):
        new, old = k + after, k - before - 1
        if new < len(x) and x[new] == x[new]:
            insort(ring, x[new])
        if old >= 0 and x[old] == x[old]:
            del ring[bisect_left(ring, x[old])]
        if ring:
            place = q * (len(ring) - 1)
            low = int(place)
            high = min(low + 1, len(ring) - 1)
            out[k] = ring[low] + (ring[high] - ring[low]) * (place - low)
    return out


def _quantiles(df: DataFrame, k: list[str], v: str, before: int, after: int, q: float, out: str, size: int) -> DataFrame:
    """df (k, _z, ...), _z the place of a row in its series from 0."""
    rows = in_ranges(df, "_z", before, after, size)
    keys = [*k, "_range"]
    names = [c for c in rows.columns if c not in keys and c != "_z"]
    rows = rows.select(*keys, "_z", *names).repartition(*keys).sortWithinPartitions(*keys, "_z")
    kept = [*k, *[c for c in names if c != "_own"]]
    shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + f", `{out}` double"
    schema = _arrow(rows, shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            rows_ = pa.Table.from_batches(held).combine_chunks()
            own = rows_.column("_own").to_numpy()
            if not own.any():
                return
            x = rows_.column(v).cast(pa.float64()).to_numpy()
            found = quantile_of(x, before, after, q)
            table = rows_.select(kept).append_column(out, pa.array(found, from_pandas=True)).filter(pa.array(own)).cast(schema)
            yield from table.to_batches()

        for key, part in _groups(batches, len(keys)):
            if key != at and held:
                yield from told()
                held = []
            at = key
            held.append(part)
        if held:
            yield from told()

    return rows.mapInArrow(run, shape)


# --- values carried forward, and as-of joins


def carried(df: DataFrame, k: list[str], o: list[str], columns: list[str], size: int = SIZE) -> DataFrame:
    """Nulls replaced by the last value before them in the order of ``o``, however long ago: each range begins with what the ranges before it end with."""
    rows = written(numbered_series(df, k, o).withColumn("_range", F.floor(F.col("_i") / size)), "ranges")
    by = [*k, "_range"]
    ends = rows.groupBy(*by).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))), F.when(F.col(c).isNotNull(), F.col("_i"))).alias(f"_e{n}") for n, c in enumerate(columns)])
    # a row a range of each series
    back = Window.partitionBy(*k).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, *[F.last(f"_e{n}", ignorenulls=True).over(back)["v"].alias(f"_b{n}") for n in range(len(columns))])
    ends = ends.withColumnsRenamed({c: f"_k{m}" for m, c in enumerate(by)})
    both = rows.join(ends, [rows[c].eqNullSafe(ends[f"_k{m}"]) for m, c in enumerate(by)], "left")
    w = Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return both.select(*[F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_b{columns.index(c)}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def asof(left: DataFrame, right: DataFrame, k: list[str], t: str, v: str, how: str = "backward", size: int = SIZE) -> DataFrame:
    """left with the time (t_found) and v of the row of right (k, t, v) last at or before its time (backward), first at or after it (forward), or nearest to it, the earlier of equally near ones; of right rows at one time the smallest v counts.

    ``alignment.asof`` for series of any length: the last row of right before a range is carried into it.
    """
    best = right.groupBy(*k, t).agg(F.min(v).alias("_v")).select(*k, t, F.struct(F.col(t).alias("t"), F.col("_v").alias("v")).alias("_r"))
    one = left.withColumn("_r", F.lit(None).cast(best.schema["_r"].dataType)).withColumn("_side", F.lit(1))
    both = one.unionByName(best.withColumn("_side", F.lit(0)), allowMissingColumns=True).withColumn("_back", F.col("_r")).withColumn("_ahead", F.col("_r")).withColumn("_t", -F.col(t))
    if how != "forward":
        both = carried(both, k, [t, "_side"], ["_back"], size)
    if how != "backward":
        both = carried(both, k, ["_t", "_side"], ["_ahead"], size)
    back, ahead = F.col("_back"), F.col("_ahead")
    if how == "nearest":
        found = F.when(ahead.isNull() | (F.col(t) - back["t"] <= ahead["t"] - F.col(t)), back).otherwise(ahead)
    else:
        found = back if how == "backward" else ahead
    return both.where("_side = 1").withColumn("_f", found).select(*left.columns, F.col("_f.t").alias(f"{t}_found"), F.col("_f.v").alias(v))


# --- windowed signals


def running_mean(df: DataFrame, k: list[str], o: str, v: str, m: int, out: str = "mean", size: int = SIZE) -> DataFrame:
    """The centred mean of 2m+1 samples of ``windows.running_mean``, the first and last sample standing beyond the ends, in ranges."""
    ends = df.groupBy(*k).agg(F.count("*").alias("_n"), F.min_by(v, o).alias("_a"), F.max_by(v, o).alias("_b"), F.avg(v).alias("_m"))
    rows = numbered_series(df, k, [o])
    spread = in_ranges(rows, "_i", m, m, size)
    w = Window.partitionBy(*k, "_range").orderBy("_i").rowsBetween(-m, m)
    both = spread.withColumn("_t", F.sum(v).over(w)).where("_own")
    # a row a series: a hot one is a single row to all of its own, and skewed joins are split
    both = both.join(ends, k) if k else both.crossJoin(F.broadcast(ends))
    before, after = F.greatest(F.lit(0), F.lit(m) - F.col("_i")), F.greatest(F.lit(0), F.col("_i") + F.lit(m + 1) - F.col("_n"))
    mean = (F.col("_t") + before * F.col("_a") + after * F.col("_b")) / (2 * m + 1)
    return both.select(*df.columns, F.when(F.col("_n") <= 2 * m + 1, F.col("_m")).otherwise(mean).alias(out))


def weighted(df: DataFrame, k: list[str], o: str, v: str, kernel: list[float], first: int, out: str = "smooth", size: int = SIZE) -> DataFrame:
    """``windows.weighted`` in ranges."""
    from tracekit.operators.windows import weighted as whole

    reach = max(0, -first), max(0, first + len(kernel) - 1)
    return by_ranges(df, k, o, *reach, lambda rows, keys: whole(rows, keys, "_i", v, kernel, first, out), size)


def rolling_baseline(df: DataFrame, k: list[str], o: str, v: str, width: int, q: float, out: str = "baseline", size: int = SIZE) -> DataFrame:
    """The quantile over [i - width/2, i + width/2), beyond the ends copies of the first and last sample."""
    half = width // 2
    ends = df.groupBy(*k).agg(F.min(F.struct(o, v)).alias("_a"), F.max(F.struct(o, v)).alias("_b"), F.count("*").alias("_n"))
    reach = F.sequence(F.lit(1), F.lit(half))
    halo = ends.select(*k, F.explode(reach).alias("_j"), "_a", "_b", "_n")
    side = F.explode(F.array(F.struct((half - F.col("_j")).alias("z"), F.col(f"_a.{v}").alias("v")), F.struct((F.col("_n") + half - 1 + F.col("_j")).alias("z"), F.col(f"_b.{v}").alias("v"))))
    halo = halo.select(*k, side.alias("h")).select(*k, F.col("h.z").alias("_z"), F.col("h.v").alias(v), F.lit(True).alias("_halo"))
    rows = numbered_series(df, k, [o], "_z").withColumn("_z", F.col("_z") + half).withColumn("_halo", F.lit(False))
    both = rows.unionByName(halo, allowMissingColumns=True)
    return _quantiles(both, k, v, half, half - 1, q, out, size).where("not _halo").select(*df.columns, out)


def sliding_zscore(df: DataFrame, k: list[str], o: str, v: str, half: int, out: str = "z", size: int = SIZE) -> DataFrame:
    """(v - 20th percentile) / deviation over [i - half, i + half); a zero deviation is taken as the mean of the others."""
    rows = numbered_series(df, k, [o], "_z")
    low = _quantiles(rows.withColumn("_p", F.col("_z")), k, v, half, half - 1, 0.2, "_q", size).withColumnRenamed("_p", "_i")
    spread = in_ranges(low, "_i", half, half - 1, size)
    w = Window.partitionBy(*k, "_range").orderBy("_i").rowsBetween(-half, half - 1)
    both = written(spread.withColumn("_s", F.stddev_pop(v).over(w)).where("_own").drop("_own", "_range", "_i"), "deviations")
    usual = both.groupBy(*k).agg(F.avg(F.when(F.col("_s") > 0, F.col("_s"))).alias("_u"))
    both = both.join(usual, k) if k else both.crossJoin(F.broadcast(usual))
    both = both.withColumn("_s", F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.col("_u")))
    return both.select(*df.columns, F.try_divide(F.col(v) - F.col("_q"), F.col("_s")).alias(out))
