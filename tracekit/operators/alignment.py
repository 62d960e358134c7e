"""As-of joins and event-triggered extraction: one shuffle by key, union and windows, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, k: list[str], t: str, value: str, how: str = "nearest") -> DataFrame:
    """left (k, t, ...) with the time and ``value`` of right's row at or before (backward), at or after (forward), or nearest to t; on ties the earlier; null if none."""
    rest = [c for c in left.columns if c not in (*k, t)]
    a = left.select(*k, t, F.lit(1).alias("_s"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast("double").alias("_t"), F.struct(*rest if rest else [F.lit(0).alias("_")]).alias("_r"))
    b = right.groupBy(*k, t).agg(F.min(value).alias("_v")).select(*k, t, F.lit(0).alias("_s"), "_v", F.col(t).cast("double").alias("_t"), F.lit(None).cast(a.schema["_r"].dataType).alias("_r"))
    both = a.unionByName(b)
    # rows of right stand before those of left at the same time; looking forward, after them
    back = Window.partitionBy(*k).orderBy(t, "_s").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*k).orderBy(F.col(t).desc(), "_s").rowsBetween(Window.unboundedPreceding, 0)
    pick = lambda w: F.last(F.when(F.col("_t").isNotNull(), F.struct("_t", "_v")), ignorenulls=True).over(w)
    both = both.withColumn("_b", pick(back)).withColumn("_f", pick(ahead)).where("_s = 1")
    if how == "nearest":
        near = F.when(F.col("_f").isNull() | (F.col(t) - F.col("_b._t") <= F.col("_f._t") - F.col(t)), F.col("_b")).otherwise(F.col("_f"))
    else:
        near = F.col("_b" if how == "backward" else "_f")
    return both.withColumn("_n", near).select(*k, t, *[F.col("_r")[c].alias(c) for c in rest], F.col("_n._t").alias(f"{t}_found"), F.col("_n._v").alias(value))


def triggered(traces: DataFrame, events: DataFrame, k: list[str], frame: str, at: str, event: str, v: str, pre: int, post: int) -> DataFrame:
    """(k, event, rel, v): traces in [at + pre, at + post) of each event, rel counted from the first frame there is; frames cut off at the start shift."""
    wanted = events.select(*k, event, F.explode(F.sequence(F.col(at) + pre, F.col(at) + (post - 1))).alias(frame))
    got = wanted.where(F.col(frame) >= 0).join(traces.select(*k, frame, v), [*k, frame])
    return got.withColumn("rel", F.col(frame) - F.min(frame).over(Window.partitionBy(*k, event))).select(*k, event, "rel", v)


def near_centres(events: DataFrame, centres: DataFrame, kind: str, pos: str, centre: str, tolerance: float) -> DataFrame:
    """Events within ``tolerance`` of a centre of their kind."""
    return events.join(F.broadcast(centres), kind).where(F.abs(F.col(pos) - F.col(centre)) <= tolerance)


def paired_by_order(events: DataFrame, k: list[str], o: str, t: str, edge: str, start: str, stop: str) -> DataFrame:
    """(k, n, start, stop): the n-th start with the n-th stop of each key."""
    n = F.row_number().over(Window.partitionBy(*k).orderBy(o))
    a = events.where(F.col(edge) == start).withColumn("n", n).select(*k, "n", F.col(t).alias("start"))
    b = events.where(F.col(edge) == stop).withColumn("n", n).select(*k, "n", F.col(t).alias("stop"))
    return a.join(b, [*k, "n"])


def ordered_pairs(items: DataFrame, name: str) -> DataFrame:
    """(main, comp) of a short list of items with main before comp."""
    return items.select(F.col(name).alias("main")).join(F.broadcast(items.select(F.col(name).alias("comp"))), F.col("main") < F.col("comp"))


def interpolated(clock: DataFrame, source: DataFrame, k: list[str], t: str, v: str, out: str = "value") -> DataFrame:
    """clock (k, t, ...) with the straight line through the samples of ``source`` (k, t, v) around t; beyond the ends the line of the nearest two goes on. Null if a key has no two samples.

    One shuffle by key: each sample stands for the piece up to the next one, and clock rows take the piece before them, or else the one after.
    """
    w = Window.partitionBy(*k).orderBy(t)
    piece = F.struct(F.col(t).cast("double").alias("t0"), F.col(v).cast("double").alias("v0"), F.lead(t).over(w).cast("double").alias("t1"), F.lead(v).over(w).cast("double").alias("v1"))
    pieces = source.groupBy(*k, t).agg(F.min(v).alias(v)).withColumn("_p", piece).where("_p.t1 is not null")
    rest = [c for c in clock.columns if c not in (*k, t)]
    both = clock.withColumn("_s", F.lit(1)).unionByName(pieces.select(*k, t, "_p", F.lit(0).alias("_s")), allowMissingColumns=True)
    by = Window.partitionBy(*k).orderBy(t, "_s")
    before = F.last("_p", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(F.when(F.col("_s") == 0, F.struct(F.col(t).alias("_at"), "_p"))).over(Window.partitionBy(*k))
    both = both.withColumn("_b", before).withColumn("_f", first).where("_s = 1").withColumn("_p", F.coalesce("_b", "_f._p"))
    line = F.col("_p.v0") + (F.col(t) - F.col("_p.t0")) * (F.col("_p.v1") - F.col("_p.v0")) / (F.col("_p.t1") - F.col("_p.t0"))
    return both.select(*k, t, *rest, line.alias(out))


def trial_summary(trials: DataFrame, k: list[str], rel: str, v: str, onset: int) -> DataFrame:
    """(k, peak, rise, area): of each trial the largest value from ``onset`` on, that less the value at onset, and the sum from there; null without values."""
    after = F.when(F.col(rel) >= onset, F.nanvl(F.col(v), F.lit(None)))
    at = F.max(F.when(F.col(rel) == onset, F.col(v)))
    return trials.groupBy(*k).agg(F.max(after).alias("peak"), (F.max(after) - at).alias("rise"), F.sum(after).alias("area"))


def synced(low: DataFrame, high: DataFrame, k: list[str], t: str, pulses: DataFrame | None, start: str = "start", stop: str = "stop", name: str = "segment", width: float = 1.0) -> DataFrame:
    """(k, segment, t, index, t_high): inside each pulse interval (k, start, stop, segment), each low time's fractional place among the high times there, held at their ends, and the high time nearest to that place (half places to the even one). Without pulses all is one interval.

    Times of both clocks are put into intervals by an equi join on cells, and meet in one window by interval.
    """
    from tracekit.operators.segments import assigned

    if pulses is None:
        place = lambda df: df.select(*k, t).withColumn(name, F.lit(0))
    else:
        place = lambda df: assigned(df.select(*k, t).distinct(), pulses, k, [t], t, width, start, stop, name).where(F.col(name).isNotNull())
    keys = [*k, name]
    w = Window.partitionBy(*keys).orderBy(t)
    top = place(high).withColumn("_i", F.row_number().over(w) - 1)
    both = place(low).withColumn("_s", F.lit(1)).unionByName(top.withColumn("_s", F.lit(0)), allowMissingColumns=True)
    by = Window.partitionBy(*keys).orderBy(t, "_s")
    mark = F.when(F.col("_s") == 0, F.struct(F.col(t).alias("t"), F.col("_i").alias("i")))
    before = F.last(mark, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(mark, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("_b", before).withColumn("_a", after).where("_s = 1 and (_a is not null or _b is not null)")
    inside = F.col("_b.i") + (F.col(t) - F.col("_b.t")) / (F.col("_a.t") - F.col("_b.t"))
    index = F.when(F.col("_b").isNull(), F.col("_a.i")).when(F.col("_a").isNull() | (F.col("_a.i") == F.col("_b.i")), F.col("_b.i")).when(F.col(t) == F.col("_b.t"), F.col("_b.i")).otherwise(inside)
    out = both.select(*keys, t, index.cast("double").alias("index")).withColumn("_i", F.bround("index").cast("int"))
    return out.join(top.select(*keys, "_i", F.col(t).alias(f"{t}_high")), [*keys, "_i"]).drop("_i")


def attached(members: DataFrame, sessions: DataFrame, signals: DataFrame, cluster: str, session: str, entity: str) -> DataFrame:
    """Signals (session, entity, ...) of each cluster of members (cluster, session, entity), with one row of nulls for each of ``sessions`` in which it has no entity."""
    clusters = members.select(cluster).distinct().crossJoin(F.broadcast(sessions.select(session).distinct()))
    return clusters.join(members, [cluster, session], "left").join(signals, [session, entity], "left")
