"""Binned tuning curves against occupancy, their shuffle nulls, place fields and their reliability by lap.

Frames and spikes may carry key columns k (session, lap type): all steps keep keys apart. Without any, all frames are one clock.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracekit.operators import resampling


def valid_positions(frames: DataFrame, runs: DataFrame, k: list[str], t: str, width: float, excluded: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Frames (k, frame, t, lap, ...) that lie in a lap (number over 0) and in a running interval (k, start, stop, segment), are not excluded (k, frame), and for which some entity has a value (``known``, k and frame)."""
    from tracekit.operators.segments import assigned

    out = assigned(frames.where("lap > 0"), runs, k, ["frame"], t, width).where("segment is not null").drop("segment")
    if excluded is not None:
        out = out.join(excluded.select(*k, "frame").distinct(), [*k, "frame"], "left_anti")
    return out if known is None else out.join(known.select(*k, "frame").distinct(), [*k, "frame"], "left_semi")


def frame_interval(frames: DataFrame, k: list[str], t: str) -> DataFrame:
    """(k, dt): the median time from one frame to the next."""
    w = Window.partitionBy(*k).orderBy("frame") if k else Window.orderBy("frame")
    step = frames.select(*k, (F.lead(t).over(w) - F.col(t)).alias("_d"))
    return step.groupBy(*k).agg(F.median("_d").alias("dt"))


def occupancy(frames: DataFrame, dt: float | str, k: tuple[str, ...] = ()) -> DataFrame:
    """(k, bin, occupancy) of frames (k, bin, ...): their number times the interval, the median one of the time column ``dt`` names. Bins without frames are left out."""
    if not isinstance(dt, str):
        return frames.groupBy(*k, "bin").agg((F.count("*") * F.lit(dt)).alias("occupancy"))
    n = frames.groupBy(*k, "bin").agg(F.count("*").alias("_n"))
    step = frame_interval(frames, list(k), dt)
    both = n.join(step, list(k)) if k else n.crossJoin(F.broadcast(step))
    return both.select(*k, "bin", (F.col("_n") * F.col("dt")).alias("occupancy"))


def raw_rates(spikes: DataFrame, frames: DataFrame, occ: DataFrame, k: tuple[str, ...] = ()) -> DataFrame:
    """(k, entity, bin, occupancy, rate) of spikes (k, entity, frame) over frames (k, frame, bin): a dense grid of the entities and visited bins of each key, events over occupancy."""
    counts = spikes.join(frames.select(*k, "frame", "bin"), [*k, "frame"]).groupBy(*k, "entity", "bin").agg(F.count("*").alias("n"))
    entities = spikes.select(*k, "entity").distinct()
    grid = entities.join(occ, list(k)) if k else entities.crossJoin(F.broadcast(occ))
    return grid.join(counts, [*k, "entity", "bin"], "left").select(*k, "entity", "bin", "occupancy", (F.coalesce("n", F.lit(0)) / F.col("occupancy")).alias("rate"))


def rates_by_lap(spikes: DataFrame, frames: DataFrame, dt: float, k: tuple[str, ...] = ()) -> DataFrame:
    """(k, lap, entity, bin, rate): rates within each lap, over the bins that the lap visits, in one pass over all laps."""
    keys = (*k, "lap")
    placed = spikes.join(frames.select(*k, "frame", "lap"), [*k, "frame"])
    occ = occupancy(frames, dt, keys)
    counts = placed.join(frames.select(*k, "frame", "bin"), [*k, "frame"]).groupBy(*keys, "entity", "bin").agg(F.count("*").alias("n"))
    entities = spikes.select(*k, "entity").distinct()
    grid = occ.join(entities, list(k)) if k else occ.crossJoin(F.broadcast(entities))
    return grid.join(counts, [*keys, "entity", "bin"], "left").select(*keys, "entity", "bin", (F.coalesce("n", F.lit(0)) / F.col("occupancy")).alias("rate"))


def circular_smooth(curves: DataFrame, k: list[str], v: str, bins: int, kernel: list[float], out: str = "smooth") -> DataFrame:
    """Wrap-around convolution over bins 0 .. bins - 1; absent bins count as 0."""
    half = len(kernel) // 2
    spread = F.explode(F.array(*[F.struct(F.lit(j - half).alias("d"), F.lit(x).alias("w")) for j, x in enumerate(kernel)]))
    return curves.select(*k, "bin", v, spread.alias("s")).groupBy(*k, F.pmod(F.col("bin") + F.col("s.d"), F.lit(bins)).alias("bin")).agg(F.sum(F.col(v) * F.col("s.w")).alias(out))


def smoothed_rates(rates: DataFrame, occ: DataFrame, bins: int, kernel: list[float], k: tuple[str, ...] = ()) -> DataFrame:
    """(k, entity, bin, rate, occupancy): both smoothed around the circle."""
    r = circular_smooth(rates, [*k, "entity"], "rate", bins, kernel, "rate")
    return r.join(circular_smooth(occ, list(k), "occupancy", bins, kernel, "occupancy"), [*k, "bin"]).select(*k, "entity", "bin", "rate", "occupancy")


def spatial_information(rates: DataFrame, k: tuple[str, ...] = ()) -> DataFrame:
    """(k, entity, per_event, per_second) of rates (k, entity, bin, occupancy, rate)."""
    by = Window.partitionBy(*k, "entity")
    r = rates.withColumn("p", F.col("occupancy") / F.sum("occupancy").over(by)).withColumn("l", F.col("rate") / F.avg("rate").over(by)).where("l > 0")
    term = F.log2("l") * F.col("p")
    return r.groupBy(*k, "entity").agg(F.sum(F.col("l") * term).alias("per_event"), F.sum(F.col("rate") * term).alias("per_second"))


def circular_shuffles(spikes: DataFrame, frames: DataFrame, n: int, seed: int = 7, k: tuple[str, ...] = ()) -> DataFrame:
    """(k, shuffle, entity, bin, n): spikes of frames (k, frame, lap, bin) after the positions of each lap are rolled by a hashed offset, for each of n shuffles."""
    reached = resampling.shuffled_counts(spikes, frames, n, seed, k)
    return reached.select(*k, "entity", "bin", F.explode(F.arrays_zip("draws", "counts")).alias("d")).select(*k, F.col("d.draws").alias("shuffle"), "entity", "bin", F.col("d.counts").cast("long").alias("n"))


def null_percentile(real: DataFrame, null: DataFrame, n: int, p: float, k: tuple[str, ...] = ()) -> DataFrame:
    """(k, entity, bin, occupancy, rate, limit, null_mean, significant): real rates (k, entity, bin, occupancy, rate) against the percentile, between ranks as a line, over all n shuffles of null (k, shuffle, entity, bin, n).

    Shuffles that don't reach a bin count as 0 there: they are a number before the sorted counts of the others, at most n for each curve and bin, and no row.
    """
    held = null.groupBy(*k, "entity", "bin").agg(F.sort_array(F.collect_list(F.col("n").cast("double"))).alias("_s"), F.sum("n").alias("null_total"))
    place = p * (n - 1)
    low = int(place)
    at = lambda i: F.coalesce(F.get("_s", F.lit(i) - n + F.size("_s")), F.lit(0.0))
    value = at(low) + (at(min(low + 1, n - 1)) - at(low)) * F.lit(place - low)
    return _against(real, held.withColumn("null_limit", value).drop("_s"), n, k)


def _against(real: DataFrame, limits: DataFrame, n: int, k: tuple[str, ...]) -> DataFrame:
    both = real.join(limits, [*k, "entity", "bin"], "left")
    both = both.withColumn("limit", F.coalesce("null_limit", F.lit(0.0)) / F.col("occupancy")).withColumn("null_mean", F.coalesce("null_total", F.lit(0)) / n / F.col("occupancy"))
    return both.drop("null_limit", "null_total").withColumn("significant", F.col("rate") > F.col("limit"))


def shuffle_tested(real: DataFrame, spikes: DataFrame, frames: DataFrame, n: int, p: float, seed: int = 7, k: tuple[str, ...] = ()) -> DataFrame:
    """``null_percentile`` of real rates against n circular shuffles of the spikes, of which only the limits and means of bins leave a task."""
    return _against(real, resampling.shuffled_counts(spikes, frames, n, seed, k, "limits", p), n, k)


def peak_z_p(real: DataFrame, spikes: DataFrame, frames: DataFrame, n: int, v: str = "real", seed: int = 7, k: tuple[str, ...] = ()) -> DataFrame:
    """(k, entity, v, z, p): how far the largest count by bin (k, entity, v) is from those of n shuffles in their deviations, and the share of them that reach it."""
    both = real.join(resampling.shuffled_counts(spikes, frames, n, seed, k, "peaks"), [*k, "entity"])
    mean = F.aggregate("peaks", F.lit(0.0), lambda s, x: s + x) / n
    both = both.withColumn("_m", mean).withColumn("_d", F.sqrt(F.aggregate("peaks", F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m"))) / n))
    reach = F.size(F.filter("peaks", lambda x: x >= F.col(v))) / n
    return both.select(*k, "entity", v, ((F.col(v) - F.col("_m")) / F.nullif(F.col("_d"), F.lit(0.0))).alias("z"), reach.alias("p"))


def candidates(tested: DataFrame, least: int = 5, k: tuple[str, ...] = ()) -> DataFrame:
    """(k, entity, bins, candidate): significant bins of the curve twice around, and whether there are enough of them."""
    n = tested.groupBy(*k, "entity").agg((F.count_if("significant") * 2).alias("bins"))
    return n.withColumn("candidate", F.col("bins") >= least)


def circle_runs(on: np.ndarray) -> np.ndarray:
    """(start, length) of each unbroken stretch of a circle of bins; one that passes the last bin goes on at the first."""
    if on.all():
        return np.array([[0, on.size]] if on.size else np.zeros((0, 2)), dtype=int)
    turn = int(np.argmin(on))  # a bin that is off: seen from there, no stretch wraps
    step = np.diff(np.append(np.roll(on, -turn), False).astype(int), prepend=0)
    start = np.flatnonzero(step > 0)
    return np.stack([(start + turn) % on.size, np.flatnonzero(step < 0) - start], axis=1)


def fields_of(rate: np.ndarray, significant: np.ndarray, least: int = 5, times: float = 2.0) -> list[np.ndarray]:
    """Bins, in order around the circle, of each field of one curve; the longest first, of equal ones the one that starts later.

    A field is a whole stretch of at least ``least`` bins that are significant or over ``times`` the mean rate, of which as many lie in significant stretches of that length.
    Stretches of a circle cannot overlap, and one that passes the last bin is one field with all of its bins.
    """
    n = rate.size
    around = lambda start, length: np.arange(start, start + length) % n
    sure = np.zeros(n, dtype=bool)
    for start, length in circle_runs(significant):
        if length >= least:
            sure[around(start, length)] = True
    found = [around(start, length) for start, length in circle_runs(significant | (rate > times * np.nanmean(rate))) if length >= least]
    return sorted((f for f in found if sure[f].sum() >= least), key=lambda f: (f.size, f[0]), reverse=True)


def extract_fields(tested: DataFrame, bins: int, least: int = 5, times: float = 2.0, k: tuple[str, ...] = ()) -> DataFrame:
    """(k, entity, field, bins array, peak, peak_rate, best) of the place fields of tested curves (k, entity, bin, rate, significant), numbered from the longest; bins that a curve lacks have no rate and are not significant. The best is the one with the highest rate.

    A curve has a fixed number of bins, so one is looked at as a whole.
    """

    def told(rows: pd.DataFrame) -> pd.DataFrame:
        rate, sure = np.zeros(bins), np.zeros(bins, dtype=bool)
        rate[rows["bin"]], sure[rows["bin"]] = rows["rate"], rows["significant"]
        found = fields_of(rate, sure, least, times)
        top = [float(rate[f].max()) for f in found]
        head = [rows[c].iloc[0] for c in (*k, "entity")]
        return pd.DataFrame([(*head, i, f.tolist(), int(f[rate[f].argmax()]), top[i], i == int(np.argmax(top))) for i, f in enumerate(found)], columns=[*k, "entity", "field", "bins", "peak", "peak_rate", "best"])

    shape = ", ".join(f"`{c}` {tested.schema[c].dataType.simpleString()}" for c in (*k, "entity"))
    return tested.select(*k, "entity", "bin", "rate", "significant").groupBy(*k, "entity").applyInPandas(told, f"{shape}, field int, bins array<int>, peak int, peak_rate double, best boolean")


def lap_reliability(laps: DataFrame, fields: DataFrame, k: tuple[str, ...] = ()) -> DataFrame:
    """(k, entity, lap, strength): the mean, over the bins of the entity's fields (k, entity, bin), of each lap's rate over the lap's mean rate; null in laps without events."""
    mean = F.avg("rate").over(Window.partitionBy(*k, "entity", "lap"))
    rel = laps.withColumn("_r", F.when(mean > 0, F.col("rate") / mean))
    return rel.join(fields.select(*k, "entity", "bin").distinct(), [*k, "entity", "bin"]).groupBy(*k, "entity", "lap").agg(F.avg("_r").alias("strength"))


def reliability_summary(strengths: DataFrame, k: tuple[str, ...] = ()) -> DataFrame:
    """(k, entity, share, laps): the share and number of laps with a strength over 1."""
    over = F.coalesce(F.col("strength") > 1, F.lit(False))
    return strengths.groupBy(*k, "entity").agg(F.avg(over.cast("double")).alias("share"), F.count_if(over).alias("laps"))


def refined_fields(fields: DataFrame, summary: DataFrame, laps: int, share: float = 0.2, least: int = 2, k: tuple[str, ...] = ()) -> DataFrame:
    """The best fields of entities that have a strength over 1 in enough laps: the share of all ``laps``, rounded half to even, and ``least`` at least."""
    need = max(round(laps * share), least)
    return fields.where("best").join(summary.where(F.col("laps") >= need).select(*k, "entity"), [*k, "entity"])


def place_tuning(spikes: DataFrame, frames: DataFrame, dt: float, bins: int, kernel: list[float], n: int, p: float = 0.99, least: int = 5, k: tuple[str, ...] = ()) -> DataFrame:
    """(k, entity, field, bins, peak, peak_rate, share, laps): the whole chain, from frames (k, frame, lap, bin) and spikes (k, entity, frame) to the best fields of entities that are reliable from lap to lap."""
    from tracekit.sources.scratch import written

    occ = occupancy(frames, dt, k)
    real = written(raw_rates(spikes, frames, occ, k), "rates")
    tested = shuffle_tested(real, spikes, frames, n, p, k=k)
    some = candidates(tested, least, k).where("candidate").select(*k, "entity")
    fields = written(extract_fields(tested.join(some, [*k, "entity"], "left_semi"), bins, least, k=k), "fields")
    inside = fields.select(*k, "entity", F.explode("bins").alias("bin"))
    summary = reliability_summary(lap_reliability(rates_by_lap(spikes.join(fields.select(*k, "entity").distinct(), [*k, "entity"], "left_semi"), frames, dt, k), inside, k), k)
    laps = frames.select(*k, "lap").distinct().count()
    return refined_fields(fields, summary, laps, k=k).join(summary, [*k, "entity"]).drop("best")


def other_curves(curves: DataFrame, kinds: DataFrame, kind: str, reference: object) -> DataFrame:
    """Curves (.., kind, ...) of all kinds but the reference, with the condition's name (kind, name); kinds without a name are left out."""
    return curves.where(F.col(kind) != reference).join(F.broadcast(kinds), kind)


def field_window(cues: int, locations: int, stimulus: bool = False) -> tuple[int, int]:
    """The bins of peaks in the middle of the track, by the number of cues and of their locations."""
    if stimulus:
        return 40, 70
    if cues == 1 and locations in (1, 2):
        return (40, 65) if locations == 1 else (20, 70)
    return 11, 89
