"""Operators over the given tables, each with the DuckDB SQL for the same rows. Doubles are rounded to 6 places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.functions import scalars as S
from tracekit.operators import alignment as A
from tracekit.operators import groups as G
from tracekit.operators import models as M
from tracekit.operators import ranges, resampling
from tracekit.operators import segments as E
from tracekit.operators import tuning as T
from tracekit.operators import windows as W
from tracekit.plans import fixtures as V
from tracekit.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
#: Draws of the queries that SQL checks.
DRAWS = 1000
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def r(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# --- tuning: the flagship chain

_RATES = """#occ AS (SELECT bin, count(*) * 0.1 AS occupancy FROM frames GROUP BY bin),
rates AS (SELECT entity, bin, occupancy, coalesce(n, 0) / occupancy AS rate FROM (SELECT DISTINCT entity FROM spikes) CROSS JOIN occ
          LEFT JOIN (SELECT entity, bin, count(*) AS n FROM spikes JOIN frames USING (frame) GROUP BY ALL) USING (entity, bin))"""


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    f = V.frames(spark, sf)
    return T.raw_rates(V.spikes(spark, sf), f.select("frame", "bin"), T.occupancy(f, 0.1))


@query("t11_spatial_information", V.over("frames", "spikes", body=_RATES + """,
p AS (SELECT *, occupancy / sum(occupancy) OVER (PARTITION BY entity) AS p, rate / avg(rate) OVER (PARTITION BY entity) AS l FROM rates)
SELECT entity, round(sum(l * log2(l) * p), 6) AS per_event, round(sum(rate * log2(l) * p), 6) AS per_second FROM p WHERE l > 0 GROUP BY entity"""))
def t11(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.spatial_information(_rates(spark, sf)))


@query("t2_occupancy", V.over("frames", body="SELECT bin, round(count(*) * 0.1, 6) AS occupancy FROM frames GROUP BY bin"))
def t2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.occupancy(V.frames(spark, sf), 0.1))


@query("t4_raw_rates", V.over("frames", "spikes", body=_RATES + " SELECT entity, bin, round(occupancy, 6) AS occupancy, round(rate, 6) AS rate FROM rates"))
def t4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_rates(spark, sf))


_KERNEL = S.gaussian_kernel(10)
_KSQL = "(VALUES " + ", ".join(f"({j - 5}, {x!r}::DOUBLE)" for j, x in enumerate(_KERNEL)) + ") AS k(d, w)"


@query("t5_smoothed_rates", V.over("frames", "spikes", body=_RATES + f" SELECT entity, (bin + d + 100) % 100 AS bin, round(sum(rate * w), 6) AS smooth FROM rates, {_KSQL} GROUP BY ALL"))
def t5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.circular_smooth(_rates(spark, sf), ["entity"], "rate", 100, _KERNEL))


@query("t6_rates_by_lap", V.over("frames", "spikes", body="SELECT entity, lap, bin, count(*) AS n FROM spikes JOIN frames USING (frame) GROUP BY ALL"))
def t6(spark: SparkSession, sf: str) -> DataFrame:
    return V.spikes(spark, sf).join(V.frames(spark, sf), "frame").groupBy("entity", "lap", "bin").agg(F.count("*").alias("n"))


_SHUFFLES = """#placed AS (SELECT frame, lap, bin, row_number() OVER (PARTITION BY lap ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY lap) AS length FROM frames),
drawn AS (SELECT shuffle, entity, lap, length, i - (CAST('0x' || substr(md5('7-' || shuffle || '-' || lap), 1, 8) AS BIGINT) % length) AS j FROM spikes JOIN placed USING (frame), unnest(range(1, 1001)) AS u(shuffle)),
nulls AS (SELECT shuffle, entity, p.bin, count(*) AS n FROM drawn d JOIN placed p ON p.lap = d.lap AND p.i = ((d.j % d.length) + d.length) % d.length GROUP BY ALL)"""


@query("t8_circular_shuffle", V.over("frames", "spikes", body=_SHUFFLES + " SELECT entity, bin, count(*) AS reached, CAST(sum(n) AS BIGINT) AS total, max(n) AS most, CAST(sum(shuffle * n) AS BIGINT) AS mark FROM nulls GROUP BY ALL"))
def t8(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each entity and bin tells of all draws: how many reach it, their spikes in all and at most, and a sum over draws and counts that marks which."""
    return resampling.shuffled_counts(V.spikes(spark, sf), V.frames(spark, sf), DRAWS, told="marks")


@query("t9_null_percentile", V.over("frames", "spikes", body=_RATES + ", " + _SHUFFLES[1:] + """,
lim AS (SELECT entity, bin, quantile_cont(coalesce(n, 0) / occupancy, 0.99) AS lim, avg(coalesce(n, 0) / occupancy) AS null_mean FROM rates CROSS JOIN unnest(range(1, 1001)) AS u(shuffle) LEFT JOIN nulls USING (shuffle, entity, bin) GROUP BY ALL)
SELECT entity, bin, round(rate, 6) AS rate, round(lim, 6) AS "limit", round(null_mean + 1e-9, 6) AS null_mean, rate > lim AS significant FROM rates JOIN lim USING (entity, bin)"""))
def t9(spark: SparkSession, sf: str) -> DataFrame:
    tested = T.shuffle_tested(_rates(spark, sf), V.spikes(spark, sf), V.frames(spark, sf), DRAWS, 0.99)
    return rounded(tested.drop("occupancy").withColumn("null_mean", F.col("null_mean") + 1e-9))  # means end on a half of the last place


# --- windows


@query("w1_running_mean", V.over("traces", body="""#n AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n, avg(value) OVER (PARTITION BY entity) AS a, sum(value) OVER (PARTITION BY entity ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s,
 first_value(value) OVER (PARTITION BY entity ORDER BY frame) AS f, last_value(value) OVER (PARTITION BY entity ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM traces)
SELECT entity, frame, round(CASE WHEN n <= 11 THEN a ELSE (s + greatest(0, 5 - frame) * f + greatest(0, frame + 6 - n) * l) / 11 END, 6) AS mean FROM n"""))
def w1(spark: SparkSession, sf: str) -> DataFrame:
    return W.running_mean(V.traces(spark, sf), ["entity"], "frame", "value", 5).select("entity", "frame", r("mean"))


@query("w2_difference", V.over("traces", body="SELECT entity, frame, round(coalesce(value - lag(value) OVER (PARTITION BY entity ORDER BY frame), 0), 6) AS diff FROM traces"))
def w2(spark: SparkSession, sf: str) -> DataFrame:
    return W.difference(V.traces(spark, sf), ["entity"], "frame", "value", "zero").select("entity", "frame", r("diff"))


@query("w3_sigma_threshold", V.over("traces", body="SELECT entity, round(3 * stddev_pop(d), 6) AS threshold FROM (SELECT entity, value - lag(value) OVER (PARTITION BY entity ORDER BY frame) AS d FROM traces) GROUP BY entity"))
def w3(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(W.sigma_threshold(V.traces(spark, sf), ["entity"], "frame", "value"))


_MINIMA = """#n AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM traces),
b AS (SELECT *, lag(frame) OVER w AS pf, lag(value) OVER w AS pv, lead(frame) OVER w AS nf, lead(value) OVER w AS nv FROM n WHERE value < 100 WINDOW w AS (PARTITION BY entity ORDER BY frame)),
s AS (SELECT *, CASE WHEN pf IS NULL THEN CASE WHEN frame > 1 THEN -1 ELSE 1 END WHEN frame - pf > 1 THEN -1 ELSE sign(value - pv) END AS l, CASE WHEN nf IS NULL THEN
CASE WHEN n - frame > 1 THEN 1 ELSE -1 END WHEN nf - frame > 1 THEN 1 ELSE sign(nv - value) END AS r FROM b),
t AS (SELECT *, first_value(CASE WHEN r <> 0 THEN r END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rr FROM s)
SELECT entity, frame, round(value, 6) AS value FROM t WHERE l < 0 AND rr > 0"""


@query("w4_minima_candidates", V.over("traces", body=_MINIMA))
def w4(spark: SparkSession, sf: str) -> DataFrame:
    return W.minima_candidates(V.traces(spark, sf), ["entity"], "frame", "value", 100).select("entity", "frame", r("value"))


@query("w4_local_minima")
def w4b(spark: SparkSession, sf: str) -> DataFrame:
    c = W.minima_candidates(V.traces(spark, sf), ["entity"], "frame", "value", 100).select("entity", "frame", "value")
    return rounded(W.kept_apart(c, ["entity"], "frame", "value", 5))


@query("w8_rolling_baseline", V.over("traces", body="""#e AS (SELECT entity, min(frame) AS a, max(frame) AS b, arg_min(value, frame) AS va, arg_max(value, frame) AS vb FROM traces GROUP BY 1),
p AS (SELECT entity, frame, value, TRUE AS keep FROM traces UNION ALL SELECT entity, a - j, va, FALSE FROM e, unnest(range(1, 26)) AS u(j) UNION ALL SELECT entity, b + j, vb, FALSE FROM e, unnest(range(1, 26)) AS u(j)),
q AS (SELECT *, quantile_cont(value, 0.1) OVER (PARTITION BY entity ORDER BY frame ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) AS baseline FROM p) SELECT entity, CAST(frame AS INT) AS frame, round(baseline, 6) AS baseline FROM q WHERE keep"""))
def w8(spark: SparkSession, sf: str) -> DataFrame:
    t = V.traces(spark, sf).withColumn("frame", F.col("frame").cast("int"))
    return W.rolling_baseline(t, ["entity"], "frame", "value", 50, 0.1).select("entity", "frame", r("baseline"))


@query("w11_sliding_zscore", V.over("traces", body="""#q AS (SELECT *, quantile_cont(value, 0.2) OVER w AS q, stddev_pop(value) OVER w AS s FROM traces WINDOW w AS (PARTITION BY entity ORDER BY frame ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)),
u AS (SELECT *, avg(CASE WHEN s > 0 THEN s END) OVER (PARTITION BY entity) AS m FROM q) SELECT entity, frame, round((value - q) / CASE WHEN s > 0 THEN s ELSE m END, 6) AS z FROM u"""))
def w11(spark: SparkSession, sf: str) -> DataFrame:
    return W.sliding_zscore(V.traces(spark, sf), ["entity"], "frame", "value", 10).select("entity", "frame", r("z"))


def _fir(kernel: list[float], first: int) -> str:
    terms = [f"coalesce(lead(value, {first + j}) OVER w, 0) * {x!r}::DOUBLE" for j, x in enumerate(kernel)]
    return V.over("traces", body=f"SELECT entity, frame, round({' + '.join(terms)}, 6) AS smooth FROM traces WINDOW w AS (PARTITION BY entity ORDER BY frame)")


@query("w12_gauss_smooth", _fir(S.gaussian_kernel(6), -3))
def w12(spark: SparkSession, sf: str) -> DataFrame:
    return W.weighted(V.traces(spark, sf), ["entity"], "frame", "value", S.gaussian_kernel(6), -3).select("entity", "frame", r("smooth"))


_DECAYED = _fir(S.decay_kernel(3), -9)


@query("w13_decay_filter", f"WITH s AS ({_DECAYED}) SELECT entity, frame, CASE WHEN frame < 20 THEN coalesce(max(CASE WHEN frame = 20 THEN smooth END) OVER (PARTITION BY entity), smooth) ELSE smooth END AS smooth FROM s")
def w13(spark: SparkSession, sf: str) -> DataFrame:
    return W.decayed(V.traces(spark, sf), ["entity"], "frame", "value", S.decay_kernel(3), 20).select("entity", "frame", r("smooth"))


@query("w14_event_rate", "SELECT user_id AS entity, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate FROM events GROUP BY 1")
def w14(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "events").groupBy(F.col("user_id").alias("entity")).agg(r(F.count_if(F.col("event_type") == "error") / F.count("*"), "rate"))


@query("w17_velocity", V.over("traces", body="SELECT entity, frame, round(30 * abs(coalesce(lead(value) OVER w - value, value - lag(value) OVER w)), 6) AS velocity FROM traces WINDOW w AS (PARTITION BY entity ORDER BY frame)"))
def w17(spark: SparkSession, sf: str) -> DataFrame:
    return W.velocity(V.traces(spark, sf), ["entity"], "frame", "value").select("entity", "frame", r("velocity"))


@query("w19_rising_edges", V.over("traces", body="#d AS (SELECT *, value - coalesce(lag(value) OVER (PARTITION BY entity ORDER BY frame), 0) AS d FROM traces), m AS (SELECT *, max(d) OVER (PARTITION BY entity) AS m FROM d) SELECT entity, frame FROM m WHERE d > m / 2"))
def w19(spark: SparkSession, sf: str) -> DataFrame:
    return W.rising_edges(V.traces(spark, sf), ["entity"], "frame", "value").select("entity", "frame")


@query("w23_carry_state", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS state FROM events")
def w23(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("state"))
    return W.carried(e, ["user_id"], "event_id", ["state"]).select("event_id", "state")


@query("w24_drop_time_regress", "SELECT event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NULL OR value >= m")
def w24(spark: SparkSession, sf: str) -> DataFrame:
    return W.without_regress(V.table(spark, sf, "events"), ["user_id"], "event_id", "value").select("event_id", "value")


@query("w25_fill_leading", V.over("traces", body="SELECT entity, frame, CASE WHEN frame < 30 THEN coalesce(max(CASE WHEN frame = 30 THEN value END) OVER (PARTITION BY entity), value) ELSE value END AS value FROM traces"))
def w25(spark: SparkSession, sf: str) -> DataFrame:
    return W.filled_leading(V.traces(spark, sf), ["entity"], "frame", "value", 30).select("entity", "frame", "value")


@query("w26_lag1_autocorrelation", V.over("traces", body="SELECT entity, round(coalesce(corr(value, n), 0), 6) AS r FROM (SELECT *, lead(value) OVER (PARTITION BY entity ORDER BY frame) AS n FROM traces) GROUP BY entity"))
def w26(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(W.lag1_autocorrelation(V.traces(spark, sf), ["entity"], "frame", "value"))


# --- segments


_RUNS = "#f AS (SELECT *, frame - row_number() OVER (PARTITION BY entity ORDER BY frame) AS g FROM traces WHERE value >= 200) SELECT entity, min(frame) AS start, max(frame) AS stop, count(*) AS length FROM f GROUP BY entity, g"


@query("g1_suprathreshold_runs", V.over("traces", body=_RUNS))
def g1(spark: SparkSession, sf: str) -> DataFrame:
    return E.runs(V.traces(spark, sf).withColumn("on", F.col("value") >= 200), ["entity"], "frame", "on")


@query("g2_laps_by_reset", """WITH e AS (SELECT user_id AS entity, event_id AS frame, (epoch_us(ts) % 86400000000) / 86400000000.0::DOUBLE AS pos FROM events),
d AS (SELECT *, CASE WHEN coalesce(lag(pos) OVER (PARTITION BY entity ORDER BY frame) - pos, 0) >= 0.5 THEN 1 ELSE 0 END AS r FROM e),
l AS (SELECT *, CAST(sum(r) OVER (PARTITION BY entity ORDER BY frame) AS BIGINT) AS lap FROM d) SELECT entity, lap, min(frame) AS start, max(frame) AS stop, count(*) AS length FROM l GROUP BY entity, lap""")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    f = V.spikes(spark, sf).join(V.frames(spark, sf).select("frame", "pos"), "frame")
    return E.lap_epochs(E.laps_by_reset(f, ["entity"], "frame", "pos"), ["entity"], "frame")


@query("g6_filter_epochs", V.over("intervals", body="SELECT entity, segment, round(start, 6) AS start, round(stop, 6) AS stop FROM intervals WHERE stop - start > 86400"))
def g6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.long_epochs(V.intervals(spark, sf).select("entity", "segment", "start", "stop"), 86400))


@query("g7_complement_epochs", V.over("intervals", body="""#e AS (SELECT entity, start + 1000 AS start, stop FROM intervals WHERE segment % 2 = 0 AND stop - start > 1000),
g AS (SELECT entity, coalesce(lag(stop) OVER (PARTITION BY entity ORDER BY start), 0) AS a, start AS b FROM e UNION ALL SELECT entity, max(stop), 1800000000 FROM e GROUP BY entity)
SELECT entity, round(a, 6) AS start, round(b, 6) AS stop FROM g WHERE b - a > 500"""))
def g7(spark: SparkSession, sf: str) -> DataFrame:
    e = V.intervals(spark, sf).where("segment % 2 = 0 and stop - start > 1000").withColumn("start", F.col("start") + 1000).withColumn("until", F.lit(1.8e9))
    return rounded(E.complement(e, ["entity"], "until", 500))


@query("g8_onset_windows", V.over("intervals", body="""#e AS (SELECT *, start - lag(stop) OVER (PARTITION BY entity ORDER BY start) AS g FROM intervals WHERE segment % 2 = 0)
SELECT entity, round(start - 300, 6) AS lo, round(start + 300, 6) AS hi FROM e WHERE g > 3600 AND stop - start > 3600"""))
def g8(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.onset_windows(V.intervals(spark, sf).where("segment % 2 = 0"), ["entity"], 300, 3600))


@query("g10_label_halves", V.over("traces", body="SELECT entity, frame, CASE WHEN row_number() OVER (PARTITION BY entity ORDER BY frame) <= count(*) OVER (PARTITION BY entity) // 2 THEN 'a' ELSE 'b' END AS context FROM traces"))
def g10(spark: SparkSession, sf: str) -> DataFrame:
    return E.labelled_halves(V.traces(spark, sf), ["entity"], "frame", "a", "b").select("entity", "frame", "context")


@query("g11_epoch_means", V.over("traces", "intervals", body="#s AS (SELECT t.entity, t.frame, t.value, max(i.segment) AS segment FROM traces t JOIN intervals i ON t.entity = i.entity AND t.t BETWEEN i.start AND i.stop GROUP BY ALL) SELECT entity, segment, round(avg(value), 6) AS mean FROM s GROUP BY ALL"))
def g11(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.epoch_means(V.traces(spark, sf), V.intervals(spark, sf), ["entity"], ["frame"], "t", "value", 86400.0))


# --- joins


@query("j1_assign_segment", V.over("traces", "intervals", body="SELECT t.entity, t.frame, max(i.segment) AS segment FROM traces t LEFT JOIN intervals i ON t.entity = i.entity AND t.t BETWEEN i.start AND i.stop GROUP BY ALL"))
def j1(spark: SparkSession, sf: str) -> DataFrame:
    return E.assigned(V.traces(spark, sf), V.intervals(spark, sf), ["entity"], ["frame"], "t", 86400.0).select("entity", "frame", "segment")


_TWO = "#a AS (SELECT user_id AS entity, event_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'click'), b AS (SELECT user_id AS entity, epoch_us(ts) / 1e6 AS t, min(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL)"


def _asof(how: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = V.events(spark, sf).withColumn("t", F.col("us") / 1e6).withColumn("entity", F.col("user_id"))
        a = e.where("event_type = 'click'").select("entity", "t", "event_id")
        return A.asof(a, e.where("event_type = 'purchase'").select("entity", "t", "value"), ["entity"], "t", "value", how).select("event_id", r("t_found"), r("value"))

    return run


def _asof_sql(how: str) -> str:
    cond, order = {"nearest": ("TRUE", "abs(a.t - b.t), b.t"), "backward": ("b.t <= a.t", "b.t DESC"), "forward": ("b.t >= a.t", "b.t")}[how]
    return "WITH " + _TWO[1:] + f", m AS (SELECT event_id, b.t AS t_found, value, row_number() OVER (PARTITION BY event_id ORDER BY {order}) AS k FROM a JOIN b ON a.entity = b.entity AND {cond}) SELECT a.event_id, round(t_found, 6) AS t_found, round(value, 6) AS value FROM a LEFT JOIN m ON a.event_id = m.event_id AND k = 1"


def _asof_ranges(how: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = V.events(spark, sf).withColumn("t", F.col("us") / 1e6).withColumn("entity", F.col("user_id"))
        a = e.where("event_type = 'click'").select("entity", "t", "event_id")
        return ranges.asof(a, e.where("event_type = 'purchase'").select("entity", "t", "value"), ["entity"], "t", "value", how).select("event_id", r("t_found"), r("value"))

    return run


for _how, _id in (("nearest", "j3_asof_nearest_ranges"), ("backward", "j4_asof_backward_ranges"), ("forward", "j4_asof_forward_ranges")):
    query(_id, _asof_sql(_how))(_asof_ranges(_how))


@query("w1_running_mean_ranges", SQL["w1_running_mean"])
def w1_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.running_mean(V.traces(spark, sf), ["entity"], "frame", "value", 5).select("entity", "frame", r("mean"))


@query("w12_gauss_smooth_ranges", SQL["w12_gauss_smooth"])
def w12_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.weighted(V.traces(spark, sf), ["entity"], "frame", "value", S.gaussian_kernel(6), -3).select("entity", "frame", r("smooth"))


@query("w23_carry_state_ranges", SQL["w23_carry_state"])
def w23_ranges(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("state"))
    return ranges.carried(e, ["user_id"], ["event_id"], ["state"]).select("event_id", "state")


for _how, _id in (("nearest", "j3_asof_nearest"), ("backward", "j4_asof_backward"), ("forward", "j4_asof_forward")):
    query(_id, _asof_sql(_how))(_asof(_how))


@query("j5_trigger_align", V.over("traces", body="""#e AS (SELECT entity, frame AS f0, row_number() OVER (PARTITION BY entity ORDER BY frame) AS event_no FROM traces WHERE value > 480),
w AS (SELECT e.entity, event_no, t.frame, value FROM e JOIN traces t ON t.entity = e.entity AND t.frame >= f0 - 5 AND t.frame < f0 + 10)
SELECT entity, event_no, frame - min(frame) OVER (PARTITION BY entity, event_no) AS rel, round(value, 6) AS value FROM w"""))
def j5(spark: SparkSession, sf: str) -> DataFrame:
    t = V.traces(spark, sf)
    e = W.numbered(t.where("value > 480"), ["entity"], ["frame"], "n").select("entity", F.col("frame").alias("at"), (F.col("n") + 1).alias("event_no"))
    return rounded(A.triggered(t, e, ["entity"], "frame", "at", "event_no", "value", -5, 10))


@query("j6_match_positions", "WITH c AS (SELECT * FROM (VALUES ('purchase', 0.25), ('click', 0.5), ('error', 0.75)) AS c(event_type, centre)) SELECT event_id, event_type FROM events JOIN c USING (event_type) WHERE abs((epoch_us(ts) % 86400000000) / 86400000000.0::DOUBLE - centre) <= 0.05")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    e = V.events(spark, sf).withColumn("pos", F.pmod("us", F.lit(V.DAY)) / F.lit(float(V.DAY)))
    c = spark.createDataFrame([("purchase", 0.25), ("click", 0.5), ("error", 0.75)], "event_type string, centre double")
    return A.near_centres(e, c, "event_type", "pos", "centre", 0.05).select("event_id", "event_type")


@query("j13_ordered_pairs", "SELECT a.t AS main, b.t AS comp FROM (SELECT DISTINCT event_type AS t FROM events) a, (SELECT DISTINCT event_type AS t FROM events) b WHERE a.t < b.t")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    return A.ordered_pairs(V.table(spark, sf, "events").select("event_type").distinct(), "event_type")


@query("e5_pair_start_stop", """WITH n AS (SELECT user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
SELECT a.user_id, a.n, a.us AS start, b.us AS stop FROM n a JOIN n b ON a.user_id = b.user_id AND a.n = b.n AND a.event_type = 'signup' AND b.event_type = 'purchase'""")
def e5(spark: SparkSession, sf: str) -> DataFrame:
    return A.paired_by_order(V.events(spark, sf), ["user_id"], "event_id", "us", "event_type", "signup", "purchase")


# --- aggregates and tests


@query("a1_group_mean_sem", """WITH l AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME variable VALUE value)
SELECT l_returnflag, variable, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem FROM l GROUP BY ALL""")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.mean_sem(V.table(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"]))


@query("a2_mean_of_means", "SELECT event_type, round(avg(m), 6) AS mean, round(stddev_pop(m) / sqrt(count(m)), 6) AS sem, count(m) AS n FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) GROUP BY event_type")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.mean_of_means(V.table(spark, sf, "events"), ["event_type"], "user_id", "value"))


@query("a4_ratio_of_sums", "SELECT l_returnflag, round(sum(l_discount) / nullif(sum(l_quantity), 0), 6) AS ratio FROM lineitem GROUP BY 1")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.ratio_of_sums(V.table(spark, sf, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity"))


@query("a5_class_counts", "SELECT c.event_type, count(e.event_id) AS n, round(count(e.event_id) / (SELECT count(*) FROM events), 6) AS share FROM (VALUES ('click'), ('error'), ('none'), ('view')) AS c(event_type) LEFT JOIN events e USING (event_type) GROUP BY 1")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.class_counts(V.table(spark, sf, "events"), "event_type", ["click", "error", "none", "view"]))


@query("a16_modal_class", "SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)) WHERE k = 1")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return G.modal(V.table(spark, sf, "events"), ["user_id"], "event_type")


@query("a23_peak_bin_order", V.over("matrix", body="#p AS (SELECT entity, bin AS peak FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY value DESC, bin) AS k FROM matrix) WHERE k = 1) SELECT entity, peak, row_number() OVER (ORDER BY peak, entity) AS place FROM p"))
def a23(spark: SparkSession, sf: str) -> DataFrame:
    return G.peak_order(V.matrix(spark, sf), "entity", "bin", "value")


@query("a26_sessions_per_subject", "SELECT o_custkey AS subject, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1")
def a26(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("a28_pair_sessions", "WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders) SELECT o_custkey, k // 2 AS pair, min(o_orderkey) AS first, max(o_orderkey) AS second FROM n GROUP BY 1, 2 HAVING count(*) = 2")
def a28(spark: SparkSession, sf: str) -> DataFrame:
    return G.consecutive_pairs(V.table(spark, sf, "orders"), ["o_custkey"], "o_orderkey")


_TT = """#s AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS ma, avg(value) FILTER (event_type = 'view') AS mb, var_samp(value) FILTER (event_type = 'click') AS va,
var_samp(value) FILTER (event_type = 'view') AS vb, count(*) FILTER (event_type = 'click') AS na, count(*) FILTER (event_type = 'view') AS nb FROM events GROUP BY 1)
SELECT user_id, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)), 6) AS t, na + nb - 2 AS df FROM s WHERE na > 1 AND nb > 1"""


@query("h2_t_test", "WITH " + _TT[1:])
def h2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.t_test(V.table(spark, sf, "events"), ["user_id"], "event_type", "value", "click", "view"))


@query("h1_mann_whitney", """WITH e AS (SELECT user_id, event_type, value FROM events WHERE event_type IN ('click', 'view')),
k AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY user_id, value) AS c FROM e),
s AS (SELECT user_id, sum(rank) FILTER (event_type = 'click') AS ra, count(*) FILTER (event_type = 'click') AS na, count(*) FILTER (event_type = 'view') AS nb, count(*) AS n, sum(c * c - 1) AS tie FROM k GROUP BY 1),
u AS (SELECT *, CAST(ra - na * (na + 1) / 2 AS DOUBLE) AS u FROM s WHERE na > 0 AND nb > 0)
SELECT user_id, round(u, 6) AS u, round((greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sqrt(na * nb / 12 * (n + 1 - tie / (n * (n - 1)))), 6) AS z FROM u""")
def h1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.mann_whitney(V.table(spark, sf, "events"), ["user_id"], "event_type", "value", "click", "view"))


@query("h5_bootstrap_sd", """WITH o AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS i FROM events WHERE event_type IN ('click', 'view')),
s AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS na, count(*) FILTER (event_type = 'view') AS nb FROM o GROUP BY 1 HAVING na > 0 AND nb > 0),
d AS (SELECT user_id, g.event_type, CASE WHEN g.event_type = 'click' THEN na ELSE nb END AS m, iter, unnest(range(1, greatest(na, nb) + 1)) AS j FROM s, (VALUES ('click'), ('view')) AS g(event_type), unnest(range(1, 1001)) AS u(iter)),
p AS (SELECT d.user_id, iter, avg(value) FILTER (d.event_type = 'click') - avg(value) FILTER (d.event_type = 'view') AS diff FROM d JOIN o ON o.user_id = d.user_id AND
o.event_type = d.event_type AND o.i = CAST('0x' || substr(md5('11-' || d.user_id || '-' || d.event_type || '-' || iter || '-' || j), 1, 8) AS BIGINT) % m GROUP BY 1, 2)
SELECT user_id, round(stddev_pop(diff), 6) AS sd FROM p GROUP BY 1""")
def h5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.bootstrap_sd(V.table(spark, sf, "events"), ["user_id"], "event_type", "value", "event_id", "click", "view", DRAWS))


# --- similarity and models


@query("m1_cosine_similarity", "WITH m AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 5) AS cosine FROM m a JOIN m b ON a.vec_id < b.vec_id")
def m1(spark: SparkSession, sf: str) -> DataFrame:
    return M.cosine_pairs(V.table(spark, sf, "embeddings"), "vec_id", "embedding").withColumn("cosine", F.round("cosine", 5))


@query("m6_cluster_means", V.over("matrix", body="SELECT class AS label, bin AS pos, round(avg(value), 6) AS mean FROM matrix GROUP BY ALL"))
def m6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.cluster_means(V.table(spark, sf, "embeddings"), "label", "embedding"))


@query("m18_class_weights", "SELECT quality, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY quality")
def m18(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.class_weights(V.table(spark, sf, "labels"), "quality"))


def _binary(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "labels").join(V.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select("quality", (F.log1p("n_chars") / 10).alias("score"))


_BINARY = "WITH b AS (SELECT quality, ln(1 + n_chars) / 10 AS score FROM labels JOIN documents USING (doc_id))"


@query("m19_binary_metrics", _BINARY + """, c AS (SELECT count(*) FILTER (score >= 0.7 AND quality = 1) AS tp, count(*) FILTER (score >= 0.7 AND quality = 0) AS fp, count(*) FILTER (score < 0.7 AND quality = 1) AS fn, count(*) AS n FROM b),
a AS (SELECT avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) AS auc FROM b x, b y WHERE x.quality = 1 AND y.quality = 0)
SELECT round((n - fp - fn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round(auc, 6) AS auc FROM c, a""")
def m19(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.binary_metrics(_binary(spark, sf), "quality", "score", 0.7))


_CUTS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8]


@query("m20_best_threshold", _BINARY + f""", g AS (SELECT threshold, sqrt(avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0 END) FILTER (quality = 1) * avg(CASE WHEN score >= threshold THEN 0.0 ELSE 1 END) FILTER
(quality = 0)) AS value FROM b, unnest({_CUTS}::DOUBLE[]) AS u(threshold) GROUP BY 1) SELECT threshold, round(value, 6) AS value FROM g ORDER BY round(g.value, 12) DESC,
threshold LIMIT 1""")
def m20(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.best_threshold(_binary(spark, sf), "quality", "score", _CUTS))


@query("m24_class_mean_curve", V.over("matrix", body="SELECT class, bin, round(avg(value), 6) AS mean FROM matrix GROUP BY ALL"))
def m24(spark: SparkSession, sf: str) -> DataFrame:
    return V.matrix(spark, sf).groupBy("class", "bin").agg(r(F.avg("value"), "mean"))


# --- pixel tables


@query("i1_mean_projection", V.over("pixels", body="#m AS (SELECT y, x, avg(v) AS m FROM pixels GROUP BY ALL) SELECT y, x, round(m / (SELECT max(m) FROM m), 6) AS v FROM m"))
def i1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.mean_projection(V.pixels(spark, sf)))


@query("i2_subtract_min", V.over("pixels", body="SELECT frame, y, x, round(v - min(v) OVER (PARTITION BY y, x), 6) AS v FROM pixels"))
def i2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.without_minimum(V.pixels(spark, sf)))


@query("i4_block_downsample", V.over("pixels", body="SELECT frame, CAST(y // 2 AS BIGINT) AS y, CAST(x // 2 AS BIGINT) AS x, round(avg(v), 6) AS v FROM pixels GROUP BY 1, 2, 3"))
def i4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.block_means(V.pixels(spark, sf), 2))


@query("i5_crop", V.over("pixels", body="SELECT frame, y - 2 AS y, x - 1 AS x, round(v, 6) AS v FROM pixels WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6"))
def i5(spark: SparkSession, sf: str) -> DataFrame:
    return V.pixels(spark, sf).where("y between 2 and 5 and x between 1 and 6").select("frame", (F.col("y") - 2).alias("y"), (F.col("x") - 1).alias("x"), r("v"))


@query("i13_reconstruct", V.over("pixels", "traces", body="SELECT t.frame, y, x, round(sum(v * value), 4) AS v FROM pixels p JOIN traces t ON p.frame = t.entity WHERE v > 0.1 GROUP BY 1, 2, 3"))
def i13(spark: SparkSession, sf: str) -> DataFrame:
    f = V.pixels(spark, sf).where("v > 0.1").select(F.col("frame").alias("entity"), "y", "x", F.col("v").alias("w"))
    return G.reconstructed(f, V.traces(spark, sf)).withColumn("v", F.round("v", 4))


@query("i18_overlap_mask", V.over("pixels", body="SELECT y, x, round(sum(v) - max(v), 6) AS v, sum(v) - max(v) > 0.5 AS overlap FROM pixels WHERE v > 0.1 GROUP BY y, x"))
def i18(spark: SparkSession, sf: str) -> DataFrame:
    rest = F.sum("v") - F.max("v")
    return V.pixels(spark, sf).where("v > 0.1").groupBy("y", "x").agg(r(rest, "v"), (rest > 0.5).alias("overlap"))


# --- scalars, sources, sets


@query("p1_minmax", "SELECT event_id, round((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events), 6) AS scaled FROM events")
def p1(spark: SparkSession, sf: str) -> DataFrame:
    return S.scaled(V.table(spark, sf, "events").select("event_id", "value"), "value", []).select("event_id", r("scaled"))


@query("p3_minmax_by", "SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.5 END, 6) AS scaled FROM events WINDOW w AS (PARTITION BY user_id)")
def p3(spark: SparkSession, sf: str) -> DataFrame:
    return S.scaled(V.table(spark, sf, "events").select("event_id", "user_id", "value"), "value", ["user_id"], constant=0.5).select("event_id", r("scaled"))


@query("p6_rescale_bits", "SELECT event_id, CAST(round_even((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events) * 255, 0) AS BIGINT) AS level FROM events")
def p6(spark: SparkSession, sf: str) -> DataFrame:
    return S.rescaled_bits(V.table(spark, sf, "events").select("event_id", "value"), "value", 8).select("event_id", "level")


@query("p7_angle_wrap", "SELECT event_id, round((value + pi()) - floor((value + pi()) / (2 * pi())) * 2 * pi() - pi(), 5) AS angle FROM events")
def p7(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "events").select("event_id", F.round(S.wrapped_angle(F.col("value")), 5).alias("angle"))


@query("p8_bin_index", "SELECT event_id, CASE WHEN value BETWEEN 0 AND 500 THEN CAST(least(floor(value * 0.04), 19) AS INT) END AS bin FROM events")
def p8(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "events").select("event_id", S.bin_index(F.col("value"), 0, 500, 20).alias("bin"))


@query("p19_downsample_factor", """SELECT p_partkey, CASE WHEN h BETWEEN 400 AND 650 OR w BETWEEN 400 AND 650 THEN 2 WHEN h BETWEEN 651 AND 900 OR w BETWEEN 651 AND 900 THEN 3 WHEN h BETWEEN 901 AND 1200
OR w BETWEEN 901 AND 1200 THEN 4 WHEN h BETWEEN 1201 AND 1500 OR w BETWEEN 1201 AND 1500 THEN 5 ELSE 1 END AS factor FROM (SELECT p_partkey, p_size * 30 AS h, p_partkey %
1600 AS w FROM part)""")
def p19(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "part").select("p_partkey", S.downsample_factor(F.col("p_size") * 30, F.col("p_partkey") % 1600).alias("factor"))


@query("p22_first_number", "SELECT page_id, CAST(coalesce(nullif(regexp_extract(url, '(\\d+)', 1), ''), '0') AS BIGINT) AS number FROM pages")
def p22(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "pages").select("page_id", S.first_number(F.col("url")).alias("number"))


@query("p13_parse_path", "SELECT page_id, len(p) AS parts, p[1] AS first, p[-1] AS last FROM (SELECT page_id, string_split_regex(url, '[/_-]+') AS p FROM pages)")
def p13(spark: SparkSession, sf: str) -> DataFrame:
    p = F.split("url", "[/_-]+")
    return V.table(spark, sf, "pages").select("page_id", F.size(p).cast("long").alias("parts"), F.element_at(p, 1).alias("first"), F.element_at(p, -1).alias("last"))


@query("s1_read_event_log", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, FALSE AS bad FROM events UNION ALL SELECT doc_id, NULL, TRUE FROM documents")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    raw = V.table(spark, sf, "events").select("event_id", F.col("props").alias("line")).union(V.table(spark, sf, "documents").select("doc_id", "text"))
    rows = raw.select("event_id", readers.json_object(F.col("line")).alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.col("v").isNull().alias("bad"))


@query("s4_unpivot_wide", "UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME entity VALUE value")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "entity", "value")


@query("s9_registry_search", "SELECT DISTINCT url, regexp_extract(url, '//([^/]+)', 1) AS host FROM pages WHERE contains(url, 'blog') ORDER BY url LIMIT 100")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "pages").where(F.col("url").contains("blog")).select("url", F.regexp_extract("url", "//([^/]+)", 1).alias("host")).distinct().orderBy("url").limit(100)


@query("s13_to_coo", V.over("pixels", body="SELECT frame, y, x, round(v, 6) AS v FROM pixels WHERE v >= 0.1"))
def s13(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.pixels(spark, sf).where("v >= 0.1"))


@query("k1_union_sessions", "SELECT c_custkey AS subject, c_acctbal AS balance, NULL::DOUBLE AS total FROM customer UNION ALL SELECT o_custkey, NULL, o_totalprice FROM orders")
def k1(spark: SparkSession, sf: str) -> DataFrame:
    a = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(V.table(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_totalprice").alias("total")), allowMissingColumns=True)


@query("k3_intersect_except", """(SELECT user_id, 'both' AS kind FROM events WHERE event_type = 'error' AND value > 90 INTERSECT SELECT user_id, 'both' FROM events WHERE event_type = 'click' AND value >
90) UNION ALL (SELECT user_id, 'only' FROM events WHERE event_type = 'error' AND value > 90 EXCEPT SELECT user_id, 'only' FROM events WHERE event_type = 'click' AND value
> 90)""")
def k3(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events").where("value > 90")
    a, b = (e.where(F.col("event_type") == t).select("user_id") for t in ("error", "click"))
    return a.intersect(b).withColumn("kind", F.lit("both")).union(a.subtract(b).withColumn("kind", F.lit("only")))


@query("k6_top1_by", "SELECT l_suppkey, max(l_extendedprice) AS top FROM lineitem GROUP BY 1")
def k6(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("top"))


@query("k7_distinct_counts", "SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1")
def k7(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "lineitem").groupBy("l_shipdate").agg(F.count("*").alias("n"))


@query("k8_first_n_sessions", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k <= 3")
def k8(spark: SparkSession, sf: str) -> DataFrame:
    return W.numbered(V.table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "k").where("k < 3").select("o_custkey", "o_orderkey")
