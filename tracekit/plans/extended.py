"""More operators over the given tables: cluster labels, trials, positions, streams. Registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.functions import scalars as S
from tracekit.operators import alignment as A
from tracekit.operators import clusters as C
from tracekit.operators import groups as G
from tracekit.operators import segments as E
from tracekit.operators import tuning as T
from tracekit.operators import windows as W
from tracekit.plans import fixtures as V
from tracekit.plans.queries import _SHUFFLES, DRAWS, query, r, rounded
from tracekit.sources.scratch import place
from tracekit.streaming import laps

# --- sources and scalars


@query("s11_flatten_struct", "SELECT c_custkey AS id, n_name AS home_nation, r_name AS home_region_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    n = V.table(spark, sf, "nation").join(V.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = V.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return S.flattened(c.select(F.col("c_custkey").alias("id"), F.struct(F.col("n_name").alias("nation"), F.struct(F.col("r_name").alias("name")).alias("region")).alias("home")))


@query("s14_accepted_subset", V.over("traces", body="SELECT entity, frame, value FROM traces WHERE entity IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"))
def s14(spark: SparkSession, sf: str) -> DataFrame:
    ok = V.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("entity"))
    return V.traces(spark, sf).select("entity", "frame", "value").join(ok, "entity", "left_semi")


@query("p4_minmax_rows", V.over("matrix", body="SELECT entity, bin, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 6) AS scaled FROM matrix WINDOW w AS (PARTITION BY entity)"))
def p4(spark: SparkSession, sf: str) -> DataFrame:
    return S.scaled(V.matrix(spark, sf), "value", ["entity"]).select("entity", "bin", r("scaled"))


@query("p5_maxnorm", V.over("matrix", body="SELECT entity, bin, round(CASE WHEN max(value) OVER w <> 0 THEN value / max(value) OVER w ELSE value END, 6) AS scaled FROM matrix WINDOW w AS (PARTITION BY entity)"))
def p5(spark: SparkSession, sf: str) -> DataFrame:
    return W.maximum_scaled(V.matrix(spark, sf), ["entity"], "value").select("entity", "bin", r("scaled"))


@query("p10_decode_pin", "SELECT event_id, CASE CAST(json_extract(props, '$.k') AS INT) WHEN 3 THEN 'CUE1' WHEN 4 THEN 'CUE2' WHEN 10 THEN 'CUE3' WHEN 7 THEN 'REWARD' WHEN 52 THEN 'LED' END AS name FROM events")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "events").select("event_id", S.pin_name(F.get_json_object("props", "$.k").cast("int")).alias("name"))


_COHORTS = [("AUTO", "a"), ("B", "b")]


@query("p12_cohort_of", "SELECT c_custkey, CASE WHEN starts_with(c_mktsegment, 'AUTO') THEN 'a' WHEN starts_with(c_mktsegment, 'B') THEN 'b' ELSE 'other' END AS cohort FROM customer")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "customer").select("c_custkey", S.cohort(F.col("c_mktsegment"), _COHORTS, "other").alias("cohort"))


@query("p17_clip_outliers", V.over("traces", body="SELECT entity, frame, value FROM traces WHERE entity IN (SELECT entity FROM traces GROUP BY entity HAVING max(abs(value)) < 485)"))
def p17(spark: SparkSession, sf: str) -> DataFrame:
    return W.without_extreme_series(V.traces(spark, sf), ["entity"], "value", 485).select("entity", "frame", "value")


@query("p20_crop_box", "SELECT p_partkey, least(p_size, p_partkey % 40) AS \"left\", least(p_size * 2, 30) AS top, greatest(p_size, p_partkey % 40) AS \"right\", greatest(p_size * 2, 30) AS bottom FROM part")
def p20(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    return V.table(spark, sf, "part").select("p_partkey", S.crop_box(size, size * 2, F.col("p_partkey") % 40, F.lit(30)).alias("b")).select("p_partkey", "b.*")


@query("p21_every_nth", V.over("traces", body="SELECT entity, frame, value FROM traces WHERE frame % 3 = 0"))
def p21(spark: SparkSession, sf: str) -> DataFrame:
    return W.every_nth(V.traces(spark, sf), ["entity"], "frame", 3).select("entity", "frame", "value")


@query("p24_contains_all", "SELECT o_custkey, bool_or(o_orderstatus = 'O') AND bool_or(o_orderstatus = 'F') AS complete FROM orders GROUP BY 1")
def p24(spark: SparkSession, sf: str) -> DataFrame:
    missing = F.array_except(F.array(F.lit("O"), F.lit("F")), F.collect_set("o_orderstatus"))
    return V.table(spark, sf, "orders").groupBy("o_custkey").agg((F.size(missing) == 0).alias("complete"))


# --- windows and segments


@query("w15_resample_linear", """WITH e AS (SELECT user_id AS entity, event_id, event_type, epoch_us(ts) / 1e6 AS t, value FROM events),
s AS (SELECT entity, t AS t0, value AS v0, lead(t) OVER w AS t1, lead(value) OVER w AS v1, row_number() OVER w AS n, count(*) OVER (PARTITION BY entity) AS c FROM e WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY entity ORDER BY t))
SELECT event_id, round(v0 + (t - t0) * (v1 - v0) / (t1 - t0), 4) AS value FROM (SELECT entity, event_id, t FROM e WHERE event_type = 'click') a LEFT JOIN s ON s.entity = a.entity AND s.t1 IS NOT NULL AND (n = 1 OR t >= t0) AND (n = c - 1 OR t < t1)""")
def w15(spark: SparkSession, sf: str) -> DataFrame:
    e = V.events(spark, sf).select(F.col("user_id").alias("entity"), "event_id", "event_type", (F.col("us") / 1e6).alias("t"), "value")
    out = A.interpolated(e.where("event_type = 'click'").select("entity", "t", "event_id"), e.where("event_type = 'purchase'").select("entity", "t", "value"), ["entity"], "t", "value")
    return out.select("event_id", F.round("value", 4).alias("value"))


@query("w16_repair_resets", V.over("traces", body="""#n AS (SELECT *, coalesce(value - lead(value) OVER w > 100, FALSE) AS c, last_value(value) OVER (PARTITION BY entity ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND
UNBOUNDED FOLLOWING) AS z FROM traces WINDOW w AS (PARTITION BY entity ORDER BY frame)),
r(entity, frame, y, p) AS (SELECT entity, frame, value, z FROM n WHERE frame = 0 UNION ALL SELECT n.entity, n.frame, CASE WHEN n.c AND n.value < r.y THEN r.y + (r.y -
r.p) ELSE n.value END, r.y FROM r JOIN n ON n.entity = r.entity AND n.frame = r.frame + 1)
SELECT entity, frame, round(y, 6) AS value FROM r""").replace("WITH", "WITH RECURSIVE", 1))
def w16(spark: SparkSession, sf: str) -> DataFrame:
    return W.repaired_resets(V.traces(spark, sf), ["entity"], "frame", "value").select("entity", "frame", r("value"))


@query("g3_laps_by_coverage", """WITH e AS (SELECT user_id AS entity, event_id AS frame, (epoch_us(ts) % 86400000000) / 86400000000.0::DOUBLE AS pos FROM events),
d AS (SELECT *, CASE WHEN coalesce(lag(pos) OVER (PARTITION BY entity ORDER BY frame) - pos, 0) >= 0.5 THEN 1 ELSE 0 END AS r FROM e),
l AS (SELECT *, sum(r) OVER (PARTITION BY entity ORDER BY frame) AS lap FROM d),
s AS (SELECT entity, lap AS lap0, min(frame) AS start, max(frame) AS stop, count(DISTINCT floor(pos * 10)) AS visited FROM l GROUP BY ALL)
SELECT entity, start, stop, visited, row_number() OVER (PARTITION BY entity ORDER BY lap0) AS lap FROM s WHERE visited >= 3""")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    e = V.events(spark, sf).select(F.col("user_id").alias("entity"), F.col("event_id").alias("frame"), (F.pmod("us", F.lit(V.DAY)) / F.lit(float(V.DAY))).alias("pos"))
    return E.laps_by_coverage(e, ["entity"], "frame", "pos", 10, 0.3)


_HELD = "#h AS (SELECT t.entity, t.frame, max(i.segment) AS segment FROM traces t LEFT JOIN intervals i ON t.entity = i.entity AND t.t BETWEEN i.start AND i.stop GROUP BY ALL)"


@query("g5_interval_membership", V.over("traces", "intervals", body=_HELD + " SELECT entity, coalesce(segment, 0) AS segment, count(*) AS n FROM h GROUP BY ALL"))
def g5(spark: SparkSession, sf: str) -> DataFrame:
    return E.membership_counts(V.traces(spark, sf), V.intervals(spark, sf), ["entity"], ["frame"], "t", 86400.0)


@query("g9_epochs_to_flags", V.over("traces", "intervals", body=_HELD + " SELECT entity, frame, segment IS NOT NULL AS inside FROM h"))
def g9(spark: SparkSession, sf: str) -> DataFrame:
    return E.assigned(V.traces(spark, sf), V.intervals(spark, sf), ["entity"], ["frame"], "t", 86400.0).select("entity", "frame", F.col("segment").isNotNull().alias("inside"))


_TRIALS = """#e AS (SELECT entity, frame AS f0, row_number() OVER (PARTITION BY entity ORDER BY frame) AS event_no FROM traces WHERE value > 200),
w AS (SELECT e.entity, event_no, t.frame, value FROM e JOIN traces t ON t.entity = e.entity AND t.frame >= f0 - 5 AND t.frame < f0 + 10),
trials AS (SELECT entity, event_no, frame - min(frame) OVER (PARTITION BY entity, event_no) AS rel, value FROM w)"""


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    t = V.traces(spark, sf)
    e = W.numbered(t.where("value > 200"), ["entity"], ["frame"], "n").select("entity", F.col("frame").alias("at"), (F.col("n") + 1).alias("event_no"))
    return A.triggered(t, e, ["entity"], "frame", "at", "event_no", "value", -5, 10)


@query("g13_aligned_stack", V.over("traces", body=_TRIALS + " SELECT entity, rel, round(avg(value), 6) AS mean, count(*) AS n FROM trials GROUP BY ALL"))
def g13(spark: SparkSession, sf: str) -> DataFrame:
    return _trials(spark, sf).groupBy("entity", "rel").agg(r(F.avg("value"), "mean"), F.count("*").alias("n"))


@query("a21_trial_peak_area", V.over("traces", body=_TRIALS + " SELECT entity, event_no, round(max(value) FILTER (rel >= 5), 6) AS peak, round(max(value) FILTER (rel >= 5) - max(value) FILTER (rel = 5), 6) AS rise, round(sum(value) FILTER (rel >= 5), 6) AS area FROM trials GROUP BY ALL"))
def a21(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.trial_summary(_trials(spark, sf), ["entity", "event_no"], "rel", "value", 5))


@query("a20_response_max", V.over("traces", body=_TRIALS + " SELECT entity, round(avg(peak), 6) AS response FROM (SELECT entity, event_no, max(value) FILTER (rel >= 5) AS peak FROM trials GROUP BY ALL) GROUP BY entity"))
def a20(spark: SparkSession, sf: str) -> DataFrame:
    return A.trial_summary(_trials(spark, sf), ["entity", "event_no"], "rel", "value", 5).groupBy("entity").agg(r(F.avg("peak"), "response"))


@query("a25_binned_context_rate", V.over("traces", body="SELECT entity, CAST(frame * 10 // n AS INT) AS bin, round(avg(value), 6) AS mean FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM traces) GROUP BY 1, 2"))
def a25(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.binned_means(V.traces(spark, sf), ["entity"], "frame", "value", 10))


# --- cluster labels


_GOOD = "#l AS (SELECT *, silhouette > 0 AND intra > 0.4 AS good FROM labels_), k AS (SELECT cluster, session, min(class) AS c, bool_and(good) AS g FROM l WHERE cluster <> -1 GROUP BY ALL)"


@query("j12_significant_footprints", V.over("pixels", body="SELECT frame, y, x, round(v, 6) AS v FROM pixels WHERE v > 0.1 AND frame IN (SELECT frame FROM pixels GROUP BY frame HAVING max(v) > 0.3)"))
def j12(spark: SparkSession, sf: str) -> DataFrame:
    p = V.pixels(spark, sf)
    return rounded(p.where("v > 0.1").join(p.groupBy("frame").agg(F.max("v").alias("m")).where("m > 0.3"), "frame", "left_semi"))


# --- events by lap


@query("e4_sync_on_off", "SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS last_on, max(event_id) FILTER (event_type = 'signup') AS last_off FROM events GROUP BY 1")
def e4(spark: SparkSession, sf: str) -> DataFrame:
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("event_id")))
    return V.table(spark, sf, "events").groupBy("user_id").agg(last("purchase").alias("last_on"), last("signup").alias("last_off"))


@query("j15_trial_table", V.over("ev", body="#s AS (SELECT user_id, lap, min(us) AS lap_start FROM ev GROUP BY ALL) SELECT event_id, us, lap_start, lap, CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END + CASE WHEN lap % 4 = 1 THEN 2 ELSE 0 END AS label FROM ev JOIN s USING (user_id, lap) WHERE event_type IN ('purchase', 'signup')"))
def j15(spark: SparkSession, sf: str) -> DataFrame:
    e = V.events(spark, sf).withColumn("lap", F.expr(f"us div {V.DAY}"))
    both = e.where("event_type in ('purchase', 'signup')").join(e.groupBy("user_id", "lap").agg(F.min("us").alias("lap_start")), ["user_id", "lap"])
    return both.select("event_id", "us", "lap_start", "lap", F.expr("if(event_type = 'purchase', 0, 1) + if(lap % 4 = 1, 2, 0)").alias("label")).orderBy("us", "event_id")


@query("a15_segments_without", V.over("ev", body="SELECT user_id, lap FROM ev GROUP BY ALL HAVING count(*) FILTER (event_type = 'click') = 0"))
def a15(spark: SparkSession, sf: str) -> DataFrame:
    e = V.events(spark, sf).withColumn("lap", F.expr(f"us div {V.DAY}"))
    return e.groupBy("user_id", "lap").agg(F.count_if(F.col("event_type") == "click").alias("n")).where("n = 0").select("user_id", "lap")


@query("t7_sparse_bins", V.over("frames", body="#n AS (SELECT bin, count(DISTINCT lap) AS n FROM frames GROUP BY bin) SELECT bin, n AS laps, n < greatest(round_even(0.2 * (SELECT count(DISTINCT lap) FROM frames), 0), 2) AS sparse FROM n"))
def t7(spark: SparkSession, sf: str) -> DataFrame:
    f = V.frames(spark, sf)
    least = f.agg(F.greatest(F.bround(F.count_distinct("lap") * 0.2), F.lit(2.0)).alias("least"))
    return f.groupBy("bin").agg(F.count_distinct("lap").alias("laps")).crossJoin(F.broadcast(least)).select("bin", "laps", (F.col("laps") < F.col("least")).alias("sparse"))


@query("t12_null_z_p", V.over("frames", "spikes", body=_SHUFFLES + """,
a AS (SELECT entity, max(n) AS real FROM (SELECT entity, bin, count(*) AS n FROM spikes JOIN frames USING (frame) GROUP BY ALL) GROUP BY entity), b AS (SELECT shuffle, entity, max(n) AS null_ FROM nulls GROUP BY ALL)
SELECT entity, any_value(real) AS real, round((any_value(real) - avg(null_)) / nullif(stddev_pop(null_), 0), 6) AS z, round(avg(CASE WHEN null_ >= real THEN 1.0 ELSE 0 END), 6) AS p FROM a JOIN b USING (entity) GROUP BY entity"""))
def t12(spark: SparkSession, sf: str) -> DataFrame:
    real = V.spikes(spark, sf).join(V.frames(spark, sf), "frame").groupBy("entity", "bin").agg(F.count("*").alias("n")).groupBy("entity").agg(F.max("n").alias("real"))
    return rounded(T.peak_z_p(real, V.spikes(spark, sf), V.frames(spark, sf), DRAWS))


# --- aggregates, tests and sets


@query("a6_subject_totals", "SELECT o_custkey AS subject, count(*) FILTER (o_orderstatus = 'F') AS closed, count(*) AS total, round(count(*) FILTER (o_orderstatus = 'O') / nullif(count(*) FILTER (o_orderstatus = 'F'), 0), 6) AS ratio FROM orders GROUP BY 1")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(n("F").alias("closed"), F.count("*").alias("total"), r(n("O") / F.nullif(n("F"), F.lit(0)), "ratio"))


@query("a27_subjects_complete", "SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_and(o_totalprice > 50000)")
def a27(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_totalprice") > 50000).alias("ok")).where("ok").select("o_custkey")


@query("a29_trace_stats", V.over("traces", body="SELECT entity, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, count(*) AS n FROM traces GROUP BY 1"))
def a29(spark: SparkSession, sf: str) -> DataFrame:
    return V.traces(spark, sf).groupBy("entity").agg(F.min("value").alias("low"), F.max("value").alias("high"), r(F.avg("value"), "mean"), r(F.stddev_pop("value"), "sd"), F.count("*").alias("n"))


@query("a33_flag_outlier_pairs", "SELECT user_id, round(a, 6) AS a, round(b, 6) AS b FROM (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY 1) WHERE abs(a) <= 60 AND abs(b) <= 60")
def a33(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    return rounded(V.table(spark, sf, "events").groupBy("user_id").agg(mean("click").alias("a"), mean("view").alias("b")).where("abs(a) <= 60 and abs(b) <= 60"))


@query("h3_paired_t", """WITH m AS (SELECT user_id, avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view') AS d FROM events GROUP BY 1)
SELECT user_id % 10 AS grp, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 5) AS t, count(d) - 1 AS df FROM m GROUP BY 1 HAVING count(d) > 1 AND stddev_samp(d) > 0""")
def h3(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    pairs = V.table(spark, sf, "events").groupBy("user_id").agg(mean("click").alias("a"), mean("view").alias("b")).withColumn("grp", F.col("user_id") % 10)
    return G.paired_t(pairs, ["grp"], "a", "b").withColumn("t", F.round("t", 5))


@query("h4_pair_test_summary", "SELECT user_id, " + ", ".join(f"round({f}(value) FILTER (event_type = '{t}'), 6) AS {n}_{t}" for t in ("click", "view") for f, n in (("avg", "mean"), ("median", "median"), ("stddev_pop", "sd"))) + ", avg(value) FILTER (event_type = 'click') > avg(value) FILTER (event_type = 'view') AS higher FROM events GROUP BY 1")
def h4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.pair_summary(V.table(spark, sf, "events"), ["user_id"], "event_type", "value", "click", "view"))


@query("k2_union_events_sorted", "SELECT user_id, event_id, 'on' AS edge FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, event_id, 'off' FROM events WHERE event_type = 'signup'")
def k2(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events")
    one = lambda t, edge: e.where(F.col("event_type") == t).select("user_id", "event_id", F.lit(edge).alias("edge"))
    return one("purchase", "on").union(one("signup", "off")).orderBy("event_id")


@query("k4_distinct_union", V.over("traces", body="SELECT entity, frame FROM traces WHERE value > 400 UNION SELECT entity, frame FROM traces WHERE frame % 10 = 0"))
def k4(spark: SparkSession, sf: str) -> DataFrame:
    t = V.traces(spark, sf).select("entity", "frame", "value")
    return t.where("value > 400 or frame % 10 = 0").select("entity", "frame").distinct()


# --- streams: the same rows as in one batch


def _streamed(spark: SparkSession, out: DataFrame) -> DataFrame:
    """The rows of a stream over all that there is, by way of tables in the shared folder."""
    at = place(spark, "stream")
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return spark.readStream.schema(V.table(spark, sf, "events").schema).option("maxFilesPerTrigger", 64).parquet(f"{sf}/events.parquet*")


@query("st1_stream_carry_state", """WITH k AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN event_type = 'purchase' THEN value END AS p FROM events) SELECT user_id, event_id, us, last_value(p
IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS state FROM (SELECT *, max(us) OVER (PARTITION BY user_id ORDER BY event_id) AS m
FROM k) WHERE us >= m""")
def st1(spark: SparkSession, sf: str) -> DataFrame:
    e = _stream(spark, sf).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("state"))
    return _streamed(spark, laps.carried(e, "user_id", "event_id", "us", "state"))


@query("st2_stream_lap_summary", V.over("ev", body=f"SELECT user_id, lap, count(*) AS n, min(us) AS first, max(us) AS last FROM ev GROUP BY user_id, lap HAVING (lap + 1) * {V.DAY} <= (SELECT max(us) FROM ev) - 3600000000"))
def st2(spark: SparkSession, sf: str) -> DataFrame:
    e = _stream(spark, sf).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = _streamed(spark, laps.lap_summary(e, "user_id", "ts"))
    return out.select("user_id", F.expr(f"unix_micros(start) div {V.DAY}").alias("lap"), "n", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))
