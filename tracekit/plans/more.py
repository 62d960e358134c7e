"""Queries over pixel frames, curves and counts. Registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.operators import curves as C
from tracekit.operators import frames as P
from tracekit.plans import fixtures as V
from tracekit.plans.queries import query, r, rounded


@query("p15_parse_selection", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 1 OR o_custkey BETWEEN 30 AND 50")
def p15(spark: SparkSession, sf: str) -> DataFrame:
    return C.selected(V.table(spark, sf, "orders"), "o_custkey", "1,30-50").select("o_orderkey", "o_custkey")


@query("p18_gamma", "SELECT event_id, round(pow(value, 0.5), 6) AS v FROM events")
def p18(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "events").select("event_id", r(F.pow("value", F.lit(0.5)), "v"))


@query("i3_subtract_global_min", V.over("pixels", body="SELECT frame, y, x, round(v - (SELECT min(v) FROM pixels), 6) AS v FROM pixels"))
def i3(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.without_global_minimum(V.pixels(spark, sf)))


@query("i7_orient", V.over("pixels", body="#m AS (SELECT frame, y, 7 - x AS x, v FROM pixels) SELECT frame, 7 - x AS y, y AS x, round(v, 6) AS v FROM m"))
def i7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.oriented(V.pixels(spark, sf), 8))


@query("i15_fov_images", V.over("matrix", body="#m AS (SELECT class, bin, avg(value) AS v FROM matrix GROUP BY ALL), l AS (SELECT *, v - min(v) OVER (PARTITION BY class) AS d FROM m) SELECT class, bin, round(d / max(d) OVER (), 6) AS v FROM l"))
def i15(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.session_images(V.matrix(spark, sf).groupBy("class", "bin").agg(F.avg("value").alias("v")), "class"))


@query("i19_reindex_pixels", V.over("matrix", body="SELECT entity, bin, bin % 8 AS y, bin // 8 AS x FROM matrix"))
def i19(spark: SparkSession, sf: str) -> DataFrame:
    return V.matrix(spark, sf).select("entity", "bin", P.pixel_place(F.col("bin"), 8, 8, "F").alias("p")).select("entity", "bin", "p.*")


@query("j2_rebase_events", V.over("traces", body="""#s AS (SELECT entity, frame // 10 AS n, min(frame) AS start, max(frame) AS stop FROM traces WHERE frame // 10 % 2 = 1 GROUP BY ALL), o AS (SELECT *, coalesce(sum(stop -
start + 1) OVER (PARTITION BY entity ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s) SELECT t.entity, t.frame, CAST(t.frame - start + off
AS BIGINT) AS place FROM traces t JOIN o ON t.entity = o.entity AND t.frame BETWEEN start AND stop WHERE value > 200"""))
def j2(spark: SparkSession, sf: str) -> DataFrame:
    t = V.traces(spark, sf).withColumn("frame", F.col("frame").cast("long"))
    s = t.groupBy("entity", F.expr("frame div 10").alias("n")).agg(F.min("frame").alias("start"), F.max("frame").alias("stop")).where("n % 2 = 1")
    return P.rebased(t.where("value > 200").select("entity", "frame"), s, ["entity"], "frame", "start", "stop", "n").select("entity", "frame", "place")


@query("t3_spike_raster", V.over("frames", "spikes", body="SELECT DISTINCT entity, frame, lap FROM spikes JOIN frames USING (frame)"))
def t3(spark: SparkSession, sf: str) -> DataFrame:
    return V.spikes(spark, sf).join(V.frames(spark, sf).select("frame", "lap"), "frame").select("entity", "frame", "lap").distinct()


@query("t16_field_position_class", V.over("frames", "spikes", body="""#n AS (SELECT entity, bin, count(*) AS n FROM spikes JOIN frames USING (frame) GROUP BY ALL), p AS (SELECT entity, bin AS peak FROM (SELECT *, row_number() OVER
(PARTITION BY entity ORDER BY n DESC, bin) AS k FROM n) WHERE k = 1) SELECT entity, peak, CASE WHEN peak >= 90 OR peak <= 10 THEN 'start' WHEN peak BETWEEN 40 AND 60 THEN
'mid' ELSE 'place' END AS kind FROM p"""))
def t16(spark: SparkSession, sf: str) -> DataFrame:
    n = V.spikes(spark, sf).join(V.frames(spark, sf), "frame").groupBy("entity", "bin").agg(F.count("*").alias("n"))
    p = n.groupBy("entity").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("peak"))
    return p.withColumn("kind", C.field_class(F.col("peak"), middle=(40, 60)))


@query("m8_curve_distances", V.over("matrix", body="""#c AS (SELECT class, bin, avg(value) FILTER (entity % 2 = 0) AS p, avg(value) FILTER (entity % 2 = 1) AS q FROM matrix GROUP BY ALL) SELECT class, round(sum(p - q), 6) AS
diff, round(sqrt(sum((p - q) * (p - q))), 6) AS euclid, round(avg(p * q), 6) AS dot, round(1 - corr(p, q), 6) AS correlation_distance FROM c WHERE p IS NOT NULL AND q IS
NOT NULL GROUP BY class"""))
def m8(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda k: V.matrix(spark, sf).where(F.col("entity") % 2 == k).groupBy("class", "bin").agg(F.avg("value").alias("v"))
    return rounded(C.curve_distances(part(0), part(1), "class", "bin", "v"))


@query("m13_confusion_metrics", """WITH b AS (SELECT l_returnflag AS t, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS p FROM lineitem), k AS (SELECT t AS class,
count(*) AS n, count(*) FILTER (t = p) AS h FROM b GROUP BY 1), q AS (SELECT p AS class, count(*) AS m FROM b GROUP BY 1) SELECT class, n, round(CASE WHEN m > 0 THEN h /
m ELSE 0 END, 6) AS precision, round(h / n, 6) AS recall, round(2 * h / (coalesce(m, 0) + n), 6) AS f1 FROM k LEFT JOIN q USING (class)""")
def m13(spark: SparkSession, sf: str) -> DataFrame:
    told = F.expr("case when l_linestatus = 'O' then 'N' when l_quantity > 25 then 'A' else 'R' end")
    return rounded(C.confusion_metrics(V.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("t"), told.alias("p")), "t", "p"))


@query("a30_error_bars", V.over("traces", body="""#b AS (SELECT entity, frame // 10 AS x, value FROM traces), o AS (SELECT entity, x, avg(value) AS m, stddev_pop(value) / sqrt(count(value)) AS sem, count(value) AS n FROM
b GROUP BY ALL), l AS (SELECT entity, avg(value) AS base FROM b WHERE x < 2 GROUP BY 1) SELECT entity, x, round(m - base, 6) AS mean, round(sem, 6) AS sem, n FROM o JOIN
l USING (entity)"""))
def a30(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.error_bars(V.traces(spark, sf).withColumn("x", F.expr("frame div 10")), ["entity"], "x", "value", (0, 2)))


@query("a34_dominant_event_type", "SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, event_type LIMIT 1")
def a34(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(1)
