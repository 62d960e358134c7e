"""Queries over keyed series: peaks, baselines, filters and clocks. Registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.functions import scalars as S
from tracekit.operators import peaks as P
from tracekit.operators import tuning as T
from tracekit.operators import windows as W
from tracekit.plans import fixtures as V
from tracekit.plans.queries import _KSQL, query, r, rounded

E, O, X = ["entity"], "frame", "value"


def _series(spark: SparkSession, sf: str) -> DataFrame:
    return V.traces(spark, sf).select("entity", F.col("frame").cast("int").alias("frame"), "t", "value")


@query("w5_transients")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL, as each round masks what the one before found: tested against numpy."""
    return P.transients(_series(spark, sf), E, O, X, m=2, times=1.0, timeout=2.0, first=5)


_TOPS = "tops AS (SELECT entity, frame AS p FROM (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS n FROM traces WINDOW w AS (PARTITION BY entity ORDER BY frame)) WHERE value > 150 AND value > l AND value > n)"


def _tops(spark: SparkSession, sf: str) -> DataFrame:
    w = W._by(E, O)
    t = _series(spark, sf).withColumn("l", F.lag(X).over(w)).withColumn("n", F.lead(X).over(w))
    return t.where("value > 150 and value > l and value > n").select("entity", "frame")


@query("w6_peak_shape", V.over("traces", body="#" + _TOPS + """,
n AS (SELECT t.entity, p, frame, value FROM tops JOIN traces t ON t.entity = tops.entity AND frame BETWEEN p - 5 AND p + 7)
SELECT entity, p AS frame, round(max(value) FILTER (frame BETWEEN p AND p + 5), 6) AS top, CAST(arg_min(frame, struct_pack(a := -value, b := frame)) FILTER (frame BETWEEN
p AND p + 5) AS INT) AS top_at, round(min(value) FILTER (frame BETWEEN p - 3 AND p - 1), 6) AS low,
  round(max(value) FILTER (frame BETWEEN p AND p + 5) - min(value) FILTER (frame BETWEEN p - 3 AND p - 1), 6) AS amplitude, round(list_sum(list(value)), 6) AS total, count(*) AS held, round(arg_min(value, frame), 6) AS first FROM n GROUP BY entity, p"""))
def w6(spark: SparkSession, sf: str) -> DataFrame:
    out = P.peak_shapes(_series(spark, sf), _tops(spark, sf), E, O, X, reach=6, before=5, after=8)
    total = F.aggregate("waveform", F.lit(0.0), lambda a, x: a + x)
    return rounded(out.select("entity", "frame", "top", "top_at", "low", "amplitude", total.alias("total"), F.col("samples").cast("long").alias("held"), F.element_at("waveform", 1).alias("first")))


@query("w7_quiet_zscore", V.over("traces", body="#" + _TOPS + """,
s AS (SELECT t.entity, p, avg(value) AS m, stddev_pop(value) AS s FROM tops JOIN traces t ON t.entity = tops.entity AND frame >= CASE WHEN p < 20 THEN 0 ELSE p - 20 END
AND frame < CASE WHEN p < 20 THEN p ELSE p - 5 END GROUP BY 1, 2 HAVING stddev_pop(value) > 0),
b AS (SELECT *, floor((s - min(s) OVER w) / nullif(max(s) OVER w - min(s) OVER w, 0) * 10) AS b FROM s WINDOW w AS (PARTITION BY entity)),
q AS (SELECT entity, avg(m) AS m, avg(s) AS s FROM b WHERE b = 0 GROUP BY 1) SELECT t.entity, CAST(frame AS INT) AS frame, round((value - m) / s, 6) AS z FROM traces t LEFT JOIN q USING (entity)"""))
def w7(spark: SparkSession, sf: str) -> DataFrame:
    z = P.quiet_zscore(_series(spark, sf), _tops(spark, sf), E, O, X, far=20, near=5)
    # stretches of two samples give halves of the sixth place, which SQL rounds as a multiple of it and not by the decimals of the number
    return z.select("entity", "frame", (F.round(F.col("z") * 1e6) / 1e6).alias("z"))


@query("w8_baselined", V.over("traces", body="""#z AS (SELECT entity, frame, value - min(value) OVER (PARTITION BY entity) AS value FROM traces),
e AS (SELECT entity, min(frame) AS a, max(frame) AS b, arg_min(value, frame) AS va, arg_max(value, frame) AS vb FROM z GROUP BY 1),
p AS (SELECT entity, frame, value, TRUE AS keep FROM z UNION ALL SELECT entity, a - j, va, FALSE FROM e, unnest(range(1, 16)) AS u(j) UNION ALL SELECT entity, b + j, vb, FALSE FROM e, unnest(range(1, 16)) AS u(j)),
q AS (SELECT *, quantile_cont(value, 0.05) OVER (PARTITION BY entity ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS q FROM p) SELECT entity, CAST(frame AS INT) AS frame, round(value - q, 6) AS relative FROM q WHERE keep"""))
def w8b(spark: SparkSession, sf: str) -> DataFrame:
    return W.baselined(_series(spark, sf), E, O, X, 30, 0.05, log=True, from_zero=True).select("entity", "frame", r("relative"))


def _savgol() -> str:
    w = P.polynomial_weights(11, 3)
    mid = " + ".join(f"{w[5][j]!r}::DOUBLE * lead(value, {j - 5}) OVER w".replace("np.float64(", "").replace(")::", "::") for j in range(11))
    at = lambda row, base: " + ".join(f"{float(row[j])!r}::DOUBLE * max(CASE WHEN frame = {base}{j} THEN value END) OVER v" for j in range(11))
    first = " ".join(f"WHEN frame = {i} THEN {at(w[i], '')}" for i in range(5))
    last = " ".join(f"WHEN frame = n - {11 - i} THEN {at(w[i], 'n - 11 + ')}" for i in range(6, 11))
    return V.over("traces", body=f"#c AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM traces) SELECT entity, CAST(frame AS INT) AS frame, round(CASE {first} {last} ELSE {mid} END, 6) AS smooth FROM c WINDOW w AS (PARTITION BY entity ORDER BY frame), v AS (PARTITION BY entity)")


@query("w9_polynomial_smooth", _savgol())
def w9(spark: SparkSession, sf: str) -> DataFrame:
    return P.polynomial_smooth(_series(spark, sf), E, O, X).select("entity", "frame", r("smooth"))


@query("w10_find_peaks", V.over("traces", body="""#g AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY entity ORDER BY frame) THEN 0 ELSE 1 END AS c FROM traces), h AS (SELECT *, sum(c) OVER (PARTITION BY entity ORDER BY frame) AS g FROM g),
u AS (SELECT entity, g, min(frame) AS a, max(frame) AS b, min(value) AS v FROM h GROUP BY entity, g), m AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS n FROM u WINDOW w AS (PARTITION BY entity ORDER BY g)),
p AS (SELECT entity, (a + b) // 2 AS p, v FROM m WHERE v > l AND v > n AND v >= 100),
lo AS (SELECT p.entity, p, coalesce(max(frame), -1) AS lo FROM p LEFT JOIN traces t ON t.entity = p.entity AND frame < p AND value > v GROUP BY 1, 2), hi AS (SELECT
p.entity, p, coalesce(min(frame), 1000000) AS hi FROM p LEFT JOIN traces t ON t.entity = p.entity AND frame > p AND value > v GROUP BY 1, 2),
b AS (SELECT p.entity, p.p, v, min(value) FILTER (frame <= p.p) AS lm, min(value) FILTER (frame >= p.p) AS rm FROM p JOIN lo USING (entity, p) JOIN hi USING (entity, p)
JOIN traces t ON t.entity = p.entity AND frame > lo AND frame < hi GROUP BY 1, 2, 3)
SELECT entity, CAST(p AS INT) AS frame, round(v, 6) AS value, round(v - greatest(lm, rm), 6) AS prominence FROM b WHERE v - greatest(lm, rm) >= 50"""))
def w10(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.find_peaks(_series(spark, sf), E, O, X, height=100, distance=1, prominence=50))


@query("w18_dejitter_clock", """WITH e AS (SELECT user_id AS entity, event_id, epoch_us(ts) / 1e6 AS t, epoch_us(ts) // 1000 - (event_id % 7) * 40 AS ms FROM events),
n AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY entity) AS n, t - ((ms - first_value(ms) OVER w) / 1000 + first_value(t) OVER w) AS a FROM e WINDOW w AS (PARTITION BY entity ORDER BY event_id)),
m AS (SELECT *, a - CASE WHEN n <= 11 THEN avg(a) OVER (PARTITION BY entity) ELSE (sum(a) OVER (PARTITION BY entity ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) +
greatest(0, 5 - i) * first_value(a) OVER (PARTITION BY entity ORDER BY i) + greatest(0, i + 6 - n) * last_value(a) OVER (PARTITION BY entity ORDER BY i ROWS BETWEEN
UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 11 END AS d FROM n)
SELECT event_id, round(CASE WHEN d > 0.02 THEN t - d ELSE t END - 1704067200, 4) AS t_adjusted FROM m""")
def w18(spark: SparkSession, sf: str) -> DataFrame:
    e = V.events(spark, sf).select("user_id", "event_id", (F.col("us") / 1e6).alias("t"), (F.expr("us div 1000") - F.col("event_id") % 7 * 40).alias("ms"))
    return W.dejittered(e, ["user_id"], "event_id", "t", "ms", window=5).select("event_id", F.round(F.col("t_adjusted") - 1704067200, 4).alias("t_adjusted"))


@query("w20_frame_clock", V.over("traces", "ev", body="""#s AS (SELECT user_id AS entity, min(us) / 1e6 AS on_ FROM ev WHERE event_type = 'purchase' GROUP BY 1)
SELECT entity, CAST(frame AS INT) AS frame, round(t - min(t) OVER (PARTITION BY entity) + on_ - 1704067200, 4) AS t_frame FROM traces JOIN s USING (entity) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY t DESC) > 1"""))
def w20(spark: SparkSession, sf: str) -> DataFrame:
    on = V.events(spark, sf).where("event_type = 'purchase'").groupBy(F.col("user_id").alias("entity")).agg((F.min("us") / 1e6).alias("on"))
    return W.frame_clock(_series(spark, sf), on, E, "t", "on", from_zero=True).select("entity", "frame", F.round(F.col("t_frame") - 1704067200, 4).alias("t_frame"))


@query("w21_circular_smooth", V.over("matrix", body=f"SELECT entity, (bin + d + 64) % 64 AS bin, round(sum(value * w), 6) AS smooth FROM matrix, {_KSQL} GROUP BY ALL"))
def w21(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.circular_smooth(V.matrix(spark, sf), E, "value", 64, S.gaussian_kernel(10)))


@query("w22_trimmed_convolve", V.over("traces", body="SELECT entity, CAST(frame AS INT) AS frame, round(" + " + ".join(f"{x} * coalesce(lead(value, {2 - j}) OVER w, 0)" for j, x in enumerate([1.0, 2.0, 3.0, 4.0])) + ", 6) AS smooth FROM traces WINDOW w AS (PARTITION BY entity ORDER BY frame)"))
def w22(spark: SparkSession, sf: str) -> DataFrame:
    return W.trimmed_convolution(_series(spark, sf), E, O, X, [1.0, 2.0, 3.0, 4.0]).select("entity", "frame", r("smooth"))


@query("w27_peak_pipeline")
def w27(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL for its transients; tested by its parts."""
    t = _series(spark, sf)
    a = P.peak_pipeline(t, E, O, X, baseline={"width": 20, "q": 0.1}, smooth={"width": 5, "order": 2}, algorithm="maxima", height=0.1, distance=3, prominence=0.35)
    b = P.peak_pipeline(t, E, O, X, smooth={"width": 5, "order": 2}, m=2, times=1.0, timeout=2.0, first=5)
    return a.unionByName(b, allowMissingColumns=True)
