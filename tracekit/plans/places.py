"""Queries over tuning curves, place fields, tests and permutations. Registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.functions import scalars as S
from tracekit.operators import curves as C
from tracekit.operators import testing as X
from tracekit.operators import tuning as T
from tracekit.plans import fixtures as V
from tracekit.plans.queries import _KSQL, _RATES, _TT, DRAWS, query, r, rounded

DAY = V.DAY


def _frames(spark: SparkSession, sf: str, bins: int = 100) -> DataFrame:
    return V.frames(spark, sf, bins)


@query("t1_valid_positions", V.over("frames", body=f"SELECT frame FROM frames WHERE lap > 0 AND t - lap * {DAY // 10**6} BETWEEN 21600 AND 64800 AND frame % 11 > 0 AND frame % 13 > 0"))
def t1(spark: SparkSession, sf: str) -> DataFrame:
    f = _frames(spark, sf).withColumn("clock", F.lit(1))
    day = DAY // 10**6
    runs = f.select("clock", "lap").distinct().select("clock", (F.col("lap") * day + 21600.0).alias("start"), (F.col("lap") * day + 64800.0).alias("stop"), F.col("lap").alias("segment"))
    return T.valid_positions(f, runs, ["clock"], "t", 43200.0, f.where("frame % 11 = 0"), f.where("frame % 13 > 0")).select("frame")


@query("t2_occupancy_median", V.over("frames", body="#d AS (SELECT median(d) AS dt FROM (SELECT lead(t) OVER (ORDER BY frame) - t AS d FROM frames)) SELECT bin, round(count(*) * (SELECT dt FROM d), 3) AS occupancy FROM frames GROUP BY bin"))
def t2(spark: SparkSession, sf: str) -> DataFrame:
    return T.occupancy(_frames(spark, sf), "t").withColumn("occupancy", F.round("occupancy", 3))


_BY_SESSION = """#f AS (SELECT *, lap % 2 AS session FROM frames), s AS (SELECT entity, frame, session FROM spikes JOIN f USING (frame)), occ AS (SELECT session, bin, count(*) * 0.1 AS occupancy FROM f GROUP BY ALL),
rates AS (SELECT session, entity, bin, occupancy, coalesce(n, 0) / occupancy AS rate FROM (SELECT DISTINCT session, entity FROM s) JOIN occ USING (session) LEFT JOIN
(SELECT s.session, entity, bin, count(*) AS n FROM s JOIN f USING (frame) GROUP BY ALL) USING (session, entity, bin))"""


def _sessions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    f = _frames(spark, sf).withColumn("session", F.col("lap") % 2)
    return V.spikes(spark, sf).join(f.select("frame", "session"), "frame"), f


@query("t4_rates_by_session", V.over("frames", "spikes", body=_BY_SESSION + " SELECT session, entity, bin, round(occupancy, 6) AS occupancy, round(rate, 6) AS rate FROM rates"))
def t4(spark: SparkSession, sf: str) -> DataFrame:
    s, f = _sessions(spark, sf)
    return rounded(T.raw_rates(s, f, T.occupancy(f, 0.1, ("session",)), ("session",)))


@query("t5_smoothed_both", V.over("frames", "spikes", body=_RATES + f""", r AS (SELECT entity, (bin + d + 100) % 100 AS bin, sum(rate * w) AS rate FROM rates, {_KSQL} GROUP BY ALL), o AS (SELECT (bin + d + 100) % 100 AS bin, sum(occupancy *
w) AS occupancy FROM occ, {_KSQL} GROUP BY ALL) SELECT entity, bin, round(rate, 6) AS rate, round(occupancy, 6) AS occupancy FROM r JOIN o USING (bin)"""))
def t5(spark: SparkSession, sf: str) -> DataFrame:
    f = _frames(spark, sf)
    occ = T.occupancy(f, 0.1)
    return rounded(T.smoothed_rates(T.raw_rates(V.spikes(spark, sf), f, occ), occ, 100, S.gaussian_kernel(10)))


_LAPS = V.over("spikes", body="""#f AS (SELECT event_id AS frame, epoch_us(ts) // 86400000000 AS lap, CAST(floor((epoch_us(ts) % 86400000000) / 86400000000.0::DOUBLE * 20) AS INT) AS bin FROM events),
occ AS (SELECT lap, bin, count(*) * 0.1 AS occupancy FROM f GROUP BY ALL), laps AS (SELECT lap, entity, bin, coalesce(n, 0) / occupancy AS rate FROM occ CROSS JOIN
(SELECT DISTINCT entity FROM spikes) LEFT JOIN (SELECT lap, entity, bin, count(*) AS n FROM spikes JOIN f USING (frame) GROUP BY ALL) USING (lap, entity, bin))""")


@query("t6_lap_rates", _LAPS + " SELECT lap, entity, bin, round(rate, 6) AS rate FROM laps")
def t6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.rates_by_lap(V.spikes(spark, sf), _frames(spark, sf, 20), 0.1))


@query("t13_lap_reliability", _LAPS + """, r AS (SELECT *, avg(rate) OVER (PARTITION BY entity, lap) AS m FROM laps), s AS (SELECT entity, lap, avg(CASE WHEN m > 0 THEN rate / m END) AS strength FROM r WHERE bin
BETWEEN entity % 16 AND entity % 16 + 4 GROUP BY ALL) SELECT entity, round(avg(CASE WHEN coalesce(strength > 1, FALSE) THEN 1.0 ELSE 0 END), 6) AS share, count(*) FILTER
(coalesce(strength > 1, FALSE)) AS laps FROM s GROUP BY entity""")
def t13(spark: SparkSession, sf: str) -> DataFrame:
    laps = T.rates_by_lap(V.spikes(spark, sf), _frames(spark, sf, 20), 0.1)
    fields = V.spikes(spark, sf).select("entity").distinct().withColumn("bin", F.explode(F.sequence((F.col("entity") % 16).cast("int"), (F.col("entity") % 16 + 4).cast("int"))))
    return rounded(T.reliability_summary(T.lap_reliability(laps, fields)))


def _tested(frames: DataFrame, spikes: DataFrame, p: float) -> DataFrame:
    return T.shuffle_tested(T.raw_rates(spikes, frames, T.occupancy(frames, 0.1)), spikes, frames, DRAWS, p)


@query("t9_candidates", V.over("frames", "spikes", body=_RATES + """, placed AS (SELECT frame, lap, bin, row_number() OVER (PARTITION BY lap ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY lap) AS length FROM frames),
drawn AS (SELECT shuffle, entity, lap, length, i - (CAST('0x' || substr(md5('7-' || shuffle || '-' || lap), 1, 8) AS BIGINT) % length) AS j FROM spikes JOIN placed USING (frame), unnest(range(1, 1001)) AS u(shuffle)),
nulls AS (SELECT shuffle, entity, p.bin, count(*) AS n FROM drawn d JOIN placed p ON p.lap = d.lap AND p.i = ((d.j % d.length) + d.length) % d.length GROUP BY ALL),
lim AS (SELECT entity, bin, quantile_cont(coalesce(n, 0) / occupancy, 0.9) AS lim FROM rates CROSS JOIN unnest(range(1, 1001)) AS u(shuffle) LEFT JOIN nulls USING (shuffle, entity, bin) GROUP BY ALL)
SELECT entity, 2 * count(*) FILTER (rate > lim) AS bins, 2 * count(*) FILTER (rate > lim) >= 5 AS candidate FROM rates JOIN lim USING (entity, bin) GROUP BY entity"""))
def t9(spark: SparkSession, sf: str) -> DataFrame:
    return T.candidates(_tested(_frames(spark, sf), V.spikes(spark, sf), 0.9))


_FIELDS = """#placed AS (SELECT frame, lap, bin, row_number() OVER (PARTITION BY lap ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY lap) AS length FROM frames),
own AS (SELECT entity, lap, length, i FROM place_spikes JOIN placed USING (frame)),
drawn AS (SELECT shuffle, entity, lap, length, i - (CAST('0x' || substr(md5('7-' || shuffle || '-' || lap), 1, 8) AS BIGINT) % length) AS j FROM own, unnest(range(1, 1001)) AS u(shuffle)),
nulls AS (SELECT shuffle, entity, p.bin, count(*) AS n FROM drawn d JOIN placed p ON p.lap = d.lap AND p.i = ((d.j % d.length) + d.length) % d.length GROUP BY ALL),
occ AS (SELECT bin, count(*) * 0.1 AS occupancy FROM frames GROUP BY bin), real AS (SELECT entity, bin, count(*) AS n FROM place_spikes JOIN frames USING (frame) GROUP BY ALL),
rates AS (SELECT entity, bin, occupancy, coalesce(n, 0) / occupancy AS rate FROM (SELECT DISTINCT entity FROM place_spikes) CROSS JOIN occ LEFT JOIN real USING (entity, bin)),
lim AS (SELECT entity, bin, quantile_cont(coalesce(n, 0) / occupancy, 0.99) AS lim FROM rates CROSS JOIN unnest(range(1, 1001)) AS u(shuffle) LEFT JOIN nulls USING (shuffle, entity, bin) GROUP BY ALL),
tested AS (SELECT entity, bin, rate, rate > lim AS sure FROM rates JOIN lim USING (entity, bin)),
means AS (SELECT entity, sum(rate) / 100 AS mean FROM tested GROUP BY entity),
curve AS (SELECT entity, bin, coalesce(rate, 0) AS rate, coalesce(sure, FALSE) AS sure, coalesce(sure, FALSE) OR coalesce(rate, 0) > 2 * mean AS wide FROM means CROSS JOIN unnest(range(0, 100)) AS u(bin) LEFT JOIN tested USING (entity, bin)),
islands AS (
  SELECT entity, kind, bin, bin - row_number() OVER (PARTITION BY entity, kind ORDER BY bin) AS g
  FROM (SELECT entity, bin, 'sure' AS kind FROM curve WHERE sure UNION ALL SELECT entity, bin, 'wide' FROM curve WHERE wide)
), spans AS (SELECT entity, kind, g, min(bin) AS first, max(bin) AS last FROM islands GROUP BY ALL),
joined AS (
  SELECT s.entity, s.kind, s.g, CASE WHEN s.first = 0 AND e.first IS NOT NULL THEN e.first ELSE s.first END AS start
  FROM spans s LEFT JOIN spans e ON e.entity = s.entity AND e.kind = s.kind AND e.last = 99 AND e.g <> s.g
), runs AS (SELECT entity, kind, start, count(*) AS length FROM islands JOIN joined USING (entity, kind, g) GROUP BY ALL),
inside AS (SELECT entity, kind, bin, start, length FROM islands JOIN joined USING (entity, kind, g) JOIN runs USING (entity, kind, start)),
held AS (
  SELECT w.entity, w.start, w.length, count(s.bin) AS held, max(rate) AS peak_rate, min_by((w.bin - w.start + 100) % 100, (-rate, (w.bin - w.start + 100) % 100)) AS peak
  FROM inside w JOIN curve USING (entity, bin) LEFT JOIN inside s ON s.entity = w.entity AND s.kind = 'sure' AND s.bin = w.bin AND s.length >= 5 WHERE w.kind = 'wide' GROUP BY ALL
), fields AS (SELECT entity, start, length, (start + peak) % 100 AS peak, peak_rate FROM held WHERE length >= 5 AND held >= 5)"""


def _fields(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f, s = _frames(spark, sf), V.place_spikes(spark, sf)
    return f, s, T.extract_fields(_tested(f, s, 0.99), 100)


@query("t10_extract_fields", V.over("frames", "place_spikes", body=_FIELDS + """
SELECT entity, CAST(row_number() OVER (PARTITION BY entity ORDER BY length DESC, start DESC) - 1 AS INT) AS field, CAST(start AS INT) AS start, CAST(length AS INT) AS length, CAST(peak AS INT) AS peak, round(peak_rate, 6) AS peak_rate,
row_number() OVER (PARTITION BY entity ORDER BY peak_rate DESC, length DESC, start DESC) = 1 AS best FROM fields"""))
def t10(spark: SparkSession, sf: str) -> DataFrame:
    _, _, fields = _fields(spark, sf)
    return rounded(fields.select("entity", "field", F.col("bins")[0].alias("start"), F.size("bins").alias("length"), "peak", "peak_rate", "best"))


_RELIABLE = """, lap_occ AS (SELECT lap, bin, count(*) * 0.1 AS occupancy FROM frames GROUP BY ALL), lap_n AS (SELECT lap, entity, bin, count(*) AS n FROM place_spikes JOIN frames USING (frame) GROUP BY ALL),
laps AS (SELECT lap, entity, bin, coalesce(n, 0) / occupancy AS rate FROM lap_occ CROSS JOIN means LEFT JOIN lap_n USING (lap, entity, bin)), over_ AS (SELECT *, avg(rate) OVER (PARTITION BY entity, lap) AS m FROM laps),
field_bins AS (SELECT DISTINCT entity, CAST((start + d) % 100 AS INT) AS bin FROM fields, unnest(range(0, length)) AS u(d)),
strengths AS (SELECT entity, lap, avg(CASE WHEN m > 0 THEN rate / m END) AS strength FROM over_ JOIN field_bins USING (entity, bin) GROUP BY ALL),
summary AS (SELECT entity, avg(CASE WHEN coalesce(strength > 1, FALSE) THEN 1.0 ELSE 0 END) AS share, count(*) FILTER (coalesce(strength > 1, FALSE)) AS laps FROM strengths GROUP BY entity),
top AS (SELECT * FROM fields QUALIFY row_number() OVER (PARTITION BY entity ORDER BY peak_rate DESC, length DESC, start DESC) = 1)
SELECT entity, CAST(peak AS INT) AS peak, round(peak_rate, 6) AS peak_rate, round(share, 6) AS share, laps FROM top JOIN summary USING (entity)
WHERE laps >= greatest(round_even((SELECT count(DISTINCT lap) FROM frames) * 0.2, 0), 2)"""


@query("t14_refined_fields", V.over("frames", "place_spikes", body=_FIELDS + _RELIABLE))
def t14(spark: SparkSession, sf: str) -> DataFrame:
    f, s, fields = _fields(spark, sf)
    summary = T.reliability_summary(T.lap_reliability(T.rates_by_lap(s, f, 0.1), fields.select("entity", F.explode("bins").alias("bin"))))
    out = T.refined_fields(fields, summary, f.select("lap").distinct().count()).join(summary, "entity")
    return rounded(out.select("entity", "peak", "peak_rate", "share", "laps"))


@query("t15_place_tuning")
def t15(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain for two lap types; no SQL, as ``t10`` and ``t14`` hold its steps: tested against the chain of one lap type."""
    f = _frames(spark, sf).withColumn("session", F.col("lap") % 2)
    s = V.place_spikes(spark, sf).join(f.select("frame", "session"), "frame")
    return rounded(T.place_tuning(s, f, 0.1, 100, S.gaussian_kernel(10), DRAWS, k=("session",)))


@query("t16_field_windows", V.over("frames", "spikes", body="""#n AS (SELECT entity, bin, count(*) AS n FROM spikes JOIN frames USING (frame) GROUP BY ALL), p AS (SELECT entity, bin AS peak FROM (SELECT *, row_number() OVER
(PARTITION BY entity ORDER BY n DESC, bin) AS k FROM n) WHERE k = 1) SELECT entity, peak, CASE WHEN peak >= 90 OR peak <= 10 THEN 'start' WHEN peak BETWEEN 40 AND 65 THEN
'mid' ELSE 'place' END AS one, CASE WHEN peak >= 90 OR peak <= 10 THEN 'start' WHEN peak BETWEEN 20 AND 70 THEN 'mid' ELSE 'place' END AS two, CASE WHEN peak >= 90 OR
peak <= 10 THEN 'start' WHEN peak BETWEEN 40 AND 70 THEN 'mid' ELSE 'place' END AS stimulus FROM p"""))
def t16(spark: SparkSession, sf: str) -> DataFrame:
    n = V.spikes(spark, sf).join(_frames(spark, sf), "frame").groupBy("entity", "bin").agg(F.count("*").alias("n"))
    p = n.groupBy("entity").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("peak"))
    at = F.col("peak")
    return p.select("entity", "peak", C.field_class(at, middle=T.field_window(1, 1)).alias("one"), C.field_class(at, middle=T.field_window(1, 2)).alias("two"), C.field_class(at, middle=T.field_window(2, 2, True)).alias("stimulus"))


@query("t17_other_curves", V.over("frames", "spikes", body="SELECT entity, lap % 4 AS kind, CASE lap % 4 WHEN 1 THEN 'OMITCUE1' WHEN 2 THEN 'SWITCH' END AS name, bin, count(*) AS n FROM spikes JOIN frames USING (frame) WHERE lap % 4 IN (1, 2) GROUP BY ALL"))
def t17(spark: SparkSession, sf: str) -> DataFrame:
    n = V.spikes(spark, sf).join(_frames(spark, sf), "frame").groupBy("entity", (F.col("lap") % 4).alias("kind"), "bin").agg(F.count("*").alias("n"))
    return T.other_curves(n, spark.createDataFrame([(0, "CUE1"), (1, "OMITCUE1"), (2, "SWITCH")], "kind long, name string"), "kind", 0).select("entity", "kind", "name", "bin", "n")


# --- tests; tails of Student's t in SQL by Simpson's rule over the density

_TAIL = """t_tails AS (SELECT key, 1 - 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * sum(CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END *
pow(1 + pow(abs(t) * i / 400.0, 2) / df, -(df + 1) / 2.0)) * abs(t) / 1200 AS p FROM t_in, unnest(range(401)) AS u(i) GROUP BY key, t, df)"""


#: t not rounded, as p is taken from it.
_EXACT_T = "WITH " + _TT[1:].replace("round((ma - mb)", "((ma - mb)").replace(", 6) AS t", ") AS t")


@query("h2_t_test_p", f"WITH s AS ({_EXACT_T}), t_in AS (SELECT user_id AS key, t, CAST(df AS DOUBLE) AS df FROM s), {_TAIL} SELECT user_id, round(s.t, 6) AS t, s.df AS df, round(p, 5) AS p FROM s JOIN t_tails ON key = user_id")
def h2(spark: SparkSession, sf: str) -> DataFrame:
    out = X.t_test(V.table(spark, sf, "events"), ["user_id"], "event_type", "value", "click", "view")
    return out.select("user_id", r("t"), "df", F.round("p", 5).alias("p"))


@query("h3_paired_t_p", f"""WITH m AS (SELECT user_id, avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view') AS d FROM events GROUP BY 1),
t_in AS (SELECT user_id % 10 AS key, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t, CAST(count(d) - 1 AS DOUBLE) AS df FROM m GROUP BY 1 HAVING count(d) > 1 AND
stddev_samp(d) > 0), {_TAIL} SELECT key AS grp, round(t, 5) AS t, round(p, 5) AS p FROM t_in JOIN t_tails USING (key)""")
def h3(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    pairs = V.table(spark, sf, "events").groupBy("user_id").agg(mean("click").alias("a"), mean("view").alias("b")).withColumn("grp", F.col("user_id") % 10)
    return X.paired_t(pairs, ["grp"], "a", "b").select("grp", F.round("t", 5).alias("t"), F.round("p", 5).alias("p"))


@query("h4_pair_tests", f"WITH s AS ({_EXACT_T}), t_in AS (SELECT user_id AS key, t, CAST(df AS DOUBLE) AS df FROM s), {_TAIL}, d AS (SELECT user_id, " + ", ".join(f"round({f}(value) FILTER (event_type = '{t}'), 6) AS {n}_{t}" for t in ("click", "view") for f, n in (("avg", "mean"), ("median", "median"), ("stddev_pop", "sd"))) + ", avg(value) FILTER (event_type = 'click') > avg(value) FILTER (event_type = 'view') AS higher FROM events GROUP BY 1) SELECT d.*, round(s.t, 6) AS stat, round(p, 5) AS p, p < 0.05 AS significant FROM d JOIN s USING (user_id) JOIN t_tails ON key = user_id")
def h4(spark: SparkSession, sf: str) -> DataFrame:
    out = X.pair_tests(V.table(spark, sf, "events"), ["user_id"], "event_type", "value", "click", "view")
    return out.select(*[F.round(c, 5 if c == "p" else 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_MW = """WITH e AS (SELECT user_id, event_type, value FROM events WHERE event_type IN ('click', 'view')),
k AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY user_id, value) AS c FROM e),
s AS (SELECT user_id, sum(rank) FILTER (event_type = 'click') AS ra, count(*) FILTER (event_type = 'click') AS na, count(*) FILTER (event_type = 'view') AS nb, count(*) AS n, sum(c * c - 1) AS tie FROM k GROUP BY 1),
u AS (SELECT *, CAST(ra - na * (na + 1) / 2 AS DOUBLE) AS u FROM s WHERE na > 0 AND nb > 0),
z AS (SELECT user_id, u, (greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sqrt(na * nb / 12 * (n + 1 - tie / (n * (n - 1)))) AS z FROM u)"""


@query("h1_mann_whitney_p", _MW + " SELECT z.user_id, round(any_value(u), 6) AS u, round(any_value(z), 6) AS z, round(least(1, 1 - 2 * sum(CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z * i / 400.0, 2) / 2)) * any_value(z) / 1200 / sqrt(2 * pi())), 5) AS p FROM z, unnest(range(401)) AS g(i) GROUP BY 1")
def h1(spark: SparkSession, sf: str) -> DataFrame:
    out = X.mann_whitney(V.table(spark, sf, "events"), ["user_id"], "event_type", "value", "click", "view", exact=False)
    return out.select("user_id", r("u"), r("z"), F.round("p", 5).alias("p"))


@query("h1_mann_whitney_exact")
def h1b(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL for the exact distribution of U: tested against all orders of small samples."""
    return rounded(X.mann_whitney(V.table(spark, sf, "events"), ["user_id"], "event_type", "value", "click", "view"))


@query("h6_condition_effect", """WITH o AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS i FROM events WHERE event_type IN ('click', 'view')),
s AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS na, count(*) FILTER (event_type = 'view') AS nb FROM o GROUP BY 1 HAVING na > 0 AND nb > 0),
d AS (SELECT user_id, g.event_type, CASE WHEN g.event_type = 'click' THEN na ELSE nb END AS m, iter, unnest(range(1, greatest(na, nb) + 1)) AS j FROM s, (VALUES ('click'), ('view')) AS g(event_type), unnest(range(1, 1001)) AS u(iter)),
p AS (SELECT d.user_id, iter, avg(value) FILTER (d.event_type = 'click') - avg(value) FILTER (d.event_type = 'view') AS diff FROM d JOIN o ON o.user_id = d.user_id AND
o.event_type = d.event_type AND o.i = CAST('0x' || substr(md5('11-' || d.user_id || '-' || d.event_type || '-' || iter || '-' || j), 1, 8) AS BIGINT) % m GROUP BY 1, 2),
b AS (SELECT user_id, stddev_pop(diff) AS sd FROM p GROUP BY 1), e AS (SELECT user_id, avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view')
AS diff FROM events GROUP BY 1), f AS (SELECT *, CAST(sign(diff) AS INT) AS sign FROM e WHERE diff IS NOT NULL), m AS (SELECT sign, avg(diff) AS m FROM f WHERE abs(diff)
< 30 GROUP BY 1)
SELECT f.user_id, round(diff, 6) AS diff, round(sd, 6) AS sd, f.sign, coalesce(abs(diff) >= abs(m), FALSE) AS kept FROM f LEFT JOIN b USING (user_id) LEFT JOIN m ON m.sign = f.sign""")
def h6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.condition_effect(V.table(spark, sf, "events"), ["user_id"], "event_type", "value", "event_id", "click", "view", DRAWS, 30))


@query("h7_permuted_bins", V.over("traces", body="""#c AS (SELECT entity, CASE WHEN row_number() OVER w <= count(*) OVER (PARTITION BY entity) // 2 THEN 'a' ELSE 'b' END AS context, frame, value FROM traces WINDOW w AS (PARTITION BY entity ORDER BY frame)),
n AS (SELECT *, count(*) OVER (PARTITION BY entity, context) AS n, row_number() OVER (PARTITION BY entity, context ORDER BY frame) - 1 AS i FROM c), r AS (SELECT entity,
context, CAST(least(i // greatest(n // 10, 1), 9) AS INT) AS bin, avg(value) AS mean FROM n GROUP BY ALL),
s AS (SELECT entity, context, iter, n, value, row_number() OVER (PARTITION BY entity, context, iter ORDER BY CAST('0x' || substr(md5('13-' || entity || '-' || context ||
'-' || iter || '-' || frame), 1, 8) AS BIGINT), frame) - 1 AS j FROM n, unnest(range(1, 1001)) AS u(iter)),
m AS (SELECT entity, context, iter, CAST(least(j // greatest(n // 10, 1), 9) AS INT) AS bin, avg(value) AS m FROM s GROUP BY ALL), g AS (SELECT entity, context, bin,
any_value(mean) AS mean, avg(m) AS a, stddev_samp(m) AS s, count(*) AS c FROM m JOIN r USING (entity, context, bin) GROUP BY ALL)
SELECT entity, context, bin, round(mean, 6) AS mean, round(CASE WHEN s > 0 THEN (a - mean) / (s / sqrt(c)) END, 4) AS t, c - 1 AS df FROM g"""))
def h7(spark: SparkSession, sf: str) -> DataFrame:
    return _permuted(spark, sf).select("entity", "context", "bin", r("mean"), F.round("t", 4).alias("t"), "df")


def _permuted(spark: SparkSession, sf: str) -> DataFrame:
    from tracekit.operators.segments import labelled_halves

    t = labelled_halves(V.traces(spark, sf), ["entity"], "frame", "a", "b")
    return X.permuted_bins(t, ["entity", "context"], "frame", "value", 10, DRAWS)


@query("h8_context_classes", V.over("traces", body="""#p AS (SELECT entity, CASE WHEN frame % 2 = 0 THEN 'a' ELSE 'b' END AS c, count(*) FILTER (value / 1000 < 0.05) >= 11 AS ok FROM traces GROUP BY ALL), q AS (SELECT
entity, bool_or(ok) FILTER (c = 'a') AS a, bool_or(ok) FILTER (c = 'b') AS b FROM p GROUP BY 1) SELECT entity, CASE WHEN a AND b THEN 'both' WHEN a THEN 'first' WHEN b
THEN 'second' ELSE 'none' END AS kind FROM q"""))
def h8(spark: SparkSession, sf: str) -> DataFrame:
    t = V.traces(spark, sf).select("entity", F.when(F.col("frame") % 2 == 0, "a").otherwise("b").alias("context"), (F.col("value") / 1000).alias("p"))
    return X.context_classes(t, "entity", "context", "p", "a", "b", 11)


@query("h8_permuted_classes")
def h8b(spark: SparkSession, sf: str) -> DataFrame:
    """The classes that follow from ``h7_permuted_bins``; its p is tested on its own."""
    return X.context_classes(_permuted(spark, sf), "entity", "context", "p", "a", "b")


@query("h10_classify_entities", """WITH t AS (SELECT user_id, event_type AS main, avg(value) > 60 AND count(*) > 9 AS hit FROM events WHERE event_type IN ('click', 'error') GROUP BY ALL), h AS (SELECT user_id, string_agg(main, ',' ORDER BY main) AS cues FROM t WHERE hit GROUP BY 1),
f AS (SELECT user_id, CASE WHEN min(value) < 1 THEN 'place' WHEN min(value) < 2 THEN 'start' END AS class FROM events GROUP BY 1) SELECT u.user_id, CASE WHEN u.user_id %
9 = 0 THEN 'listed' WHEN cues IS NOT NULL THEN 'cue' WHEN class IS NOT NULL THEN class ELSE 'non' END AS kind, coalesce(cues, '') AS cues FROM (SELECT DISTINCT user_id
FROM events) u LEFT JOIN h USING (user_id) LEFT JOIN f USING (user_id)""")
def h10(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events")
    tested = e.where("event_type in ('click', 'error')").groupBy("user_id", F.col("event_type").alias("main")).agg((F.avg("value") > 60).alias("higher"), (F.count("*") > 9).alias("significant")).withColumn("comp", F.lit("omit"))
    low = F.min("value")
    fields = e.groupBy("user_id").agg(F.when(low < 1, "place").when(low < 2, "start").alias("class"))
    out = X.classified(e, e.where("user_id % 9 = 0"), tested, fields, "user_id")
    return out.withColumn("cues", F.array_join("cues", ","))


@query("h12_group_session_tests", f"""WITH s AS (SELECT c_mktsegment AS session, c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS grp, c_acctbal AS balance, CAST(c_custkey % 17 AS DOUBLE) AS
share FROM customer), l AS (UNPIVOT (SELECT session, grp, balance, share FROM s) ON balance, share INTO NAME variable VALUE value),
m AS (SELECT session, variable, avg(value) FILTER (grp = 'a') AS ma, avg(value) FILTER (grp = 'b') AS mb, var_samp(value) FILTER (grp = 'a') AS va, var_samp(value) FILTER
(grp = 'b') AS vb, count(*) FILTER (grp = 'a') AS na, count(*) FILTER (grp = 'b') AS nb FROM l GROUP BY ALL),
t_in AS (SELECT session || '-' || variable AS key, session, variable, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)) AS t,
CAST(na + nb - 2 AS DOUBLE) AS df FROM m), {_TAIL} SELECT session, variable, round(t, 6) AS t, CAST(df AS BIGINT) AS df, round(p, 5) AS p FROM t_in JOIN t_tails USING
(key)""")
def h12(spark: SparkSession, sf: str) -> DataFrame:
    c = V.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("session"), F.when(F.col("c_nationkey") % 2 == 0, "a").otherwise("b").alias("grp"), F.col("c_acctbal").alias("balance"), (F.col("c_custkey") % 17).cast("double").alias("share"))
    return X.session_tests(c, ["session"], "grp", ["balance", "share"], "a", "b").select("session", "variable", r("t"), "df", F.round("p", 5).alias("p"))
