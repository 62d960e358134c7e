"""Queries over laps, epochs, event logs and clocks. Registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.operators import alignment as A
from tracekit.operators import events as L
from tracekit.operators import segments as E
from tracekit.operators import windows as W
from tracekit.plans import fixtures as V
from tracekit.plans.queries import SQL, query, r, rounded

DAY = V.DAY


def _ev(spark: SparkSession, sf: str) -> DataFrame:
    """Events with t in seconds, place i in the user's order, pos within the day and lap, the day."""
    e = V.events(spark, sf).withColumn("t", F.col("us") / 1e6).withColumn("pos", F.pmod("us", F.lit(DAY)) / F.lit(float(DAY))).withColumn("lap", F.expr(f"us div {DAY}"))
    return W.numbered(e, ["user_id"], ["event_id"], "i")


_EV = f"ev AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS t, (epoch_us(ts) % {DAY}) / {float(DAY)}::DOUBLE AS pos, epoch_us(ts) // {DAY} AS lap, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)"

# --- laps and epochs


@query("g2_laps_by_falls", f"WITH {_EV}" + """,
n AS (SELECT user_id, i, pos / max(pos) OVER (PARTITION BY user_id) AS v FROM ev), d AS (SELECT user_id, i, v - coalesce(lead(v) OVER (PARTITION BY user_id ORDER BY i), 0) AS f FROM n),
p AS (SELECT user_id, i FROM (SELECT *, lag(f) OVER w AS a, lead(f) OVER w AS b FROM d WINDOW w AS (PARTITION BY user_id ORDER BY i)) WHERE f >= 0.5 AND f > a AND f > b UNION SELECT user_id, max(i) FROM ev GROUP BY 1)
SELECT user_id, row_number() OVER w - 1 AS lap, coalesce(lag(i) OVER w + 1, 0) AS start, i AS stop FROM p WINDOW w AS (PARTITION BY user_id ORDER BY i)""")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    return E.laps_by_falls(_ev(spark, sf), ["user_id"], "i", "pos", 0.5, 1)


@query("g3_laps_by_visits", f"WITH {_EV}" + """,
d AS (SELECT 1 AS clock, event_id AS frame, pos, lead(pos) OVER (ORDER BY event_id) - pos >= -0.5 AS on_ FROM ev), g AS (SELECT *, frame - row_number() OVER (ORDER BY frame) AS g FROM d WHERE on_),
s AS (SELECT min(frame) AS start, max(frame) + 1 AS stop FROM g GROUP BY g), h AS (SELECT start, stop, count(DISTINCT least(floor(pos * 20), 19)) AS visited FROM s JOIN d ON frame BETWEEN start AND stop GROUP BY ALL)
SELECT 1 AS clock, row_number() OVER (ORDER BY start) AS lap, start, stop, visited FROM h WHERE visited >= 10""")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    f = V.frames(spark, sf).select(F.lit(1).alias("clock"), "frame", "pos")
    return E.laps_by_visits(f, ["clock"], "frame", "pos", bins=20)


@query("g4_epochs_by_speed", f"WITH {_EV}" + """,
a AS (SELECT user_id, i, t, lead(t) OVER w AS t1, (lead(pos) OVER w - pos) * 2 * pi() AS d, count(*) OVER (PARTITION BY user_id) AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY i)),
s AS (SELECT *, abs(d + pi() - floor((d + pi()) / (2 * pi())) * 2 * pi() - pi()) / (t1 - t) AS s0 FROM a), u AS (SELECT *, coalesce(s0, lag(s0) OVER (PARTITION BY user_id ORDER BY i)) AS s FROM s),
m AS (SELECT *, CASE WHEN n <= 3 THEN avg(s) OVER (PARTITION BY user_id) ELSE (sum(s) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) +
CASE WHEN i = 0 THEN s ELSE 0 END + CASE WHEN i = n - 1 THEN s ELSE 0 END) / 3 END AS m FROM u),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM m WHERE m >= 0.00002), e AS (SELECT user_id, min(t) AS a, max(t) AS b FROM g GROUP BY user_id, g HAVING max(t) - min(t) > 3600)
SELECT user_id, round(a + 600 - 1704067200, 3) AS start, round(b - 300 - 1704067200, 3) AS stop FROM e WHERE b - 300 - (a + 600) > 3600""")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    out = E.epochs_by_speed(_ev(spark, sf), ["user_id"], "i", "t", "pos", 1, least=0.00002, duration=3600, trim=(600, 300))
    return out.select("user_id", *[F.round(F.col(c) - 1704067200, 3).alias(c) for c in ("start", "stop")])


_ROUND = """#q AS (SELECT entity, segment, floor(start / 7200) * 7200 AS start, ceil(stop / 7200) * 7200 AS stop FROM intervals), h AS (SELECT t.entity, t.frame, count(q.segment) AS
n FROM traces t LEFT JOIN q ON t.entity = q.entity AND t.t BETWEEN q.start AND q.stop GROUP BY ALL) SELECT entity, frame, n > 0 AS inside FROM h"""


@query("g9_rounded_flags", V.over("traces", "intervals", body=_ROUND))
def g9(spark: SparkSession, sf: str) -> DataFrame:
    out = E.assigned(V.traces(spark, sf), E.rounded_epochs(V.intervals(spark, sf), 7200.0), ["entity"], ["frame"], "t", 86400.0)
    return out.select("entity", "frame", F.col("segment").isNotNull().alias("inside"))


@query("g12_masked_slices", V.over("traces", body="""#f AS (SELECT entity, value, CASE WHEN row_number() OVER (PARTITION BY entity ORDER BY frame) <= count(*) OVER (PARTITION BY entity) // 2 THEN 'a' ELSE 'b' END AS context, value > 100 AS state, frame % 7 < 3 AS near FROM traces),
s AS (SELECT *, 'all' AS slice FROM f UNION ALL SELECT *, CASE WHEN state THEN 'on' ELSE 'off' END FROM f UNION ALL SELECT *, 'onset' FROM f WHERE near) SELECT entity, context, slice, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY ALL"""))
def g12(spark: SparkSession, sf: str) -> DataFrame:
    t = E.labelled_halves(V.traces(spark, sf), ["entity"], "frame", "a", "b").withColumn("state", F.col("value") > 100).withColumn("near", F.col("frame") % 7 < 3)
    return rounded(E.state_means(t, ["entity"], "value", "context", "state", "near"))


@query("g14_cue_with_stimulus", f"WITH {_EV}" + """,
b AS (SELECT user_id, us, event_type AS k, lead(event_type) OVER w AS n, lag(event_type) OVER w AS p, round_even((t - lag(t) OVER w) / 20000, 0) AS d FROM ev WHERE event_type IN ('purchase', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY us)),
c AS (SELECT *, coalesce(p = 'error' AND d = 1, FALSE) AS close FROM b WHERE k = 'purchase')
SELECT user_id, us, 'plain' AS pairing FROM c WHERE n IS NULL OR n = 'error' OR NOT close UNION ALL SELECT user_id, us, 'with' FROM c WHERE close""")
def g14(spark: SparkSession, sf: str) -> DataFrame:
    e = V.events(spark, sf).withColumn("t", F.col("us") / 1e6)
    out = L.cue_with_stimulus(e, ["user_id"], "t", "event_type", "purchase", "error", 20000.0)
    return out.select("user_id", F.round(F.col("t") * 1e6).cast("long").alias("us"), "pairing")


_BINS = f"""WITH {_EV}, k AS (SELECT user_id, lap, event_type, min(pos) AS pos FROM ev WHERE event_type IN ('error', 'purchase') GROUP BY ALL),
u AS (SELECT DISTINCT user_id, event_type FROM k), l AS (SELECT DISTINCT user_id, lap FROM ev),
bins AS (SELECT l.user_id, l.lap, u.event_type, CASE WHEN pos IS NULL THEN 0 WHEN pos < 0.5 THEN 1 ELSE 2 END AS loc FROM l JOIN u USING (user_id) LEFT JOIN k ON k.user_id = l.user_id AND k.lap = l.lap AND k.event_type = u.event_type)"""


def _bins(spark: SparkSession, sf: str) -> DataFrame:
    e = _ev(spark, sf)
    k = e.where("event_type in ('error', 'purchase')").groupBy("user_id", "lap", "event_type").agg(F.min("pos").alias("pos"))
    grid = e.select("user_id", "lap").distinct().join(k.select("user_id", "event_type").distinct(), "user_id")
    return grid.join(k, ["user_id", "lap", "event_type"], "left").withColumn("at", F.expr("case when pos is null then 0 when pos < 0.5 then 1 else 2 end"))


@query("g15_lap_kinds", _BINS + ", w AS (SELECT user_id, max(loc) AS most, count(DISTINCT event_type) AS cues FROM bins GROUP BY 1), t AS (SELECT user_id, lap, list(loc ORDER BY event_type) AS locs FROM bins GROUP BY ALL), rules AS (SELECT * FROM (VALUES " + ", ".join(f"({m}, {c}, {at}, '{kind}')" for m, c, at, kind in L.LAP_RULES) + ") AS r(most, cues, locs, kind)) SELECT user_id, lap, kind FROM t JOIN w USING (user_id) JOIN rules ON rules.most = w.most AND rules.cues = w.cues AND rules.locs = t.locs")
def g15(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(L.LAP_RULES, "most int, cues long, at array<int>, kind string")
    return L.lap_kinds(_bins(spark, sf), "user_id", "lap", "event_type", "at", rules)


@query("a14_segment_code", _BINS + """, c AS (SELECT user_id, lap, CAST(sum(loc * CASE event_type WHEN 'error' THEN 1 ELSE 10 END) AS BIGINT) AS code FROM bins GROUP BY ALL), d AS (SELECT *, count(*) FILTER
(code = 0) OVER (PARTITION BY user_id) AS zeros FROM c), ranked AS (SELECT user_id, code, dense_rank() OVER (PARTITION BY user_id ORDER BY code) AS kind FROM (SELECT
DISTINCT user_id, code FROM c WHERE code <> 0)), m AS (SELECT user_id, max(kind) AS most FROM ranked GROUP BY 1) SELECT d.user_id, lap, d.code, CAST(CASE WHEN d.code <> 0
THEN k.kind WHEN zeros > 2 THEN coalesce(most, 0) + 1 ELSE 0 END AS BIGINT) AS kind FROM d LEFT JOIN ranked k ON k.user_id = d.user_id AND k.code = d.code LEFT JOIN m ON
m.user_id = d.user_id""")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    from tracekit.operators.cohorts import segment_codes

    return segment_codes(_bins(spark, sf), "user_id", "lap", "event_type", "at", ["error", "purchase"])


# --- event logs


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, event_id, line): the events as records of a behaviour log, one in JSON each, some of them no JSON."""
    e = _ev(spark, sf)
    pin = F.get_json_object("props", "$.k").cast("int") % 12
    action = F.when(F.col("event_id") % 2 == 0, "open").otherwise("close")
    valve = F.struct(pin.alias("pin"), action.alias("action"))
    body = (
        F.when(F.col("event_type") == "purchase", F.to_json(F.struct(valve.alias("valve"))))
        .when(F.col("event_type") == "error", F.to_json(F.struct(F.struct(F.lit(4).alias("pin"), action.alias("action")).alias("tone"))))
        .when(F.col("event_type") == "view", F.lit('{"lick":1}'))
        .when(F.col("event_type") == "signup", F.to_json(F.struct(F.struct(F.lit("zone").alias("id"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("stop").alias("action")).alias("context"))))
    )
    t = F.col("us").cast("string")
    head = F.concat(F.lit('{"time":'), t, F.lit(',"lap":'), F.col("lap").cast("string"))
    move = F.concat(head, F.lit(',"y":'), (F.col("event_id") % 1000).cast("string"), F.lit(f',"{L.POSITION}":{{"millis":'), F.expr("us div 1000").cast("string"), F.lit("}}"))
    line = F.when(F.col("event_type") == "click", move).otherwise(F.concat(F.lit('{"time":'), t, F.lit(f',"{L.EVENT}":'), body, F.lit("}")))
    return e.select("user_id", "event_id", F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("bad "), line)).otherwise(line).alias("line"))


_CUES = [(3, "CUE1"), (4, "CUE2"), (7, "LED"), (10, "TONE")]
_CASE = "CASE pin " + " ".join(f"WHEN {p} THEN '{n}'" for p, n in _CUES) + " END"
_LOG = f"""WITH {_EV}, k AS (SELECT *, CASE event_type WHEN 'purchase' THEN CAST(json_extract(props, '$.k') AS INT) % 12 WHEN 'error' THEN 4 END AS pin, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'stop' END AS edge FROM ev WHERE event_id % 17 <> 0),
c AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN CAST(event_id % 1000 AS DOUBLE) END IGNORE NULLS) OVER w AS pos_, last_value(CASE WHEN event_type = 'click'
THEN lap END IGNORE NULLS) OVER w AS lap_ FROM k WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
told AS (SELECT *, 'position' AS channel, NULL AS edge_, NULL AS name FROM c WHERE event_type = 'click' UNION ALL SELECT *, 'lap', NULL, NULL FROM c WHERE event_type = 'click'
UNION ALL SELECT *, 'lick', NULL, NULL FROM c WHERE event_type = 'view' UNION ALL SELECT *, 'context', edge, 'zone' FROM c WHERE event_type = 'signup'
UNION ALL SELECT *, 'reward', NULL, NULL FROM c WHERE event_type = 'purchase' AND pin = 5 AND edge = 'start' UNION ALL SELECT *, 'sync', edge, NULL FROM c WHERE event_type = 'purchase' AND pin = 8
UNION ALL SELECT *, 'led', edge, NULL FROM c WHERE event_type = 'purchase' AND pin = 9 UNION ALL SELECT *, 'cue', edge, {_CASE} FROM c WHERE {_CASE} IS NOT NULL),
decoded AS (SELECT user_id, event_id, channel, edge_ AS edge, CAST(us AS DOUBLE) AS t, pos_ AS pos, CASE WHEN coalesce(edge_, '') <> 'stop' THEN lap_ END AS lap, name FROM told)"""


def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    settings = log.select("user_id").distinct().select("user_id", F.lit(8).alias("sync_pin"), F.lit(9).alias("led_pin"))
    return L.decoded_events(log, "user_id", "event_id", "line", settings, spark.createDataFrame(_CUES, "pin int, name string"))


@query("e1_decode_events", _LOG + " SELECT * FROM decoded")
def e1(spark: SparkSession, sf: str) -> DataFrame:
    return _decoded(spark, sf)


@query("e2_cue_edges", _LOG + " SELECT user_id, name, edge, row_number() OVER (PARTITION BY user_id, name, edge ORDER BY event_id) AS n, t, pos, lap FROM decoded WHERE channel = 'cue'")
def e2(spark: SparkSession, sf: str) -> DataFrame:
    return L.cue_edges(_decoded(spark, sf), "user_id", "event_id")


@query("e4_sync_times", _LOG + " SELECT user_id, arg_max(t, event_id) FILTER (edge = 'start') AS \"on\", arg_max(t, event_id) FILTER (edge = 'stop') AS off FROM decoded WHERE channel = 'sync' GROUP BY 1")
def e4(spark: SparkSession, sf: str) -> DataFrame:
    return L.sync_times(_decoded(spark, sf), "user_id", "event_id")


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    pins, at = F.array(*[F.lit(x) for x in (3, 4, 7, 10, 52, 11)]), F.array(*[F.lit(x) for x in (500, 1300, 1000, 1500)])
    li = V.table(spark, sf, "lineitem")
    pin = F.element_at(pins, (F.col("l_partkey") % 6 + 1).cast("int"))
    first = (F.col("l_suppkey") % 3).cast("int")
    return li.select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("id"), F.array(pin).alias("valves"), F.array(F.element_at(at, (F.col("l_linenumber") % 2 + F.col("l_partkey") % 2 * 2 + 1).cast("int"))).alias("locations"), F.sequence(first, first + 1).alias("laps"))


@query("e3_lap_plan", """WITH c AS (SELECT l_orderkey AS session, l_linenumber AS place, l_returnflag AS id, ([3, 4, 7, 10, 52, 11])[l_partkey % 6 + 1] AS pin, ([500, 1300, 1000,
1500])[l_linenumber % 2 + l_partkey % 2 * 2 + 1] AS loc, CAST(l_suppkey % 3 AS INT) AS f FROM lineitem),
e AS (SELECT *, CAST(unnest([f, f + 1]) AS INT) AS lap, CASE pin WHEN 3 THEN 'CUE1' WHEN 4 THEN 'CUE2' WHEN 10 THEN 'TONE' WHEN 7 THEN 'LED' WHEN 52 THEN 'OPTO' END AS cue FROM c),
g AS (SELECT session, lap, coalesce(string_agg(cue, ',' ORDER BY place, pin, loc, id), '') AS cues, list(pin ORDER BY place, pin, loc, id) AS pins, list(loc ORDER BY
place, pin, loc, id) AS locs, string_agg(id, ',' ORDER BY place, pin, loc, id) AS ids FROM e GROUP BY ALL)
SELECT session, lap, cues, array_to_string(pins, ',') AS pins, array_to_string(locs, ',') AS locs, ids, CASE WHEN list_sort(list_distinct(pins)) = [3, 4] AND locs = [500,
1300] THEN 'both' WHEN list_sort(list_distinct(pins)) = [3, 4] AND locs = [1300, 500] THEN 'both_switch'
WHEN list_sort(list_distinct(pins)) = [3, 7, 10] AND locs = [500, 1500, 1000] THEN 'toneNcueNled' WHEN list_sort(list_distinct(pins)) = [3, 7] AND locs = [1500, 1000]
THEN 'cueNled' WHEN list_sort(list_distinct(pins)) = [3, 10] AND locs = [500, 1500] THEN 'toneNcue' WHEN list_sort(list_distinct(pins)) = [7, 10] AND locs = [500, 1000]
THEN 'toneNled'
WHEN list_distinct(pins) = [3] AND len(locs) = 1 THEN 'CUE1' WHEN list_distinct(pins) = [3] AND len(locs) = 2 THEN 'both_c1' WHEN list_distinct(pins) = [4] AND len(locs)
= 1 THEN 'CUE2' WHEN list_distinct(pins) = [4] AND len(locs) = 2 THEN 'both_c2' ELSE 'unknown' END AS kind FROM g""")
def e3(spark: SparkSession, sf: str) -> DataFrame:
    names = {3: "CUE1", 4: "CUE2", 10: "TONE", 7: "LED", 52: "OPTO"}
    plan = L.lap_plan(_contexts(spark, sf), "session", names)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return plan.select("session", "lap", joined("cues"), joined("pins"), joined("locs"), joined("ids"), "kind")


@query("p11_lap_plan_type", f"SELECT kind, count(*) AS n FROM ({SQL['e3_lap_plan']}) GROUP BY 1")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    return e3(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query("e6_device_settings", """SELECT user_id, CAST(arg_max(CAST(json_extract(props, '$.k') AS INT), event_id) FILTER (event_type = 'signup') AS INT) AS sync_pin, CAST(arg_max(event_id % 10, event_id)
FILTER (event_type = 'signup' AND event_id % 3 = 0) AS INT) AS led_pin, arg_max(event_type, event_id) FILTER (event_type = 'error') AS info FROM events GROUP BY 1""")
def e6(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    led = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(',"led":'), (F.col("event_id") % 10).cast("string"))).otherwise(F.lit(""))
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit('{"settings":{"sync_pin":'), k, led, F.lit("}}"))).when(F.col("event_type") == "error", F.lit('{"sess_info":"error"}')).otherwise("{}")
    return L.device_settings(e.select("user_id", "event_id", line.alias("line")), "user_id", "event_id", "line")


# --- clocks, omitted events, numbers


_OMIT = f"WITH {_EV}, o AS (SELECT user_id, lap FROM ev GROUP BY ALL HAVING count(*) FILTER (event_type = 'click') = 0), imputed AS (SELECT user_id, lap, 'click' AS cue, arg_min(us, event_id) AS us FROM ev JOIN o USING (user_id, lap) WHERE pos > 0.5 GROUP BY 1, 2)"


def _imputed(spark: SparkSession, sf: str) -> DataFrame:
    e = _ev(spark, sf)
    laps = e.groupBy("user_id", "lap").agg(F.count_if(F.col("event_type") == "click").alias("n")).where("n = 0").select("user_id", "lap", F.lit("click").alias("cue"))
    return L.imputed_times(e.select("user_id", "lap", "event_id", "pos", "us"), laps, ["user_id"], "lap", spark.createDataFrame([("click", 0.5)], "cue string, centre double"), "event_id", "pos", "us")


@query("j7_impute_omitted_times", _OMIT + " SELECT * FROM imputed")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    return _imputed(spark, sf)


@query("j8_merge_omitted_events", _OMIT + " SELECT user_id, lap, event_type AS cue, us, FALSE AS imputed FROM ev WHERE event_type = 'click' UNION ALL SELECT *, TRUE FROM imputed")
def j8(spark: SparkSession, sf: str) -> DataFrame:
    e = _ev(spark, sf).where("event_type = 'click'").select("user_id", "lap", F.col("event_type").alias("cue"), F.col("us").alias("t"))
    return L.with_imputed(e, _imputed(spark, sf).withColumnRenamed("us", "t")).withColumnRenamed("t", "us")


@query("j14_sync_map", V.over("intervals", body="""#e AS (SELECT DISTINCT user_id AS entity, event_type, epoch_us(ts) / 1e6 AS t FROM events), a AS (SELECT e.entity, event_type, t, max(segment) AS segment FROM e JOIN
intervals i ON e.entity = i.entity AND t BETWEEN start AND stop WHERE event_type IN ('click', 'view') GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY entity, segment ORDER BY t) - 1 AS i, lead(t) OVER (PARTITION BY entity, segment ORDER BY t) AS t1, count(*) OVER (PARTITION BY entity, segment) AS n FROM a WHERE event_type = 'click'),
m AS (SELECT l.entity, l.segment, l.t, CASE WHEN l.t <= h.t THEN h.i WHEN h.t1 IS NULL THEN h.i ELSE h.i + (l.t - h.t) / (h.t1 - h.t) END AS idx FROM a l JOIN h ON
h.entity = l.entity AND h.segment = l.segment AND l.event_type = 'view' AND (h.i = 0 OR l.t >= h.t) AND (h.t1 IS NULL OR l.t < h.t1))
SELECT m.entity, m.segment, round(m.t - 1704067200, 4) AS t, round(idx, 6) AS index, round(h.t - 1704067200, 4) AS t_high FROM m JOIN h ON h.entity = m.entity AND h.segment = m.segment AND h.i = CAST(round_even(idx, 0) AS INT)"""))
def j14(spark: SparkSession, sf: str) -> DataFrame:
    e = V.events(spark, sf).select(F.col("user_id").alias("entity"), "event_type", (F.col("us") / 1e6).alias("t"))
    out = A.synced(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["entity"], "t", V.intervals(spark, sf), width=86400.0)
    return out.select("entity", "segment", F.round(F.col("t") - 1704067200, 4).alias("t"), r("index"), F.round(F.col("t_high") - 1704067200, 4).alias("t_high"))


@query("j16_reconcile_segments", V.over("traces", "intervals", body=f"""#p AS (SELECT user_id AS entity, event_id, epoch_us(ts) AS us, epoch_us(ts) // {DAY} AS lap, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click'),
a AS (SELECT entity, n, CASE WHEN event_id % 3 > 0 THEN lap END AS segment FROM p), c AS (SELECT p.entity, n, max(i.segment) AS segment FROM p LEFT JOIN intervals i ON i.entity = p.entity AND us / 1e6 BETWEEN start AND stop GROUP BY ALL),
k AS (SELECT entity, count(segment) AS kc FROM c GROUP BY 1), l AS (SELECT entity, count(segment) AS kr FROM a GROUP BY 1), u AS (SELECT entity, kc > kr AS use FROM k JOIN l USING (entity))
SELECT entity, n, segment FROM c JOIN u USING (entity) WHERE use AND segment IS NOT NULL UNION ALL SELECT entity, n, segment FROM a JOIN u USING (entity) WHERE NOT use AND segment IS NOT NULL"""))
def j16(spark: SparkSession, sf: str) -> DataFrame:
    e = W.numbered(V.events(spark, sf).where("event_type = 'click'"), ["user_id"], ["event_id"], "n").select(F.col("user_id").alias("entity"), "event_id", (F.col("us") / 1e6).alias("t"), F.expr(f"us div {DAY}").alias("lap"), (F.col("n") + 1).alias("n"))
    recorded = e.select("entity", "n", F.when(F.col("event_id") % 3 > 0, F.col("lap")).alias("segment"))
    computed = E.assigned(e, V.intervals(spark, sf), ["entity"], ["n"], "t", 86400.0).select("entity", "n", F.col("segment").cast("long").alias("segment"))
    return L.reconciled_segments(recorded, computed, ["entity"])


@query("j11_attach_signals", """WITH m AS (SELECT l_partkey AS cluster, l_linenumber AS session, max(l_orderkey) AS entity FROM lineitem WHERE l_discount >= 0.01 GROUP BY ALL), g AS (SELECT c.cluster,
s.session FROM (SELECT DISTINCT cluster FROM m) c, (SELECT DISTINCT l_linenumber AS session FROM lineitem) s) SELECT g.cluster, g.session, m.entity, l.l_quantity AS value
FROM g LEFT JOIN m USING (cluster, session) LEFT JOIN lineitem l ON l.l_orderkey = m.entity AND l.l_linenumber = g.session""")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    li = V.table(spark, sf, "lineitem")
    m = V.labels(spark, sf).where("cluster <> -1").groupBy("cluster", "session").agg(F.max("entity").alias("entity"))
    signals = li.select(F.col("l_linenumber").alias("session"), F.col("l_orderkey").alias("entity"), F.col("l_quantity").alias("value"))
    return A.attached(m, li.select(F.col("l_linenumber").alias("session")), signals, "cluster", "session", "entity").select("cluster", "session", "entity", "value")


@query("j5_trigger_windows", V.over("traces", body="""#e AS (SELECT entity, frame AS f0, row_number() OVER (PARTITION BY entity ORDER BY frame) AS event_no FROM traces WHERE value > 250),
w AS (SELECT e.entity, event_no, t.frame, value FROM e JOIN traces t ON t.entity = e.entity AND t.frame >= f0 - 30 AND t.frame < f0 + 121) SELECT entity, event_no, frame
- min(frame) OVER (PARTITION BY entity, event_no) AS rel, round(value, 6) AS value FROM w"""))
def j5(spark: SparkSession, sf: str) -> DataFrame:
    t = V.traces(spark, sf)
    e = W.numbered(t.where("value > 250"), ["entity"], ["frame"], "n").select("entity", F.col("frame").alias("at"), (F.col("n") + 1).alias("event_no"))
    return rounded(A.triggered(t, e, ["entity"], "frame", "at", "event_no", "value", -30, 121))


@query("a34_dominant_laps", f"WITH {_EV}, n AS (SELECT event_type, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, event_type LIMIT 1) SELECT event_type, n, array_to_string(list_sort(list_distinct(list(CAST(lap - (SELECT min(lap) FROM ev) + 1 AS VARCHAR)))), ',') AS laps FROM ev JOIN n USING (event_type) GROUP BY 1, 2")
def a34(spark: SparkSession, sf: str) -> DataFrame:
    out = L.dominant_type(_ev(spark, sf), "event_type", "lap")
    return out.withColumn("laps", F.array_join(F.array_sort(F.col("laps").cast("array<string>")), ","))

