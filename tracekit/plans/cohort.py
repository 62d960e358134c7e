"""Queries over scalars, sources, sessions and cohorts. Registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.functions import scalars as S
from tracekit.operators import alignment as A
from tracekit.operators import cohorts as C
from tracekit.operators import groups as G
from tracekit.plans import behaviour as B
from tracekit.plans import fixtures as V
from tracekit.plans.extended import _TRIALS, _trials
from tracekit.plans.queries import SQL, query, r, rounded
from tracekit.sources import readers as R
from tracekit.sources import sessions as N
from tracekit.sources.scratch import place

# --- scalars


@query("p2_minmax_columns", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem), 6) AS {c}" for c in ("l_quantity", "l_discount", "l_tax")) + " FROM lineitem")
def p2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.scaled_columns(V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_quantity", "l_discount", "l_tax"]))


@query("p5_integer_scale", "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / max(l_extendedprice) OVER (PARTITION BY l_suppkey) * 65535) AS BIGINT) AS level FROM lineitem")
def p5(spark: SparkSession, sf: str) -> DataFrame:
    li = V.table(spark, sf, "lineitem")
    top = li.groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("top"))
    return li.join(top, "l_suppkey").select("l_orderkey", "l_linenumber", S.integer_scale(F.col("l_extendedprice"), F.col("top"), 16).alias("level"))


@query("p6_between_bits", "SELECT l_orderkey, l_linenumber, CAST(round_even((l_partkey % 256) * 257.0::DOUBLE, 0) AS BIGINT) AS up, CAST(round_even((l_orderkey % 65536) * (255.0::DOUBLE / 65535), 0) AS BIGINT) AS down FROM lineitem")
def p6(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.between_bits(F.col("l_partkey") % 256, 8, 16).alias("up"), S.between_bits(F.col("l_orderkey") % 65536, 16, 8).alias("down"))


@query("p12_cohort_within", "SELECT c_custkey, CASE WHEN contains(upper(c_mktsegment), 'HOLD') THEN 'a' WHEN contains(upper(c_mktsegment), 'MACH') THEN 'b' ELSE 'other' END AS cohort FROM customer")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "customer").select("c_custkey", S.cohort_within(F.col("c_mktsegment"), [("hold", "a"), ("Mach", "b")], "other").alias("cohort"))


_NAME = "CASE l_partkey % 4 WHEN 0 THEN '240101_s' || l_suppkey || '_FEAR' WHEN 1 THEN '240101_s' || l_suppkey || '_ch' || l_linenumber || '_FEAR' WHEN 2 THEN 's' || l_suppkey || '_' || l_linenumber ELSE 'plain' END"


@query("p13_session_parts", f"""SELECT l_orderkey, l_linenumber, CASE WHEN n IN (3, 4) THEN p[1] END AS date, CASE WHEN n IN (3, 4) THEN p[2] WHEN n = 2 THEN p[1] END AS id, CASE WHEN n = 4 THEN p[3]
END AS channel, CASE WHEN n IN (3, 4) THEN p[-1] END AS kind, CASE WHEN n = 2 THEN p[2] END AS number FROM (SELECT *, string_split({_NAME}, '_') AS p,
len(string_split({_NAME}, '_')) AS n FROM lineitem)""")
def p13(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.session_parts(F.expr(_NAME)).alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@query("p14_normal_session", "SELECT o_orderkey, strftime(o_orderdate, '%y%m%d') || '_coh' || o_custkey % 7 || '-m' || o_custkey || '_' || o_orderstatus || '-x' || CASE WHEN o_orderkey % 2 = 0 THEN '-CtxA' ELSE '' END AS name FROM orders")
def p14(spark: SparkSession, sf: str) -> DataFrame:
    o = V.table(spark, sf, "orders")
    name = F.concat(F.lit("coh"), (F.col("o_custkey") % 7).cast("string"), F.lit("_"), F.col("o_orderstatus"), F.lit("_x_m"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "_CtxA").otherwise(""), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-101112"))
    return o.select("o_orderkey", S.normal_session(name).alias("name"))


@query("p16_finite", "SELECT user_id, event_id, round(CASE WHEN event_type = 'error' THEN 0 ELSE value END, 6) AS value FROM events")
def p16(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))).otherwise(F.col("value"))
    return rounded(V.table(spark, sf, "events").select("user_id", "event_id", S.finite(v).alias("value")))


@query("p17_clip_values", "SELECT event_id, value FROM events WHERE abs(value) < 250")
def p17(spark: SparkSession, sf: str) -> DataFrame:
    return S.within_limit(V.table(spark, sf, "events").select("event_id", "value"), "value", 250)


@query("p17_clip_columns", "SELECT event_id, CASE WHEN avg(value) OVER (PARTITION BY user_id) <= 50 THEN value END AS kept FROM events")
def p17b(spark: SparkSession, sf: str) -> DataFrame:
    return S.without_large_columns(V.table(spark, sf, "events"), ["user_id"], "value", 50).select("event_id", "kept")


@query("p23_needs_downsample", V.over("traces", body="SELECT entity, count(*) > coalesce(max(frame) FILTER (value > 200), 0) * 1.2 AS needed FROM traces GROUP BY 1"))
def p23(spark: SparkSession, sf: str) -> DataFrame:
    t = V.traces(spark, sf)
    return S.needs_downsample(t.where("value > 200"), t, ["entity"], "frame", 1.2)


@query("p9_kernels", """WITH p AS (SELECT p_partkey, p_size % 9 + 2 AS w FROM part), g AS (SELECT p_partkey, u.k AS k, exp(-0.5 * pow(u.k / (w / 2.355), 2)) AS x FROM p, LATERAL (SELECT
unnest(range(-(w // 2), w // 2 + 1)) AS k) u), d AS (SELECT p_partkey, u.k AS k, exp(-u.k / w) AS x FROM p, LATERAL (SELECT unnest(range(0, w * 6)) AS k) u), a AS (SELECT
p_partkey, max(x) / sum(x) AS top, count(*) AS n FROM g GROUP BY 1), b AS (SELECT p_partkey, max(x) / sum(x) AS first, count(*) AS tail FROM d GROUP BY 1) SELECT
p_partkey, round(top, 6) AS top, n, round(first, 6) AS first, tail FROM a JOIN b USING (p_partkey)""")
def p9(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("p_size") % 9 + 2
    p = V.table(spark, sf, "part").select("p_partkey", S.gaussian_weights(w).alias("g"), S.decay_weights(w).alias("d"))
    return rounded(p.select("p_partkey", F.array_max("g").alias("top"), F.size("g").cast("long").alias("n"), F.element_at("d", 1).alias("first"), F.size("d").cast("long").alias("tail")))


@query("h11_stars", "SELECT event_id, CASE WHEN value < 1 THEN '***' WHEN value < 10 THEN '**' WHEN value < 50 THEN '*' ELSE 'ns' END AS stars FROM events")
def h11(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "events").select("event_id", S.stars(F.col("value") / 1000).alias("stars"))


# --- sources: tables written to the shared folder and read back


@query("s1_event_log_files", "SELECT event_id, CASE WHEN event_id % 9 > 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 9 = 0 AS bad FROM events")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events")
    line = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("no json "), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit("}")))
    at = place(spark, "log")
    e.repartition(4, "user_id").sortWithinPartitions("event_id").select(line.alias("line")).write.text(at)
    got = R.event_log(spark, at)
    number = F.when(F.col("bad"), F.regexp_extract("line", "([0-9]+)$", 1).try_cast("long")).otherwise(F.try_variant_get("record", "$.id", "long"))
    return got.select(number.alias("event_id"), F.try_variant_get("record", "$.k", "long").alias("k"), "bad")


_TWO = "SELECT *, row_number() OVER (PARTITION BY part ORDER BY absolute, index) AS n FROM (SELECT user_id % 4 AS part, event_id, epoch_us(ts) / 1e6 - 1704067200 AS absolute, CAST(event_id % CASE WHEN user_id % 4 = 0 THEN 2 ELSE 3 END AS INT) AS index FROM events)"


@query("s2_frame_times_files", f"SELECT part, round(absolute, 4) AS absolute, index FROM ({_TWO}) WHERE part = 0 OR n % 2 = 1")
def s2(spark: SparkSession, sf: str) -> DataFrame:
    e = V.events(spark, sf).select((F.col("user_id") % 4).alias("part"), (F.col("us") / 1e6 - 1704067200).alias("_absoluteTime"), (F.col("event_id") % F.when(F.col("user_id") % 4 == 0, 2).otherwise(3)).cast("int").alias("_index"))
    at = place(spark, "frames")
    for p in range(4):
        e.where(F.col("part") == p).select(F.col("_absoluteTime").alias("_relativeTime"), "_absoluteTime", "_index").coalesce(1).write.format("xml").option("rowTag", "Frame").option("rootTag", "Sequence").save(f"{at}/part{p}")
    parts = [R.frame_times(spark, f"{at}/part{p}").select(F.lit(p).cast("long").alias("part"), "absolute", "index") for p in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("absolute", F.round("absolute", 4))


@query("s3_gpio_files", "SELECT round(value * 2, 4) AS t, event_type AS channel, round(value, 4) AS value FROM events")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    at = place(spark, "gpio")
    e = V.table(spark, sf, "events")
    e.select((F.col("value") * 2).alias(" Time (s)"), F.concat(F.lit(" "), F.col("event_type"), F.lit("  ")).alias("Channel Name "), F.col("value").alias("Value")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at)
    return R.gpio(spark, at).select(F.round("t", 4).alias("t"), "channel", F.round("value", 4).alias("value"))


@query("s4_wide_traces_files", "SELECT round(t, 4) AS t, entity, status, round(value, 4) AS value FROM (SELECT l_orderkey * 10 + l_linenumber AS t, l_quantity AS c0, l_discount AS c1 FROM lineitem), LATERAL (SELECT unnest(['C0', 'C1']) AS entity, unnest(['accepted', 'rejected']) AS status, unnest([c0, c1]) AS value)")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    at = place(spark, "wide")
    li = V.table(spark, sf, "lineitem")
    body = F.concat_ws(" , ", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"), F.col("l_quantity").cast("string"), F.col("l_discount").cast("string"))
    # each file has its own two lines above its data; a task writes one, so there are more files of more rows
    files = max(4, -(-li.count() // (1 << 20)))
    rows = li.select(F.pmod(F.xxhash64("l_orderkey"), F.lit(files)).alias("file"), F.lit(2).alias("at"), body.alias("line"))
    head = spark.range(files).select(F.col("id").alias("file"), F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit(" , C 0,C1 ").alias("line")), F.struct(F.lit(1).alias("at"), F.lit("Time(s)/Cell Status, accepted, rejected").alias("line")))).alias("h")).select("file", "h.at", "h.line")
    rows.union(head).repartitionById(files, F.col("file").cast("int")).sortWithinPartitions("file", "at").select("file", "line").write.partitionBy("file").text(at)
    got = R.wide_traces(spark, f"{at}/*/*.txt")
    return got.select(F.round("t", 4).alias("t"), "entity", "status", F.round("value", 4).alias("value"))


@query("s5_annotated_epochs", """WITH e AS (SELECT user_id, user_id % 2 = 1 AS second, event_id, value + CASE WHEN user_id % 2 = 1 THEN 300 ELSE 0 END AS t, event_type FROM events WHERE event_type IN ('click', 'view')),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, second ORDER BY event_id) - 1 AS n FROM e WHERE event_type = 'click' AND t < CASE WHEN second THEN 500 ELSE 300
END), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, second ORDER BY event_id) - 1 AS n FROM e WHERE event_type = 'view'),
p AS (SELECT a.user_id, a.second, a.n, a.t AS start, b.t AS stop, max(a.n) OVER (PARTITION BY a.user_id, a.second) AS m FROM a JOIN b USING (user_id, second, n))
SELECT user_id, second, n, round(start, 4) AS start, round(CASE WHEN n = m THEN least(stop, CASE WHEN second THEN 500 ELSE 300 END) ELSE stop END, 4) AS stop FROM p""")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    at = place(spark, "notes")
    e = V.table(spark, sf, "events").where("event_type in ('click', 'view')")
    body = F.concat_ws(",", F.col("event_id").cast("string"), F.col("value").cast("string"), F.when(F.col("event_type") == "click", "START").otherwise("STOP"), F.col("user_id").cast("string"))
    rows = e.select((F.col("user_id") % 8).alias("file"), (F.col("event_id") + 100).alias("at"), body.alias("line"))
    top = [(k, f"preamble {k}") for k in range(14)] + [(14, "a,b,c"), (15, "Id, Time ,Status,User")]
    head = spark.range(8).select(F.col("id").alias("file"), F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("at"), F.lit(x).alias("line")) for k, x in top])).alias("h")).select("file", "h.at", "h.line")
    rows.union(head).repartition("file").sortWithinPartitions("file", "at").select("file", "line").write.partitionBy("file").text(at)
    got = R.annotations(spark, f"{at}/*/*.txt")
    assert set(got.columns) == {"file", "line_no", "t", "status"}
    # the reader keeps time and status; the user stands in the file's own lines, matched by their number
    lines = R._numbered_lines(spark, f"{at}/*/*.txt").select("file", "line_no", F.try_element_at(F.split("line", ","), F.lit(4)).try_cast("long").alias("user_id"))
    noted = got.join(lines, ["file", "line_no"]).withColumn("second", F.col("user_id") % 2 == 1)
    return rounded(R.annotated_epochs(noted, ["user_id"], "line_no", "second", 300.0, 500.0).select("user_id", "second", "n", "start", "stop")).withColumn("n", F.col("n").cast("long"))


@query("s10_write_table", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, f AS format FROM orders, (VALUES ('parquet'), ('json'), ('csv')) AS v(f)")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    df = V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    paths = N.write_table(df, place(spark, "tables"), "orders", ["parquet", "json", "csv"], dated=True, suffix="all")
    parts = [(spark.read.schema(df.schema).option("header", True) if p.endswith("csv") else spark.read.schema(df.schema)).format(p.rsplit(".", 1)[1]).load(p).withColumn("format", F.lit(p.rsplit(".", 1)[1])) for p in paths]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s12_export_pair_tests", SQL["h4_pair_test_summary"])
def s12(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(G.pair_summary(V.table(spark, sf, "events"), ["user_id"], "event_type", "value", "click", "view"))
    path = N.write_table(out, place(spark, "tables"), "pairs", ["csv"])[0]
    return spark.read.schema(out.schema).option("header", True).csv(path)


@query("s6_wrap_sessions", """SELECT c_custkey AS subject, n, total, m.segment FROM customer c JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) o ON
o_custkey = c_custkey LEFT JOIN (SELECT c_custkey AS k, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0) m ON m.k = c.c_custkey""")
def s6(spark: SparkSession, sf: str) -> DataFrame:
    c, o = V.table(spark, sf, "customer"), V.table(spark, sf, "orders")
    traces = o.groupBy(F.col("o_custkey").alias("subject")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    image = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("segment"))
    out = N.wrapped(traces.select("subject"), ["subject"], {"traces": traces}, {"image": image})
    return out.select("subject", "traces.n", "traces.total", "image.segment")


@query("s7_session_inventory", "SELECT regexp_extract(url, '//([^/]+)', 1) AS session, bool_or(contains(url, '/en/')) AS english, bool_or(contains(url, '?page')) AS paged, bool_or(contains(url, 'https')) AS safe FROM pages GROUP BY 1")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    return N.inventory(V.table(spark, sf, "pages"), F.regexp_extract("url", "//([^/]+)", 1), "url", {"english": "/en/", "paged": "?page", "safe": "https"})


@query("s8_latest_artifact", "SELECT regexp_extract(url, '//([^/]+)', 1) AS host, arg_max(url, struct_pack(a := page_id % 50, b := url)) FILTER (contains(url, 'https') AND contains(url, '/en/') AND NOT contains(url, '?page')) AS url FROM pages GROUP BY 1")
def s8(spark: SparkSession, sf: str) -> DataFrame:
    p = V.table(spark, sf, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("host"), "url", (F.col("page_id") % 50).alias("modified"))
    return N.latest(p, ["host"], "url", "modified", ["https", "/en/"], ["?page"])


@query("s9_registry_upsert", "SELECT DISTINCT url AS path, regexp_extract(url, '//([^/]+)', 1) AS session FROM pages WHERE NOT regexp_matches(url, '/de(/|$)')")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    p = V.table(spark, sf, "pages").select(F.col("url").alias("path"), F.regexp_extract("url", "//([^/]+)", 1).alias("session"), "page_id")
    return N.upserted(p.where("page_id % 3 = 0"), p, avoid=["de"])


@query("s9_registry_sessions", "SELECT DISTINCT regexp_extract(url, '//([^/]+)', 1) AS session FROM pages WHERE contains(regexp_extract(url, '//([^/]+)', 1), 'th') ORDER BY session LIMIT 100")
def s9b(spark: SparkSession, sf: str) -> DataFrame:
    return N.searched(V.table(spark, sf, "pages").select(F.col("url").alias("path"), F.regexp_extract("url", "//([^/]+)", 1).alias("session")), "th")


# --- cohorts


@query("w14_event_rates", "WITH n AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error' AND value > 300) AS c FROM events GROUP BY 1) SELECT user_id, round(c / n, 6) AS rate FROM n WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'click' AND value > 200)")
def w14(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events")
    return rounded(C.event_rates(e.where("event_type = 'error' and value > 300"), e.groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"], "n", e.where("event_type = 'click' and value > 200")))


@query("a3_ratio_columns", """WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(*)
AS n FROM orders GROUP BY 1) SELECT *, round(f / nullif(n, 0), 6) AS f_by_n, round(f / nullif(p, 0), 6) AS f_by_p, round(o / nullif(n, 0), 6) AS o_by_n, round(o /
nullif(p, 0), 6) AS o_by_p FROM c""")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    c = V.table(spark, sf, "orders").groupBy("o_custkey").agg(n("F").alias("f"), n("O").alias("o"), n("P").alias("p"), F.count("*").alias("n"))
    return rounded(C.ratio_columns(c, ["f", "o"], ["n", "p"]))


@query("a10_class_flags", f"WITH labels_ AS ({V.SQL['labels_']}) SELECT session, entity, class = 'A' AND cluster <> -1 AS of_class, class = 'A' AND cluster <> -1 AND silhouette > 0 AND intra > 0.4 AS good_of_class FROM labels_")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return C.class_flags(V.labels(spark, sf).withColumn("good", F.expr("silhouette > 0 and intra > 0.4")), "A")


@query("a13_auto_bins", f"WITH {B._EV}" + """, p AS (SELECT user_id, event_id, pos * 2000 AS v FROM ev), l AS (SELECT user_id, count(DISTINCT lap) AS laps FROM ev GROUP BY 1), d AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM p),
n AS (SELECT user_id, count(*) AS n, min(v) AS lo, max(v) AS hi, max(d) AS d, 2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / pow(count(*), 1.0 / 3) AS fd, (max(v) - min(v)) / (log2(count(*)) + 1) AS st FROM d GROUP BY 1),
b AS (SELECT *, ceil((hi - lo) / CASE WHEN fd > 0 THEN least(fd, st) ELSE st END) AS b FROM n), h AS (SELECT p.user_id, least(floor((v - lo) / (hi - lo) * b), b - 1) AS c, count(*) AS m FROM p JOIN b USING (user_id) GROUP BY ALL),
k AS (SELECT user_id, count(*) FILTER (m > laps / 15.0) AS kinds FROM h JOIN l USING (user_id) GROUP BY 1), u AS (SELECT user_id, lo, hi, CASE WHEN d > 20 THEN greatest(kinds, 1) ELSE 1 END AS use FROM b JOIN k USING (user_id))
SELECT user_id, CAST(least(floor((v - lo) / (hi - lo) * use), use - 1) AS BIGINT) AS bin, CAST(round_even(avg(v), 0) AS BIGINT) AS at FROM p JOIN u USING (user_id) GROUP BY 1, 2""")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    e = B._ev(spark, sf)
    laps = e.groupBy("user_id").agg(F.count_distinct("lap").alias("laps"))
    return C.auto_bins(e.join(laps, "user_id").withColumn("v", F.col("pos") * 2000), ["user_id"], "event_id", "v", "laps")


@query("a17_segment_names", f"WITH t AS ({SQL['a14_segment_code']}), k AS ({SQL['g15_lap_kinds']})" + """, f AS (SELECT user_id, bool_or(kind IN ('OMITBOTH', 'OMITCUE2')) AS two FROM k GROUP BY 1),
l AS (SELECT user_id, kind AS type, count(*) AS n, max(lap) AS lap FROM t GROUP BY ALL), m AS (SELECT l.user_id, type, CASE WHEN n > 1 THEN coalesce(k.kind, CASE WHEN two
THEN 'BOTHCUES' ELSE 'CUE1' END) END AS name FROM l LEFT JOIN k ON k.user_id = l.user_id AND k.lap = l.lap LEFT JOIN f ON f.user_id = l.user_id),
p AS (SELECT user_id, list_sort(list(DISTINCT coalesce(name, ''))) = ['OMITBOTH', 'OMITCUE1', 'OMITCUE2'] AS pair FROM m GROUP BY 1) SELECT user_id, type, CASE WHEN pair
AND name = 'OMITCUE2' THEN 'CUE1' WHEN pair AND name = 'OMITCUE1' THEN 'CUE2' ELSE name END AS name FROM m JOIN p USING (user_id)""")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    types = B.a14(spark, sf).select("user_id", "lap", F.col("kind").alias("type"))
    return C.segment_names(types, B.g15(spark, sf), "user_id", "lap")


@query("a18_collate_groups", "SELECT user_id, event_id, event_type AS session, round(value, 6) AS value, CASE WHEN user_id % 3 < 2 THEN user_id % 3 END AS grp FROM events WHERE event_type IN ('click', 'view')")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    groups = e.select("user_id").distinct().where("user_id % 3 < 2").select("user_id", (F.col("user_id") % 3).alias("grp"))
    out = C.collated({t: e.where(F.col("event_type") == t).drop("event_type") for t in ("click", "view")}, "session", groups, "user_id")
    return rounded(out.select("user_id", "event_id", "session", "value", "grp"))


@query("a19_mean_by_cluster_class", "SELECT l_suppkey AS cluster, l_returnflag AS class, l_linenumber AS session, CAST(l_quantity AS INT) % 10 AS rel, round(avg(l_extendedprice) FILTER (l_partkey % 5 > 0), 6) AS mean, count(*) FILTER (l_partkey % 5 > 0) AS n FROM lineitem GROUP BY ALL")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("l_partkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    li = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cluster"), F.col("l_returnflag").alias("class"), F.col("l_linenumber").alias("session"), (F.col("l_quantity").cast("int") % 10).alias("rel"), v.alias("v"))
    return rounded(C.known_means(li, ["cluster", "class", "session", "rel"], "v"))


@query("a22_event_amplitudes", V.over("traces", body=_TRIALS + " SELECT entity, event_no % 2 AS kind, event_no, round(sum(value) FILTER (rel >= 5), 6) AS amplitude FROM trials GROUP BY ALL"))
def a22(spark: SparkSession, sf: str) -> DataFrame:
    t = _trials(spark, sf).withColumn("kind", F.col("event_no") % 2)
    return A.trial_summary(t, ["entity", "kind", "event_no"], "rel", "value", 5).select("entity", "kind", "event_no", r("area", "amplitude"))


@query("a20_response_by_class", V.over("traces", body=_TRIALS + ", p AS (SELECT entity, event_no, max(value) FILTER (rel >= 5) AS peak FROM trials GROUP BY ALL) SELECT entity, event_no % 2 AS kind, round(avg(peak), 6) AS response FROM p GROUP BY ALL"))
def a20(spark: SparkSession, sf: str) -> DataFrame:
    t = _trials(spark, sf).withColumn("kind", F.col("event_no") % 2)
    return rounded(C.responses(t, ["entity", "kind"], "event_no", "rel", "value", 5))


@query("j12_tested_footprints", V.over("pixels", body="#m AS (SELECT user_id AS frame FROM events GROUP BY 1 HAVING avg(value) FILTER (event_type = 'click') > avg(value) FILTER (event_type = 'view')) SELECT frame, y, x, round(v, 6) AS v FROM pixels WHERE v > 0.1 AND frame IN (FROM m)"))
def j12(spark: SparkSession, sf: str) -> DataFrame:
    tested = G.pair_summary(V.table(spark, sf, "events"), ["user_id"], "event_type", "value", "click", "view").withColumnRenamed("user_id", "frame")
    return rounded(C.significant_footprints(tested, V.pixels(spark, sf).where("v > 0.1"), ["frame"], "higher"))


_CURVES = f"""WITH {B._EV}, g AS (SELECT user_id, kind, bin FROM (SELECT DISTINCT user_id FROM ev), (VALUES (0), (1)) AS k(kind), unnest(range(20)) AS b(bin)), n AS (SELECT user_id,
lap % 2 AS kind, floor(pos * 20) AS bin, count(*) AS n FROM ev GROUP BY ALL), curves AS (SELECT g.*, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM g LEFT JOIN n ON n.user_id =
g.user_id AND n.kind = g.kind AND n.bin = g.bin)"""


def _curves(spark: SparkSession, sf: str) -> DataFrame:
    e = B._ev(spark, sf)
    n = e.groupBy("user_id", (F.col("lap") % 2).alias("kind"), F.floor(F.col("pos") * 20).alias("bin")).agg(F.count("*").cast("double").alias("n"))
    grid = e.select("user_id").distinct().select("user_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("kind")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("bin"))
    return grid.join(n, ["user_id", "kind", "bin"], "left").select("user_id", "kind", "bin", F.coalesce("n", F.lit(0.0)).alias("v"))


@query("a24_field_rate_ratio", _CURVES + """, p AS (SELECT user_id, bin AS peak FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, bin) AS k FROM curves WHERE kind = 0) WHERE k = 1), m AS
(SELECT user_id, peak, avg(v) FILTER (kind = 0) AS a, avg(v) FILTER (kind = 1) AS b FROM curves JOIN p USING (user_id) WHERE abs(bin - peak) <= 1 GROUP BY ALL), q AS
(SELECT *, CASE WHEN b = 0 THEN CASE WHEN a > 0 THEN 25 END ELSE a / b END AS ratio FROM m) SELECT user_id, CAST(peak AS BIGINT) AS peak, round(a, 6) AS reference,
round(b, 6) AS other, round(ratio, 6) AS ratio, coalesce(ratio > 2, FALSE) AS selected FROM q""")
def a24(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.field_rate_ratio(_curves(spark, sf), "user_id", "kind", "bin", "v", 0, 1, edge=1))


@query("a31_tuning_curves", _CURVES + " SELECT user_id % 3 AS grp, kind, bin, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem FROM curves GROUP BY ALL")
def a31(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.tuning_curves(_curves(spark, sf).withColumn("grp", F.col("user_id") % 3), ["grp", "kind"], "bin", "v"))


@query("a31_tuning_maxima", _CURVES + """, m AS (SELECT user_id % 3 AS grp, kind, user_id, max(v) AS m FROM curves GROUP BY ALL), s AS (SELECT grp, kind, avg(m) AS mean, stddev_samp(m) / sqrt(count(m)) AS sem
FROM m GROUP BY ALL), t AS (SELECT user_id % 3 AS grp, kind, quantile_cont(v, 0.999) AS top FROM curves GROUP BY ALL) SELECT grp, kind, round(mean, 6) AS mean, round(sem,
6) AS sem, round(top, 6) AS top FROM s JOIN t USING (grp, kind)""")
def a31b(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.tuning_maxima(_curves(spark, sf).withColumn("grp", F.col("user_id") % 3), ["grp", "kind"], "user_id", "v"))


@query("a32_group_session_summary", """WITH o AS (SELECT c_mktsegment AS grp, o_orderstatus AS session, o_custkey AS subject, o_totalprice AS price, CAST(o_orderkey % 100 AS DOUBLE) AS size FROM orders JOIN
customer ON c_custkey = o_custkey), l AS (UNPIVOT o ON price, size INTO NAME variable VALUE value), t AS (SELECT grp, session, variable, subject, sum(value) AS t FROM l
GROUP BY ALL), a AS (SELECT grp, session, variable, avg(t) AS total FROM t GROUP BY ALL) SELECT l.grp, l.session, l.variable, round(avg(value), 4) AS mean,
round(stddev_samp(value) / sqrt(count(value)), 4) AS sem, round(any_value(total), 4) AS total FROM l JOIN a ON a.grp = l.grp AND a.session = l.session AND a.variable =
l.variable GROUP BY ALL""")
def a32(spark: SparkSession, sf: str) -> DataFrame:
    o = V.table(spark, sf, "orders").join(V.table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    o = o.select(F.col("c_mktsegment").alias("grp"), F.col("o_orderstatus").alias("session"), F.col("o_custkey").alias("subject"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 100).cast("double").alias("size"))
    out = C.session_summary(o, ["grp", "session"], "subject", ["price", "size"])
    return out.select("grp", "session", "variable", *[F.round(c, 4).alias(c) for c in ("mean", "sem", "total")])


@query("a33_outlier_lists", """WITH p AS (SELECT user_id AS id, user_id % 5 AS grp, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY 1)
SELECT grp, count(*) AS dropped, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS which FROM p WHERE abs(a) > 60 OR abs(b) > 60 GROUP BY 1""")
def a33(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    p = V.table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(mean("click").alias("a"), mean("view").alias("b")).withColumn("grp", F.col("id") % 5)
    return C.outlier_pairs(p, ["grp"], "a", "b", 60)[1].withColumn("which", F.array_join(F.col("which").cast("array<string>"), ","))


@query("a27_eligible", "SELECT o_custkey FROM (SELECT o_custkey, bool_and(o_totalprice > 20000) AS a, bool_and(o_orderstatus <> 'P') AS b, bool_and(o_orderkey % 7 > 0) AS c FROM orders GROUP BY 1) WHERE a AND (b OR c) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def a27(spark: SparkSession, sf: str) -> DataFrame:
    o = V.table(spark, sf, "orders").select("o_custkey", (F.col("o_totalprice") > 20000).alias("a"), (F.col("o_orderstatus") != "P").alias("b"), (F.col("o_orderkey") % 7 > 0).alias("c"))
    return C.eligible(o, "o_custkey", ["a"], ["b", "c"], V.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")))


@query("k3_class_sets", """WITH x AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 60), y AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value
> 120) SELECT user_id, CASE WHEN user_id IN (FROM x) THEN CASE WHEN user_id IN (FROM y) THEN 'both' ELSE 'first' END WHEN user_id IN (FROM y) THEN 'second' ELSE 'none'
END AS kind FROM (SELECT DISTINCT user_id FROM events)""")
def k3(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events")
    return C.class_sets(e.where("event_type = 'error' and value > 60"), e.where("event_type = 'click' and value > 120"), e, "user_id")


@query("k5_sort_table", "SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END AS rank FROM customer ORDER BY rank, c_custkey")
def k5(spark: SparkSession, sf: str) -> DataFrame:
    return C.sorted_by(V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"], "c_mktsegment", ["BUILDING", "MACHINERY"])


@query("k6_top_rows", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1")
def k6(spark: SparkSession, sf: str) -> DataFrame:
    return C.top_rows(V.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")])
