"""Queries over cluster labels of all sessions, and halves of stacks. Registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.operators import clusters as C
from tracekit.operators import frames as P
from tracekit.operators import groups as G
from tracekit.plans import fixtures as V
from tracekit.plans.extended import _GOOD
from tracekit.plans.queries import query, rounded

# --- cluster labels of all seven sessions

SESSIONS = V.SESSIONS
_ALL = f"WITH labels_ AS ({V.SQL['labels_']}) "
_GOOD_ALL = _ALL.rstrip() + ", " + _GOOD.lstrip("#")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return V.labels(spark, sf).withColumn("good", F.expr("silhouette > 0 and intra > 0.4"))


@query("a7_seen_in_all_sessions", _ALL + "SELECT cluster FROM labels_ WHERE cluster <> -1 GROUP BY cluster HAVING count(DISTINCT session) = 7")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return G.seen_everywhere(V.labels(spark, sf), "cluster", "session", len(SESSIONS))


@query("a8_session_pair_counts", _GOOD_ALL + " SELECT a.session AS a, b.session AS b, count(*) AS shared, count(*) FILTER (a.c = b.c) AS same, count(*) FILTER (a.g AND b.g) AS shared_good, count(*) FILTER (a.c = b.c AND a.g AND b.g) AS same_good FROM k a JOIN k b ON a.cluster = b.cluster AND a.session < b.session GROUP BY 1, 2")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return C.session_pair_counts(_labels(spark, sf), SESSIONS)


@query("a9_qc_mask", _ALL + "SELECT session, entity, cluster, silhouette > 0 AND intra > 0.4 AS good FROM labels_")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf).select("session", "entity", "cluster", "good")


@query("a11_exclusive_classes", _ALL.rstrip() + ", f AS (SELECT cluster, bool_or(class = 'A') AS x, bool_or(class = 'R') AS y FROM labels_ WHERE cluster <> -1 GROUP BY 1) SELECT cluster, x AND NOT y AS only_first, y AND NOT x AS only_second, x AND y AS both FROM f WHERE x OR y")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return C.exclusive_classes(V.labels(spark, sf), "A", "R")


@query("a12_cluster_summary", _GOOD_ALL + " SELECT session, class, count(*) FILTER (cluster <> -1) AS accepted, count(*) FILTER (cluster = -1) AS discarded, count(*) AS underlying, count(*) FILTER (cluster <> -1 AND good) AS good FROM l GROUP BY ALL")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return C.summary(_labels(spark, sf))


@query("j9_cluster_members", _ALL + "SELECT cluster, " + ", ".join(f"max(entity) FILTER (session = {s}) AS s{s}" for s in SESSIONS) + " FROM labels_ WHERE cluster <> -1 GROUP BY cluster")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    return G.members(V.labels(spark, sf), "cluster", "session", SESSIONS, "entity")


@query("j10_filter_members", _ALL + "SELECT session, entity, CASE WHEN o_orderstatus = 'F' THEN cluster END AS cluster FROM labels_ JOIN orders ON entity = o_orderkey")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    keep = V.labels(spark, sf).join(V.table(spark, sf, "orders").where("o_orderstatus = 'F'"), F.col("entity") == F.col("o_orderkey"), "left_semi")
    return C.members_kept(V.labels(spark, sf), keep).select("session", "entity", "cluster")


# --- halves of as many frames as there are


@query("i8_split_halves", V.over("pixels", body="#m AS (SELECT count(*) // 2 AS middle FROM embeddings) SELECT CASE WHEN frame >= middle THEN 1 ELSE 0 END AS half, CASE WHEN frame >= middle THEN frame - middle ELSE frame END AS frame, y, x, round(v, 6) AS v FROM pixels CROSS JOIN m"))
def i8(spark: SparkSession, sf: str) -> DataFrame:
    n = V.table(spark, sf, "embeddings").agg(F.count("*").alias("n"))
    return rounded(P.halves(V.pixels(spark, sf).crossJoin(F.broadcast(n)), F.col("n")).drop("n"))
