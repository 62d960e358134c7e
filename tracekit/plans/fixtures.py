"""Views of the given tables in the shapes that the operators take, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, frame, t, value): a user's events in order of time."""
    by = Window.partitionBy("user_id").orderBy("us", "event_id")
    return events(spark, sf).select(F.col("user_id").alias("entity"), (F.row_number().over(by) - 1).alias("frame"), (F.col("us") / 1e6).alias("t"), "value")


def frames(spark: SparkSession, sf: str, bins: int = 100) -> DataFrame:
    """(frame, t, pos, lap, bin) on one clock: a lap is a day."""
    e = events(spark, sf)
    pos = F.pmod("us", F.lit(DAY)) / F.lit(float(DAY))
    return e.select(F.col("event_id").alias("frame"), (F.col("us") / 1e6).alias("t"), pos.alias("pos"), F.expr(f"us div {DAY}").alias("lap"), F.floor(pos * bins).cast("int").alias("bin"))


def spikes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("frame"))


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, segment, start, stop): from each purchase of a user to the next one, in seconds."""
    by = Window.partitionBy("user_id").orderBy("us", "event_id")
    p = events(spark, sf).where("event_type = 'purchase'")
    p = p.select(F.col("user_id").alias("entity"), (F.col("us") / 1e6).alias("start"), (F.lead("us").over(by) / 1e6).alias("stop"), F.row_number().over(by).alias("segment"))
    return p.where("stop is not null")


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, class, bin, value) of the embeddings."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("entity"), F.col("label").alias("class"), F.posexplode("embedding").alias("bin", "value")).withColumn("value", F.col("value").cast("double"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """(frame, y, x, v): an embedding as a frame of 8 x 8."""
    return matrix(spark, sf).select(F.col("entity").alias("frame"), F.expr("bin div 8").cast("int").alias("y"), (F.col("bin") % 8).cast("int").alias("x"), F.col("value").alias("v"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """(session, entity, cluster, class, silhouette, intra) of all sessions."""
    cluster = F.when(F.col("l_discount") < 0.01, F.lit(-1).cast("long")).otherwise(F.col("l_partkey"))
    quality = [F.col("l_tax").alias("silhouette"), (F.col("l_discount") * 10).alias("intra")]
    return table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("session"), F.col("l_orderkey").alias("entity"), cluster.alias("cluster"), F.col("l_returnflag").alias("class"), *quality)


#: The sessions of ``labels``.
SESSIONS = [1, 2, 3, 4, 5, 6, 7]


def place_spikes(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, frame) of four entities that fire in seven bins in a row, each in its own (the first one's pass the last bin), and now and then elsewhere."""
    near = F.pmod(F.col("bin") - 25 * F.col("entity") + 4, F.lit(100)) < 7
    e = frames(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("frame"), (F.col("user_id") % 4).cast("int").alias("entity"), "value"), "frame")
    return e.where(near | (F.col("value") > 150)).select("entity", "frame")


SQL = {
    "ev": f"SELECT *, epoch_us(ts) AS us, epoch_us(ts) // {DAY} AS lap, (epoch_us(ts) % {DAY}) / {float(DAY)}::DOUBLE AS pos FROM events",
    "traces": "SELECT user_id AS entity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, epoch_us(ts) / 1e6 AS t, value FROM events",
    "frames": f"SELECT event_id AS frame, epoch_us(ts) / 1e6 AS t, (epoch_us(ts) % {DAY}) / {float(DAY)}::DOUBLE AS pos, epoch_us(ts) // {DAY} AS lap, CAST(floor((epoch_us(ts) % {DAY}) / {float(DAY)}::DOUBLE * 100) AS INT) AS bin FROM events",
    "spikes": "SELECT user_id AS entity, event_id AS frame FROM events",
    "place_spikes": "SELECT CAST(user_id % 4 AS INT) AS entity, event_id AS frame FROM frames JOIN events ON frame = event_id WHERE ((bin - 25 * (user_id % 4) + 4) % 100 + 100) % 100 < 7 OR value > 150",
    "intervals": "SELECT * FROM (SELECT user_id AS entity, epoch_us(ts) / 1e6 AS start, lead(epoch_us(ts)) OVER w / 1e6 AS stop, row_number() OVER w AS segment FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE stop IS NOT NULL",
    "matrix": "SELECT vec_id AS entity, label AS class, CAST(u.i AS INT) AS bin, CAST(embedding[u.i + 1] AS DOUBLE) AS value FROM embeddings, unnest(range(0, len(embedding))) AS u(i)",
    "pixels": "SELECT vec_id AS frame, CAST(u.i // 8 AS INT) AS y, CAST(u.i % 8 AS INT) AS x, CAST(embedding[u.i + 1] AS DOUBLE) AS v FROM embeddings, unnest(range(0, len(embedding))) AS u(i)",
    "labels_": "SELECT l_linenumber AS session, l_orderkey AS entity, CASE WHEN l_discount < 0.01 THEN -1 ELSE l_partkey END AS cluster, l_returnflag AS class, l_tax AS silhouette, l_discount * 10 AS intra FROM lineitem",
}


def over(*views: str, body: str) -> str:
    """SQL of ``body`` with the named views before it."""
    return "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in views) + (", " if body.lstrip().startswith("#") else " ") + body.lstrip().lstrip("#")
