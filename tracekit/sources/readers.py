"""Readers of text formats: each gives a DataFrame and reads through Spark's sources only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracekit.sources.scratch import written


def frame_times(spark: SparkSession, path: str) -> DataFrame:
    """(file, relative, absolute, index) of all Frame elements of XML files; of a file with index 2 (two planes), every other row by time."""
    schema = "_relativeTime double, _absoluteTime double, _index int"
    raw = spark.read.schema(schema).format("xml").option("rowTag", "Frame").load(path).withColumn("file", F.input_file_name())
    rows = raw.select("file", F.col("_relativeTime").alias("relative"), F.col("_absoluteTime").alias("absolute"), F.coalesce("_index", F.lit(0)).alias("index"))
    w = Window.partitionBy("file")
    both = rows.withColumn("_n", F.row_number().over(w.orderBy("absolute", "index"))).withColumn("_m", F.max("index").over(w))
    return both.where("_m <> 2 or _n % 2 = 1").drop("_n", "_m")


def gpio(spark: SparkSession, path: str) -> DataFrame:
    """(t, channel, value) of CSV files with the columns Time (s), Channel Name and Value, in whatever order; white space around names and channels goes."""
    raw = spark.read.option("header", True).csv(path)
    at = {c.strip().lower(): c for c in raw.columns}
    col = lambda c: F.trim(F.col(f"`{at[c]}`"))
    return raw.select(col("time (s)").try_cast("double").alias("t"), col("channel name").alias("channel"), col("value").try_cast("double").alias("value"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): lines of text files in order, numbered from 0 in each file.

    A line's number is its place in its split and the lines of the splits before it in the file, so one large file is read and numbered by many tasks. Lines are written once with a number that rises within
    a split, so that they only meet a row a split, and are neither sorted nor held.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_i"))
    raw = written(raw, "lines")
    sizes = raw.groupBy("file", "_b").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))  # a row a split
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("file", "_b", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return raw.join(F.broadcast(starts), ["file", "_b"]).select("file", (F.col("_shift") + F.col("_i")).alias("line_no"), "line")


def json_object(line: Column) -> Column:
    """The JSON object that a line is, as variant; null where it is anything else.

    The parser stops at the end of the first value. What follows one shows as the line is also parsed as the only element of an array and the only field of an object: nothing but white space passes in both.
    """
    v = F.try_parse_json(line)
    alone = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"line":'), line, F.lit("}"))).isNotNull()
    return F.when(alone & F.schema_of_variant(v).startswith("OBJECT"), v)


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, record variant, bad, line): a JSON object a line; lines that are none are kept as bad, with their text as ``line`` (null for the others), blank lines are left out."""
    v = json_object(F.col("line"))
    return _numbered_lines(spark, path).where("trim(line) <> ''").select("file", "line_no", v.alias("record"), v.isNull().alias("bad"), F.when(v.isNull(), F.col("line")).alias("line"))


def wide_traces(spark: SparkSession, path: str) -> DataFrame:
    """(file, t, entity, status, value) of CSV files with a time column first and one column for each entity; the first row below the names tells each entity's status. White space goes everywhere."""
    lines = _numbered_lines(spark, path).withColumn("p", F.transform(F.split(F.regexp_replace("line", "\\s+", ""), ",", -1), lambda x: F.nullif(x, F.lit(""))))
    rows = lines.select("file", "line_no", F.element_at("p", 1).try_cast("double").alias("t"), F.posexplode("p").alias("at", "x")).where("at > 0")
    head = rows.where("line_no < 2").groupBy("file", "at").agg(F.max(F.when(F.col("line_no") == 0, F.col("x"))).alias("entity"), F.max(F.when(F.col("line_no") == 1, F.col("x"))).alias("status"))
    return rows.where("line_no > 1").join(F.broadcast(head), ["file", "at"]).select("file", "t", "entity", "status", F.col("x").try_cast("double").alias("value"))


def annotations(spark: SparkSession, path: str, skip: int = 14) -> DataFrame:
    """(file, line_no, t, status) of CSV files after ``skip`` lines and a header to throw away; the line after that names the columns, Time and Status among them."""
    lines = _numbered_lines(spark, path).where(F.col("line_no") > skip).withColumn("p", F.transform(F.split("line", ",", -1), lambda x: F.trim(x)))
    names = lines.where(F.col("line_no") == skip + 1).select("file", F.col("p").alias("names"))
    cell = lambda name: F.try_element_at("p", F.nullif(F.array_position("names", name), F.lit(0)).cast("int"))
    rows = lines.where(F.col("line_no") > skip + 1).join(F.broadcast(names), "file")
    return rows.select("file", "line_no", cell("Time").try_cast("double").alias("t"), cell("Status").alias("status")).where("status in ('START', 'STOP')")


def annotated_epochs(rows: DataFrame, k: list[str], order: str, second: str, half: float, end: float) -> DataFrame:
    """(k, second, n, start, stop): the n-th start with the n-th stop of annotations (k, second, order, t, status); those of the second context are ``half`` later. Starts have to be before ``half``, or ``end`` in the second context, and the last stop is clipped there."""
    w = Window.partitionBy(*k, second, "status").orderBy(order)
    at = F.col("t") + F.when(F.col(second), F.lit(half)).otherwise(0.0)
    limit = F.when(F.col(second), F.lit(end)).otherwise(F.lit(half))
    n = rows.withColumn("t", at).withColumn("n", F.row_number().over(w) - 1)
    start = n.where("status = 'START'").where(F.col("t") < limit).withColumn("n", F.row_number().over(Window.partitionBy(*k, second).orderBy(order)) - 1).select(*k, second, "n", F.col("t").alias("start"))
    both = start.join(n.where("status = 'STOP'").select(*k, second, "n", F.col("t").alias("stop")), [*k, second, "n"])
    last = F.max("n").over(Window.partitionBy(*k, second)) == F.col("n")
    return both.withColumn("stop", F.when(last, F.least("stop", limit)).otherwise(F.col("stop")))
