"""Lines of an event log are JSON objects and nothing else."""

import json

from pyspark.sql import functions as F

from tracekit.plans.queries import QUERIES
from tracekit.sources import readers

LINES = ['{"k": 3}', ' {"k": 3} ', '{"k": 3} and more', '{"k": 3}]', '{"k": 3}}', '{"k": 3}] {}', '{"k": 3}, {"k": 4}', '{"k": 3}, "x": 1', "{}", "8294846167456848 words", "12", '"text"', "[1]", "null", "true", "words", "", None, '{"k"', '{"k": {"k": [1, 2]}}']


def an_object(line):
    try:
        return isinstance(json.loads(line), dict)
    except (TypeError, ValueError):
        return False


def test_only_whole_objects_are_records(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, line string")
    got = {r.i: r.good for r in df.select("i", readers.json_object(F.col("line")).isNotNull().alias("good")).collect()}
    assert got == {i: an_object(x) for i, x in enumerate(LINES)}


def test_texts_that_begin_with_a_number_are_bad_lines(spark, tmp_path):
    spark.createDataFrame([(1, '{"k": 7}')], "event_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(2, "8294846167456848 words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in QUERIES["s1_read_event_log"](spark, str(tmp_path)).collect()) == [(1, 7, False), (2, None, True)]
