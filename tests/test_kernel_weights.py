"""Weights of kernels by row: each array and its sum are worked out once."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracekit.functions import scalars as S


def test_array_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(n):
        seen.add(1)
        return [float(i + 1) for i in range(n)]

    raw = F.udf(told, T.ArrayType(T.DoubleType())).asNondeterministic()("n")
    held = spark.range(4).select(F.lit(8).alias("n")).select(S._of_one(raw).alias("w")).collect()
    assert [r.w for r in held] == [[(i + 1) / 36 for i in range(8)]] * 4 and seen.value == 4
    # the array stands once in the expression, whatever its length
    plan = spark.range(4).select(S.decay_weights(F.col("id") + 2).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("EXP(") + plan.count("exp(") == 1
