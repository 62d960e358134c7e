"""Series of a batch are searched together, and one that goes on in the next batch is whole."""

import contextlib
import io
import random

import numpy as np

from tracekit.operators import peaks as P


def test_series_are_searched_by_batches(spark):
    draw = random.Random(6)
    lists = [[float(draw.randrange(9)) for _ in range(n)] for n in (0, 1, 2, 30, 3, 200, 50)]
    lists[3][4] = None
    df = spark.createDataFrame([(e, i, v) for e, x in enumerate(lists) for i, v in enumerate(x)], "entity long, frame int, value double").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = io.StringIO()
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        out = P.find_peaks(df, ["entity"], "frame", "value", height=2, distance=3, prominence=1)
        got = sorted(tuple(r) for r in out.collect())
        with contextlib.redirect_stdout(plan):
            out.explain()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = []
    for e, x in enumerate(lists):
        at, prom = P._find(np.array([-np.inf if v is None else v for v in x]), 2, 3, 1)
        want += [(e, int(i), x[i], float(p)) for i, p in zip(at, prom, strict=True)]
    assert want and got == want
    assert "FlatMapGroups" not in plan.getvalue()
