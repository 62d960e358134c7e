"""Window operators against brute force."""

import contextlib
import io
import random

from tracekit.operators import windows as W


def brute_apart(rows, gap):
    """In each round, of every pair of neighbours that are too close the larger goes, of equal ones the first."""
    rows = sorted(rows)
    while True:
        gone = {a if a[1] >= b[1] else b for a, b in zip(rows, rows[1:], strict=False) if b[0] - a[0] < gap}
        if not gone:
            return rows
        rows = [r for r in rows if r not in gone]


def test_kept_apart_by_islands(spark):
    draw = random.Random(4)
    series = {e: [(f, float(draw.randrange(9))) for f in draw.sample(range(600), 150)] for e in range(4)}
    series[4] = [(f, -float(f)) for f in range(300)]
    df = spark.createDataFrame([(e, f, v) for e, rows in series.items() for f, v in rows], "entity long, frame long, value double")
    out = W.kept_apart(df, ["entity"], "frame", "value", 5)
    assert sorted((r.entity, r.frame, r.value) for r in out.collect()) == [(e, f, v) for e, rows in series.items() for f, v in brute_apart(rows, 5)]
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        out.explain()
    assert "_island" in plan.getvalue()  # a group is an island, not a series


def test_islands_are_thinned_by_batches(spark):
    """Not a call an island: islands of a batch, those that go on in the next one, and a series of one long island."""
    draw = random.Random(5)
    series = {e: [(f, float(draw.randrange(9))) for f in sorted(draw.sample(range(3000), 700))] for e in range(6)}
    series[6] = [(f, float(draw.randrange(3))) for f in range(0, 2000, 4)]
    df = spark.createDataFrame([(e, f, v) for e, rows in series.items() for f, v in rows], "entity long, frame long, value double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = io.StringIO()
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        out = W.kept_apart(df, ["entity"], "frame", "value", 5)
        got = sorted((r.entity, r.frame, r.value) for r in out.collect())
        with contextlib.redirect_stdout(plan):
            out.explain()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == [(e, f, v) for e, rows in series.items() for f, v in brute_apart(rows, 5)]
    assert "FlatMapGroups" not in plan.getvalue()
