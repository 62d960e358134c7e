"""The readers on small files of their formats, and structs flattened."""

import contextlib
import glob
import io

from pyspark.sql import functions as F

from tracekit.functions import scalars as S
from tracekit.sources import readers


def test_frame_times_of_two_planes(spark, tmp_path):
    frame = '<Frame relativeTime="{0}.5" absoluteTime="{0}.75" index="{1}"/>'
    (tmp_path / "a.xml").write_text("<Scan><Sequence>" + "".join(frame.format(k, k % 2 + 1) for k in range(6)) + "</Sequence></Scan>")
    (tmp_path / "b.xml").write_text("<Scan>" + '<Frame relativeTime="0.5" absoluteTime="1.5"/>' * 2 + "</Scan>")
    rows = readers.frame_times(spark, str(tmp_path)).orderBy("file", "absolute").collect()
    assert [(r.relative, r["index"]) for r in rows] == [(0.5, 1), (2.5, 1), (4.5, 1), (0.5, 0), (0.5, 0)]


def test_gpio(spark, tmp_path):
    (tmp_path / "g.csv").write_text("Time (s), Channel Name, Value\n0.1, GPIO-1, 5\n0.2, GPIO-2 , x\n")
    assert [tuple(r) for r in readers.gpio(spark, str(tmp_path)).orderBy("t").collect()] == [(0.1, "GPIO-1", 5.0), (0.2, "GPIO-2", None)]


def test_flattened(spark):
    df = spark.range(1).select("id", F.struct(F.lit(1).alias("a"), F.struct(F.lit(2).alias("c")).alias("b")).alias("s"))
    assert S.flattened(df).columns == ["id", "s_a", "s_b_c"]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """Files of many splits: every line has its own number, and bad lines keep their text."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    lines = {f: [f'{{"id": {k}}}' if k % 7 else "" if k % 2 else f"broken {f} {k}" for k in range(n)] for f, n in (("a", 300), ("b", 1), ("c", 90))}
    for f, some in lines.items():
        (tmp_path / f"{f}.log").write_text("\n".join(some) + "\n")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = readers.event_log(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    got = [(r.file[-5], r.line_no, r.line, r.bad) for r in rows]
    assert {(g[0], g[1]): (g[2], g[3]) for g in got} == {(f, k): (x if x.startswith("broken") else None, x.startswith("broken")) for f, some in lines.items() for k, x in enumerate(some) if x}
    assert len(got) == sum(bool(x) for some in lines.values() for x in some)


def test_wide_traces_are_not_held_by_tasks(spark, tmp_path):
    """Files of many splits with their own names; lines are neither joined with themselves nor sorted."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for f, n in (("a", 200), ("b", 3), ("c", 0)):
        lines = [f" ,{f} 0,{f}1 ", "Time(s)/Cell Status, accepted, rejected", *[f"{k}.5, {k} , {'x' if k % 5 == 0 else 2 * k}" for k in range(n)]]
        (tmp_path / f"{f}.csv").write_text("\n".join(lines) + "\n")
    plan = io.StringIO()
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        out = readers.wide_traces(spark, str(tmp_path))
        rows = out.collect()
        with contextlib.redirect_stdout(plan):
            out.explain()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    got = sorted((r.file[-5], r.t, r.entity, r.status, r.value) for r in rows if r.value is not None)
    want = [(f, k + 0.5, f"{f}{e}", "rejected" if e else "accepted", float(2 * k if e else k)) for f, n in (("a", 200), ("b", 3)) for k in range(n) for e in (0, 1) if not (e and k % 5 == 0)]
    assert got == sorted(want) and len(rows) == 2 * 203
    assert "SortMergeJoin" not in plan.getvalue()


def test_wide_traces_query_deals_more_rows_to_more_files(spark, tmp_path, monkeypatch):
    from tracekit.plans import QUERIES, cohort

    seen, read = [], readers.wide_traces
    monkeypatch.setattr(cohort.R, "wide_traces", lambda spark, path: seen.append(path) or read(spark, path))
    rows = spark.range(1 << 21).selectExpr("id as l_orderkey", "1 as l_linenumber", "cast(id % 7 as double) as l_quantity", "0.5d as l_discount")
    rows.union(rows.selectExpr("l_orderkey", "2", "l_quantity", "l_discount")).union(rows.selectExpr("l_orderkey", "3", "l_quantity", "l_discount")).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = QUERIES["s4_wide_traces_files"](spark, str(tmp_path))
    files = glob.glob(seen[0])
    told = {r.entity: (r.n, r.status, r.s) for r in out.groupBy("entity").agg(F.count("*").alias("n"), F.max("status").alias("status"), F.sum("value").alias("s")).collect()}
    assert len(files) == 6
    assert told == {"C0": (6 << 20, "accepted", 3.0 * sum(k % 7 for k in range(1 << 21))), "C1": (6 << 20, "rejected", float(3 << 20))}
