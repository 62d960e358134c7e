"""Pairs of vectors by tiles: few copies of each vector, bounds without pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracekit.operators import models as M

VECTORS = np.random.default_rng(4).normal(size=(60, 5)).astype(np.float32)
VECTORS[7] = 0


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(VECTORS)], "i long, x array<float>")


def plain():
    x = VECTORS.astype(float) / np.where((n := np.linalg.norm(VECTORS.astype(float), axis=1)) > 0, n, np.nan)[:, None]
    return {(3 * a, 3 * b): x[a] @ x[b] for a in range(60) for b in range(a + 1, 60) if 7 not in (a, b)}


@pytest.mark.parametrize("blocks", [1, 4, 16])
def test_pairs_bounds_and_distances(vectors, monkeypatch, blocks):
    monkeypatch.setattr(M, "BLOCKS", blocks)
    monkeypatch.setattr(M, "CELLS", 50)
    want = plain()
    pairs = M.cosine_pairs(vectors, "i", "x", size=6)
    got = {(r.a, r.b): r.cosine for r in pairs.collect()}
    assert got == pytest.approx(want, abs=1e-9) and pairs.count() == len(want)
    few = M.cosine_pairs(vectors, "i", "x", least=0.5, size=6).collect()
    assert {(r.a, r.b) for r in few} == {k for k, v in want.items() if v >= 0.5}
    lo, hi = M.cosine_bounds(vectors, "i", "x", size=6).first()
    assert (lo, hi) == pytest.approx((min(want.values()), max(want.values())))
    both = M.distances(M.scaled_similarity(pairs, M.cosine_bounds(vectors, "i", "x", size=6)), vectors, "i")
    assert both.count() == 2 * len(want) + 60 and both.where("a = b and distance = 0").count() == 60


def test_a_vector_goes_to_a_bounded_number_of_tasks(vectors, monkeypatch):
    monkeypatch.setattr(M, "BLOCKS", 3)
    seen = M._tiles(vectors, "i", "x", 1, lambda ia, ib, cosine, good: __import__("pyarrow").RecordBatch.from_pydict({"n": [int(len(ia))]}), "n long")
    assert seen.select(F.spark_partition_id().alias("p")).distinct().count() <= 6


def test_no_vectors(vectors):
    assert M.cosine_pairs(vectors.limit(0), "i", "x").count() == 0
    assert M.cosine_bounds(vectors.limit(0), "i", "x").first()[0] is None


def test_order_of_rows_keeps_all_pairs(vectors, monkeypatch):
    monkeypatch.setattr(M, "RUN", 4)
    for size in (6, 100):
        rows = M.cosine_pairs(vectors, "i", "x", size=size).collect()
        assert {(r.a, r.b): r.cosine for r in rows} == pytest.approx(plain(), abs=1e-9) and len(rows) == len(plain())


def test_dense_values_come_first(monkeypatch):
    monkeypatch.setattr(M, "LEAD", 12)
    monkeypatch.setattr(M, "PAGE", 3)
    cosine = np.array([0.9, 0.31, -0.8, 0.3, 0.6, 0.32, -0.1, 0.33, 0.1, -0.5, 0.7, 0.0, 0.31, -0.2])
    batch = pa.RecordBatch.from_pydict({"a": list(range(14)), "b": list(range(20, 34)), "cosine": cosine})
    got = M._dense_first(batch).to_pylist()
    assert sorted(got, key=lambda r: r["a"]) == batch.to_pylist()
    assert [r["cosine"] for r in got[:3]] == [0.3, 0.31, 0.32] and got[12:] == batch.to_pylist()[12:]
    assert M._dense_first(batch.slice(0, 2)).num_rows == 2 and M._dense_first(batch.slice(0, 0)).num_rows == 0


def test_files_of_all_pairs_take_few_bytes(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(1000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<float>")
    M.cosine_pairs(df, "i", "x").withColumn("cosine", F.round("cosine", 5)).write.parquet(str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 4.5 * 499500


def test_both_orders_of_a_pair(vectors, monkeypatch):
    monkeypatch.setattr(M, "RUN", 4)
    for size in (6, 100):
        rows = M.cosine_pairs(vectors, "i", "x", size=size, both=True).collect()
        assert {(r.a, r.b): r.cosine for r in rows} == pytest.approx(plain() | {(b, a): v for (a, b), v in plain().items()}, abs=1e-9) and len(rows) == 2 * len(plain())
        s = M.scaled_similarity(M.cosine_pairs(vectors, "i", "x", size=size, both=True), M.cosine_bounds(vectors, "i", "x", size=size))
        once = M.scaled_similarity(M.cosine_pairs(vectors, "i", "x", size=size), M.cosine_bounds(vectors, "i", "x", size=size))
        told = lambda df: sorted((r.a, r.b, round(r.distance, 9)) for r in df.collect())
        assert told(M.distances(s, vectors, "i", both=True)) == told(M.distances(once, vectors, "i"))


def test_the_other_order_is_the_same_run_again():
    good = np.array([[True, True, False], [False, False, False], [True, True, True]])
    a, b, c = M._runs(np.array([1, 2, 3]), np.array([7, 8, 9]), np.arange(9.0).reshape(3, 3), good, True)
    assert a.tolist() == [1, 1, 7, 8, 3, 3, 3, 7, 8, 9] and b.tolist() == [7, 8, 1, 1, 7, 8, 9, 3, 3, 3] and c.tolist() == [0, 1, 0, 1, 6, 7, 8, 6, 7, 8]


def test_files_of_distances_take_few_bytes(spark, tmp_path):
    from tracekit.plans import QUERIES

    x = np.random.default_rng(1).normal(size=(1000, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    QUERIES["m2_distances"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 2.5 * 1000000


def test_tasks_of_all_pairs_have_a_bounded_number_of_rows(vectors, monkeypatch):
    monkeypatch.setattr(M, "BLOCKS", 2)
    monkeypatch.setattr(M, "FULL", 10)
    tasks = lambda df: df.rdd.getNumPartitions()
    pairs, bounds = M.cosine_pairs(vectors, "i", "x", size=5), M.cosine_bounds(vectors, "i", "x", size=5, beside=True)
    assert tasks(pairs) == 21 and tasks(M.cosine_pairs(vectors, "i", "x", size=5, least=0.5)) == 3
    assert {(r.a, r.b): r.cosine for r in pairs.collect()} == pytest.approx(plain(), abs=1e-9)
    scaled = M.scaled_similarity(pairs, bounds)
    assert scaled.count() == len(plain())
    scaled.collect()
    assert "ReusedExchange" in scaled._jdf.queryExecution().executedPlan().toString()
