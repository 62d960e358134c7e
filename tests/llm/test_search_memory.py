"""What the index and the search of ranked search hold must not grow with a task's share of the input."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tracekit.llm import lexical
from tracekit.llm.shared import stored


def test_row_groups_of_large_rows_are_bounded(spark):
    rows = spark.range(0, 400, 1, 1).select(F.transform(F.sequence(F.lit(0), F.lit(4000)), lambda x: F.xxhash64(x, "id")).alias("terms"))
    out = stored(rows, "large_rows", group=1 << 21)
    (file,) = [f.removeprefix("file:") for f in out.inputFiles()]
    found = pq.ParquetFile(file).metadata
    assert found.num_row_groups >= 4
    assert max(found.row_group(i).total_byte_size for i in range(found.num_row_groups)) < 4 << 20
    assert out.count() == 400


def test_index_is_written_in_small_row_groups(spark, monkeypatch):
    monkeypatch.setattr(lexical, "GROUP", 1 << 16)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(0, cast(id % 300 as int)), x -> cast(hash(x, id) as string)), ' ')").alias("text"))
    files = [Path(f.removeprefix("file:")) for f in lexical.index(docs).strata.inputFiles()]
    assert sum(pq.ParquetFile(f).metadata.num_row_groups for f in files) > len(files)


def test_waiting_strata_hold_no_batch():
    one = [pa.array([100]), pa.array([[5, 9]]), pa.array([[1, 7]]), pa.array([[1, 1]], pa.list_(pa.int32())), pa.array([[1, 1]], pa.list_(pa.int32())), pa.array([[1, 2]], pa.list_(pa.int32())), pa.array([[0, 0, 1]], pa.list_(pa.int32()))]
    batch = pa.RecordBatch.from_arrays(one, ["m", "ids", "terms", "groups", "tfs", "sizes", "docs"])
    (s,) = lexical._strata(batch, np.array([1, 7]))
    assert s.ids.tolist() == [5, 9]
    whole = np.frombuffer(batch.column(1).values.buffers()[1], dtype=np.int64)
    assert not np.shares_memory(s.ids, whole)
