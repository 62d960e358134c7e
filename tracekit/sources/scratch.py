"""Tables written to the folder that driver and executors share, to cut a lineage or to carry a stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, as in tests, one of our own if all runs on this machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tracekit.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tracekit-")
        spark.conf.set("tracekit.scratch", folder)
    return folder.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: later steps don't repeat earlier ones, and lost executors lose nothing."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
