"""A training corpus from ``documents`` in five stages: quality, near-duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm import decontaminate, minhash, mixing, quality, substrings
from tracekit.llm.queries import MIX, with_domain
from tracekit.llm.shared import shared_folder, spare, stored, with_row_id, without

#: No SQL: the quality stage fits a model, and the substring stage is not to be had in SQL over whole tables.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, row, unique = with_row_id(docs)
    known = labels.select(F.col("doc_id").alias(row), "quality") if unique else labels.select("doc_id", "quality").join(rows.select("doc_id", row), "doc_id").select(row, "quality")
    told = quality.classify(rows, known, key=row)
    return without(rows, row, stored(told.where("not kept").select(F.col(row).alias("id")), "rejected")).drop(row)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near-duplicates. Groups are those of the operator: five-word shingles, similarity 0.8 or more."""
    rows, row, _ = with_row_id(docs)
    told = minhash.near_duplicates(rows, key=row, width=5)
    return without(rows, row, stored(told.where("not kept").select(F.col(row).alias("id")), "copies")).drop(row)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat a string of 100 bytes from before; a character cut in two goes, as does a document of which no word is left. n_chars tells the new length."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = substrings.without_repeats(docs, carry=rest)
    out = out.toDF("doc_id", "kept", "n_bytes", "n_removed", "n_spans", *[f"c{k}" for k in range(len(rest))])
    text = F.expr("if(n_removed = 0, cast(kept as string), try_validate_utf8(cast(kept as string)))")
    # cut characters are rare: only such texts are mended
    text = F.coalesce(text, F.regexp_replace(F.expr("make_valid_utf8(cast(kept as string))"), "�", ""))
    out = out.withColumn("t", text).where("n_removed = 0 or regexp_count(t, '\\\\S') > 0")
    cols = {"doc_id": F.col("doc_id"), "text": F.col("t")} | {c: F.col(f"c{k}") for k, c in enumerate(rest)}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("n_removed") > 0, F.length("t").cast("long")).otherwise(cols["n_chars"])
    return out.select(*[cols[c].alias(c) for c in docs.columns])


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold ten consecutive words of a benchmark item (all of them, if it has fewer)."""
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, row, _ = with_row_id(docs)
    told = decontaminate.contamination(rows, tests, key=row)
    return without(rows, row, stored(told.where("contaminated").select(F.col(row).alias("id")), "leaks")).drop(row)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies, n_taken, text) of the documents taken: how often, and how many tokens in all."""
    rows, row, _ = with_row_id(with_domain(docs))
    taken = mixing.mix(rows, key=row, **MIX).select(row, "n_tokens", "copies", "n_taken").withColumnRenamed(row, spare(rows, "taken_row"))
    at = spare(rows, "taken_row")
    out = rows.select("doc_id", "domain", "lang", "source", "text", row).join(taken, F.col(row) == F.col(at))
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", "copies", "n_taken", "text")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("suffix_dedup", without_repeated_passages),
    ("decontamination", without_leaks),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
