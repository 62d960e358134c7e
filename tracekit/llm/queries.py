"""The operators over the given tables: one query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm import collocations, decontaminate, fingerprint, html_text, language, lexical, licenses, minhash, mixing, quality, substrings, tool_calls, toxicity
from tracekit.llm import oracles

#: Target mixture: four domains of sources, weighted, then languages, then sources evenly.
MIX = {
    "levels": ["domain", "lang", "source"],
    "fraction": 0.5,
    "epochs": 4,
    "seed": 42,
    "weights": {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 3.0, "de": 1.5}},
}
#: Tools that the calls derived from conversations name.
TOOLS = {
    "search": {"properties": {"n": {"type": "integer"}, "q": {"type": "string"}}, "required": ["n", "q"]},
    "summarise": {"properties": {"q": {"type": "string"}}, "required": ["q"]},
    "translate": {"properties": {"n": {"type": "number"}, "q": {"type": "string"}, "to": {"type": "string"}}, "required": ["q"]},
    "plan": {"properties": {"n": {"type": "integer"}, "q": {"type": "string"}, "steps": {"type": "array", "items": {"type": "object", "properties": {"at": {"type": "integer"}, "kind": {"enum": ["first", "next"]}}, "required": ["at"]}}}, "required": ["q"]},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_domain(docs: DataFrame) -> DataFrame:
    """``docs`` with a domain, a group of sources; null sources belong to domain dnull."""
    return docs.withColumn("domain", F.concat(F.lit("d"), F.coalesce(F.expr("cast(cast(regexp_extract(source, '[0-9]+$', 0) as int) % 4 as string)"), F.lit("null"))))


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.expr("coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)"))
    models = language.fit(docs.where("not held_out"))
    return language.predict(docs, models, ["doc_id", "held_out"])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(with_domain(table(spark, sf_dir, "documents")), **MIX)


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls are read from the conversations: each user turn calls a tool; the next assistant turn is its result.

    A call continues the one two turns before, and every fourth one the one six turns before too; a plan has steps, of which each fifth text has a wrong one.
    """
    turns = table(spark, sf_dir, "conversations")
    name = F.element_at(F.array(*[F.lit(x) for x in ("search", "summarise", "translate", "unknown", "plan")]), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) + 1).cast("int"))
    size = F.length("text")
    steps = F.array(F.struct(F.lit(0).alias("at"), F.lit("first").alias("kind")), F.struct(size.alias("at"), F.when(size % 5 == 0, "last").otherwise("next").alias("kind")))
    plain = F.to_json(F.struct(F.col("text").alias("q"), size.alias("n")))
    arguments = F.when(name == "plan", F.to_json(F.struct(F.col("text").alias("q"), steps.alias("steps")))).when(size % 7 == 0, F.to_json(F.struct(F.col("text").alias("q"), size.cast("string").alias("n")))).otherwise(plain)
    calls = turns.where("role = 'user'").select(F.col("conv_id").alias("conv"), F.col("turn").alias("call"), name.alias("tool"), arguments.alias("arguments"))
    results = turns.where("role = 'assistant'").select(F.col("conv_id").alias("conv"), (F.col("turn") - 1).alias("call"), F.col("text").alias("content"))
    edges = calls.select("conv", "call", F.explode(F.when(F.col("call") % 8 == 0, F.array(F.col("call") - 2, F.col("call") - 6)).otherwise(F.array(F.col("call") - 2))).alias("parent"))
    out = tool_calls.link(calls, results, TOOLS, edges)
    return out.select(F.col("conv").alias("conv_id"), F.col("call").alias("turn"), "place", "depth", "tool", "valid", F.array_join("errors", "; ").alias("errors"), "linked", "json")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.held_against_next(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)"))
    out = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), docs.where("not held_out"), ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("matches").alias("n_matches"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_mixture": op1_language_mixture,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_mixing": op3_mixing,
        "op4_tool_calls": op4_tool_calls,
        "op5_license_scan": op5_license_scan,
        "op6_main_text": op6_main_text,
        "op7_decontamination": op7_decontamination,
        "op8_minhash": op8_minhash,
        "op9_quality": op9_quality,
        "op10_fingerprint": op10_fingerprint,
        "op11_toxicity": op11_toxicity,
        "op12_ranked_search": op12_ranked_search,
        "op13_collocations": op13_collocations,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
