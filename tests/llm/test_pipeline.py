"""The corpus pipeline, stage by stage, on tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_operators import PROSE, alnum, brute_components, brute_repeats  # noqa: E402

BASE = "doc_id long, text string, lang string, source string, n_chars long"
SHAPE = BASE + ", id int, row_id int, score string, kept int, k int, host string"
LONG = " ".join(f"word{i % 700} of line {i}" for i in range(6000))


def rows():
    texts = [PROSE, PROSE, PROSE.replace("seven", "eight"), None, "", " \n ", "a", LONG, LONG + " end", "The harbour wall tonight " + PROSE[:60], "é ü " * 40, "x" * 3000, "Item words that a benchmark asks about in a row of ten or more", PROSE + " " + LONG[:400]]
    return [(i, t, "en" if i % 3 else None, f"src{i % 3}" if i % 4 else None, len(t) if t is not None else None, 1, 2, "s", 3, 4, "h") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "words that a benchmark asks about in a row of ten"), (2, "no such words"), (None, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(rows(), SHAPE).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SHAPE).repartition(3)


@pytest.fixture(scope="module")
def repeated(spark, docs):
    more = spark.createDataFrame([(None, PROSE, *[None] * 9), (None, None, *[None] * 9), (0, PROSE, *[None] * 9), (2, "another text", *[None] * 9)], SHAPE)
    return docs.union(more)


def texts(df):
    return sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())


def same_shape(out, df):
    assert out.columns == df.columns and out.schema["text"].dataType == df.schema["text"].dataType


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:4])
def test_stages_of_an_empty_table(spark, folder, docs, name, stage):
    out = stage(spark, docs.limit(0), folder)
    same_shape(out, docs)
    assert out.count() == 0


@pytest.mark.parametrize("name,stage", [corpus_pipeline.STAGES[k] for k in (0, 2, 3)])
def test_stages_of_repeated_rows_and_null_keys(spark, folder, repeated, name, stage):
    out = stage(spark, repeated, folder)
    same_shape(out, repeated)
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert (2, "another text") in kept or name == "quality"
    assert sum(t == PROSE for _, t in kept) == {"quality": sum(t == PROSE for _, t in kept), "suffix_dedup": 1, "decontamination": 4}[name]


def test_quality_drops_what_scores_low(spark, folder, docs):
    from tracekit.llm import quality

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    told = {r.doc_id: r.kept for r in quality.classify(docs, labels).collect()}
    assert {i for i, _ in texts(corpus_pipeline.good_quality(spark, docs, folder))} == {i for i, kept in told.items() if kept}


def test_one_of_each_component(spark, folder, docs, repeated):
    parts = brute_components([(r[0], r[1]) for r in rows()], 5, 80)
    assert {i for i, _ in texts(corpus_pipeline.one_of_each(spark, docs, folder))} == {i for i, (_, c) in parts.items() if i == c}
    kept = [r.text for r in corpus_pipeline.one_of_each(spark, repeated, folder).collect()]
    assert kept.count(PROSE) == 1 and "another text" in kept and sum(t is None for t in kept) == 2


def test_repeated_passages_go(spark, folder, docs):
    got = {r.doc_id: r for r in corpus_pipeline.without_repeated_passages(spark, docs, folder).collect()}
    for i, n, gone, left in brute_repeats([(r[0], (r[1] or "").encode()) for r in rows()], 100):
        text = left.decode("utf-8", "ignore")
        if gone and not text.strip():
            assert i not in got
        elif gone:
            assert (got[i].text, got[i].n_chars) == (text, len(text))
        else:
            assert (got[i].text or "") == left.decode() and got[i].host == "h"


def test_leaks_go(spark, folder, docs):
    tests = [alnum("words that a benchmark asks about in a row of ten"), alnum("no such words")]
    windows = {tuple(t[s : s + 10]) for t in tests for s in range(max(1, len(t) - 9))}
    said = {r[0]: alnum(r[1]) for r in rows()}
    clean = {i for i, t in said.items() if not any(tuple(t[p : p + len(w)]) == w for w in windows for p in range(len(t)))}
    assert {i for i, _ in texts(corpus_pipeline.without_leaks(spark, docs, folder))} == clean and 12 not in clean


def test_mixing_takes_tokens_up_to_the_budget(spark, folder, docs, repeated):
    out = corpus_pipeline.mixed(spark, docs, folder)
    assert out.columns == ["doc_id", "domain", "lang", "source", "n_tokens", "copies", "n_taken", "text"]
    total = sum(len((r[1] or "").split()) for r in rows())
    taken = out.agg(F.sum("n_taken")).first()[0]
    assert abs(taken - total // 2) <= out.select("domain", "lang", "source").distinct().count()  # a leaf's share is cut to whole tokens
    assert corpus_pipeline.mixed(spark, repeated, folder).count() > 0 and corpus_pipeline.mixed(spark, docs.limit(0), folder).count() == 0


def test_whole_pipeline(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and {r.doc_id for r in out} <= {r[0] for r in rows()} and not {r.doc_id for r in out} & {1, 3, 4, 5, 12}
