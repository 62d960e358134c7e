"""Phrase collocations by partitioned mining (SON): shards are mined completely at a lowered support, what is frequent in any shard is counted exactly over all.

Documents are dealt to a fixed number of shards by a hash of their text, so shards grow with the input and their support does not fall. A phrase with ``least`` occurrences among the words of a language
has, in at least one shard, its share of them: ``least`` times the shard's share of the words. Each shard is mined at that support by all tasks together (counts by shard and phrase, added up by block of text
before they are shuffled). The union of what shards report is thinned by an upper bound (reported counts, plus for each silent shard one less than its support) and
counted exactly in another pass, which shuffles at most one row for each block of text and phrase. Words
come first, then pairs of frequent words, then longer phrases of pairs that may be frequent.

Phrases are 64-bit hashes of their language and words; their texts are looked up for the ranked ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracekit.llm import bytehash as bh
from tracekit.llm.shared import frugal, in_filter, key_filter, stored

U = np.uint64
#: Shards; bytes of text counted at once; bits of a filter over phrases; parts that rows of one frequent word are dealt to.
SHARDS, TEXT, BITS, DEAL = 8, 1 << 22, 1 << 28, 32
#: Bytes that end a piece, and bytes of words.
CUT = np.zeros(256, dtype=bool)
CUT[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True
INSIDE = ~CUT
INSIDE[[0x20, 0x09]] = False


def _words(batch: pa.RecordBatch, shards: bool = False) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(language, shard or -1, hashes of words, numbers of their pieces, bytes, starts, stops) of the texts of a batch (text, lang, shard), by block, language and, if asked, shard."""
    lang = batch.column(1).dictionary_encode()
    codes, names = lang.indices.to_numpy().astype(np.int64), lang.dictionary.to_pylist()
    if shards:
        codes = codes * SHARDS + batch.column(2).to_numpy()
    for rows, data, offsets in bh.blocks(batch, most=TEXT):
        begins, stops, firsts = bh.words(data, offsets, INSIDE)
        if not begins.size:
            continue
        w = bh.hashes(data, begins, stops, bh.FOLDED)
        cuts = np.cumsum(CUT[data], dtype=np.int32)
        fresh = np.ones(begins.size, dtype=bool)
        fresh[1:] = cuts[begins[1:]] != cuts[stops[:-1] - 1]
        fresh[firsts[:-1][np.diff(firsts) > 0]] = True
        piece = np.cumsum(fresh, dtype=np.int32)
        of = np.repeat(codes[rows], np.diff(firsts))
        by = np.argsort(of, kind="stable")
        edges = [0, *(np.flatnonzero(np.diff(of[by])) + 1).tolist(), of.size]
        del cuts, fresh  # a block's caller holds its own arrays beside those of the block
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            at, code = by[lo:hi], int(of[by[lo]])
            yield names[code // SHARDS if shards else code], code % SHARDS if shards else -1, w[at], piece[at], data, begins[at], stops[at]


def _first(w: np.ndarray, lang: str) -> np.ndarray:
    return bh.mixed(w ^ U(bh.hash_of(lang.encode() + b"\0", bh.VALUE)))


def _longer(key: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Keys of phrases of k words from those of their first k - 1: key[i] stands for the words from i on."""
    return bh.mixed(key[: max(0, w.size - k + 1)] * U(0xD6E8FEB86659FD93) + w[k - 1 :])


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(key.view(np.int64), return_counts=True)


def _rows(lang: str, key: np.ndarray | None, **columns: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    keys = pa.nulls(n, pa.int64()) if key is None else pa.array(key)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), keys, *(pa.array(v) for v in columns.values())], ["lang", "key", *columns])


def _shard_rows(lang: str, shard: int, key: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    return _rows(lang, key, shard=np.full(n.size, shard, dtype=np.int32), n=n.astype(np.int64))


def word_counts(source: DataFrame, least: int) -> DataFrame:
    """(lang, key, shard, n): the words with ``least`` occurrences or more in their language (shard -1), and rows with a null key for all words of each shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, shard, w, _, _, _, _ in _words(batch, shards=True):
                yield _shard_rows(lang, -1, *_counted(_first(w, lang)))
                yield _shard_rows(lang, shard, None, np.array([w.size]))

    out = source.mapInArrow(frugal(count), "lang string, key long, shard int, n long").groupBy("lang", "key", "shard").agg(F.sum("n").alias("n"))
    return out.where(F.col("key").isNull() | (F.col("n") >= least))


def possible(source: DataFrame, sizes: DataFrame, least: int, words: np.ndarray, pairs: np.ndarray | None, longest: int) -> DataFrame:
    """(key) of the phrases that may have ``least`` occurrences: pairs of words on the filter ``words`` or, given the filter ``pairs``, longer phrases all of whose pairs are on that.

    ``sizes`` (lang, shard, n) are the words of shards. What a shard reports, it holds as often as its support or more; a shard that is silent about a phrase holds it at most once less than that.
    """
    shared = source.sparkSession.sparkContext.broadcast((words, pairs))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = shared.value
        for batch in batches:
            for lang, shard, w, piece, _, _, _ in _words(batch, shards=True):
                first = _first(w, lang)
                on = in_filter(words, first.view(np.int64))
                good = (piece[1:] == piece[:-1]) & on[1:] & on[:-1]
                key = _longer(first, w, 2)
                if pairs is None:
                    yield _shard_rows(lang, shard, *_counted(key[good]))
                    continue
                good[good] = in_filter(pairs, key[good].view(np.int64))
                for k in range(3, longest + 1):
                    key, good = _longer(key, w, k), good[:-1] & good[1:]
                    if not good.any():
                        break
                    yield _shard_rows(lang, shard, *_counted(key[good]))

    total = sizes.groupBy("lang").agg(F.sum("n").alias("total"))
    support = sizes.join(total, "lang").select("lang", "shard", F.greatest(F.ceil(F.col("n") * least / F.col("total")), F.lit(1)).alias("support"))
    silent = support.groupBy("lang").agg(F.sum(F.col("support") - 1).alias("silent"))
    counts = source.mapInArrow(frugal(mine), "lang string, key long, shard int, n long").groupBy("lang", "shard", "key").agg(F.sum("n").alias("n"))
    # a row a language and shard, and a row a language
    reported = counts.join(F.broadcast(support), ["lang", "shard"]).where(F.col("n") >= F.col("support"))
    bound = reported.groupBy("lang", "key").agg(F.sum(F.col("n") - F.col("support") + 1).alias("u"))
    return bound.join(F.broadcast(silent), "lang").where(F.col("u") + F.col("silent") >= least).select("key")


def counted(source: DataFrame, wanted: np.ndarray, least: int, longest: int) -> DataFrame:
    """(lang, key, n, k, p1.., s1..): exact counts of all phrases on the filter with ``least`` or more, their number of words, and the keys of their first j and of all but their first j words."""
    shared = source.sparkSession.sparkContext.broadcast(wanted)
    parts = [f"{c}{j}" for c in "ps" for j in range(1, longest)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, _, w, piece, _, _, _ in _words(batch):
                keys = [_first(w, lang)]
                for k in range(2, min(longest, w.size) + 1):
                    keys.append(_longer(keys[-1], w, k))
                    at = np.flatnonzero((piece[k - 1 :] == piece[: piece.size - k + 1]) & in_filter(shared.value, keys[-1].view(np.int64)))
                    if not at.size:
                        continue
                    found, one, n = np.unique(keys[-1][at].view(np.int64), return_index=True, return_counts=True)
                    one = at[one]
                    columns = {"n": n.astype(np.int64), "k": np.full(n.size, k, dtype=np.int32)}
                    for name in parts:
                        j = int(name[1:])
                        if j < k:
                            columns[name] = (keys[j - 1][one] if name[0] == "p" else keys[k - j - 1][one + j]).view(np.int64)
                        else:
                            columns[name] = np.zeros(n.size, dtype=np.int64)
                    yield _rows(lang, found, **columns)

    shape = "lang string, key long, n long, k int, " + ", ".join(f"{p} long" for p in parts)
    return source.mapInArrow(frugal(count), shape).groupBy("lang", "key").agg(F.sum("n").alias("n"), F.max("k").alias("k"), *[F.max(p).alias(p) for p in parts]).where(F.col("n") >= least)


def texts_of(source: DataFrame, wanted: DataFrame, longest: int) -> DataFrame:
    """(lang, key, phrase) of the phrases ``wanted`` (lang, key), words joined by a blank."""
    shared = source.sparkSession.sparkContext.broadcast(key_filter(wanted.select("key").distinct(), "key", BITS, plain=True))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, _, w, piece, data, begins, stops in _words(batch):
                key = _first(w, lang)
                for k in range(2, min(longest, w.size) + 1):
                    key = _longer(key, w, k)
                    at = np.flatnonzero((piece[k - 1 :] == piece[: piece.size - k + 1]) & in_filter(shared.value, key.view(np.int64)))
                    if not at.size:
                        continue
                    found, one = np.unique(key[at].view(np.int64), return_index=True)
                    said = [b" ".join(data[begins[i + j] : stops[i + j]].tobytes() for j in range(k)).lower() for i in at[one].tolist()]
                    yield _rows(lang, found, phrase=np.array([s.decode() for s in said], dtype=object))

    return source.mapInArrow(frugal(look), "lang string, key long, phrase string").join(wanted, ["lang", "key"], "left_semi").groupBy("lang", "key").agg(F.min("phrase").alias("phrase"))


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame, longest: int) -> DataFrame:
    """(lang, key, a, l, r, n, score) of each of ``phrases``: the cut with the lowest score, the first of equals."""
    deal = F.pmod(F.col("key"), F.lit(DEAL)).cast("int")
    cuts = F.filter(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"p{j}").alias("p"), F.col(f"s{j}").alias("s")) for j in range(1, longest)]), lambda c: c["j"] < F.col("k"))
    rows = phrases.select("lang", "key", F.col("n").alias("a"), "k", deal.alias("deal"), F.explode(cuts).alias("c")).select("lang", "key", "a", "k", "deal", "c.*")
    # rows of a word that begins or ends many phrases are dealt to several tasks
    single = words.select("lang", F.col("key").alias("part"), F.col("n").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("part_deal"))
    known = single.union(phrases.select("lang", "key", "n", F.lit(0)))

    def told(rows: DataFrame, part: str, alone: str, out: str) -> DataFrame:
        here = F.when(F.expr(alone), F.col("deal")).otherwise(F.lit(0)).alias("part_deal")
        return rows.select("*", F.col(part).alias("part"), here).join(known, ["lang", "part", "part_deal"]).withColumnRenamed("f", out).drop("part", "part_deal")

    rows = told(told(rows, "p", "j = 1", "l"), "s", "j = k - 1", "r").join(F.broadcast(totals), "lang")  # a row a language
    score = F.expr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(17, 0)) * cast(r as decimal(17, 0)))")
    return rows.groupBy("lang", "key").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "j", "l", "r")).alias("b")).select("lang", "key", "a", "b.l", "b.r", "n", "b.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, keep: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``keep`` phrases of 2 to ``longest`` words.

    Texts, A-Z as a-z, are cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs. Candidates have a >= ``least`` occurrences within pieces,
    overlaps included. Cut after some words, the first part occurs l times and the rest r times among n words of the language: the score is floor(1000 a n / (l r)) at the
    cut where that is lowest (of equals, the earliest). A candidate goes if a longer one holds it and occurs as often. Order: score, then a, both descending, then the phrase's
    bytes. Null texts count as empty, null languages as ``und``; repeated rows count each; an empty table, or no candidate, gives an empty result. Texts are
    read whole; other columns are ignored.
    """
    source = docs.select(F.col(text).cast("binary").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    source = source.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(SHARDS)).cast("int"))
    counts = stored(word_counts(source, least), "words")
    sizes = counts.where("key is null").select("lang", "shard", "n")
    totals = sizes.groupBy("lang").agg(F.sum("n").alias("n"))
    words = counts.where("key is not null").select("lang", "key", "n")
    frequent = key_filter(words.select("key"), "key", BITS, plain=True)
    pairs = stored(possible(source, sizes, least, frequent, None, 2), "pairs")
    more = stored(possible(source, sizes, least, frequent, key_filter(pairs, "key", BITS, plain=True), longest), "phrases")
    phrases = stored(counted(source, key_filter(pairs.union(more), "key", BITS, plain=True), least, longest), "counted")
    # a phrase inside a longer one that is as frequent lies inside one with one word more that is
    inner = phrases.where("k > 2").select("lang", "n", F.explode(F.array(F.expr("element_at(array(" + ", ".join(f"p{j}" for j in range(1, longest)) + "), k - 1)"), F.col("s1"))).alias("key")).distinct()
    left = scored(phrases, words, totals, longest).join(inner.select("lang", "key", F.col("n").alias("a")), ["lang", "key", "a"], "left_anti")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = stored(left.withColumn("place", F.rank().over(best)).where(F.col("place") <= keep).drop("place"), "ranked")
    said = first.join(texts_of(source, first.select("lang", "key"), longest), ["lang", "key"])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = said.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= keep)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
