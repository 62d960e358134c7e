"""Ranked lexical search over a length-stratified index.

The normaliser m of a document depends on its number of terms only, relative to the mean; documents of a segment with equal m are one stratum. A row of the index
is a stratum: its documents, and posting lists by term, within a term by tf. The weight of a posting depends on m and tf alone, so it is computed once for each tf of a
term in a stratum. The largest tf of each term bounds what a stratum can add to an item. A search visits strata from the highest bound down and leaves out, item by item, those
whose bound is under the item's ``keep``-th score so far.

The index covers all terms of all rows and is written without a shuffle: a segment is what one block of text gives. Items are the stated query set, taken in
blocks of bounded size, each against all rows of the index; a task gives at most ``keep`` rows an item for each group of segments.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracekit.llm import bytehash as bh
from tracekit.llm.shared import frugal, numbered, shared_folder, stored

#: Bytes of text that make one segment; postings of the items' terms that are looked at together; pairs of items and documents scored at once; terms of the items of one block; bytes of a row
#: group of the index, which bound what its writer and its reader hold, however large a task's share is.
SEGMENT, TOGETHER, STEP, TERMS, GROUP = 1 << 23, 1 << 21, 1 << 21, 1 << 19, 1 << 22
INDEX = "m long, ids array<long>, terms array<long>, groups array<int>, tfs array<int>, sizes array<int>, docs array<int>"


@dataclass
class Index:
    """Strata of all segments (one row each), the number of documents with a term, and their number of terms with repeats."""

    strata: DataFrame
    documents: int
    terms: int


@dataclass
class Block:
    """Items as columns of a sparse matrix: for each term of the sorted vocabulary the items that hold it and how often."""

    vocabulary: np.ndarray
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray
    rows: np.ndarray


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins."""
    new = np.ones(keys[0].size, dtype=bool)
    if new.size:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _lists(values: np.ndarray, sizes: np.ndarray, mask: np.ndarray | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, mask=mask))


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all rows of ``docs``, written to the shared folder."""
    source = docs.select(F.col(text).cast("binary").alias("text"), F.col(key).cast("long").alias("id"))

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(bh.words(data, offsets, bh.ALNUM)[2]) for _, data, offsets in bh.blocks(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([int(sum((x > 0).sum() for x in n))]), pa.array([int(sum(x.sum() for x in n))])], ["documents", "terms"])

    total = source.select("text").mapInArrow(frugal(size), "documents long, terms long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "terms")]).first()
    of, terms = total.documents, max(1, total.terms)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(1)
            for rows, data, offsets in bh.blocks(batch, most=SEGMENT):
                begins, stops, firsts = bh.words(data, offsets, bh.ALNUM)
                n = np.diff(firsts)
                term = bh.hashes(data, begins, stops, bh.FOLDED).view(np.int64)
                doc = np.repeat(np.arange(n.size), n)
                by = np.argsort(term, kind="stable")
                term, doc = term[by], doc[by]
                at = _runs(term, doc)
                tf = np.diff(np.append(at, term.size))
                term, doc = term[at], doc[at]
                m = 75 + 25 * n.astype(np.int64) * of // terms
                by = np.lexsort((doc, tf, term, m[doc]))
                term, doc, tf = term[by], doc[by], tf[by]
                posting_m = m[doc]
                some = np.flatnonzero(n > 0)
                some = some[np.argsort(m[some], kind="stable")]
                place = np.zeros(n.size, dtype=np.int64)  # of a document in its stratum
                head = _runs(m[some])
                in_stratum = np.diff(np.append(head, some.size))
                place[some] = np.arange(some.size) - np.repeat(head, in_stratum)
                group, list_at = _runs(posting_m, term, tf), _runs(posting_m, term)
                stratum = _runs(posting_m)
                edges = np.append(stratum, term.size)
                per_stratum_groups = np.diff(np.searchsorted(group, edges))
                per_stratum_lists = np.diff(np.searchsorted(list_at, edges))
                own = known.slice(rows.start, rows.stop - rows.start)
                ids = own.fill_null(0).to_numpy()[some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(posting_m[stratum]),
                        _lists(ids, in_stratum, mask=own.is_null().to_numpy(zero_copy_only=False)[some]),
                        _lists(term[list_at], per_stratum_lists),
                        _lists(np.diff(np.searchsorted(group, np.append(list_at, term.size))).astype(np.int32), per_stratum_lists),
                        _lists(tf[group].astype(np.int32), per_stratum_groups),
                        _lists(np.diff(np.append(group, term.size)).astype(np.int32), per_stratum_groups),
                        _lists(place[doc].astype(np.int32), np.diff(edges)),
                    ],
                    ["m", "ids", "terms", "groups", "tfs", "sizes", "docs"],
                )

    return Index(stored(source.mapInArrow(frugal(build), INDEX), "strata", group=GROUP), total.documents, total.terms)


def _item_terms(items: DataFrame) -> DataFrame:
    """(row, terms, times): the distinct terms of each item (row long, text binary) and how often it holds them; items without a term are left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for at, data, offsets in bh.blocks(batch):
                begins, stops, firsts = bh.words(data, offsets, bh.ALNUM)
                h = bh.hashes(data, begins, stops, bh.FOLDED).view(np.int64)
                told = [np.unique(h[firsts[k] : firsts[k + 1]], return_counts=True) for k in range(firsts.size - 1)]
                sizes = np.array([t.size for t, _ in told], dtype=np.int64)
                if told:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[at]), _lists(np.concatenate([t for t, _ in told]), sizes), _lists(np.concatenate([c for _, c in told]).astype(np.int64), sizes)], ["row", "terms", "times"])

    return items.mapInArrow(frugal(cut), "row long, terms array<long>, times array<long>").where(F.size("terms") > 0)


def _block(table: pa.Table) -> Block:
    table = table.combine_chunks()
    terms, times = (table.column(c).combine_chunks() for c in ("terms", "times"))
    vocabulary, rank = np.unique(terms.flatten().to_numpy(), return_inverse=True)
    item = np.repeat(np.arange(table.num_rows), np.diff(terms.offsets.to_numpy()))
    by = np.argsort(rank, kind="stable")
    return Block(vocabulary, np.searchsorted(rank[by], np.arange(vocabulary.size + 1)), item[by], times.flatten().to_numpy()[by], table.column("row").to_numpy())


def _known(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which terms stand in the vocabulary, and where."""
    rank = np.searchsorted(vocabulary, terms)
    rank[rank == vocabulary.size] = 0
    on = vocabulary[rank] == terms
    return on, rank[on]


def _document_counts(strata: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """For each term of the vocabulary the number of documents that hold it."""
    shared = strata.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(shared.value.size, dtype=np.int64)
        for batch in batches:
            terms, groups, sizes = (batch.column(k).flatten().to_numpy() for k in range(3))
            on, rank = _known(shared.value, terms)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(groups)])]
            np.add.at(df, rank, np.diff(ends)[on])
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["rank", "df"])

    told = strata.select("terms", "groups", "sizes").mapInArrow(frugal(count), "rank long, df long").groupBy("rank").agg(F.sum("df").alias("df")).toArrow()  # a row a term of the block
    out = np.zeros(vocabulary.size, dtype=np.int64)
    out[told.column("rank").to_numpy()] = told.column("df").to_numpy()
    return out


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + size[i] - 1, one range after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@dataclass
class _Stratum:
    m: int
    ids: np.ndarray
    missing: np.ndarray
    rank: np.ndarray
    impact: np.ndarray
    size: np.ndarray
    docs: np.ndarray


class _Best:
    """The first ``keep`` documents of each item so far: by score, then id (null last)."""

    def __init__(self, items: int, keep: int) -> None:
        self.keep = keep
        self.least = np.zeros(items, dtype=np.int64)
        self.rows = [np.zeros(0, dtype=np.int64) for _ in range(3)] + [np.zeros(0, dtype=bool)]

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        item, score, ids, missing = (np.concatenate(x) for x in zip(self.rows, (item, score, ids, missing), strict=True))
        by = np.lexsort((ids, missing, -score, item))
        place = np.arange(by.size) - np.repeat(_runs(item[by]), np.diff(np.append(_runs(item[by]), by.size)))
        by, place = by[place < self.keep], place[place < self.keep]
        self.rows = [x[by] for x in (item, score, ids, missing)]
        last = by[place == self.keep - 1]
        self.least[item[last]] = score[last]


def _visit(strata: list[_Stratum], block: Block, weight: np.ndarray, keep: int) -> _Best:
    """The first documents of all items among those of the strata."""
    best, items = _Best(block.rows.size, keep), block.rows.size
    held = np.diff(block.first)
    value = weight[np.repeat(np.arange(held.size), held)] * block.times
    largest, bound = np.zeros(len(strata), dtype=np.int64), np.zeros(items, dtype=np.int64)
    for k, s in enumerate(strata):
        largest[k] = _bound(s, block, value, held, bound).max(initial=0)
    for k in np.argsort(-largest, kind="stable").tolist():
        s = strata[k]
        # made once more: bounds of all strata and items at once would be a table of both
        of = _bound(s, block, value, held, bound)
        open_ = np.flatnonzero((of > 0) & (of >= best.least))
        each = max(1, STEP // max(1, s.ids.size))
        for lo in range(0, open_.size, each):
            chosen = open_[lo : lo + each]
            score = _scores(s, block, value, chosen, items)
            if s.ids.size > keep:
                least = np.partition(score, s.ids.size - keep, axis=1)[:, s.ids.size - keep]
                least = np.maximum(least, best.least[chosen])
            else:
                least = best.least[chosen]
            i, d = np.nonzero((score > 0) & (score >= least[:, None]))
            best.add(chosen[i], score[i, d], s.ids[d], s.missing[d])
    return best


def _bound(s: _Stratum, block: Block, value: np.ndarray, held: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The most that a document of the stratum can score for each item, in ``out``."""
    at = _runs(s.rank)
    top = np.maximum.reduceat(s.impact, at) if at.size else at
    rank = s.rank[at]
    to = _ranges(block.first[rank], held[rank])
    out[:] = 0
    np.add.at(out, block.item[to], value[to] * np.repeat(top, held[rank]))
    return out


def _scores(s: _Stratum, block: Block, value: np.ndarray, chosen: np.ndarray, items: int) -> np.ndarray:
    """Scores of the documents of a stratum (columns) for the chosen items (rows)."""
    slot = np.full(items, -1, dtype=np.int64)
    slot[chosen] = np.arange(chosen.size)
    out = np.zeros(chosen.size * s.ids.size, dtype=np.int64)
    held = np.diff(block.first)[s.rank]
    rank, size = s.rank, s.size
    begin = np.concatenate([[0], np.cumsum(size)])
    work = np.cumsum(held * size)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(work, np.arange(STEP, int(work[-1]) if work.size else 0, STEP)) + 1, [rank.size]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        # each tf of a term, with each item that holds the term, then with each of its documents
        to = _ranges(block.first[rank[a:b]], held[a:b])
        group = np.repeat(np.arange(a, b), held[a:b])
        on = slot[block.item[to]]
        good = on >= 0
        to, group, on = to[good], group[good], on[good]
        add = value[to] * s.impact[group]
        docs = s.docs[_ranges(begin[group], size[group])]
        np.add.at(out, np.repeat(on * s.ids.size, size[group]) + docs, np.repeat(add, size[group]))
    return out.reshape(chosen.size, s.ids.size)


def _strata(batch: pa.RecordBatch, vocabulary: np.ndarray) -> Iterator[_Stratum]:
    """The rows of a batch of the index with the postings of terms of the vocabulary only."""
    for k in range(batch.num_rows):
        ids, terms, groups, tfs, sizes, docs = (batch.column(c)[k].values for c in range(1, 7))
        on, rank = _known(vocabulary, terms.to_numpy())
        if not rank.size:
            continue
        m = batch.column(0)[k].as_py()
        groups, sizes = groups.to_numpy().astype(np.int64), sizes.to_numpy().astype(np.int64)
        at = _ranges((np.cumsum(groups) - groups)[on], groups[on])
        tf = tfs.to_numpy()[at].astype(np.int64)
        posting = _ranges((np.cumsum(sizes) - sizes)[at], sizes[at])
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        # ids are copied, as a view would hold the whole batch for as long as the stratum waits
        yield _Stratum(m, np.array(ids.fill_null(0)), missing, np.repeat(rank, groups[on]), 1_000_000_000 * tf // (1000 * tf + 12 * m), sizes[at], docs.to_numpy()[posting].astype(np.int64))


def _search_block(found: Index, block: Block, keep: int) -> DataFrame:
    """(row, doc, score): at least the first ``keep`` documents of each item of the block, a few more at the most from each task."""
    df = _document_counts(found.strata, block.vocabulary)
    weight = np.floor(1000 * np.log((2.0 * found.documents + 2) / (2.0 * df + 1))).astype(np.int64)
    weight[df == 0] = 0
    shared = found.strata.sparkSession.sparkContext.broadcast((block, weight))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = shared.value
        held: dict[int, list[_Stratum]] = {}
        size = 0

        def told() -> pa.RecordBatch:
            best = _visit([_joined(x) for x in held.values()], block, weight, keep)
            item, score, ids, missing = best.rows
            return pa.RecordBatch.from_arrays([pa.array(block.rows[item]), pa.array(ids, mask=missing), pa.array(score)], ["row", "doc", "score"])

        for batch in batches:
            for s in _strata(batch, block.vocabulary):
                held.setdefault(s.m, []).append(s)
                size += s.docs.size + s.ids.size
                if size >= TOGETHER:
                    yield told()
                    held, size = {}, 0
        if held:
            yield told()

    return found.strata.mapInArrow(frugal(look), "row long, doc long, score long")


def _joined(parts: list[_Stratum]) -> _Stratum:
    """One stratum of several segments' with the same normaliser."""
    if len(parts) == 1:
        return parts[0]
    offset = np.cumsum([0, *[p.ids.size for p in parts[:-1]]])
    rank, impact, size = (np.concatenate([getattr(p, c) for p in parts]) for c in ("rank", "impact", "size"))
    docs = np.concatenate([p.docs + o for p, o in zip(parts, offset.tolist(), strict=True)])
    by = np.lexsort((impact, rank))
    docs = docs[_ranges((np.cumsum(size) - size)[by], size[by])]
    return _Stratum(parts[0].m, np.concatenate([p.ids for p in parts]), np.concatenate([p.missing for p in parts]), rank[by], impact[by], size[by], docs)


def search(found: Index, items: DataFrame, item: str = "item_id", text: str = "text", keep: int = 20) -> DataFrame:
    """(item, rank, doc_id, score): the ``keep`` documents with the highest scores above 0 for each row of ``items``.

    Terms are runs of ASCII letters and digits (A-Z as a-z) and of all characters outside ASCII. A term that df of N documents hold weighs w = floor(1000 ln((2 N + 2) / (2 df + 1)));
    a document of n terms has m = 75 + 25 n N div L, L being the terms of all documents; its score is the sum of w * ((10^9 tf) div (1000 tf + 12 m)) over
    the item's terms, repeats included. Equal scores go by document id, null last. Rows of documents with one id are documents of their own; rows of ``items`` with one id are
    ranked each for itself. Texts are read whole; null ones have no terms, and items without terms no rows. An empty table on either side gives an empty result. Other columns are ignored.
    """
    spark = items.sparkSession
    kind = items.schema[item].dataType.simpleString()
    rows = numbered(items.select(F.col(item).alias("item"), F.col(text).cast("binary").alias("text")), [F.col("item").asc_nulls_first(), "text"], "row")
    terms = stored(_item_terms(rows.select("row", "text")), "item_terms")
    blocks = -(-(terms.agg(F.sum(F.size("terms"))).first()[0] or 0) // TERMS)
    at = f"{shared_folder(spark)}/ranked-{uuid.uuid4().hex}"
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    for b in range(blocks):  # one job after the other, each with a bounded block of items against the index
        part = terms.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow()
        if part.num_rows:
            told = _search_block(found, _block(part), keep)
            told.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).write.mode("append").parquet(at)
    shape = "row long, doc long, score long, rank int"
    ranked = spark.read.schema(shape).parquet(at) if blocks else spark.createDataFrame([], shape)
    return ranked.join(rows.select("row", F.col("item").cast(kind).alias(item)), "row").select(item, "rank", F.col("doc").alias("doc_id"), "score")
