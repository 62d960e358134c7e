"""Benchmark decontamination over a distributed positional inverted index of the training documents.

The index has a row for each term and range of documents: the posting list of the term, that is the documents of the range
and the places of the term in each. It is written once, for the terms of the whole benchmark; a document that has none of the lead terms, the rarest
of each window over the whole corpus, cannot match and has no postings. A search starts from the lists of the lead terms and
intersects them with those of the other terms, rarest first, each shifted by the term's place
in the window; what is left are exact phrase matches. With a slack, terms may stand that many words
off their place (proximity matches).

The benchmark is the query set: its windows are taken in blocks of bounded size, each against all rows of the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekit.llm import bytehash as bh
from tracekit.llm.shared import frugal, in_filter, key_filter, stored, with_row_id

U = np.uint64
#: Windows that one block of queries holds, which is what is broadcast at once; bits of the filters over terms; matches of lead terms that are looked at together.
BLOCK, BITS, STEP = 1 << 16, 1 << 27, 1 << 20
INDEX = "shard long, term long, ids array<long>, counts array<int>, places array<int>"
FOUND = "id long, spans array<struct<lo: long, hi: long>>, items array<string>"


@dataclass
class Windows:
    """A block of benchmark windows: terms as ranks in the sorted vocabulary, -1 past a short window's end; places of its terms from the rarest to the most frequent; windows by lead term."""

    vocabulary: np.ndarray
    terms: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    names: list[str | None]
    by_rarity: np.ndarray
    lead_first: np.ndarray
    lead_order: np.ndarray


def windows_of(tests: DataFrame, width: int) -> DataFrame:
    """(item, terms): the distinct windows of ``width`` consecutive words of tests (item string, text binary); an item with fewer, but not none, is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in bh.blocks(batch):
                begins, stops, firsts = bh.words(data, offsets, bh.ALNUM)
                h = bh.hashes(data, begins, stops, bh.FOLDED).view(np.int64)
                item, found = [], []
                for k, name in enumerate(batch.column(0).slice(rows.start, rows.stop - rows.start).to_pylist()):
                    w = h[firsts[k] : firsts[k + 1]]
                    for s in range(max(1, w.size - width + 1) if w.size else 0):
                        item.append(name)
                        found.append(w[s : s + width])
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(found, pa.list_(pa.int64()))], ["item", "terms"])

    return tests.mapInArrow(frugal(cut), "item string, terms array<long>").distinct()


def term_counts(source: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(term, n): how often each term on the filter stands in all of the texts."""
    shared = source.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in bh.blocks(batch):
                begins, stops, _ = bh.words(data, offsets, bh.ALNUM)
                term, n = np.unique(bh.hashes(data, begins, stops, bh.FOLDED).view(np.int64), return_counts=True)
                on = in_filter(shared.value, term)
                yield pa.RecordBatch.from_arrays([pa.array(term[on]), pa.array(n[on].astype(np.int64))], ["term", "n"])

    return source.select("text").mapInArrow(frugal(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def by_rarity(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, terms, order, lead): places of the window's terms from the rarest in the corpus to the most frequent, and the rarest; windows with a term that stands nowhere are left out."""
    each = windows.select("item", "terms", F.posexplode("terms").alias("place", "term")).join(counts, "term", "left")
    told = each.groupBy("item", "terms").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place"))).alias("s"))
    return told.where("s[0].n > 0").select("item", "terms", F.col("s.place").alias("order"), F.expr("terms[s[0].place]").alias("lead"))


def positional_index(source: DataFrame, wanted: np.ndarray, leads: np.ndarray) -> DataFrame:
    """(shard, term, ids, counts, places): posting lists by range of documents and term; one row of each range, with no term, has its documents and their numbers of words."""
    shared = source.sparkSession.sparkContext.broadcast((wanted, leads))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, leads = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, data, offsets in bh.blocks(batch):
                begins, stops, firsts = bh.words(data, offsets, bh.ALNUM)
                n, own = np.diff(firsts), ids[rows]
                h = bh.hashes(data, begins, stops, bh.FOLDED).view(np.int64)
                doc = np.repeat(np.arange(n.size), n)
                there = in_filter(wanted, h)
                hopeful = np.zeros(n.size, dtype=bool)
                hopeful[doc[there & in_filter(leads, h)]] = True
                there &= hopeful[doc]
                term, doc, place = h[there], doc[there], (np.arange(h.size) - np.repeat(firsts[:-1], n))[there]
                by = np.lexsort((place, doc, term))
                term, doc, place = term[by], doc[by], place[by]
                new_term, new = np.ones(term.size, dtype=bool), np.ones(term.size, dtype=bool)
                new_term[1:] = term[1:] != term[:-1]
                new[1:] = new_term[1:] | (doc[1:] != doc[:-1])
                head, list_at = np.flatnonzero(new_term), np.flatnonzero(new)
                by_term = np.append(np.searchsorted(list_at, head), list_at.size)
                id_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], [n.size], n.size + by_term[1:]]).astype(np.int32)), pa.array(np.concatenate([own, own[doc[list_at]]])))
                count_lists = pa.ListArray.from_arrays(id_lists.offsets, pa.array(np.concatenate([n, np.diff(np.append(list_at, term.size))]).astype(np.int32)))
                place_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], [0], np.append(head, term.size)[1:]]).astype(np.int32)), pa.array(place.astype(np.int32)))
                terms = pa.array(np.concatenate([[0], term[head]]).astype(np.int64), mask=np.arange(head.size + 1) == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(head.size + 1, own[0])), terms, id_lists, count_lists, place_lists], ["shard", "term", "ids", "counts", "places"])

    return source.mapInArrow(frugal(build), INDEX)


def _block(rows: pa.Table) -> Windows:
    """Windows of the rows (item, terms, order, lead), with their vocabulary."""
    rows = rows.combine_chunks()
    terms, order, lead = (rows.column(c).combine_chunks() for c in ("terms", "order", "lead"))
    lengths = np.diff(terms.offsets.to_numpy())
    vocabulary, rank = np.unique(terms.flatten().to_numpy(), return_inverse=True)
    width = int(lengths.max())
    at = np.repeat(np.arange(lengths.size), lengths), np.arange(rank.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    matrix, rarity = (np.full((lengths.size, width), fill, dtype=np.int64) for fill in (-1, 0))
    matrix[at], rarity[at] = rank, order.flatten().to_numpy()
    for k in np.flatnonzero(lengths < width).tolist():  # past a short window's end there is nothing to look for
        rarity[k, lengths[k] :] = np.arange(lengths[k], width)
    leads = np.searchsorted(vocabulary, lead.to_numpy())
    by = np.argsort(leads, kind="stable")
    named = rows.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
    return Windows(vocabulary, matrix, lengths, named.indices.to_numpy().astype(np.int64), named.dictionary.to_pylist(), rarity, np.searchsorted(leads[by], np.arange(vocabulary.size + 1)), by)


def _stands(codes: np.ndarray, doc: np.ndarray, term: np.ndarray, place: np.ndarray, slack: int) -> np.ndarray:
    """Whether a posting of the term lies within ``slack`` words of the place."""
    base = (doc.astype(U) << U(48)) | (term.astype(U) << U(28))
    want = base + np.maximum(place - slack, 0).astype(U)
    at = np.searchsorted(codes, want)
    got = codes[np.minimum(at, codes.size - 1)]
    return (at < codes.size) & (place + slack >= 0) & (got <= base + np.maximum(place + slack, 0).astype(U))


def _matches(rows: pa.Table, w: Windows, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, number of the document, window, start) of all matches in the posting lists of one range."""
    term = rows.column("term").to_numpy()
    rank = np.searchsorted(w.vocabulary, term)
    rank[rank == w.vocabulary.size] = 0
    known = w.vocabulary[rank] == term
    rows, rank = rows.filter(pa.array(known)).combine_chunks(), rank[known]
    none = np.zeros(0, np.int64)
    if not rows.num_rows:
        return none, none, none, none
    ids, counts, places = (rows.column(c).combine_chunks() for c in ("ids", "counts", "places"))
    per = counts.flatten().to_numpy().astype(np.int64)
    docs, number = np.unique(ids.flatten().to_numpy(), return_inverse=True)
    doc, place = np.repeat(number, per), places.flatten().to_numpy().astype(np.int64)
    term = np.repeat(np.repeat(rank, np.diff(ids.offsets.to_numpy())), per)
    codes = np.sort((doc.astype(U) << U(48)) | (term.astype(U) << U(28)) | place.astype(U))
    many = np.diff(w.lead_first)[term]
    lead = np.flatnonzero(many)
    doc, term, place, many = doc[lead], term[lead], place[lead], many[lead]
    found = []
    for part in np.split(np.arange(lead.size), np.unique(np.searchsorted(np.cumsum(many), np.arange(STEP, int(many.sum()), STEP)))):
        m = many[part]
        d, p = np.repeat(doc[part], m), np.repeat(place[part], m)
        win = w.lead_order[np.repeat(w.lead_first[term[part]], m) + np.arange(d.size) - np.repeat(np.cumsum(m) - m, m)]
        start = p - w.by_rarity[win, 0]
        for r in range(1, w.terms.shape[1]):
            if not d.size:
                break
            off = w.by_rarity[win, r]
            t = w.terms[win, off]
            good = (t < 0) | _stands(codes, d, np.maximum(t, 0), start + off, slack)
            d, win, start = d[good], win[good], start[good]
        found.append((d, win, start))
    d, win, start = (np.concatenate(x) for x in zip(*found, strict=True))
    return docs, d, win, start


def search(index: DataFrame, windows: Windows, slack: int = 0) -> DataFrame:
    """(id, spans, items) of the documents in which windows occur: the spans of words [lo, hi) and the distinct names of their items.

    A span starts where the window does, judged by its lead term; with a slack the other terms may be so many words off, and the span may reach over the text's edge.
    """
    shared = index.sparkSession.sparkContext.broadcast(windows)

    def told(rows: pa.Table) -> pa.RecordBatch:
        w = shared.value
        docs, d, win, start = _matches(rows, w, slack)
        by = np.lexsort((start, d))
        d, win, start = d[by], win[by], start[by]
        hit, edge = np.unique(d, return_index=True)
        spans = pa.StructArray.from_arrays([pa.array(start), pa.array(start + w.lengths[win])], ["lo", "hi"])
        pair = np.unique(d * (1 << 32) + w.items[win])
        item_edge = np.searchsorted(pair >> 32, hit)
        names = pa.array(w.names, pa.string()).take(pa.array(pair & 0xFFFFFFFF))
        lists = [pa.ListArray.from_arrays(pa.array(np.append(e, x).astype(np.int32)), v) for e, x, v in ((edge, d.size, spans), (item_edge, pair.size, names))]
        return pa.RecordBatch.from_arrays([pa.array(docs[hit].astype(np.int64)), *lists], ["id", "spans", "items"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            for a, b in zip([0, *(np.flatnonzero(np.diff(shard)) + 1).tolist()], [*(np.flatnonzero(np.diff(shard)) + 1).tolist(), shard.size], strict=True):
                if held and b > a and held[0].column(0)[0].as_py() != shard[a]:
                    yield told(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield told(pa.Table.from_batches(held))

    return index.where("term is not null").repartition("shard").sortWithinPartitions("shard", "term").mapInArrow(frugal(find), FOUND)


def _covered(spans: str) -> F.Column:
    """Words in the union of spans."""
    return F.expr(f"aggregate(array_sort({spans}), named_struct('hi', 0L, 'n', 0L), (a, s) -> named_struct('hi', greatest(a.hi, s.hi), 'n', a.n + greatest(0L, s.hi - greatest(a.hi, s.lo))), a -> a.n)")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10, slack: int = 0) -> DataFrame:
    """(key, n_words, n_hit, items array<string>, spans, contaminated) for each row of ``docs``.

    Words are runs of ASCII letters and digits (A-Z as a-z) and of all characters outside ASCII. Windows are ``width`` consecutive
    words of an item; an item with fewer, but not none, is one window. n_hit counts the words inside any occurrence of a
    window; items are the distinct ids, as strings, of the items with occurring windows, sorted as strings; items with a null id
    hit but are not named, and rows with one id are one item. Null texts have no words; an empty benchmark hits nothing. Rows
    with one key stay separate; spans are cut at the text's edges. Other columns are ignored.
    """
    docs, row, unique = with_row_id(docs, text, key)
    source = docs.select(F.col(row).alias("id"), F.col(text).cast("binary").alias("text"))
    tests = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text"))
    windows = stored(windows_of(tests, width), "windows")
    wanted = key_filter(windows.select(F.explode("terms").alias("term")).distinct(), "term", BITS, plain=True)
    queries = stored(by_rarity(windows, term_counts(source, wanted)), "queries")
    leads = key_filter(queries.select("lead").distinct(), "lead", BITS, plain=True)
    index = stored(positional_index(source, wanted, leads), "postings")
    sizes = index.where("term is null").select(F.explode(F.arrays_zip("ids", "counts")).alias("d")).select(F.col("d.ids").alias("id"), F.col("d.counts").cast("long").alias("n_words"))
    blocks = -(-queries.count() // min(BLOCK, (1 << 19) // width))
    found = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)) == b).toArrow()
        if rows.num_rows:
            part = search(index, _block(rows), slack)
            found = found.union(part) if found else part
    if found is None:
        found = sizes.limit(0).selectExpr("id", "cast(null as array<struct<lo: bigint, hi: bigint>>) as spans", "cast(null as array<string>) as items")
    elif blocks > 1:
        found = found.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    out = sizes.join(found, "id", "left")
    spans = F.transform(F.coalesce("spans", F.array().cast("array<struct<lo: bigint, hi: bigint>>")), lambda s: F.struct(F.greatest(s["lo"], F.lit(0)).alias("lo"), F.least(s["hi"], F.col("n_words")).alias("hi")))
    items = F.array_sort(F.array_distinct(F.filter(F.coalesce("items", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    out = out.select("id", "n_words", spans.alias("spans"), items.alias("items")).select("id", "n_words", _covered("spans").alias("n_hit"), "items", "spans")
    out = out.withColumn("contaminated", F.col("n_hit") > 0)
    if unique:
        return out.withColumnRenamed("id", key)
    return docs.select(F.col(row).alias("id"), F.col(key).alias("k")).join(out, "id").drop("id").withColumnRenamed("k", key)
