"""Exact substring dedup by interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the corpus.

Strings of that length are dealt out so that equal ones meet: each has an anchor, its leftmost smallest
``ANCHOR``-byte gram, which depends on nothing but the string itself. Neighbouring strings share an anchor, so
a row stands for a run of them; its key is the hash of the bytes that all strings of the run have in
common. Runs with a key of their own cannot repeat and go no further; hashes do no more than that.

Different runs with one key are decided by a breadth-first expansion on the Burrows-Wheeler transform of the runs' texts: starting from the
empty string, intervals of the suffix order are extended backwards a byte at a time, each new interval boundary gets
its longest common prefix, in increasing order, and the expansion stops at ``length``. Suffixes with
no boundary between them then share ``length`` bytes. Runs that look like whole copies of an earlier one need no transform, but a comparison of
their bytes: within a batch on the spot, else stretch by stretch, in a join with the text that holds the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekit.llm import bytehash as bh
from tracekit.llm.shared import frugal, in_filter, key_filter, stored, with_row_id

U = np.uint64
ANCHOR = 16
#: Texts of runs that one transform takes in; a key with more than HOT different runs is resolved by single strings.
BATCH, HOT = 1 << 20, 4096
#: Bytes of runs, about, that one task puts through transforms; bytes of text, about, whose runs are held at once.
TASK, PART = 4 << 20, 6 << 20


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: x.size - rest], x[rest:]) if rest else x


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring strings that share an anchor and lie in one text: anchor, first and last start, text number."""
    width = length - ANCHOR + 1
    found: list[tuple[np.ndarray, ...]] = []
    step = 1 << 18
    text_of = np.repeat(np.arange(offsets.size - 1), np.diff(offsets))
    for lo in range(0, max(0, data.size - length + 1), step):
        piece = data[lo : lo + step + length - 1]
        # a gram's hash from its two halves: eight bytes read as one number
        eight = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(piece), 8)
        eight = np.ascontiguousarray(eight).view(U).ravel()
        gram = bh.mixed(eight[: piece.size - 15] * U(0x9E3779B97F4A7C15) + (eight[8:] ^ U(0xC2B2AE3D27D4EB4F)) * U(0xD6E8FEB86659FD93))
        order = (gram >> U(20) << U(20)) | np.arange(gram.size, dtype=U)
        best = (_sliding_min(order, width) & U((1 << 20) - 1)).astype(np.int64)
        start = np.arange(best.size)
        inside = text_of[lo : lo + best.size] == text_of[lo + length - 1 : lo + length - 1 + best.size]
        change = np.ones(best.size, dtype=bool)
        change[1:] = (best[1:] != best[:-1]) | (inside[1:] != inside[:-1]) | (text_of[lo + 1 : lo + best.size] != text_of[lo : lo + best.size - 1])
        at = np.flatnonzero(change)
        end = np.append(at[1:], best.size) - 1
        good = inside[at]
        at, end = at[good], end[good]
        found.append((best[at] + lo, start[at] + lo, start[end] + lo, text_of[at + lo]))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def keyed_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(key, hash of the run's text, text number, first start, last start).

    A run is parted in two where its strings begin well before the anchor or not, so that the part common to all of its
    strings is more than half a string.
    """
    anchor, a, b, text = runs(data, offsets, length)
    cut = (length - ANCHOR) // 2
    left = np.minimum(b, anchor - cut - 1)
    right = np.maximum(a, anchor - cut)
    has_left, has_right = left >= a, right <= b
    where = np.concatenate([anchor[has_left], anchor[has_right]])
    lo = np.concatenate([a[has_left], right[has_right]])
    hi = np.concatenate([left[has_left], b[has_right]])
    text = np.concatenate([text[has_left], text[has_right]])
    side = np.repeat(np.array([1, 2], dtype=U), [int(has_left.sum()), int(has_right.sum())])
    # the bytes that every string of this side of the anchor has
    start = np.where(side == 1, where - cut - 1, where)
    stop = np.where(side == 1, where + ANCHOR, where - cut + length)
    by = np.argsort(start, kind="stable")
    where, lo, hi, text, side, start, stop = (x[by] for x in (where, lo, hi, text, side, start, stop))
    key = _span_hash(data, start, stop) + side
    by = np.argsort(lo, kind="stable")
    ctx = np.empty(lo.size, dtype=U)
    ctx[by] = _span_hash(data, lo[by], hi[by] + length)
    shape = (where - lo).astype(U) * U(256) + (hi - lo).astype(U)
    return key, bh.mixed(ctx + shape), text, lo, hi


def _span_hash(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of short overlapping stretches; starts rise."""
    out = np.empty(start.size, dtype=U)
    i = 0
    while i < start.size:
        first = int(start[i])
        j = int(np.searchsorted(start, first + bh.STRETCH - 1024, side="right"))
        last = int(stop[i:j].max())
        sums = np.zeros(last - first + 1, dtype=U)
        np.cumsum(bh.VALUE[data[first:last]] * bh.POWER[: last - first], out=sums[1:])
        s, e = start[i:j] - first, stop[i:j] - first
        out[i:j] = bh.mixed((sums[e] - sums[s]) * bh.UNPOWER[s] + (e - s).astype(U))
        i = j
    return out


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a circular text in the order of the ``depth`` or more bytes that follow."""
    n = text.size
    wide = np.concatenate([text, text[:8]])
    word = np.zeros(n, dtype=U)
    for k in range(8):
        word = (word << U(8)) | wide[k : k + n].astype(U)
    span = 8
    while True:
        order = np.argsort(word)
        ranked = word[order]
        step = np.zeros(n, dtype=np.int64)
        step[1:] = np.cumsum(ranked[1:] != ranked[:-1])
        if span >= depth or step[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = step
        word = (rank.astype(U) << U(32)) | np.roll(rank, -span).astype(U)
        span *= 2


def common_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a circular text and, for each place in it, the common prefix with the place before: its length if under ``length``, else -1.

    Intervals are extended backwards breadth first. An interval of strings of n bytes whose right end has no value yet
    puts n - 1 there and is queued; one whose right end is known adds nothing to its extensions that others don't.
    """
    n = text.size
    order = suffix_order(text, length)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    before = text[order - 1]  # the transform
    back = rank[order - 1].astype(U)  # where a suffix with one byte more in front of it stands
    prefix = np.full(n + 1, -1, dtype=np.int16)
    prefix[0] = 0
    low, high = np.array([0]), np.array([n])
    for depth in range(length):
        size = high - low
        one = size == 1
        place = low[one]
        child_low, child_high = [back[place].astype(np.int64)], [back[place].astype(np.int64) + 1]
        low, size = low[~one], size[~one]
        # several intervals at once, but never many times the text
        bounds = np.searchsorted(np.cumsum(size), np.arange(1, int(size.sum()) // (1 << 22) + 1) * (1 << 22)) if size.size else np.zeros(0, np.int64)
        for part in np.split(np.arange(size.size), bounds):
            if not part.size:
                continue
            s = size[part]
            which = np.repeat(np.arange(part.size), s)
            place = np.repeat(low[part] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
            packed = (which.astype(U) << U(40)) | (before[place].astype(U) << U(32)) | back[place]
            packed.sort()
            group = packed >> U(32)
            edge = np.flatnonzero(group[1:] != group[:-1]) + 1
            child_low.append((packed[np.append(0, edge)] & U(0xFFFFFFFF)).astype(np.int64))
            child_high.append((packed[np.append(edge, packed.size) - 1] & U(0xFFFFFFFF)).astype(np.int64) + 1)
        low, high = np.concatenate(child_low), np.concatenate(child_high)
        new = prefix[high] < 0
        new &= high < n
        prefix[high[new]] = depth
        # an extension of the last interval of all has no right end to fill, but its parts may
        new |= (high == n) & (high - low > 1)
        low, high = low[new], high[new]
        if not low.size:
            break
    return order, prefix[:n]


def _repeats(key: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, last start) of strings of some runs that stand in another of them, or in another place, before."""
    text = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if text.size < length + 8:
        text = np.tile(text, -(-(length + 8) // max(1, text.size)))
    order, prefix = common_prefixes(text, length)
    group = np.empty(text.size, dtype=np.int64)
    group[order] = np.cumsum(prefix >= 0)
    many = hi - lo + 1
    base = np.cumsum([0, *(len(t) for t in texts[:-1])])
    run = np.repeat(np.arange(lo.size), many)
    off = np.arange(run.size) - np.repeat(np.cumsum(many) - many, many)
    g, r, s = group[base[run] + off], row[run], lo[run] + off
    by = np.lexsort((s, r, g))
    first = np.ones(by.size, dtype=bool)
    first[1:] = g[by][1:] != g[by][:-1]
    again = np.zeros(by.size, dtype=bool)
    again[by] = ~first
    # neighbouring starts of one run are one row
    edge = again.copy()
    edge[1:] &= ~(again[:-1] & (run[1:] == run[:-1]))
    stop = again.copy()
    stop[:-1] &= ~(again[1:] & (run[1:] == run[:-1]))
    return r[edge], s[edge], s[stop]


SPAN = pa.schema([("id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
RUN = pa.schema([("again", pa.bool_()), ("key", pa.int64()), ("ctx", pa.int64()), ("id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
TOLD = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("open", pa.bool_()), ("fid", pa.int64()), ("flo", pa.int32())])
PIECE = pa.schema([("open", pa.bool_()), ("hot", pa.bool_()), ("key", pa.int64()), ("id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("fid", pa.int64()), ("flo", pa.int32()), ("piece", pa.binary())])


def _rows(schema: pa.Schema, *columns: np.ndarray | pa.Array | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Whether the n[i] bytes from a[i] on are those from b[i] on."""
    out = np.zeros(a.size, dtype=bool)
    for k in range(0, a.size, step):
        m = n[k : k + step]
        first = np.cumsum(m) - m
        off = np.arange(int(m.sum())) - np.repeat(first, m)
        out[k : k + step] = np.logical_and.reduceat(data[np.repeat(a[k : k + step], m) + off] == data[np.repeat(b[k : k + step], m) + off], first)
    return out


def _all_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """All runs of a batch, taken in parts of a few MB (again false). Of those whose bytes are equal within a part only the first is left to meet others; the rest are repeats, neighbours joined (again true), with keys of their own that deal them evenly."""
    parts = (batch.slice(rows.start, rows.stop - rows.start) for batch in batches for rows, _, _ in bh.blocks(batch, most=PART))
    for batch in parts:
        ids = batch.column(0).to_numpy()
        everything, starts = bh.whole(batch.column(1))
        found = []
        for rows, data, offsets in bh.blocks(batch, most=1 << 20):
            key, ctx, text, lo, hi = keyed_runs(data, offsets, length)
            found.append((key, ctx, ids[rows][text], lo - offsets[text], hi - lo, lo + starts[rows.start]))
        if not found:
            continue
        key, ctx, at, lo, more, place = (np.concatenate(x) for x in zip(*found, strict=True))
        same = key + ctx * U(3)
        by = np.lexsort((lo, at, same))
        new = np.ones(by.size, dtype=bool)
        new[1:] = same[by[1:]] != same[by[:-1]]
        first = by[np.maximum.accumulate(np.where(new, np.arange(by.size), 0))]
        twin, first = by[~new], first[~new]
        fits = more[twin] == more[first]
        twin, first = twin[fits], first[fits]
        good = _equal(everything, place[twin], place[first], more[twin] + length)
        again = np.zeros(by.size, dtype=bool)
        again[twin[good]] = True
        rest = ~again
        yield _rows(RUN, np.zeros(int(rest.sum()), bool), key[rest].view(np.int64), ctx[rest].view(np.int64), at[rest], lo[rest], (lo + more)[rest])
        at, lo, hi = at[again], lo[again], (lo + more)[again]
        by = np.lexsort((lo, at))
        at, lo, hi = at[by], lo[by], hi[by]
        new = np.ones(at.size, dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (lo[1:] > hi[:-1] + 1)
        edge = np.flatnonzero(new)
        if edge.size:
            last = np.append(edge[1:], at.size) - 1
            yield _rows(RUN, np.ones(edge.size, bool), bh.mixed(at[edge].view(U) * U(1 << 20) + lo[edge].astype(U)).view(np.int64), np.zeros(edge.size, np.int64), at[edge], lo[edge], hi[last])


def _told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order (again, key, ctx, id, lo): the first run of each context of a key with several (open), and the others with the place of the first one that they look like (fid, flo).

    Rows stream through; of the key that a batch ends in, no more than its first row and that of its last context is held.
    """
    head: tuple[int, int, int, int] | None = None  # key, context and place of the first row of the context that the last batch ended in
    only: tuple[int, int, int, int] | None = None  # the first row of the key that it ended in, if it has had one context
    for batch in batches:
        again = batch.column(0).to_numpy(zero_copy_only=False)
        if again.any():
            kept = batch.filter(pa.array(again))
            none = pa.nulls(kept.num_rows)
            yield _rows(TOLD, *(kept.column(k) for k in (1, 3, 4, 5)), np.zeros(kept.num_rows, bool), none.cast(pa.int64()), none.cast(pa.int32()))
        key, ctx, at, lo, hi = (batch.column(k).to_numpy()[~again] for k in range(1, 6))
        n = key.size
        if not n:
            continue
        new_key = np.ones(n, dtype=bool)
        new_key[1:] = key[1:] != key[:-1]
        new_key[0] = head is None or head[0] != key[0]
        new = new_key.copy()
        new[1:] |= ctx[1:] != ctx[:-1]
        new[0] |= head is None or head[1] != ctx[0]
        first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        fid, flo = at[first], lo[first]
        if head is not None:
            fid[first < 0], flo[first < 0] = head[2], head[3]
        number = np.cumsum(new_key)  # 0: the key that the last batch ended in
        contexts = np.bincount(number[new], minlength=number[-1] + 1)
        several = contexts > 1
        if not new_key[0]:
            several[0] = contexts[0] > 0 or only is None
        is_open = new & several[number]
        if only is not None and not new_key[0] and contexts[0]:
            yield _rows(TOLD, *([x] for x in only), [True], [None], [None])
            only = None
        yield _rows(TOLD, key[is_open], at[is_open], lo[is_open], hi[is_open], np.ones(int(is_open.sum()), bool), pa.nulls(int(is_open.sum()), pa.int64()), pa.nulls(int(is_open.sum()), pa.int32()))
        yield _rows(TOLD, key[~new], at[~new], lo[~new], hi[~new], np.zeros(int((~new).sum()), bool), fid[~new], flo[~new])
        if number[-1]:
            k = int(np.flatnonzero(new_key)[-1])
            only = None if several[number[-1]] else (int(key[k]), int(at[k]), int(lo[k]), int(hi[k]))
        head = (int(key[-1]), int(ctx[-1]), int(fid[-1]), int(flo[-1]))


def _pieces(batches: Iterator[pa.RecordBatch], length: int, hot_keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The bytes of open runs, hot where their keys are on the filter, and those of the stretches that runs with one and the same offset to their firsts make up, from rows (id, text, runs)."""
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            found: list[list] = [[] for _ in PIECE]
            for row, text, runs_ in zip(*(whole.column(c).slice(k, 256) for c in range(3)), strict=True):
                t, values = text.as_py() or b"", runs_.values
                key, lo, hi, is_open, fid, flo = (values.field(c).to_numpy(zero_copy_only=False) for c in range(6))
                hot = in_filter(hot_keys, key)
                at = [np.flatnonzero(is_open)]
                claim = np.flatnonzero(~is_open)
                shift = flo[claim].astype(np.int64) - lo[claim]
                by = np.lexsort((lo[claim], shift, fid[claim]))
                claim, shift = claim[by], shift[by]
                a, b, f = lo[claim], hi[claim], fid[claim].astype(np.int64)
                edge = np.ones(claim.size, dtype=bool)
                edge[1:] = (f[1:] != f[:-1]) | (shift[1:] != shift[:-1]) | (a[1:] > b[:-1] + length)
                start = np.flatnonzero(edge)
                end = np.append(start[1:], claim.size)[: start.size] - 1
                at.append(claim[start])
                for c, x in zip(found, (is_open, hot, key), strict=False):
                    c.extend(np.concatenate([x[i] for i in at]).tolist())
                n = at[0].size
                found[3].extend([row.as_py()] * (n + start.size))
                los, his = np.concatenate([lo[at[0]], a[start]]).tolist(), np.concatenate([hi[at[0]], b[end]]).tolist()
                found[4].extend(los)
                found[5].extend(his)
                found[6].extend([None] * n + f[start].tolist())
                found[7].extend([None] * n + flo[claim[start]].astype(np.int64).tolist())
                found[8].extend(t[x : y + length] for x, y in zip(los, his, strict=True))
            yield _rows(PIECE, *found)


def repeated_spans(docs: DataFrame, row: str, text: str = "text", length: int = 100) -> DataFrame:
    """(id, lo, hi): starts lo..hi of strings of ``length`` bytes in document ``id`` that also start earlier. Spans may overlap.

    Raises an error if two different texts turn out to have one hash, rather than give a wrong result.
    """
    source = docs.select(F.col(row).alias("id"), F.col(text).cast("binary").alias("text"))
    shape = {s: ", ".join(f"{f.name} {n}" for f, n in zip(s, names, strict=True)) for s, names in ((RUN, "boolean long long long int int".split()), (TOLD, "long long int int boolean long int".split()), (PIECE, "boolean boolean long long int int long int binary".split()))}
    found = source.mapInArrow(frugal(lambda b: _all_runs(b, length)), shape[RUN])
    dealt = found.repartition("key").sortWithinPartitions("again", "key", "ctx", "id", "lo")
    told = stored(dealt.mapInArrow(frugal(_told_apart), shape[TOLD]), "runs")
    plain = told.where("not open and fid is null").select("id", "lo", "hi")
    # a filter of keys is enough: those that are on it by chance are resolved by single strings as well
    many = told.where("open").groupBy("key").agg(F.count("*").alias("n")).where(f"n > {HOT}")
    hot = docs.sparkSession.sparkContext.broadcast(key_filter(many, "key", plain=True))
    by_doc = told.where("open or fid is not null").groupBy("id").agg(F.collect_list(F.struct("key", "lo", "hi", "open", F.coalesce("fid", F.lit(0)).alias("fid"), F.coalesce("flo", F.lit(0)).alias("flo"))).alias("runs"))

    def among(ids: DataFrame, column: str) -> DataFrame:
        """(id, text) of the documents named, and maybe a few others."""
        bits = docs.sparkSession.sparkContext.broadcast(key_filter(ids, column))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_filter(bits.value, batch.column(2).to_numpy()))).select([0, 1])

        return docs.select(F.col(row).alias("id"), F.col(text).cast("binary").alias("text"), F.xxhash64(F.col(row)).alias("h")).mapInArrow(frugal(pick), "id long, text binary")

    piece = among(told.where("open or fid is not null"), "id").join(by_doc, "id").select("id", "text", "runs")
    piece = stored(piece.mapInArrow(frugal(lambda b: _pieces(b, length, hot.value)), shape[PIECE]), "pieces")

    claims = piece.where("not open")
    firsts = among(claims, "fid").select(F.col("id").alias("fid"), "text")
    equal = F.substring("text", F.col("flo") + 1, F.length("piece")) == F.col("piece")
    copies = stored(claims.join(firsts, "fid").where(equal).select("id", "lo", "hi"), "copies")
    if copies.count() != claims.count():
        raise RuntimeError("two different texts have one hash: other constants in bytehash are called for")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done(rows: pa.Table) -> pa.RecordBatch:
            r, lo, hi = _repeats(rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_numpy().astype(np.int64), rows.column(3).to_numpy().astype(np.int64), rows.column(4).to_pylist(), length)
            return _rows(SPAN, r, lo, hi)

        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                held.append(part := batch.slice(k, 2000))
                size += part.column(4).nbytes
                if size >= BATCH:
                    rows = pa.Table.from_batches(held)
                    key = rows.column(0).to_numpy()
                    whole = np.flatnonzero(key != key[-1])
                    if not whole.size:
                        continue
                    yield done(rows.slice(0, cut := int(whole[-1]) + 1))
                    held = rows.slice(cut).combine_chunks().to_batches()
                    size = sum(x.column(4).nbytes for x in held)
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield done(rows)

    # a transform takes far longer than its bytes to read, so tasks are cut by bytes
    mixed_runs = piece.where("open and not hot").select("key", "id", "lo", "hi", "piece")
    tasks = max(1, -(-(mixed_runs.agg(F.sum(F.length("piece"))).first()[0] or 0) // TASK))
    dealt = mixed_runs.repartition(min(tasks, 200_000), "key").sortWithinPartitions("key")
    mixed = dealt.mapInArrow(frugal(expand), "id long, lo int, hi int")
    single = piece.where("open and hot").select("id", F.explode(F.sequence("lo", "hi")).alias("at"), "lo", "piece")
    single = single.select("id", "at", F.substring("piece", F.col("at") - F.col("lo") + 1, length).alias("s")).select("id", "at", F.unhex(F.md5("s")).alias("s"))
    first = single.groupBy("s").agg(F.min(F.struct("id", "at")).alias("first"))
    again = single.join(first, "s").where("struct(id, at) <> first").select("id", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return plain.unionByName(copies).unionByName(mixed).unionByName(again)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept binary, n_bytes, n_removed, n_spans) for each row: its text without the bytes that repeat; then the columns ``carry`` as they are.

    Texts are taken as UTF-8 bytes, null as empty, and strings never cross documents. "Earlier" means a smaller key (rows with the
    same key: the order of the text's hash; null keys first), or the same document and an earlier start; strings are
    judged on the input, not on what is left. Texts shorter than ``length`` lose nothing; an empty table gives an empty result. Other columns are ignored.
    """
    names = [key, "kept", "n_bytes", "n_removed", "n_spans", *carry]
    docs, row, _ = with_row_id(docs, text, key)
    spans = stored(repeated_spans(docs, row, text, length), "spans")
    by_doc = spans.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    wanted = docs.sparkSession.sparkContext.broadcast(key_filter(spans, "id"))
    more = [f"c{k}" for k in range(len(carry))]
    source = docs.select(F.col(row).alias("id"), F.xxhash64(F.col(row)).alias("h"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"), F.col(key).alias("k"), *[F.col(c).alias(m) for c, m in zip(carry, more, strict=True)])
    kinds = "".join(f", {m} {docs.schema[c].dataType.simpleString()}" for c, m in zip([key, *carry], ["k", *more], strict=True))

    def parted(batches: Iterator[pa.RecordBatch], inside: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = in_filter(wanted.value, batch.column(1).to_numpy())
            yield batch.filter(pa.array(on if inside else ~on))

    shape = f"id long, h long, text binary{kinds}"
    touched = source.mapInArrow(frugal(lambda b: parted(b, True)), shape).join(by_doc, "id", "left")
    none = F.lit(0).cast("long")
    whole = source.mapInArrow(frugal(lambda b: parted(b, False)), shape).select("k", "text", F.length("text").cast("long"), none, none, *more)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at.start, at.stop - at.start) for b in batches for at, _, _ in bh.blocks(b, most=PART)):
            kept, n, gone, spans = [], [], [], []
            for t, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(t, dtype=np.uint8)
                change = np.zeros(data.size + 1, dtype=np.int32)
                if s.is_valid and len(s.values):
                    s = s.values
                    np.add.at(change, s.field(0).to_numpy(), 1)
                    np.add.at(change, s.field(1).to_numpy() + length, -1)
                out = np.cumsum(change[:-1]) > 0
                kept.append(data[~out].tobytes())
                n.append(data.size)
                gone.append(int(out.sum()))
                spans.append(int((out[1:] & ~out[:-1]).sum()) + int(out[:1].sum()))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), *(batch.column(k) for k in range(2, batch.num_columns))], ["kept", "n", "gone", "spans", "k", *more])

    out = touched.select("text", "spans", "k", *more).mapInArrow(frugal(cut), f"kept binary, n long, gone long, spans long{kinds}")
    return out.select("k", "kept", "n", "gone", "spans", *more).union(whole).toDF(*names)

