"""MinHash near-duplicates with tensored banding.

Two small collections of half keys are computed for each document, each half of ``half`` minhashes.
The table keys are all combinations of one half of each collection: ``side * side`` tables from
``2 * side * half`` minhashes, about the square root of what separate bands would need. Two documents
meet in a table if they share a half in both collections; with the defaults a pair at similarity 0.8 is
missed with a chance of 2e-4, one at 0.85 with 8e-6, and a component only suffers if no other link joins its parts.

Candidates are confirmed on the full shingle sets. Only links that can join two components are
looked at, and no bucket is expanded into all its pairs. First, members are held against one pivot of their buckets, a member that meets
the most others. After that, only members outside a bucket's largest component can still bring links between components. They
are held in blocks, on full sets, against all members of the buckets with the same largest component, so no link is left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekit.llm import bytehash as bh
from tracekit.llm.shared import components, frugal, in_filter, key_filter, stored, with_row_id

U = np.uint64
#: Table keys that one task makes, so that counting them stays within its memory.
KEYS_A_TASK = 1_000_000


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of a batch."""
    for rows, data, offsets in bh.blocks(batch):
        begins, stops, firsts = bh.words(data, offsets, bh.SOLID)
        s, at = bh.pairs(bh.hashes(data, begins, stops, bh.FOLDED), firsts, width)
        for k in range(rows.stop - rows.start):
            yield rows.start + k, np.unique(s[at[k] : at[k + 1]])


def _full(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, width: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """(id, s): the full sets of those of rows (id, text, h) that are on the filter, in batches of about ``most`` hashes."""
    for batch in batches:
        batch = batch.filter(pa.array(in_filter(wanted, batch.column(2).to_numpy())))
        ids, first, sets, held = batch.column(0), 0, [], 0
        for k, s in _sets(batch, width):
            sets.append(s.view(np.int64))
            held += s.size
            if held >= most or k == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(sets)), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])
                first, sets, held = k + 1, [], 0


def signatures(docs: DataFrame, row: str, text: str = "text", width: int = 2, side: int = 13, half: int = 3) -> DataFrame:
    """(id, n_shingles, digest, minhashes): a digest of each document's set and its ``2 * side * half`` minhashes; no set, no digest."""
    factors = bh.mixed(np.arange(7, 7 + 2 * side * half, dtype=U) * U(0xA24BAED4963EE407)) | U(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, low = [], [], []
            for _, s in _sets(batch, width):
                n.append(s.size)
                if not s.size:
                    digest.append(None)
                    low.append(None)
                    continue
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                best = np.full(factors.size, (1 << 64) - 1, dtype=U)
                for k in range(0, s.size, 4096):
                    np.minimum(best, (s[k : k + 4096, None] * factors).min(axis=0), out=best)
                low.append((best >> U(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(low, pa.list_(pa.int32()))], ["id", "n_shingles", "digest", "minhashes"])

    return docs.select(F.col(row).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(frugal(sign), "id long, n_shingles long, digest binary, minhashes array<int>")


def table_keys(signed: DataFrame, side: int = 13, half: int = 3) -> DataFrame:
    """(key, id): all combinations of a half key of the first collection with one of the second."""
    halves = F.transform(F.sequence(F.lit(0), F.lit(2 * side - 1)), lambda i: F.xxhash64(i, *[F.element_at("minhashes", (i * half + k + 1).cast("int")) for k in range(half)]))
    cut = signed.select("id", F.slice(halves, 1, side).alias("x"), F.slice(halves, side + 1, side).alias("y"))
    one = cut.select("id", F.explode("x").alias("x"), "y")
    return one.select("id", "x", F.explode("y").alias("y")).select(F.xxhash64("x", "y").alias("key"), "id")


def _alike(likely: DataFrame, signed: DataFrame, percent: int, least: float) -> DataFrame:
    """(a, b, same) of the pairs whose sizes allow the similarity and whose minhashes don't speak clearly against it (more than four deviations); same is the share of equal minhashes."""
    s = signed.select("id", "n_shingles", "minhashes")
    both = likely.join(s.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("minhashes").alias("ma")), "a")
    both = both.join(s.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("minhashes").alias("mb")), "b")
    both = both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    same = F.aggregate(F.zip_with("ma", "mb", lambda p, q: (p == q).cast("int")), F.lit(0), lambda t, x: t + x) / F.size("ma")
    return both.select("a", "b", same.alias("same")).where(F.col("same") >= least)


def confirmed(likely: DataFrame, docs: DataFrame, row: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``likely`` with 100 * intersection >= percent * union of their full sets."""
    ids = likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(key_filter(ids, "id"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _full(batches, wanted.value, width)

    sets = docs.select(F.col(row).alias("id"), F.col(text).cast("binary").alias("text"), F.xxhash64(F.col(row)).alias("h")).mapInArrow(frugal(full), "id long, s array<long>")
    both = likely.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).cast("long").alias("n")).where(f"100 * c >= {percent} * (n - c)").select("a", "b")


def _blocks_of(placed: DataFrame, percent: int, block: tuple[int, int]) -> DataFrame:
    """(id, component, cluster, band, i, j, side): the blocks that each member goes to, as one held (side 0) or read (side 1).

    Sizes that can be alike lie in one band or in neighbouring ones, so a block holds outside members of one band and reads members of three.
    """
    band = F.floor(F.log("n") / F.lit(math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9)).cast("long")
    placed = placed.withColumn("band", band)
    near = placed.withColumn("band", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
    held = placed.where("outside").groupBy("cluster", "band").agg(F.ceil(F.count("*") / block[0]).cast("int").alias("rows"))
    sizes = near.groupBy("cluster", "band").agg(F.ceil(F.count("*") / block[1]).cast("int").alias("cols")).join(held, ["cluster", "band"])
    at = F.xxhash64("id")
    columns = ["id", "component", "cluster", "band"]
    hold = placed.where("outside").join(sizes, ["cluster", "band"]).select(*columns, F.pmod(at, "rows").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), F.lit(0).alias("side"))
    read = near.join(sizes, ["cluster", "band"]).select(*columns, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(at, "cols").cast("int").alias("j"), F.lit(1).alias("side"))
    return hold.union(read)


def links_across(placed: DataFrame, docs: DataFrame, row: str, text: str, width: int, percent: int, block: tuple[int, int] = (400, 1600)) -> DataFrame:
    """(a, b): of each cluster in ``placed`` (id, n, cluster, component, outside), links between an outside member and a member of another component, one for each such component at least.

    All outside members are held against all members of their cluster whose sizes allow it, on full sets, block by block; a task holds one block of outside
    members and reads the other members one at a time. Sets that are alike enough share one of the first shingles, in the order of their hashes, so a member is compared
    in full only with a block in which some set shares one with it (a prefix filter, which leaves nothing out). Only links leave a task, no candidates.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(key_filter(placed.select("id").distinct(), "id"))
    source = docs.select(F.col(row).alias("id"), F.col(text).cast("binary").alias("text"), F.xxhash64(F.col(row)).alias("h"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _full(batches, wanted.value, width):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.values.to_numpy().tobytes() for s in part.column(1)], pa.binary())], ["id", "s"])

    dealt = source.mapInArrow(frugal(full), "id long, s binary").join(_blocks_of(placed, percent, block), "id")
    dealt = dealt.select("cluster", "band", "i", "j", "side", "id", "component", "s").repartition("cluster", "band", "i", "j").sortWithinPartitions("cluster", "band", "i", "j", "side")

    def first(s: np.ndarray) -> np.ndarray:
        return s[: s.size - (-(-percent * s.size // 100)) + 1]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, parts, sets, seen = None, [], [], [], set()
        token = owner = n = where = heads = None
        for batch in batches:
            a, b = [], []
            cluster, band, i, j, side, who, part, raw = (batch.column(k).to_pylist() for k in range(8))
            for k in range(batch.num_rows):
                s = np.frombuffer(raw[k], dtype=U)
                if (cluster[k], band[k], i[k], j[k]) != at:
                    at, ids, parts, sets, seen, token = (cluster[k], band[k], i[k], j[k]), [], [], [], set(), None
                if side[k] == 0:
                    ids.append(who[k])
                    parts.append(part[k])
                    sets.append(s)
                    continue
                if not ids:
                    continue
                if token is None:
                    n = np.array([x.size for x in sets])
                    token, owner = np.concatenate(sets), np.repeat(np.arange(n.size), n)
                    by = np.argsort(token)
                    token, owner, where = token[by], owner[by], np.array(parts)
                    heads = np.unique(np.concatenate([first(x) for x in sets]))
                f = first(s)
                if not (heads[np.minimum(np.searchsorted(heads, f), heads.size - 1)] == f).any():
                    continue
                lo, hi = np.searchsorted(token, s), np.searchsorted(token, s, side="right")
                c = hi - lo
                common = np.bincount(owner[np.repeat(lo - np.cumsum(c) + c, c) + np.arange(int(c.sum()))], minlength=n.size)
                for x in np.flatnonzero((100 * common >= percent * (n + s.size - common)) & (where != part[k])).tolist():
                    if (x, part[k]) not in seen:
                        seen.add((x, part[k]))
                        a.append(min(ids[x], who[k]))
                        b.append(max(ids[x], who[k]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(frugal(compare), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80, side: int = 13, half: int = 3, least: float = 0.6) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``.

    A document's set holds its distinct ``width``-word shingles (words ``[^ \\t-\\r]+``, A-Z as a-z; with fewer
    words, the whole sequence). Documents with 100 * intersection >= percent * union are linked;
    component_id is the smallest key reachable. Documents without words, or with null text, are linked with
    nothing. Equal texts share a component; of rows with the same key one is kept (ordered by text
    hash); null keys order before all others, and a component that begins with such a row has a null component_id. Empty tables give empty results. Other columns are ignored.
    """
    docs, row, unique = with_row_id(docs, text, key)
    signed = stored(signatures(docs, row, text, width, side, half), "signed")
    firsts = signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("minhashes").alias("minhashes"))
    firsts = stored(firsts, "sets")
    distinct = firsts.select(F.col("first").alias("id"), "n_shingles", "minhashes")
    # a set makes side * side keys: tasks are cut by keys, as splits by bytes would be far too large
    tasks = min(20_000, max(1, -(-signed.count() * side * side // KEYS_A_TASK)))
    keys = table_keys(distinct.select("id", "minhashes").repartition(tasks, "id"), side, half)
    shared = keys.groupBy("key").agg(F.count("*").alias("meets")).where("meets > 1")
    members = stored(keys.join(shared, "key"), "members")
    degree = members.groupBy("id").agg(F.sum("meets").alias("degree"))
    size = distinct.select("id", F.col("n_shingles").alias("n"))
    members = stored(members.select("key", "id").join(degree.join(size, "id"), "id"), "members")

    # each member and the pivot of its bucket; of a member's pivots the one that looks most alike is tried
    pivot = members.groupBy("key").agg(F.max_by(F.struct(F.col("id").alias("a"), F.col("n").alias("na")), F.struct("degree", -F.col("id"))).alias("p")).select("key", "p.*")
    likely = members.join(pivot, "key").where(f"a <> id and 100 * least(n, na) >= {percent} * greatest(n, na)").select("a", F.col("id").alias("b")).distinct()
    best = _alike(likely, distinct, percent, least).groupBy("b").agg(F.max_by("a", F.struct("same", -F.col("a"))).alias("a"))
    best = stored(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star")
    links = stored(confirmed(best, docs, row, text, width, percent), "linked")
    part = stored(components(distinct.select("id"), links), "parts")

    # buckets of several components; those with one largest component are a cluster, in which all members that are outside of it are held against all
    placed = members.join(part, "id")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    parts = parts.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("cluster"), F.count("*").alias("parts")).where("parts > 1")
    inside = placed.join(parts.select("key", "cluster"), "key").select("cluster", "id", "n", "component", (F.col("component") != F.col("cluster")).alias("outside")).distinct()
    across = stored(links_across(stored(inside, "inside"), docs, row, text, width, percent), "across")
    if not across.isEmpty():
        part = components(distinct.select("id"), links.union(across))

    by_set = firsts.select("digest", F.col("first").alias("id")).join(part, "id").select("digest", "component")
    out = signed.select("id", "n_shingles", "digest").join(by_set, "digest", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
    if unique:
        return out.select(F.col("id").alias(key), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    names = docs.select(F.col(row).alias("id"), F.col(key).alias("k"))
    out = out.join(names, "id").join(names.select(F.col("id").alias("component"), F.col("k").alias("c")), "component")
    return out.select(F.col("k").alias(key), "n_shingles", F.col("c").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
