"""Content-defined chunking and containment of weighted chunk sets.

A rolling gear hash marks chunk ends from the last 32 bytes alone, so an insertion moves no ends but near it.
Chunking is normalised: below the usual size an end needs more zero bits than above it. A fingerprint is the sorted
set of (digest, length) of a text's chunks, in hex; equal texts have equal fingerprints. Containment of one
fingerprint in another is the shared chunks' length over its own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekit.llm import bytehash as bh
from tracekit.llm.shared import with_row_id

U = np.uint64
#: Sizes of a chunk in bytes; the last chunk of a text may be smaller. The least one is no smaller than the hash's reach.
LEAST, USUAL, MOST = 32, 64, 255
GEAR = (bh.mixed(np.arange(1, 257, dtype=U) * U(0x9FB21C651E98DF25)) >> U(32)).astype(np.uint32)
STRICT, LOOSE = np.uint32(0xFE000000), np.uint32(0xF8000000)


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all chunks of some texts, and the number of the first chunk of each text (one more at the end)."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = loose[(h[loose] & STRICT) == 0].tolist()
    loose = loose.tolist()
    ends = offsets.tolist()
    starts, firsts = [], [0]
    n_strict, n_loose = len(strict), len(loose)
    for d in range(len(ends) - 1):
        s, e = ends[d], ends[d + 1]
        while s < e:
            starts.append(s)
            if e - s <= LEAST:
                break
            k = bisect_left(strict, s + LEAST - 1)
            if k < n_strict and strict[k] < s + USUAL - 1:
                cut = strict[k] + 1
            else:
                k = bisect_left(loose, s + USUAL - 1)
                cut = loose[k] + 1 if k < n_loose and loose[k] < s + MOST else s + MOST
            s = cut
        firsts.append(len(starts))
    return np.array(starts, dtype=np.int64), np.array(firsts, dtype=np.int64)


def chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct chunks of each text, as digest * 256 + length."""
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 1 << 21):
            size += len(texts[hi])
            hi += 1
        data = np.frombuffer(b"".join(texts[lo:hi]), dtype=np.uint8)
        offsets = np.cumsum([0, *(len(t) for t in texts[lo:hi])])
        starts, firsts = chunk_ends(data, offsets)
        stops = np.append(starts[1:], data.size)
        code = (bh.hashes(data, starts, stops) >> U(32) << U(8)) | (stops - starts).astype(U)
        out += [np.unique(code[firsts[k] : firsts[k + 1]]) for k in range(hi - lo)]
        lo = hi
    return out


def in_hex(chunks: np.ndarray) -> str:
    return chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's length that lies in chunks of b; 1 for two empty sets, 0 for one."""
    if not a.size or not b.size:
        return float(a.size == b.size)
    common = np.intersect1d(a, b, assume_unique=True)
    return float((common & U(255)).sum()) / float((a & U(255)).sum())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of each row's whole text; null counts as empty, whose fingerprint is empty. Other columns are ignored."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([in_hex(c) for c in chunk_sets(texts)], pa.string())], ["k", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).mapInArrow(make, f"k {kind}, fingerprint string").withColumnRenamed("k", key)


def edited(own: str, following: str) -> str:
    """``own`` with its last half (rounded down) replaced by as much of the start of ``following``."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


def held_against_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The next row is that of the next smaller key (rows with one key: by the hash of the text; null keys last), after the smallest the
    largest. Rows are dealt by ranges of keys; the row that follows a range is sent to it as well, so no row needs another
    range. Null texts count as empty; near_edited and near_next are containments. Other columns are ignored.
    """
    docs, row, _ = with_row_id(docs, text, key)
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.expr(f"percentile_approx(`{row}`, array({', '.join(str(k / parts) for k in range(1, parts))}), 10000)")).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    # where the row belongs: the number of cuts that are smaller
    own = F.size(F.filter(bounds, lambda c: c < F.col("id"))) if len(cuts) <= 32 else F.expr(_search(cuts))
    source = docs.select(F.col(row).alias("id"), F.col(key).alias("k"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t")).withColumn("part", own)
    heads = [tuple(r) for r in docs.select(F.col(row).alias("id")).withColumn("part", own).groupBy("part").agg(F.max("id")).orderBy("part").collect()]
    ahead = {}
    for k, (_, top) in enumerate(heads):
        ahead[top] = heads[(k + 1) % len(heads)][0]
    if ahead:
        pairs = F.create_map(*[F.lit(x) for kv in ahead.items() for x in kv])
        source = source.withColumn("also", pairs[F.col("id")])
    else:
        source = source.withColumn("also", F.lit(None).cast("int"))
    both = source.select("id", "k", "t", F.explode(F.when(F.col("also").isNull(), F.array(F.struct(F.col("part"), F.lit(False).alias("ahead")))).otherwise(F.array(F.struct(F.col("part"), F.lit(False).alias("ahead")), F.struct(F.col("also").alias("part"), F.lit(True).alias("ahead"))))).alias("p"))
    dealt = both.select("p.part", "p.ahead", "id", "k", "t").repartition(max(1, parts // 4), "part").sortWithinPartitions("part", "ahead", F.desc("id"))
    kind = docs.schema[key].dataType.simpleString()

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row seen: part, ahead, key, text, chunks
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                rows = list(zip(*(piece.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True))
                rows = [(*r, c) for r, c in zip(rows, chunk_sets([r[3] for r in rows]), strict=True)]
                chain = [held, *rows] if held else rows
                held = chain[-1]
                todo = [(a, b) for a, b in zip(chain, chain[1:], strict=False) if not a[1] and a[0] == b[0]]
                if not todo:
                    continue
                own_text = [a[3].decode("utf-8", "replace") for a, _ in todo]
                new = [edited(t, b[3].decode("utf-8", "replace")).encode() for t, (_, b) in zip(own_text, todo, strict=True)]
                new_sets = chunk_sets(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[2] for a, _ in todo], batch.schema.field(3).type),
                        pa.array([len(t) for t in own_text], pa.int64()),
                        pa.array([hashlib.sha256(e).hexdigest() for e in new], pa.string()),
                        pa.array([in_hex(a[4]) for a, _ in todo], pa.string()),
                        pa.array([in_hex(c) for c in new_sets], pa.string()),
                        pa.array([containment(a[4], c) for (a, _), c in zip(todo, new_sets, strict=True)], pa.float64()),
                        pa.array([containment(a[4], b[4]) for a, b in todo], pa.float64()),
                    ],
                    ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return dealt.mapInArrow(hold, f"k {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("k", key)


def _search(cuts: list[int]) -> str:
    """SQL for the number of cuts below id, by halving."""
    if not cuts:
        return "0"

    def over(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if(id > {cuts[mid]}L, {over(mid + 1, hi)}, {over(lo, mid)})"

    return over(0, len(cuts))
