"""Tables in the shared folder, row keys and bounded key filters."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, as in tests, one of our own if all runs on this machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("tracekit.scratch", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="tracekit-")
            spark.conf.set("tracekit.scratch", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives lost executors. ``group``: bytes of a row group, for rows that are large."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    if group:  # sizes are checked after so many rows only: as few as rows may be large
        out = out.option("parquet.block.size", group).option("parquet.page.size.row.check.min", 16)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, which gives the memory that it no longer holds back to the system at the end of its task: workers wait for their next task with what their allocators keep."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's, where it has one
        if trim:
            trim(0)

    return task


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """``df``, written to the shared folder, with the place of each row in the order as a long column ``out``: a range sort over all rows, each partition numbered by itself."""
    # the number of a row within its partition stands in the low 33 bits
    rows = stored(df.orderBy(*order).withColumn(out, F.monotonically_increasing_id()), "rows")
    part, first, shift = spare(rows, "row_part"), 0, []
    for r in rows.groupBy(F.shiftright(out, 33).alias(part)).agg(F.count("*").alias("n")).orderBy(part).collect():  # a row a partition
        shift += [F.lit(int(r[0])), F.lit(first)]
        first += r[1]
    if not shift:
        return rows
    return rows.withColumn(out, F.create_map(*shift)[F.shiftright(out, 33)] + F.col(out).bitwiseAND((1 << 33) - 1))


def with_row_id(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, str, bool]:
    """``docs`` with a long column that tells rows apart and orders them by key; that column's name; whether it is the key itself.

    The key serves where it is an integer, unique and never null. Otherwise rows are numbered in the order
    of (key, hash of the text), null keys first.
    """
    row = spare(docs, "row_id")
    if docs.schema[key].dataType.typeName() in ("long", "integer", "short", "byte"):
        twice = docs.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull())
        if twice.isEmpty():
            return docs.withColumn(row, F.col(key).cast("long")), row, True
    digest = spare(docs, "row_digest")
    return numbered(docs.withColumn(digest, F.xxhash64(F.col(text))), [F.col(key).asc_nulls_first(), digest], row).drop(digest), row, False


def bits_for(keys: int, most: int = 1 << 30) -> int:
    """Bits of a key filter: 16 a key, a power of two, never over ``most`` (128 MB)."""
    return min(most, max(1 << 16, 1 << (16 * max(1, keys) - 1).bit_length()))


#: Bits of one page of a key filter.
PAGE = 1 << 19


def key_filter(keys: DataFrame, column: str, most: int = 1 << 30, plain: bool = False) -> np.ndarray:
    """A bitmap of bounded size over the hashes of long keys, or over the keys themselves if they are hashes (``plain``).

    A key outside it is certainly not in ``keys``; one inside may be. It keeps rows that cannot match
    out of a shuffle; an exact join must follow. Pages of it are made on executors: the driver gets at most ``most / PAGE`` rows of 64 KB.
    """
    bits = bits_for(keys.count(), most)
    size = min(PAGE, bits)
    slot = keys.select(F.expr(f"pmod({column if plain else f'xxhash64({column})'}, {bits})").alias("s")).distinct()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, page = -1, np.zeros(0, dtype=np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(page, bitorder="little").tobytes()])], ["page", "bits"])

        for batch in batches:
            pages, slots = (batch.column(k).to_numpy() for k in range(2))
            edges = np.flatnonzero(np.diff(pages)) + 1
            for a, b in zip([0, *edges], [*edges, pages.size], strict=True):
                if a == b:
                    continue
                if pages[a] != at:
                    if at >= 0:
                        yield done()
                    at, page = int(pages[a]), np.zeros(size, dtype=np.uint8)
                page[slots[a:b] % size] = 1
        if at >= 0:
            yield done()

    dealt = slot.select(F.expr(f"s div {size}").alias("page"), "s").repartition("page").sortWithinPartitions("page")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for page, made in dealt.mapInArrow(frugal(make), "page long, bits binary").collect():
        out[page * size // 8 : (page + 1) * size // 8] = np.frombuffer(made, dtype=np.uint8)
    return out.view(np.int64)


def in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes fall on set bits: keys' ``xxhash64`` values, or the keys of a plain filter."""
    s = np.mod(hashes, words.size * 64)
    return (words[s >> 6] >> (s & 63)) & 1 == 1


def without(rows: DataFrame, column: str, removed: DataFrame, most: int = 1 << 26) -> DataFrame:
    """``rows`` whose long ``column`` is not in ``removed`` (id).

    A bitmap over the removed ids, of bounded size (8 MB, 4 million ids at full sharpness), is broadcast as a table of words: rows off its bits stay where
    they are, and only the others are shuffled for an exact anti join.
    """
    bits = bits_for(removed.count(), most)
    word, mask, slot = spare(rows, "filter_word"), spare(rows, "filter_mask"), spare(rows, "filter_slot")
    s = removed.select(F.expr(f"pmod(xxhash64(id), {bits})").alias("s"))
    words = s.groupBy(F.expr("s div 64").alias(word)).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias(mask))
    marked = rows.withColumn(slot, F.pmod(F.xxhash64(column), F.lit(bits))).withColumn(word, F.expr(f"`{slot}` div 64")).join(F.broadcast(words), word, "left")
    on = F.coalesce(F.expr(f"shiftright(`{mask}`, cast(`{slot}` % 64 as int)) & 1L = 1L"), F.lit(False))
    gone = removed.select(F.col("id").alias(word))
    clear, maybe = marked.where(~on).select(*rows.columns), marked.where(on).select(*rows.columns)
    return clear.union(maybe.join(gone, maybe[column] == gone[word], "left_anti"))


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(id, component): the smallest id that each node reaches over ``links`` (a, b).

    Rounds of large-star and small-star, each a pair of aggregations over the links, so a
    long chain ends after about log(length) rounds; nothing is gathered on the driver. It ends on stars: each node hangs on one
    other at most, and none that hangs on another has any hanging on itself.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "links")
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up = 1 and down > 0").isEmpty():
            break
    else:
        raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    return nodes.join(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")), "id", "left").select("id", F.coalesce("m", "id").alias("component"))
