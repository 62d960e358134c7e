"""Resampling by array index: shuffle nulls, bootstraps and permutations whose draws never become rows.

What is drawn from stays in arrays (the bins of a lap, the values of a group); a draw is an index into them, taken in numpy inside Arrow tasks. Only counts, deviations or means
leave a task. Draws are hashed (md5), so every engine that can hash makes the same ones.

Rows of one key stream through a task sorted by it. Keys with more than ``BIG`` rows are split: the counts of their parts are added up; samples and series over it are drawn
by joins over rows instead, in ``groups`` and ``testing``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracekit.sources.scratch import written

#: Rows of one key that one task takes, cells that are indexed at once, frames whose bins one task takes (32 MB twice over up to 255 bins, else 64 MB).
BIG, STEP, SENT = 1 << 20, 1 << 22, 1 << 24


def draws(prefix: str, ends: list[bytes]) -> np.ndarray:
    """The 32 bits that ``scalars.hashed`` takes of the prefix with each of the ends."""
    head = prefix.encode()
    return np.frombuffer(b"".join([md5(head + x).digest() for x in ends]), dtype=">u4")[::4].astype(np.int64)


#: Shifts and constants of the rounds of MD5, and hashes that are made at once (their arrays stay in a core's cache).
_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_ADDED = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_AT_ONCE = 1 << 13


def _first_words(blocks: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each row of 64 padded bytes."""
    w = np.ascontiguousarray(blocks.view("<u4").T)
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(w.shape[1], x, dtype=np.uint32) for x in start)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            at = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            at = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            at = 7 * i % 16
        f += a
        f += w[at]
        f += _ADDED[i]
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=g)
        f <<= np.uint32(_SHIFTS[i])
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += start[0]
    return a.byteswap()


def drawn(heads: list[bytes], ends: list[bytes]) -> np.ndarray:
    """``draws`` of each head (rows) with each of the ends (columns), hashed by whole arrays of messages of equal length."""
    out = np.empty((len(heads), len(ends)), dtype=np.int64)
    by_size: list[dict[int, list[int]]] = [{}, {}]
    for of, texts in zip(by_size, (heads, ends), strict=True):
        for i, x in enumerate(texts):
            of.setdefault(len(x), []).append(i)
    for h, rows in by_size[0].items():
        left = np.frombuffer(b"".join(heads[i] for i in rows), dtype=np.uint8).reshape(len(rows), h)
        for e, columns in by_size[1].items():
            if h + e > 55:  # more than one block
                for i in rows:
                    out[i, columns] = draws(heads[i].decode(), [ends[j] for j in columns])
                continue
            right = np.frombuffer(b"".join(ends[j] for j in columns), dtype=np.uint8).reshape(len(columns), e)
            wide = min(len(columns), _AT_ONCE)
            tall = max(1, _AT_ONCE // wide)
            for lo in range(0, len(rows), tall):
                for first in range(0, len(columns), wide):
                    part, own = left[lo : lo + tall], right[first : first + wide]
                    block = np.zeros((part.shape[0], own.shape[0], 64), dtype=np.uint8)
                    block[:, :, :h] = part[:, None, :]
                    block[:, :, h : h + e] = own[None, :, :]
                    block[:, :, h + e] = 0x80
                    block[:, :, 56], block[:, :, 57] = (h + e) * 8 & 255, (h + e) * 8 >> 8
                    out[np.ix_(rows[lo : lo + tall], columns[first : first + wide])] = _first_words(block.reshape(-1, 64)).reshape(block.shape[:2])
    return out


def _types(df: DataFrame, columns: list[str] | tuple[str, ...]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Slices of equal leading columns, each with its key, in the order they come; a group may come in several slices."""
    for batch in batches:
        n = batch.num_rows
        new = np.zeros(n, dtype=bool)
        for c in range(keys):
            codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), n] if n else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield tuple(batch.column(c)[a].as_py() for c in range(keys)), batch.slice(a, b - a)


def _stretches(batch: pa.RecordBatch, first: int, keys: int) -> Iterator[tuple[tuple, int, int]]:
    """(key, rows, first row) of each stretch of a batch with equal values in ``keys`` columns from ``first`` on, in the order they come; a key may go on in the next batch."""
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    for c in range(first, first + keys):
        codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    edges = [0, *np.flatnonzero(new).tolist(), n] if n else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield tuple(batch.column(c)[a].as_py() for c in range(first, first + keys)), b - a, a


def _nonzero(matrix: np.ndarray, p: float) -> list[pa.Array]:
    """(bin, numbers of the draws that reach it from 1, their counts) of a matrix of draws and bins."""
    bin_, draw = np.nonzero(matrix.T)
    edges = np.flatnonzero(np.diff(bin_, prepend=-1))
    lists = pa.array(np.append(edges, bin_.size).astype(np.int32))
    return [pa.array(bin_[edges].astype(np.int32)), pa.ListArray.from_arrays(lists, pa.array((draw + 1).astype(np.int32))), pa.ListArray.from_arrays(lists, pa.array(matrix[draw, bin_].astype(np.int32)))]


def _marks(matrix: np.ndarray, p: float) -> list[pa.Array]:
    """(bin, how many draws reach it, their counts in all and at most, the sum of number and count) of the bins that any draw reaches."""
    some = np.flatnonzero(matrix.any(axis=0))
    held = matrix[:, some].astype(np.int64)
    mark = np.arange(1, held.shape[0] + 1) @ held
    return [pa.array(x) for x in (some.astype(np.int32), (held > 0).sum(axis=0), held.sum(axis=0), held.max(axis=0, initial=0), mark)]


def _peaks(matrix: np.ndarray, p: float) -> list[pa.Array]:
    """The largest count of each draw."""
    return [pa.ListArray.from_arrays(pa.array([0, matrix.shape[0]], pa.int32()), pa.array(matrix.max(axis=1).astype(np.int32)))]


def _limits(matrix: np.ndarray, p: float) -> list[pa.Array]:
    """(bin, the count at the share ``p`` of the draws, as a line between two, sum of the counts) of the bins that any draw reaches."""
    some = np.flatnonzero(matrix.any(axis=0))
    place = p * (matrix.shape[0] - 1)
    low = int(place)
    high = min(low + 1, matrix.shape[0] - 1)
    top = np.partition(np.ascontiguousarray(matrix[:, some].T), (low, high), axis=1)
    at, above = top[:, low].astype(float), top[:, high]
    limit = at + (above - at) * (place - low)
    return [pa.array(some.astype(np.int32)), pa.array(limit), pa.array(matrix[:, some].sum(axis=0, dtype=np.int64))]


#: What is told of the counts of one curve, and its columns.
TOLD: dict[str, tuple[Callable, str]] = {
    "bins": (_nonzero, "bin int, draws array<int>, counts array<int>"),
    "marks": (_marks, "bin int, reached long, total long, most long, mark long"),
    "peaks": (_peaks, "peaks array<int>"),
    "limits": (_limits, "bin int, null_limit double, null_total long"),
}


def parts_of(df: DataFrame, work: int, least: int = 1 << 24) -> int:
    """Into how many tasks ``work`` (numbers drawn) is dealt: one for ``least`` each, as many as shuffles have by default at most.

    Rows are few and small beside the work on them, so sizes of shuffles, by which Spark joins small partitions, say nothing of it.
    """
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-work // least)))


def shuffled_counts(spikes: DataFrame, frames: DataFrame, n: int, seed: int = 7, k: tuple[str, ...] = (), told: str = "bins", p: float = 0.99, big: int = BIG, sent: int | None = None) -> DataFrame:
    """Counts by bin of spikes (k, entity, frame) over frames (k, frame, lap, bin >= 0) after the positions of each lap are rolled by a hashed offset, for each of n draws.

    ``told`` = bins: (k, entity, bin, draws, counts), the draws that reach a bin and how often each does. ``marks``: (k, entity, bin, reached, total, most, mark), how many draws reach a bin, their
    counts in all and at most, and the sum of each draw's number times its count. ``peaks``: (k, entity, peaks), the largest count of each draw. ``limits``:
    (k, entity, bin, null_limit, null_total), the count at the share ``p`` of the draws and the sum over all, for bins that any draw reaches.

    A lap's bins are one array, which each task gets once, before the places of all its entities' spikes in it; the counts of an entity are one matrix of draws and bins. Over ``sent`` frames (``SENT``) the
    laps are dealt to groups, and the counts of an entity are added up over them. Spikes of frames that are not known, and rows with a null key, are left out.
    """
    laps_of = [*k, "lap"]
    by = Window.partitionBy(*laps_of)
    placed = frames.select(*laps_of, "frame", F.col("bin").cast("int").alias("bin"), (F.row_number().over(by.orderBy("frame")) - 1).alias("i")).dropna(subset=laps_of)
    total = frames.agg(F.coalesce(F.max("bin"), F.lit(-1)).alias("top"), F.count("*").alias("n")).first()
    bins, groups = int(total.top) + 1, max(1, -(-int(total.n) // (sent or SENT)))
    entity = [*k, "entity"]
    own = spikes.join(placed.select(*laps_of, "frame", "i"), [*k, "frame"])
    # at most one row for each ``big`` spikes: bounded by the input over it
    sizes = own.groupBy(*entity).agg(F.count("*").alias("spikes"))
    hot = written(sizes.where(F.col("spikes") > big).select(*entity, F.ceil(F.col("spikes") / big).alias("parts")), "hot")
    split = hot.count() > 0
    if split:
        own = own.join(F.broadcast(hot), entity, "left").withColumn("part", F.pmod(F.xxhash64("frame", "lap"), "parts").cast("int"))
    else:
        own = own.withColumn("part", F.lit(None).cast("int"))
    in_group = F.pmod(F.xxhash64(*laps_of, F.lit(groups)), F.lit(groups)).cast("int")
    if groups > 1:
        own = own.withColumn("part", F.coalesce("part", F.lit(0)) * groups + in_group)
    name = F.concat_ws("-", *[F.col(c).cast("string") for c in laps_of])
    keys = [*entity, "part"]
    tasks = parts_of(spikes, spikes.count() * n)
    slot = F.pmod(F.xxhash64(*keys), F.lit(tasks)).cast("int") + (F.pmod("part", F.lit(groups)) * tasks if groups > 1 else F.lit(0))
    rows = own.groupBy(*keys, *(c for c in laps_of if c not in keys)).agg(F.collect_list("i").alias("at"))
    rows = rows.select(slot.alias("slot"), F.lit(1).alias("side"), *keys, name.alias("name"), F.col("at").cast("array<int>").alias("at"))
    laps = placed.groupBy(*laps_of).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "bin"))), lambda x: x["bin"]).alias("at"))
    laps = laps.select(F.explode(F.sequence(in_group * tasks, in_group * tasks + (tasks - 1))).alias("slot"), F.lit(0).alias("side"), *[F.lit(None).cast(spikes.schema[c].dataType).alias(c) for c in entity], F.lit(None).cast("int").alias("part"), name.alias("name"), "at")
    dealt = laps.union(rows).repartitionById(tasks * groups, "slot").sortWithinPartitions("slot", "side", *keys)
    width = len(keys)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
        known: dict[str, np.ndarray] = {}
        offsets: dict[str, np.ndarray] = {}
        at, counts, waiting, size = None, np.zeros(0, dtype=np.int32), [], 0
        row = np.arange(n, dtype=np.int64)[:, None] * bins

        def add() -> None:
            nonlocal counts, waiting, size
            if waiting:
                counts += np.bincount(np.concatenate(waiting), minlength=n * bins).astype(np.int32)
            waiting, size = [], 0

        for batch in batches:
            side, names, lists = batch.column(1).to_numpy(), batch.column(width + 2), batch.column(width + 3)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for key, part, first in _stretches(batch, 2, width):
                for r in range(first, first + part):
                    name, places = names[r].as_py(), values[ends[r] : ends[r + 1]]
                    if side[r] == 0:
                        known[name] = np.tile(places.astype(np.min_scalar_type(bins)), 2)
                        continue
                    if key != at:
                        if at is not None:
                            add()
                            yield at, counts.reshape(n, bins)
                        at, counts = key, np.zeros(n * bins, dtype=np.int32)
                    lap = known[name]
                    if name not in offsets:
                        if len(offsets) > 1 << 12:
                            offsets.clear()
                        offsets[name] = draws(f"{seed}-", [f"{s}-{name}".encode() for s in range(1, n + 1)])
                    back = (lap.size // 2 - offsets[name] % (lap.size // 2))[:, None]
                    each = max(1, STEP // n)
                    for lo in range(0, places.size, each):
                        waiting.append((lap[places[None, lo : lo + each] + back] + row).ravel())
                        size += waiting[-1].size
                        if size >= STEP:
                            add()
        if at is not None:
            add()
            yield at, counts.reshape(n, bins)

    shape = {h: _types(spikes, entity) + TOLD[h][1] for h in TOLD}
    schemas = {h: _arrow(spikes, shape[h]) for h in TOLD}

    def tell(how: str, keep: int, found: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for key, counts in found(batches):
                columns = TOLD[how][0](counts, p)
                heads = [pa.repeat(pa.scalar(x, schemas[how].field(c).type), len(columns[0])) for c, x in enumerate(key[:keep])]
                held.append(pa.RecordBatch.from_arrays([*heads, *(x.cast(schemas[how].field(keep + c).type) for c, x in enumerate(columns))], schema=schemas[how]))
                size += held[-1].nbytes
                if size >= STEP:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

        return run

    if not split and groups == 1:
        return dealt.mapInArrow(tell(told, len(entity), matrices), shape[told])
    # entities in one piece are told of at once, the others' pieces are added up
    if groups == 1:
        cold = dealt.where("part is null").mapInArrow(tell(told, len(entity), matrices), shape[told])
        pieces = dealt.where("part is not null or side = 0").mapInArrow(tell("bins", len(entity), matrices), shape["bins"])
    else:
        cold, pieces = None, dealt.mapInArrow(tell("bins", len(entity), matrices), shape["bins"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
        at, counts = None, None
        for batch in batches:
            for key, part, first in _stretches(batch, 0, len(entity)):
                if key != at:
                    if at is not None:
                        yield at, counts
                    at, counts = key, np.zeros((n, bins), dtype=np.int32)
                for r in range(first, first + part):
                    b, which, times = (batch.column(len(entity) + c)[r] for c in range(3))
                    counts[which.values.to_numpy() - 1, b.as_py()] += times.values.to_numpy()
        if at is not None:
            yield at, counts

    whole = pieces.repartition(tasks, *entity).sortWithinPartitions(*entity).mapInArrow(tell(told, len(entity), merged), shape[told])
    return whole if cold is None else cold.union(whole)


def _arrow(df: DataFrame, shape: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(shape))


def sampled_deviation(groups: DataFrame, k: list[str], a: object, b: object, n: int, seed: int) -> DataFrame:
    """(k, sd) of rows (k, name string, a_values, b_values, one row a key): the deviation of the difference of the means of two hashed samples with replacement, each as large as the larger group, over n draws."""
    shape = _types(groups, k) + "sd double"
    schema = _arrow(groups, shape)
    width = len(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                name = batch.column(width)[r].as_py()
                sides = [batch.column(width + 1 + s)[r].values.to_numpy(zero_copy_only=False) for s in range(2)]
                big = max(x.size for x in sides)
                mean, ends = np.zeros((2, n)), [b"%d" % j for j in range(1, big + 1)]
                for s, (values, group) in enumerate(zip(sides, (a, b), strict=True)):
                    each = max(1, STEP // big)
                    for lo in range(1, n + 1, each):
                        its = range(lo, min(n, lo + each - 1) + 1)
                        taken = values[drawn([f"{seed}-{name}{group}-{i}-".encode() for i in its], ends) % values.size]
                        with np.errstate(invalid="ignore"):
                            mean[s, lo - 1 : lo - 1 + len(its)] = np.nansum(taken, axis=1) / (~np.isnan(taken)).sum(axis=1)
                d = mean[0] - mean[1]
                d = d[~np.isnan(d)]
                out.append((*(batch.column(c)[r].as_py() for c in range(width)), float(d.std()) if d.size else None))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    return groups.mapInArrow(run, shape)


def permuted_means(series: DataFrame, k: list[str], bins: int, n: int, seed: int) -> DataFrame:
    """(k, bin, mean, _null_mean, _null_sd, _draws) of rows (k, name string, orders array<string>, values array<double>, one row a series in order): the mean of each of ``bins`` stretches, and mean and deviation of it over n hashed permutations."""
    shape = _types(series, k) + "bin int, mean double, _null_mean double, _null_sd double, _draws long"
    schema = _arrow(series, shape)
    width = len(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                name = batch.column(width)[r].as_py()
                ends = [x.encode() for x in batch.column(width + 1)[r].as_py()]
                values = batch.column(width + 2)[r].values.to_numpy(zero_copy_only=False)
                size = values.size
                step = max(size // bins, 1)
                edges = np.arange(0, min(bins, -(-size // step)) * step, step)
                count = np.add.reduceat((~np.isnan(values)).astype(float), edges)
                with np.errstate(invalid="ignore", divide="ignore"):
                    real = np.add.reduceat(np.nan_to_num(values), edges) / count
                    means = np.empty((n, edges.size))
                    each = max(1, STEP // size)
                    for lo in range(1, n + 1, each):
                        its = range(lo, min(n, lo + each - 1) + 1)
                        # a hash of 32 bits, then the place of the sample (under 2^31): both sort as one number
                        order = np.sort(drawn([f"{seed}-{name}{i}-".encode() for i in its], ends).astype(np.uint64) << np.uint64(31) | np.arange(size, dtype=np.uint64), axis=1)
                        x = values[(order & np.uint64((1 << 31) - 1)).astype(np.int64)]
                        means[lo - 1 : lo - 1 + len(its)] = np.add.reduceat(np.nan_to_num(x), edges, axis=1) / np.add.reduceat((~np.isnan(x)).astype(float), edges, axis=1)
                for b in range(edges.size):
                    m = means[:, b][~np.isnan(means[:, b])]
                    head = tuple(batch.column(c)[r].as_py() for c in range(width))
                    out.append((*head, b, None if np.isnan(real[b]) else float(real[b]), float(m.mean()) if m.size else None, float(m.std(ddof=1)) if m.size > 1 else None, n))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    return series.mapInArrow(run, shape)
