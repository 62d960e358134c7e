"""Spectra: of similarity graphs (leading eigenvectors over edge tables) and of series (fast Fourier transforms)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekit.operators.resampling import _arrow, _types
from tracekit.sources.scratch import written


#: Rounds at most, vectors beside those asked for, how little values move at the end, and the seed of the start.
ROUNDS, EXTRA, CLOSE, SEED = 60, 4, 1e-7, 19


def _starts(width: int, seed: int, name: str) -> Column:
    """A block to begin with: the first leading vector, which is known (roots of degrees ``d``), and numbers drawn by node."""
    start = lambda c: F.pmod(F.xxhash64(F.lit(seed + c), name), F.lit(1 << 30)) / float(1 << 30) - 0.5
    return F.array(F.sqrt("d"), *[start(c) for c in range(width - 1)])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _summed(block: DataFrame, tell: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of the small matrices that ``tell`` makes of the batches of a table: a task adds up its own."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            if b.num_rows:
                out = tell(b) if out is None else out + tell(b)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), _lists(out)], ["i", "x"])

    parts = block.mapInArrow(add, "i long, x array<double>").select("i", F.posexplode("x").alias("c", "v")).groupBy("i", "c").agg(F.sum("v").alias("v")).collect()  # a row an entry
    out = np.zeros((max((r.i for r in parts), default=0) + 1, max((r.c for r in parts), default=0) + 1))
    for r in parts:
        out[r.i, r.c] = r.v
    return out


def _iterated(block: DataFrame, n: int, width: int, rounds: int, close: float, step: Callable[[DataFrame, int], DataFrame]) -> tuple[DataFrame, np.ndarray]:
    """(.., x array) with entries in the n leading eigenvectors, and their values: ``step`` (block, width) gives the block with ``y``, its x gone once through the graph, by node.

    A block is made orthogonal by its products, of which the driver sees its width squared. Half of the unit is mixed in, so that no negative value leads.
    """
    spark = block.sparkSession
    kept = [c for c in block.columns if c != "x"]
    values, turn = np.zeros(n), np.eye(width)
    for _ in range(rounds):
        gram = _summed(block, lambda b: _matrix(b.column("x")).T @ _matrix(b.column("x")))
        size, basis = np.linalg.eigh(gram)
        good = size > size.max() * 1e-12
        turn = basis[:, good] / np.sqrt(size[good])
        flat = spark.sparkContext.broadcast(turn)
        width = turn.shape[1]
        through = step(_turned(block, flat), width)
        moved = written(through.select(*kept, "x", F.array(*[(F.col("x")[c] + F.col("y")[c]) / 2 for c in range(width)]).alias("y")), "moved")
        # values in the span of the block (Rayleigh and Ritz)
        small = _summed(moved, lambda b: _matrix(b.column("x")).T @ _matrix(b.column("y")))
        found, axes = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-found)
        now = 2 * found[order][:n] - 1
        turn = axes[:, order]
        flat = spark.sparkContext.broadcast(turn)
        if now.size == values.size and np.abs(now - values).max() < close:
            return _turned(moved.select(*kept, "x"), flat).select(*kept, F.slice("x", 1, n).alias("x")), now
        values = now
        block = written(_turned(moved.select(*kept, F.col("y").alias("x")), flat), "block")
    return _turned(moved.select(*kept, "x"), flat).select(*kept, F.slice("x", 1, n).alias("x")), values


def eigenvectors(pairs: DataFrame, n: int, rounds: int = ROUNDS, extra: int = EXTRA, close: float = CLOSE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(id, x array) with each node's entries in the n leading eigenvectors of the normalised similarity D^-1/2 W D^-1/2 of pairs (a, b, similarity > 0, a <> b, each once), and their values; those of the normalised Laplacian are one less them.

    A block of n + ``extra`` vectors goes through the graph a round: a join with the edges and sums by node. It ends when the values move by less than ``close``. Where similarities are
    cosines of vectors, ``cosine_eigenvectors`` needs no pairs.
    """
    both = pairs.where("similarity > 0 and a <> b").select("a", "b", "similarity")
    both = both.union(both.select("b", "a", "similarity"))
    degree = both.groupBy("a").agg(F.sum("similarity").alias("d"))
    scaled = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
    edges = written(scaled.select("a", "b", (F.col("similarity") / F.sqrt(F.col("d") * F.col("e"))).alias("w")), "edges")
    block = written(degree.select(F.col("a").alias("id"), _starts(n + extra, seed, "a").alias("x")), "block")

    def step(unit: DataFrame, width: int) -> DataFrame:
        sums = edges.join(unit, edges.b == unit.id).groupBy("a").agg(F.array(*[F.sum(F.col("w") * F.col("x")[c]) for c in range(width)]).alias("y"))
        return unit.join(sums, unit.id == sums.a)

    return _iterated(block, n, n + extra, rounds, close, step)


def cosine_eigenvectors(vectors: DataFrame, name: str, vector: str, lowest: float, highest: float, n: int, rounds: int = ROUNDS, extra: int = EXTRA, close: float = CLOSE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """What ``eigenvectors`` gives for the scaled similarity of all pairs of vectors (``models.scaled_similarity`` of their cosines, of which ``lowest`` and ``highest`` are the ends), without a pair.

    A similarity is p + q * cosine, so what a block becomes in the graph follows from its sums and its products with the vectors at unit length: a table of one row a
    dimension, which a round adds up over all vectors and which goes to the driver. Work, memory and disk grow with the vectors. Vectors of zeros are left out, and so is one that is unlike all others.
    """
    spark = vectors.sparkSession
    q = 0.5 if lowest < 0 else 1.0
    p = 1 - q
    top = max(p + q * highest, 1.0)
    p, q = p / top, q / top
    raw = vectors.select(F.col(name).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("u"))
    size = F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x))
    rows = written(raw.withColumn("_s", size).where("_s > 0").select("id", F.transform("u", lambda x: x / F.col("_s")).alias("u")), "unit")
    kind = rows.schema["id"].dataType.simpleString()

    def through_of(b: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
        return np.vstack([x.sum(axis=0), _matrix(b.column("u")).T @ x])

    first = spark.sparkContext.broadcast(_summed(rows, lambda b: through_of(b, np.ones((b.num_rows, 1)))))

    def degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                # a vector is like itself by p + q, which is no pair
                d = p * first.value[0, 0] + q * (_matrix(b.column("u")) @ first.value[1:, 0]) - (p + q)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("u"), pa.array(d)], ["id", "u", "d"])

    known = rows.mapInArrow(degrees, f"id {kind}, u array<double>, d double").where("d > 1e-12")
    known = written(known, "degrees")

    def parts(b: pa.RecordBatch) -> np.ndarray:
        u = _matrix(b.column("u"))
        return np.hstack([np.full((len(u), 1), np.sqrt(p)), np.sqrt(q) * u]) / np.sqrt(b.column("d").to_numpy())[:, None]

    # but for what a node is like itself, the graph is the product of these parts: its leading vectors are a start from which few rounds are left
    size, axes = np.linalg.eigh(_summed(known, lambda b: parts(b).T @ parts(b)))
    good = [c for c in np.argsort(-size)[: n + extra] if size[c] > size.max() * 1e-12]
    near = spark.sparkContext.broadcast(axes[:, good])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.hstack([parts(b) @ near.value, _matrix(b.column("x"))[:, : n + extra - len(good)]])
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("u"), b.column("d"), _lists(x)], b.schema.names)

    drawn = known.withColumn("x", _starts(n + extra + 1, seed, "id")).withColumn("x", F.slice("x", 2, n + extra))
    block = written(drawn.mapInArrow(begin, f"id {kind}, u array<double>, d double, x array<double>"), "block")

    def step(unit: DataFrame, width: int) -> DataFrame:
        sums = spark.sparkContext.broadcast(_summed(unit, lambda b: through_of(b, _matrix(b.column("x")) / np.sqrt(b.column("d").to_numpy())[:, None])))

        def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x, root = _matrix(b.column("x")), np.sqrt(b.column("d").to_numpy())[:, None]
                    y = (p * sums.value[0] + q * (_matrix(b.column("u")) @ sums.value[1:]) - (p + q) * x / root) / root
                    yield pa.RecordBatch.from_arrays([*b.columns, _lists(y)], [*b.schema.names, "y"])

        return unit.mapInArrow(through, f"id {kind}, u array<double>, d double, x array<double>, y array<double>")

    found, values = _iterated(block, n, n + extra, rounds, close, step)
    return found.select("id", "x"), values


def _turned(block: DataFrame, turn) -> DataFrame:
    """block (.., x) with each x times a matrix."""
    at = block.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _lists(_matrix(b.column(at)) @ turn.value)
                yield pa.RecordBatch.from_arrays([x if c == at else b.column(c) for c in range(b.num_columns)], b.schema.names)

    return block.mapInArrow(run, ", ".join(f"{c} {block.schema[c].dataType.simpleString()}" for c in block.columns))


def clusters(pairs: DataFrame, n: int, seed: int = 42, **options: int) -> DataFrame:
    """(id, cluster): k-means on the rows, at unit length, of the n leading eigenvectors of the normalised similarity of pairs (a, b, similarity). Nodes without similar ones are left out."""
    return _grouped(eigenvectors(pairs, n, **options)[0], n, seed)


def cosine_clusters(vectors: DataFrame, name: str, vector: str, lowest: float, highest: float, n: int, seed: int = 42, **options: int) -> DataFrame:
    """``clusters`` of the scaled similarity of all pairs of vectors, without a pair."""
    return _grouped(cosine_eigenvectors(vectors, name, vector, lowest, highest, n, **options)[0], n, seed)


def _grouped(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x))
    rows = written(vectors.select("id", array_to_vector(F.transform("x", lambda x: F.when(size > 0, x / size).otherwise(0.0))).alias("features")), "rows")
    return KMeans(k=n, seed=seed, initSteps=5).fit(rows).transform(rows).select("id", F.col("prediction").alias("cluster"))


def series_spectrum(x: np.ndarray, fs: float, split: float, length: int) -> tuple[float, float | None]:
    """The dominant frequency of a whole series, and the power below ``split`` over that above in decibels from half overlapping Hann windows."""
    n = x.size
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    power = power[1 : n // 2 + 1] if n > 1 else np.zeros(1)
    dominant = (int(np.argmax(np.round(power, 6))) + 1) * fs / n
    size = min(n, length)
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[:: max(size // 2, 1)]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    total = np.zeros(size // 2 + 1)
    for lo in range(0, len(parts), 1024):  # windows overlap, so few of them are held at once
        some = parts[lo : lo + 1024]
        total += (np.abs(np.fft.rfft((some - some.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2).sum(axis=0)
    total /= len(parts)
    total[1:] *= np.where(np.arange(1, total.size) * 2 == size, 1.0, 2.0)
    below = np.arange(total.size) * fs / size <= split
    low, high = total[below].sum(), total[~below].sum()
    return dominant, float(10 * np.log10(low / high)) if low > 0 and high > 0 else None


def spectral_features(traces: DataFrame, k: list[str], o: str, v: str, fs: float, split: float, length: int = 256) -> DataFrame:
    """(k, dominant, snr): the frequency over 0 with the largest amplitude of the whole series, the mean removed (the lowest of equal ones), and the power below ``split`` over that above, in decibels, from half overlapping Hann windows of ``length`` samples (the whole series if shorter).

    A series is one array and goes through fast transforms; nulls count as its mean.
    """
    each = F.sort_array(F.collect_list(F.struct(F.col(o).alias("o"), F.col(v).cast("double").alias("v"))))
    series = traces.groupBy(*k).agg(F.transform(each, lambda x: x["v"]).alias("_s"))
    shape = _types(series, k) + "dominant double, snr double"
    schema = _arrow(series, shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                x = b.column(len(k))[r].values.to_numpy(zero_copy_only=False)
                if np.isnan(x).any():
                    x = np.where(np.isnan(x), np.nanmean(x) if not np.isnan(x).all() else 0.0, x)
                out.append((*(b.column(c)[r].as_py() for c in range(len(k))), *series_spectrum(x, fs, split, length)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    return series.mapInArrow(run, shape)
