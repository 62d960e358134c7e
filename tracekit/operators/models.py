"""Similarity, clusters, features and decoders. Vectors are array columns; models are trained by Spark's library."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracekit.functions.scalars import hashed
from tracekit.operators import kernels, networks

# --- similarity


def cosine_pairs(vectors: DataFrame, name: str, vector: str, least: float | None = None, size: int = 1000, both: bool = False) -> DataFrame:
    """(a, b, cosine) of all pairs a < b, or of those that reach ``least``: blocks of vectors are multiplied as matrices. With ``both`` each pair comes as (b, a) too.

    Without ``least`` the result is quadratic by its nature. Each vector goes to as many tasks as there are blocks; vectors of zeros have no similarity. Names are whole numbers, once each.
    Without it rows leave in an order that files of columns hold in few bytes: one name beside a run of others, the same run for the next name.
    """

    def pairs(ia: np.ndarray, ib: np.ndarray, cosine: np.ndarray, good: np.ndarray) -> pa.RecordBatch:
        if least is not None:  # few rows, in any order
            at, to = np.nonzero(good & (cosine >= least))
            x, y = np.minimum(ia[at], ib[to]), np.maximum(ia[at], ib[to])
            found = [(x, y, cosine[at, to]), (y, x, cosine[at, to])][: 1 + both]
        else:
            found = []
            for p, q in ((slice(p, p + RUN), slice(q, q + RUN)) for p in range(0, ia.size, RUN) for q in range(0, ib.size, RUN)):
                less = ia[p, None] < ib[None, q]
                found.append(_runs(ia[p], ib[q], cosine[p, q], good[p, q] & less, both))
                found.append(_runs(ib[q], ia[p], cosine[p, q].T, (good[p, q] & ~less).T, both))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b", "cosine"])

    shape = "a long, b long, cosine double"
    return _tiles(vectors, name, vector, size, pairs, shape) if least is not None else _tiles(vectors, name, vector, size, pairs, shape, FULL, _dense_first)


def _runs(x: np.ndarray, y: np.ndarray, cosine: np.ndarray, good: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, names and cosines of the pairs that are good: all of the first x, then all of the next. With ``both`` those of an x are followed by the same the other way round, as equal bytes that are near take no place."""
    at, to = np.nonzero(good)
    a, b, c = x[at], y[to], cosine[at, to]
    if not both:
        return a, b, c
    n = np.bincount(at, minlength=x.size)
    here = np.arange(at.size) + (np.cumsum(n) - n)[at]
    out = np.empty(2 * at.size, x.dtype), np.empty(2 * at.size, x.dtype), np.empty(2 * at.size)
    for place, told in ((here, (a, b, c)), (here + n[at], (b, a, c))):
        for column, values in zip(out, told, strict=True):
            column[place] = values
    return out


def _dense_first(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The first ``LEAD`` rows by cosine, from where most are close together: Parquet keeps to a dictionary of values only if these repeat in the first page of a file; without, a value takes 8 bytes."""
    cosine = batch.column("cosine").to_numpy()[:LEAD]
    order = np.argsort(cosine, kind="stable")
    if cosine.size > PAGE:
        dense = cosine[order]
        order = np.roll(order, -int(np.argmin(dense[PAGE:] - dense[:-PAGE])))
    return batch.take(pa.array(np.append(order, np.arange(order.size, batch.num_rows))))


def cosine_bounds(vectors: DataFrame, name: str, vector: str, size: int = 1000, beside: bool = False) -> DataFrame:
    """One row (_lo, _hi): the smallest and the largest cosine of all pairs, of which none leaves its task. ``beside`` all pairs of ``cosine_pairs`` vectors are dealt as there, and once for both."""

    def bounds(ia: np.ndarray, ib: np.ndarray, cosine: np.ndarray, good: np.ndarray) -> pa.RecordBatch:
        some = cosine[good]
        return pa.RecordBatch.from_arrays([pa.array([some.min()] if some.size else [], pa.float64()), pa.array([some.max()] if some.size else [], pa.float64())], ["lo", "hi"])

    return _tiles(vectors, name, vector, size, bounds, "lo double, hi double", FULL if beside else TALL).agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))


#: Blocks that vectors are cut into at most while a block has no more than ``TALL`` vectors; cosines that are held at once.
BLOCKS, TALL, CELLS = 16, 1 << 16, 1 << 20
#: ``TALL`` where all pairs leave their tasks: 41 million rows are a file of one row group, and the vectors' copies (at 64 floats) few beside them.
FULL = 6400
#: Rows of a run of names; rows at a file's start that go by value; rows of a page of Parquet.
RUN, LEAD, PAGE = 256, 1 << 16, 20000


def _tiles(vectors: DataFrame, name: str, vector: str, size: int, tell: Callable, shape: str, tall: int = TALL, begin: Callable | None = None) -> DataFrame:
    """What ``tell`` makes of names, names, their cosines and which of these are pairs, for pieces of all pairs of blocks of vectors, by name; a task's first piece goes through ``begin``.

    Blocks have about ``size`` vectors, or more where there are many: up to ``BLOCKS`` times ``tall`` vectors none goes to more than ``BLOCKS`` + 1 tasks.
    """
    rows = vectors.count()
    n = max(1, min(-(-rows // size), max(BLOCKS, -(-rows // tall))))
    x = F.col(vector) if vectors.schema[vector].dataType.simpleString() == "array<float>" else F.transform(vector, lambda x: x.cast("double"))
    unit = vectors.select(F.col(name).cast("long").alias("i"), x.alias("x"), F.pmod(F.xxhash64(name), F.lit(n)).alias("p"))
    every = F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")
    # of the tiles (r, c) only those with r <= c are needed, as both orders of a pair lie in one of them
    left = unit.select(F.col("p").alias("r"), F.explode(F.filter(every, lambda q: q >= F.col("p"))).alias("c"), F.lit(0).alias("side"), "i", "x")
    right = unit.select(F.explode(F.filter(every, lambda q: q <= F.col("p"))).alias("r"), F.col("p").alias("c"), F.lit(1).alias("side"), "i", "x").where("r < c")
    # a tile is a task: its bytes are few beside its products, so small ones must not be joined
    tile = F.expr(f"cast(r * {n} - r * (r - 1) div 2 + c - r as int)")
    dealt = left.union(right).repartitionById(n * (n + 1) // 2, tile)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        side, i = rows.column("side").to_numpy(), rows.column("i").to_numpy()
        x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(i), -1).astype(np.float64)
        x /= np.where((long := np.linalg.norm(x, axis=1)) > 0, long, np.nan)[:, None]
        order = np.argsort(i)
        a, b = order[side[order] == 0], order[side[order] == 1]
        same = rows.column("r")[0].as_py() == rows.column("c")[0].as_py()
        ia, xa = i[a], x[a]
        ib, xb = (ia, xa) if same else (i[b], x[b])
        each = max(1, CELLS // max(1, ib.size) // 8 * 8)  # Parquet packs indices by eight: names that come again are the same bytes then
        for lo in range(0, ia.size if ib.size else 0, each):
            cosine = xa[lo : lo + each] @ xb.T
            good = ~np.isnan(cosine)
            if same:
                good &= ia[lo : lo + each, None] < ib[None, :]
            told = tell(ia[lo : lo + each], ib, cosine, good)
            yield begin(told) if begin and not lo else told

    return dealt.mapInArrow(multiply, shape)


def scaled_similarity(pairs: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """pairs (a, b, cosine) with ``similarity``: (x + 1) / 2 if any is negative, over the largest if that is over 1; both found by one aggregate, or given as ``bounds`` (_lo, _hi)."""
    if bounds is None:
        bounds = pairs.agg(F.min("cosine").alias("_lo"), F.max("cosine").alias("_hi"))
    shift = lambda x: F.when(F.col("_lo") < 0, (x + 1) / 2).otherwise(x)
    top = F.greatest(shift(F.col("_hi")), F.lit(1.0))
    return pairs.crossJoin(F.broadcast(bounds)).withColumn("similarity", shift(F.col("cosine")) / top).drop("_lo", "_hi")


def distances(pairs: DataFrame, items: DataFrame, name: str, both: bool = False) -> DataFrame:
    """(a, b, distance) in both orders from pairs (a, b, similarity), a < b, or in both orders already: 1 less the similarity, and 0 of each item (name) from itself."""
    turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # in one pass over the pairs
    d = pairs.select((1 - F.col("similarity")).alias("distance"), (F.struct("a", "b") if both else turned).alias("s")).select("s.a", "s.b", "distance")
    return d.union(items.select(F.col(name).alias("a"), F.col(name).alias("b"), F.lit(0.0)))


def kmeans(vectors: DataFrame, name: str, vector: str, n: int, seed: int = 42) -> DataFrame:
    rows = vectors.select(name, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=n, seed=seed).fit(rows).transform(rows).select(name, F.col("prediction").alias("cluster"))


def best_assignment(gain: np.ndarray) -> np.ndarray:
    """The column of each row in the one-to-one assignment of largest total (rows no more than columns): shortest augmenting paths over potentials."""
    rows, cols = gain.shape
    cost = gain.max() - gain
    u, v = np.zeros(rows + 1), np.zeros(cols + 1)
    owner = np.zeros(cols + 1, dtype=int)
    for i in range(1, rows + 1):
        owner[0], j = i, 0
        low, way, used = np.full(cols + 1, np.inf), np.zeros(cols + 1, dtype=int), np.zeros(cols + 1, dtype=bool)
        while True:
            used[j] = True
            free = ~used
            free[0] = False
            reach = np.append(np.inf, cost[owner[j] - 1] - u[owner[j]] - v[1:])
            better = free & (reach < low)
            low[better], way[better] = reach[better], j
            nxt = int(np.argmin(np.where(free, low, np.inf)))
            step = low[nxt]
            u[owner[used]] += step
            v[used] -= step
            low[free] -= step
            j = nxt
            if owner[j] == 0:
                break
        while j:
            owner[j], j = owner[way[j]], way[j]
    out = np.full(rows, -1)
    for j in range(1, cols + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def match_labels(pairs: DataFrame, true: str, cluster: str, most: int = 1000) -> tuple[DataFrame, float]:
    """pairs with ``matched``, the true label that stands for the row's cluster, and the accuracy: clusters and labels are assigned one to one so that most rows agree.

    Only the table of counts goes to the driver; more than ``most`` labels or clusters are an error. A cluster left over has a null label.
    """
    counts = pairs.where(F.col(true).isNotNull() & F.col(cluster).isNotNull()).groupBy(true, cluster).agg(F.count("*").alias("n"))
    size = counts.agg(F.count_distinct(true).alias("a"), F.count_distinct(cluster).alias("b")).first()
    if max(size.a, size.b) > most:
        raise ValueError(f"{size.a} labels and {size.b} clusters are too many to match")
    table = counts.toPandas().pivot(index=cluster, columns=true, values="n").fillna(0)
    gain = table.to_numpy(dtype=float)
    wide = gain.shape[0] <= gain.shape[1]
    to = best_assignment(gain if wide else gain.T)
    chosen = [(table.index[i], table.columns[j]) for i, j in enumerate(to)] if wide else [(table.index[i], table.columns[j]) for j, i in enumerate(to)]
    hit = sum(table.loc[a, b] for a, b in chosen)
    named = pairs.sparkSession.createDataFrame([(a.item() if hasattr(a, "item") else a, b.item() if hasattr(b, "item") else b) for a, b in chosen], f"`{cluster}` {pairs.schema[cluster].dataType.simpleString()}, matched {pairs.schema[true].dataType.simpleString()}")
    return pairs.join(F.broadcast(named), cluster, "left"), float(hit / gain.sum()) if gain.sum() else 0.0


def projection_weights(vectors: DataFrame, name: str, vector: str, means: DataFrame, cluster: str) -> DataFrame:
    """(name, weights array): each vector regressed on the clusters' means (cluster, vector) with an intercept, its coefficients at unit length; null where they are all 0. The means, one vector a cluster, go to the driver."""
    rows = means.select(cluster, F.transform(vector, lambda x: x.cast("double")).alias("m")).orderBy(cluster).collect()
    base = np.column_stack([np.ones(len(rows[0].m)), *(r.m for r in rows)])
    solve = np.linalg.pinv(base)[1:]

    @F.pandas_udf("array<double>")
    def weigh(x: pd.Series) -> pd.Series:
        w = np.stack(x.to_numpy()).astype(float) @ solve.T
        size = np.linalg.norm(w, axis=1)
        return pd.Series([list(a / s) if s > 0 else None for a, s in zip(w, size, strict=True)])

    return vectors.select(name, weigh(F.transform(vector, lambda x: x.cast("double"))).alias("weights"))


def project_pca(train: DataFrame, other: DataFrame, vector: str, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``projected``, their vectors on the k components of the first one's."""
    features = lambda df: df.withColumn("_f", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(features(train))
    told = lambda df: model.transform(features(df)).withColumn("projected", vector_to_array("_p")).drop("_f", "_p")
    return told(train), told(other)


def cross_cosine(a: DataFrame, b: DataFrame, vector: str) -> DataFrame:
    """One row (a_rows, b_rows, cosine): the mean cosine between all vectors of the one set and all of the other, zero vectors apart. It is the product of the means of the vectors at unit length, so no pair is made."""

    def mean(df: DataFrame, name: str) -> DataFrame:
        x = df.select(F.transform(vector, lambda v: v.cast("double")).alias("x")).withColumn("s", F.sqrt(F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v))).where("s > 0")
        return x.select(F.posexplode(F.transform("x", lambda v: v / F.col("s"))).alias("at", "v")).groupBy("at").agg(F.avg("v").alias(name), F.count("*").alias(f"{name}_rows"))

    return mean(a, "a").join(mean(b, "b"), "at").agg(F.max("a_rows").alias("a_rows"), F.max("b_rows").alias("b_rows"), F.sum(F.col("a") * F.col("b")).alias("cosine"))


# --- features


def location_features(curves: DataFrame, k: list[str], at: str, v: str, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """(k, window, sum, mean, high, low, high_at, low_at, balance) of curves within bins from..to of each window: the first place on ties; balance is (high - |low|) / (high + |low|)."""
    named = F.explode(F.filter(F.array(*[F.when(F.col(at).between(a, b), F.lit(n)) for n, (a, b) in windows.items()]), lambda x: x.isNotNull()))
    g = curves.select(*k, at, v, named.alias("window")).groupBy(*k, "window")
    out = g.agg(F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(at, F.struct(F.col(v), -F.col(at))).alias("high_at"), F.min_by(at, F.struct(v, at)).alias("low_at"))
    return out.withColumn("balance", (F.col("high") - F.abs("low")) / F.nullif(F.col("high") + F.abs("low"), F.lit(0.0)))


def trial_features(traces: DataFrame, trials: DataFrame, k: list[str], trial: str, frame: str, v: str, at: str, start: str, before: int = 10, after: int = 20) -> DataFrame:
    """(k, trial, rise, top_at) for each trial (k, trial, at, start) with all of its frames: the largest value from the event on less the mean before it, and the place of the largest since the lap's start."""
    wanted = trials.select(*k, trial, at, start, F.explode(F.sequence(F.col(at) - before, F.col(at) + (after - 1))).alias(frame))
    both = wanted.join(traces.select(*k, frame, v), [*k, frame])
    late = F.col(frame) >= F.col(at)
    out = both.groupBy(*k, trial, start).agg(F.count("*").alias("_n"), (F.max(F.when(late, F.col(v))) - F.avg(F.when(~late, F.col(v)))).alias("rise"), F.max_by(frame, F.when(late, F.struct(F.col(v), -F.col(frame)))).alias("_at"))
    return out.where(F.col("_n") == before + after).select(*k, trial, "rise", (F.col("_at") - F.col(start)).alias("top_at"))


def temporal_features(traces: DataFrame, peaks: DataFrame, k: list[str], o: str, v: str, rate: float) -> DataFrame:
    """Shape of each series: moments (population), quartiles, lag-1 correlation, share of samples over a deviation above the mean, range, peak count, frequency, mean height, mean and deviation of the gaps between peaks (k, o, value), baseline and peak over noise."""
    from tracekit.operators.windows import lag1_autocorrelation

    q = lambda p: F.percentile(v, F.lit(p))
    base = traces.groupBy(*k).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), q(0.5).alias("median"), q(0.25).alias("q1"), q(0.75).alias("q3"), q(0.1).alias("baseline"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), F.max(v).alias("_hi"), F.min(v).alias("_lo"),
    )
    active = traces.join(base.select(*k, "mean", "sd"), k).groupBy(*k).agg(F.avg((F.col(v) > F.col("mean") + F.col("sd")).cast("double")).alias("active"))
    gap = F.col(o) - F.lag(o).over(Window.partitionBy(*k).orderBy(o))
    found = peaks.withColumn("_g", gap).groupBy(*k).agg(F.count("*").alias("peaks"), F.avg("value").alias("height"), F.avg("_g").alias("gap"), F.stddev_pop("_g").alias("gap_sd"))
    out = base.join(active, k).join(lag1_autocorrelation(traces, k, o, v).withColumnRenamed("r", "lag1"), k).join(found, k, "left")
    noise = F.when(F.col("sd") > 0, (F.col("_hi") - F.col("median")) / F.col("sd"))
    out = out.withColumn("iqr", F.col("q3") - F.col("q1")).withColumn("range", F.col("_hi") - F.col("_lo")).withColumn("over_noise", noise)
    return out.withColumn("peaks", F.coalesce("peaks", F.lit(0))).withColumn("frequency", F.col("peaks") / (F.col("n") / rate)).drop("_hi", "_lo")


def feature_vectors(tables: list[DataFrame], order: list[str], label: str) -> DataFrame:
    """The rows of all sessions with ``features``, an array of the columns in a fixed order, NaN and null as 0, and the label as a whole number."""
    from tracekit.functions.scalars import finite

    one = lambda df: df.withColumn("features", F.array(*[F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) for c in order])).withColumn("label", F.col(label).cast("int"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(df) for df in tables])


# --- decoders


def folds(df: DataFrame, name: str, label: str, n: int, seed: int = 5) -> DataFrame:
    """df with a ``fold``: in each label, rows in a hashed order are dealt in turn."""
    placed = _places(df, [label], hashed(F.lit(seed), F.col(name)), [name])
    return placed.withColumn("fold", F.pmod("_at", F.lit(n)).cast("int")).drop("_at")


def _places(df: DataFrame, k: list[str], h: Column, ties: list[str]) -> DataFrame:
    """df with ``_at``, a row's place from 0 in the order of the hash h of 32 bits within each k. Ranks come from counts by ranges of the hash, so no window spans a whole k; rows without a k are left out."""
    rows = df.withColumn("_h", h).withColumn("_r", F.floor(F.col("_h") / F.lit(1 << 24)))
    counts = rows.groupBy(*k, "_r").agg(F.count("*").alias("_c"))
    before = counts.select(*k, "_r", F.coalesce(F.sum("_c").over(Window.partitionBy(*k).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    rank = F.row_number().over(Window.partitionBy(*k, "_r").orderBy("_h", *ties)) - 1
    return rows.join(F.broadcast(before), [*k, "_r"]).withColumn("_at", F.col("_b") + rank).drop("_h", "_r", "_b")


def nearest(train: DataFrame, test: DataFrame, name: str, label: str, vector: str, neighbours: int = 5) -> DataFrame:
    """test (name, label) with ``predicted``: the most frequent label among the ``neighbours`` rows of ``train`` that are most alike by cosine, the smallest on ties."""
    ask = test.select(F.col(name).cast("long").alias("i"), F.lit(0).alias("f"), F.lit(0).cast("long").alias("y"), F.lit(1).cast("long").alias("n"), _floats(test, vector))
    known = train.select(F.col(name).cast("long").alias("i"), F.lit(-1).alias("f"), F.col(label).cast("long").alias("y"), _floats(train, vector))
    size = [df.agg(F.count("*"), F.max(F.size(vector))).first() for df in (test, train)]
    won = _most_alike(ask, known, neighbours, size[0][0], size[1][0], max(size[0][1] or 1, size[1][1] or 1)).select(F.col("i").alias("_n"), _vote(neighbours).alias("predicted"))
    return test.join(won, F.col(name) == F.col("_n")).drop("_n")


def nearest_folds(dealt: DataFrame, name: str, label: str, vector: str, values: list[int]) -> DataFrame:
    """(neighbours, fold, n, accuracy, error) for each number of neighbours and fold of dealt (name, label, vector, fold), by the rows of the other folds. One look at the pairs serves all folds and numbers.

    Rows of one fold, label and vector are asked about once.
    """
    most = max(values)
    rows = dealt.select(F.col(name).cast("long").alias("i"), F.col("fold").alias("f"), F.col(label).cast("long").alias("y"), _floats(dealt, vector))
    size = dealt.agg(F.count("*"), F.max(F.size(vector))).first()
    ask = rows.groupBy("f", "y", "x").agg(F.min("i").alias("i"), F.count("*").alias("n")).select("i", "f", "y", "n", "x")
    told = _most_alike(ask, rows, most, size[0], size[0], size[1] or 1)
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("k"), _vote(v).alias("p")) for v in values])).alias("t")
    told = told.select("f", "y", "n", each).select(F.col("t.k").alias("neighbours"), F.col("f").alias("fold"), "n", F.abs(F.col("t.p") - F.col("y")).alias("off"))
    hit = F.sum(F.when(F.col("off") == 0, F.col("n")).otherwise(0))
    return told.groupBy("neighbours", "fold").agg(F.sum("n").alias("n"), (hit / F.sum("n")).alias("accuracy"), F.percentile("off", F.lit(0.5), F.col("n")).alias("error"))


def _floats(df: DataFrame, vector: str) -> Column:
    return (F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.transform(vector, lambda x: x.cast("double"))).alias("x")


def _vote(k: int) -> Column:
    """The most frequent label of the first k of ``best``, the smallest on ties."""
    y = F.transform(F.slice("best", 1, k), lambda s: s["y"])
    count = lambda a: F.size(F.filter(y, lambda z: z == a))
    return -F.array_max(F.transform(F.array_distinct(y), lambda a: F.struct(count(a).alias("c"), (-a).alias("y"))))["y"]


#: Blocks that rows asked about and training rows are cut into; numbers of a block of rows asked about, over which there are more blocks.
ASKED, TRAINED, HELD = 16, 4, 1 << 22


class _Best:
    """The ``most`` training rows most alike to each row asked about (f ascending), by the cosine rounded to 9 places and the name.

    Cosines of all pairs are products of floats. Only pairs that are not under a row's worst by more than such products may err are worked out in doubles.
    """

    def __init__(self, f: np.ndarray, x: np.ndarray, most: int) -> None:
        self.f, self.x, self.most = f, _unit(x), most
        self.short, self.slack = self.x.astype(np.float32), (x.shape[1] + 16) * 2.0**-23
        self.s, self.i, self.y = np.full((f.size, most), -np.inf), np.full((f.size, most), np.iinfo(np.int64).max), np.zeros((f.size, most), np.int64)

    def add(self, f: np.ndarray, i: np.ndarray, y: np.ndarray, x: np.ndarray) -> None:
        """Training rows: no row asked about sees those of its own f."""
        for one in np.unique(f).tolist():
            at = np.flatnonzero(f == one)
            x_, ends = _unit(x[at]), np.searchsorted(self.f, [one, one + 1])
            short, each = x_.astype(np.float32), max(1, (CELLS // 2) // at.size)
            for lo, hi in ((0, ends[0]), (ends[1], self.f.size)):
                for a in range(lo, hi, each):
                    b = min(a + each, hi)
                    cosine = self.short[a:b] @ short.T
                    least = self.s[a:b, -1] - self.slack
                    if at.size > self.most and np.isneginf(least).any():
                        least = np.maximum(least, np.partition(cosine, -self.most, axis=1)[:, -self.most] - 2 * self.slack)
                    found = np.flatnonzero(cosine >= least.astype(np.float32)[:, None] - np.float32(self.slack))
                    for part in np.array_split(found, -(-found.size // (1 << 16))) if found.size else ():
                        row, col = a + part // at.size, part % at.size
                        self._merge(row, np.round(np.einsum("ij,ij->i", self.x[row], x_[col]), 9), i[at[col]], y[at[col]])

    def _merge(self, row: np.ndarray, s: np.ndarray, i: np.ndarray, y: np.ndarray) -> None:
        some, place = np.unique(row, return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(some.size), self.most), place])
        s, i, y = (np.concatenate([old[some].ravel(), new]) for old, new in ((self.s, s), (self.i, i), (self.y, y)))
        order = np.lexsort((i, -s, place))
        place = place[order]
        kept = order[np.arange(place.size) - np.searchsorted(place, np.arange(some.size))[place] < self.most]
        self.s[some], self.i[some], self.y[some] = (c[kept].reshape(-1, self.most) for c in (s, i, y))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def _most_alike(ask: DataFrame, known: DataFrame, most: int, asked: int, trained: int, width: int) -> DataFrame:
    """ask (i, f, y, n) with ``best``, the ``most`` rows (d, i, y) of known (i, f, y, x) of another f that are most alike to x by cosine, of equally near ones those of smaller i; d is less for nearer ones. Rows without any are left out.

    All pairs are looked at, in tiles of a block of rows asked about, which a task holds, and a block of training rows that stream by: the time is quadratic, memory and what leaves a task are not. Of training rows with one f
    and vector no more than ``most`` can count. ``asked``, ``trained`` and ``width`` are the rows and the length of vectors at most.
    """
    r = max(1, min(-(-asked // 1000), max(ASKED, -(-asked * width // HELD))))
    c = max(1, min(-(-trained // 4000), TRAINED))
    copy = F.row_number().over(Window.partitionBy("f", "x").orderBy("i"))
    known = known.withColumn("_c", copy).where(F.col("_c") <= most).drop("_c")
    tile = lambda at, n: F.pmod(F.xxhash64(at), F.lit(n))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = ask.select(F.lit(0).alias("side"), tile("i", r).alias("r"), to(c).alias("c"), "i", "f", "y", "n", "x")
    right = known.select(F.lit(1).alias("side"), to(r).alias("r"), tile("i", c).alias("c"), "i", "f", "y", F.lit(0).cast("long").alias("n"), "x")
    dealt = left.union(right).repartitionById(r * c, (F.col("r") * c + F.col("c")).cast("int")).sortWithinPartitions("side", "f").select("side", "i", "f", "y", "n", "x")

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        i, f, y = (batch.column(c).to_numpy() for c in (1, 2, 3))
        return [f, i, y, batch.column(5).flatten().to_numpy().reshape(len(i), -1)]

    def told(rows: pa.RecordBatch, best: _Best) -> Iterator[pa.RecordBatch]:
        for lo in range(0, rows.num_rows, 8192):
            hi = min(lo + 8192, rows.num_rows)
            there = np.isfinite(best.s[lo:hi])
            ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
            # less 0 for no negative zero
            near = pa.StructArray.from_arrays([pa.array(0.0 - best.s[lo:hi][there]), pa.array(best.i[lo:hi][there]), pa.array(best.y[lo:hi][there])], ["d", "i", "y"])
            yield pa.RecordBatch.from_arrays([*(rows.column(c).slice(lo, hi - lo) for c in (1, 2, 3, 4)), pa.ListArray.from_arrays(pa.array(ends), near)], ["i", "f", "y", "n", "best"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, best = [], None, None
        for batch in batches:
            first = int(np.count_nonzero(batch.column(0).to_numpy() == 0))
            if first:
                held.append(batch.slice(0, first))
            if first == batch.num_rows or not held:
                continue
            if best is None:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                f, _, _, x = columns(rows)
                best = _Best(f, x, most)
            f, i, y, x = columns(batch.slice(first))
            best.add(f, i, y, x)
        if best is not None:
            yield from told(rows, best)

    near = dealt.mapInArrow(look, "i long, f int, y long, n long, best array<struct<d: double, i: long, y: long>>")
    if c > 1:
        near = near.groupBy("i", "f", "y", "n").agg(F.flatten(F.collect_list("best")).alias("best"))
    return near.withColumn("best", F.slice(F.array_sort("best"), 1, most)).where(F.size("best") > 0)


def predictions(train: DataFrame, test: DataFrame, name: str, label: str, vector: str, model: str = "bayes", **options: float) -> DataFrame:
    """test with ``predicted`` by a model trained on ``train``: ``kernel`` (radial) or ``linear`` (least squares, one against the rest), ``svc`` (linear, one against the rest), ``trees`` (boosted, one against the rest), ``bayes`` (Gaussian) or ``nearest``. Labels are whole numbers from 0."""
    if model in ("kernel", "linear"):
        return kernels.predictions(train, test, label, vector, options.get("C", 1.0), model == "kernel")
    if model == "nearest":
        return nearest(train, test, name, label, vector, int(options.get("neighbours", 5)))
    makers = {
        "svc": lambda: OneVsRest(classifier=LinearSVC(regParam=1 / options.get("C", 1.0) / 100, maxIter=30)),
        "trees": lambda: OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=3, seed=7)),
        "bayes": lambda: NaiveBayes(modelType="gaussian"),
    }
    ready = lambda df: df.withColumn("features_", array_to_vector(F.transform(vector, lambda x: x.cast("double")))).withColumn("label_", F.col(label).cast("double"))
    made = makers[model]()
    made.setFeaturesCol("features_").setLabelCol("label_").setPredictionCol("predicted")
    return made.fit(ready(train)).transform(ready(test)).withColumn("predicted", F.col("predicted").cast("long")).select(*test.columns, "predicted")


def cross_validated(df: DataFrame, name: str, label: str, vector: str, n: int = 10, model: str = "bayes", **options: float) -> DataFrame:
    """(fold, n, accuracy, error) for each of n stratified folds: the share of right labels, and the median size of the label's error, of a model trained on the others."""
    from tracekit.sources.scratch import written

    dealt = folds(df.select(name, label, vector), name, label, n)
    if model in ("kernel", "linear"):  # all folds at once
        return kernels.grid(dealt, label, vector, [options.get("C", 1.0)], model == "kernel").drop("C")
    if model == "nearest":
        return nearest_folds(written(dealt, "folds"), name, label, vector, [int(options.get("neighbours", 5))]).drop("neighbours")
    told = [predictions(dealt.where(F.col("fold") != f), dealt.where(F.col("fold") == f), name, label, vector, model, **options) for f in range(n)]
    rows = reduce(lambda a, b: a.unionByName(b), told)
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"), F.median(F.abs(F.col("predicted") - F.col(label))).alias("error"))


def grid_search(df: DataFrame, name: str, label: str, vector: str, values: list[float], n: int = 3, model: str = "kernel", option: str = "C") -> DataFrame:
    """(option, best) for each value of a model's option: the best accuracy of its folds; sorted so that the first row is the best, the larger value on ties. The least-squares machines share their features and sums among all C, numbers of neighbours the pairs."""
    from tracekit.sources.scratch import written

    if model == "nearest" and option == "neighbours":
        told = nearest_folds(written(folds(df.select(name, label, vector), name, label, n), "folds"), name, label, vector, [int(v) for v in values])
        return told.groupBy(F.col("neighbours").cast("double").alias(option)).agg(F.max("accuracy").alias("best")).orderBy(F.desc("best"), F.desc(option))
    if model in ("kernel", "linear") and option == "C":
        told = kernels.grid(folds(df.select(name, label, vector), name, label, n), label, vector, values, model == "kernel")
        return told.groupBy("C").agg(F.max("accuracy").alias("best")).orderBy(F.desc("best"), F.desc("C"))
    rows = [(float(c), float(cross_validated(df, name, label, vector, n, model, **{option: c}).agg(F.max("accuracy")).first()[0])) for c in values]
    return df.sparkSession.createDataFrame(rows, f"`{option}` double, best double").orderBy(F.desc("best"), F.desc(option))


def permuted_accuracy(df: DataFrame, name: str, label: str, vector: str, repeats: int, n: int = 3, model: str = "bayes", seed: int = 17) -> DataFrame:
    """(repeat, fold, accuracy) with the labels dealt anew over the rows in a hashed order each time: what chance gives. Rows to which a null falls are left out of that repeat.

    All repeats are dealt at once, and the least-squares machines share each pass over the vectors.
    """
    from tracekit.sources.scratch import written

    # the n-th row in the hashed order takes the n-th label in the order of names; rows are told by their place in that, since names may be copies
    rows = _numbered(df.select(F.col(name).alias("_k"), F.col(label).alias("_y"), F.col(vector).alias("_v")), [F.col("_k")]).withColumnRenamed("_at", "_i")
    each = rows.select("_i", "_k", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    placed = _places(each, ["repeat"], hashed(F.lit(seed), F.col("repeat"), F.col("_k")), ["_k", "_i"])
    mixed = written(placed.join(rows.select(F.col("_i").alias("_at"), "_y"), "_at").drop("_at"), "mixed")
    if model not in ("kernel", "linear"):
        of = lambda k: mixed.where(F.col("repeat") == k).join(rows.select("_i", "_v"), "_i").select(F.col("_k").alias(name), F.col("_y").alias(label), F.col("_v").alias(vector))
        out = [cross_validated(written(of(k), "mixed"), name, label, vector, n, model).select(F.lit(k).alias("repeat"), "fold", "accuracy") for k in range(repeats)]
        return reduce(lambda a, b: a.union(b), out)
    dealt = _places(mixed, ["repeat", "_y"], hashed(F.lit(5), F.col("_k")), ["_k", "_i"])
    fold = (F.col("repeat") * n + F.pmod("_at", F.lit(n))).cast("int").alias("f")
    lists = dealt.groupBy("_i").agg(F.collect_list(F.struct(fold, F.col("_y").alias("y"))).alias("_e"))
    dealt = written(lists.join(rows.select("_i", "_v"), "_i").select(F.col("_e.f").alias("_f"), F.col("_e.y").alias("_y"), "_v"), "dealt")
    return kernels.repeated(dealt, "_f", "_y", "_v", repeats, n, kernel=model == "kernel")


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with its place in the order as ``_at``, from a range sort and the sizes of its partitions."""
    from tracekit.sources.scratch import written

    rows = written(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "order")
    sizes = rows.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row a partition
    shift, first = [], 0
    for p, n in sizes:
        shift += [F.lit(p), F.lit(first)]
        first += n
    return rows.withColumn("_at", F.create_map(*shift)[F.shiftright("_m", 33)] + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m")


def train_scorer(df: DataFrame, vector: str, label: str, kind: str = "logistic", hidden: list[int] | None = None, seed: int = 3) -> object:
    """A model of a 0/1 label with weights that even out the classes: logistic regression, or a network with hidden layers (``network``) that stops early."""
    if kind == "network":
        return networks.train(df, vector, label, tuple(hidden or (16, 8)), seed=seed)
    rows = df.withColumn("features_", array_to_vector(F.transform(vector, lambda x: x.cast("double")))).withColumn("label_", F.col(label).cast("double"))
    one = rows.agg(F.avg("label_")).first()[0]
    weight = F.when(F.col("label_") == 1, 0.5 / max(one, 1e-9)).otherwise(0.5 / max(1 - one, 1e-9))
    return LogisticRegression(featuresCol="features_", labelCol="label_", weightCol="weight_", regParam=1e-3, maxIter=50).fit(rows.withColumn("weight_", weight))


def score_new(model: object, df: DataFrame, vector: str, threshold: float = 0.5) -> DataFrame:
    """df with ``score``, the probability of label 1, and ``accepted``."""
    if isinstance(model, networks.Network):
        return networks.scored(model, df, vector, threshold)
    rows = model.transform(df.withColumn("features_", array_to_vector(F.transform(vector, lambda x: x.cast("double")))))
    return rows.withColumn("score", vector_to_array("probability")[1]).select(*df.columns, "score").withColumn("accepted", F.col("score") >= threshold)


def best_fold_scorer(df: DataFrame, name: str, vector: str, label: str, n: int, thresholds: list[float], kind: str = "logistic") -> tuple[object, DataFrame]:
    """The model of the fold with the best F1 at its own best threshold, and (fold, threshold, accuracy, precision, recall, f1, auc) of all folds."""
    from tracekit.operators import groups as G
    from tracekit.sources.scratch import written

    dealt = written(folds(df.select(name, label, vector), name, label, n), "folds")
    rows, models = [], []
    for f in range(n):
        model = train_scorer(dealt.where(F.col("fold") != f), vector, label, kind)
        told = written(score_new(model, dealt.where(F.col("fold") == f), vector).select(label, "score"), "scores")
        at = G.best_threshold(told, label, "score", thresholds).first().threshold
        m = G.binary_metrics(told, label, "score", at).first()
        rows.append((f, float(at), *(float(x) if x is not None else None for x in m)))
        models.append(model)
    best = max(range(n), key=lambda f: (rows[f][5] or 0.0, -f))
    return models[best], df.sparkSession.createDataFrame(rows, "fold int, threshold double, accuracy double, precision double, recall double, f1 double, auc double")


def registered(folds_: DataFrame, keys: dict[str, object], metrics: list[str]) -> DataFrame:
    """One row for a model: its keys, and mean and deviation of each metric over its folds."""
    return folds_.agg(*[f(c).alias(f"{c}_{n}") for c in metrics for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))]).select(*[F.lit(v).alias(k) for k, v in keys.items()], "*")
