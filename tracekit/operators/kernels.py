"""Decoders on a radial kernel: random Fourier features and a least-squares machine, one against the rest, with a grid of C that shares features and sums.

The kernel exp(-gamma |x - y|^2) is the mean product of ``size`` random cosines of x and y. On these features a machine needs only two sums over the rows, of products of features and of features
with labels. They are added up by fold in one pass, so the training sums of a fold are those of all less its own; one eigendecomposition a fold (of ``size`` numbers squared, on the driver) then
solves every C, and a second pass predicts all rows for all C. A row may lie in a fold of each of several repeats, with a label in each: its features are made once a pass. Labels are whole numbers from 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Features:
    """cos(x W + b), scaled, and a one; without W the vector itself and a one (a linear machine)."""

    weights: np.ndarray | None
    phases: np.ndarray | None

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.weights is not None:
            x = np.sqrt(2 / self.phases.size) * np.cos(x @ self.weights + self.phases)
        return np.hstack([x, np.ones((len(x), 1))])


def radial(df: DataFrame, vector: str, size: int = 256, gamma: float | None = None, seed: int = 23) -> Features:
    """Random features of the radial kernel; gamma is one over the length and the variance of all entries of the vectors if not given."""
    each = df.select(F.size(vector).alias("n"), F.explode(F.transform(vector, lambda x: x.cast("double"))).alias("x"))
    told = each.agg(F.max("n").alias("n"), F.var_pop("x").alias("s")).first()
    if gamma is None:
        gamma = 1 / (told.n * told.s) if told.s else 1.0
    draw = np.random.default_rng(seed)
    return Features(draw.normal(0, np.sqrt(2 * gamma), (told.n, size)), draw.uniform(0, 2 * np.pi, size))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _by_fold(folds: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each fold in lists of folds: the rows that name it, and the places in the flat lists."""
    row = np.repeat(np.arange(len(folds)), np.diff(folds.offsets.to_numpy()))
    flat = folds.flatten().to_numpy()
    order = np.argsort(flat, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(flat[order])) + 1):
        if at.size:
            yield int(flat[at[0]]), row[at], at


def fold_sums(df: DataFrame, made: Features, classes: int) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """For each fold of df (_fold array<int>, _label array<long>, _x array<double>) the sums of products of features, and of features with +1 for a row's class and -1 for others, and its rows.

    A row counts in each of its folds, with the label that goes with it. Tasks add up what they see; the driver gets one matrix a fold.
    """
    shared = df.sparkSession.sparkContext.broadcast(made)
    shape = "fold int, n long, products binary, labels binary"

    def rows(totals: dict) -> Iterator[pa.RecordBatch]:
        for f, (g, r, n) in totals.items():
            row = zip((f, n, g.tobytes(), r.tobytes()), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], ["fold", "n", "products", "labels"])

    def add(totals: dict, f: int, g: np.ndarray, r: np.ndarray, n: int) -> None:
        a = totals.setdefault(f, [np.zeros_like(g), np.zeros_like(r), 0])
        a[0] += g
        a[1] += r
        a[2] += n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for b in batches:
            for part in (b.slice(lo, 4096) for lo in range(0, b.num_rows, 4096)):
                z, y = shared.value.of(_matrix(part.column(2))), part.column(1).flatten().to_numpy(zero_copy_only=False)
                for one, row, at in _by_fold(part.column(0)):
                    mine = z[row]
                    add(totals, one, mine.T @ mine, mine.T @ np.where(y[at, None] == np.arange(classes), 1.0, -1.0), at.size)
        yield from rows(totals)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for b in batches:
            for f, n, g, r in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                r = np.frombuffer(r).reshape(-1, classes)
                add(totals, f, np.frombuffer(g).reshape(len(r), -1), r, n)
        yield from rows(totals)

    out: dict = {}
    for f, n, g, r in df.select("_fold", "_label", "_x").mapInArrow(count, shape).repartition("fold").mapInArrow(merge, shape).collect():
        r = np.frombuffer(r).reshape(-1, classes)
        out[f] = (np.frombuffer(g).reshape(len(r), -1), r, n)
    return out


def machines(products: np.ndarray, labels: np.ndarray, values: list[float]) -> np.ndarray:
    """Weights (C, feature, class) of the least-squares machine for each C: (products + 1/C) w = labels."""
    size, basis = np.linalg.eigh(products)
    told = basis.T @ labels
    return np.stack([basis @ (told / (np.maximum(size, 0) + 1 / c)[:, None]) for c in values])


def predicted(df: DataFrame, made: Features, weights: dict[int, np.ndarray]) -> DataFrame:
    """df (_fold array<int>, _x, ...) without _x, with ``told``, for each of its folds the array of the classes for each C of the machine of that fold; the first of equal ones."""
    shared = df.sparkSession.sparkContext.broadcast((made, weights))
    rest = [c for c in df.columns if c != "_x"]
    shape = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in rest) + "told array<array<int>>"

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, weights = shared.value
        for b in batches:
            for part in (b.slice(lo, 2048) for lo in range(0, b.num_rows, 2048)):
                fold, z = part.column(part.schema.get_field_index("_fold")), made.of(_matrix(part.column(part.schema.get_field_index("_x"))))
                ends = fold.offsets.to_numpy() - fold.offsets[0].as_py()
                n = len(next(iter(weights.values())))
                best = np.zeros((ends[-1], n), dtype=np.int32)
                for one, row, at in _by_fold(fold):
                    mine = z[row]
                    for c in range(n):
                        best[at, c] = np.argmax(mine @ weights[one][c], axis=1)
                each = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, n, dtype=np.int32)), pa.array(best.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), each)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), lists], [*rest, "told"])

    return df.mapInArrow(tell, shape)


def _classes(rows: DataFrame) -> int:
    return int(rows.agg(F.coalesce(F.max(F.array_max("_label")), F.lit(0))).first()[0]) + 1


def _doubles(vector: str) -> Column:
    return F.transform(vector, lambda x: x.cast("double")).alias("_x")


def _ready(df: DataFrame, label: str, vector: str, fold: Column) -> DataFrame:
    return df.select(F.array(fold.cast("int")).alias("_fold"), F.array(F.col(label).cast("long")).alias("_label"), _doubles(vector))


def _told(rows: DataFrame, made: Features, values: list[float], n: int | None = None) -> DataFrame:
    """(fold, y, C, p) for each fold of each of rows (_fold, _label, _x) and each C: its label and the one of the machine trained on the other folds, of the same n where n is given."""
    sums = fold_sums(rows, made, _classes(rows))
    group = lambda f: f // n if n else 0
    whole: dict = {}
    for f, (g, r, _) in sums.items():
        a = whole.setdefault(group(f), [np.zeros_like(g), np.zeros_like(r)])
        a[0] += g
        a[1] += r
    weights = {f: machines(whole[group(f)][0] - g, whole[group(f)][1] - r, values) for f, (g, r, _) in sums.items()}
    each = predicted(rows, made, weights).select(F.explode(F.arrays_zip("_fold", "_label", "told")).alias("e"))
    named = F.explode(F.arrays_zip(F.array(*[F.lit(float(c)) for c in values]).alias("C"), F.col("e.told").alias("p"))).alias("t")
    return each.select(F.col("e._fold").alias("fold"), F.col("e._label").alias("y"), named).select("fold", "y", F.col("t.C").alias("C"), F.col("t.p").alias("p"))


def grid(dealt: DataFrame, label: str, vector: str, values: list[float], kernel: bool = True, size: int = 256, gamma: float | None = None) -> DataFrame:
    """(C, fold, n, accuracy, error) for each C and fold of dealt (label, vector, fold): the share of right labels, and the median size of the label's error, by a machine trained on the other folds."""
    made = radial(dealt, vector, size, gamma) if kernel else Features(None, None)
    told = _told(_ready(dealt, label, vector, F.col("fold")), made, values)
    return told.groupBy("C", "fold").agg(F.count("*").alias("n"), F.avg((F.col("p") == F.col("y")).cast("double")).alias("accuracy"), F.median(F.abs(F.col("p") - F.col("y"))).cast("double").alias("error"))


#: Folds of which a task of ``repeated`` holds the sums at once (half a MB each at 256 features).
HELD = 128


def repeated(dealt: DataFrame, folds: str, labels: str, vector: str, repeats: int, n: int, c: float = 1.0, kernel: bool = True, size: int = 256, gamma: float | None = None) -> DataFrame:
    """(repeat, fold, accuracy) for several labellings of the same vectors, each with n folds of its own: a row has the arrays ``labels`` and ``folds`` (repeat * n + fold), and a machine is trained on the other folds of its repeat.

    Repeats share each pass over the vectors, as many as have ``HELD`` folds together.
    """
    made = radial(dealt, vector, size, gamma) if kernel else Features(None, None)
    once, out = max(1, HELD // n), []
    for k in range(0, repeats, once):
        lo, hi = F.lit(k * n), F.lit((k + once) * n - 1)
        mine = F.filter(F.arrays_zip(F.col(folds).alias("f"), F.col(labels).alias("y")), lambda e: e["f"].between(lo, hi))  # noqa: B023 (called at once)
        rows = dealt.select(mine.alias("_e"), vector).select(F.col("_e.f").cast("array<int>").alias("_fold"), F.col("_e.y").cast("array<long>").alias("_label"), _doubles(vector))
        right = F.avg((F.col("p") == F.col("y")).cast("double"))
        out.append(_told(rows, made, [c], n).groupBy("fold").agg(right.alias("accuracy")))
    return reduce(DataFrame.union, out).select(F.floor(F.col("fold") / n).cast("int").alias("repeat"), F.pmod("fold", F.lit(n)).alias("fold"), "accuracy")


def predictions(train: DataFrame, test: DataFrame, label: str, vector: str, c: float = 1.0, kernel: bool = True, size: int = 256, gamma: float | None = None) -> DataFrame:
    """test with ``predicted`` by a machine trained on train."""
    rows = _ready(train, label, vector, F.lit(0))
    made = radial(train, vector, size, gamma) if kernel else Features(None, None)
    (g, r, _) = fold_sums(rows, made, _classes(rows))[0]
    asked = test.select("*", F.array(F.lit(0)).alias("_fold"), _doubles(vector))
    out = predicted(asked, made, {0: machines(g, r, [c])})
    return out.select(*test.columns, F.col("told")[0][0].cast("long").alias("predicted"))
