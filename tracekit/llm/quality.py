"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression on the form of the text gives each document's own evidence, as odds against the base rate that it was fitted with. The
labels that are known are counted by path, host and in all. A host's rate of good documents is shrunk toward that of all,
a path's toward its host's, each by a strength that the spread of the counts tells (method of moments, of paths within their
hosts); so a sparse site stands near the global prior and one with many labels at its own rate. A document's own label is left out of the counts that
it is judged by. The posterior odds are the evidence times the odds of the path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekit.llm import bytehash as bh
from tracekit.llm.shared import frugal, stored

UPPER = np.zeros(256, dtype=bool)
UPPER[0x41:0x5B] = True
LINE = np.ones(256, dtype=bool)
LINE[0x0A] = False


def form(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What a text looks like, a row each: the share of each ASCII character, size, capitals, and how far words and lines repeat."""
    n = np.diff(offsets)
    text = np.repeat(np.arange(n.size), n)
    share = np.bincount(text * 129 + np.minimum(data, 128), minlength=n.size * 129).reshape(n.size, 129)
    out = [np.sqrt(share / np.maximum(n, 1)[:, None]), np.log1p(n)[:, None]]
    for kind, value in ((bh.SOLID, bh.FOLDED), (LINE, bh.VALUE)):
        begins, stops, firsts = bh.words(data, offsets, kind)
        count = np.diff(firsts)
        h = bh.hashes(data, begins, stops, value)
        distinct = np.array([np.unique(h[firsts[k] : firsts[k + 1]]).size for k in range(n.size)])
        size = np.array([(stops[firsts[k] : firsts[k + 1]] - begins[firsts[k] : firsts[k + 1]]).sum() for k in range(n.size)])
        out += [np.log1p(count)[:, None], (distinct / np.maximum(count, 1))[:, None], np.log1p(size / np.maximum(count, 1))[:, None]]
    capital = np.bincount(text[UPPER[data]], minlength=n.size)
    return np.hstack([*out, (capital / np.maximum(n, 1))[:, None]])


def _features(rows: DataFrame) -> DataFrame:
    """``rows`` (text binary, then others) with features array<double> in the place of text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in bh.blocks(batch):
                f = form(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)), pa.array(f.ravel()))
                rest = [batch.column(k).slice(at.start, at.stop - at.start) for k in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([lists, *rest], ["features", *batch.schema.names[1:]])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(frugal(make), f"features array<double>, {shape}")


def _known(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(k, y): the label of each key that has one."""
    return labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.avg(label) >= 0.5).cast("double").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> tuple[np.ndarray, float, float] | None:
    """(weights, intercept, prior) of the regression, from at most about ``sample`` labelled rows chosen by a hash of the key; None without any labels.

    Only the fit is bounded so; everything else covers all rows.
    """
    known = _known(labels, key, label)
    total = known.count()
    if not total:
        return None
    chosen = known.where(F.expr(f"pmod(xxhash64(k, 17), 1000000) < {min(1.0, sample / total) * 1_000_000}"))
    rows = docs.select(F.col(text).cast("binary").alias("text"), F.col(key).alias("k")).join(F.broadcast(chosen), "k").select("text", "y")  # its size is bounded by ``sample``
    rows = stored(_features(rows).select(array_to_vector("features").alias("raw"), "y"), "sample")
    few = rows.groupBy("y").count().collect()
    prior = sum(r[0] * r[1] for r in few) / max(1, sum(r[1] for r in few))
    if len(few) < 2:
        return np.zeros(0), 0.0, prior
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows)
    model = LogisticRegression(labelCol="y", regParam=1e-3, maxIter=60).fit(scaler.transform(rows))
    std = scaler.std.toArray()
    weights = np.where(std > 0, model.coefficients.toArray() / np.where(std > 0, std, 1), 0)
    return weights, float(model.intercept - weights @ scaler.mean.toArray()), prior


def _strength(groups: DataFrame, parent: list[str]) -> float:
    """Labels that the prior counts as: variance within groups (.., n labels, s of them good) over the variance of their rates around their parents' (method of moments), 1 at least; 10 where the counts don't tell."""
    n, s = F.col("n").cast("double"), F.col("s").cast("double")
    per = groups.groupBy(*parent).agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(s - s * s / n).alias("w"), F.sum(s * s / n).alias("q"), F.sum(n * n).alias("nn"))
    sums = per.agg(F.sum(F.col("k") - 1).alias("df"), F.sum(F.col("n") - F.col("k")).alias("dw"), F.sum("w").alias("w"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") - F.col("nn") / F.col("n")).alias("n0")).first()
    if not sums.df or not sums.dw or not sums.n0:
        return 10.0
    within = max(sums.w / sums.dw, 1e-9)
    between = (sums.b - sums.df * within) / sums.n0
    return float(min(max(within / between if between > 0 else 1e6, 1.0), 1e6))


def rates(counts: DataFrame, marked: DataFrame) -> DataFrame:
    """``marked`` (host, path, y, ...) with host_rate and path_rate, from labels counted by path: ``counts`` (host, path, n, s), its own label y, if it has one, left out."""
    hosts = counts.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s")).first()
    of_hosts, of_paths = _strength(hosts, []), _strength(counts, ["host"])
    has, own = F.col("y").isNotNull().cast("int"), F.coalesce("y", F.lit(0.0))

    def left(name: str) -> F.Column:
        return F.coalesce(F.col(name), F.lit(0)) - (has if name.startswith("n") else own)

    out = marked.join(counts.withColumnsRenamed({"n": "n_path", "s": "s_path"}), ["host", "path"], "left").join(hosts.withColumnsRenamed({"n": "n_host", "s": "s_host"}), "host", "left")
    least = F.lit(total.n) - has
    overall = F.when(least > 0, (F.lit(total.s) - own) / least).otherwise(F.lit(0.5))
    out = out.withColumn("host_rate", (left("s_host") + F.lit(of_hosts) * overall) / (left("n_host") + F.lit(of_hosts)))
    return out.withColumn("path_rate", (left("s_path") + F.lit(of_paths) * F.col("host_rate")) / (left("n_path") + F.lit(of_paths)))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: tuple[str, ...] = ("source", "lang"), label: str = "quality", sample: int = 20000, threshold: float = 0.5) -> DataFrame:
    """(key, score, own, host_rate, path_rate, kept) for each row: the posterior probability of good quality, the text's own, the shrunk rates of labels of its host and path, and whether the score reaches the threshold.

    ``labels`` has rows (key, label 0/1); several for a key are averaged and count as good from 0.5, null ones are skipped, as are those of no document. Hosts and
    paths are groups by the named columns, nulls a group of their own. Null texts count as empty; a text is taken whole, however long. Without labels all scores are 0.5 and all rows are kept; with one class only, the
    text tells nothing and the path's rate is the score. Rows with one key stay separate, each with the label of the key. A score at the threshold is kept. An empty table gives an empty result. Other columns are ignored.
    """
    model = fit(docs, labels, key, text, label, sample)
    weights, intercept, prior = model if model else (np.zeros(0), 0.0, 0.5)
    base = float(np.log(max(prior, 1e-4) / max(1 - prior, 1e-4)))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for at, data, offsets in bh.blocks(batch):
                z = form(data, offsets) @ w + intercept if w.size else np.full(offsets.size - 1, base)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at.start, at.stop - at.start) for k in range(1, batch.num_columns)), pa.array(np.clip(z, -30, 30))], ["k", "host", "path", "z"])

    spelled = F.to_json(F.struct(F.lit(1).alias("a"), *[F.col(c).cast("string").alias(f"p{k}") for k, c in enumerate(path)]))
    rows = docs.select(F.col(text).cast("binary").alias("text"), F.col(key).alias("k"), F.to_json(F.struct(F.lit(1).alias("a"), F.col(host).cast("string").alias("h"))).alias("host"), spelled.alias("path"))
    kind = docs.schema[key].dataType.simpleString()
    marked = rows.mapInArrow(frugal(own), f"k {kind}, host string, path string, z double").join(_known(labels, key, label), "k", "left")
    marked = stored(marked, "scored")
    counts = stored(marked.where("y is not null").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("s")), "counts")
    out = rates(counts, marked)
    rate = F.least(F.greatest("path_rate", F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = F.col("z") - F.lit(base) + F.log(rate / (1 - rate))
    score = (1 / (1 + F.exp(-odds)) if model else F.lit(0.5)).alias("score")
    out = out.select(F.col("k").alias(key), score, (1 / (1 + F.exp(-F.col("z")))).alias("own"), "host_rate", "path_rate")
    return out.withColumn("kept", F.col("score") >= F.lit(threshold))
