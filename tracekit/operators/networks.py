"""A small network for a 0/1 label, trained with a weighted loss until a held-out part of the rows no longer gets better.

Each round is one pass: tasks add up the gradients of the rows they hold and the loss of held-out rows, and the driver, which gets one sum a task, moves the weights. Rows count by the size
of their class, so both classes weigh the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekit.sources.scratch import written


@dataclass
class Network:
    """Weights and shifts by layer, the scale of the inputs, and the held-out loss of each round."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray
    scale: np.ndarray
    losses: list[float]

    def states(self, x: np.ndarray) -> list[np.ndarray]:
        """The input, scaled, and what each layer gives: rectified, the last one as the odds of label 1."""
        out = [(x - self.mean) / self.scale]
        for k, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(z if k == len(self.layers) - 1 else np.maximum(z, 0))
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.states(x)[-1][:, 0], -30, 30)))


def _loss(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float(-(weight * np.log(np.where(y == 1, p, 1 - p) + 1e-12)).sum())


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Sums over the rows of the slopes of the weighted loss, by layer."""
    states = net.states(x)
    back = ((1 / (1 + np.exp(-np.clip(states[-1][:, 0], -30, 30))) - y) * weight)[:, None]
    out: list[np.ndarray] = []
    for k in range(len(net.layers) - 1, -1, -1):
        out += [back.sum(axis=0), states[k].T @ back]
        if k:
            back = (back @ net.layers[k][0].T) * (states[k] > 0)
    return out[::-1]


def train(df: DataFrame, vector: str, label: str, hidden: tuple[int, ...] = (16, 8), rounds: int = 200, patience: int = 12, held: float = 0.2, rate: float = 0.03, seed: int = 3) -> Network:
    """The network of the round with the smallest held-out loss; training ends when ``patience`` rounds in a row bring none that is smaller. Rows are held out by a hash of their vectors."""
    part = F.pmod(F.xxhash64(F.lit(seed), vector), F.lit(1000)) < held * 1000
    rows = written(df.select(F.transform(vector, lambda x: x.cast("double")).alias("x"), F.col(label).cast("double").alias("y"), part.alias("held")), "examples")
    width = len(rows.select("x").first()[0])
    sums = [g(F.col("x")[c]) for c in range(width) for g in (F.avg, F.stddev_pop)]
    told = rows.where("not held").agg(F.avg("y"), *sums).first()
    share = min(max(told[0] or 0.0, 1e-6), 1 - 1e-6)
    by = {1.0: 0.5 / share, 0.0: 0.5 / (1 - share)}
    draw, sizes = np.random.default_rng(seed), [width, *hidden, 1]
    layers = [(draw.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    net = Network(layers, np.array(told[1::2], dtype=float), np.array([s or 1.0 for s in told[2::2]]), [])
    flat = [w for layer in net.layers for w in layer]
    first, second = [np.zeros_like(w) for w in flat], [np.zeros_like(w) for w in flat]
    best, since = [w.copy() for w in flat], 0
    sc = df.sparkSession.sparkContext

    for step in range(1, rounds + 1):
        shared = sc.broadcast(net)

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            net = shared.value
            total, n, loss, m = [np.zeros_like(w) for layer in net.layers for w in layer], 0, 0.0, 0
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, out = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
                weight = np.where(y == 1, by[1.0], by[0.0])
                for t, g in zip(total, gradients(net, x[~out], y[~out], weight[~out]), strict=True):
                    t += g
                n += int((~out).sum())
                loss += _loss(net.probability(x[out]), y[out], weight[out])
                m += int(out.sum())
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([t.ravel() for t in total]).tobytes()]), pa.array([n]), pa.array([loss]), pa.array([m])], ["slopes", "n", "loss", "m"])

        parts = rows.mapInArrow(look, "slopes binary, n long, loss double, m long").collect()  # a row of as many numbers as the network has for each task
        shared.unpersist()
        n, m = sum(r.n for r in parts), sum(r.m for r in parts)
        net.losses.append(sum(r.loss for r in parts) / max(1, m))
        if len(net.losses) == 1 or net.losses[-1] < min(net.losses[:-1]):
            best, since = [w.copy() for w in flat], 0
        else:
            since += 1
            if since >= patience:
                break
        slope, at = sum(np.frombuffer(r.slopes) for r in parts) / max(1, n), 0
        for w, a, b in zip(flat, first, second, strict=True):
            g = slope[at : at + w.size].reshape(w.shape)
            at += w.size
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    for w, was in zip(flat, best, strict=True):
        w[...] = was
    return net


def scored(net: Network, df: DataFrame, vector: str, threshold: float = 0.5) -> DataFrame:
    """df with ``score``, the probability of label 1, and ``accepted``."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy().reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shared.value.probability(x) if b.num_rows else np.zeros(0))], [*b.schema.names[:-1], "score"])

    shape = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in df.columns)
    asked = df.select("*", F.transform(vector, lambda x: x.cast("double")).alias("_x"))
    return asked.mapInArrow(tell, f"{shape}score double").withColumn("accepted", F.col("score") >= threshold)
