"""Language mixtures of documents by expectation maximisation over n-gram likelihoods.

Each language has a model of byte trigrams within words (hashed to a fixed number of slots, smoothed). A
document is a mixture of languages; each of its words comes from one of them. Expectation
maximisation estimates the proportions from the words' likelihoods. Languages enter in the
order of their share as long as the likelihood, less a penalty for each language, grows; the answer is the language with
the largest share of the selected set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekit.llm import bytehash as bh

SLOTS = 1 << 15
UNKNOWN = "und"
#: Bytes as the models see them: A-Z as a-z, all other ASCII but letters as one blank.
SEEN = np.full(256, 0x20, dtype=np.uint8)
SEEN[0x61:0x7B] = np.arange(0x61, 0x7B)
SEEN[0x41:0x5B] = np.arange(0x61, 0x7B)
SEEN[0x80:] = np.arange(0x80, 0x100)
_SALT = (bh.VALUE[:, None] * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Models:
    names: list[str]
    #: log probability of each slot (rows) in each language
    table: np.ndarray


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the trigrams around each letter, where each word's begin, and the number of the first word of each text."""
    n = np.diff(offsets)
    text = np.repeat(np.arange(n.size), n)
    apart = np.full(data.size + n.size + 1, 0x20, dtype=np.uint8)  # a blank between texts
    apart[np.arange(data.size) + text + 1] = SEEN[data]
    mix = _SALT[apart[:-2], 0] + _SALT[apart[1:-1], 1] + _SALT[apart[2:], 2]
    mix ^= mix >> np.uint32(15)
    slot = (mix * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    letter = apart[1:-1] != 0x20
    begin = letter & (apart[:-2] == 0x20)
    at = np.flatnonzero(letter)
    first = np.searchsorted(at, np.flatnonzero(begin))
    starts = offsets + np.arange(offsets.size)
    return slot[at], first, np.searchsorted(np.flatnonzero(begin), starts)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> Models:
    """Models of all languages that ``lang`` names, from all rows of ``labelled`` with a language and a text.

    Counts are summed by task before they are shuffled; the driver gets at most ``SLOTS`` numbers a language, so the table grows with
    the languages (3000 of them are 800 MB), but not with the rows. Rows without a text or a language teach nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name in batch.column(1).unique().to_pylist():
                of = batch.filter(pa.compute.equal(batch.column(1), name))
                here = total.setdefault(name, np.zeros(SLOTS, dtype=np.int64))
                for _, data, offsets in bh.blocks(of):
                    here += np.bincount(_grams(data, offsets)[0], minlength=SLOTS)
        for name, c in total.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * some.size, pa.string()), pa.array(some), pa.array(c[some])], ["lang", "slot", "n"])
            if not some.size:
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([0]), pa.array([0])], ["lang", "slot", "n"])

    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("binary").alias("text"), F.col(lang).alias("lang"))
    got = rows.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(got["lang"].unique())
    table = np.full((SLOTS, max(1, len(names))), smoothing)
    at = {name: k for k, name in enumerate(names)}
    np.add.at(table, (got["slot"].to_numpy(dtype=np.int64), got["lang"].map(at).to_numpy(dtype=np.int64)), got["n"].to_numpy(dtype=float))
    return Models(names, np.log(table / table.sum(axis=0)).astype(np.float32))


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of each text; first has one more at the end."""
    out = np.zeros((first.size - 1, *x.shape[1:]), dtype=np.float64)
    some = np.flatnonzero(np.diff(first))
    if some.size:
        out[some] = np.add.reduceat(x, first[:-1][some], axis=0)
    return out


def _mixture(like: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each text, and the log likelihood (less the words' offsets)."""
    n = np.diff(first)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    norm = None
    for k in range(rounds + 1):
        part = like * np.repeat(share, n, axis=0).astype(np.float32)
        norm = part.sum(axis=1)
        np.maximum(norm, np.float32(1e-37), out=norm)
        if k == rounds:
            break
        part /= norm[:, None]
        share = _sums(part, first) / np.maximum(n, 1)[:, None]
    return share, _sums(np.log(norm), first)


def mixtures(data: np.ndarray, offsets: np.ndarray, models: Models, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text's selected languages (0 for the others), and its number of words."""
    slot, word, first = _grams(data, offsets)
    n = np.diff(first)
    if not word.size or not models.names:
        return np.zeros((n.size, len(models.names))), n
    score = np.add.reduceat(models.table[slot], word, axis=0)
    top = score.max(axis=1, keepdims=True)
    like = np.exp(score - top)
    total = _sums(score - top, first)
    languages = len(models.names)
    alone = total.argmax(axis=1)
    best = np.zeros((n.size, languages))
    best[np.arange(n.size), alone] = 1
    value = total[np.arange(n.size), alone]
    share, _ = _mixture(like, first, np.ones((n.size, languages)), rounds)
    share[np.arange(n.size), alone] += 1  # the best single language comes first
    order = np.argsort(-share, axis=1, kind="stable")
    live = np.flatnonzero(n > 1)
    for k in range(2, languages + 1):
        if not live.size:
            break
        allowed = np.zeros((live.size, languages))
        allowed[np.arange(live.size)[:, None], order[live, :k]] = 1
        rows = np.repeat(first[live], n[live]) + np.arange(int(n[live].sum())) - np.repeat(np.cumsum(n[live]) - n[live], n[live])
        edges = np.concatenate([[0], np.cumsum(n[live])])
        share, value_k = _mixture(like[rows], edges, allowed, rounds)
        value_k -= penalty * (k - 1) * np.log(n[live])
        better = value_k > value[live]
        live, share, value_k = live[better], share[better], value_k[better]
        best[live], value[live] = share, value_k
    best[n == 0] = 0
    return best, n


def predict(docs: DataFrame, models: Models, carry: list[str], text: str = "text", rounds: int = 10, penalty: float = 2.0) -> DataFrame:
    """The columns ``carry`` with lang_pred, score and proportions (map) of each row's whole text.

    lang_pred is ``und`` with score 0 if the text is null or has no letter (or no language was learned);
    the score is the language's share of the words. A text without ASCII letters whose other characters are letters counts as having some. Ties go to the
    language that sorts first. Only the text is looked at, whole, however long; rows are independent, so repeated ones have the same answer, and an empty table gives
    an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            name, score, parts = [], [], []
            for rows, data, offsets in bh.blocks(batch):
                share, words = mixtures(data, offsets, m, rounds_, penalty)
                some = np.add.reduceat(np.append((SEEN[data] < 0x80) & (SEEN[data] != 0x20), False).astype(np.int64), offsets[:-1]) if data.size else np.zeros(words.size)
                some = np.where(np.diff(offsets) > 0, some, 0)
                for k in range(words.size):
                    known = bool(m.names) and words[k] > 0 and (some[k] > 0 or any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")))
                    top = int(share[k].argmax()) if known else 0
                    name.append(m.names[top] if known else UNKNOWN)
                    score.append(float(min(1.0, share[k, top])) if known else 0.0)
                    parts.append([(m.names[j], float(share[k, j])) for j in np.flatnonzero(share[k] > 0)] if known else [])
            kept = [batch.column(j) for j in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(parts, pa.map_(pa.string(), pa.float64()))], [*inner, "lang_pred", "score", "proportions"])

    rounds_, inner = rounds, [f"c{k}" for k in range(len(carry))]
    rows = docs.select(F.col(text).cast("binary").alias("text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)])
    shape = ", ".join(f"{i} {docs.schema[c].dataType.simpleString()}" for i, c in zip(inner, carry, strict=True))
    out = rows.mapInArrow(tell, f"{shape}, lang_pred string, score double, proportions map<string, double>")
    return out.toDF(*carry, "lang_pred", "score", "proportions")
