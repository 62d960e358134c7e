"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded texts.

Folding takes letters that look alike to one letter (Cyrillic, Greek and full-width forms, digits and signs that stand for letters), so spellings meant to slip through
fall on the word they stand for. The lexicon is learned from labelled rows: words, and beginnings of words, that toxic texts hold more often than clean ones, each with a
weight, the lower bound of its log odds. Exception phrases, a match with the word before or after it that clean texts hold at least as often as toxic ones, take their match out. What is left,
summed and set against the length of the text, goes through a logistic curve fitted on labelled rows that the lexicon was not learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekit.llm.shared import frugal, stored

#: Letters of other scripts that look like Latin ones.
ALIKE = {
    "a": "аαɑ", "b": "Ьв", "c": "сϲ", "d": "ԁ", "e": "еεҽ", "g": "ɡ", "h": "һн", "i": "іιı", "j": "ј", "k": "кκ", "m": "мμ", "n": "пη", "o": "оοσ", "p": "рρ",
    "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ѡω", "x": "хχ", "y": "уγ", "z": "ᴢ",
}
#: Digits and signs in the place of letters; l, 1 and i are one.
FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
#: Characters that show nothing.
HIDDEN = "­​‌‍⁠﻿"
#: Shortest beginning of a word that the lexicon may hold, and the number of its lengths.
SHORTEST, LENGTHS = 4, 8


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {c: " " for c in [*range(0x80), *range(0x2010, 0x2060), *range(0x3000, 0x3004), 0xA0]}
    out |= {c: chr(c).lower() for c in range(0x41, 0x5B)} | {c: chr(c) for c in range(0x61, 0x7B)} | {c: chr(c) for c in range(0x30, 0x3A)}
    out |= {ord(x): latin for latin, some in ALIKE.items() for x in some}
    out |= {0xFF01 + k: out[0x21 + k] for k in range(94)}
    out |= {ord(x): None for x in HIDDEN}
    return {c: v and v.translate(str.maketrans(FOR)) for c, v in out.items()}


TABLE = _table()
#: A sign between word characters.
_SIGN = re.compile(r"(?<=[^\W_])[" + re.escape("".join(SIGNS)) + r"](?=[^\W_])")
_HAS_SIGN = re.compile("[" + re.escape("".join(SIGNS)) + "]")


def folded(text: str | None) -> list[str]:
    """The words of a text, folded: lower case, look-alikes as Latin letters, digits and inner signs as the letters they stand for."""
    if not text:
        return []
    text = text.lower()
    if _HAS_SIGN.search(text):
        text = _SIGN.sub(lambda m: SIGNS[m.group()], text)
    return text.translate(TABLE).split()


def forms(word: str) -> list[str]:
    """What the lexicon may hold of a word: the whole of it, with a blank on both sides, and its beginnings, with one before them."""
    return [f" {word} ", *(f" {word[:k]}" for k in range(SHORTEST, min(len(word), SHORTEST + LENGTHS)))]


@dataclass
class Lexicon:
    """Weights of forms, exception phrases (folded words between blanks), and the curve: a weight for each feature and an intercept."""

    weights: dict[str, float]
    exceptions: frozenset[str]
    curve: np.ndarray
    intercept: float

    def automaton(self) -> ahocorasick.Automaton | None:
        out = ahocorasick.Automaton()
        for form, w in self.weights.items():
            out.add_word(form, (len(form), w))
        for phrase in self.exceptions:
            if phrase not in self.weights:
                out.add_word(phrase, (len(phrase), None))
        if not len(out):
            return None
        out.make_automaton()
        return out


def matches(words: list[str], automaton: ahocorasick.Automaton | None) -> list[tuple[int, int, float]]:
    """(start, end, weight) in the joined words of each match: the longest form at each word, but for those inside an exception phrase."""
    if automaton is None or not words:
        return []
    found: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for last, (size, weight) in automaton.iter(" " + " ".join(words) + " "):
        start = last - size + 1
        if weight is None:
            spared.append((start, last + 1))
        else:
            found[start] = (last + 1, weight)  # ends rise, so the longest stays
    out = [(a, b, w) for a, (b, w) in found.items()]
    if not spared:
        return out
    # exceptions sorted by start, with the furthest end up to each
    spared.sort()
    starts, reach = np.array([a for a, _ in spared]), np.maximum.accumulate([b for _, b in spared])
    at = np.searchsorted(starts, [a for a, _, _ in out], side="right") - 1
    return [m for m, k in zip(out, at.tolist(), strict=True) if k < 0 or reach[k] < m[1]]


def features(weights: list[float], words: int) -> list[float]:
    """What the curve sees: the sum of weights, that a word, that against the root of the length, and the largest."""
    total = sum(weights)
    return [float(np.log1p(total)), float(np.log1p(100 * total / max(1, words))), total / max(1, words) ** 0.5, max(weights, default=0.0)]


def _counts(rows: DataFrame, told: str, shared) -> DataFrame:
    """(form, toxic, clean): how many toxic and clean texts hold each form (``told`` = forms), or each phrase of a match with a neighbour (phrases)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton() if shared else None
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = folded(text.as_py())
                if told == "forms":
                    seen = {f for w in set(words) for f in forms(w)}
                else:
                    line = " " + " ".join(words) + " "
                    seen = set()
                    for a, _, _ in matches(words, automaton):
                        end = line.index(" ", a + 1)
                        before, after = line.rfind(" ", 0, a), line.find(" ", end + 1)
                        if before >= 0 and a > 0:
                            seen.add(line[before : end + 1])
                        if after > end:
                            seen.add(line[a : after + 1])
                (toxic if y else clean).update(seen)
            both = sorted(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([toxic[f] for f in both], pa.int64()), pa.array([clean[f] for f in both], pa.int64())], ["form", "toxic", "clean"])

    return rows.mapInArrow(frugal(count), "form string, toxic long, clean long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon_of(rows: DataFrame, least: int, size: int, sure: float) -> dict[str, float]:
    """Weights of at most ``size`` forms of the texts of ``rows`` (text, y): log odds of toxic against clean texts less ``sure`` standard errors, where that is over log 3 and ``least`` toxic texts hold the form.

    A longer form stays only if it weighs more than each of its beginnings that stay.
    """
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    bound = F.log(t / (n.get(1, 0) + 1.0)) - F.log(c / (n.get(0, 0) + 1.0)) - sure * F.sqrt(1 / t + 1 / c)
    told = _counts(rows, "forms", None).where(F.col("toxic") >= least).select("form", bound.alias("w")).where(F.col("w") > float(np.log(3)))
    best = {r["form"]: r["w"] for r in told.orderBy(F.desc("w"), "form").limit(size).collect()}  # the size of the lexicon is a parameter of the model
    out: dict[str, float] = {}
    for form in sorted(best, key=len):
        stem = form.rstrip(" ")
        if all(best[form] > out.get(stem[:k], -1.0) for k in range(SHORTEST + 1, len(stem) + 1)):
            out[form] = float(best[form])
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 20000, least: int = 4, size: int = 5000, sure: float = 1.64) -> Lexicon:
    """The lexicon learned from at most about ``sample`` labelled rows (two thirds for the words and exceptions, a third for the curve), chosen by a hash of the key.

    Labels of one key are averaged and count as toxic from 0.5; null ones and those of no row are skipped. Only the fit is bounded. Without rows of both classes
    the lexicon is empty and all texts score the share of toxic rows (0 without any).
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    total = known.count()
    chosen = known.where(F.expr(f"pmod(xxhash64(k, 29), 1000000) < {min(1.0, sample / max(1, total)) * 1_000_000}"))
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(key).alias("k")).join(F.broadcast(chosen), "k")  # its size is bounded by ``sample``
    rows = stored(rows.select("text", "y", F.expr("pmod(xxhash64(k, 31), 3)").alias("part")), "labelled")
    few = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = few.get(1, 0) / max(1, sum(few.values()))
    plain = Lexicon({}, frozenset(), np.zeros(4), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if len(few) < 2:
        return plain
    learn, curve = rows.where("part < 2").select("text", "y"), rows.where("part = 2").select("text", "y")
    weights = lexicon_of(learn, least, size, sure)
    if not weights:
        return plain
    bare = Lexicon(weights, frozenset(), plain.curve, plain.intercept)
    sc = docs.sparkSession.sparkContext
    phrases = _counts(learn, "phrases", sc.broadcast(bare)).where(F.col("clean") >= least)
    n = {r["y"]: r["n"] for r in learn.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = (F.col("toxic") + 0.5) / (n.get(1, 0) + 1.0) <= (F.col("clean") + 0.5) / (n.get(0, 0) + 1.0)
    spared = frozenset(r["form"] for r in phrases.where(rate).orderBy(F.desc("clean"), "form").limit(size).collect())
    lexicon = Lexicon(weights, spared, plain.curve, plain.intercept)
    seen = stored(scored(curve, lexicon, ["y"]).select(array_to_vector("features").alias("features"), F.col("y").cast("double").alias("y")), "curve")
    if seen.select("y").distinct().count() < 2:
        return plain
    model = LogisticRegression(labelCol="y", regParam=1e-3, maxIter=100).fit(seen)
    return Lexicon(weights, spared, model.coefficients.toArray(), float(model.intercept))


def scored(docs: DataFrame, lexicon: Lexicon, carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry`` with score (0 to 1), predicted (1 from 0.5 on), features, and matches: the words' places in the folded text and weights."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    inner = [f"c{k}" for k in range(len(carry))]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        automaton = lexicon.automaton()
        for batch in batches:
            seen, hits = [], []
            for t in batch.column(0):
                words = folded(t.as_py())
                found = matches(words, automaton)
                seen.append(features([w for _, _, w in found], len(words)))
                hits.append([{"start": a, "stop": b, "weight": w} for a, b, w in found])
            f = np.array(seen).reshape(-1, 4)
            z = np.clip(f @ lexicon.curve + lexicon.intercept, -30, 30)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, 4, dtype=np.int32)), pa.array(f.ravel()))
            spans = pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("weight", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(1 / (1 + np.exp(-z))), lists, spans], [*inner, "score", "features", "matches"])

    rows = docs.select(F.col(text).cast("string").alias("text"), *[F.col(c).alias(i) for i, c in zip(inner, carry, strict=True)])
    shape = "".join(f"{i} {docs.schema[c].dataType.simpleString()}, " for i, c in zip(inner, carry, strict=True))
    out = rows.mapInArrow(frugal(tell), f"{shape}score double, features array<double>, matches array<struct<start: long, stop: long, weight: double>>")
    return out.toDF(*carry, "score", "features", "matches").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, learn: DataFrame | None = None, carry: tuple[str, ...] = ("doc_id",), key: str = "doc_id", text: str = "text", label: str = "toxic", **fitting) -> DataFrame:
    """``carry`` with score, predicted, features and matches for each row of ``docs``, by a lexicon fitted on ``labels`` of the rows ``learn`` (all of ``docs`` if not given).

    Only the text is looked at, whole, however long; null and empty texts match nothing and score what the curve gives to that. Rows with one key stay separate and have the
    same score if their texts are the same. Ties at 0.5 count as toxic. An empty table gives an empty result, and other columns are ignored.
    """
    return scored(docs, fit(docs if learn is None else learn, labels, key, text, label, **fitting), list(carry), text)
