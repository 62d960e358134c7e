"""Ranked search, collocations and toxicity against plain re-statements, with awkward tables."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracekit.llm import collocations, lexical, toxicity

DRAW = random.Random(31)
WORDS = ["the", "of", "sand", "Rain", "HARBOUR", "été", "x1", "night", "a-b", "naïve", "fox"]


def some_text(n):
    return "".join(DRAW.choice(WORDS) + DRAW.choice([" ", " ", " ", ", ", ".\n", "\t", "  "]) for _ in range(n))


# --- ranked search


def terms(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]


def plain_ranks(docs, items, keep):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    big_n, big_l = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, t in items:
        found = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * big_n // big_l
            score = sum(math.floor(1000 * math.log((2.0 * big_n + 2) / (2.0 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(t) if w in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:keep])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def searched():
    docs = [(i, some_text(DRAW.randrange(1, 60))) for i in range(150)] + [(i, "copy of the sand") for i in range(150, 190)]
    docs += [(190, None), (191, ""), (192, "?!"), (None, "sand sand"), (7, "Rain fox"), (7, "Rain fox"), (193, "sand night " * 4000)]
    items = [(i, some_text(DRAW.randrange(1, 12))) for i in range(12)] + [(12, None), (13, "..."), (14, "nowhere"), (14, "sand SAND sand"), (None, "été fox")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_ranks(spark, searched, small, monkeypatch):
    """Whole, and with segments, groups, steps and blocks of items so small that all are cut."""
    docs, items = searched
    if small:
        for name, size in (("SEGMENT", 500), ("TOGETHER", 60), ("STEP", 50), ("TERMS", 9)):
            monkeypatch.setattr(lexical, name, size)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("rank", F.lit("clash")).withColumn("score", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = lexical.search(lexical.index(d), b, keep=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_ranks(docs, items, 5)


def test_search_of_nothing(spark):
    d, b = spark.createDataFrame([(1, "sand")], "doc_id long, text string"), spark.createDataFrame([(1, "sand")], "item_id long, text string")
    assert lexical.search(lexical.index(d.limit(0)), b).count() == 0
    assert lexical.search(lexical.index(d), b.limit(0)).count() == 0
    assert lexical.search(lexical.index(d.withColumn("text", F.lit(None).cast("string"))), b).count() == 0


def test_strata_are_grouped_by_normaliser(spark, searched):
    found = lexical.index(spark.createDataFrame(searched[0], "doc_id long, text string").coalesce(1))
    rows = found.strata.collect()
    assert len({r.m for r in rows}) == len(rows) > 3 and [r.m for r in rows] == sorted(r.m for r in rows)
    for r in rows:
        assert r.terms == sorted(set(r.terms)) and len(r.tfs) == len(r.sizes) == sum(r.groups) and len(r.docs) == sum(r.sizes)


# --- collocations


def plain_collocations(docs, least, longest, keep):
    f, n = {}, Counter()
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for s in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[s : s + k])] += 1
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inner = {p[i:j] for p, a in some.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and c[p[i:j]] <= a}
        rows = []
        for p, a in some.items():
            if p not in inner:
                score, cut = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), cut, p))
        for rank, (score, a, phrase, cut, p) in enumerate(sorted(rows)[:keep]):
            out.append((lang, rank + 1, phrase.decode(), -a, c[p[:cut]], c[p[cut:]], n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(collocations, "TEXT", 300)
        monkeypatch.setattr(collocations, "DEAL", 2)
    fixed = ["of the sand harbour night", "x1 fox rain", "of the"]
    docs = [(" ".join(DRAW.choice(fixed) if DRAW.random() < 0.3 else some_text(3) for _ in range(DRAW.randrange(1, 30))), DRAW.choice(["en", "fr", None, "und"])) for _ in range(120)]
    docs += [("a copy, of the same text here again now", "en")] * 30 + [(None, "en"), ("", "fr"), ("...", None), ("one", "de"), ("long words " * 3000, "fr"), ("the " * 500, "en")]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(4).withColumn("rank", F.lit(0)).withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(None).cast("string"))
    for least, keep in ((12, 2000), (5, 7)):
        got = collocations.collocations(df, least=least, keep=keep)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        want = plain_collocations(docs, least, 5, keep)
        assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 10


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([("some words", "en")], "text string, lang string")
    assert collocations.collocations(df).count() == 0 and collocations.collocations(df.limit(0)).count() == 0


def test_scores_pass_64_bits(spark):
    """Counts of a size that a corpus of many terabytes would give."""
    big = 3 * 10**12
    phrases = spark.createDataFrame([("en", 7, big, 2, 1, 2)], "lang string, key long, n long, k int, p1 long, s1 long")
    words = spark.createDataFrame([("en", 1, big + 5), ("en", 2, big + 9)], "lang string, key long, n long")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    out = collocations.scored(phrases, words, totals, 2).first()
    assert out.score == 1000 * big * 10**15 // ((big + 5) * (big + 9)) and (out.l, out.r) == (big + 5, big + 9)


# --- toxicity


def test_folding():
    for spelled in ("idiot", "IDIOT", "1d10t", "idi0t", "іdіоt", "ｉｄｉｏｔ", "id​iot", "!d!ot".replace("!d", "id"), "i|diot".replace("|", "")):
        assert toxicity.folded(f"You {spelled}.") == toxicity.folded("you idiot"), spelled
    assert toxicity.folded("cl@ss $ 5! a!") == ["ciass", "s", "a"]
    assert toxicity.folded("réêou") == ["réêou"] and toxicity.folded(None) == toxicity.folded("") == [] == toxicity.folded(" .,")


def plain_matches(words, weights, exceptions):
    line = " " + " ".join(words) + " "
    spared = [(m.start(), m.start() + len(e)) for e in exceptions for m in re.finditer(f"(?={re.escape(e)})", line)]
    best = {}
    for f, w in weights.items():
        for m in re.finditer(f"(?={re.escape(f)})", line):
            if len(f) > best.get(m.start(), (0, 0))[0]:
                best[m.start()] = (len(f), w)
    return sorted((a, a + n, w) for a, (n, w) in best.items() if not any(x <= a and a + n <= y for x, y in spared))


def test_matches():
    for _ in range(300):
        words = ["".join(DRAW.choice("ab") for _ in range(DRAW.randrange(1, 7))) for _ in range(DRAW.randrange(12))]
        forms = {f for w in words + ["abab", "bb"] for f in toxicity.forms(w)}
        weights = {f: DRAW.random() for f in DRAW.sample(sorted(forms), min(4, len(forms)))}
        pairs = [f" {a} {b} " for a, b in zip(words, words[1:], strict=False)]
        exceptions = frozenset(DRAW.sample(pairs, min(2, len(pairs))))
        lexicon = toxicity.Lexicon(weights, exceptions, None, 0.0)
        assert sorted(toxicity.matches(words, lexicon.automaton())) == plain_matches(words, weights, exceptions)


@pytest.fixture(scope="module")
def judged(spark):
    """``scum`` and ``moron`` are toxic, but ``pond scum`` is not; words of their own in all texts."""
    rows = []
    for i in range(600):
        words = [DRAW.choice(["sand", "rain", "harbour", "night", "fox", "wall"]) for _ in range(DRAW.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(DRAW.randrange(len(words) + 1), DRAW.choice(["scum", "moron", "m0ron", "ЅCUM".replace("Ѕ", "S")]))
        elif i % 12 == 1:
            words += ["pond", "scum"]
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), rows


def test_held_out_texts(spark, judged):
    docs, labels, rows = judged
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels, docs.where("doc_id % 5 <> 0")).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    right = sum(out[i].predicted == y for i, _, y in held)
    assert right >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in out.values())
    lexicon = toxicity.fit(docs, labels)
    assert " scum " in lexicon.weights and any("pond scum" in e for e in lexicon.exceptions)


def test_awkward_texts(spark, judged):
    docs, labels, _ = judged
    rows = [(1, None), (2, ""), (3, "m0r0n scum"), (3, "m0r0n scum"), (None, "pond scum"), (4, "sand " * 60000 + "moron"), (5, "​")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("matches", F.lit(1))
    out = toxicity.toxicity(df, labels, docs).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert len(out) == 7 and len({r.score for r in by[3]}) == 1 and by[3][0].predicted == 1 and by[None][0].matches == []
    assert by[1][0].score == by[2][0].score == by[5][0].score and by[4][0].matches[0].start == 5 * 60000
    assert toxicity.toxicity(df.limit(0), labels, docs).count() == 0


def test_without_labels(spark, judged):
    docs, labels, _ = judged
    few = docs.limit(3)
    assert {r.score < 1e-6 and r.predicted for r in toxicity.toxicity(few, labels.limit(0), docs).collect()} == {0}
    assert {r.predicted for r in toxicity.toxicity(few, labels.where("toxic = 1"), docs).collect()} == {1}
    twice = labels.union(spark.createDataFrame([(None, 1), (1, None), (10**9, 1)], labels.schema))
    assert toxicity.toxicity(few, twice, docs).count() == 3
