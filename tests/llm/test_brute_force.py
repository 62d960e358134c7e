"""Operators without SQL against plain re-statements of what they compute, on small fixtures."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracekit.llm import bytehash as bh
from tracekit.llm import fingerprint, html_text, language, licenses, quality, queries, shared, tool_calls

DRAW = random.Random(11)
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- 1: mixtures


def mixture_of(text, models, rounds=10, penalty=2.0):
    """Expectation maximisation word by word, with all the sets of languages that are nested in the order of their shares."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    slot, first, _ = language._grams(data, np.array([0, data.size]))
    words = [slot[a:b] for a, b in zip(first, [*first[1:], slot.size])]
    logs = [[float(sum(models.table[s, k] for s in w)) for k in range(len(models.names))] for w in words]

    def fit(allowed):
        share = {k: 1 / len(allowed) for k in allowed}
        for _ in range(rounds):
            new = dict.fromkeys(allowed, 0.0)
            for w in logs:
                top = max(w)
                part = {k: share[k] * math.exp(w[k] - top) for k in allowed}
                total = sum(part.values()) or 1e-37
                for k in allowed:
                    new[k] += part[k] / total / len(logs)
            share = new
        return share, sum(math.log(max(sum(share[k] * math.exp(w[k] - max(w)) for k in allowed), 1e-37)) for w in logs)

    alone = [sum(w[k] - max(w) for w in logs) for k in range(len(models.names))]
    best = max(range(len(alone)), key=lambda k: alone[k])
    chosen, value = {best: 1.0}, alone[best]
    share, _ = fit(range(len(models.names)))
    order = sorted(share, key=lambda k: (-share[k] - (k == best), k))
    for n in range(2, len(order) + 1):
        if len(words) < 2:
            break
        part, got = fit(order[:n])
        got -= penalty * (n - 1) * math.log(len(words))
        if got <= value:
            break
        chosen, value = part, got
    return {models.names[k]: v for k, v in chosen.items()}


def test_mixtures(spark):
    en = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions near the harbour wall"
    de = "der schnelle braune Fuchs springt über den faulen Hund während sieben Zauberer leise Tränke an der Mauer mischen"
    fr = "le rapide renard brun saute par dessus le chien paresseux tandis que sept sorciers préparent des potions"
    docs = spark.createDataFrame([(1, en, "en"), (2, de, "de"), (3, fr, "fr")], "doc_id long, text string, lang string")
    models = language.fit(docs)
    texts = [en, de + " " + en, fr + " " + de, en + " " + de + " " + fr, "Hund dog", "chien", (en + " ") * 400 + de, "the der le"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language.predict(rows, models, ["doc_id"]).collect():
        want = mixture_of(texts[r.doc_id], models)
        assert r.proportions.keys() == {k for k, v in want.items() if v > 0}, r.doc_id
        assert all(abs(r.proportions[k] - v) < 2e-3 for k, v in want.items() if v > 0)
        assert r.lang_pred == max(sorted(want), key=lambda k: want[k]) and abs(r.score - max(want.values())) < 2e-3


# --- 4: calls


def longest(calls, edges):
    up = {c: {p for a, p in edges if a == c and p in calls} for c in calls}
    depth: dict = {}
    while True:
        new = {c: max((depth[p] + 1 for p in up[c]), default=0) for c in calls if c not in depth and all(p in depth for p in up[c])}
        if not new:
            return {c: depth.get(c) for c in calls}
        depth.update(new)


def test_depths_of_random_graphs(spark):
    rows, want = [], {}
    for conv in range(30):
        n = DRAW.choice([1, 2, 5, 9])
        calls = DRAW.sample(range(100), n)
        edges = {(calls[i], calls[DRAW.randrange(i)]) for i in range(1, n) for _ in range(DRAW.choice([0, 1, 1, 2, 3]))}
        if conv % 3 == 0 and n > 2:
            edges |= {(calls[0], calls[-1]), (calls[1], calls[1]), (calls[0], 999)}
        for c, d in longest(set(calls), edges).items():
            want[conv, c] = d
        rows += [(conv, a, b) for a, b in edges]
    calls = spark.createDataFrame(list(want), "conv long, call long")
    got = {(r.conv, r.call): r.depth for r in tool_calls.depths(calls, spark.createDataFrame(rows, "conv long, call long, parent long")).collect()}
    assert got == want
    ladder = [(0, k, k - d) for k in range(1, 7) for d in (1, 2, 5)] + [(1, k, k - d) for k in range(1, 300) for d in ((1, 2, 3) if k % 4 == 0 else (1,))]
    got = {r.call: r.depth for r in tool_calls.depths(spark.createDataFrame([(0, k) for k in range(7)] + [(1, k) for k in range(300)], "conv long, call long"), spark.createDataFrame(ladder, "conv long, call long, parent long")).collect()}
    assert got == {k: k for k in range(300)}


def wrong(value, schema, path=""):
    kinds = {"string": lambda v: isinstance(v, str), "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "boolean": lambda v: isinstance(v, bool), "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "null": lambda v: v is None}
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else types
    out = []
    if types and not any(kinds[t](value) for t in types):
        out.append(f"{path}: not {' or '.join(types)}")
    if "enum" in schema and not any(value == x and isinstance(value, bool) == isinstance(x, bool) for x in schema["enum"]):
        out.append(f"{path}: not one of the values")
    begin = f"{path}." if path else ""
    if isinstance(value, dict) and ("properties" in schema or "required" in schema):
        props = schema.get("properties", {})
        out += [f"{begin}{p}: missing" for p in schema.get("required", []) if p not in value]
        for p, v in value.items():
            if p in props:
                out += wrong(v, props[p], begin + p)
            elif not schema.get("additionalProperties", False):
                out.append(f"{begin}{p}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += wrong(v, schema["items"], f"{path}[{i}]")
    return sorted(out)


def plain_json(v):
    if isinstance(v, dict):
        return {k: plain_json(x) for k, x in v.items()}
    if isinstance(v, list):
        return [plain_json(x) for x in v]
    return int(v) if isinstance(v, float) and v == int(v) and abs(v) < 1e7 else v


SCHEMAS = {
    "deep": {"properties": {"it's": {"type": "string"}, "n": {"type": ["integer", "null"]}, "kind": {"enum": ["a", 1, None, True]}, "at": {"properties": {"x": {"type": "number"}, "y": {"type": "number"}}, "required": ["x"]}, "list": {"type": "array", "items": {"type": "object", "properties": {"id": {"type": "integer"}}, "required": ["id"]}}, "any": {}}, "required": ["n"]},
    "open": {"properties": {"a": {"type": "boolean"}}, "additionalProperties": True},
}
ARGUMENTS = [
    {"n": 1}, {"n": None}, {"n": 1.5}, {"n": 2.0, "it's": "x 1.0 \"y 2.0\" \\"}, {"it's": 3}, {"n": 1, "kind": "a"}, {"n": 1, "kind": 1.0}, {"n": 1, "kind": None}, {"n": 1, "kind": True}, {"n": 1, "kind": "b"},
    {"n": 1, "at": {"y": 2}}, {"n": 1, "at": {"x": "q", "z": 1}}, {"n": 1, "at": 4}, {"n": 1, "list": [{"id": 1}, {"id": "1"}, 3, {"no": 1}]}, {"n": 1, "list": {}}, {"n": 1, "any": {"deep": [1, 2.0, {"x": None}]}}, {"more": 1, "n": 7}, {"a": 1, "b": 2}, {"a": True}, {}, {"n": 1, "list": []},
]


def test_nested_arguments(spark):
    rows = [(1, 10 * k + j, tool, json.dumps(a)) for k, a in enumerate(ARGUMENTS) for j, tool in enumerate(["deep", "open", "none"])]
    calls = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv long, call long, tool string, arguments string, json string, depth int")
    none = spark.createDataFrame([], "conv long, call long, content string")
    got = {r.call: r for r in tool_calls.link(calls, none, SCHEMAS, none.selectExpr("conv", "call", "call as parent")).collect()}
    for _, call, tool, text in rows:
        value = json.loads(text)
        assert got[call].errors == (wrong(value, SCHEMAS[tool]) if tool in SCHEMAS else ["unknown tool"]), text
        held = json.loads(got[call].json)
        assert held["arguments"] == value and got[call].json == json.dumps(plain_json(held), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[60].json.startswith('{"arguments":{"kind":1,"n":1},')


def test_tool_calls_of_the_conversations(spark):
    """The registered query against the same in Python, on the smallest table."""
    sf = "/root/testdata/sf0.001"
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    calls: dict = {}
    for conv, turn, role, text in turns:
        if role == "user":
            tool = ["search", "summarise", "translate", "unknown", "plan"][(conv + turn) % 5]
            n = len(text) if text is not None else None
            a = {"q": text, "n": n}
            if tool == "plan":
                a = {"q": text, "steps": [{"at": 0, "kind": "first"}, {"at": n, "kind": "last" if n is not None and n % 5 == 0 else "next"}]}
            elif n is not None and n % 7 == 0:
                a["n"] = str(n)
            calls.setdefault(conv, {})[turn] = (tool, json.dumps({k: v for k, v in a.items() if v is not None}, sort_keys=True))
    got = {(r.conv_id, r.turn): r for r in queries.op4_tool_calls(spark, sf).collect()}
    assert len(got) == sum(map(len, calls.values()))
    for conv, own in calls.items():
        depth = longest(set(own), {(c, c - d) for c in own for d in ((2, 6) if c % 8 == 0 else (2,))})
        for place, turn in enumerate(sorted(own, key=lambda c: (depth[c] is None, depth[c], c))):
            r, (tool, arguments) = got[conv, turn], own[turn]
            value = json.loads(arguments)
            errors = wrong(value, queries.TOOLS[tool]) if tool in queries.TOOLS else ["unknown tool"]
            answer = sorted(t or "" for c, at, role, t in turns if c == conv and role == "assistant" and at == turn + 1)
            assert (r.place, r.depth, r.tool, r.valid, r.errors, r.linked) == (place, depth[turn], tool, not errors, "; ".join(errors), bool(answer))
            assert json.loads(r.json) == {"arguments": value, "call": str(turn), "name": tool, "result": answer[0] if answer else None} | ({"errors": errors} if errors else {})


# --- 5: notices


def edits_to_end(notice, text):
    """Fewest edits of the notice against any stretch that ends at each place of the text (Sellers)."""
    row = list(range(len(notice) + 1))
    out = [row[-1]]
    for c in text:
        new = [0]
        for i, x in enumerate(notice):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        out.append(row[-1])
    return out


def distance(a, b):
    return edits_to_end(a, "")[0] if not b else _full(a, b)


def _full(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_licenses_against_brute_force(spark):
    filler = "Ünder the trees of mit or apache license plates the general public sat on a licence".split()
    texts: list = [None, "", "MIT License", "mit-license mit/license MIT\nLICENSE", "permit license", "the general public license, general public license v3"]
    for _ in range(60):
        words = [DRAW.choice(filler) for _ in range(DRAW.randrange(30))]
        for _ in range(DRAW.randrange(3)):
            n = list(DRAW.choice(list(licenses.NOTICES)))
            for _ in range(DRAW.randrange(len(n) // 12 + 1)):
                n[DRAW.randrange(len(n))] = DRAW.choice(["", "x", "qz", " "])
            words.insert(DRAW.randrange(len(words) + 1), "".join(n).title() if DRAW.random() < 0.3 else "".join(n))
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(None if i % 9 == 8 else i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, labels string, spans int").union(spark.createDataFrame([(2, "MIT License", "y", 2)], "doc_id long, text string, labels string, spans int"))
    out = licenses.scan(docs).collect()
    assert len(out) == len(texts) + 1 and sum(r.doc_id == 2 for r in out) == 2 and sum(r.doc_id is None for r in out) == sum(i % 9 == 8 for i in range(len(texts)))
    for r in (r for r in out if r.doc_id is not None):
        t = (texts[r.doc_id] or "").translate(LOW)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        base = sorted({label for _, label in at})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(base))
        near = {n: min(edits_to_end(n, t)) for n in licenses.NOTICES}
        held = {licenses.NOTICES[n] for n, e in near.items() if e <= licenses.edits_allowed(n)}
        assert set(filter(None, r["labels"].split(","))) <= held | set(base)
        for s in r.spans:
            assert s.edits <= licenses.edits_allowed(s.notice) and distance(s.notice, t[s.start : s.stop]) <= s.edits
        # the notice with the smallest share of edits can't be missed
        if held:
            n = min(near, key=lambda n: (near[n] / len(n), -len(n)))
            assert any(s.edits / len(s.notice) <= near[n] / len(n) + 1e-9 for s in r.spans), (t, n, r.spans)
        assert r.spans == sorted(r.spans, key=lambda s: s.start) and all(a.stop <= b.start for a, b in zip(r.spans, r.spans[1:]))


def test_licenses_of_one_long_text(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT license. " * 30000)], "doc_id long, text string")
    r = licenses.scan(docs).first()
    assert (r.n_base, r.first_word, r.last_word, len(r.spans), r.spans[-1].stop) == (30000, 3, 149998, 30000, 29999 * 32 + 30)


# --- 6: main text


def naive_surges(weights, width):
    padded = [0] * width + weights + [0] * width
    on = [sum(padded[k : k + width]) > 0 for k in range(len(padded) - width + 1)]
    out, k = [], 0
    while k < len(on):
        if on[k]:
            end = k
            while end < len(on) and on[end]:
                end += 1
            at = [i - width for i in range(k, end + width - 1) if padded[i] > 0]
            out.append((at[0], at[-1], sum(weights[at[0] : at[-1] + 1])))
            k = end
        k += 1
    return out


def test_surges():
    for _ in range(500):
        weights = [DRAW.choice([0, 0, 0, 5, 40]) for _ in range(DRAW.randrange(30))]
        for width in (1, 2, 3, 5):
            assert html_text.surges([float(w) for w in weights], width) == naive_surges(weights, width)


def words(n):
    return " ".join(DRAW.choice(["sand", "rain", "harbour", "fox &amp; dog", "<b>wall</b>", "night,"]) for _ in range(n))


def seen(t):
    return " ".join(re.sub("<[^>]+>", "", t).replace("&amp;", "&").split())


@pytest.mark.parametrize("wrap", ["article", "main", "div", "section", None])
def test_pages_by_their_lines(wrap):
    """No name on the page tells anything here: lists of links and short lines around the text are told from it by their weights."""
    for _ in range(60):
        links = lambda n: "<ul>" + "".join(f"<li><a href='/{k}'>{words(3)}</a></li>" for k in range(n)) + "</ul>"
        body = [words(DRAW.randrange(20, 60)) for _ in range(DRAW.randrange(2, 8))] + [words(2), words(30)]
        inner = "".join(f"<p>{t}</p>" + DRAW.choice(["", "", "<aside>see also</aside>", "<div class='ad-slot'>buy</div>", "<form>Name</form>"] + ["<div class=related-posts>a</div><div class=share-bar>b</div><div id=newsletter>c</div>"]) for t in body)
        page = f"<body><div>Site</div>{links(5)}" + (f"<{wrap}>{inner}</{wrap}>" if wrap else inner) + f"{links(4)}<div>Contact us</div></body>"
        assert html_text.main_text(page) == "\n".join(map(seen, body)), page


def test_what_the_weights_decide():
    """The same markup, with the long text now before and now after a list of links: the heavier side is the text; a paragraph on the other side is text as well, a bare line is not."""
    a, b, bare = "<p>" + "first " * 80 + "</p>", "<p>short note</p>", "<div>short note</div>"
    gap = "<ul>" + "<li><a href=x>link here</a></li>" * 4 + "</ul>"
    assert html_text.main_text(a + gap + bare) == seen(a) and html_text.main_text(bare + gap + a) == seen(a)
    assert html_text.main_text(f"{a}<nav>x</nav>{b}") == f"{seen(a)}\nshort note" and html_text.main_text(f"{b}<nav>x</nav>{a}") == f"short note\n{seen(a)}"
    # an article of few words beside a long text in plain elements is a teaser
    assert html_text.main_text(f"<article>{b}</article>{gap}<div>{a * 4}</div>") == "\n".join([seen(a)] * 4)
    assert html_text.main_text(f"<article>{a}</article>{gap}<div>{a}</div>") == seen(a)


def test_linked_lines_at_the_edges():
    text = "<p>" + "some words of the text " * 10 + "</p>"
    for wrap in ("div", "article", "main"):
        page = f"<ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul><{wrap}><h1><a href=/t>A linked title</a></h1>{text}<p><a href=/s>The source</a></p></{wrap}><div><a href=/x>Next</a></div>"
        assert html_text.main_text(page) == f"A linked title\n{seen(text)}\nThe source", wrap


@pytest.mark.parametrize("told, least, most", [(("article", "main"), 1.0, 0.0), (("article", "main", "nav", "footer", "header", "aside"), 1.0, 0.1)])
def test_given_pages_without_their_tags(told, least, most):
    """Pages whose elements of these names are plain ones: the share of the text that is still kept, and of what is kept beside it. In the second case no class or id is left either."""
    from collections import Counter

    import pyarrow.parquet as pq

    kept = whole = beside = 0
    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist():
        bare = re.sub(rf"<(/?)({'|'.join(told)})\b", r"<\1div", page or "")
        if len(told) > 2:
            bare = re.sub(r"""\s(class|id|role)=("[^"]*"|[^\s>]+)""", "", bare)
        a, b = (Counter(html_text.main_text(x).split("\n")) for x in (page or "", bare))
        kept += sum(len(t) * n for t, n in (a & b).items())
        whole += sum(len(t) * n for t, n in a.items())
        beside += sum(len(t) * n for t, n in (b - a).items())
    assert kept >= least * whole > 0 and beside <= most * whole


def test_names_are_whole():
    text = "<p>One two three four five six seven eight nine.</p>"
    for name in ("share-price", "related-work", "navy-blue", "text-header-size", "body social-science", "market-share", "admin", "section-header", "no-sidebar", "eviction-notice"):
        for attr in (f'class="{name}"', f"id='{name}'"):
            assert html_text.main_text(f"<article>{text}<div {attr}>Second</div></article>").endswith("Second"), attr
    for name in ("share-bar", "related-posts", "nav", "site-header", "cookie-notice", "comments", "comment-list", "x sidebar", "ad_slot", "promo", "footer-links"):
        assert not html_text.main_text(f"<article>{text}<div class='{name}'>Second</div></article>").endswith("Second"), name
    assert html_text.main_text("<article><header><h1>Title</h1></header><p>Text</p></article>") == "Title\nText"
    assert html_text.main_text("<article><p title=it's>First.</p><p title = \"a > b\" data-x='class=ad'>Second.</p><p>It's third.</p></article>") == "First.\nSecond.\nIt's third."


def test_page_tables(spark):
    long = "<article>" + "<p>" + "word " * 20 + "</p>" * 1 + ("<p class=x>a <b>b</b> c</p>" * 40000) + "</article>"
    rows = spark.createDataFrame([(1, "u", "<p>same</p>", 5), (1, "u", "<p>same</p>", 6), (None, None, long, 7)], "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id or 0, r.text[:9], r.n_chars) for r in html_text.extract(rows, ["page_id", "url"]).collect())
    assert got == [(0, "word word", 99 + 6 * 40000), (1, "same", 4), (1, "same", 4)]
    assert html_text.extract(rows.limit(0), ["page_id", "url"]).count() == 0


# --- 9: rates


def brute_rates(rows):
    known = [(h, p, y) for h, p, y in rows if y is not None]

    def strength(groups):
        """groups: parent -> list of (n, s)"""
        df = sum(len(g) - 1 for g in groups.values())
        dw = sum(n - 1 for g in groups.values() for n, _ in g)
        if not df or not dw:
            return 10.0
        within = max(sum(n * (s / n) * (1 - s / n) for g in groups.values() for n, s in g) / dw, 1e-9)
        spread = n0 = 0.0
        for g in groups.values():
            big, good = sum(n for n, _ in g), sum(s for _, s in g)
            spread += sum(n * (s / n - good / big) ** 2 for n, s in g)
            n0 += big - sum(n * n for n, _ in g) / big
        between = (spread - df * within) / n0
        return min(max(within / between if between > 0 else 1e6, 1.0), 1e6)

    def count(keep):
        own = [y for h, p, y in known if keep(h, p)]
        return len(own), sum(own)

    hosts, paths = sorted({h for h, _, _ in known}), sorted({(h, p) for h, p, _ in known})
    a = strength({0: [count(lambda h, p, x=x: h == x) for x in hosts]})
    b = strength({x: [count(lambda h, p, q=q: (h, p) == q) for q in paths if q[0] == x] for x in hosts})
    out = []
    for h, p, y in rows:
        has, own = y is not None, y or 0.0
        n, s = len(known) - has, sum(k[2] for k in known) - own
        top = s / n if n > 0 else 0.5
        n, s = count(lambda x, _: x == h)
        host = (s - own + a * top) / (n - has + a)
        n, s = count(lambda x, q: (x, q) == (h, p))
        out.append((host, (s - own + b * host) / (n - has + b)))
    return out


def test_quality_posterior(spark):
    """Scores are the text's odds against the base rate times the odds of the path, whose rate comes from labels but the document's own."""
    docs = [(i, ("WORD!! " if DRAW.random() < (0.7 if i % 5 == 0 else 0.2) else "word and ") * (3 + i % 9), [None, "s0", "s1", "s2", "s2"][i % 5], "en" if i % 3 else None) for i in range(240)]
    labels = [(i, int(DRAW.random() < (0.2 if i % 5 == 0 else 0.9))) for i in range(0, 240, 2)] + [(999, 1), (1, None), (None, 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").withColumn("score", F.lit("x")).withColumn("host", F.lit(1)).withColumn("k", F.lit(1))
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(frame, told).collect()}
    own = dict(labels)
    rates = brute_rates([(d[2], (d[2], d[3]), float(own[d[0]]) if own.get(d[0]) is not None else None) for d in [(d[0], d[1], str(d[2]), str(d[3])) for d in docs]])
    base = sum(own[i] for i in range(0, 240, 2)) / 120
    for d, (host, path) in zip(docs, rates, strict=True):
        r = got[d[0]]
        assert (r.host_rate, r.path_rate) == pytest.approx((host, path), abs=1e-9)
        odds = math.log(r.own / (1 - r.own)) - math.log(base / (1 - base)) + math.log(path / (1 - path))
        assert r.score == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-6) and r.kept == (r.score >= 0.5)


def test_sparse_sites_shrink(spark):
    rows = [("rich", "rich/a", 0.0)] * 180 + [("rich", "rich/a", 1.0)] * 20 + [("good", "good/a", 1.0)] * 190 + [("good", "good/a", 0.0)] * 10 + [("sparse", "sparse/a", 0.0)] + [("sparse", "sparse/a", None), ("new", "new/a", None), ("rich", "rich/b", None), ("rich", "rich/a", None)]
    marked = spark.createDataFrame(rows, "host string, path string, y double")
    counts = marked.where("y is not null").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    out = {(r.host, r.path): (r.host_rate, r.path_rate) for r in quality.rates(counts, marked).where("y is null").collect()}
    overall = 210 / 401
    assert abs(out["rich", "rich/a"][1] - 0.1) < 0.02 and abs(out["rich", "rich/b"][1] - 0.1) < 0.02  # many labels: its own rate, for a new path of it too
    assert 0.2 < out["sparse", "sparse/a"][1] < overall  # one bad label moves it a part of the way
    assert out["new", "new/a"][1] == pytest.approx(overall)  # none: the prior


def test_quality_ties_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "a b " * 100000, "s", "en"), (2, None, "s", "en"), (2, None, "s", "en"), (3, "", None, None)], "doc_id long, text string, source string, lang string")
    one = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")  # a tie of labels counts as good, and there is no other class
    out = quality.classify(docs, one).collect()
    assert len(out) == 4 and all(r.kept for r in out)
    none = quality.classify(docs, one.limit(0)).collect()
    assert {(r.score, r.kept) for r in none} == {(0.5, True)}  # a score at the threshold is kept


# --- 10: chunks


def naive_chunks(t):
    out, s = [], 0
    while s < len(t):
        end = len(t)
        for e in range(s + fingerprint.LEAST, min(len(t), s + fingerprint.MOST) + 1):
            if e - s < fingerprint.LEAST:
                continue
            h = sum(int(fingerprint.GEAR[t[e - 1 - k]]) << k for k in range(32) if e - 1 - k >= 0) & 0xFFFFFFFF
            mask = int(fingerprint.STRICT) if e - s < fingerprint.USUAL else int(fingerprint.LOOSE)
            if h & mask == 0 or e - s == fingerprint.MOST:
                end = e
                break
        if len(t) - s <= fingerprint.LEAST:
            end = len(t)
        out.append(t[s:end])
        s = end
    return out


def test_chunks_against_brute_force():
    texts = [b"", b"x", b"y" * 40, b"ab" * 4000, "é".encode() * 500, *(bytes(DRAW.choice(b"abcdefgh  ,.") for _ in range(DRAW.randrange(3000))) for _ in range(20))]
    texts += [t[:50] + b"an insertion" + t[50:] for t in texts]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts, firsts = fingerprint.chunk_ends(data, np.cumsum([0, *map(len, texts)]))
    stops = np.append(starts[1:], data.size)
    sets = fingerprint.chunk_sets(texts)
    for k, t in enumerate(texts):
        want = naive_chunks(t)
        # the hash of the first bytes of a text reaches back into the one before it, but no chunk ends so early
        assert [data[a:b].tobytes() for a, b in zip(starts[firsts[k] : firsts[k + 1]], stops[firsts[k] : firsts[k + 1]])] == want
        for j in (k - 1, (k + len(texts) // 2) % len(texts)):
            own, other = set(want), set(naive_chunks(texts[j]))
            share = float(bool(own) == bool(other)) if not own or not other else sum(map(len, own & other)) / sum(map(len, own))
            assert fingerprint.containment(sets[k], sets[j]) == pytest.approx(share)


# --- shared


def test_long_words_have_different_hashes():
    """Over long regular strings sums modulo a power of two collide, as those of the Thue-Morse word and its complement do."""
    t = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    u = t.translate(str.maketrans("ab", "ba"))
    assert bh.hash_of(t.encode()) != bh.hash_of(u.encode()) and bh.hash_of(t.encode()) == bh.hash_of(t.upper().encode())
    data = np.frombuffer(f"{t} x {u} y".encode(), dtype=np.uint8)
    begins, stops, _ = bh.words(data, np.array([0, data.size]), bh.SOLID)
    assert bh.hashes(data, begins, stops, bh.FOLDED).tolist() == [bh.hash_of(w.encode()) for w in (t, "x", u, "y")]


def test_key_filter(spark, monkeypatch):
    keys = spark.range(0, 30000, 3).select(F.col("id").alias("k"))
    monkeypatch.setattr(shared, "PAGE", 1 << 14)
    words = shared.key_filter(keys, "k")
    h = np.array([r[0] for r in spark.range(30000).select(F.xxhash64("id")).collect()])
    on = shared.in_filter(words, h)
    assert on[::3].all() and on.mean() < 0.45
    assert not shared.in_filter(shared.key_filter(keys.limit(0), "k"), h).any()


def test_numbered(spark):
    rows = spark.createDataFrame([(DRAW.randrange(50), k) for k in range(500)], "a long, b long").repartition(7)
    got = sorted((r.n, r.a, r.b) for r in shared.numbered(rows, ["a", F.desc("b")], "n").collect())
    assert [g[0] for g in got] == list(range(500)) and [(g[1], -g[2]) for g in got] == sorted((g[1], -g[2]) for g in got)
    assert shared.numbered(rows.limit(0), ["a"], "n").count() == 0


def test_no_shared_folder_is_an_error_on_a_cluster(spark):
    class Context:
        master = "spark://x:7077"

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared.shared_folder(Session())


# --- 1 and 3: awkward tables


def test_language_of_long_and_repeated_texts(spark):
    en, de = "the quick brown fox jumps over the lazy dog and rests", "der schnelle braune Fuchs springt über den faulen Hund"
    known = spark.createDataFrame([(en, "en"), (de, "de"), (None, "de"), (en, None)], "text string, lang string")
    models = language.fit(known)
    assert models.names == ["de", "en"]
    rows = spark.createDataFrame([(1, (en + " ") * 20000, "x"), (1, (en + " ") * 20000, "x"), (None, de, "x"), (4, "12 -- !!", "x"), (5, "É", "x")], "doc_id long, text string, lang_pred string")
    out = sorted(((r[0] or 0, r[2], r[3]) for r in language.predict(rows, models, ["doc_id", "lang_pred"]).collect()))
    assert [x[:2] for x in out] == [(0, "de"), (1, "en"), (1, "en"), (4, "und"), (5, out[4][1])] and out[1] == out[2] and out[3][2] == 0
    assert out[4][1] in ("de", "en")


def test_mixing_of_awkward_rows(spark):
    """Ties in the seeded order, repeated and null keys, names that clash: tokens of each leaf stay within its budget, and alike rows share a fate."""
    from tracekit.llm import mixing

    rows = [(i % 5 if i % 7 else None, "w " * (1 + i % 3), "a" if i % 2 else None, i, "x", 1.0, 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, k long, l0 string, budget double, range int")
    out = mixing.mix(docs, ["lang"], fraction=0.5, epochs=2).collect()
    assert set(out[0].asDict()) == {"doc_id", "lang", "n_tokens", "copies", "n_taken"}
    total = sum(1 + i % 3 for i in range(60))
    assert abs(sum(r.n_taken for r in out) - total // 2) <= 20 and all(0 < r.n_taken <= r.copies * r.n_tokens for r in out)
    again = mixing.mix(docs.repartition(5), ["lang"], fraction=0.5, epochs=2).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    full = mixing.mix(docs, ["lang"], fraction=5.0, epochs=2).collect()
    assert len(full) == 60 and {r.copies for r in full} == {2}
