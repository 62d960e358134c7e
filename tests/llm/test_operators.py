"""Each operator on a small awkward table, on an empty one, and against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tracekit.llm import decontaminate, fingerprint, html_text, language, licenses, minhash, mixing, quality, substrings, tool_calls
from tracekit.llm.shared import components

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept int, id int, k int, score string, h int, row_id int, n int"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix a potion of blue sand and old rain near the harbour wall tonight"


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


@pytest.fixture(scope="module")
def awkward(spark):
    texts = [
        PROSE, PROSE, PROSE.replace("seven", "eight"), None, "", "   \n\t ", "a", "é ü ß", "12 34 !!", PROSE + " " + PROSE, "x" * 5000, "ab " * 3000,
        "Released under the MIT License.", "released undr the mit licence", "Das ist ein kleiner deutscher Satz über Wörter und Zeit.", "mit license " * 3,
    ]
    rows = [(i, t, "de" if i == 14 else "en", None if i % 5 == 0 else f"src{i % 3}", 1, "c", 1, 2, 3, "s", 4, 5, 6) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


@pytest.fixture(scope="module")
def repeated(spark, awkward):
    """Keys that are null or stand twice, once with the same text and once not."""
    more = spark.createDataFrame([(None, PROSE, None, None, *[None] * 9), (None, None, None, None, *[None] * 9), (0, PROSE, *[None] * 11), (2, "another text", *[None] * 11)], SHAPE)
    return awkward.union(more)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[s : s + width]) for s in range(max(1, len(w) - width + 1))} if w else set()
    part = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                c = len(sets[a] & sets[b])
                if c and 100 * c >= percent * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    return {i: (len(sets[i]), part[i]) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_matches_brute_force(awkward, width):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(awkward, width=width).collect()}
    assert got == brute_components(rows, width, 80)


def test_minhash_repeated_keys_and_empty(repeated, empty):
    out = minhash.near_duplicates(repeated).collect()
    assert len(out) == 20
    prose = [r for r in out if r.n_shingles == len(PROSE.split()) - 1]
    assert sum(r.kept for r in prose) == 1  # of all copies, whatever their keys, one is kept
    assert minhash.near_duplicates(empty).count() == 0


def test_links_across_blocks_lose_nothing(spark):
    """A chain: each text shares over 80 % with the next only, and small blocks split them."""
    w = [f"w{i}" for i in range(80)]
    texts = [" ".join(w[3 * k : 3 * k + 50]) for k in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components(list(enumerate(texts)), 2, 80)
    placed = docs.select(F.col("doc_id").alias("id"), F.lit(49).alias("n"), F.lit(0).cast("long").alias("cluster"), F.col("doc_id").alias("component"), F.lit(True).alias("outside"))
    links = {(r.a, r.b) for r in minhash.links_across(placed, docs, "doc_id", "text", 2, 80, block=(3, 4)).collect()}
    assert links == {(k, k + 1) for k in range(9)}


def brute_parts(pairs):
    part = {x: x for p in pairs for x in p}
    for _ in part:
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
    return part


def test_components_of_shuffled_paths_and_trees(spark):
    """Also where, after a round, a node hangs on two others and none on itself."""
    draw = random.Random(5)
    graphs = [[(2, 5), (5, 4), (4, 6), (6, 3)], []]
    for k, n in enumerate([2, 5, 6, 8, 8, 8, 20, 60] * 4):
        ids = draw.sample(range(1000 * k, 1000 * k + 1000), n)
        graphs[1] += [(ids[i], ids[i - 1 if k % 2 else draw.randrange(i)]) for i in range(1, n)]
    for pairs in graphs:
        want = brute_parts(pairs) | {10**6: 10**6}
        nodes = spark.createDataFrame([(i,) for i in want], "id long")
        links = spark.createDataFrame(pairs, "a long, b long")
        assert {r.id: r.component for r in components(nodes, links).collect()} == want
    with pytest.raises(RuntimeError):
        components(nodes, links, most_rounds=1)


def brute_repeats(rows, length):
    seen, out = set(), []
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        out.append((i, len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_substrings_match_brute_force(awkward, monkeypatch):
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in awkward.collect())
    want = brute_repeats(rows, 100)
    for hot in (substrings.HOT, 1):  # with 1, all keys with several texts go the way of hot ones
        monkeypatch.setattr(substrings, "HOT", hot)
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in substrings.without_repeats(awkward).collect())
        assert got == want


def test_substrings_repeated_keys_and_empty(repeated, empty):
    out = substrings.without_repeats(repeated, carry=("kept", "n")).toDF("key", "text", "size", "gone", "spans", "c0", "c1").collect()
    assert len(out) == 20
    assert sum(r["gone"] < r["size"] for r in out if bytes(r["text"] or b"") == PROSE.encode()) == 1
    assert substrings.without_repeats(empty).count() == 0


def test_contamination_matches_brute_force(spark, awkward, empty):
    items = [(1, " ".join(PROSE.split()[3:15])), (2, "Released under"), (2, "fox jumps"), (3, None), (4, "!!"), (None, "12 34"), (10, PROSE.upper())]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(awkward, tests).collect()}
    for r in awkward.collect():
        w, hit, names = alnum(r.text), set(), set()
        for i, t in items:
            v = alnum(t)
            for s in range(max(1, len(v) - 9)) if v else ():
                win = v[s : s + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        names |= {str(i)} if i is not None else set()
        assert got[r.doc_id] == (len(w), len(hit), sorted(names), bool(hit)), r.doc_id
    assert decontaminate.contamination(awkward, tests.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, tests).count() == 0


def test_contamination_in_blocks_and_with_slack(spark, awkward, monkeypatch):
    tests = spark.createDataFrame([(1, " ".join(PROSE.split()[3:15])), (2, "fox jumps"), (5, "brown fox over")], "item_id long, text string")
    one = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(awkward, tests).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    monkeypatch.setattr(decontaminate, "STEP", 3)
    assert {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(awkward, tests).collect()} == one
    near = {r.doc_id: r["items"] for r in decontaminate.contamination(awkward, tests, slack=1).collect()}
    assert "5" not in one[0][1] and "5" in near[0]
    short = spark.createDataFrame([(0, "over fox"), (1, "brown over"), (2, "x brown over")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in decontaminate.contamination(short, tests.where("item_id = 5"), slack=1).collect()}
    assert got == {0: [], 1: [], 2: []}  # no brown, no fox
    turned = spark.createDataFrame([(0, "brown over fox"), (1, "a brown over fox b"), (2, "fox over brown")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in decontaminate.contamination(turned, tests.where("item_id = 5"), slack=1).collect()}
    assert got == {0: [(0, 3)], 1: [(1, 4)], 2: []}


def test_language(awkward, repeated, empty):
    models = language.fit(awkward)
    out = {r.doc_id: r for r in language.predict(awkward, models, ["doc_id", "score"]).toDF("doc_id", "old", "lang_pred", "score", "p").collect()}
    assert out[0].lang_pred == "en" and out[14].lang_pred == "de"
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (3, 4, 5, 8))
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language.predict(empty, models, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in language.predict(repeated, language.fit(empty), ["doc_id"]).collect()} == {"und"}


def test_licenses(awkward, empty):
    out = {r.doc_id: r for r in licenses.scan(awkward).collect()}
    assert (out[12].n_base, out[12].first_word, out[12].base_labels, out[12].score) == (1, 3, "mit", 1.0)
    assert out[12].spans[0].start == 0 and out[12].spans[0].stop == len("Released under the MIT License")
    assert (out[13].n_base, out[13]["labels"]) == (0, "mit") and 0.8 < out[13].score < 1 and out[13].spans[0].edits == 2
    assert (out[15].n_base, out[15].first_word, out[15].last_word) == (3, 0, 4)
    assert out[3].first_word is None and out[3].n_words == 0
    assert licenses.scan(empty).count() == 0


def test_fingerprints(awkward, repeated, empty):
    rows = sorted(((r.doc_id, r.text or "") for r in awkward.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint.held_against_next(awkward).collect()}
    for k, (i, t) in enumerate(rows):
        e = fingerprint.edited(t, rows[(k + 1) % len(rows)][1])
        own, new, nxt = fingerprint.chunk_sets([t.encode(), e.encode(), rows[(k + 1) % len(rows)][1].encode()])
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.in_hex(own), fingerprint.in_hex(new))
        assert (r.near_edited, r.near_next) == (fingerprint.containment(own, new), fingerprint.containment(own, nxt))
    assert got[0].fingerprint == got[1].fingerprint and got[3].fingerprint == ""
    assert fingerprint.held_against_next(repeated).count() == 20
    assert fingerprint.held_against_next(empty).count() == 0
    assert {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(awkward).collect()} == {i: got[i].fingerprint for i in got}


def test_chunks_survive_a_shift():
    import random

    random.seed(3)
    body = bytes(random.choice(b"abcdefghij ") for _ in range(20000))
    a, b = fingerprint.chunk_sets([body, b"an insertion" + body])
    assert fingerprint.containment(a, b) > 0.98


def test_html():
    page = '<html><head><title>T</title></head><body><nav>Home <a href="x">More</a></nav><div class="cookie-notice">We use</div><article><h1>A &amp; B</h1><p>One\n two&nbsp;<b>three</b></p><aside>no</aside><p>Four<br>five</p><form>Name</form><script>var p="</p>";</script><p>six &lt;7</p></article><section id="comments"><p>first!</p></section><footer>&copy;</footer></body></html>'
    assert html_text.main_text(page) == "A & B\nOne two three\nFour five\nsix <7"
    plain = "<body><div class=menu>x</div><p>" + "word " * 30 + "</p><p>short</p><p>" + "more " * 30 + "</p></body>"
    assert html_text.main_text(plain).split("\n")[1] == "short"
    assert html_text.main_text("") == "" and html_text.main_text("just text") == "just text"
    assert html_text.main_text("<article><p>cut of <b>here &am") == "cut of here &am"


def test_html_article_is_whole():
    asides = "<aside>a</aside><div class='newsletter-box'>b</div><div class=related-links>c</div>"
    body = [f"{k} " + "word " * 80 for k in range(10)]
    page = "<nav>x</nav><article>" + "".join(f"<p>{t}</p>" for t in body) + asides + "<p>The end.</p><p>Thanks.</p></article><div>y</div><article><p>Short</p></article>"
    assert html_text.main_text(page) == "\n".join([*(t.strip() for t in body), "The end.", "Thanks.", "Short"])


def test_html_layout_is_no_aside():
    for name in ("content no-sidebar", "has-sidebar", "page-with-sidebar", "post social-science", "sidebar", "content-sidebar"):
        assert html_text.main_text(f"<div class='{name}'><article><p>Kept</p></article></div>") == "Kept"
        assert html_text.main_text(f"<div id=menu>no</div><div class='{name}'><p>Kept text of the page</p></div>") == "Kept text of the page"
    for name in ("post no-sidebar", "social-science"):
        assert html_text.main_text(f"<article><p>First words here</p><div class='{name}'>Second</div></article>") == "First words here\nSecond"
    for name in ("site-footer", "share-bar", "cookie-notice", "x related-posts", "sidebar-left", "ad", "menu__item"):
        assert html_text.main_text(f"<article><p>First words here, and more of them</p><div class='{name}'>Second</div></article>") == "First words here, and more of them"
    assert html_text.main_text("<form id=f><main><p>Kept</p></main></form>") == "Kept"
    assert html_text.main_text("<p>Long text of the page</p><aside><article>teaser</article></aside>") == "Long text of the page"


def test_html_optional_end_tags():
    assert html_text.main_text("<article><p class=notice>no<p>First <b>words</b> of it<div>Second part</div></article>") == "First words of it\nSecond part"
    assert html_text.main_text("<article><ul><li class=promo>no<ul><li>inner</ul><li>One of them</ul><p>After the list</article>") == "One of them\nAfter the list"
    assert html_text.main_text("<article><table><tr><td class=ad>no<td>Cell of it<tr><td>Next cell</table><dl><dt>Term<dd class=ad>no<dt>Other</dl></article>") == "Cell of it\nNext cell\nTerm\nOther"
    assert html_text.main_text("<article><p>First words</p><div><div class=ad>no</div>Second</div></article>") == "First words\nSecond"
    assert html_text.main_text("<nav><a href=x>Home</a><main><p>Kept</p></main>").endswith("Kept")


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (3, "w", "<p>é</p>", "t")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(rows, ["page_id", "url"]).orderBy("page_id").collect()]
    assert got == [(1, "u", "", 0), (2, None, "", 0), (3, "w", "é", 1)]


def test_quality(spark, awkward, repeated, empty):
    docs = spark.createDataFrame([(i, ("WORD!! " if i % 4 == 0 else "word and ") * (5 + i % 7), f"s{i % 3}", "en") for i in range(200)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(100)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert sum(out[i].kept == (i % 4 != 0) for i in range(100, 200)) == 100
    assert quality.classify(repeated, labels.limit(0)).where("kept").count() == 20
    assert quality.classify(awkward, labels.where("quality = 1")).count() == 16
    assert quality.classify(empty, labels).count() == 0


def test_mixing_budget_and_siblings(spark, empty):
    rows = [(i, "w " * 10, "a" if i < 4 else "b", "x" if i % 2 else "y") for i in range(40)] + [(99, None, "a", None), (98, " ", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs, ["lang", "source"], fraction=0.5, epochs=2).collect()
    # lang a has 40 tokens, twice 80, of the 100 it should get: the rest goes to b
    assert sum(r.n_taken for r in out if r.lang == "a") == 80 and sum(r.n_taken for r in out) == 200
    assert {r.copies for r in out if r.lang == "a"} == {2}
    assert mixing.mix(empty, ["lang", "source"]).count() == 0


def test_tool_calls(spark):
    calls = [(1, "a", None, "search", '{"q":"x","n":3}'), (1, "a", None, "search", '{"q":"y"}'), (1, "b", "a", "search", '{"n":"3","z":1,"q":"é"}'), (1, "c", "b", "calc", "oops"), (1, "d", "e", "search", "[1]"), (1, "e", "d", "none", None), (None, "q", None, None, None), (2, "z", "gone", None, "{}")]
    calls = spark.createDataFrame(calls, "conv long, call string, parent string, tool string, arguments string")
    results = spark.createDataFrame([(1, "a", "r1"), (1, "a", "r0"), (1, "b", None), (3, "x", "y")], "conv long, call string, content string")
    schemas = {"search": {"properties": {"q": {"type": "string"}, "n": {"type": "integer"}}, "required": ["q"]}, "calc": {"properties": {}, "required": []}}
    out = tool_calls.link(calls, results, schemas).orderBy("conv", "place").collect()
    assert [(r.call, r.place, r.depth, r.valid, r.linked) for r in out] == [("a", 0, 0, True, True), ("b", 1, 1, False, True), ("c", 2, 2, False, False), ("d", 3, None, False, False), ("e", 4, None, False, False), ("z", 0, 0, False, False)]
    assert out[0].json == '{"arguments":{"n":3,"q":"x"},"call":"a","name":"search","result":"r0"}'
    assert out[1].errors == ["n: not integer", "z: unknown"]
    chain = spark.createDataFrame([(1, str(i), str(i - 1), "calc", "{}") for i in range(100)], calls.schema)
    assert {r.call: r.depth for r in tool_calls.link(chain, results, schemas).collect()} == {str(i): i for i in range(100)}
    assert tool_calls.link(calls.limit(0), results.limit(0), schemas).count() == 0
