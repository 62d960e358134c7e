"""Main text of web pages from the distribution of text over their lines.

Markup is stripped so that each block of the page is a line; what is named an advert, form, comment and the like is stripped
with it and leaves nothing, while a menu, header or footer leaves a gap. A line weighs as much as its text,
less twice what is linked. The weights are summed over sliding windows of lines: where the sum surges from nothing a stretch of text
begins, where it dives to nothing it ends. The main text runs from the surge of the first stretch that is text to the dive of the last, with the headings and paragraphs that
adjoin it, linked throughout or not, and all that lies between. A stretch is text if it is the heaviest, or holds a paragraph or heading; where the heaviest holds none, all stretches are.

The edge of an article or main element is a gap as well, so that a stretch lies either within one or outside, and text outside
weighs a tenth where a page has one. If the heaviest stretch is within, only what is within is text, and its links weigh as much as other words.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no markup, and is never text.
RAW = {"script", "style", "template", "noscript", "iframe", "svg", "math", "object", "canvas", "textarea", "title"}
#: Elements that never hold main text.
ASIDE = {"nav", "header", "footer", "aside", "form", "select", "button", "menu", "dialog", "head", "audio", "video"}
#: Elements that run on within a line.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Names of a class or id, or of its last or first word, for what stands aside.
NAMES = re.compile(r"ads?|advert(s|isement|isements|ising|orial)?|sponsor(ed|s)?|promos?|cookies?|consent|gdpr|comments?|disqus|sidebar|widget|menu|nav|navbar|navigation|navmenu|footer|masthead|breadcrumbs?|subscribe|newsletter|signup|login|popup|modal|overlay|pagination|pager|skip-link|toolbar")
#: Names that may as well name a topic or a part of the text: they count alone, or beside words that tell a place on the page.
TOPICS = re.compile(r"banner|notice|share|sharing|social|related|recommend(ed|ations?)?|respond|replies")
PLACES = {"ad", "ads", "app", "area", "articles", "bar", "blog", "block", "box", "btn", "button", "buttons", "container", "content", "cookie", "cookies", "entry", "follow", "footer", "form", "global", "group", "icon", "icons", "inner", "item", "items", "label", "legal", "link", "links", "list", "main", "media", "menu", "mobile", "module", "nav", "networks", "page", "panel", "post", "posts", "privacy", "section", "site", "slot", "sticky", "stories", "strip", "title", "tools", "top", "bottom", "left", "right", "text", "thread", "unit", "widget", "wrap", "wrapper"}
#: A header of one of these is the page's; others are headings of what they stand in.
PAGES = {"app", "blog", "global", "main", "mobile", "nav", "page", "site", "sticky", "top", "bar", "wrap", "wrapper", "container", "inner"}
#: A layout that has or lacks what the last word names.
LAYOUT = {"no", "not", "has", "have", "with", "without", "hide", "show", "and"}
#: What stands around the text, not in it: it leaves a gap.
FURNITURE = {"nav", "header", "footer", "menu", "head"}
FURNITURE_NAMES = re.compile(r"menu|nav\w*|footer|header|masthead|breadcrumbs?|toolbar|pagination|pager")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold running text, or its title.
PROSE = HEADINGS | {"p", "blockquote", "pre", "figcaption"}
#: Elements that end where a sibling begins, unless a new list or table has begun.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
LISTS = {"ul", "ol", "menu", "dl", "table", "select", "article", "main"}
#: Elements that may stand in a paragraph, besides INLINE.
PHRASES = {"button", "select", "option", "optgroup", "audio", "video", "input", "area", "track", "source", "link", "meta"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog"}
#: A quote opens a value after an equals sign only; elsewhere, as in an unquoted value, it is a character like others.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>)|\Z))*+)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")


def _named(token: str) -> bool:
    words = [w for w in re.split("[_-]+", token) if w]
    if not words or LAYOUT.intersection(words[:-1]):
        return False
    if NAMES.fullmatch(token) or TOPICS.fullmatch(token) or NAMES.fullmatch(words[-1]):
        return True
    rest = [w for w in words if not w.isdigit()]
    if "header" in rest:
        return PAGES.issuperset(set(rest) - {"header"})
    if NAMES.fullmatch(words[0]):
        return PLACES.issuperset(rest[1:]) or any(TOPICS.fullmatch(w) for w in rest[1:])
    return any(TOPICS.fullmatch(w) and PLACES.issuperset(rest[:k] + rest[k + 1 :]) for k, w in enumerate(rest))


def _aside(tag: str, attrs: str) -> str:
    """What an element stands aside for: ``furniture`` around the text, something ``else``, or nothing (an empty string)."""
    if tag in ASIDE:
        return "furniture" if tag in FURNITURE else "else"
    if not attrs or tag in {"html", "body", "article", "main"}:
        return ""
    for name, *values in ATTR.findall(attrs):
        value = next((v for v in values if v), "").lower()
        name = name.lower()
        if name in ("class", "id") and (told := next((t for t in value.split() if _named(t)), None)):
            return "furniture" if any(FURNITURE_NAMES.fullmatch(w) for w in re.split("[_-]+", told)) else "else"
        if name == "role" and value in ROLES:
            return "furniture"
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "else"
    return ""


def _tags(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, stop, tag, closing, attributes) of each tag; a comment has no name, and an element of RAW is one tag up to its end."""
    out, at = [], 0
    while m := TAG.search(page, at):
        at, tag, closing = m.end(), (m[2] or "").lower(), bool(m[1])
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        out.append((m.start(), at, tag, closing, m[3] or ""))
    return out


def _ends(tags: list[tuple[int, int, str, bool, str]]) -> list[int]:
    """The tag that ends the element that each tag opens: its end tag, that of an element around it, or a start that implies it; else ``len(tags)``."""
    ends = [len(tags)] * len(tags)
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}

    def close(depth: int, by: int) -> None:
        while len(stack) > depth:
            tag, k = stack.pop()
            count[tag] -= 1
            ends[k] = by

    for k, (_, _, tag, closing, attrs) in enumerate(tags):
        if not tag or tag in RAW or tag in VOID and tag != "hr":
            continue
        if closing:
            if count.get(tag):
                d = len(stack) - 1
                while stack[d][0] != tag and (tag not in INLINE or stack[d][0] in INLINE):
                    d -= 1
                if stack[d][0] == tag:
                    close(d, k)
            continue
        if count.get("p") and tag not in INLINE and tag not in PHRASES:
            d = len(stack) - 1
            while stack[d][0] in INLINE:
                d -= 1
            if stack[d][0] == "p":
                close(d, k)
        if any(count.get(x) for x in SIBLINGS.get(tag, ())):
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] in LISTS:
                    break
                if stack[d][0] in SIBLINGS[tag]:
                    close(d, k)
                    if tag in ("li", "dt", "dd", "td", "th", "option"):
                        break
        if tag != "hr" and not attrs.endswith("/"):
            stack.append((tag, k))
            count[tag] = count.get(tag, 0) + 1
    return ends


def _asides(page: str, tags: list[tuple[int, int, str, bool, str]]) -> dict[int, tuple[int, str]]:
    """The tags that open what stands aside, with those that end it and what it is.

    An element with an article, a main element or most of the page's text in it is the page's layout; but elements of ASIDE
    that are closed, forms apart, stand aside unless main is in them. A header with a heading, in an article or main element, is its title.
    """
    ends = _ends(tags)
    text, mains, articles, heads = [0], [0], [0], [0]
    at = 0
    for start, stop, tag, closing, _ in tags:
        text.append(text[-1] + len(page[at:start].strip()))
        mains.append(mains[-1] + (tag == "main" and not closing))
        articles.append(articles[-1] + (tag == "article" and not closing))
        heads.append(heads[-1] + (tag in HEADINGS and not closing))
        at = stop
    text.append(text[-1] + len(page[at:].strip()))
    out: dict[int, tuple[int, str]] = {}
    k = inside = 0
    while k < len(tags):
        _, _, tag, closing, attrs = tags[k]
        if tag in ("article", "main"):
            inside = max(0, inside + (-1 if closing else 1))
        if tag and not closing and tag not in RAW and tag not in VOID and not attrs.endswith("/") and (kind := _aside(tag, attrs)):
            end = ends[k]
            sure = tag in ASIDE and tag != "form" and end < len(tags) and tags[end][2] == tag and tags[end][3]
            held = text[end + 1] - text[k + 1]
            title = tag == "header" and inside and heads[end] > heads[k]
            if not title and mains[end] == mains[k] and (sure or articles[end] == articles[k] and 2 * held <= text[-1]):
                out[k] = end, kind
                # an end tag of its own belongs to it; another one does not
                k = end + (end < len(tags) and tags[end][2] == tag and tags[end][3])
                continue
        k += 1
    return out


def lines(page: str, width: int = 3, outside: float = 0.1) -> list[tuple[str, float, bool, bool]]:
    """(text, weight, within, prose) of each line: the text without markup; its length less twice what is linked, in an article or main element its length; whether it is in one; and whether it is a paragraph or heading.

    Text outside counts ``outside`` times in a page that has one. Gaps are ``width`` empty lines. An element that never closes
    runs to the end of the element around it or of the page.
    """
    out: list[tuple[str, float, bool, bool]] = []
    parts: list[str] = []
    linked, prose = 0, False
    tags = _tags(page)
    asides = _asides(page, tags)
    shown: list[tuple[int, int, str | None, bool]] = []
    k = main = links = 0
    while k < len(tags):
        if k in asides:
            end, kind = asides[k]
            own = end < len(tags) and tags[end][2] == tags[k][2] and tags[end][3]
            stop = tags[end][1] if own else tags[end][0] if end < len(tags) else len(page)
            shown.append((tags[k][0], stop, None, kind == "furniture"))
            k = (end if own else end - 1) + 1
        else:
            shown.append(tags[k][:4])
            k += 1
    scale = outside if any(tag in ("article", "main") and not closing for _, _, tag, closing in shown) else 1.0
    gap = [("", 0.0, False, False)] * width

    def flush() -> None:
        nonlocal linked
        t = " ".join(html.unescape("".join(parts)).split())
        if t:
            out.append((t, float(len(t)) if main else scale * max(0, len(t) - 2 * linked), main > 0, prose))
        parts.clear()
        linked = 0

    at = 0
    for start, stop, tag, closing in [*shown, (len(page), len(page), "", False)]:
        if start > at:
            parts.append(page[at:start])
            if links > 0:
                linked += start - at
        at = stop
        if tag is None:
            flush()
            if closing and not main:
                out += gap
        elif tag in RAW and not closing:
            if tag not in ("svg", "math"):
                flush()
        elif tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = max(0, links + (-1 if closing else 1))
        elif tag:
            flush()
            links, prose = 0, tag in PROSE and not closing
            if tag in ("article", "main"):
                was, main = main, max(0, main + (-1 if closing else 1))
                if not was or not main:
                    out += gap
    flush()
    return out


def surges(weights: list[float], width: int) -> list[tuple[int, int, float]]:
    """(first, last, weight) of the lines between each surge of the windowed sums and its dive: the first and the last line with a weight of a stretch in which no ``width`` lines in a row have none."""
    out: list[tuple[int, int, float]] = []
    first = last = -1
    held = 0.0
    for k, w in enumerate(weights):
        if w <= 0:
            continue
        if first >= 0 and k - last > width:  # a window of ``width`` lines between them sums to nothing
            out.append((first, last, held))
            first, held = -1, 0.0
        if first < 0:
            first = k
        last, held = k, held + w
    if first >= 0:
        out.append((first, last, held))
    return out


def main_text(page: str, width: int = 3) -> str:
    """The text from the first to the last stretch of text, joined by line feeds. Of equally heavy stretches the first counts as the heaviest. A page without text has none."""
    all_lines = lines(page, width)
    found = surges([w for _, w, _, _ in all_lines], width)
    if not found:
        return ""
    top = max(found, key=lambda s: s[2])
    within = all_lines[top[0]][2]
    held = [any(prose and w > 0 for _, w, _, prose in all_lines[a : b + 1]) for a, b, _ in found]
    plain = within or not held[found.index(top)]
    text = [s for s, h in zip(found, held, strict=True) if all_lines[s[0]][2] == within and (plain or h or s == top)]
    first, last = text[0][0], text[-1][1]
    while first > 0 and all_lines[first - 1][3] and all_lines[first - 1][2] == within:
        first -= 1
    while last + 1 < len(all_lines) and all_lines[last + 1][3] and all_lines[last + 1][2] == within:
        last += 1
    return "\n".join(t for t, _, w, _ in all_lines[first : last + 1] if t and w == within)


def extract(pages: DataFrame, keep: list[str], source: str = "html") -> DataFrame:
    """The columns ``keep`` with text and n_chars (code points) of each row's whole page.

    A null or empty page has an empty text; rows are independent, so repeated ones give the same result again, as often as they stand there, and an empty table an
    empty one. A page is taken whole, however long; time grows with its length. Columns other than ``keep`` are ignored.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.decode("utf-8", "replace")) if p else "" for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 1) for k in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f"c{k}" for k in range(len(keep))), "text", "n_chars"])

    rows = pages.select(F.col(source).cast("binary").alias("page"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)])
    shape = ", ".join(f"c{k} {pages.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    out = rows.mapInArrow(take, f"{shape}, text string, n_chars long")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], "text", "n_chars")
