"""License scan: exact phrases of words, and short notices with a bounded number of errors.

A notice may have so many edits; cut into one piece more, at least one piece stands unchanged in any
occurrence (pigeonhole). All pieces are looked for at once; where one is found, the regular
expression library matches the whole notice around it with bounded errors and tells its span and edits.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekit.llm import bytehash as bh

# The phrases whose places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Short notices in lower case, with their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "licensed under the apache license, version 2.0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "this work is licensed under the gnu general public license, version 3": "gpl",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms, with or without": "bsd",
    "released under the bsd 3-clause license": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under the eclipse public license": "epl",
    "permission to use, copy, modify, and/or distribute this software for any": "isc",
    "licensed under cc by-nc 4.0": "cc-by-nc",
    "licensed under cc by-sa 4.0": "cc-by-sa",
    "creative commons attribution-noncommercial": "cc-by-nc",
    "creative commons attribution-sharealike": "cc-by-sa",
    "creative commons attribution 4.0 international": "cc-by",
    "released into the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
}
SPANS = "array<struct<notice: string, label: string, start: long, stop: long, edits: int>>"


def edits_allowed(notice: str) -> int:
    """One edit for every twelve characters."""
    return max(1, len(notice) // 12)


class Notices:
    """The pieces of all notices in one automaton, and a pattern with bounded errors for each notice."""

    def __init__(self, notices: dict[str, str]) -> None:
        self.names = list(notices)
        self.labels = [notices[n] for n in self.names]
        self.most = [edits_allowed(n) for n in self.names]
        self.exact = [n.encode() for n in self.names]
        self.patterns = [regex.compile(rf"(?:{regex.escape(n, special_only=True, literal_spaces=True)}){{e<={e}}}".encode(), regex.BESTMATCH) for n, e in zip(self.names, self.most, strict=True)]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (n, e) in enumerate(zip(self.names, self.most, strict=True)):
            edge = [round(j * len(n) / (e + 1)) for j in range(e + 2)]
            for a, b in zip(edge, edge[1:], strict=False):
                pieces.setdefault(n[a:b], []).append((k, a))
        self.seeds = ahocorasick.Automaton()
        for p, of in pieces.items():
            self.seeds.add_word(p, (len(p), of))
        self.seeds.make_automaton()

    def find(self, low: bytes, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int, int]]]:
        """By text: (notice, start, stop, edits) of the best match around each seed; the text is lower-cased, white space made blanks."""
        seen: dict[int, list[tuple[int, int]]] = {}
        for end, (size, of) in self.seeds.iter(low.decode("latin-1")):
            for k, a in of:
                seen.setdefault(k, []).append((end + 1 - size - a, end + 1 - size))
        out: dict[int, set[tuple[int, int, int, int]]] = {}
        exact: list[tuple[int, int]] = []
        for k, places in seen.items():
            n = len(self.names[k])
            at = [s for s in {p[0] for p in places} if s >= 0 and low[s : s + n] == self.exact[k]]
            for s, d in zip(at, (np.searchsorted(offsets, at, side="right") - 1).tolist(), strict=True):
                if s + n <= offsets[d + 1]:
                    out.setdefault(d, set()).add((k, s - int(offsets[d]), s - int(offsets[d]) + n, 0))
                    exact.append((s, s + n))
        spans = np.array(sorted(exact), dtype=np.int64).reshape(-1, 2)
        reach = np.maximum.accumulate(spans[:, 1]) if exact else np.zeros(0, np.int64)
        for k, places in seen.items():
            e, n = self.most[k], len(self.names[k])
            done = -1
            seed = np.array([p[1] for p in places])
            doc = np.searchsorted(offsets, seed, side="right") - 1
            # what holds a seed within an exact notice overlaps that, and would give way to it
            inside = np.searchsorted(spans[:, 0], seed, side="right") - 1
            free = (inside < 0) | (reach[np.maximum(inside, 0)] <= seed) if exact else np.ones(seed.size, bool)
            for (start, _), d in sorted((p, d) for p, d, f in zip(places, doc.tolist(), free.tolist(), strict=True) if f):
                lo, hi = max(int(offsets[d]), start - e), min(int(offsets[d + 1]), start + n + e)
                if start < done and hi <= done + e:
                    continue
                if m := self.patterns[k].search(low, lo, hi):
                    out.setdefault(d, set()).add((k, m.start() - int(offsets[d]), m.end() - int(offsets[d]), sum(m.fuzzy_counts)))
                    done = m.end()
        return {d: self.apart(own) for d, own in out.items()}

    def apart(self, own: set[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Of notices that overlap, the one with the smallest share of edits stands; the others of one text give way to those that stand, in the order of their starts."""
        starts: list[int] = []
        kept: list[tuple[int, int, int, int]] = []
        for x in sorted(own, key=lambda x: (x[3] / len(self.names[x[0]]), x[1] - x[2], x)):
            at = bisect(starts, x[1])
            if (at == 0 or kept[at - 1][2] <= x[1]) and (at == len(kept) or x[2] <= kept[at][1]):
                starts.insert(at, x[1])
                kept.insert(at, x)
        return kept


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row's whole text.

    Words are runs of ASCII letters and digits (A-Z as a-z) and of all characters outside ASCII. n_base counts all places where
    the words of a phrase stand one after another; first_word and last_word are their smallest and largest start, null without any. Labels are
    distinct, sorted and joined by commas. spans tell the notices found, with start and stop in code points and the number of edits. The
    score is 1 with an exact phrase or notice, else 1 less the smallest share of edits of a notice found, 0 without any. Null
    texts count as empty; a text is taken whole, however long. Rows are independent: repeated ones, and null keys, each give their own row; an empty table gives an empty
    result. Other columns are ignored.
    """
    wanted = [([bh.hash_of(w.encode()) for w in p.split()], label) for p, label in phrases.items()]
    kind = docs.schema[key].dataType.simpleString()
    blank = bytes.maketrans(b"\t\n\v\f\r", b"     ")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Notices(notices)
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for rows, data, offsets in bh.blocks(batch):
                begins, stops, firsts = bh.words(data, offsets, bh.ALNUM)
                h = bh.hashes(data, begins, stops, bh.FOLDED)
                at: dict[int, list[tuple[int, str]]] = {}
                for w, label in wanted:
                    p = np.flatnonzero(h[: max(0, h.size - len(w) + 1)] == np.uint64(w[0]))
                    for j in range(1, len(w)):
                        p = p[h[p + j] == np.uint64(w[j])]
                    d = np.searchsorted(firsts, p, side="right") - 1
                    good = p + len(w) <= firsts[d + 1]
                    for x, q in zip(d[good].tolist(), p[good].tolist(), strict=True):
                        at.setdefault(x, []).append((q - int(firsts[x]), label))
                low = data.tobytes().lower().translate(blank)
                fuzzy = known.find(low, offsets)
                for k in range(rows.stop - rows.start):
                    own, near = at.get(k, []), fuzzy.get(k, [])
                    base = sorted({label for _, label in own})
                    spans, best = [], 1.0 if own else 0.0
                    if near:
                        # code points that begin before each byte; a span that cuts one in two has it as a whole
                        lead = (data[offsets[k] : offsets[k + 1]] & 0xC0) != 0x80
                        before = np.concatenate([[0], np.cumsum(lead)])
                        for n, a, b, e in near:
                            best = max(best, 1 - e / len(known.names[n]))
                            spans.append({"notice": known.names[n], "label": known.labels[n], "start": int(before[a]) - int(a < lead.size and not lead[a]), "stop": int(before[b]), "edits": e})
                    for c, v in zip(cols, (int(firsts[k + 1] - firsts[k]), len(own), min((p for p, _ in own), default=None), max((p for p, _ in own), default=None), ",".join(base), ",".join(sorted({*base, *(known.labels[n[0]] for n in near)})), best, spans), strict=True):
                        c.append(v)
            longs, strings = pa.int64(), pa.string()
            span = pa.list_(pa.struct([("notice", strings), ("label", strings), ("start", longs), ("stop", longs), ("edits", pa.int32())]))
            arrays = [pa.array(c, t) for c, t in zip(cols, (longs, longs, longs, longs, strings, strings, pa.float64(), span), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["k", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(look, f"k {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}").withColumnRenamed("k", key)
