"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS win, least(len(w), 10) AS n
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(s) WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(s)
), hits AS (SELECT p.doc_id, p.s, p.n, win.item_id FROM places p JOIN win ON p.win = win.win AND p.n = win.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) AS u(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _level(parents: list[str], child: str, weight: str, source: str, above: str) -> str:
    """One step down the tree: the budgets of the children of each node, from the water level of the node."""
    p = ", ".join(parents)
    on = " AND ".join(f"n.{c} = a.{c}" for c in parents)
    return f"""
    (WITH n AS (SELECT {p}, {child}, sum(tokens) * 4.0 AS cap, {weight} AS weight FROM {source} GROUP BY ALL),
    c AS (
      SELECT n.*, a.budget AS total, n.cap / n.weight AS ratio,
             sum(n.cap) OVER (PARTITION BY {', '.join('n.' + x for x in parents)} ORDER BY n.cap / n.weight, n.{child} ROWS UNBOUNDED PRECEDING) AS caps,
             sum(n.weight) OVER (PARTITION BY {', '.join('n.' + x for x in parents)} ORDER BY n.cap / n.weight, n.{child} ROWS UNBOUNDED PRECEDING) AS weights,
             sum(n.weight) OVER (PARTITION BY {', '.join('n.' + x for x in parents)}) AS whole
      FROM n JOIN {above} a ON {on}
    ), f AS (SELECT *, caps + ratio * (whole - weights) <= total AS filled FROM c),
    g AS (SELECT *, coalesce(max(CASE WHEN filled THEN caps END) OVER (PARTITION BY {p}), 0) AS used, coalesce(max(CASE WHEN filled THEN weights END) OVER (PARTITION BY {p}), 0) AS gone FROM f)
    SELECT {p}, {child}, CASE WHEN filled THEN cap ELSE least(cap, weight * (total - used) / (whole - gone)) END AS budget FROM g)"""


MIXING = rf"""
WITH r AS (
  SELECT doc_id, 'd' || coalesce(CAST(TRY_CAST(regexp_extract(source, '[0-9]+$') AS INT) % 4 AS VARCHAR), 'null') AS domain, coalesce(lang, 'null') AS lang, coalesce(source, 'null') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens, 0 AS root FROM documents
), rows_ AS (SELECT * FROM r WHERE n_tokens > 0),
leaves AS (SELECT root, domain, lang, source, sum(n_tokens) AS tokens FROM rows_ GROUP BY ALL),
top AS (SELECT 0 AS root, floor(sum(tokens) * 0.5) AS budget FROM leaves),
l1 AS {_level(['root'], 'domain', "CASE domain WHEN 'd0' THEN 4.0::DOUBLE WHEN 'd1' THEN 3.0 WHEN 'd2' THEN 2.0 ELSE 1.0 END", 'leaves', 'top')},
l2 AS {_level(['root', 'domain'], 'lang', "CASE lang WHEN 'en' THEN 3.0::DOUBLE WHEN 'de' THEN 1.5 ELSE 1.0 END", 'leaves', 'l1')},
l3 AS {_level(['root', 'domain', 'lang'], 'source', '1.0::DOUBLE', 'leaves', 'l2')},
shares AS (
  SELECT domain, lang, source, tokens, budget, least(CAST(floor(round(CAST(budget AS DOUBLE) / tokens, 9)) AS BIGINT), 4) AS whole FROM l3 JOIN leaves USING (domain, lang, source)
), placed AS (
  SELECT rows_.*, whole, round(CAST(budget - whole * tokens AS DOUBLE), 3) AS rest, CAST('0x' || substr(md5('42-' || whole || '-' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h
  FROM rows_ JOIN shares USING (domain, lang, source)
), cut AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN start < rest THEN 1 ELSE 0 END AS BIGINT) AS copies,
       CAST(whole * n_tokens + greatest(0, least(n_tokens, ceil(rest - start))) AS BIGINT) AS n_taken
FROM cut WHERE whole + CASE WHEN start < rest THEN 1 ELSE 0 END > 0
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 1], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS u(p) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM c JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
reach(i, j) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.i, b.j FROM reach r JOIN both_ b ON r.j = b.i)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT i, min(j) AS component_id FROM reach GROUP BY i) m ON m.i = d.doc_id
"""

#: Only the items' terms meet the documents'; all else is integers.
RANKED = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT doc_id, translate(unnest(w), '{_UPPER}', '{_LOWER}') AS term FROM d),
b AS (
  SELECT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), '{_UPPER}', '{_LOWER}') AS term FROM benchmark
), q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
l AS (SELECT count(*) FILTER (len(w) > 0) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d),
m AS (SELECT doc_id, 75 + (25 * CAST(len(w) AS BIGINT) * big_n) // big_l AS m FROM d, l WHERE len(w) > 0),
p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), l),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""

COLLOCATIONS = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
), e AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
w AS (SELECT lang, piece, unnest(ws) AS w, generate_subscripts(ws, 1) AS s FROM e),
v AS (
  SELECT lang, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4, lead(w, 4) OVER p AS w5 FROM w WINDOW p AS (PARTITION BY lang, piece ORDER BY s)
), g AS MATERIALIZED (
  SELECT lang, 1 AS k, w AS phrase, count(*) AS f FROM v GROUP BY ALL
  UNION ALL SELECT lang, 2, w || ' ' || w2 AS phrase, count(*) FROM v WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 AS phrase, count(*) FROM v WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 AS phrase, count(*) FROM v WHERE w4 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 5, w || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 AS phrase, count(*) FROM v WHERE w5 IS NOT NULL GROUP BY ALL
),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
h AS MATERIALIZED (SELECT * FROM g WHERE f >= 100),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM h WHERE k > 1),
x AS (SELECT lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:k], ' ') AS y FROM c, unnest(range(1, k)) AS u(j)),
cuts AS (
  SELECT x.lang, x.phrase, x.k, a, j, p.f AS l, q.f AS r, n, (1000::HUGEINT * a * n) // (p.f::HUGEINT * q.f) AS score
  FROM x JOIN h p ON p.lang = x.lang AND p.phrase = x.x JOIN h q ON q.lang = x.lang AND q.phrase = x.y JOIN n ON n.lang = x.lang
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM c, unnest(range(2, k)) AS u(m), unnest(range(1, k - m + 2)) AS v(i) GROUP BY ALL
), kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE 100 * coalesce(longer, 0) < 100 * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 2000
"""

SQL = {"op12_ranked_search": RANKED, "op13_collocations": COLLOCATIONS, "op3_mixing": MIXING, "op7_decontamination": DECONTAMINATION, "op8_minhash": NEAR_DUPLICATES}
