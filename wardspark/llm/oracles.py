"""Corpus queries in SQL, where SQL can express them: plain definitions, without the methods that make them fast."""

from wardspark.llm.license_rules import BASE, rules
from wardspark.llm.license_scan import REACH, SCORES
from wardspark.llm.perspectives import SQL as PERSPECTIVES

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def licenses() -> str:
    rows = ", ".join(
        f"({number}, {rule.rank}, {_text(start)}, {_text(rule.pattern)}, {_text(rule.keyword)}, {_text(rule.label)})"
        for number, rule in enumerate(rules()) for start in dict.fromkeys(rule.starts))
    base = " UNION ALL ".join(
        f"SELECT r, i - 1 AS start, '{label}' AS label FROM spots WHERE " + " AND ".join(f"list_extract(words, i + {n}) = '{part}'" for n, part in enumerate(phrase.split(" ")))
        for phrase, label in BASE)
    scores = " ".join(f"WHEN {rank} THEN CAST({score} AS DOUBLE)" for rank, score in SCORES.items())
    return f"""
WITH rules(number, rank, start, pattern, keyword, label) AS (VALUES {rows}),
docs AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS words FROM documents),
gated AS (SELECT * FROM docs WHERE EXISTS (SELECT 1 FROM rules WHERE contains(array_to_string(words, ' '), keyword)) OR contains(array_to_string(words, ' '), 'rights reserved')),
spots AS (SELECT r, words, array_to_string(words, ' ') AS line, unnest(range(1, len(words) + 1)) AS i FROM gated),
base AS ({base}),
tried AS (
  SELECT r, i - 1 AS start, number, rank, u.label, regexp_extract(array_to_string(list_slice(words, i, i + {REACH - 1}), ' '), '^((?:' || pattern || '))(?: |$)', 1) AS found
  FROM spots JOIN rules u ON list_extract(words, i) = u.start AND contains(line, keyword)),
best AS (SELECT *, row_number() OVER (PARTITION BY r, start ORDER BY rank DESC, length(found) DESC, number) AS place FROM tried WHERE found <> ''),
hits AS (SELECT r, start, start + len(string_split(found, ' ')) AS stop, rank, label FROM best WHERE place = 1),
kept AS (
  SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.r = h.r AND o.start < h.start AND o.stop >= h.stop AND o.rank >= h.rank)
    AND NOT EXISTS (SELECT 1 FROM hits o WHERE o.r = h.r AND o.start > h.start AND o.stop <= h.stop AND o.rank > h.rank)),
named AS (SELECT r, label FROM base UNION SELECT r, label FROM kept),
of_base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
of_all AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM named GROUP BY r),
of_kept AS (SELECT r, max(rank) AS rank, string_agg(label || ':' || start || ':' || stop, ',' ORDER BY start) AS detections FROM kept GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE coalesce(rank, CASE WHEN n_base > 0 THEN 2 END, 0) {scores} END AS score, coalesce(detections, '') AS detections
FROM docs LEFT JOIN of_base USING (r) LEFT JOIN of_all USING (r) LEFT JOIN of_kept USING (r)"""


CAP_FILTERS = """
WITH RECURSIVE vectors AS (SELECT vec_id, label, row_number() OVER () AS r, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
fine AS (
  SELECT r, vec_id, label, v, sqrt(list_dot_product(v, v)) AS size FROM vectors
  WHERE v IS NOT NULL AND label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
  WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98),
reach(a, b) AS (SELECT r, r FROM vectors UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN vectors ON b = r GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM vectors JOIN least ON least.a = r LEFT JOIN counts ON counts.a = r"""

WINNOWING = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS words FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, words, least(13, len(words)) AS n FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
item_places AS (SELECT item, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM items),
windows AS (SELECT DISTINCT item, n, array_to_string(list_slice(words, k, k + n - 1), ' ') AS said FROM item_places),
doc_places AS (SELECT r, words, n, unnest(range(1, greatest(len(words) - n + 2, 1))) AS k FROM docs, (SELECT DISTINCT n FROM items)),
met AS (
  SELECT r, k, p.n, item FROM (SELECT r, k, n, array_to_string(list_slice(words, k, k + n - 1), ' ') AS said FROM doc_places) p JOIN windows w ON p.n = w.n AND p.said = w.said),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM met) GROUP BY r),
of_items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM met GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN of_items USING (r)"""

COLLOCATIONS = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
said AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS i FROM said, (VALUES (1), (2), (3)) AS t(m)),
counts AS (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
candidates AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE m > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS head, array_to_string(list_slice(w, k + 1, m), ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = head JOIN counts y ON y.lang = c.lang AND y.phrase = rest),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored) WHERE place = 1),
longer AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, array_to_string(list_slice(w, 1, 2), ' ') AS phrase FROM candidates WHERE m = 3 UNION ALL SELECT lang, a, array_to_string(list_slice(w, 2, 3), ' ') FROM candidates WHERE m = 3)
  GROUP BY lang, phrase),
kept AS (SELECT w.* FROM weakest w LEFT JOIN longer o ON o.lang = w.lang AND o.phrase = w.phrase WHERE most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes ON sizes.lang = ranked.lang WHERE rank <= 2000"""

ORACLES = {
    "op1_license_scan": licenses(),
    "op5_cap_filters": CAP_FILTERS,
    "op7_perspectives": PERSPECTIVES,
    "op10_winnowing_decontamination": WINNOWING,
    "op11_collocations": COLLOCATIONS,
}
