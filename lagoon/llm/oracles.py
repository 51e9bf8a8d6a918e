"""DuckDB SQL for those queries on documents that SQL can express on whole tables."""

from __future__ import annotations

from lagoon.llm.quality import POLICIES, RULES

#: Exact sets and all pairs that share a shingle; the recursion follows links of distinct sets.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(words) >= 4 THEN list_distinct([array_to_string(words[i:i + 3], chr(10)) FOR i IN range(1, len(words) - 2)])
    WHEN len(words) > 0 THEN [array_to_string(words, chr(10))] ELSE [] END AS shingles FROM w),
c AS (SELECT doc_id, len(shingles) AS n, md5(array_to_string(list_sort(shingles), chr(11))) AS k, shingles FROM g),
s AS (SELECT k, any_value(n) AS n, min(doc_id) AS least, any_value(shingles) AS shingles FROM c WHERE n > 0 GROUP BY k),
e AS (SELECT k, n, unnest(shingles) AS x FROM s),
p AS (
  SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.x = b.x AND a.k <> b.k
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(k, reach) AS (SELECT k, k FROM s UNION SELECT r.k, p.b FROM r JOIN p ON p.a = r.reach),
m AS (SELECT r.k, min(s.least) AS component_id FROM r JOIN s ON s.k = r.reach GROUP BY r.k)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM c LEFT JOIN m ON c.k = m.k AND c.n > 0
"""

_FAILED = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES.values()))
_MASK = {p: sum(1 << list(RULES).index(r) for r in rules) for p, rules in POLICIES.items()}

QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], chr(10)) AS x FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM d, range(5) t(j) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN l ON w.doc_id = l.doc_id),
f AS (SELECT *, CAST({_FAILED} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {_MASK['base']}) <> 0 AS base_failed, (failed & {_MASK['v1']}) = 0 AS kept, failed FROM f
"""
