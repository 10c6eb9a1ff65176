"""SQL (DuckDB) of the corpus queries that SQL can express."""

from __future__ import annotations

from tilewright.llm.repetition import RepetitionRules

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

SUBSTRING = f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i + 19], ' ') END AS g FROM w),
f AS (SELECT doc_id, i, word, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM g),
c AS (SELECT doc_id, i, word, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) m USING (doc_id) LEFT JOIN n USING (doc_id)"""


def repetition(rules: RepetitionRules = RepetitionRules()) -> str:
    """SQL of the repetition rules."""
    tops, dups = dict(rules.top), dict(rules.duplicated)
    parts, joins, verdict = [], [], []
    for k in sorted({*tops, *dups, rules.repeat_window}):
        parts.append(f"""g{k} AS (SELECT doc_id, i, n, word, g, CASE WHEN g IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, g) END AS c, min(i) OVER (PARTITION BY doc_id, g) AS first
 FROM (SELECT doc_id, i, len(ws) AS n, ws[i] AS word, CASE WHEN i + {k - 1} <= len(ws) THEN array_to_string(ws[i:i + {k - 1}], ' ') END AS g FROM w)),
b{k} AS (SELECT doc_id, arg_min(g, {{'c': -c, 'f': first}}) AS g FROM g{k} WHERE c > 1 GROUP BY doc_id),
v{k} AS (SELECT doc_id, word, max(CASE WHEN c > 1 THEN 1 ELSE 0 END) OVER o AS dup, max(CASE WHEN c > 1 AND x.g = b.g THEN 1 ELSE 0 END) OVER o AS top
 FROM g{k} x LEFT JOIN b{k} b USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)),
t{k} AS (SELECT doc_id, count(*) FILTER (dup = 1) AS words{k}, sum(length(word)) FILTER (dup = 1) AS dup{k}, sum(length(word)) FILTER (top = 1) AS top{k} FROM v{k} GROUP BY doc_id)""")
        joins.append(f"LEFT JOIN t{k} USING (doc_id)")
        if k in tops:
            verdict.append(f"coalesce(top{k}, 0) > CAST({tops[k]} AS DOUBLE) * word_chars")
        if k in dups:
            verdict.append(f"coalesce(dup{k}, 0) > CAST({dups[k]} AS DOUBLE) * word_chars")
    r = rules.repeat_window
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
c AS (SELECT doc_id, sum(length(ws[i])) AS word_chars FROM w GROUP BY doc_id),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
n AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r > 1) AS n_dup_lines, coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) FILTER (r > 1), 0) AS dup_line_chars FROM l GROUP BY doc_id),
{", ".join(parts)},
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(words{r}, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join([f"top{k}" for k in tops] + [f"dup{k}" for k in dups])}
 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) {" ".join(joins)}),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT (n_dup_lines > CAST({rules.max_dup_line_share} AS DOUBLE) * n_lines OR dup_line_chars > CAST({rules.max_dup_line_chars} AS DOUBLE) * word_chars OR n_symbols > CAST({rules.max_symbols_per_word} AS DOUBLE) * n_words OR {" OR ".join(verdict)}) AS kept FROM b"""
