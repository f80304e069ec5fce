"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tableproof.llm.url_filter import RULES, Vocabulary


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def url_vocabulary(vocabulary: Vocabulary = Vocabulary()) -> str:
    edge = r"[^\p{L}\p{N}]"
    has = lambda term: f"regexp_matches(lower(coalesce(url, '')), '(^|{edge}){term}({edge}|$)')"
    strict = " OR ".join(has(t) for t in vocabulary.strict)
    count = " + ".join(f"{has(t)}::INT" for t, _ in vocabulary.soft)
    weight = " + ".join(f"CASE WHEN {has(t)} THEN {w}::DOUBLE ELSE 0 END" for t, w in vocabulary.soft)
    fits = lambda r: f"(host = {_text(r.host)} OR host LIKE {_text('%.' + r.host)}) AND starts_with(path, {_text(r.path)})"
    ordered = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    pick = lambda of: "CASE " + " ".join(f"WHEN {fits(r)} THEN {_text(getattr(r, of))}" for r in ordered) + " END"
    return rf"""
WITH u AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
s AS (SELECT *, {strict} AS strict, {count} AS n, {weight} AS w FROM u)
SELECT page_id, host, path, {pick("name")} AS rule,
       coalesce({pick("verdict")}, CASE WHEN strict OR (n >= {vocabulary.soft_terms} AND w >= {vocabulary.soft_limit}) THEN 'block' ELSE 'allow' END) AS verdict
FROM s"""


HOST_RULES = r"""
WITH w AS (SELECT doc_id, source AS host, coalesce(text, '') AS text,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
           FROM documents),
grams AS (SELECT doc_id, i, ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2] AS g
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
places AS (SELECT DISTINCT doc_id, i + k AS p FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM places GROUP BY doc_id),
m AS (SELECT doc_id, host, len(ws) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             (word_chars / greatest(n_words, 1) < 2.0 OR word_chars / greatest(n_words, 1) > 20.0)::INT
             + (n_symbols / greatest(n_words, 1) > 0.2)::INT
             + (n_dup_lines / greatest(n_lines, 1) > 0.3)::INT
             + (100 * n_repeat_words > 30 * n_words)::INT AS soft FROM m),
h AS (SELECT host, count(*) AS n, sum((base_failed OR soft > 0)::INT) AS f FROM j GROUP BY host),
mo AS (SELECT avg(f / n) AS mean, coalesce(var_pop(f / n), 0) AS spread, avg(1.0::DOUBLE / n) AS inv, sum(n)::DOUBLE AS alldocs FROM h),
pr AS (SELECT mean, CASE WHEN mean > 0 AND mean < 1 AND spread - mean * (1 - mean) * inv > 0
                         THEN least(greatest(mean * (1 - mean) / (spread - mean * (1 - mean) * inv) - 1, 0), alldocs) ELSE alldocs END AS s FROM mo),
v AS (SELECT host, (f + mean * s) / (n + s) AS rate FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND soft < CASE WHEN rate >= 0.9 THEN 0 WHEN rate >= 0.5 THEN 1 ELSE 2 END AS kept,
       CASE WHEN rate >= 0.9 THEN 'blocked' WHEN rate >= 0.5 THEN 'suspect' ELSE 'trusted' END AS host_verdict
FROM j JOIN v ON j.host IS NOT DISTINCT FROM v.host"""

LINE_SPREAD = r"""
WITH parts AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, i, trim(regexp_replace(lower(ls[i]), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS k
      FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM parts)),
b AS (SELECT k, min(doc_id) AS first_id FROM l WHERE k <> '' GROUP BY k
      HAVING count(DISTINCT source) + (count(*) > count(source))::INT >= 10),
bad AS (SELECT DISTINCT doc_id, i FROM l JOIN b USING (k) WHERE doc_id <> first_id),
left_ AS (SELECT p.doc_id, count(*) FILTER (bad.i IS NOT NULL) AS n_removed,
                 string_agg(p.line, chr(10) ORDER BY p.i) FILTER (bad.i IS NULL) AS text
          FROM (SELECT doc_id, ls[i] AS line, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM parts)) p
          LEFT JOIN bad ON p.doc_id = bad.doc_id AND p.i = bad.i GROUP BY p.doc_id)
SELECT doc_id, text, n_removed FROM left_ WHERE n_removed = 0 OR regexp_matches(coalesce(text, ''), '[^\x20\x09-\x0D]')
UNION ALL SELECT doc_id, text, 0 FROM documents WHERE text IS NULL"""

NEAR_COPIES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, top) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.top FROM reach r JOIN edge e ON e.a = r.node),
comp AS (SELECT node AS doc_id, min(top) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)"""
