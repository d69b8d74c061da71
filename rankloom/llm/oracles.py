"""DuckDB SQL of the corpus queries that SQL can express; their rows must equal those of the queries."""

from __future__ import annotations

from . import mixing, quality, substrings, warc

_WORD = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)])) END AS sh FROM w),
c AS (SELECT sh, min(doc_id) AS rep, count(*) AS copies, any_value(len(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
u AS (SELECT rep, n, unnest(sh) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.rep < b.rep
      WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM p WHERE 100 * k >= 90 * (na + nb - k)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT rep AS x, rep AS r FROM c UNION SELECT e.b, reach.r FROM reach JOIN both_ways e ON e.a = reach.x),
k AS (SELECT x, min(r) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id, coalesce(c.copies, 1) AS n_copies
FROM s LEFT JOIN c ON s.sh = c.sh LEFT JOIN k ON k.x = c.rep
"""

QUALITY = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, {_WORD}) AS ws FROM t),
win AS (SELECT r, i, array_to_string(ws[i : i + {quality.REPEAT_WIDTH - 1}], ' ') AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - {quality.REPEAT_WIDTH - 2})) AS i FROM w)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {quality.REPEAT_WIDTH})) AS p FROM twice) GROUP BY r),
line AS (SELECT r, source, unnest(string_split(t, chr(10))) AS x FROM t),
worded AS (SELECT r, source, x, regexp_extract_all(translate(x, '{_UPPER}0123456789', '{_LOWER}0000000000'), {_WORD}) AS ws FROM line),
folded AS (SELECT r, source, x, array_to_string(ws, ' ') AS y, len(ws) AS n FROM worded WHERE len(ws) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM folded GROUP BY r),
common AS (SELECT source, y FROM folded GROUP BY source, y HAVING count(DISTINCT r) >= {quality.LINE_DOCS}),
lost AS (SELECT f.r, sum(f.n) AS n FROM folded f JOIN common c ON f.y = c.y AND f.source IS NOT DISTINCT FROM c.source GROUP BY f.r),
m AS (
  SELECT t.doc_id, len(w.ws) AS n_words, coalesce(list_sum([length(x) FOR x IN w.ws]), 0) AS word_chars, length(t.t) - length(regexp_replace(t.t, '[{quality.SYMBOLS.decode()}]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS lost
  FROM t JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN again USING (r) LEFT JOIN lost USING (r)),
v AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND n_words - lost >= {quality.LEAST_WORDS} AND n_words - lost >= {quality.LEAST_LEFT} * n_words AS kept,
  CAST(CASE WHEN base_failed THEN 0 ELSE lost END AS BIGINT) AS n_common_words
FROM v
"""

SUBSTRINGS = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
win AS (SELECT r, i, array_to_string(ws[i : i + {substrings.WIDTH - 1}], ' ') AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - {substrings.WIDTH - 2})) AS i FROM w)),
often AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY x) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {substrings.WIDTH})) AS p FROM often),
word AS (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT word.r, count(gone.p) AS n, coalesce(string_agg(word.x, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL), '') AS t
         FROM word LEFT JOIN gone ON word.r = gone.r AND word.p = gone.p GROUP BY word.r)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.r = kept.r
"""

WARC = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS ref FROM p WHERE payload_bytes >= {warc.REVISIT_BYTES} GROUP BY payload_digest)
SELECT p.page_id, payload_bytes, payload_digest, CASE WHEN ref <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN ref <> page_id THEN ref END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": NGRAM_JOIN, "op4_quality_rules": QUALITY, "op7_substring_dedup": SUBSTRINGS, "op8_warc_writer": WARC, "op10_source_mixing": mixing.oracle()}
