"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import quality_rules as q

_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP5 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, {_TRIM}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
held AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (keep IS NOT NULL AND keep <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep IS NULL OR keep = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN held USING (k) GROUP BY doc_id
"""


def _fence(level: str) -> str:
    return f"""
    SELECT {level} rule, max(docs) AS docs, min(bin) FILTER (upto * 100 >= docs * 25) AS q25,
           min(bin) FILTER (upto * 100 >= docs * 75) AS q75
    FROM (SELECT {level} rule, bin, sum(n) OVER (PARTITION BY {level} rule ORDER BY bin) AS upto,
                 sum(n) OVER (PARTITION BY {level} rule) AS docs
          FROM (SELECT {level} rule, bin, count(*) AS n FROM binned GROUP BY ALL))
    GROUP BY ALL"""


_RULES = ", ".join(f"('{r}', '{side}', {least})" for r, (side, least) in q.RULES.items())

#: The quality signals of whole texts, shared with the pipeline.
SIGNALS = """
words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w,
         generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS i
  FROM docs),
windows AS (
  SELECT doc_id, i, w || chr(1) || lead(w) OVER o || chr(1) || lead(w, 2) OVER o AS t
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM windows WHERE t IS NOT NULL),
       (VALUES (0), (1), (2)) AS s(k)
  WHERE c > 1 GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM words GROUP BY doc_id),
lined AS (
  SELECT doc_id, count(*) AS n_word_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
signals AS (
  SELECT d.doc_id, d.lang, d.source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_word_lines, 0) AS n_word_lines
  FROM docs d LEFT JOIN counted USING (doc_id) LEFT JOIN lined USING (doc_id) LEFT JOIN repeated USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM signals)
"""

OP8 = f"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents), {SIGNALS},
valued AS (
  SELECT doc_id, lang, source, unnest(['symbols', 'word_length', 'dup_lines', 'repeats']) AS rule,
         unnest([1000 * n_symbols // n_words, 1000 * word_chars // n_words, 1000 * n_dup_lines // n_word_lines,
                 1000 * n_repeat_words // n_words]) AS value
  FROM based WHERE NOT base_failed),
binned AS (
  SELECT *, (value >> greatest(length(bin(value)) - {q.PRECISION}, 0)) << greatest(length(bin(value)) - {q.PRECISION}, 0) AS bin
  FROM valued),
own AS ({_fence("lang, source,")}), by_lang AS ({_fence("lang,")}), everything AS ({_fence("")}),
fences AS (
  SELECT own.lang, own.source, own.rule, side, least,
         CASE WHEN own.docs >= {q.LEAST_DOCS} THEN own.q25 WHEN by_lang.docs >= {q.LEAST_DOCS} THEN by_lang.q25 ELSE everything.q25 END AS a,
         CASE WHEN own.docs >= {q.LEAST_DOCS} THEN own.q75 WHEN by_lang.docs >= {q.LEAST_DOCS} THEN by_lang.q75 ELSE everything.q75 END AS b
  FROM own JOIN by_lang ON own.lang IS NOT DISTINCT FROM by_lang.lang AND own.rule = by_lang.rule
       JOIN everything ON own.rule = everything.rule
       JOIN (VALUES {_RULES}) AS r(rule, side, least) ON own.rule = r.rule),
failed AS (
  SELECT DISTINCT doc_id
  FROM valued v JOIN fences f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source AND v.rule = f.rule
  WHERE value > b + {q.REACH} * (b - a) + least OR (side = 'both' AND value < a - {q.REACH} * (b - a) - least))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM failed) AS kept
FROM based
"""


OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM m
"""


#: Starts of 50-word windows of whole texts, each with a hash of its words.
_WINDOWS = """
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM w WHERE len(w) >= 50))"""

#: Islands of windows that overlap or touch, from (doc_id, s) of what goes, and their stretches.
_ISLANDS = """
o AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= {0} THEN 0 ELSE 1 END AS opens FROM gone),
n AS (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM o),
spans AS (SELECT doc_id, min(s) AS a, max(s) + {0} AS b FROM n GROUP BY doc_id, island),
removed AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list_sort(list({{'a': a, 'b': b}})) AS cuts FROM spans GROUP BY doc_id)"""

OP2 = f"""
WITH {_WINDOWS}, gone AS (SELECT doc_id, s FROM k QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1), {_ISLANDS.format(50)}
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans FROM w LEFT JOIN removed USING (doc_id)
"""

OP4 = f"""
WITH {_WINDOWS}, gone AS (SELECT doc_id, s FROM k QUALIFY doc_id > min(doc_id) OVER (PARTITION BY h)), {_ISLANDS.format(50)},
kept AS (SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN cuts IS NULL THEN w ELSE flatten(list_transform(range(1, len(cuts) + 2), lambda i: w[CASE WHEN i = 1 THEN 1 ELSE cuts[i - 1].b END : CASE WHEN i > len(cuts) THEN len(w) ELSE cuts[i].a - 1 END])) END AS left_
  FROM w LEFT JOIN removed USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed, sha256(array_to_string(left_, ' ')) AS kept_sha256 FROM kept
"""

OP10 = f"""
WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
k AS (SELECT doc_id, s, hash(x[2 * s - 1 : 2 * s + 398]) AS h FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 198)) AS s FROM x WHERE length(x) >= 400)),
gone AS (SELECT doc_id, s FROM k QUALIFY count(*) OVER (PARTITION BY h) > 1), {_ISLANDS.format(200)},
kept AS (SELECT x.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN cuts IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(cuts) + 2), lambda i: array_to_string(regexp_extract_all(x, '..')[CASE WHEN i = 1 THEN 1 ELSE cuts[i - 1].b END : CASE WHEN i > len(cuts) THEN length(x) // 2 ELSE cuts[i].a - 1 END], '')), '') END AS left_
  FROM x LEFT JOIN removed USING (doc_id))
SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed, n_spans, sha256(unhex(left_)) AS kept_sha256 FROM kept
"""

OP7 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS g FROM w),
c AS (SELECT md5(array_to_string(g, chr(10))) AS c, min(doc_id) AS rep, count(*) AS n, any_value(g) AS g FROM g GROUP BY g),
e AS (SELECT c, len(g) AS size, unnest(g) AS t FROM c),
j AS (SELECT a.c AS l, b.c AS r, any_value(a.size) AS x, any_value(b.size) AS y, count(*) AS both_ FROM e a JOIN e b ON a.t = b.t AND a.c <> b.c GROUP BY a.c, b.c),
links AS (SELECT l, r FROM j WHERE 10 * both_ >= 8 * (x + y - both_)),
reach AS (SELECT c AS l, c AS r FROM c UNION SELECT reach.l, links.r FROM reach JOIN links ON links.l = reach.r),
least AS (SELECT l AS c, min(rep) AS class_id FROM reach JOIN c ON c.c = reach.r GROUP BY l),
degree AS (SELECT l AS c, count(*) AS n_set_links, sum(n) AS documents FROM links JOIN c ON c.c = links.r GROUP BY l)
SELECT g.doc_id, class_id, (coalesce(documents, 0) + n - 1)::BIGINT AS n_links, coalesce(n_set_links, 0) AS n_set_links
FROM g JOIN c ON c.g = g.g JOIN least ON least.c = c.c LEFT JOIN degree ON degree.c = c.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_trees": OP2, "op3_warc": OP3, "op4_license_scan": OP4, "op5_line_dedup": OP5, "op7_jaccard_join": OP7, "op8_quality_rules": OP8, "op10_suffix_array": OP10}
