"""Registered queries of text functions: titles, templates, keys, pieces, replies, budgets; documents and parts make their inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import folds
from ..operators import summaries as S
from ..runtime import table

#: Lines of a document without white space at both ends, blank ones left out.
LINES = "list_filter(list_transform(string_split({0}, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda l: l <> '')"
STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def titles_and_templates(spark, sf_dir):
    """Titles of texts and summaries, template tests, gists and labels."""
    docs = _documents(spark, sf_dir).withColumn("made", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("source\n\n## "), F.substring("text", 1, 50), F.lit("\n- **Methods:** "), "text")).otherwise(F.col("text")))
    return docs.select(
        "doc_id", X.title_from_text(F.col("text")).alias("title"), X.title_from_summary(F.col("made")).alias("summary_title"),
        X.has_template(F.col("made")).alias("template"), X.gist(F.col("text")).alias("gist"), S.complete_template(F.col("made")).alias("complete"),
    )


TITLES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'source' || chr(10) || chr(10) || '## ' || substr(text, 1, 50) || chr(10) || '- **Methods:** ' || text ELSE text END AS made FROM d)
SELECT doc_id, {STRIP.format("ltrim(" + LINES.format("text") + "[1], '#')")} AS title,
  {STRIP.format("ltrim(list_filter(list_transform(string_split(made, chr(10))[1:6], lambda l: " + STRIP.format("l") + "), lambda l: starts_with(l, '#'))[1], '#')")} AS summary_title,
  starts_with(made, '## ') OR contains(made, chr(10) || '## ') AS template,
  CASE WHEN length(text) <= 260 THEN text ELSE regexp_replace(substr(text, 1, 260), ' [^ ]*$', '') || '…' END AS gist,
  (starts_with(made, '## ') OR contains(made, chr(10) || '## ')) AND len(list_filter(['Question & context', 'Empirical context', 'Literature drawn on', 'Methods', 'Arguments', 'Key conclusions', 'Discussion items'], lambda f: contains(made, '**' || f))) >= 5 AS complete
FROM m
"""


def normal_forms(spark, sf_dir):
    """Ligatures, invisible characters, white space, dashes and header keys of a text's start."""
    start = F.concat(F.lit("  ﬁrst—­part "), F.regexp_replace(F.substring("text", 1, 200), "a", "ﬀ"), F.lit("​ ..."))
    return _documents(spark, sf_dir).select(
        "doc_id", X.expand(start).alias("expanded"), X.norm(start).alias("norm"), X.loose(start).alias("loose"), X.name_key(start).alias("name"),
        X.header_key(F.substring("text", 1, 6)).alias("header"), X.slug(start).alias("slug"),
    )


_START = "'  ﬁrst—' || chr(173) || 'part ' || replace(substr(text, 1, 200), 'a', 'ﬀ') || chr(8203) || ' ...'"
_COLLAPSE = "trim(regexp_replace({0}, '[\\s\\x0B]+', ' ', 'g'))"
_EXPANDED = "replace(replace(replace(replace(s, 'ﬀ', 'ff'), 'ﬁ', 'fi'), chr(173), ''), chr(8203), '')"
FORMS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS (SELECT doc_id, text, {_START} AS s FROM d)
SELECT doc_id, {_EXPANDED} AS expanded, {_COLLAPSE.format(_EXPANDED)} AS norm, lower({_COLLAPSE.format('s')}) AS loose,
  rtrim(lower({_COLLAPSE.format("replace(s, '—', '-')")}), '.') AS name,
  CASE WHEN length(regexp_replace(lower(substr(text, 1, 6)), '[^a-z]', '', 'g')) >= 5 THEN regexp_replace(lower(substr(text, 1, 6)), '[^a-z]', '', 'g') END AS header,
  substr(trim(regexp_replace(lower(s), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40) AS slug FROM s
"""


def pieces_and_briefs(spark, sf_dir):
    """What is embedded: pieces of a document, text of a brief, and its size."""
    docs, lines = _documents(spark, sf_dir), F.split("text", "\n")
    part = lambda k: F.coalesce(F.get(lines, F.lit(k)), F.lit(""))
    record = {"authors": part(0), "title": part(1), "question": part(2), "arguments": part(3), "conclusions": part(4)}
    pieces = X.pieces_of(F.col("text"))
    return docs.select(
        "doc_id", F.size(pieces).alias("pieces"), F.array_join(F.transform(pieces, lambda p: F.concat_ws(":", F.length(p), F.substring(p, 1, 5))), "|").alias("cuts"),
        X.brief_text(part(1), part(2), part(3), part(4)).alias("brief"), X.short_brief_chars(record).alias("short"), S.pooled_text(part(1), part(2), part(3)).alias("pooled"),
    )


BRIEFS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
p AS (SELECT *, list_filter(list_transform(range(greatest(ceil(length(text) / 5000)::INT, 1)), lambda i: {STRIP.format('substr(text, (i * 5000 + 1)::INT, 5000)')}), lambda x: x <> '')[1:40] AS p FROM d),
f AS (SELECT *, coalesce(l[1], '') AS a, coalesce(l[2], '') AS b, coalesce(l[3], '') AS c, coalesce(l[4], '') AS e, coalesce(l[5], '') AS g FROM p)
SELECT doc_id, len(p)::INT AS pieces, array_to_string(list_transform(p, lambda x: length(x) || ':' || substr(x, 1, 5)), '|') AS cuts,
  substr(array_to_string(list_filter([b, c, e, g], lambda x: x <> ''), chr(10) || chr(10)), 1, 5000) AS brief,
  (length(a) + length(b) + length(c) + least(500, length(e)) + least(300, length(g)))::INT AS short,
  array_to_string(list_filter([b, c, e], lambda x: x <> ''), ' ') AS pooled FROM f
"""


def query_rewrites(spark, sf_dir):
    """Field aliases, field terms, match expressions and pieces of snippets, over part names."""
    n = F.col("p_name")
    word = F.get(F.split(n, " "), F.lit(0))
    asked = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("lit:")).otherwise(F.lit("author:")), n, F.lit(" context:x"))
    snippet = F.concat(n, F.lit(" ["), word, F.lit("] "), n)
    parts = X.snippet_parts(snippet)
    author = F.when(F.col("p_partkey") % 5 == 0, F.lit('O"Hara'))
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.field_query(asked).alias("query"), X.field_terms("title", F.concat(n, F.lit("-a é1"))).alias("terms"),
        F.array_join(F.transform(parts, lambda p: F.concat(p["text"], p["matched"].cast("string"))), "|").alias("parts"),
        S.match_expression(F.concat(F.lit(" "), n), author).alias("expression"),
        S.plain_words(F.when(F.col("p_partkey") % 3 == 0, asked).otherwise(n), author).alias("plain"),
    )


REWRITES = """
WITH n AS (SELECT p_partkey, p_name AS n, string_split(p_name, ' ')[1] AS w, CASE WHEN p_partkey % 5 = 0 THEN 'O"Hara' END AS a FROM part)
SELECT p_partkey, (CASE WHEN p_partkey % 2 = 0 THEN 'literature:' ELSE 'authors_raw:' END) || n || ' question_context:x' AS query,
  array_to_string(list_transform(list_filter(string_split(regexp_replace(n || '-a é1', '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: length(x) > 1), lambda x: 'title:' || x), ' ') AS terms,
  n || ' false|' || w || 'true| ' || n || 'false' AS parts,
  CASE WHEN a IS NULL THEN n ELSE n || ' AND authors_raw:"O"Hara"' END AS expression, a IS NULL AND p_partkey % 3 <> 0 AS plain FROM n
"""


def name_checks(spark, sf_dir):
    """Keys of file names, works of chapters, names of paths, and agreement of titles and authors."""
    n = F.translate("p_name", " ", "_")
    stem = F.concat(F.lit("Smith, J_"), n, F.lit("_"), F.format_string("%02d", F.col("p_partkey") % 100))
    text_key, sum_key = X.text_key_of(F.concat(F.lit("text_"), stem, F.lit(".md"))), X.summary_key(F.concat(F.lit("sum_"), stem, F.lit(".md")))
    words = F.split("p_name", " ")
    other = F.array_join(F.slice(words, 1, 1 + F.pmod(F.col("p_partkey"), F.size(words))), " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text_key["stem"].alias("text_stem"), text_key["chapter"].alias("text_chapter"), sum_key["stem"].alias("sum_stem"), sum_key["chapter"].alias("sum_chapter"),
        X.work_of(stem).alias("work"), X.last_component(F.concat(F.lit("a\\b/"), n, F.lit(".md"))).alias("file"),
        F.round(X.same_title(F.col("p_name"), other), 6).alias("same"),
        X.has_author(stem, F.array(F.when(F.col("p_partkey") % 2 == 0, F.lit("J. Smith")).otherwise(F.lit("A. Jones")))).alias("author"),
    )


_WORDS = "list_filter(string_split(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: length(w) > 2)"
CHECKS = f"""
WITH n AS (SELECT p_partkey, p_name, replace(p_name, ' ', '_') AS n, string_split(p_name, ' ') AS w FROM part),
o AS (SELECT *, array_to_string(w[1 : 1 + p_partkey % len(w)], ' ') AS other FROM n),
s AS (SELECT *, {_WORDS.format('p_name')} AS a, {_WORDS.format('other')} AS b FROM o),
c AS (SELECT *, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_filter(a, lambda x: list_contains(b, x) OR contains(array_to_string(b, ''), x))) / len(a) END AS ab,
  CASE WHEN len(b) = 0 THEN 0 ELSE len(list_filter(b, lambda x: list_contains(a, x) OR contains(array_to_string(a, ''), x))) / len(b) END AS ba FROM s)
SELECT p_partkey, 'Smith, J_' || n AS text_stem, printf('%02d', p_partkey % 100) AS text_chapter, 'Smith, J_' || n AS sum_stem, printf('%02d', p_partkey % 100) AS sum_chapter,
  'Smith, J_' || n AS work, n || '.md' AS file, round(greatest(ab, ba), 6) AS same, p_partkey % 2 = 0 AS author FROM c
"""


def replies(spark, sf_dir):
    """Lists in replies, labelled bullets, fields of a map, numbered lists, sizes in words."""
    words = F.split("p_name", " ")
    numbered = F.array_join(F.transform(words, lambda w, i: F.concat((i + 1).cast("string"), F.lit(") "), w)), "\n")
    reply = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Here:\n"), numbered)).otherwise(F.array_join(words, "\n\n"))
    labelled = F.concat(F.lit("**Works:**\n- "), F.array_join(words, "\n- "), F.lit("\n- None.\n**Terms:** "), "p_name", F.lit(" *\n**End:** x"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(X.bullet_items(reply), "|").alias("items"), X.numbered_list(words).alias("listed"),
        F.array_join(X.labelled_bullets(labelled, "Works", ["Terms", "End"]), "|").alias("works"), S.labelled_field(labelled, "Terms", ["End"]).alias("terms"),
        X.size_words(F.col("p_partkey") * 977).alias("size"), S.cost_words(F.when(F.col("p_partkey") % 4 > 0, F.col("p_partkey") / 4)).alias("cost"),
    )


REPLIES = """
WITH n AS (SELECT *, string_split(p_name, ' ') AS w, p_partkey * 977 AS b FROM part)
SELECT p_partkey, array_to_string(w, '|') AS items, array_to_string(list_transform(w, lambda x, i: i || '. ' || x), chr(10)) AS listed, array_to_string(w, '|') AS works, p_name AS terms,
  CASE WHEN b < 1024 THEN b || ' bytes' WHEN b < 1048576 THEN ceil(b / 1024)::BIGINT || ' KB' ELSE printf('%.1f MB', b / 1048576) END AS size,
  CASE WHEN p_partkey % 4 = 0 THEN 'no price known' WHEN p_partkey / 4 < 0.01 THEN 'under one cent' ELSE printf('about $%.2f', p_partkey / 4) END AS cost FROM n
"""


def summary_inputs(spark, sf_dir):
    """What a summary call gets: the whole text or its first third and passages; quotes document; scanned-page decision."""
    docs = _documents(spark, sf_dir)
    sentences = F.slice(X.sentences(F.col("text")), 1, 3)
    return docs.select(
        "doc_id", F.md5(S.prompt_text(F.col("text"), sentences, 2000)).alias("prompt"), F.md5(S.quotes_document(sentences)).alias("quotes"),
        S.needs_ocr(F.col("doc_id") % 5, F.lit(8)).alias("ocr"), F.length(folds.body_span(F.col("text"))).alias("body"),
    )


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\\s\\x0B]+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: " + STRIP.format("s") + "), lambda s: s <> '')"
INPUTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS (SELECT *, {_SENTENCES}[1:3] AS s FROM d)
SELECT doc_id, md5(CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, 1, 666) || chr(10) || chr(10) || array_to_string(s, chr(10) || chr(10)) END) AS prompt,
  md5(array_to_string(list_transform(s, lambda x: '- "' || x || '"'), chr(10))) AS quotes, doc_id % 5 >= 4 AS ocr, length(text)::INT AS body FROM s
"""

QUERIES = {
    "titles_and_templates": (titles_and_templates, TITLES),
    "normal_forms": (normal_forms, FORMS),
    "pieces_and_briefs": (pieces_and_briefs, BRIEFS),
    "query_rewrites": (query_rewrites, REWRITES),
    "name_checks": (name_checks, CHECKS),
    "replies": (replies, REPLIES),
    "summary_inputs": (summary_inputs, INPUTS),
}
