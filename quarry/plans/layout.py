"""Registered queries of page geometry and of book structure; order lines stand for glyphs and lines, sources for books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import books as K
from ..operators import folds
from ..operators import layout as G
from ..operators import pages as P
from ..runtime import table


def _line(spark, sf_dir):
    """One row per order line number of an order, with made-up geometry."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.max("l_partkey").alias("k"), F.max("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))


LINE = "i AS (SELECT l_orderkey AS o, l_linenumber AS n, max(l_partkey) AS k, max(l_suppkey) AS s, max(l_quantity) AS q FROM lineitem GROUP BY ALL)"


def glyph_lines(spark, sf_dir):
    k = F.col("k")
    glyphs = _line(spark, sf_dir).select((F.col("o") % 12).alias("doc"), (F.col("o") % 5).alias("page"), (F.col("o") * 10 + F.col("n")).alias("pos"), F.substring(F.lit("abcdefghijkl"), (k % 12 + 1).cast("int"), F.lit(1)).alias("text"), F.col("q").alias("x0"), (k % 9).cast("double").alias("y0"), (F.col("q") + 1).alias("x1"), (k % 9 + 10).cast("double").alias("y1"), (F.col("s") % 4 + 8.25).cast("double").alias("size"), (k % 2 == 0).alias("bold"), (F.col("s") % 6 == 0).alias("brk"))
    return G.lines_from_glyphs(glyphs)


GLYPHS = f"""
WITH {LINE}, g AS (SELECT o % 12 AS doc, o % 5 AS page, o * 10 + n AS pos, substr('abcdefghijkl', (k % 12 + 1)::INT, 1) AS text, q AS x0, (k % 9)::DOUBLE AS y0, q + 1 AS x1, (k % 9 + 10)::DOUBLE AS y1, round_even((s % 4 + 8.25) * 2, 0) / 2 AS half, k % 2 = 0 AS bold, s % 6 = 0 AS brk FROM i),
l AS (SELECT *, sum(brk::INT) OVER (PARTITION BY doc, page ORDER BY pos)::BIGINT AS line FROM g), m AS (SELECT * FROM l WHERE NOT brk),
c AS (SELECT doc, page, line, half, count(*) AS n, min(pos) AS first FROM m GROUP BY ALL), z AS (SELECT doc, page, line, half AS size FROM c QUALIFY row_number() OVER (PARTITION BY doc, page, line ORDER BY n DESC, first) = 1)
SELECT doc, page, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, avg(bold::INT) > 0.6 AS bold, string_agg(text, '' ORDER BY pos) AS text, any_value(size)::DOUBLE AS size FROM m JOIN z USING (doc, page, line) GROUP BY ALL
"""


def _lines(spark, sf_dir):
    """Lines of pages in a column each, with a bullet or number at some."""
    k = F.col("k")
    mark = F.when(k % 6 == 0, "• ").when(k % 6 == 1, "2. ").otherwise("")
    return _line(spark, sf_dir).select((F.col("o") % 40).alias("doc"), F.col("o").alias("page"), F.col("n").alias("line"), F.concat(mark, F.lit("word "), k).alias("text"), (k % 3 * 5).cast("double").alias("x0"), (F.col("n") * 14 + k % 4 * 5).cast("double").alias("y0"), (k % 3 * 5 + 60 + F.col("s") % 40).cast("double").alias("x1"), (F.col("n") * 14 + k % 4 * 5 + 10).cast("double").alias("y1"), (F.when(k % 11 == 0, 16).when(k % 13 == 0, 13).otherwise(10)).cast("double").alias("size"), (k % 5 == 0).alias("bold"))


LINES = f"""{LINE}, l AS (SELECT o % 40 AS doc, o AS page, n AS line, (CASE k % 6 WHEN 0 THEN '• ' WHEN 1 THEN '2. ' ELSE '' END) || 'word ' || k AS text, (k % 3 * 5)::DOUBLE AS x0, (n * 14 + k % 4 * 5)::DOUBLE AS y0,
  (k % 3 * 5 + 60 + s % 40)::DOUBLE AS x1, (n * 14 + k % 4 * 5 + 10)::DOUBLE AS y1, (CASE WHEN k % 11 = 0 THEN 16 WHEN k % 13 = 0 THEN 13 ELSE 10 END)::DOUBLE AS size, k % 5 = 0 AS bold FROM i),
p AS (SELECT *, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1 FROM l WINDOW w AS (PARTITION BY doc, page ORDER BY line)),
b AS (SELECT * EXCLUDE (px0, px1, py1), sum((py1 IS NULL OR y0 - py1 > y1 - y0 OR y0 - py1 < y0 - y1 OR ((x0 > px1 OR x1 < px0) AND abs(x0 - px0) > 30))::INT) OVER (PARTITION BY doc, page ORDER BY line) - 1 AS block FROM p)"""


def _blocks(spark, sf_dir):
    return G.blocks(_lines(spark, sf_dir), F.lit(100.0))


def text_blocks(spark, sf_dir):
    """Blocks with their geometry, and list items in them."""
    return G.item_starts(G.block_geometry(_blocks(spark, sf_dir))).select("doc", "page", "line", "block", "left", "right", "width", "lh", "item")


BLOCKS = f"""
WITH {LINES}
SELECT doc, page, line, block::BIGINT AS block, min(x0) OVER w AS "left", max(x1) OVER w AS "right", greatest(max(x1) OVER w - min(x0) OVER w, 1) AS width, median(y1 - y0) OVER w AS lh,
  CASE WHEN starts_with(text, '• ') THEN 'bullet' WHEN starts_with(text, '2. ') AND count(*) FILTER (starts_with(text, '2. ')) OVER w >= 2 THEN 'number' END AS item FROM b WINDOW w AS (PARTITION BY doc, page, block)
"""


def page_statistics(spark, sf_dir):
    """Body size, heading sizes and line height of a document, and the level of each heading size."""
    stats = P.statistics(_lines(spark, sf_dir))
    return stats.select("doc", "body", F.array_join(F.transform("heads", lambda x: x.cast("string")), ",").alias("heads"), "lh", P.heading_rank(F.lit(13.0), F.col("heads")).alias("rank"))


STATISTICS = f"""
WITH {LINES}, z AS (SELECT doc, size, sum(length(text)) AS n, min((page, line)) AS first FROM l GROUP BY ALL), o AS (SELECT doc, size AS body FROM z QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, first) = 1),
h AS (SELECT doc, list_sort(list(size) FILTER (size > body + 0.5), 'DESC') AS heads FROM z JOIN o USING (doc) GROUP BY doc), m AS (SELECT doc, median(y1 - y0) AS lh FROM l GROUP BY doc)
SELECT doc, body, array_to_string(coalesce(heads, []), ',') AS heads, lh, CASE WHEN list_contains(heads, 13.0) THEN least(list_position(heads, 13.0), 4) WHEN len(heads) > 0 THEN least(len(heads) + 1, 4) ELSE 2 END::INT AS rank
FROM o JOIN h USING (doc) JOIN m USING (doc)
"""


def book_words(spark, sf_dir):
    """Vocabulary of a source, by first letter, and the function words among its tokens."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    lines = docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("line"), F.col("text"))
    words = P.vocabulary(lines).groupBy("doc").agg(F.count(F.lit(1)).alias("words"))
    function = K.lexicon(lines).groupBy("doc").agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("n"), F.sum(F.when(F.col("is_function"), F.col("n"))).alias("function"))
    return words.join(function, "doc")


BOOK_WORDS = """
WITH d AS (SELECT source AS doc, text FROM documents WHERE text IS NOT NULL),
w AS (SELECT DISTINCT doc, lower(unnest(list_concat(regexp_extract_all(text, '\\p{L}{2,}'), regexp_extract_all(text, '\\p{L}{2,}-\\p{L}{2,}')))) AS word FROM d),
t AS (SELECT doc, token, count(*) AS n FROM (SELECT doc, lower(unnest(regexp_extract_all(text, '\\p{L}+'))) AS token FROM d) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC) AS r FROM t),
c AS (SELECT doc, count(*) AS words FROM w GROUP BY doc)
SELECT doc, words, count(*) AS tokens, sum(n)::BIGINT AS n, sum(n) FILTER (r <= 40)::BIGINT AS function FROM r JOIN c USING (doc) GROUP BY doc, words
"""


def heading_tests(spark, sf_dir):
    """Heading tests over made-up lines, with sizes and without."""
    k = F.col("o_orderkey") % 8
    text = F.element_at(F.array(*map(F.lit, ["1.2 Methods used", "INTRODUCTION", "Some plain words", "Chapter 4 of it", "Abstract.", "RESULTS AND MORE,", "2 " + "long " * 20, "Discussion"])), (k + 1).cast("int"))
    heads = F.array(F.lit(16.0), F.lit(13.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.is_heading(text).alias("plain"), P.is_heading(text, F.when(F.col("o_custkey") % 4 == 0, 13.0).otherwise(10.0), F.col("o_custkey") % 3 == 0, heads).alias("sized"),
                                                 X.numbered_depth(text).alias("depth"), X.heading_level(F.concat(F.expr("repeat('#', cast(o_custkey % 8 as int))"), F.lit(" "), text)).alias("level"), X.title_like(text).alias("like"))


HEADING_TESTS = """
WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_custkey AS c FROM orders)
SELECT o_orderkey, k IN (1, 3, 7) AS plain, c % 4 = 0 OR k IN (1, 3, 7) AS sized, CASE k WHEN 0 THEN 2 WHEN 3 THEN 1 WHEN 6 THEN 1 END::INT AS depth, CASE WHEN c % 8 > 0 THEN least(c % 8, 6) END::INT AS level,
  k IN (0, 1, 2, 3, 7) AS "like" FROM o
"""


def page_tables(spark, sf_dir):
    """Lines inside tables of their page, the tables that count, and one as text."""
    lines = _lines(spark, sf_dir)
    tables = lines.filter("line < 3").select("doc", "page", F.col("line").alias("pos"), F.col("x0"), (F.col("y0") - 10).alias("y0"), (F.col("x0") + 80).alias("x1"), (F.col("y0") + 40).alias("y1"))
    rows = F.array(F.array(F.lit("a|b"), F.col("text")), F.array(F.lit(" x  y ")), F.array(F.lit("1"), F.lit("2")))
    met = P.covering(lines, tables)
    return met.select("doc", "page", "line", "table_pos", P.table_markdown(rows).alias("markdown"), G.may_hold_table(F.col("page") % 6000, F.col("line"), F.col("table_pos")).alias("ruled"), G.is_table(rows, F.col("line") * 20, F.lit(100)).alias("table"))


TABLES = f"""
WITH {LINES}, x AS (SELECT * FROM l), t AS (SELECT doc, page, line AS pos, x0, y0 - 10 AS y0, x0 + 80 AS x1, y0 + 40 AS y1 FROM x WHERE line < 3),
h AS (SELECT x.doc, x.page, x.line, min(pos) AS table_pos FROM x JOIN t ON t.doc = x.doc AND t.page = x.page AND (x.x0 + x.x1) / 2 BETWEEN t.x0 AND t.x1 AND (x.y0 + x.y1) / 2 BETWEEN t.y0 AND t.y1 GROUP BY ALL)
SELECT doc, page, line, table_pos, '| a/b | ' || text || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| x y |  |' || chr(10) || '| 1 | 2 |' AS markdown, page % 6000 <= 5000 AND (line >= 3 OR table_pos >= 3) AS ruled, line * 20 < 80 AS "table"
FROM x LEFT JOIN h USING (doc, page, line)
"""


def book_headings(spark, sf_dir):
    """Headings and plain candidates among lines made of part names."""
    lines = table(spark, sf_dir, "part").select((F.col("p_partkey") % 30).alias("doc"), F.col("p_partkey").alias("line"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.expr("repeat('#', cast(p_size % 8 + 1 as int))"), F.lit(" "), "p_name")).when(F.col("p_partkey") % 4 == 1, F.upper("p_name")).when(F.col("p_partkey") % 4 == 2, F.concat(F.col("p_size"), F.lit(" "), "p_name")).otherwise(F.col("p_name")).alias("text"))
    return K.headings(lines).unionByName(K.plain_candidates(lines))


HEADINGS = """
WITH l AS (SELECT p_partkey % 30 AS doc, p_partkey AS line, p_name, p_size, p_partkey % 4 AS k FROM part)
SELECT doc, line, least(p_size % 8 + 1, 6)::INT AS level, trim(repeat('#', greatest(p_size % 8 - 5, 0)::INT) || ' ' || p_name) AS text FROM l WHERE k = 0
UNION ALL SELECT doc, line, 0, upper(p_name) FROM l WHERE k = 1 UNION ALL SELECT doc, line, 0, p_size || ' ' || p_name FROM l WHERE k = 2
"""


def contents_levels(spark, sf_dir):
    """Levels of contents entries that are believable, with the loose lines that they come from."""
    line = _line(spark, sf_dir)
    no = F.col("n") * 9 + F.col("k") % 12
    lines = line.select(F.col("o").alias("doc"), F.col("n").alias("pos"), F.concat(F.when(F.col("k") % 3 == 0, F.concat("n", F.lit(". "))).when(F.col("k") % 3 == 1, F.lit("")).otherwise(F.lit("Part ")), F.lit("title "), F.col("k"), F.lit(" .... "), no).alias("text"), F.lit(100).alias("pages"), (F.col("s") % 5 == 0).alias("bold"))
    entries = K.loose_entries(lines).join(lines.select("doc", "pos", "bold"), ["doc", "pos"])
    return K.levels(K.believable(entries)).select("doc", "pos", "title", "no", "level")


LEVELS = f"""
WITH {LINE}, e AS (SELECT o AS doc, n AS pos, k % 3 AS c, (CASE k % 3 WHEN 0 THEN n || '. ' WHEN 1 THEN '' ELSE 'Part ' END) || 'title ' || k AS title, (n * 9 + k % 12)::INT AS no, s % 5 = 0 AS bold FROM i),
f AS (SELECT doc, count(*) AS cnt, avg((no < prev)::INT) AS falls FROM (SELECT doc, no, lag(no) OVER (PARTITION BY doc ORDER BY pos) AS prev FROM e) GROUP BY doc HAVING count(*) >= 3 AND coalesce(avg((no < prev)::INT), 0) <= 0.3),
w AS (SELECT e.*, min(CASE WHEN c = 0 THEN pos END) OVER (PARTITION BY doc) AS a, max(CASE WHEN c = 0 THEN pos END) OVER (PARTITION BY doc) AS z, avg(bold::INT) OVER (PARTITION BY doc) AS b FROM e SEMI JOIN f USING (doc))
SELECT doc, pos, title, no, CASE WHEN c = 0 THEN 1 WHEN c = 2 THEN 0 WHEN a IS NULL OR pos < a OR pos > z OR (b < 0.5 AND bold) THEN 1 ELSE 2 END AS level FROM w
"""


def recurring_keys(spark, sf_dir):
    """Headings that recur at short and at long distances."""
    line = _line(spark, sf_dir).select((F.col("o") % 20).alias("doc"), (F.col("k") % 200).cast("string").alias("key"), (F.col("o") * 10 + F.col("n")).alias("line"))
    return P.recurring_headings(line.withColumn("offset", F.col("line") * 4).withColumn("text", F.concat(F.lit("Head "), "key")))


RECURRING = f"""
WITH {LINE}, h AS (SELECT o % 20 AS doc, (k % 200)::VARCHAR AS key, o * 10 + n AS line FROM i), g AS (SELECT *, 4 * (line - lag(line) OVER (PARTITION BY doc, key ORDER BY line)) AS gap FROM h),
m AS (SELECT doc, key, count(*) AS n, median(gap) AS median FROM g GROUP BY ALL HAVING count(*) >= 3)
SELECT doc, key, n, CASE WHEN median <= 5000 THEN 'running' ELSE 'template' END AS kind FROM m WHERE median <= 5000 OR median >= 8000
"""


def chapter_spans(spark, sf_dir):
    """Spans of units, whether they are plausible, and ordinals of their titles."""
    line = _line(spark, sf_dir).select(F.col("o").alias("doc"), (F.col("n") * 10 + F.col("k") % 8).alias("page"), F.lit(90).alias("pages"))
    spans = P.spans(line).groupBy("doc").agg(F.min("span").alias("least"), F.max("span").alias("most"))
    titles = F.array(F.concat(F.lit("Chapter "), F.col("doc") % 90), F.lit("IV. Of it"), F.lit("No number"))
    return spans.join(P.plausible(line), "doc").withColumn("ordinals", F.array_join(F.transform(P.ordinals(titles), lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ","))


SPANS = f"""
WITH {LINE}, b AS (SELECT o AS doc, n * 10 + k % 8 AS page FROM i), s AS (SELECT *, coalesce(lead(page) OVER (PARTITION BY doc ORDER BY page), 90) - page AS span FROM b)
SELECT doc, min(span) AS least, max(span) AS most, count(*) >= 2 AND min(page) <= 22.5 AS ok, CASE WHEN count(*) < 2 THEN 'fewer than 2 units' WHEN min(page) > 22.5 THEN 'misses the start' ELSE '' END AS note, (doc % 90) || ',4,-' AS ordinals FROM s GROUP BY doc
"""


def folio_offsets(spark, sf_dir):
    """Offset between pages and printed numbers, of any length, of books whose last lines carry them."""
    pages = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("doc"), F.floor(F.col("p_partkey") / 20).alias("page"), "p_name", (F.col("p_size") % 10).alias("odd"))
    number = F.when(F.col("odd") < F.col("doc") / 2, F.col("page") - 3).otherwise(F.col("page") + 5)
    lines = pages.select("doc", "page", F.posexplode(F.array("p_name", F.lit("a line of text"), F.lit("another line"), number.cast("string"))).alias("line", "text"))
    return P.folio_offset(lines, digits=18)


FOLIOS = """
WITH p AS (SELECT p_partkey % 20 AS doc, p_partkey // 20 AS page, p_size % 10 < (p_partkey % 20) / 2 AS odd FROM part), v AS (SELECT doc, CASE WHEN odd THEN 3 ELSE -5 END AS "offset", page FROM p WHERE (CASE WHEN odd THEN page - 3 ELSE page + 5 END) >= 0),
c AS (SELECT doc, "offset", count(*) AS n, min(page) AS first FROM v GROUP BY ALL), b AS (SELECT *, sum(n) OVER (PARTITION BY doc) AS all_, row_number() OVER (PARTITION BY doc ORDER BY n DESC, first) AS r FROM c)
SELECT doc, "offset" FROM b WHERE r = 1 AND n >= 10 AND n / all_ >= 0.6
"""


def bound_repairs(spark, sf_dir):
    """Bounds after furniture and leading fragments are gone, with the characters of their units."""
    line = _line(spark, sf_dir)
    bounds = line.select(F.col("o").alias("doc"), F.col("n").alias("pos"), (F.col("n") * 10).alias("page"), (F.col("k") % 3 > 0).alias("matched"), F.lit(80).alias("pages"))
    pages = bounds.select("doc").distinct().select("doc", F.explode(F.sequence(F.lit(0), F.lit(79))).alias("page")).withColumn("chars", F.pmod(F.col("doc") + F.col("page"), F.lit(300)))
    furniture = bounds.filter("doc % 4 = 0 and pos = 2").select("doc", F.explode(F.sequence("page", F.col("page") + 6)).alias("page"))
    kept = K.without_leading(K.without_furniture(bounds, furniture), pages)
    return K.unit_chars(K.unit_pages(kept), pages).select("doc", "pos", "page", "stop", F.col("chars").cast("long").alias("chars"))


REPAIRS = f"""
WITH {LINE}, b AS (SELECT o AS doc, n AS pos, n * 10 AS page, k % 3 > 0 AS matched FROM i), u AS (SELECT *, coalesce(lead(page) OVER (PARTITION BY doc ORDER BY page), 80) AS stop FROM b),
f AS (SELECT *, doc % 4 = 0 AND pos = 2 AND 7 / (stop - page) >= 0.5 AS gone FROM u), k AS (SELECT doc, pos, page, matched FROM f QUALIFY NOT gone OR count(*) FILTER (NOT gone) OVER (PARTITION BY doc) < 2),
s AS (SELECT *, coalesce(lead(page) OVER (PARTITION BY doc ORDER BY page), 80) AS stop FROM k),
c AS (SELECT s.doc, pos, s.page, matched, stop, list_sum(list_transform(range(s.page, stop), lambda p: (s.doc + p) % 300))::BIGINT AS chars FROM s),
l AS (SELECT *, min((NOT matched AND chars < 1500)::INT) OVER (PARTITION BY doc ORDER BY page) AS lead_, row_number() OVER (PARTITION BY doc ORDER BY page) AS r, count(*) OVER (PARTITION BY doc) AS n FROM c),
m AS (SELECT doc, pos, page FROM l WHERE lead_ = 0 OR r > n - 2), v AS (SELECT *, coalesce(lead(page) OVER (PARTITION BY doc ORDER BY page), 80) AS stop FROM m)
SELECT doc, pos, page, stop, list_sum(list_transform(range(page, stop), lambda p: (doc + p) % 300))::BIGINT AS chars FROM v
"""


def joined_paragraphs(spark, sf_dir):
    """Lines joined with and without a vocabulary, paragraphs that go on, and rendered elements."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").withColumn("w", F.split("p_name", " "))
    first, second = F.get("w", F.lit(0)), F.coalesce(F.get("w", F.lit(1)), F.lit("x"))
    broken = F.concat(F.lit("a "), first, F.lit("-"))
    goes = F.array(F.concat(first, F.when(k % 2 == 0, F.lit(".")).otherwise(F.lit(" and"))), F.concat(second, F.lit(" on.")))
    rendered = P.render(part.select(k.alias("doc"), F.posexplode(F.array(F.struct(F.lit("heading").alias("kind"), F.lit(2).alias("level"), first.alias("text")), F.struct(F.lit("bullet").alias("kind"), F.lit(0).alias("level"), second.alias("text")), F.struct(F.lit("para").alias("kind"), F.lit(0).alias("level"), F.col("p_name").alias("text")))).alias("pos", "e")).select("doc", "pos", "e.kind", "e.level", "e.text")).withColumnRenamed("text", "rendered")
    made = part.select(k.alias("doc"), folds.concat_lines(broken, second).alias("joined"), folds.concat_lines(broken, second, F.array(F.concat(first, F.lit("-"), second))).alias("kept"), folds.continues(F.get(goes, F.lit(0)), F.get(goes, F.lit(1))).alias("on"), F.size(folds.merge_continuations(goes)).alias("paragraphs"), F.size(P.chapters_by_marker(F.concat(first, F.lit("\n<!-- chapter -->\n"), second, F.lit("\n <!-- Chapter --> \n")))).alias("chapters"))
    return made.join(rendered, "doc")


JOINED = """
WITH w AS (SELECT p_partkey AS doc, p_name, string_split(p_name, ' ')[1] AS a, coalesce(string_split(p_name, ' ')[2], 'x') AS b FROM part)
SELECT doc, 'a ' || a || b AS joined, 'a ' || a || '-' || b AS kept, doc % 2 > 0 AS "on", CASE WHEN doc % 2 > 0 THEN 1 ELSE 2 END::INT AS paragraphs, 2 AS chapters, '## ' || a || chr(10) || chr(10) || '- ' || b || chr(10) || chr(10) || p_name || chr(10) AS rendered FROM w
"""


def renumbered_files(spark, sf_dir):
    """Names of the chapters that stay."""
    files = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 7).cast("string").alias("stem"), F.col("doc_id").alias("idx"), F.coalesce("text", F.lit("")).alias("text"))
    graded = P.grade(P.file_features(files))
    return P.renumbered(graded).groupBy("stem").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("verdict").startswith("reject")).alias("rejected"))


RENUMBERED = """
WITH f AS (SELECT (doc_id // 7)::VARCHAR AS stem, doc_id AS idx, coalesce(text, '') AS text, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS t,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '' AND NOT starts_with(x, '#')) AS body FROM documents),
x AS (SELECT stem, idx, length(t) AS chars, (CASE WHEN t = '' OR starts_with(ltrim(text), '#') THEN 0 ELSE 1 END)::INT AS paras,
  CASE WHEN len(body) > 0 THEN len(list_filter(body, lambda b: regexp_matches(b, '^\\s*#*\\s*\\(?\\d{1,3}[.)]\\s+\\S') OR regexp_matches(b, '(?i)\\(\\s*(?:19|20)\\d{2}[a-z]?\\s*\\)|,\\s*(?:19|20)\\d{2}\\b|\\bpp?\\.\\s*\\d|\\bvol\\.\\s*\\d'))) / len(body) ELSE 0 END AS ref FROM f),
y AS (SELECT *, chars / greatest(sum(chars) OVER b, 1) AS share, coalesce(median(CASE WHEN chars >= 1200 THEN chars END) OVER b, max(chars) OVER b) AS typical FROM x WINDOW b AS (PARTITION BY stem))
SELECT stem, count(*) AS files, 0::BIGINT AS rejected FROM y WHERE NOT (chars < 250 OR (ref >= 0.55 AND share < 0.25) OR (chars < greatest(1200, 0.15 * typical) AND paras < 3)) GROUP BY stem
"""

def line_kinds(spark, sf_dir):
    """HEAD, LIST, PARA or CONT of every line by its geometry."""
    return G.labels(_blocks(spark, sf_dir)).select("doc", "page", "line", "label")


KINDS = f"""
WITH {LINES}, z AS (SELECT doc, size, sum(length(text)) AS n, min((page, line)) AS first FROM l GROUP BY ALL), y AS (SELECT doc, size AS body FROM z QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, first) = 1),
g AS (SELECT b.*, size > body + 0.5 AS head, min(x0) OVER w AS lft, max(x1) OVER w AS rgt, greatest(max(x1) OVER w - min(x0) OVER w, 1) AS width, median(y1 - y0) OVER w AS lh,
  starts_with(text, '• ') OR (starts_with(text, '2. ') AND count(*) FILTER (starts_with(text, '2. ')) OVER w >= 2) AS item FROM b JOIN y USING (doc) WINDOW w AS (PARTITION BY doc, page, block)),
v AS (SELECT *, lag(line) OVER w IS NULL OR lag(head) OVER w AS fresh, y0 - lag(y1) OVER w AS gap, lag(x1) OVER w AS ended FROM g WINDOW w AS (PARTITION BY doc, page, block ORDER BY line))
SELECT doc, page, line, CASE WHEN head THEN 'HEAD' WHEN item THEN 'LIST' WHEN fresh OR gap > 0.6 * lh OR x0 > lft + 0.4 * lh OR (ended < rgt - 0.2 * width AND x0 <= lft + 0.05 * width AND gap >= -0.3 * lh) THEN 'PARA' ELSE 'CONT' END AS label FROM v
"""


def page_elements(spark, sf_dir):
    """Headings, paragraphs, items and tables of pages in reading order, by kind; joining lines has no short SQL."""
    return G.elements(_blocks(spark, sf_dir)).groupBy("doc", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def title_matches(spark, sf_dir):
    """Contents titles found among headings of their book, with the offset and the bounds that follow; fuzzy ratios have no SQL."""
    part = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 25).alias("doc"), (F.col("p_partkey") % 25).cast("long").alias("pos"), F.concat(F.lit("Of "), "p_name", F.lit(" "), "p_type").alias("title"))
    headings = part.select("doc", (F.col("pos") * 4 + 3).alias("page"), "pos", F.when(F.col("pos") % 5 > 0, F.col("title")).otherwise(F.concat("title", F.lit("s"))).alias("text"))
    wanted = part.select("doc", "pos", "title", (F.col("pos") * 4 + 2).alias("page"))
    return K.verified(wanted, headings).select("doc", "pos", "page", "matched", F.round("fraction", 6).alias("fraction"))


def contents_found(spark, sf_dir):
    """Printed contents of made-up books: their pages, rows and entries."""
    from ..operators import contents as T

    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("doc"), "n_nationkey", "n_name")
    row = nation.select("doc", F.lit(2).alias("page"), F.concat("n_name", F.lit(" of the river")).alias("a"), (F.col("n_nationkey") * 5 + 7).cast("string").alias("b"), (F.col("n_nationkey") * 14.0).alias("y0"))
    left = row.select("doc", "page", F.col("a").alias("text"), F.lit(40.0).alias("x0"), "y0", F.lit(200.0).alias("x1"), (F.col("y0") + 10).alias("y1"), F.lit(False).alias("bold"))
    right = row.select("doc", "page", F.col("b").alias("text"), F.lit(480.0).alias("x0"), "y0", F.lit(500.0).alias("x1"), (F.col("y0") + 10).alias("y1"), F.lit(False).alias("bold"))
    title = row.select("doc", "page").distinct().select("doc", "page", F.lit("Contents").alias("text"), F.lit(40.0).alias("x0"), F.lit(-30.0).alias("y0"), F.lit(100.0).alias("x1"), F.lit(-20.0).alias("y1"), F.lit(True).alias("bold"))
    pages = row.select("doc", "page").distinct().select("doc", "page", F.lit(540.0).alias("width"), F.lit(200).alias("pages"))
    found = T.entries(T.rows(left.unionByName(right).unionByName(title)), pages)
    return T.carried(found, T.contents_pages(T.page_kinds(found))).select("doc", "pos", "title", "no", "roman")


FOUND = """
SELECT n_regionkey::VARCHAR AS doc, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS pos, n_name || ' of the river' AS title, (n_nationkey * 5 + 7)::INT AS no, false AS roman FROM nation
"""

QUERIES = {
    "line_kinds": (line_kinds, KINDS),
    "page_elements": (page_elements, None),
    "title_matches": (title_matches, None),
    "contents_found": (contents_found, FOUND),
    "glyph_lines": (glyph_lines, GLYPHS),
    "text_blocks": (text_blocks, BLOCKS),
    "page_statistics": (page_statistics, STATISTICS),
    "book_words": (book_words, BOOK_WORDS),
    "heading_tests": (heading_tests, HEADING_TESTS),
    "page_tables": (page_tables, TABLES),
    "book_headings": (book_headings, HEADINGS),
    "contents_levels": (contents_levels, LEVELS),
    "recurring_keys": (recurring_keys, RECURRING),
    "chapter_spans": (chapter_spans, SPANS),
    "folio_offsets": (folio_offsets, FOLIOS),
    "bound_repairs": (bound_repairs, REPAIRS),
    "joined_paragraphs": (joined_paragraphs, JOINED),
    "renumbered_files": (renumbered_files, RENUMBERED),
}
