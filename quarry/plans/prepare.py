"""Registered queries of search tables, list pages, gold files, line streams and signals; documents and made-up files feed them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import prepare as P
from ..operators import summaries as S
from ..runtime import table
from .lexical import SEARCH, STOP, tokens

STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def index_rows(spark, sf_dir):
    """Rows of an index, and the bodies that it lacks."""
    docs = _documents(spark, sf_dir)
    summary = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("f\n## Summary of "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, F.lit(""))
    stem = F.concat(F.lit("Smith_"), F.col("doc_id"))
    found = docs.select(stem.alias("stem"), F.lit(None).cast("string").alias("chapter"), F.when(F.col("doc_id") % 4 > 0, F.col("text")).alias("text"), summary.alias("summary"))
    missing = P.bodies(docs.select(stem.alias("id"), F.when(F.col("doc_id") % 4 > 0, F.col("text")).alias("text")), docs.filter("doc_id % 5 = 0").select(stem.alias("id")))
    return P.index_rows(found).join(missing.select(F.col("id").alias("stem"), F.length("body").alias("body")), "stem", "left").select("stem", "title", "authors_raw", "body")


INDEX = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 4 > 0 AS there FROM documents),
l AS (SELECT *, {STRIP.format("ltrim(list_filter(list_transform(string_split(text, chr(10)), lambda l: " + STRIP.format("l") + "), lambda l: l <> '')[1], '#')")} AS first FROM d)
SELECT 'Smith_' || doc_id AS stem, CASE WHEN doc_id % 3 = 0 THEN 'Summary of ' || doc_id WHEN there AND first <> '' THEN first ELSE 'Smith_' || doc_id END AS title, 'Smith' AS authors_raw, CASE WHEN there AND doc_id % 5 > 0 THEN length(text) END::INT AS body FROM l
"""


def search_entry(spark, sf_dir):
    """A page of each kind of search: words, words of an author, an author alone, nothing."""
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.coalesce(F.get(F.split("text", "\n"), F.lit(0)), F.lit("")).alias("title"), F.concat(F.lit("Al "), "source").alias("authors_raw"), F.lit("").alias("summary"), F.col("text").alias("body"))
    page = lambda kind, *a, **k: P.search(docs, *a, **k).select(F.lit(kind).alias("kind"), "id", "tier", F.round("score", 6).alias("score"))
    return page("words", SEARCH, limit=15, offset=5).unionByName(page("author", [], "src3", limit=10)).unionByName(page("both", SEARCH, "src3", limit=10)).unionByName(page("browse", [], limit=10, offset=10))


def _entry_sql() -> str:
    """The same pages in SQL, from the weighted scores of other search queries."""
    from .lexical import weighted_sql

    fields = {"title": tokens("coalesce(string_split(text, chr(10))[1], '')"), "authors_raw": tokens("'Al ' || source"), "summary": tokens("''")}
    weights = {"title": 5.0, "authors_raw": 2.0}
    own = weighted_sql("a", fields, SEARCH, weights).replace("FROM documents", "FROM (SELECT * FROM documents WHERE source = 'src3')")
    every = weighted_sql("s", fields, SEARCH, weights)
    body = weighted_sql("b", {"body": tokens()}, SEARCH, {})
    return f"""
WITH {every}, {body}, {own},
f AS (SELECT doc_id, 0 AS tier, score FROM s UNION ALL SELECT doc_id, 1, score FROM b WHERE doc_id NOT IN (SELECT doc_id FROM s)),
t AS (SELECT doc_id, coalesce(string_split(text, chr(10))[1], '') AS title, source FROM documents)
(SELECT 'words' AS kind, doc_id AS id, tier, round(score, 6) AS score FROM f ORDER BY tier, round(score, 9), doc_id LIMIT 15 OFFSET 5) UNION ALL
(SELECT 'author', doc_id, 0, NULL::DOUBLE FROM t WHERE source = 'src3' ORDER BY title, doc_id LIMIT 10) UNION ALL
(SELECT 'both', doc_id, 0, round(score, 6) FROM a ORDER BY round(score, 9), doc_id LIMIT 10) UNION ALL
(SELECT 'browse', doc_id, 0, NULL::DOUBLE FROM t ORDER BY title, doc_id LIMIT 10 OFFSET 10)
"""


def page_rules(spark, sf_dir):
    """Strokes on pages; order lines stand for what is drawn."""
    q = F.col("l_quantity")
    drawings = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") % 7).alias("page"), F.lit(0).alias("left"), F.lit(0).alias("bottom"), (q * 2).alias("right"), (F.col("l_linenumber") * 2).alias("top"), F.lit(600).alias("width"), F.lit(300).alias("height"))
    return P.rule_counts(drawings)


RULES = "SELECT l_suppkey AS doc, l_orderkey % 7 AS page, count(*) AS drawn, count(*) FILTER (l_linenumber * 2 < 3 AND l_quantity * 2 > 60) AS across, count(*) FILTER (l_quantity * 2 < 3 AND l_linenumber * 2 > 6) AS down FROM lineitem GROUP BY ALL"


def figure_lists(spark, sf_dir):
    """Pages of lists in the front; order lines stand for pages."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") - 1).alias("page")).agg(F.max("l_partkey").alias("k"))
    kinds = line.select("doc", "page", F.lit(60).alias("pages"), (F.col("k") % 3 == 0).alias("veto"), (F.col("k") % 5 + 1).alias("entries"), (F.col("k") % 2 == 0).alias("extends"), F.lit(False).alias("opens"))
    return P.list_pages(kinds)


LISTS = """
WITH RECURSIVE l AS (SELECT l_orderkey AS doc, l_linenumber - 1 AS page, max(l_partkey) AS k FROM lineitem GROUP BY ALL),
p AS (SELECT doc, page, k % 3 = 0 AND k % 5 + 1 >= 3 AS opens, k % 2 = 0 AS extends FROM l WHERE page < 6),
r AS (SELECT doc, page FROM p WHERE opens UNION SELECT p.doc, p.page FROM r JOIN p ON p.doc = r.doc AND p.page = r.page + 1 AND p.extends)
SELECT doc, page FROM r
"""


def grouped_files(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("text_b"), "l_orderkey", F.lit("_0"), "l_linenumber", F.lit(".md")).alias("file")).distinct()
    return P.grouped(names).select("stem", F.array_join("files", " ").alias("files"))


GROUPED = "SELECT 'b' || l_orderkey AS stem, string_agg(DISTINCT 'text_b' || l_orderkey || '_0' || l_linenumber || '.md', ' ' ORDER BY 'text_b' || l_orderkey || '_0' || l_linenumber || '.md') AS files FROM lineitem GROUP BY l_orderkey"


def repeated_phrases(spark, sf_dir):
    return P.phrases(_documents(spark, sf_dir), "doc_id", F.col("text"), STOP).select(F.col("doc").alias("doc_id"), "phrase", "n", "rank")


_STOPPED = ", ".join(f"'{w}'" for w in STOP)
PHRASES = f"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '\\p{{L}}+'), lambda x: lower(x)) AS w FROM documents), s AS (SELECT doc_id, w, unnest([1, 2, 3]) AS n FROM d),
r AS (SELECT doc_id, w[i : i + n - 1] AS r FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM s WHERE len(w) >= n)),
p AS (SELECT doc_id, array_to_string(r, ' ') AS phrase FROM r WHERE NOT list_has_any(r, [{_STOPPED}])),
c AS (SELECT doc_id, phrase, count(*) AS n FROM p WHERE length(phrase) >= 4 GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, phrase, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, phrase)::INT AS rank FROM c QUALIFY rank <= 25
"""


def named_entities(spark, sf_dir):
    return P.entities(_documents(spark, sf_dir), "doc_id", F.col("text")).select(F.col("doc").alias("doc_id"), "entity", "n", "rank")


ENTITIES = """
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\\p{Ll},;] (\\p{Lu}[\\p{L}''-]+(?: \\p{Lu}[\\p{L}''-]+)*)', 1)) AS entity FROM documents), c AS (SELECT doc_id, entity, count(*) AS n FROM e GROUP BY ALL)
SELECT doc_id, entity, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, entity)::INT AS rank FROM c QUALIFY rank <= 25
"""


def gold_files(spark, sf_dir):
    """Made-up gold files of three kinds."""
    k = F.col("p_partkey")
    bounds = P.gold_bounds(F.concat(F.lit("# comment\n"), k, F.lit("\t "), "p_name", F.lit("\nno page\n7\tLast\n")))
    units = P.gold_units(F.concat(F.lit("2\t"), "p_name", F.lit("\nx\tno\n\n1\t "), k))
    tags = P.tagged_lines(F.concat(F.lit("[HEAD] "), "p_name", F.lit("\n[OTHER] x\n[PARA]"), k))
    text = lambda c, *f: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in f])), "|")
    return table(spark, sf_dir, "part").select("p_partkey", text(bounds, "page", "title").alias("bounds"), text(units, "occurrence", "key").alias("units"), text(tags, "tag", "text").alias("tags"))


GOLD = "SELECT p_partkey, (p_partkey - 1) || ':' || p_name || '|6:Last' AS bounds, '2:' || p_name || '|1:' || p_partkey AS units, 'HEAD:' || p_name || '|PARA:' || p_partkey AS tags FROM part"


def graded_repairs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    of = lambda c: orders.select(F.col("o_orderkey").alias("doc"), c.alias("f1"))
    return P.graded(of(F.col("o_totalprice")), of(F.col("o_custkey") * 100.0)).groupBy("worse").agg(F.count(F.lit(1)).alias("n"))


def line_labels(spark, sf_dir):
    """Lines of a stream with labels, blank lines between some."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line")).agg(F.max("l_partkey").alias("k"), F.max("l_suppkey").alias("s"))
    k = F.col("k")
    text = F.when(k % 7 == 0, "  ").when(k % 7 == 1, "12").when(k % 7 == 2, "Running Head 4").when(k % 7 == 3, "- item").otherwise(F.concat(F.lit("line "), k))
    lines = line.select((F.col("page") % 15).alias("doc"), "page", "line", text.alias("text"), (F.col("s") % 3).alias("bid"))
    running = lines.select("doc").distinct().withColumn("key", F.lit("runninghead"))
    return P.ocr_labels(P.line_stream(lines, running), F.col("text").endswith("5")).select("doc", "page", "line", "bid", "blank_before", "label")


LABELS = """
WITH l AS (SELECT l_orderkey AS page, l_linenumber AS line, max(l_partkey) AS k, max(l_suppkey) AS s FROM lineitem GROUP BY ALL),
m AS (SELECT page % 15 AS doc, page, line, k, s % 3 AS b, coalesce(lag(k % 7 = 0) OVER (PARTITION BY page % 15 ORDER BY page, line), false) AS blank_before FROM l),
t AS (SELECT *, k % 7 > 3 AND k % 10 = 5 AS head, k % 7 = 3 AS item FROM m WHERE k % 7 > 2),
o AS (SELECT *, lag(b) OVER w AS pb, lag(page) OVER w AS pp, coalesce(lag(head) OVER w, true) AS ph FROM t WINDOW w AS (PARTITION BY doc ORDER BY page, line))
SELECT doc, page, line, (sum((pb IS NULL OR pb <> b OR pp <> page)::INT) OVER (PARTITION BY doc ORDER BY page, line) - 1)::BIGINT AS bid, blank_before,
  CASE WHEN head THEN 'HEAD' WHEN item THEN 'LIST' WHEN ph OR blank_before THEN 'PARA' ELSE 'CONT' END AS label FROM o
"""


def cleaned_pages(spark, sf_dir):
    """Pages of a source as one text."""
    docs = _documents(spark, sf_dir).groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit(" \r\n")).alias("t")))), lambda x: x["t"]).alias("pages"))
    return docs.select("source", F.md5(P.clean_pages(F.concat("pages", F.array(F.lit("# References\r\nx"))))).alias("text"))


CLEANED = f"""
WITH t AS (SELECT source, string_agg({STRIP.format("text")}, chr(10) || chr(10) ORDER BY doc_id) FILTER ({STRIP.format("text")} <> '') AS t FROM (SELECT source, doc_id, coalesce(text, '') AS text FROM documents) GROUP BY source)
SELECT source, md5({STRIP.format("t")}) AS text FROM t
"""


def source_changes(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    sources = orders.select(k.alias("stem"), F.concat(k, F.when(k % 3 == 0, F.lit(".PDF")).otherwise(F.lit(".md"))).alias("name"), F.col("o_orderdate").alias("modified"))
    return P.changed_texts(sources, orders.filter(k % 2 == 0).select((k + 1 - k % 4).alias("stem"), F.col("o_orderdate").alias("modified")).groupBy("stem").agg(F.max("modified").alias("modified")))


CHANGED = """
WITH m AS (SELECT o_orderkey + 1 - o_orderkey % 4 AS stem, max(o_orderdate) AS made FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT o_orderkey AS stem, coalesce(o_orderkey % 3 > 0 AND o_orderdate > made, false) AS changed FROM orders LEFT JOIN m ON m.stem = o_orderkey
"""


def collected_tickets(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("ticket"), F.col("l_orderkey").alias("batch")).agg(F.max("l_partkey").alias("k"))
    results = line.select("ticket", "batch", (F.col("k") % 90).cast("string").alias("custom_id"), F.col("k").cast("string").alias("text"))
    return P.collected(results, line.filter("k % 9 = 0").select((F.col("k") % 90).cast("string").alias("custom_id")))


COLLECTED = """
WITH l AS (SELECT l_suppkey % 50 AS ticket, l_orderkey AS batch, max(l_partkey) AS k FROM lineitem GROUP BY ALL)
SELECT ticket, (k % 90)::VARCHAR AS custom_id, arg_max(k::VARCHAR, batch) AS text, (k % 90) IN (SELECT k % 90 FROM l WHERE k % 9 = 0) AS truncated FROM l GROUP BY ticket, k % 90
"""


def reply_parts(spark, sf_dir):
    """A thread's reply, suggestions of a gap check, chapters that an editor marked."""
    n = F.col("p_name")
    reply = F.concat(F.lit("**Thread name:** "), n, F.lit("\n**Discussion:** about "), n, F.lit(" **\n**Key arguments:**\n- a\n- "), n, F.lit("\n**Key concepts:**\n• c\n**Methods:** m\n**Empirical contexts:** "), F.col("p_size"))
    found = S.map_reply(reply, F.lit("Theme"))
    told = P.suggestions(F.concat(F.lit("**Missing works:**\n- "), n, F.lit("\n- None\n**Terms:** t1\n- t2")), ["Missing works", "Terms"])
    marked = P.marked_chapters(n, F.when(F.col("p_partkey") % 2 == 0, F.concat(n, F.lit("\n<!-- chapter -->\nrest"))).otherwise(n))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws("|", found["name"], found["discussion"], F.array_join(found["arguments"], ","), F.array_join(found["concepts"], ","), found["methods"], found["empirical"]).alias("thread"),
        F.concat_ws("|", F.array_join(told["missing_works"], ","), F.array_join(told["terms"], ",")).alias("suggested"), F.array_join(marked, "|").alias("chapters"), P.gap_briefs(F.repeat(n, 50), n).alias("brief"),
        X.try_double(F.when(F.col("p_partkey") % 3 == 0, F.lit("x")).otherwise(F.lit(" 1.5")), 0.0).alias("number"))


REPLY = """
SELECT p_partkey, p_name || '|about ' || p_name || '|a,' || p_name || '|c|m|' || p_size AS thread, p_name || '|t1,t2' AS suggested, CASE WHEN p_partkey % 2 = 0 THEN p_name || '|rest' ELSE p_name END AS chapters,
  p_name || ': ' || substr(repeat(p_name, 50), 1, 300) AS brief, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1.5 END::DOUBLE AS number FROM part
"""


def rundown(spark, sf_dir):
    """The most central sentence of each line, which stands for a paragraph."""
    docs = _documents(spark, sf_dir)
    return P.extractive_rundown(docs, "doc_id", F.filter(F.split("text", "\n"), lambda x: X.strip(x) != ""), STOP).select(F.col("doc").alias("doc_id"), "pos", "sentence")


_SPLIT = "list_filter(list_transform(string_split(regexp_replace(p, '([.!?])[\\s\\x0B]+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: " + STRIP.format("s") + "), lambda s: s <> '')"
RUNDOWN = f"""
WITH d AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {STRIP.format("x")} <> '') AS l FROM documents),
g AS (SELECT doc_id, unnest(range(len(l)))::INT AS par, unnest(l) AS p FROM d), s AS (SELECT doc_id, par, unnest(range(len(s)))::INT AS pos, unnest(s) AS sentence FROM (SELECT doc_id, par, {_SPLIT} AS s FROM g)),
t AS (SELECT doc_id, par, pos, unnest(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM s),
p AS (SELECT doc_id, par, pos, term, count(*) AS tf FROM t WHERE length(term) > 1 AND term NOT IN ({_STOPPED}) GROUP BY ALL), n AS (SELECT doc_id, par, count(*) AS n FROM s GROUP BY ALL),
f AS (SELECT doc_id, par, term, count(*) AS df FROM p GROUP BY ALL), w AS (SELECT doc_id, par, pos, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM p JOIN f USING (doc_id, par, term) JOIN n USING (doc_id, par)),
u AS (SELECT doc_id, par, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, par, pos)) AS u FROM w),
c AS (SELECT doc_id, par, pos, sum(u * everything) AS c FROM (SELECT *, sum(u) OVER (PARTITION BY doc_id, par, term) AS everything FROM u) GROUP BY ALL)
SELECT doc_id, par AS pos, trim(regexp_replace(sentence, '[\\s\\x0B]+', ' ', 'g')) AS sentence FROM s LEFT JOIN c USING (doc_id, par, pos) QUALIFY row_number() OVER (PARTITION BY doc_id, par ORDER BY round(coalesce(c, 0), 9) DESC, pos) = 1
"""

QUERIES = {
    "index_rows": (index_rows, INDEX),
    "search_entry": (search_entry, _entry_sql()),
    "page_rules": (page_rules, RULES),
    "figure_lists": (figure_lists, LISTS),
    "grouped_files": (grouped_files, GROUPED),
    "repeated_phrases": (repeated_phrases, PHRASES),
    "named_entities": (named_entities, ENTITIES),
    "gold_files": (gold_files, GOLD),
    "graded_repairs": (graded_repairs, "SELECT o_custkey * 100 < o_totalprice AS worse, count(*) AS n FROM orders GROUP BY 1"),
    "line_labels": (line_labels, LABELS),
    "cleaned_pages": (cleaned_pages, CLEANED),
    "source_changes": (source_changes, CHANGED),
    "collected_tickets": (collected_tickets, COLLECTED),
    "reply_parts": (reply_parts, REPLY),
    "rundown": (rundown, RUNDOWN),
}
