"""Registered queries of maps, reviews and drafts; parts stand for works, suppliers for threads, orders for hits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import maps as M
from ..runtime import table


def _works(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("base"), F.col("p_brand").alias("authors"), F.col("p_name").alias("title"))


def work_list(spark, sf_dir):
    briefs = table(spark, sf_dir, "part").select(F.concat_ws("_", "p_brand", F.translate("p_name", " ", "_"), "p_partkey").alias("base"))
    return M.work_list(briefs)


WORKS = "SELECT p_brand || '_' || replace(p_name, ' ', '_') || '_' || p_partkey AS base, p_brand AS authors, p_name || ' ' || p_partkey AS title FROM part"


def _threads(spark, sf_dir):
    """Threads with the works that lines name, and shared ones."""
    line = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select((F.col("l_suppkey") % 40).alias("thread"), (F.col("l_partkey") % 500).alias("base"), (F.col("l_linenumber") == 1).alias("also")).distinct()
    listed = lambda own: F.array_sort(F.collect_list(F.when(own, F.col("base"))))
    return line.groupBy("thread").agg(listed(~F.col("also")).alias("bases"), listed(F.col("also")).alias("also_bases"))


THREADS = "t AS (SELECT DISTINCT l_suppkey % 40 AS thread, l_partkey % 500 AS base, l_linenumber = 1 AS also FROM lineitem WHERE l_quantity > 40)"


def thread_works(spark, sf_dir):
    """Works of the chosen threads of a map."""
    threads = _threads(spark, sf_dir).withColumn("pos", F.col("thread") + 1).withColumn("name", F.concat(F.lit("Theme "), "thread"))
    chosen = M.choose_threads(threads, "theme 1").unionByName(M.choose_threads(threads, "4"))
    return M.thread_works(chosen).select("thread", F.col("pos").cast("long").alias("pos"), "base")


THREAD_WORKS = f"""
WITH {THREADS}, d AS (SELECT thread, base, min(also) AS also FROM t WHERE thread IN (1, 3) OR thread BETWEEN 10 AND 19 GROUP BY ALL)
SELECT thread, row_number() OVER (PARTITION BY thread ORDER BY also, base) - 1 AS pos, base FROM d QUALIFY count(*) OVER (PARTITION BY thread) >= 6
"""


def _members(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("base"), F.when(k % 7 > 0, k % 9).alias("main"), F.when((k % 7 > 0) & (k % 5 == 0), (k + 1) % 9).alias("second"))


def _terms(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 8).cast("long").alias("class"), F.lower("n_name").alias("term"))
    rank = F.row_number().over(Window.partitionBy("class").orderBy("term"))
    return rows.withColumn("rank", rank)


TERMS = "n AS (SELECT n_nationkey % 8 AS class, lower(n_name) AS term, row_number() OVER (PARTITION BY n_nationkey % 8 ORDER BY lower(n_name)) AS rank FROM nation), names AS (SELECT class, string_agg(term, ', ' ORDER BY rank) AS name FROM n WHERE rank <= 3 GROUP BY class)"


def map_sections(spark, sf_dir):
    made = M.sections(_members(spark, sf_dir), _terms(spark, sf_dir), _works(spark, sf_dir))
    return made.select("pos", "thread", "name", F.size("works").alias("works"), F.size("also").alias("also"), F.get("works", F.lit(0)).alias("first"))


MAP_SECTIONS = f"""
WITH m AS (SELECT p_partkey AS base, lower(p_brand) AS a, CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 9 END AS main, CASE WHEN p_partkey % 7 > 0 AND p_partkey % 5 = 0 THEN (p_partkey + 1) % 9 END AS second FROM part), {TERMS},
w AS (SELECT main AS thread, count(*)::INT AS works, arg_min(base, (a, base)) AS first FROM m WHERE main IS NOT NULL GROUP BY 1), s AS (SELECT second AS thread, count(*)::INT AS also FROM m WHERE second IS NOT NULL GROUP BY 1)
SELECT row_number() OVER (ORDER BY works DESC, thread)::INT AS pos, thread, coalesce(name, 'Theme') AS name, works, coalesce(also, 0) AS also, first FROM w LEFT JOIN s USING (thread) LEFT JOIN names ON class = thread
"""


def live_groups(spark, sf_dir):
    """Candidates in groups of their threads, for many and for few candidates."""
    members, terms, works = _members(spark, sf_dir), _terms(spark, sf_dir), _works(spark, sf_dir).select("base")
    many, few = M.targeted_groups(works.filter("base % 3 = 0"), members, terms), M.targeted_groups(works.filter("base <= 5"), members, terms)
    return many.unionByName(few.select((-F.col("base")).alias("base"), "group"))


GROUPS = f"""
WITH {TERMS}
SELECT p_partkey AS base, coalesce(name, 'Theme') AS "group" FROM part LEFT JOIN names ON class = p_partkey % 9 WHERE p_partkey % 3 = 0 AND p_partkey % 7 > 0
UNION ALL SELECT -p_partkey, 'Relevant works' FROM part WHERE p_partkey <= 5
"""


def listed_map(spark, sf_dir):
    """Works of a long list, and none of a short one."""
    works = _works(spark, sf_dir).select("base")
    long, short = works.filter("base % 10 = 0"), works.filter("base < 4")
    return M.restricted(works, long).unionByName(M.restricted(works, short))


def threads_of_text(spark, sf_dir):
    """Works found again in a rendered map."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("map"), F.concat(F.lit("- "), F.upper("p_brand"), F.lit(" —  "), "p_name", F.lit(" ")).alias("l"), "p_partkey")
    block = rows.groupBy("map").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "l"))), lambda x: x["l"])).alias("l"))
    maps = block.select("map", F.concat(F.lit("# Map\n## 1. Rivers\ntext\n"), "l", F.lit("\n- nobody - nothing\n## Cross-cutting works\n"), "l").alias("text"))
    records = _works(spark, sf_dir).filter("base < 300")
    titled = records.withColumn("title", F.regexp_replace("title", "^", " "))
    return M.threads_from_text(maps, titled.select("base", "authors", "title")).distinct()


TEXT_THREADS = """
WITH k AS (SELECT p_partkey, lower(p_brand) || ' - ' || trim(lower(p_name)) AS key FROM part)
SELECT DISTINCT a.p_partkey % 20 AS map, 'Rivers' AS thread, b.p_partkey AS base FROM k a JOIN k b ON a.key = b.key AND b.p_partkey < 300
"""


def review_outline(spark, sf_dir):
    """Parts of reviews and of outlines made of nations' names."""
    n = F.lower("n_name")
    review = F.concat(F.lit("# T\nintro\n## "), n, F.lit("\nown text\n### Sub\nmore "), n, F.lit("\n### Empty\n\n## Second\n\n## Works drawn on\n## Not read\nx"))
    outline = F.concat(F.lit("head **Section:** "), n, F.lit("\nCovers: a, b\nWorks: Smith; Jones\n**Section:**\n\n**Section:** **Bold**\nWorks: none"))
    parts = lambda c, x: F.array_join(F.transform(c, x), "|")
    return table(spark, sf_dir, "nation").select(
        "n_name", parts(M.review_parts(review), lambda p: F.concat_ws("/", p["section"], p["title"], p["text"])).alias("review"),
        parts(M.outline_parts(outline), lambda p: F.concat_ws("/", p["title"], p["covers"], p["works"])).alias("outline"))


REVIEW = """
SELECT n_name, lower(n_name) || '//own text|' || lower(n_name) || '/Sub/more ' || lower(n_name) AS review, lower(n_name) || '/a, b/Smith; Jones|Bold//none' AS outline FROM nation
"""


def review_footer(spark, sf_dir):
    works = _works(spark, sf_dir)
    signals = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") * 2).alias("base")).agg(F.max(F.year("l_shipdate")).alias("year"), F.max("l_linenumber").alias("cited_by_count"))
    selected = M.attach_briefs(works.filter("base % 3 = 0").withColumn("title", F.when(F.col("base") % 2 == 0, F.col("title"))), works.select("base", F.concat(F.lit("brief "), "title").alias("title")))
    return M.footer_rows(selected, signals)


FOOTER = """
WITH s AS (SELECT l_partkey * 2 AS base, max(year(l_shipdate)) AS year, max(l_linenumber) AS c FROM lineitem GROUP BY 1)
SELECT p_partkey AS base, p_brand AS authors, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'brief ' || p_name END AS title, year::INT AS year, coalesce(c, 0)::INT AS cited_by_count
FROM part LEFT JOIN s ON s.base = p_partkey WHERE p_partkey % 3 = 0
"""


def flat_groups(spark, sf_dir):
    """Works of groups in order, each once."""
    groups = _threads(spark, sf_dir).select(F.col("thread").alias("place"), "bases")
    return M.flattened(groups).select("base", F.col("pos.place").alias("place"))


FLAT = f"WITH {THREADS} SELECT base, min(thread) AS place FROM t WHERE NOT also GROUP BY base"


def debate_lines(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("anchor"), F.col("l_linenumber").alias("rank")).agg((F.max("l_partkey") % 500 + 1).alias("newer")).filter("rank <= 2")
    works = _works(spark, sf_dir)
    return M.debate_lines(line, works.select("base", "title"), works.filter("base % 4 = 0").select("base"))


DEBATES = """
WITH l AS (SELECT l_suppkey AS anchor, l_linenumber AS rank, max(l_partkey) % 500 + 1 AS newer FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL),
n AS (SELECT anchor, string_agg(p_name, '; ' ORDER BY rank) AS names FROM l JOIN part ON p_partkey = newer WHERE anchor % 4 = 0 GROUP BY anchor)
SELECT anchor, p_name || ' <-> ' || names AS line FROM n JOIN part ON p_partkey = anchor
"""


def style_samples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")).alias("text"))
    return M.style_paragraphs(docs, docs.filter("path % 6 = 0"))


STYLE = """
WITH l AS (SELECT doc_id AS path, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents WHERE doc_id % 6 > 0)
SELECT path, pos::INT AS pos, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM l WHERE len(list_filter(regexp_split_to_array(text, '[\\s\\x0B]+'), lambda w: w <> '')) >= 20
"""


def json_replies(spark, sf_dir):
    n = F.col("o_orderkey")
    body = F.when(n % 5 == 0, F.lit("not json")).otherwise(F.concat(F.lit('{"name": "'), "o_orderstatus", F.lit('", "share": '), (n % 4).cast("string"), F.lit(".5}")))
    reply = F.when(n % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    found = M.json_reply(reply, "name string, share double")
    return table(spark, sf_dir, "orders").select("o_orderkey", found["name"].alias("name"), found["share"].alias("share"))


JSON_REPLIES = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS name, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 4 + 0.5 END::DOUBLE AS share FROM orders"


def section_calls(spark, sf_dir):
    """Plan items of a section with the shape of its call."""
    plan = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 5).cast("string").alias("section"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 2000).alias("target"))
    items = M.section_items(plan, plan.select("pos", "section"), "3")
    return items.select("pos", "section", F.col("target").alias("asked")).join(M.prompt_shape(items.select("section", "target")).withColumnRenamed("target", "t").groupBy("section").agg(F.sum("paragraphs").alias("paragraphs"), F.sum("t").alias("target")), "section")


CALLS = """
WITH i AS (SELECT o_orderkey AS pos, (o_custkey % 5)::VARCHAR AS section, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 2000 END AS asked FROM orders WHERE o_custkey % 5 = 3)
SELECT section, pos, asked, sum(greatest(1, round_even(coalesce(asked, 600) / 200, 0)::INT)) OVER ()::BIGINT AS paragraphs, sum(coalesce(asked, 600)) OVER ()::BIGINT AS target FROM i
"""


def call_sizes(spark, sf_dir):
    """What drafts, gaps, maps, questions and labels cost, in characters and tokens."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    parts = M.draft_cost(docs.select(F.length("text").alias("chars"), (F.col("doc_id") % 900).alias("target"))).withColumnsRenamed({"chars": "draft_chars", "tokens_out": "draft_out", "calls": "draft_calls"})
    gap = M.gap_cost(docs).select(F.col("chars").alias("gap_chars"))
    ask = M.ask_cost(docs.select(F.length("text").alias("chars"))).select(F.col("chars").alias("ask_chars"))
    label = M.labelling_cost(docs.select((F.col("doc_id") % 30).alias("n")), True)
    joined = parts.join(gap, F.lit(True)).join(ask, F.lit(True)).join(label, F.lit(True))
    return joined.select("*", M.map_cost(F.col("draft_calls"), F.lit(7), F.lit(810)).alias("map_chars"), F.lit(M.review_calls("sections")).alias("review_calls"))


SIZES = """
SELECT sum(length(coalesce(text, '')))::BIGINT AS draft_chars, (2 * sum(doc_id % 900))::BIGINT AS draft_out, count(*) AS draft_calls, sum(least(length(coalesce(text, '')), 3000) + 3200)::BIGINT AS gap_chars,
  (40 * (sum(length(coalesce(text, ''))) // count(*)))::BIGINT AS ask_chars, sum(500 + 20 * (doc_id % 30))::BIGINT AS tokens_in, sum(16 * (doc_id % 30) + 64)::BIGINT AS tokens_out, 0.5::DOUBLE AS factor,
  floor(7 * 20 * 810 * 1.3)::BIGINT AS map_chars, 5 AS review_calls FROM documents
"""


def recovered_labels(spark, sf_dir):
    """Replies by their place in the sorted corpus, with the papers that hold sentences."""
    corpus = table(spark, sf_dir, "part").select(F.concat(F.lit("b"), "p_partkey").alias("base"), F.when(F.col("p_partkey") % 9 > 0, F.split("p_name", " ")).otherwise(F.array().cast("array<string>")).alias("sentences"))
    results = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey") * 3).alias("custom_id"), F.col("s_name").alias("reply"))
    return M.recovered_sequences(results, M.with_sentences(corpus))


RECOVERED = """
WITH c AS (SELECT 'b' || p_partkey AS base FROM part WHERE p_partkey % 9 > 0), n AS (SELECT base, row_number() OVER (ORDER BY base) - 1 AS p FROM c)
SELECT base, s_name AS reply FROM n JOIN supplier ON p = s_suppkey * 3
"""


def rundown_replies(spark, sf_dir):
    """A rundown's chunks as one list."""
    chunks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("chunk")).agg(F.max("l_partkey").alias("k"))
    reply = F.concat(F.lit("1. "), F.col("k"), F.lit("\n2) second of "), F.col("chunk"), F.lit("\nchatter"))
    return M.renumbered(chunks.select("doc", "chunk", reply.alias("reply")))


RUNDOWN = """
WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS chunk, max(l_partkey) AS k FROM lineitem GROUP BY ALL),
e AS (SELECT doc, chunk, 0 AS i, k::VARCHAR AS text FROM l UNION ALL SELECT doc, chunk, 1, 'second of ' || chunk FROM l)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY chunk, i)::INT AS pos, text FROM e
"""


def blueprint_moves(spark, sf_dir):
    return M.enough_sections(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 30).alias("skeleton"), (F.col("l_partkey") % 400).alias("move")))


MOVES = "SELECT l_suppkey % 30 AS skeleton, l_partkey % 400 AS move, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 4"


def section_budget(spark, sf_dir):
    """Sections that one call shows; a hashed order has no SQL."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("by"), F.col("doc_id").alias("key"), (F.col("n_chars") % 7).alias("n"), F.col("n_chars").alias("chars"))
    return M.budgeted_sections(rows.filter("chars is not null"))


QUERIES = {
    "work_list": (work_list, WORKS),
    "thread_works": (thread_works, THREAD_WORKS),
    "map_sections": (map_sections, MAP_SECTIONS),
    "live_groups": (live_groups, GROUPS),
    "listed_map": (listed_map, "SELECT p_partkey AS base FROM part WHERE p_partkey % 10 = 0"),
    "threads_of_text": (threads_of_text, TEXT_THREADS),
    "review_outline": (review_outline, REVIEW),
    "review_footer": (review_footer, FOOTER),
    "flat_groups": (flat_groups, FLAT),
    "debate_lines": (debate_lines, DEBATES),
    "style_samples": (style_samples, STYLE),
    "json_replies": (json_replies, JSON_REPLIES),
    "section_calls": (section_calls, CALLS),
    "call_sizes": (call_sizes, SIZES),
    "recovered_labels": (recovered_labels, RECOVERED),
    "rundown_replies": (rundown_replies, RUNDOWN),
    "blueprint_moves": (blueprint_moves, MOVES),
    "section_budget": (section_budget, None),
}
