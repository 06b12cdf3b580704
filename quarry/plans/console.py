"""Registered queries of console tables; parts stand for papers, orders for files and jobs, conversations for themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import console as B
from ..operators import summaries as S
from ..runtime import table


def _papers(spark, sf_dir):
    """name, pages, prepared of papers; names are authors and title."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat_ws("_", F.translate("p_name", " ", "-"), key.cast("string"), F.lit("t")).alias("name"), F.when(key % 6 > 0, F.col("p_size") * 7).alias("pages"), key.alias("k"))


PAPERS = "p AS (SELECT replace(p_name, ' ', '-') || '_' || p_partkey || '_t' AS name, CASE WHEN p_partkey % 6 > 0 THEN p_size * 7 END AS pages, p_partkey AS k FROM part)"


def paper_sorting(spark, sf_dir):
    """First pages of the papers by name and by length."""
    from ..operators.library import page_of

    papers = _papers(spark, sf_dir)
    by = lambda column, falling: page_of(papers, B.sort_papers(papers, column, falling), 1, 100).select(F.lit(column).alias("by"), "name", "pages")
    return by("name", False).unionByName(by("pages", True)).unionByName(by("k", True))


SORTING = f"""
WITH {PAPERS}
(SELECT 'name' AS by, name, pages FROM p ORDER BY lower(name), name LIMIT 100) UNION ALL
(SELECT 'pages', name, pages FROM p ORDER BY coalesce(pages, -1) DESC, name LIMIT 100) UNION ALL
(SELECT 'k', name, pages FROM p ORDER BY k DESC, name LIMIT 100)
"""


def _outputs(spark, sf_dir):
    papers = _papers(spark, sf_dir)
    chapter = F.when(F.col("k") % 4 == 0, F.concat("name", F.lit("_01"))).otherwise(F.col("name"))
    return papers.filter("k % 3 > 0").select(chapter.alias("stem")), papers.filter("k % 5 = 0").select(chapter.alias("stem"))


OUTPUTS = f"{PAPERS}, o AS (SELECT *, CASE WHEN k % 4 = 0 THEN name || '_01' ELSE name END AS stem FROM p)"


def stage_counts(spark, sf_dir):
    return B.stage_summary(_papers(spark, sf_dir), *_outputs(spark, sf_dir))


STAGES = f"WITH {OUTPUTS} SELECT count(*) AS papers, count(*) FILTER (k % 3 > 0) AS prepared, count(*) FILTER (k % 5 = 0) AS summarised FROM o"


def papers_covered(spark, sf_dir):
    return B.core_names(_outputs(spark, sf_dir)[0])


COVERED = f"WITH {OUTPUTS} SELECT DISTINCT unnest([stem, regexp_replace(stem, '_\\d+$', '')]) AS name FROM o WHERE k % 3 > 0"


def papers_to_prepare(spark, sf_dir):
    papers = _papers(spark, sf_dir)
    return B.unprepared(papers.select("name"), _outputs(spark, sf_dir)[0], papers.filter("k % 10 = 1").select("name"), papers.filter("k % 9 = 0").select("name"))


PREPARE = f"WITH {OUTPUTS} SELECT name FROM o WHERE (k % 3 = 0 OR k % 10 = 1) AND k % 9 <> 0"


def listed_texts(spark, sf_dir):
    """Texts of the listed files, and the papers that an only-list keeps."""
    papers = _papers(spark, sf_dir)
    chapters = papers.filter("k % 4 = 0").select(F.col("name").alias("stem"), F.explode(F.array(F.concat("name", F.lit("_01")), F.concat("name", F.lit("_02")))).alias("chapter_stem"))
    files = papers.filter("k % 7 < 3").select(F.col("k").alias("pos"), F.concat("name", F.lit(".pdf")).alias("file"))
    texts = B.named_texts(files, chapters)
    return B.only_named(texts, papers.filter("k % 2 = 0").select(F.when(F.col("k") % 4 == 0, F.concat("name", F.lit("_02"))).otherwise(F.col("name")).alias("stem")), "stem")


LISTED = f"WITH {PAPERS} SELECT CASE WHEN k % 4 = 0 THEN name || '_02' ELSE name END AS stem FROM p WHERE k % 7 < 3 AND k % 2 = 0"


def _entries(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat("o_orderpriority", F.lit(" "), key.cast("string")).alias("name"), (key % 50 == 0).alias("folder"), F.col("o_orderdate").alias("modified"),
        F.concat_ws("/", F.when(key % 3 == 0, F.lit("in")), F.concat(key.cast("string"), F.when(key % 2 == 0, F.lit(".PDF")).otherwise(F.lit(".md")))).alias("path"))


def folder_listing(spark, sf_dir):
    return B.folder_page(_entries(spark, sf_dir).drop("path"), "URGENT", 2)


FOLDER = """
SELECT o_orderpriority || ' ' || o_orderkey AS name, o_orderkey % 50 = 0 AS folder, o_orderdate AS modified FROM orders WHERE contains(lower(o_orderpriority || ' ' || o_orderkey), 'urgent')
ORDER BY folder DESC, CASE WHEN folder THEN lower(name) END, modified DESC, name LIMIT 100 OFFSET 100
"""


def folder_counts(spark, sf_dir):
    files = _entries(spark, sf_dir).select("path")
    first, capped = B.files_below(files, 50)
    return B.suffix_counts(files, ".pdf").join(first.agg(F.max("path").alias("last"), F.count(F.lit(1)).alias("shown")), F.lit(True)).withColumn("capped", capped)


FOLDER_COUNTS = """
WITH f AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'in/' ELSE '' END || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.PDF' ELSE '.md' END AS path FROM orders)
SELECT count(*) FILTER (ends_with(path, '.PDF') AND NOT contains(path, '/')) AS here, count(*) FILTER (ends_with(path, '.PDF') AND contains(path, '/')) AS deeper,
  (SELECT max(path) FROM (SELECT path FROM f ORDER BY path LIMIT 50)) AS last, 50 AS shown, true AS capped FROM f
"""


def _steps(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("pos")).agg(F.max("l_quantity").alias("q"), F.max("l_suppkey").alias("s"))
    outcome = F.when(F.col("q") < 25, "done").when(F.col("q") < 28, "failed")
    return line.select("chain", "pos", outcome.alias("outcome"), F.when(F.col("s") % 3 > 0, F.col("q")).alias("dollars"), F.when(F.col("chain") % 2 == 0, F.lit(40.0)).alias("approved"))


STEPS = """
WITH l AS (SELECT l_orderkey AS chain, l_linenumber AS pos, max(l_quantity) AS q, max(l_suppkey) AS s FROM lineitem GROUP BY ALL),
t AS (SELECT chain, pos, CASE WHEN q < 25 THEN 'done' WHEN q < 28 THEN 'failed' END AS outcome, CASE WHEN s % 3 > 0 THEN q END AS dollars, CASE WHEN chain % 2 = 0 THEN 40 END AS approved FROM l),
d AS (SELECT *, outcome IS NULL AND coalesce(dollars > coalesce(approved, 0), false) AS dear FROM t),
b AS (SELECT *, coalesce(max(CASE WHEN outcome = 'failed' THEN 2 WHEN dear THEN 1 END) OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM d),
s AS (SELECT chain, pos, outcome, dollars, approved, CASE WHEN stopped = 2 THEN 'skipped' WHEN stopped = 1 THEN 'waiting' WHEN dear THEN 'paused' ELSE coalesce(outcome, 'ready') END AS state FROM b)
"""


def job_chains(spark, sf_dir):
    return B.chain_states(_steps(spark, sf_dir)).select("chain", "pos", "state")


def chains_go_on(spark, sf_dir):
    return B.next_steps(B.chain_states(_steps(spark, sf_dir)))


def next_ids(spark, sf_dir):
    """Next id of records whose ids are partly not numbers, and the last line of the longest logs."""
    records = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, F.lit("old")).otherwise(F.col("o_orderkey").cast("string")).alias("id"))
    logs = table(spark, sf_dir, "conversations").select("conv_id", "turn", B.last_line(F.concat("text", F.lit("\n\n  \n"))).alias("last"))
    return logs.join(F.broadcast(B.next_id(records)), F.lit(True))


NEXT = """
SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '')[-1] AS last,
  (SELECT max(CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey END) + 1 FROM orders) AS next FROM conversations
"""


def form_flags(spark, sf_dir):
    fields = table(spark, sf_dir, "nation").select(F.lit("run").alias("command"), F.col("n_nationkey").cast("string").alias("field"), F.element_at(F.array(*map(F.lit, ["int", "float", "bool", "text"])), F.col("n_nationkey") % 4 + 1).alias("kind"), F.concat(F.lit("--"), F.lower("n_name")).alias("flag"))
    values = table(spark, sf_dir, "supplier").select(F.lit("run").alias("command"), (F.col("s_suppkey") % 40).cast("string").alias("field"), F.element_at(F.array(*map(F.lit, ["12", " 1.5 ", "on", "", "x"])), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("value")).distinct()
    return B.flags(fields, values)


FLAGS = """
WITH f AS (SELECT n_nationkey::VARCHAR AS field, ['int', 'float', 'bool', 'text'][n_nationkey % 4 + 1] AS kind, '--' || lower(n_name) AS flag FROM nation),
v AS (SELECT DISTINCT (s_suppkey % 40)::VARCHAR AS field, trim(['12', ' 1.5 ', 'on', '', 'x'][s_suppkey % 5 + 1]) AS value FROM supplier),
j AS (SELECT *, CASE kind WHEN 'int' THEN value = '12' WHEN 'float' THEN value IN ('12', '1.5') ELSE true END AS good FROM f JOIN v USING (field) WHERE value <> '')
SELECT 'run' AS command, field, CASE WHEN good THEN CASE WHEN kind <> 'bool' THEN flag || ' ' || value WHEN value = 'on' THEN flag END END AS flag, NOT good AS bad FROM j
WHERE NOT good OR kind <> 'bool' OR value = 'on'
"""


def list_counts(spark, sf_dir):
    lists = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return B.list_counts(lists, table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_suppkey").alias("list_id")))


LIST_COUNTS = "SELECT s_name AS name, count(l_suppkey) AS n FROM supplier LEFT JOIN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45) ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name"


def newest_files(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("map_"), (F.col("o_custkey") % 100).cast("string"), F.lit("_plan_12.md")).alias("name"), F.col("o_orderdate").alias("modified"))
    return B.newest_first(files).withColumn("outline", B.outline_of(F.col("name")))


NEWEST = "SELECT 'map_' || (o_custkey % 100) || '_plan_12.md' AS name, max(o_orderdate) AS modified, 'map_' || (o_custkey % 100) AS outline FROM orders GROUP BY o_custkey % 100"


def books_and_outputs(spark, sf_dir):
    """Books of chapters, and what is there of each paper."""
    names = table(spark, sf_dir, "part").select(F.concat_ws("_", (F.col("p_partkey") % 300).cast("string"), F.format_string("%02d", F.col("p_size"))).alias("stem"))
    chapters = names.distinct()
    prepared = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).cast("string").alias("name"))
    outputs = names.select(F.concat(F.lit("text_"), "stem", F.lit(".md")).alias("name")).distinct().unionByName(prepared.select(F.concat("name", F.lit(".md")).alias("name")))
    made = B.finished(outputs)
    return B.books_of(chapters, prepared).join(made.withColumnRenamed("stem", "book"), "book", "left").select("stem", "book", "single", "chapters")


BOOKS = """
WITH c AS (SELECT DISTINCT (p_partkey % 300)::VARCHAR AS head, printf('%02d', p_size) AS chapter FROM part), p AS (SELECT (s_suppkey * 2)::VARCHAR AS name FROM supplier)
SELECT head || '_' || chapter AS stem, name AS book, CASE WHEN name IS NOT NULL THEN true END AS single, CASE WHEN name IS NOT NULL THEN count(*) OVER (PARTITION BY head) END AS chapters
FROM c LEFT JOIN p ON name = head
"""


def related_files(spark, sf_dir):
    stems = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("stem"))
    files = table(spark, sf_dir, "part").select(F.concat(F.element_at(F.array(*map(F.lit, ["text_", "sum_", "quote_", "odd_"])), (F.col("p_size") % 4 + 1).cast("int")), (F.col("p_partkey") % 150).cast("string"), F.lit(".md")).alias("file"))
    return B.related_documents(stems, files)


RELATED = """
WITH f AS (SELECT DISTINCT p_size % 4 AS kind, p_partkey % 150 AS s FROM part)
SELECT s::VARCHAR AS stem, [0, 1, 3][kind + 1] AS place, ['text_', 'sum_', 'quote_'][kind + 1] || s || '.md' AS file FROM f JOIN supplier ON s_suppkey = s WHERE kind < 3
"""


def paper_links(spark, sf_dir):
    works = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("base"), F.col("s_name").alias("title"))
    edges = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 200).alias("dst")).distinct()
    return B.paper_facts(works, edges.join(works.select(F.col("base").alias("dst")), "dst", "left_semi"))


LINKS = """
WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 200 AS dst FROM lineitem JOIN supplier ON s_suppkey = l_partkey % 200 WHERE l_quantity > 48),
n AS (SELECT src, list_sort(list(s_name)) AS cites FROM e JOIN supplier ON s_suppkey = dst GROUP BY src),
b AS (SELECT dst, list_sort(list(s_name)) AS cited_by FROM e JOIN supplier ON s_suppkey = src GROUP BY dst)
SELECT s_suppkey AS base, s_name AS title, coalesce(cites, []) AS cites, coalesce(cited_by, []) AS cited_by FROM supplier LEFT JOIN n ON src = s_suppkey LEFT JOIN b ON dst = s_suppkey
"""


def conversation_list(spark, sf_dir):
    return B.conversation_cards(table(spark, sf_dir, "conversations"))


TALKS = "SELECT conv_id, count(*) AS questions, arg_max(text, turn) AS last FROM conversations WHERE role = 'user' GROUP BY conv_id"


def conversation_works(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("conv"), F.col("l_linenumber").alias("pos")).agg((F.max("l_partkey") % 10).alias("base"))
    found = line.select("conv", F.concat(F.lit("f"), "base").alias("base"), F.col("pos").alias("rank"))
    return B.conversation_works(line.filter("conv % 3 = 0").select("conv", F.col("base").cast("string").alias("base"), "pos"), found, 4)


TALK_WORKS = """
WITH l AS (SELECT l_orderkey AS conv, l_linenumber AS pos, max(l_partkey) % 10 AS base FROM lineitem GROUP BY ALL)
SELECT conv, base::VARCHAR AS base, min(pos) AS pos FROM l WHERE conv % 3 = 0 GROUP BY ALL UNION ALL SELECT conv, 'f' || base, pos FROM l WHERE conv % 3 > 0 AND pos <= 4
"""


def page_marks(spark, sf_dir):
    """Checked page numbers, pages of a mark, and which page counts are stale."""
    k = F.col("o_orderkey")
    numbers = F.array((k % 7).cast("int"), (k % 5 + 1).cast("int"), F.lit(3))
    kinds = F.create_map((k % 9).cast("string"), F.lit("contents"), F.lit("12"), F.lit("contents"), F.lit("30"), F.when(k % 2 == 0, F.lit("left-out")).otherwise(F.lit("contents")))
    orders = table(spark, sf_dir, "orders")
    files = orders.select(k.alias("name"), F.col("o_custkey").alias("size"), F.col("o_orderstatus").alias("modified"))
    cached = orders.filter(k % 3 > 0).select(k.alias("name"), F.concat_ws(":", F.when(k % 4 == 0, F.lit(0)).otherwise(F.col("o_custkey")), "o_orderstatus").alias("stamp"))
    stale = B.to_recount(files, cached).withColumn("stale", F.lit(True))
    made = orders.select(k.alias("name"), B.page_numbers(numbers, F.lit(6)).alias("numbers"), B.marks_of(kinds, "contents").alias("contents"))
    return made.join(stale, "name", "left").select("name", F.array_join("numbers", ",").alias("numbers"), F.array_join("contents", ",").alias("contents"), F.coalesce("stale", F.lit(False)).alias("stale"))


MARKS = """
SELECT o_orderkey AS name, CASE WHEN o_orderkey % 7 BETWEEN 1 AND 6 THEN array_to_string(list_sort(list_distinct([o_orderkey % 7, o_orderkey % 5 + 1, 3])), ',') END AS numbers,
  array_to_string(list_sort(CASE WHEN o_orderkey % 2 = 0 THEN [o_orderkey % 9, 12] ELSE [o_orderkey % 9, 12, 30] END), ',') AS contents,
  o_orderkey % 3 = 0 OR (o_orderkey % 4 = 0 AND o_custkey <> 0) AS stale FROM orders
"""


def lookup_run(spark, sf_dir):
    """Works after matches were stored and others forgotten, with the estimate of what was to look up."""
    part = table(spark, sf_dir, "part")
    works = part.select(F.concat(F.lit("A_b"), (F.col("p_partkey") % 500).cast("string"), F.lit("_"), (F.col("p_partkey") % 3).cast("string")).alias("base"), F.col("p_retailprice").alias("v")).dropDuplicates(["base"]).select("base", F.lit(1.0).alias("v"))
    matched = works.filter(F.col("base").endswith("_1")).select("base", F.lit(2.0).alias("v"))
    kept, _ = B.forget(B.store(works, matched), table(spark, sf_dir, "region").select(F.col("r_name").alias("citing_base")), works.filter(F.col("base").endswith("7_2")).select("base"))
    asked = B.looked_up(works, kept)
    estimate = B.fetch_estimate(asked.select("work", F.lit(3).alias("papers"), F.when(F.col("work").endswith("5"), F.lit("10.1/x")).alias("doi")))
    return kept.join(F.broadcast(estimate), F.lit(True))


LOOKUP = """
WITH w AS (SELECT DISTINCT 'A_b' || (p_partkey % 500) AS work, p_partkey % 3 AS c FROM part), u AS (SELECT DISTINCT work FROM w),
e AS (SELECT count(*) AS works, 3 * count(*) AS papers, count(*) FILTER (ends_with(work, '5')) AS by_doi, count(*) FILTER (NOT ends_with(work, '5')) AS by_search FROM u)
SELECT work || '_' || c AS base, CASE WHEN c = 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS v, works, papers::BIGINT AS papers, by_doi, by_search FROM w, e WHERE NOT (c = 2 AND ends_with(work, '7'))
"""


def missed_works(spark, sf_dir):
    """Works still without a match, with the file a lookup reads: the whole text, else the first chapter."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    before = part.filter(k % 4 == 0).select(k.alias("work"))
    tried = part.filter(k % 6 < 4).select(k.alias("work"), F.when(k % 6 < 2, F.lit("crossref")).alias("source"))
    texts = part.select(k.alias("stem"), F.when(k % 2 == 0, F.lit("01")).alias("chapter"), F.concat(F.lit("t"), k).alias("path")).filter(k % 5 > 0)
    return B.text_paths(B.not_found(before, tried), texts)


MISSED = "SELECT p_partkey AS work, CASE WHEN p_partkey % 5 > 0 THEN 't' || p_partkey END AS path FROM part WHERE (p_partkey % 4 = 0 OR p_partkey % 6 IN (2, 3)) AND p_partkey % 6 NOT IN (0, 1)"


def shown_documents(spark, sf_dir):
    """What a found document shows: its files, the one that opens, its first neighbours, tags as words."""
    k = F.col("o_orderkey")
    text, summary = F.when(k % 3 > 0, F.concat(F.lit("t"), k)), F.when(k % 4 > 0, F.concat(F.lit("s"), k)).otherwise(F.lit(""))
    which = F.when(k % 5 == 0, "text").when(k % 5 == 1, "sum")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", *S.result_row(text, summary), S.file_to_show(text, summary, which).alias("shown"),
        F.array_join(B.first_related(F.sequence(F.lit(1), (k % 11 + 1).cast("int"))), ",").alias("related"),
        B.plain_moves(F.concat(F.lit("1. [GAP]: "), "o_orderpriority", F.lit(" [AIM]: x")), {"GAP": "Gap", "AIM": "Aim"}).alias("plan"),
        S.summary_status(F.concat(F.lit("## T\n"), F.when(k % 2 == 0, F.lit("**Methods:** **Arguments:** **Key conclusions:** **Empirical context:** **Discussion items:**")).otherwise("")), k % 7 == 0).alias("status"))


SHOWN = """
WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, CASE WHEN o_orderkey % 3 > 0 THEN 't' || o_orderkey END AS t, CASE WHEN o_orderkey % 4 > 0 THEN 's' || o_orderkey END AS s FROM orders)
SELECT k AS o_orderkey, t IS NOT NULL AS has_text, s IS NOT NULL AS has_sum, CASE k % 5 WHEN 0 THEN t WHEN 1 THEN s ELSE coalesce(s, t) END AS shown,
  array_to_string(range(1, least(k % 11 + 1, 8) + 1), ',') AS related, '1. **Gap:** ' || p || ' **Aim:** x' AS plan,
  CASE WHEN k % 7 = 0 THEN 'truncated' WHEN k % 2 = 0 THEN 'ok' ELSE 'no template' END AS status FROM o
"""

QUERIES = {
    "paper_sorting": (paper_sorting, SORTING),
    "stage_counts": (stage_counts, STAGES),
    "papers_covered": (papers_covered, COVERED),
    "papers_to_prepare": (papers_to_prepare, PREPARE),
    "listed_texts": (listed_texts, LISTED),
    "folder_listing": (folder_listing, FOLDER),
    "folder_counts": (folder_counts, FOLDER_COUNTS),
    "job_chains": (job_chains, STEPS + "SELECT chain, pos, state FROM s"),
    "chains_go_on": (chains_go_on, STEPS + "SELECT chain, min(pos) AS pos FROM s WHERE state <> 'done' GROUP BY chain"),
    "next_ids": (next_ids, NEXT),
    "form_flags": (form_flags, FLAGS),
    "list_counts": (list_counts, LIST_COUNTS),
    "newest_files": (newest_files, NEWEST),
    "books_and_outputs": (books_and_outputs, BOOKS),
    "related_files": (related_files, RELATED),
    "paper_links": (paper_links, LINKS),
    "conversation_list": (conversation_list, TALKS),
    "conversation_works": (conversation_works, TALK_WORKS),
    "page_marks": (page_marks, MARKS),
    "lookup_run": (lookup_run, LOOKUP),
    "missed_works": (missed_works, MISSED),
    "shown_documents": (shown_documents, SHOWN),
}
