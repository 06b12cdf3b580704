"""Registered queries of review work, lookups, tickets and lists; orders, parts and lines stand for works, files and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import citations as C
from ..operators import library as B
from ..operators import metrics as E
from ..operators import reviews as R
from ..operators import sequences as Q
from ..runtime import table


def _parts(spark, sf_dir):
    """base, work of papers, every third a chapter."""
    k = F.col("p_partkey")
    name = F.concat(F.col("p_brand"), F.lit("_"), F.translate("p_name", " ", "_"))
    return table(spark, sf_dir, "part").select(F.when(k % 3 == 0, F.concat(name, F.lit("_0"), k % 10)).otherwise(F.concat(name, F.lit("_t"))).alias("base"), k.alias("k"), "p_name", "p_brand", "p_retailprice")


PARTS = "p AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_brand || '_' || replace(p_name, ' ', '_') || '_0' || (p_partkey % 10) ELSE p_brand || '_' || replace(p_name, ' ', '_') || '_t' END AS base, p_partkey AS k, p_name, p_brand, p_retailprice FROM part)"


def works_pending(spark, sf_dir):
    papers = _parts(spark, sf_dir)
    found = R.works_to_fetch(papers, papers.filter("k % 4 = 0").select("base"), papers.filter("k % 50 = 1").select(X.work_of(F.col("base")).alias("work")), papers.filter("k % 5 > 0").select(X.work_of(F.col("base")).alias("work")))
    return found.select("work", F.array_join("bases", " ").alias("bases"))


PENDING = f"""
WITH {PARTS}, w AS (SELECT *, CASE WHEN regexp_matches(base, '^.*_.*_\\d+$') THEN regexp_replace(base, '_\\d+$', '') ELSE base END AS work FROM p)
SELECT work, array_to_string(list_sort(list(DISTINCT base)), ' ') AS bases FROM w
WHERE base NOT IN (SELECT base FROM w WHERE k % 4 = 0) AND work NOT IN (SELECT work FROM w WHERE k % 50 = 1) AND work IN (SELECT work FROM w WHERE k % 5 > 0) GROUP BY work
"""


def confirmed_tries(spark, sf_dir):
    """The first record of each work that agrees with its name."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    work = F.concat(F.lit("Smith_"), F.translate("p_name", " ", "_"), k)
    tries = part.select(work.alias("work"), F.explode(F.array(*map(F.lit, [0, 1, 2]))).alias("place"), "p_name", k.alias("k"))
    tries = tries.select("work", "place", F.element_at(F.array(*map(F.lit, ["own", "export", "crossref"])), F.col("place") + 1).alias("source"), F.concat(F.lit("10.1/"), "k", F.lit("."), "place").alias("doi"),
                         F.when((F.col("k") + F.col("place")) % 3 == 0, F.concat("p_name", F.col("k"))).otherwise(F.lit("something else")).alias("title"), F.array(F.when(F.col("k") % 2 == 0, F.lit("Smith")).otherwise(F.lit("Jones"))).alias("authors"), (F.col("place") == 2).alias("need_author"))
    return R.confirmed(tries)


CONFIRMED = """
WITH t AS (SELECT 'Smith_' || replace(p_name, ' ', '_') || p_partkey AS work, p_partkey AS k, unnest([0, 1, 2]) AS place FROM part),
g AS (SELECT * FROM t WHERE (k + place) % 3 = 0 AND (place < 2 OR k % 2 = 0))
SELECT work, '10.1/' || k || '.' || min(place) AS doi, ['own', 'export', 'crossref'][min(place) + 1] AS source, 1.0::DOUBLE AS confidence FROM g GROUP BY work, k
"""


def close_records(spark, sf_dir):
    """Search results that agree in title, both ways, and in author."""
    k = F.col("p_partkey")
    found = table(spark, sf_dir, "part").select(F.concat(F.lit("Smith_"), F.translate("p_name", " ", "_")).alias("work"), k.alias("pos"), F.when(k % 3 == 0, F.concat("p_name", F.lit(": an unrelated and much longer subtitle"))).when(k % 3 == 1, F.concat(F.lit("several words that lead up to "), "p_name")).otherwise(F.lit("x")).alias("title"),
                                                    F.array(F.when(k % 2 == 0, F.lit("Jane Smith")).otherwise(F.lit("Jones"))).alias("authors"), F.lit("10.1/x").alias("doi"))
    return R.close_records(found).select("work", "pos")


def planned_documents(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    made = orders.select(k.alias("stem"), F.explode(F.filter(F.array(F.when(k % 2 == 0, "sum"), F.when(k % 3 == 0, "para"), F.when(k % 5 < 3, "quote")), lambda x: x.isNotNull())).alias("kind"))
    return R.plan_documents(orders.select(k.alias("stem"), (k % 7 == 0).alias("changed")), made).select("stem", "changed", F.array_join("todo", ",").alias("todo"))


PLANNED = """
SELECT o_orderkey AS stem, o_orderkey % 7 = 0 AS changed, array_to_string(list_filter([CASE WHEN o_orderkey % 2 > 0 OR o_orderkey % 7 = 0 THEN 'sum' END, CASE WHEN o_orderkey % 3 > 0 OR o_orderkey % 7 = 0 THEN 'para' END,
  CASE WHEN o_orderkey % 5 >= 3 OR o_orderkey % 7 = 0 THEN 'quote' END], lambda x: x IS NOT NULL), ',') AS todo FROM orders WHERE todo <> ''
"""


def stale_outputs(spark, sf_dir):
    """Summaries of chapters that are gone, and summaries without a template, with the files beside them."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.max("l_partkey").alias("k"))
    stem = F.concat(F.lit("b"), "o", F.lit("_0"), "n")
    summaries = rows.select(stem.alias("stem"), F.concat(F.lit("sum_"), stem).alias("path"), F.when(F.col("k") % 4 > 0, F.lit("x\n## T")).otherwise(F.lit("none")).alias("text"))
    texts = rows.filter("k % 3 > 0").select(stem.alias("stem"))
    stale = R.stale_summaries(summaries, texts).select("stem", F.lit("stale").alias("why"), F.lit(None).cast("string").alias("pair"))
    pairs = rows.filter("k % 8 = 0").select(stem.alias("stem"), F.concat(F.lit("para_"), stem).alias("pair"))
    return stale.unionByName(R.failed_outputs(summaries, pairs).select("stem", F.lit("failed").alias("why"), "pair"))


STALE = """
WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, max(l_partkey) AS k FROM lineitem GROUP BY ALL), s AS (SELECT *, 'b' || o || '_0' || n AS stem FROM l)
SELECT stem, 'stale' AS why, NULL::VARCHAR AS pair FROM s WHERE k % 3 = 0 AND o IN (SELECT o FROM s WHERE k % 3 > 0)
UNION ALL SELECT stem, 'failed', CASE WHEN k % 8 = 0 THEN 'para_' || stem END FROM s WHERE k % 4 = 0
"""


def ticket_cards(spark, sf_dir):
    """Progress of tickets and the names that open ones wait for."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("ticket"), F.when(k % 3 == 0, "open").otherwise("done").alias("state"), F.array(F.concat(F.lit("p"), k % 500), F.concat(F.lit("q"), k % 90)).alias("plans"), R.card(F.col("o_custkey") % 20, F.least(F.col("o_custkey") % 20, k % 9)).alias("c"))
    waiting = R.pending(rows).withColumn("waits", F.lit(True))
    return rows.select("ticket", "c.answered", "c.share", F.get("plans", F.lit(0)).alias("name")).join(waiting, "name", "left").select("ticket", "answered", "share", F.coalesce("waits", F.lit(False)).alias("waits"))


CARDS = """
WITH o AS (SELECT o_orderkey AS k, o_custkey % 20 AS n, least(o_custkey % 20, o_orderkey % 9) AS open_ FROM orders)
SELECT k AS ticket, n - open_ AS answered, round_even(100 * (n - open_) / greatest(1, n), 0)::INT AS share, k % 500 IN (SELECT k % 500 FROM o WHERE k % 3 = 0) AS waits FROM o
"""


def keyword_hits(spark, sf_dir):
    works = _parts(spark, sf_dir).select(F.col("k").alias("base"), F.col("p_brand").alias("authors"), F.col("p_name").alias("title"))
    found = R.keyword_select(works, "RED")
    long = F.repeat(F.col("title"), 60)
    return found.select("base", R.hit_lines(long, F.concat(F.lit("c "), long), F.col("authors"), F.col("title")).alias("hit"))


HITS = """
WITH f AS (SELECT * FROM part WHERE contains(lower(p_brand), 'red') OR contains(lower(p_name), 'red') ORDER BY lower(p_brand), p_partkey LIMIT 30)
SELECT p_partkey AS base, p_brand || ' - ' || p_name || chr(10) || 'Arguments: ' || substr(repeat(p_name, 60), 1, 500) || chr(10) || 'Conclusions: ' || substr('c ' || repeat(p_name, 60), 1, 300) AS hit FROM f
"""


def filled_selection(spark, sf_dir):
    works = _parts(spark, sf_dir)
    selected = works.filter("k % 100 = 7").select(F.col("k").alias("base"), F.col("k").alias("pos"))
    return R.backfill(selected, works.filter("k < 100").select(F.col("k").alias("base"), (100 - F.col("k")).alias("rank")))


FILLED = """
WITH s AS (SELECT p_partkey AS base, 0 AS part, p_partkey AS at_ FROM part WHERE p_partkey % 100 = 7),
r AS (SELECT p_partkey AS base, 1 AS part, 100 - p_partkey AS at_ FROM part WHERE p_partkey < 100 AND p_partkey NOT IN (SELECT base FROM s))
SELECT base FROM (SELECT * FROM s UNION ALL SELECT * FROM r ORDER BY part, at_ LIMIT 40)
"""


def section_words(spark, sf_dir):
    """Terms that a section's text lacks, and how many works it names."""
    nation = table(spark, sf_dir, "nation")
    terms = nation.select((F.col("n_nationkey") % 4).alias("section"), F.lower("n_name").alias("term"), F.col("n_nationkey").alias("rank"))
    sections = nation.filter("n_nationkey < 8").groupBy((F.col("n_nationkey") % 4).alias("section")).agg(F.concat_ws(" ", F.array_sort(F.collect_list("n_name"))).alias("text"))
    works = nation.select(F.col("n_nationkey").alias("base"), F.concat(F.lit("Al "), F.initcap("n_name")).alias("authors"))
    named = R.works_for_section(F.lit("France; Germany, Indonesia"), works).agg(F.count(F.lit(1)).alias("named"))
    return R.section_terms(terms, sections).join(named, F.lit(True))


WORDS = """
WITH t AS (SELECT n_nationkey % 4 AS section, lower(n_name) AS term, n_nationkey AS k FROM nation), s AS (SELECT n_nationkey % 4 AS section, string_agg(lower(n_name), ' ') AS text FROM nation WHERE n_nationkey < 8 GROUP BY 1),
f AS (SELECT section, term, row_number() OVER (PARTITION BY section ORDER BY k)::INT AS rank FROM t JOIN s USING (section) WHERE NOT contains(text, term)),
n AS (SELECT count(*) AS c FROM nation WHERE contains('france; germany, indonesia', lower(n_name)) AND length(n_name) > 3)
SELECT section, term, rank, CASE WHEN c >= 2 THEN c ELSE (SELECT count(*) FROM nation) END AS named FROM f, n WHERE rank <= 6
"""


def manuscript_parts(spark, sf_dir):
    """A manuscript of regions, its words against a target, works by first use, shares in percent."""
    nation = table(spark, sf_dir, "nation")
    sections = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("label"), F.when(F.col("r_regionkey") == 2, F.lit("  ")).otherwise(F.concat(F.lit(" some words on "), "r_name")).alias("text"))
    whole = R.manuscript(sections).select("text", F.col("words").cast("long").alias("words"))
    uses = R.used_in_order(nation.select((F.col("n_regionkey") * 10).alias("base"), F.col("n_nationkey").alias("pos")))
    shares = R.stage_shares(uses.withColumn("typical_share", F.when(F.col("base") > 0, F.col("pos") / 200)))
    return shares.join(whole, F.lit(True)).withColumn("fits", R.within_target(F.col("words"), F.col("pos") + 10))


PARTS_OF = """
WITH w AS (SELECT string_agg('## ' || r_name || chr(10) || chr(10) || 'some words on ' || r_name, chr(10) || chr(10) ORDER BY r_regionkey) AS text, sum(3 + len(string_split(r_name, ' '))) AS words FROM region WHERE r_regionkey <> 2),
u AS (SELECT n_regionkey * 10 AS base, min(n_nationkey) AS pos FROM nation GROUP BY 1)
SELECT base, pos, CASE WHEN base > 0 THEN pos / 200 END AS typical_share, CASE WHEN base > 0 THEN round_even(100 * pos / 200, 0) ELSE 0 END::INT AS percent, text, words::BIGINT AS words,
  CASE WHEN words < (pos + 10) * 0.85 THEN 'under' WHEN words > (pos + 10) * 1.15 THEN 'over' ELSE 'ok' END AS fits FROM u, w
"""


def sequences_kept(spark, sf_dir):
    """Label sequences after a run, and the papers that still need labels."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    of = lambda rule, name: part.filter(rule).select(k.alias("base"), F.lit(name).alias("moves"))
    merged = R.merge_sequences(of("p_partkey % 5 = 0", "new"), of("p_partkey % 3 = 0", "old"), part.filter("p_partkey % 2 = 0").select(k.alias("base")))
    todo = R.papers_to_label(part.select(k.alias("base")), merged, limit=100).withColumn("moves", F.lit("todo"))
    return merged.unionByName(todo)


KEPT = """
WITH m AS (SELECT p_partkey AS base, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE 'old' END AS moves FROM part WHERE p_partkey % 5 = 0 OR (p_partkey % 3 = 0 AND p_partkey % 2 = 0))
SELECT * FROM m UNION ALL (SELECT p_partkey, 'todo' FROM part WHERE p_partkey NOT IN (SELECT base FROM m) ORDER BY p_partkey LIMIT 100)
"""


def recent_marks(spark, sf_dir):
    """The newest files, and stems marked after their output was made."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    newest = R.recent(orders.select(k.cast("string").alias("name"), F.col("o_orderdate").alias("modified")))
    again = R.marked_again(orders.filter(k % 2 == 0).select((k % 900).alias("stem"), F.col("o_orderdate").alias("modified")), orders.filter(k % 2 == 1).select(((k + 1) % 900).alias("stem"), F.col("o_orderdate").alias("modified")))
    return newest.select("name", "total").unionByName(again.select(F.concat(F.lit("again "), "stem").alias("name"), F.lit(None).cast("long").alias("total")))


RECENT = """
WITH a AS (SELECT o_orderkey % 900 AS stem, o_orderdate AS d FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT (o_orderkey + 1) % 900 AS stem, max(o_orderdate) AS made FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
(SELECT o_orderkey::VARCHAR AS name, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, name LIMIT 12)
UNION ALL SELECT DISTINCT 'again ' || stem, NULL::BIGINT FROM a JOIN b USING (stem) WHERE d > made
"""


def page_specs(spark, sf_dir):
    """Page specifications as page numbers."""
    k = F.col("o_orderkey") % 9
    spec = F.when(k == 0, F.lit(" ")).when(k == 1, F.lit(None).cast("string")).otherwise(F.concat(k, F.lit(" , "), F.lit("2-"), k + 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(E.pages_of(spec), ",").alias("pages"))


SPECS = "SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 1 THEN array_to_string(range(1, o_orderkey % 9 + 1), ',') END AS pages FROM orders"


def located_gold(spark, sf_dir):
    """Lines of a key's n-th occurrence; order lines stand for lines."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("doc"), (F.col("l_partkey") % 50).cast("string").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")).groupBy("doc", "line").agg(F.min("key").alias("key"))
    gold = E.occurrences(lines).filter("occurrence % 4 = 1").select("doc", "key", "occurrence")
    return E.locate(gold, lines.select("doc", "key", "line").distinct()).groupBy("doc").agg(F.count("line").alias("found"), F.sum("line").alias("lines"))


GOLD = """
WITH l AS (SELECT l_suppkey % 10 AS doc, l_orderkey * 10 + l_linenumber AS line, min((l_partkey % 50)::VARCHAR) AS key FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY doc, key ORDER BY line) AS n FROM l) SELECT doc, count(*) AS found, sum(line)::BIGINT AS lines FROM n WHERE n % 4 = 1 GROUP BY doc
"""


def chapter_scores(spark, sf_dir):
    """Means over chapter scores."""
    return E.overall(table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("f1"), F.col("l_tax").alias("exact"), F.col("l_linenumber").cast("long").alias("over"), (F.col("l_suppkey") % 3).alias("under"))).select(
        "files", F.round("f1", 6).alias("f1"), F.round("exact", 6).alias("exact"), "over", "under")


SCORES = "SELECT count(*) AS files, round(avg(l_discount * 10), 6) AS f1, round(avg(l_tax), 6) AS exact, sum(l_linenumber)::BIGINT AS over, sum(l_suppkey % 3)::BIGINT AS under FROM lineitem"


def list_changes(spark, sf_dir):
    """A list by name and by id without one item, a list file with new names, and what its names stand for."""
    lists = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("list_id"), F.col("l_partkey").alias("document_id")).distinct()
    first = B.list_by_id(lists, 3).unionByName(B.list_by_name(lists, "nobody"))
    left = B.remove_item(items, 3, 5).join(first, F.col("list_id") == F.col("id"))
    return left.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("document_id") == 5).alias("five"))


CHANGES = "SELECT s_name AS name, count(DISTINCT l_partkey) AS n, 0 AS five FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey = 3 AND l_partkey <> 5 GROUP BY s_name"


def kept_history(spark, sf_dir):
    """Jobs that a year's retention keeps."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("ended"))
    return B.keep_recent(orders, F.col("ended"), F.lit("1998-01-01").cast("timestamp"), 365).select("o_orderkey")


HISTORY = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 365 DAY"


def citation_lookups(spark, sf_dir):
    """A work's references and citers beside its row, and graph edges that name unknown works."""
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 300).alias("citing_base"), (F.col("l_partkey") % 300).alias("cited_base"))
    works = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("base"), "p_name")
    nodes, pairs = C.coupling_graph(works.filter("base < 50"), C.coupling(edges.filter("citing_base < 60").distinct().select("citing_base", F.col("cited_base").cast("string").alias("cited_ext_id"), F.lit(None).cast("string").alias("cited_doi")), 6))
    counts = C.references(edges, 7).agg(F.count(F.lit(1)).alias("cites")).join(C.citers(edges, 7).agg(F.count(F.lit(1)).alias("cited")), F.lit(True))
    graph = nodes.agg(F.count(F.lit(1)).alias("nodes")).join(pairs.agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").cast("long").alias("weight")), F.lit(True))
    return C.metadata(works, 7).join(counts, F.lit(True)).join(graph, F.lit(True))


LOOKUPS = """
WITH e AS (SELECT l_orderkey % 300 AS a, l_partkey % 300 AS b FROM lineitem), d AS (SELECT DISTINCT a, b FROM e WHERE a < 60),
c AS (SELECT x.a AS l, y.a AS r, count(*) AS n FROM d x JOIN d y ON x.b = y.b AND x.a < y.a GROUP BY ALL HAVING count(*) >= 6),
n AS (SELECT p_partkey AS base FROM part WHERE p_partkey < 50 UNION SELECT l FROM c UNION SELECT r FROM c)
SELECT p_partkey AS base, p_name, (SELECT count(*) FROM e WHERE a = 7) AS cites, (SELECT count(*) FROM e WHERE b = 7) AS cited, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM c) AS edges, (SELECT sum(n)::BIGINT FROM c) AS weight FROM part WHERE p_partkey = 7
"""


def move_pairs(spark, sf_dir):
    """Texts with their labels in maximal runs, and shares of a skeleton's stages."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("base"), F.col("l_linenumber").alias("pos")).agg(F.max("l_partkey").alias("k"))
    pairs = Q.paired(line.filter("k % 11 > 0").select("base", "pos", F.col("k").cast("string").alias("text")), line.filter("pos < 6").select("base", "pos", F.concat(F.lit("M"), F.col("k") % 2).alias("label")))
    return Q.gathered(pairs).groupBy("base", "label").agg(F.count(F.lit(1)).alias("runs"), F.max(F.size("texts")).alias("longest"))


PAIRS = """
WITH l AS (SELECT l_orderkey AS base, l_linenumber AS pos, max(l_partkey) AS k FROM lineitem GROUP BY ALL), p AS (SELECT base, pos, 'M' || (k % 2) AS label FROM l WHERE k % 11 > 0 AND pos < 6),
g AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY pos) - row_number() OVER (PARTITION BY base, label ORDER BY pos) AS g FROM p), r AS (SELECT base, label, g, count(*) AS n FROM g GROUP BY ALL)
SELECT base, label, count(*) AS runs, max(n)::INT AS longest FROM r GROUP BY base, label
"""


def skeleton_shares(spark, sf_dir):
    stages = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("skeleton"), F.concat(F.lit("M"), F.col("l_partkey") % 5).alias("label"), F.col("l_discount").alias("typical_share"))
    return Q.skeleton_distribution(stages, ["M0", "M1", "M2"]).select("skeleton", "label", F.round("share", 6).alias("share"))


SHARES = """
WITH s AS (SELECT l_suppkey % 20 AS skeleton, 'M' || (l_partkey % 5) AS label, sum(l_discount) AS s FROM lineitem WHERE l_partkey % 5 < 3 GROUP BY ALL)
SELECT skeleton, label, round(s / sum(s) OVER (PARTITION BY skeleton), 6) AS share FROM s
"""

QUERIES = {
    "works_pending": (works_pending, PENDING),
    "confirmed_tries": (confirmed_tries, CONFIRMED),
    "close_records": (close_records, "SELECT 'Smith_' || replace(p_name, ' ', '_') AS work, p_partkey AS pos FROM part WHERE p_partkey % 6 = 0"),
    "planned_documents": (planned_documents, PLANNED),
    "stale_outputs": (stale_outputs, STALE),
    "ticket_cards": (ticket_cards, CARDS),
    "keyword_hits": (keyword_hits, HITS),
    "filled_selection": (filled_selection, FILLED),
    "section_words": (section_words, WORDS),
    "manuscript_parts": (manuscript_parts, PARTS_OF),
    "sequences_kept": (sequences_kept, KEPT),
    "recent_marks": (recent_marks, RECENT),
    "page_specs": (page_specs, SPECS),
    "located_gold": (located_gold, GOLD),
    "chapter_scores": (chapter_scores, SCORES),
    "list_changes": (list_changes, CHANGES),
    "kept_history": (kept_history, HISTORY),
    "citation_lookups": (citation_lookups, LOOKUPS),
    "move_pairs": (move_pairs, PAIRS),
    "skeleton_shares": (skeleton_shares, SHARES),
}
