"""Registered queries over library tables, snapshots, lists and linkage; orders, customers and labels stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import citations as C
from ..operators import library as B
from ..runtime import table


def upsert_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("base"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("price"))
    return C.last_wins(rows, "base", "pos")


def insert_ignore_first(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("list_id"), (F.col("l_partkey") % 100).alias("document_id"), F.col("l_shipdate").alias("added_at"))
    return B.add_items(items.filter("document_id < 50"), items)


IGNORE = "SELECT l_suppkey AS list_id, l_partkey % 100 AS document_id, min(l_shipdate) AS added_at FROM lineitem GROUP BY ALL"


def _snapshots(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 500).cast("string").alias("stem"), F.when(F.col("o_orderkey") % 3 > 0, F.floor(F.col("o_orderkey") / 500).cast("string")).alias("chapter"),
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("m"),
    ).groupBy("stem", "chapter").agg(F.max("k").alias("k"), F.max("m").alias("m"))
    index = orders.filter("k % 5 <> 0").select("stem", "chapter", "k", F.col("m").alias("text_mtime"), F.when(F.col("k") % 2 == 0, F.col("m")).alias("sum_mtime"), F.when(F.col("k") % 7 > 0, F.col("k")).alias("body_rowid"))
    found = orders.filter("k % 11 <> 0").select("stem", "chapter", F.when(F.col("k") % 4 > 0, F.lit("p")).alias("text_path"), F.when(F.col("k") % 13 == 0, 1.0).otherwise(F.col("m")).alias("text_mtime"), F.when(F.col("k") % 2 == 0, F.when(F.col("k") % 6 == 0, 2.0).otherwise(F.col("m"))).alias("sum_mtime"))
    return index, found


SNAP = """
o AS (SELECT (o_orderkey % 500)::VARCHAR AS stem, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey // 500)::VARCHAR END AS chapter, max(o_orderkey) AS k, max(o_totalprice) AS m FROM orders GROUP BY ALL),
i AS (SELECT stem, chapter, m AS text_mtime, CASE WHEN k % 2 = 0 THEN m END AS sum_mtime, CASE WHEN k % 7 > 0 THEN k END AS body_rowid FROM o WHERE k % 5 <> 0),
f AS (SELECT stem, chapter, CASE WHEN k % 4 > 0 THEN 'p' END AS text_path, CASE WHEN k % 13 = 0 THEN 1.0 ELSE m END AS text_mtime, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 6 = 0 THEN 2.0 ELSE m END END AS sum_mtime FROM o WHERE k % 11 <> 0)"""


def snapshot_diff(spark, sf_dir):
    index, found = _snapshots(spark, sf_dir)
    return B.what_changed(index.drop("k"), found).select("stem", "chapter", "change_row", "change_body")


DIFF = f"""
WITH {SNAP}
SELECT f.stem, f.chapter, i.stem IS NULL OR f.text_mtime IS DISTINCT FROM i.text_mtime OR f.sum_mtime IS DISTINCT FROM i.sum_mtime AS change_row,
  f.text_path IS NOT NULL AND (i.stem IS NULL OR f.text_mtime IS DISTINCT FROM i.text_mtime OR i.body_rowid IS NULL) AS change_body
FROM f LEFT JOIN i ON f.stem = i.stem AND f.chapter IS NOT DISTINCT FROM i.chapter
"""


def index_counts(spark, sf_dir):
    index, found = _snapshots(spark, sf_dir)
    changed = B.what_changed(index.drop("k"), found)
    return changed.groupBy("change_row", "change_body").agg(F.count(F.lit(1)).alias("n"))


COUNTS = f"SELECT change_row, change_body, count(*) AS n FROM ({DIFF}) GROUP BY ALL"


def index_upsert(spark, sf_dir):
    index, found = _snapshots(spark, sf_dir)
    changed = B.what_changed(index.drop("k"), found).filter("change_row").select("stem", "chapter", "text_mtime", "sum_mtime")
    return B.upsert(index.drop("k", "body_rowid"), changed, ["stem", "chapter"])


UPSERT = f"""
WITH {SNAP}, d AS (SELECT f.stem, f.chapter, f.text_mtime, f.sum_mtime FROM f LEFT JOIN i ON f.stem = i.stem AND f.chapter IS NOT DISTINCT FROM i.chapter
  WHERE i.stem IS NULL OR f.text_mtime IS DISTINCT FROM i.text_mtime OR f.sum_mtime IS DISTINCT FROM i.sum_mtime)
SELECT * FROM d UNION ALL SELECT stem, chapter, text_mtime, sum_mtime FROM i WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.stem = i.stem AND d.chapter IS NOT DISTINCT FROM i.chapter)
"""


def merged_scan(spark, sf_dir):
    index, found = _snapshots(spark, sf_dir)
    texts = index.select("stem", "chapter", F.lit("t").alias("text_path"), "text_mtime")
    sums = found.select("stem", "chapter", F.lit("s").alias("sum_path"), "sum_mtime")
    return B.merged_scan(texts, sums)


MERGED = f"""
WITH {SNAP} SELECT coalesce(i.stem, f.stem) AS stem, coalesce(i.chapter, f.chapter) AS chapter, CASE WHEN i.stem IS NOT NULL THEN 't' END AS text_path, i.text_mtime,
  CASE WHEN f.stem IS NOT NULL THEN 's' END AS sum_path, f.sum_mtime FROM i FULL JOIN f ON i.stem = f.stem AND i.chapter IS NOT DISTINCT FROM f.chapter
"""


def _lists(spark, sf_dir):
    lists = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.initcap("n_name").alias("name"), F.lit(0.0).alias("created_at"))
    items = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("list_id"), F.col("c_custkey").alias("document_id"), F.col("c_acctbal").alias("added_at"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stem"))
    return lists, items, docs


def list_summaries(spark, sf_dir):
    lists, items, _ = _lists(spark, sf_dir)
    return B.list_summaries(lists, items.filter("list_id > 5")).select("id", F.lower("name").alias("name"), "n_items")


LISTS = "SELECT n_nationkey::BIGINT AS id, lower(n_name) AS name, count(c_custkey) AS n_items FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND n_nationkey > 5 GROUP BY ALL"


def list_members(spark, sf_dir):
    _, items, docs = _lists(spark, sf_dir)
    return B.list_members(items, docs, 3).select("id", "stem", "added_at")


def list_memberships(spark, sf_dir):
    lists, items, docs = _lists(spark, sf_dir)
    more = items.unionByName(items.withColumn("list_id", (F.col("list_id") + 1) % 25))
    return B.memberships(more, lists, docs).select("document_id", F.lower(F.array_join("lists", ",")).alias("lists"))


MEMBERS = """
WITH i AS (SELECT c_custkey AS d, c_nationkey AS l FROM customer UNION ALL SELECT c_custkey, (c_nationkey + 1) % 25 FROM customer)
SELECT d AS document_id, lower(string_agg(DISTINCT n_name, ',' ORDER BY n_name)) AS lists FROM i JOIN nation ON n_nationkey = l GROUP BY d
"""


def export_stems(spark, sf_dir):
    _, items, docs = _lists(spark, sf_dir)
    return B.export_stems(items, docs, 3)


def list_edits(spark, sf_dir):
    """Create, rename and delete in turn."""
    lists, items, _ = _lists(spark, sf_dir)
    made = B.rename_list(B.create_list(lists, " Reading ", 5.0), 2, "Second")
    left, kept = B.delete_list(made, B.remove_item(items, 4, 1), 7)
    return B.list_summaries(left, kept).select("id", "name", "n_items")


EDITS = """
WITH l AS (SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey = 2 THEN 'Second' ELSE array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS name FROM nation
  UNION ALL SELECT max(n_nationkey) + 1, 'Reading' FROM nation)
SELECT id, name, count(c_custkey) AS n_items FROM l LEFT JOIN customer ON c_nationkey = id AND NOT (c_nationkey = 4 AND c_custkey = 1) WHERE id <> 7 GROUP BY ALL
"""


def progress_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    pdfs = orders.select(F.concat(F.lit("A_T"), (F.col("o_custkey") % 300).cast("string")).alias("stem")).distinct()
    texts = orders.select(F.concat(F.lit("A_T"), (F.col("o_custkey") % 400).cast("string"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("_0"), (F.col("o_orderkey") % 5).cast("string"))).otherwise("")).alias("text")).distinct()
    sums = texts.filter(F.col("text").rlike("[1357]$"))
    return B.progress(pdfs, texts, sums)


PROGRESS = """
WITH p AS (SELECT DISTINCT 'A_T' || (o_custkey % 300) AS stem FROM orders),
t AS (SELECT DISTINCT 'A_T' || (o_custkey % 400) || CASE WHEN o_orderkey % 3 > 0 THEN '_0' || (o_orderkey % 5) ELSE '' END AS text FROM orders),
m AS (SELECT coalesce(a.stem, b.stem) AS stem, text FROM t LEFT JOIN p a ON a.stem = text LEFT JOIN p b ON b.stem = regexp_replace(text, '_\\d+$', ''))
SELECT p.stem, count(text) AS prepared, count(*) FILTER (regexp_matches(text, '[1357]$')) AS summarised FROM p LEFT JOIN m USING (stem) GROUP BY p.stem
"""


def paginate(spark, sf_dir):
    rows = table(spark, sf_dir, "part").filter(B.name_contains(F.col("p_name"), "A") & B.fits_length(F.col("p_size"), "books", 10))
    return B.page_of(rows.select("p_partkey", "p_name", "p_size"), [F.coalesce("p_size", F.lit(-1)).desc(), F.col("p_partkey")], 3)


PAGINATE = "SELECT p_partkey, p_name, p_size FROM part WHERE contains(lower(p_name), 'a') AND p_size > 10 ORDER BY p_size DESC, p_partkey LIMIT 100 OFFSET {0}"


def provenance_chain(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 7 > 0, F.floor(F.col("o_orderkey") / 2)).alias("from"))
    return B.origins(steps, "from")


PROVENANCE = """
WITH RECURSIVE s AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey // 2 END AS up FROM orders),
w AS (SELECT key, key AS cur, 0 AS d FROM s UNION ALL SELECT w.key, s.up, d + 1 FROM w JOIN s ON s.key = w.cur WHERE s.up IS NOT NULL AND d < 40)
SELECT key, arg_max(cur, d) AS origin FROM w GROUP BY key
"""


def doi_extract(spark, sf_dir):
    text = F.concat(F.lit("See 10.1234/"), F.col("url"), F.lit("). and doi:10.55555/ABC.1; 10.12/no 10.1234/abc.1, 10.55555/abc.1"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(X.own_dois(text), " ").alias("dois"))


DOI = """
WITH t AS (SELECT page_id, list_transform(regexp_extract_all('See 10.1234/' || url || '). and doi:10.55555/ABC.1; 10.12/no 10.1234/abc.1, 10.55555/abc.1', '(?i)\\b10\\.\\d{4,9}/[^\\s"<>]+'),
  lambda d: lower(rtrim(d, '.,;:)]}'''))) AS l FROM pages),
u AS (SELECT page_id, unnest(l) AS d, generate_subscripts(l, 1) AS i FROM t),
f AS (SELECT page_id, d, min(i) AS i FROM u GROUP BY ALL)
SELECT page_id, string_agg(d, ' ' ORDER BY i) AS dois FROM f GROUP BY page_id
"""


def name_words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.name_words(F.col("text")), " ").alias("words"))


WORDS_SQL = "list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) > 2)"


def title_share(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 120).alias("a"), F.substring("text", 60, 120).alias("b"))
    return docs.select("doc_id", F.round(X.title_share(F.col("a"), F.col("b")), 6).alias("share"), F.round(X.same_title(F.col("a"), F.col("b")), 6).alias("both"))


_SHARE = "CASE WHEN len({a}) = 0 THEN 0 ELSE len(list_filter({a}, lambda x: list_contains({b}, x) OR contains(array_to_string({b}, ''), x))) / len({a}) END"
SHARE = f"""
WITH w AS (SELECT doc_id, {WORDS_SQL.format('substr(text, 1, 120)')} AS a, {WORDS_SQL.format('substr(text, 60, 120)')} AS b FROM documents)
SELECT doc_id, round({_SHARE.format(a='a', b='b')}, 6) AS share, round(greatest({_SHARE.format(a='a', b='b')}, {_SHARE.format(a='b', b='a')}), 6) AS both FROM w
"""


def quote_verify(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_replace(F.substring("text", 40, 50), " ", "  ").alias("quote"))
    return rows.select("doc_id", X.verify_quote(F.col("quote"), F.col("text")).alias("found"))


QUOTE = """
WITH q AS (SELECT doc_id, text, replace(substr(text, 40, 50), ' ', '  ') AS q FROM documents)
SELECT doc_id, contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(q, '\\s+', ' ', 'g')))) AS found FROM q
"""


def record_link(spark, sf_dir):
    """Names cut from documents' openings against the openings themselves."""
    docs = table(spark, sf_dir, "documents").filter("text <> ''")
    opening = F.substring("text", 1, 100)
    works = docs.filter("doc_id % 20 = 0").select(F.concat(F.get(X.name_words(F.col("text")), F.lit(0)), F.lit("_"), F.substring("text", 1, 80)).alias("work"))
    records = docs.select(F.col("doc_id").alias("pos"), opening.alias("title"), F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("doi"), F.array(F.get(X.name_words(F.col("text")), F.lit(0))).alias("authors"))
    return C.linked(works.distinct(), records)


LINK = f"""
WITH d AS (SELECT * FROM documents WHERE text <> ''),
w AS (SELECT DISTINCT {WORDS_SQL.format('text')}[1] || '_' || substr(text, 1, 80) AS work FROM d WHERE doc_id % 20 = 0),
ww AS (SELECT work, {WORDS_SQL.format("substr(work, strpos(work, '_') + 1)")} AS a, {WORDS_SQL.format("string_split(work, '_')[1]")}[1] AS author FROM w),
r AS (SELECT doc_id, {WORDS_SQL.format('substr(text, 1, 100)')} AS b, lower({WORDS_SQL.format('text')}[1]) AS names FROM d)
SELECT work, '10.1/' || min(doc_id) AS doi FROM ww, r WHERE {_SHARE.format(a='a', b='b')} >= 0.7 AND (author IS NULL OR contains(names, author)) GROUP BY work
"""


def percentile_anchors(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.round(F.expr("percentile(o_totalprice, 0.66)"), 6).alias("p66"), F.round(F.expr("percentile(o_totalprice, 0.5)"), 6).alias("p50")
    )


PERCENTILES = "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.66), 6) AS p66, round(quantile_cont(o_totalprice, 0.5), 6) AS p50 FROM orders GROUP BY 1"


def names_and_numbers(spark, sf_dir):
    """Stems, chapters, works and coercions over made-up names."""
    n = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Smith, J_"), F.translate("p_name", " ", "_"), F.lit("_"), (F.col("p_partkey") % 1000).cast("string")).alias("s"))
    s, key = F.col("s"), X.split_chapter(F.col("s"))
    return n.select(
        "p_partkey", key["stem"].alias("stem"), key["chapter"].alias("chapter"), X.work_of(s).alias("work"), X.book_of(s).alias("book"), X.authors_of(s).alias("authors"),
        X.slug(s).alias("slug"), X.label(F.concat(s, s)).alias("label"), X.try_int(F.when(F.col("p_partkey") % 2 == 0, F.lit(" 7 ")).otherwise("1.5")).alias("number"), X.header_key(s).alias("header"),
    )


NAMES = """
WITH n AS (SELECT p_partkey, 'Smith, J_' || replace(p_name, ' ', '_') || '_' || (p_partkey % 1000) AS s FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(s, '^.+_\\d{2,3}$') THEN regexp_replace(s, '_\\d{2,3}$', '') ELSE s END AS stem, nullif(regexp_extract(s, '^.+_(\\d{2,3})$', 1), '') AS chapter,
  CASE WHEN regexp_matches(s, '^.*_.*_\\d+$') THEN regexp_replace(s, '_\\d+$', '') ELSE s END AS work, CASE WHEN regexp_matches(s, '^.+_\\d{2,3}$') THEN regexp_replace(s, '_\\d{2,3}$', '') ELSE '' END AS book,
  'Smith, J' AS authors, substr(trim(regexp_replace(lower(s), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40) AS slug, CASE WHEN length(s || s) > 60 THEN substr(s || s, 1, 57) || '...' ELSE s || s END AS label,
  CASE WHEN p_partkey % 2 = 0 THEN 7 END AS number, regexp_replace(lower(s), '[^a-z]', '', 'g') AS header FROM n
"""


def page_numbers(spark, sf_dir):
    roman = F.get(F.array(*map(F.lit, ["xiv", "l2", "L", "12.", "(7)", "IX", "B4", "word"])), F.pmod(F.col("o_orderkey"), F.lit(8)).cast("int"))
    token = F.when(F.col("o_orderkey") % 9 == 0, F.col("o_custkey").cast("string")).otherwise(roman)
    found = X.page_number(token)
    return table(spark, sf_dir, "orders").select("o_orderkey", found["no"].alias("no"), found["roman"].alias("roman"))


PAGES = """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN o_custkey::VARCHAR END AS d, o_orderkey % 8 AS r FROM orders)
SELECT o_orderkey, CASE WHEN d IS NOT NULL THEN CASE WHEN length(d) <= 4 THEN d::INT END ELSE [14, 12, 50, NULL, 7, 9, 84, NULL][r + 1] END AS no,
  CASE WHEN d IS NOT NULL THEN CASE WHEN length(d) <= 4 THEN false END ELSE [true, false, true, NULL, false, true, false, NULL][r + 1] END AS roman FROM t
"""

QUERIES = {
    "upsert_last_wins": (upsert_last_wins, "SELECT o_custkey AS base, max(o_orderkey) AS pos, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1"),
    "insert_ignore_first": (insert_ignore_first, IGNORE),
    "snapshot_diff": (snapshot_diff, DIFF),
    "index_counts": (index_counts, COUNTS),
    "index_upsert": (index_upsert, UPSERT),
    "merged_scan": (merged_scan, MERGED),
    "list_summaries": (list_summaries, LISTS),
    "list_members": (list_members, "SELECT c_custkey AS id, c_mktsegment AS stem, c_acctbal AS added_at FROM customer WHERE c_nationkey = 3"),
    "list_memberships": (list_memberships, MEMBERS),
    "export_stems": (export_stems, "SELECT DISTINCT c_mktsegment AS stem FROM customer WHERE c_nationkey = 3"),
    "list_edits": (list_edits, EDITS),
    "progress_join": (progress_join, PROGRESS),
    "paginate": (paginate, "SELECT * FROM (" + PAGINATE.format("least(200, 100 * greatest(0, (SELECT ceil(count(*) / 100) - 1 FROM part WHERE contains(lower(p_name), 'a') AND p_size > 10))::BIGINT)") + ")"),
    "provenance_chain": (provenance_chain, PROVENANCE),
    "doi_extract": (doi_extract, DOI),
    "name_words": (name_words, f"SELECT item_id, array_to_string({WORDS_SQL.format('text')}, ' ') AS words FROM benchmark"),
    "title_share": (title_share, SHARE),
    "quote_verify": (quote_verify, QUOTE),
    "record_link": (record_link, LINK),
    "percentile_anchors": (percentile_anchors, PERCENTILES),
    "names_and_numbers": (names_and_numbers, NAMES),
    "page_numbers": (page_numbers, PAGES),
}
