"""Registered queries over pages, chapters and themes; a source stands for a book and its documents for pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import folds
from ..operators import lexical as L
from ..operators import pages as P
from ..operators import themes as K
from ..operators import vector as V
from ..runtime import table
from .lexical import tokens

LINES = """l0 AS (SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
l AS (SELECT *, regexp_replace(lower(text), '[^a-z]', '', 'g') AS k0 FROM l0),
k AS (SELECT *, CASE WHEN length(k0) >= 5 THEN k0 END AS key, row_number() OVER (PARTITION BY doc, page ORDER BY line) AS a, row_number() OVER (PARTITION BY doc, page ORDER BY line DESC) AS b FROM l)"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text"))


def running_headers(spark, sf_dir):
    """Every third page opens with its book's name."""
    opened = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Book of "), "source", F.lit("\n"), "text")).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").withColumn("text", opened)
    return P.running_headers(docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text")), 2)


HEADERS_CTE = f"""{LINES},
c AS (SELECT doc, key, sum((a <= {{0}})::INT + (b <= {{0}})::INT) AS n FROM k WHERE key IS NOT NULL GROUP BY ALL),
p AS (SELECT doc, count(DISTINCT page) AS pages FROM k GROUP BY doc),
h AS (SELECT doc, key FROM c JOIN p USING (doc) WHERE pages >= 4 AND n >= greatest(3, floor(pages * 0.3)))"""
HEADERS = f"WITH {HEADERS_CTE.format(2)} SELECT * FROM h".replace(
    "FROM documents)", "FROM (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Book of ' || source || chr(10) || text ELSE text END AS text FROM documents))")


def header_candidates(spark, sf_dir):
    """The counts behind the running headers, with few pages a book so that some pass."""
    few = _lines(spark, sf_dir).withColumn("doc", F.floor(F.col("page") / 5).cast("string"))
    return P.without_headers(few, 3).groupBy("doc").agg(F.count(F.lit(1)).alias("kept"))


CANDIDATES = "WITH " + HEADERS_CTE.format(3).replace("source AS doc", "(doc_id // 5)::VARCHAR AS doc") + """
SELECT doc, count(*) AS kept FROM k JOIN p USING (doc) LEFT JOIN (SELECT doc, key, true AS gone FROM h) USING (doc, key)
WHERE gone IS NULL AND (pages < 4 OR NOT regexp_matches(text, '(?i)^\\s*(?:\\d{1,4}|[ivxlcdm]{1,6})\\s*$')) GROUP BY doc"""


def reference_cut(spark, sf_dir):
    made = F.concat(F.col("text"), F.lit("\n# References\nA. Author (1999)\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(folds.strip_references(made)).alias("kept"), F.length(folds.strip_references(F.col("text"))).alias("same"))


REFERENCE = """SELECT doc_id, CASE WHEN length(text) + 1 >= (length(text) + 31) * 0.5 THEN length(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) ELSE length(text) + 31 END::INT AS kept,
  length(text)::INT AS same FROM documents"""


def file_verdicts(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 7).cast("string").alias("stem"), F.col("doc_id").alias("idx"), "text")
    return P.grade(P.file_features(files)).select("stem", "idx", "chars", "paras", F.round("ref_score", 6).alias("ref_score"), F.round("share", 6).alias("share"), F.round("typical", 6).alias("typical"), "verdict")


VERDICTS = """
WITH f AS (SELECT (doc_id // 7)::VARCHAR AS stem, doc_id AS idx, text, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t,
  list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '' AND NOT starts_with(x, '#')) AS body FROM documents),
x AS (SELECT stem, idx, length(t) AS chars, (CASE WHEN t = '' OR starts_with(ltrim(text), '#') THEN 0 ELSE 1 END)::INT AS paras,
  CASE WHEN len(body) > 0 THEN len(list_filter(body, lambda b: regexp_matches(b, '^\\s*#*\\s*\\(?\\d{1,3}[.)]\\s+\\S') OR regexp_matches(b, '(?i)\\(\\s*(?:19|20)\\d{2}[a-z]?\\s*\\)|,\\s*(?:19|20)\\d{2}\\b|\\bpp?\\.\\s*\\d|\\bvol\\.\\s*\\d'))) / len(body) ELSE 0 END AS ref FROM f),
y AS (SELECT *, chars / greatest(sum(chars) OVER b, 1) AS share, coalesce(median(CASE WHEN chars >= 1200 THEN chars END) OVER b, max(chars) OVER b) AS typical, count(*) OVER b = 1 AS lone FROM x WINDOW b AS (PARTITION BY stem))
SELECT stem, idx, chars::INT AS chars, paras, round(ref, 6) AS ref_score, round(share, 6) AS share, round(typical, 6) AS typical,
  CASE WHEN chars < 250 THEN 'reject:empty' WHEN ref >= 0.55 AND share < 0.25 THEN 'reject:reference-block' WHEN chars < greatest(1200, 0.15 * typical) AND paras < 3 THEN 'reject:too-short'
    WHEN (lone AND chars >= 150000) OR (NOT lone AND share >= 0.7) THEN 'flag:oversized' ELSE 'keep' END AS verdict FROM y
"""


def verdict_counts(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 7).cast("string").alias("stem"), F.col("doc_id").alias("idx"), "text")
    return P.grade_counts(P.grade(P.file_features(files)))


VERDICT_COUNTS = f"""SELECT stem, count(*) FILTER (starts_with(verdict, 'keep')) AS kept, count(*) FILTER (starts_with(verdict, 'flag')) AS flagged,
  count(*) FILTER (starts_with(verdict, 'reject')) AS rejected FROM ({VERDICTS}) GROUP BY stem"""


def page_routes(spark, sf_dir):
    books = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("doc")).agg(F.count(F.lit(1)).alias("pages"), F.avg(F.when(F.length("text") >= 400, 1.0).otherwise(0.0)).alias("f"))
    n = F.col("pages").cast("int")
    return books.select("doc", P.route(F.col("pages"), F.col("f")).alias("route"), F.size(P.sample_indices(n)).alias("sampled"), F.element_at(P.sample_indices(n), -1).alias("last"))


ROUTES = """SELECT source AS doc, CASE WHEN avg(CASE WHEN length(text) >= 400 THEN 1.0 ELSE 0 END) < 0.1 THEN 'ocr' WHEN count(*) > 100 THEN 'book' ELSE 'straight' END AS route,
  least(24, count(*))::INT AS sampled, (count(*) - 1)::INT AS last FROM documents GROUP BY source"""


def nearest_snap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    bounds = orders.select((F.col("o_custkey") % 20).alias("doc"), F.col("o_orderkey").alias("bound"))
    targets = orders.select((F.col("o_custkey") % 20).alias("doc"), (F.col("o_orderkey") * 3 + 1).alias("target"))
    return P.nearest_snap(bounds.distinct(), targets.distinct(), 400)


SNAP = """
WITH b AS (SELECT DISTINCT o_custkey % 20 AS doc, o_orderkey AS bound FROM orders),
t AS (SELECT DISTINCT o_custkey % 20 AS doc, o_orderkey * 3 + 1 AS target FROM orders),
m AS (SELECT b.doc, bound, target, abs(bound - target) AS gap FROM b JOIN t ON b.doc = t.doc AND abs(bound - target) <= 400),
n AS (SELECT *, gap = least0 AS own FROM (SELECT *, min(gap) OVER (PARTITION BY doc, target) AS least0 FROM m) QUALIFY row_number() OVER (PARTITION BY doc, bound ORDER BY gap, target) = 1)
SELECT b.doc, b.bound, CASE WHEN n.own AND b.bound <> 0 THEN n.target ELSE b.bound END AS snapped FROM b LEFT JOIN n ON b.doc = n.doc AND b.bound = n.bound
"""


def seams(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l")).filter("size(l) > 1")
    return lines.select("doc_id", P.seam_broken(F.element_at("l", 1), F.element_at("l", 2)).alias("broken"), folds.continues(F.element_at("l", 1), F.element_at("l", 2)).alias("continues"))


SEAMS = """
WITH l AS (SELECT doc_id, trim(string_split(text, chr(10))[1], ' ' || chr(9) || chr(13)) AS a, trim(string_split(text, chr(10))[2], ' ' || chr(9) || chr(13)) AS b FROM documents WHERE contains(text, chr(10)))
SELECT doc_id, a <> '' AND b <> '' AND NOT starts_with(a, '#') AND NOT starts_with(b, '#') AND NOT regexp_matches(a, '[.!?:;"''”’)\\]…*\\d]$') AND regexp_matches(regexp_extract(b, '\\p{L}'), '^\\p{Ll}') AS broken,
  a <> '' AND b <> '' AND NOT regexp_matches(a, '[.?!:’‘”“)"'']$') AND regexp_matches(b, '^[\\p{Ll}\\p{Nd}("]') AS continues FROM l
"""


def ocr_elements(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(0).alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return P.ocr_elements(lines).groupBy("doc", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def char_offsets(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return P.char_offsets(lines).select("doc", "line", "offset")


OFFSETS = """
WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS t, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line FROM documents)
SELECT doc, line, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM l
"""


def apparatus(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("the", "of", "and", "to", "in", "de", "la")])
    units = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(0).alias("unit"), F.split("text", "\n").alias("lines"))
    return P.apparatus(units, words).select("doc", F.round("stop_ratio", 6).alias("stop_ratio"), F.round("digit_density", 6).alias("digit_density"), F.round("short_share", 6).alias("short_share"), "prose_lines", "apparatus")


APPARATUS = """
WITH b AS (SELECT doc_id AS doc, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS b FROM documents),
t AS (SELECT *, array_to_string(b, chr(10)) AS s FROM b),
f AS (SELECT doc, len(b) AS n, regexp_extract_all(lower(s), '\\p{L}+') AS toks, length(regexp_replace(s, '[^\\p{L}\\p{N}]', '', 'g')) AS alnum, length(regexp_replace(s, '[^\\p{Nd}]', '', 'g')) AS digits,
  len(list_filter(b, lambda x: length(x) < 45)) AS short, len(list_filter(b, lambda x: length(x) >= 150)) AS prose,
  len(list_filter(b, lambda x: length(regexp_replace(x, '[^\\p{Lu}]', '', 'g')) >= 0.7 * greatest(1, length(regexp_replace(x, '[^\\p{L}]', '', 'g'))))) AS caps FROM t),
g AS (SELECT *, CASE WHEN len(toks) > 0 THEN len(list_filter(toks, lambda w: w IN ('the', 'of', 'and', 'to', 'in', 'de', 'la'))) / len(toks) ELSE 0 END AS stop FROM f)
SELECT doc, round(stop, 6) AS stop_ratio, round(CASE WHEN alnum > 0 THEN digits / alnum ELSE 0 END, 6) AS digit_density, round(CASE WHEN n > 0 THEN short / n ELSE 0 END, 6) AS short_share, prose::INT AS prose_lines,
  n >= 20 AND prose < 5 AND (stop < 0.18)::INT + (CASE WHEN alnum > 0 THEN digits / alnum ELSE 0 END >= 0.06)::INT + (short / greatest(n, 1) >= 0.7)::INT + (caps / greatest(n, 1) >= 0.3)::INT >= 2 AS apparatus FROM g
"""


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    item = F.col("vec_id").alias("item")
    sign = F.expr("aggregate(slice(embedding, 1, 3), 0, (a, x) -> 2 * a + cast(x > 0 as int))")
    runs = e.select(item, F.lit(0).alias("run"), F.col("label").cast("int").alias("label"))
    runs = runs.unionByName(e.select(item, F.lit(1).alias("run"), sign.alias("label"))).unionByName(e.select(item, F.lit(2).alias("run"), (F.col("vec_id") % 11 - 1).cast("int").alias("label")))
    return runs, e.select(item, F.col("label").cast("int").alias("cluster"))


RUNS = """r AS (SELECT vec_id AS item, 0 AS run, label::INT AS label FROM embeddings
  UNION ALL SELECT vec_id, 1, 4 * (embedding[1] > 0)::INT + 2 * (embedding[2] > 0)::INT + (embedding[3] > 0)::INT FROM embeddings UNION ALL SELECT vec_id, 2, (vec_id % 11 - 1)::INT FROM embeddings),
f AS (SELECT vec_id AS item, label::INT AS cluster FROM embeddings),
pairs AS (SELECT a.item, b.item AS other, CASE WHEN a.item = b.item THEN 1.0 ELSE count(*) FILTER (a.label = b.label AND a.label >= 0) / 3.0 END AS co
  FROM r a JOIN r b ON a.run = b.run GROUP BY a.item, b.item),
prof AS (SELECT p.item, f.cluster, avg(co) AS profile FROM pairs p JOIN f ON f.item = p.other GROUP BY ALL)"""


def soft_assign(spark, sf_dir):
    return K.assign(K.profiles(*_runs(spark, sf_dir)))


ASSIGN = f"""
WITH {RUNS}, q AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(profile, 9) DESC, cluster) AS r FROM prof),
t AS (SELECT item, max(cluster) FILTER (r = 1) AS c1, max(profile) FILTER (r = 1) AS p1, max(cluster) FILTER (r = 2) AS c2, max(profile) FILTER (r = 2) AS p2 FROM q GROUP BY item)
SELECT item, CASE WHEN round(p1, 9) >= 0.15 THEN c1 END AS main, CASE WHEN round(p1, 9) >= 0.15 AND round(p2, 9) >= 0.15 AND round(p2, 9) >= round(0.8 * p1, 9) THEN c2 END AS second FROM t
"""


def cluster_strength(spark, sf_dir):
    return K.strength(*_runs(spark, sf_dir)).select("item", F.round("strength", 6).alias("strength"))


STRENGTH = f"""WITH {RUNS} SELECT p.item, round(avg(co), 6) AS strength FROM pairs p JOIN f a ON a.item = p.item JOIN f b ON b.item = p.other WHERE a.cluster = b.cluster AND p.item <> p.other GROUP BY p.item"""


def coassociation(spark, sf_dir):
    runs, final = _runs(spark, sf_dir)
    return K.coassociation(runs, final.filter("item % 20 = 0")).select("item", "other", F.round("share", 6).alias("share"))


COASSOCIATION = f"WITH {RUNS} SELECT item, other, round(co, 6) AS share FROM pairs WHERE item % 20 = 0 AND item <> other AND co > 0"


def silhouette_squared(spark, sf_dir):
    return K.silhouette(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("vec_id", F.round("silhouette", 6).alias("silhouette"))


SILHOUETTE = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.vec_id, a.label AS mine, b.label, sum(list_dot_product(a.e, a.e) - 2 * list_dot_product(a.e, b.e) + list_dot_product(b.e, b.e)) AS s, count(*) AS n FROM v a, v b GROUP BY ALL),
m AS (SELECT vec_id, max(s / greatest(n - 1, 1)) FILTER (label = mine) AS a, min(s / n) FILTER (label <> mine) AS b, max(n) FILTER (label = mine) AS n FROM d GROUP BY vec_id)
SELECT vec_id, round(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM m
"""


def thread_jaccard(spark, sf_dir):
    terms = L.top(L.postings(table(spark, sf_dir, "documents"), "source", X.search_tokens(F.col("text"))), ["doc"], [F.col("tf").desc(), F.col("term")], 12)
    return K.term_overlap(terms.withColumnRenamed("doc", "class")).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


JACCARD = f"""
WITH p AS (SELECT source, term, count(*) AS tf FROM (SELECT source, unnest({tokens()}) AS term FROM documents) GROUP BY ALL),
t AS (SELECT source, term FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY tf DESC, term) <= 12),
n AS (SELECT source, count(*) AS n FROM t GROUP BY 1)
SELECT a.source AS a, b.source AS b, round(count(*) / (max(x.n) + max(y.n) - count(*)), 6) AS jaccard
FROM t a JOIN t b ON a.term = b.term AND a.source < b.source JOIN n x ON x.source = a.source JOIN n y ON y.source = b.source GROUP BY ALL
"""


def theme_overlap(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("thread"), (F.col("l_partkey") % 700).alias("base"))
    return K.theme_neighbours(members)


OVERLAP = """
WITH m AS (SELECT DISTINCT l_suppkey % 40 AS thread, l_partkey % 700 AS base FROM lineitem)
SELECT a.thread, b.thread AS other, count(*) AS shared FROM m a JOIN m b ON a.base = b.base AND a.thread <> b.thread GROUP BY ALL
"""


def merged_threads(spark, sf_dir):
    """Classes of documents by source, with the vectors of the ids as their centroids."""
    vectors = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id")
    means = V.centroids(vectors, "lang").withColumnRenamed("lang", "class")
    posted = L.postings(table(spark, sf_dir, "documents"), "lang", X.search_tokens(F.col("text"))).withColumnRenamed("doc", "class")
    return K.merged_threads(means, L.ctfidf(posted, 12))


def kmeans_sweep(spark, sf_dir):
    k, score, model = K.kmeans_sweep(table(spark, sf_dir, "embeddings"))
    return spark.createDataFrame([(k, float(score))], "k int, silhouette double")


def connected_works(spark, sf_dir):
    from ..operators.components import connected_components

    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst"))
    return connected_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "running_headers": (running_headers, HEADERS),
    "header_candidates": (header_candidates, CANDIDATES),
    "reference_cut": (reference_cut, REFERENCE),
    "file_verdicts": (file_verdicts, VERDICTS),
    "verdict_counts": (verdict_counts, VERDICT_COUNTS),
    "page_routes": (page_routes, ROUTES),
    "nearest_snap": (nearest_snap, SNAP),
    "seams": (seams, SEAMS),
    "ocr_elements": (ocr_elements, None),
    "char_offsets": (char_offsets, OFFSETS),
    "apparatus": (apparatus, APPARATUS),
    "soft_assign": (soft_assign, ASSIGN),
    "cluster_strength": (cluster_strength, STRENGTH),
    "coassociation": (coassociation, COASSOCIATION),
    "silhouette_squared": (silhouette_squared, SILHOUETTE),
    "thread_jaccard": (thread_jaccard, JACCARD),
    "theme_overlap": (theme_overlap, OVERLAP),
    "merged_threads": (merged_threads, None),
    "kmeans_sweep": (kmeans_sweep, None),
    "connected_works": (connected_works, None),
}
