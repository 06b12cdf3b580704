"""Registered queries over vectors and citation graphs; line items stand for citations, orders for works."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import citations as C
from ..operators import lexical as L
from ..operators import vector as V
from ..runtime import table
from .lexical import TERMS, okapi_sql, tokens

COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})) + 1e-9)"
VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def knn_related(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return V.search(rows, rows.filter("vec_id % 20 = 0"), V.RELATED_TOP_K).select("query", "other", F.round("score", 6).alias("score"), "rank")


KNN = f"""
WITH {VECTORS}, s AS (SELECT a.vec_id AS query, b.vec_id AS other, {COS.format('a.e', 'b.e')} AS score FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query, other, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, other)::INT AS rank
FROM s QUALIFY rank <= 10
"""


def retrieve_cosine(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").filter("label < 5")
    asked = table(spark, sf_dir, "embeddings").filter("vec_id = 7")
    return V.search(rows, asked, V.RETRIEVE_TOP_K, skip_self=False).select("other", F.round("score", 6).alias("score"), "rank")


RETRIEVE = f"""
WITH {VECTORS}
SELECT b.vec_id AS other, round({COS.format('a.e', 'b.e')}, 6) AS score,
       row_number() OVER (ORDER BY round({COS.format('a.e', 'b.e')}, 9) DESC, b.vec_id)::INT AS rank
FROM v a, v b WHERE a.vec_id = 7 AND b.label < 5 QUALIFY rank <= 8
"""


def label_centroids(spark, sf_dir):
    means = V.centroids(table(spark, sf_dir, "embeddings"), "label")
    return means.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("mean"))


CENTROIDS_CTE = f"""
{VECTORS}, x AS (SELECT label, unnest(range(len(e)))::INT AS i, unnest(e) / (sqrt(list_dot_product(e, e)) + 1e-9) AS x FROM v),
m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL)"""
CENTROIDS = f"WITH {CENTROIDS_CTE} SELECT label, i, round(m, 6) AS mean FROM m"


def centroid_central(spark, sf_dir):
    return V.most_central(table(spark, sf_dir, "embeddings"), "label").select("label", "vec_id", F.round("score", 6).alias("score"), "rank")


CENTRAL = f"""
WITH {CENTROIDS_CTE}, c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label)
SELECT label, vec_id, round({COS.format('e', 'c')}, 6) AS score,
       row_number() OVER (PARTITION BY label ORDER BY round({COS.format('e', 'c')}, 9) DESC, vec_id)::INT AS rank
FROM v JOIN c USING (label) QUALIFY rank <= 20
"""


def hybrid_rrf(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").join(vectors.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    asked = vectors.filter("vec_id = 7")
    known = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    lexical = L.okapi(docs, "doc_id", X.search_tokens(F.col("text")), TERMS)
    found = V.hybrid(known, asked.first()["embedding"], lexical)
    return found.select(F.col("doc").alias("doc_id"), F.round("rrf", 6).alias("rrf"), F.round("score", 6).alias("score"))


HYBRID = f"""
WITH {VECTORS}, d AS (SELECT doc_id, {tokens()} AS toks FROM documents WHERE doc_id IN (SELECT vec_id FROM v)), {okapi_sql('d', TERMS, 'doc_id')},
s AS (SELECT b.vec_id AS doc_id, {COS.format('a.e', 'b.e')} AS score FROM v a, v b JOIN d ON b.vec_id = d.doc_id WHERE a.vec_id = 7),
dense AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
lex AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)
SELECT doc_id, round(1.0 / (60 + dense.rank) + 1.0 / (60 + lex.rank), 6) AS rrf, round(dense.score, 6) AS score
FROM dense JOIN lex USING (doc_id) ORDER BY round(1.0 / (60 + dense.rank) + 1.0 / (60 + lex.rank), 12) DESC, dense.rank LIMIT 8
"""


def piece_mean(spark, sf_dir):
    """Mean of the pieces' unit vectors against all rows; the vectors of one label stand for a document's pieces."""
    rows = table(spark, sf_dir, "embeddings")
    asked = V.centroids(rows.filter("vec_id < 5").withColumn("one", F.lit(-1)), "one").select(F.col("one").cast("long").alias("vec_id"), F.col("centroid").alias("embedding"))
    return V.search(rows.withColumn("embedding", F.col("embedding").cast("array<double>")), asked, 20).select("other", F.round("score", 3).alias("score"), "rank")


PIECE_MEAN = f"""
WITH {VECTORS}, x AS (SELECT unnest(range(len(e))) AS i, unnest(e) / (sqrt(list_dot_product(e, e)) + 1e-9) AS x FROM v WHERE vec_id < 5),
c AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM x GROUP BY i))
SELECT vec_id AS other, round({COS.format('e', 'c')}, 3) AS score, row_number() OVER (ORDER BY round({COS.format('e', 'c')}, 9) DESC, vec_id)::INT AS rank
FROM v, c QUALIFY rank <= 20
"""


def _citations(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("citing_base"), F.col("l_partkey").alias("cited_ext_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("10.1/"), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"))).alias("cited_doi"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey")).alias("cited_base"),
    )


CITATIONS = """c AS (SELECT row_number() OVER () AS id, l_orderkey AS citing_base, l_partkey AS cited_ext_id,
  CASE WHEN l_linenumber % 2 = 0 THEN '10.1/' || l_suppkey || '-' || l_partkey END AS cited_doi, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS cited_base FROM lineitem)"""


def _works(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("base"), F.when(F.col("p_size") > 10, F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string"))).alias("doi"),
        F.col("p_partkey").alias("ext_id"), (F.col("p_size") + 1970).alias("year"), F.col("p_retailprice").cast("int").alias("cited_by_count"),
        (F.col("p_size") / 50).alias("match_confidence"),
    )


WORKS = """w AS (SELECT p_partkey AS base, CASE WHEN p_size > 10 THEN '10.1/' || p_partkey END AS doi, p_partkey AS ext_id, p_size + 1970 AS year,
  round_even(trunc(p_retailprice), 0)::INT AS cited_by_count, p_size / 50 AS match_confidence FROM part)"""


def coupling(spark, sf_dir):
    return C.coupling(_citations(spark, sf_dir))


COUPLING = f"""
WITH {CITATIONS}, pairs AS (
  SELECT a.id AS i, b.id AS j, a.citing_base AS base_a, b.citing_base AS base_b FROM c a JOIN c b ON a.cited_ext_id = b.cited_ext_id AND a.citing_base < b.citing_base
  UNION SELECT a.id, b.id, a.citing_base, b.citing_base FROM c a JOIN c b ON a.cited_doi = b.cited_doi AND a.citing_base < b.citing_base)
SELECT base_a, base_b, count(*) AS shared FROM pairs GROUP BY ALL HAVING count(*) >= 2
"""


def cocitation(spark, sf_dir):
    return C.cocitation(_citations(spark, sf_dir))


COCITATION = f"""
WITH {CITATIONS} SELECT a.cited_ext_id AS cited_a, b.cited_ext_id AS cited_b, count(DISTINCT a.citing_base) AS count
FROM c a JOIN c b ON a.citing_base = b.citing_base AND a.cited_ext_id < b.cited_ext_id GROUP BY ALL HAVING count(DISTINCT a.citing_base) >= 2
"""


def authority(spark, sf_dir):
    return C.authority(_works(spark, sf_dir), _citations(spark, sf_dir))


AUTHORITY = f"""
WITH {CITATIONS}, {WORKS}, d AS (SELECT cited_base, count(*) AS n FROM c WHERE cited_base IS NOT NULL GROUP BY 1)
SELECT base, coalesce(cited_by_count, 0) AS cited_by_count, coalesce(n, 0) AS in_degree FROM w LEFT JOIN d ON base = cited_base WHERE match_confidence >= 0.7
"""


def work_signals(spark, sf_dir):
    return C.work_signals(_works(spark, sf_dir))


SIGNALS = f"WITH {WORKS} SELECT base, year, coalesce(cited_by_count, 0) AS cited_by_count FROM w WHERE match_confidence >= 0.7"


def graph_stats(spark, sf_dir):
    return C.stats(_works(spark, sf_dir), _citations(spark, sf_dir))


STATS = f"""
WITH {CITATIONS}, {WORKS}
SELECT (SELECT count(*) FROM w) AS works, (SELECT count(doi) FROM w) AS with_doi, (SELECT count(*) FROM c) AS citations,
  (SELECT count(cited_base) FROM c) AS internal_edges, (SELECT count(DISTINCT citing_base) FROM c WHERE cited_base IS NOT NULL) AS corpus_works_with_refs
"""


def resolve_edges(spark, sf_dir):
    works = _works(spark, sf_dir).filter("base % 2 = 0")
    return C.resolve(_citations(spark, sf_dir), works).groupBy("cited_base").agg(F.count(F.lit(1)).alias("n"))


RESOLVE = f"""
WITH {CITATIONS}, {WORKS}, e AS (SELECT * FROM w WHERE base % 2 = 0),
r AS (SELECT coalesce(c.cited_base, (SELECT min(base) FROM e WHERE e.ext_id = c.cited_ext_id OR e.doi = c.cited_doi)) AS cited_base FROM c)
SELECT cited_base, count(*) AS n FROM r GROUP BY 1
"""


def _edges(spark, sf_dir):
    """Suppliers' and parts' ids stand for works that cite each other."""
    works = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("base"))
    cites = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("citing_base"), (F.col("l_partkey") % 500).alias("cited_base"))
    return works, C.citation_graph(works, cites)


EDGES = """g AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 500 AS dst FROM lineitem
  WHERE l_suppkey IN (SELECT p_partkey FROM part) AND l_partkey % 500 IN (SELECT p_partkey FROM part))"""


def citation_edges(spark, sf_dir):
    return _edges(spark, sf_dir)[1]


def pagerank_10(spark, sf_dir):
    works, edges = _edges(spark, sf_dir)
    return C.pagerank(works, edges, 10).select("node", F.round("rank", 9).alias("rank"))


PAGERANK = f"""
WITH RECURSIVE {EDGES}, n AS MATERIALIZED (SELECT p_partkey AS node, (SELECT count(*) FROM part) AS n FROM part),
o AS MATERIALIZED (SELECT src, count(*) AS out FROM g GROUP BY src),
l AS MATERIALIZED (SELECT g.src, g.dst, out FROM g JOIN o USING (src)),
r AS (
  SELECT 0 AS i, node, 1.0::DOUBLE / n AS rank FROM n
  UNION ALL
  (WITH cur AS (SELECT * FROM r WHERE i < 10),
        s AS (SELECT l.dst, sum(rank / out) AS got FROM l JOIN cur ON cur.node = l.src GROUP BY l.dst),
        z AS (SELECT coalesce(sum(rank), 0) AS lost FROM cur WHERE node NOT IN (SELECT src FROM o))
   SELECT cur.i + 1, cur.node, 0.15 / n.n + 0.85 * (coalesce(s.got, 0) + z.lost / n.n)
   FROM cur JOIN n USING (node) LEFT JOIN s ON s.dst = cur.node, z))
SELECT node, round(rank, 9) AS rank FROM r WHERE i = 10
"""


def ranked_works(spark, sf_dir):
    return C.ranked(_works(spark, sf_dir), "cited_by_count", "base").select("base", "cited_by_count")


RANKED = f"WITH {WORKS} SELECT base, cited_by_count FROM w WHERE cited_by_count > 0 ORDER BY cited_by_count DESC, base LIMIT 20"


def found_counts(spark, sf_dir):
    return C.found_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


FOUND = "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1"


def debate_pairs(spark, sf_dir):
    works = _works(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("base"), "embedding")
    return C.debates(works, vectors).select("anchor", "newer", F.round("score", 6).alias("score"), "rank")


DEBATES = f"""
WITH {WORKS}, {VECTORS}, k AS (SELECT * FROM w),
p AS (SELECT quantile_cont(cited_by_count, 0.66) AS cites, quantile_cont(year, 0.5) AS split FROM k),
s AS (SELECT a.base AS anchor, b.base AS newer, {COS.format('x.e', 'y.e')} AS score
      FROM k a, k b, p, v x, v y WHERE a.cited_by_count >= cites AND a.year <= split AND b.year > split AND x.vec_id = a.base AND y.vec_id = b.base)
SELECT anchor, newer, round(score, 6) AS score, row_number() OVER (PARTITION BY anchor ORDER BY round(score, 9) DESC, newer)::INT AS rank FROM s QUALIFY rank <= 2
"""

QUERIES = {
    "knn_related": (knn_related, KNN),
    "retrieve_cosine": (retrieve_cosine, RETRIEVE),
    "label_centroids": (label_centroids, CENTROIDS),
    "centroid_central": (centroid_central, CENTRAL),
    "hybrid_rrf": (hybrid_rrf, HYBRID),
    "piece_mean": (piece_mean, PIECE_MEAN),
    "coupling": (coupling, COUPLING),
    "cocitation": (cocitation, COCITATION),
    "authority": (authority, AUTHORITY),
    "work_signals": (work_signals, SIGNALS),
    "graph_stats": (graph_stats, STATS),
    "resolve_edges": (resolve_edges, RESOLVE),
    "citation_edges": (citation_edges, f"WITH {EDGES} SELECT src, dst FROM g"),
    "pagerank_10": (pagerank_10, PAGERANK),
    "ranked_works": (ranked_works, RANKED),
    "found_counts": (found_counts, FOUND),
    "debate_pairs": (debate_pairs, DEBATES),
}
