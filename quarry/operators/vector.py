"""Dense vectors: cosine search, neighbours, centroids and rank fusion.

Queries are taken in blocks of bounded size; each block is one matrix product per Arrow batch, and only the best k of a
batch leave a task. Nothing pairs all rows with all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

# Fixed values.
EPSILON = 1e-9
RETRIEVE_TOP_K, RELATED_TOP_K, CENTRAL_MEMBERS = 8, 10, 20
# End of fixed values.

#: Query vectors that one pass over the rows compares with.
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Dot product over the norms' product plus a trifle."""
    return dot(a, b) / (norm(a) * norm(b) + EPSILON)


def cosine_or_less(a: Column, b: Column) -> Column:
    """-1 when a vector is missing."""
    return F.coalesce(cosine(a, b), F.lit(-1.0))


def search(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", skip_self: bool = True) -> DataFrame:
    """query, other, score, rank: the k rows closest by cosine to each query row, ties by id."""
    spark, total, out = rows.sparkSession, queries.count(), None
    blocks = max(1, -(-total // QUERY_BLOCK))
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == block).select(id_col, vec_col).filter(F.col(vec_col).isNotNull()).collect()
        if not part:
            continue
        ids = np.array([r[0] for r in part])
        matrix = np.array([r[1] for r in part], dtype=np.float64)
        held = spark.sparkContext.broadcast((ids, matrix, np.linalg.norm(matrix, axis=1)))

        def run(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, matrix, length = held.value
            for frame in frames:
                frame = frame[frame[vec_col].notna()]
                if not len(frame):
                    continue
                own = frame[id_col].to_numpy()
                vectors = np.array(frame[vec_col].tolist(), dtype=np.float64)
                score = matrix @ vectors.T / (length[:, None] * np.linalg.norm(vectors, axis=1)[None, :] + EPSILON)
                # one place more than asked for, as the query itself may be among them
                best = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, : k + 1] if len(own) > k + 1 else np.argsort(-score, axis=1)
                # equal scores at the edge are settled by id below, so take all that tie with the last one
                edge = np.take_along_axis(np.round(score, 9), best[:, -1:], axis=1)
                row, col = np.nonzero(np.round(score, 9) >= edge)
                yield pd.DataFrame({"query": ids[row], "other": own[col], "score": score[row, col]})

        found = rows.select(id_col, vec_col).mapInPandas(run, "query long, other long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query long, other long, score double")
    if skip_self:
        out = out.filter("query <> other")
    order = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "other")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def scores(rows: DataFrame, query: list[float], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, score of every row against one vector."""
    return rows.filter(F.col(vec_col).isNotNull()).select(id_col, cosine(F.col(vec_col), F.array(*[F.lit(float(x)) for x in query])).alias("score"))


def global_rank(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with ``rank`` from 1 over the whole table, without one task for all of them.

    A range sort deals the rows out; a checkpoint fixes where they lie; each part ranks its own rows and adds the sizes
    of the parts before it, of which there are as many as partitions.
    """
    placed = cut(rows.orderBy(*order).withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return placed.withColumn("__own", own).join(F.broadcast(starts), "__p").withColumn("rank", F.col("__before") + F.col("__own")).drop("__p", "__own", "__before")


def hybrid(rows: DataFrame, query: list[float], lexical_scores: DataFrame, k: int = RETRIEVE_TOP_K, id_col: str = "vec_id") -> DataFrame:
    """doc, rrf, score (the cosine), dense: the k best by fused ranks, ties in dense order."""
    dense = global_rank(scores(rows, query, id_col).withColumnRenamed(id_col, "doc"), [F.round("score", 9).desc(), F.col("doc")])
    lexical = global_rank(lexical_scores, [F.round("score", 9).desc(), F.col("doc")])
    fused = fuse(dense, lexical).join(dense.select("doc", F.col("rank").alias("dense"), "score"), "doc")
    return fused.orderBy(F.round("rrf", 12).desc(), "dense").limit(k).select("doc", "rrf", "score", "dense")


def centroids(rows: DataFrame, by: str, vec_col: str = "embedding") -> DataFrame:
    """group, centroid: mean of unit vectors, element by element, map-combined."""
    unit = rows.withColumn("__n", norm(F.col(vec_col)) + EPSILON).select(by, "__n", F.posexplode(vec_col).alias("i", "x"))
    mean = unit.groupBy(by, "i").agg(F.avg(F.col("x").cast("double") / F.col("__n")).alias("m"))
    return mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def most_central(rows: DataFrame, by: str, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CENTRAL_MEMBERS) -> DataFrame:
    """group, id, score, rank: members with the largest dot product of unit vector and unit centroid."""
    joined = rows.join(centroids(rows, by, vec_col), by)
    score = cosine(F.col(vec_col), F.col("centroid"))
    ranked = joined.select(by, id_col, score.alias("score"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.round("score", 9).desc(), id_col))).filter(F.col("rank") <= k)


def fuse(*rankings: DataFrame, key: str = "doc", k: int = 60) -> DataFrame:
    """key, rrf over (key, rank) relations; ties go by the first ranking's order."""
    parts = None
    for place, ranking in enumerate(rankings):
        one = ranking.select(key, "rank", F.lit(place).alias("place"))
        parts = one if parts is None else parts.unionByName(one)
    first = F.min(F.struct("place", "rank"))
    return parts.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), first.alias("seen"))


def hashing_embedder(width: int = 64):
    """A pandas function from texts to unit vectors by signed word hashes; stands in where no model is given."""
    import zlib

    def embed(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), width))
        for k, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[k, h % width] += 1.0 if h & 0x80000000 else -1.0
        return pd.Series(list(out / (np.linalg.norm(out, axis=1, keepdims=True) + EPSILON)))

    return F.pandas_udf(embed, "array<double>")


def build_index(works: DataFrame, index: DataFrame | None, embed, key: str = "base", text_col: str = "text", force: bool = False) -> DataFrame:
    """The index with works that it lacks embedded and added; only they go through the embedder."""
    if index is None or force:
        return works.withColumn("embedding", embed(F.col(text_col)))
    new = works.join(index.select(key), key, "left_anti")
    return index.unionByName(new.withColumn("embedding", embed(F.col(text_col))))
