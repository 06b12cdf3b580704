"""Works and citation edges: linking, coupling, co-citation, authority and PageRank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

# Fixed values.
LEAST_CONFIDENCE, LEAST_SHARED, DAMPING = 0.7, 2, 0.85
# End of fixed values.


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, that of the largest order (B01): the maximum of a struct, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, order)]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(order, *rest), F.col(order)).alias("r"))
    return picked.select(key, "r.*")


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def resolve(citations: DataFrame, works: DataFrame) -> DataFrame:
    """Citations with a null ``cited_base`` filled by external id or DOI; the least base where several works match."""
    by = lambda c: works.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"__{c}")).agg(F.min("base").alias(f"__base_{c}"))
    out = citations.join(by("ext_id"), F.col("cited_ext_id") == F.col("__ext_id"), "left").join(by("doi"), F.col("cited_doi") == F.col("__doi"), "left")
    found = F.least("__base_ext_id", "__base_doi")
    return out.withColumn("cited_base", F.coalesce("cited_base", found)).select(*citations.columns)


def coupling(citations: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """base_a, base_b, shared: pairs of citing works by the number of shared cited ones; repeated edges multiply.

    With external ids only, edges are counted per (citing, cited) first, so pairs form between distinct works. Where
    DOIs stand too, an edge pair that agrees in both counts once: pairs by DOI that also agree by id are left out.
    """
    edges = citations.groupBy("citing_base", "cited_ext_id", "cited_doi").agg(F.count(F.lit(1)).alias("n"))
    a, b = edges.alias("a"), edges.alias("b")
    rising = F.col("a.citing_base") < F.col("b.citing_base")
    pair = [F.col("a.citing_base").alias("base_a"), F.col("b.citing_base").alias("base_b"), (F.col("a.n") * F.col("b.n")).alias("n")]
    by_id = a.join(b, (F.col("a.cited_ext_id") == F.col("b.cited_ext_id")) & rising).select(*pair)
    same = F.coalesce(F.col("a.cited_ext_id") == F.col("b.cited_ext_id"), F.lit(False))
    by_doi = a.join(b, (F.col("a.cited_doi") == F.col("b.cited_doi")) & rising).filter(~same).select(*pair)
    return by_id.unionByName(by_doi).groupBy("base_a", "base_b").agg(F.sum("n").alias("shared")).filter(F.col("shared") >= least)


def cocitation(citations: DataFrame, least: int = 2) -> DataFrame:
    """cited_a, cited_b, count of works that cite both; pairs form inside one reference list only."""
    edges = citations.filter(F.col("cited_ext_id").isNotNull()).select("citing_base", "cited_ext_id").distinct()
    a, b = edges.alias("a"), edges.alias("b")
    met = a.join(b, (F.col("a.citing_base") == F.col("b.citing_base")) & (F.col("a.cited_ext_id") < F.col("b.cited_ext_id")))
    counted = met.groupBy(F.col("a.cited_ext_id").alias("cited_a"), F.col("b.cited_ext_id").alias("cited_b")).agg(F.count(F.lit(1)).alias("count"))
    return counted.filter(F.col("count") >= least)


def authority(works: DataFrame, citations: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """base, cited_by_count, in_degree of works of enough confidence."""
    degree = citations.filter(F.col("cited_base").isNotNull()).groupBy(F.col("cited_base").alias("base")).agg(F.count(F.lit(1)).alias("in_degree"))
    known = works.filter(F.col("match_confidence") >= least)
    return known.join(degree, "base", "left").select(
        "base", F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), F.coalesce("in_degree", F.lit(0)).alias("in_degree")
    )


def work_signals(works: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    return works.filter(F.col("match_confidence") >= least).select("base", "year", F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"))


def metadata(works: DataFrame, base: str) -> DataFrame:
    return works.filter(F.col("base") == base)


def references(citations: DataFrame, base: str) -> DataFrame:
    return citations.filter(F.col("citing_base") == base)


def citers(citations: DataFrame, base: str) -> DataFrame:
    return citations.filter(F.col("cited_base") == base)


def stats(works: DataFrame, citations: DataFrame) -> DataFrame:
    """One row of counts."""
    w = works.agg(F.count(F.lit(1)).alias("works"), F.count("doi").alias("with_doi"))
    c = citations.agg(
        F.count(F.lit(1)).alias("citations"), F.count("cited_base").alias("internal_edges"),
        F.countDistinct(F.when(F.col("cited_base").isNotNull(), F.col("citing_base"))).alias("corpus_works_with_refs"),
    )
    return w.join(F.broadcast(c), F.lit(True))


def citation_graph(works: DataFrame, citations: DataFrame) -> DataFrame:
    """src, dst: distinct edges with both ends among the works."""
    known = works.select("base")
    edges = citations.select(F.col("citing_base").alias("src"), F.col("cited_base").alias("dst"))
    edges = edges.join(known.withColumnRenamed("base", "src"), "src", "left_semi").join(known.withColumnRenamed("base", "dst"), "dst", "left_semi")
    return edges.select("src", "dst").distinct()


def coupling_graph(works: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (works and whatever pairs name) and weighted edges."""
    nodes = works.select("base").union(pairs.select("base_a")).union(pairs.select("base_b")).distinct()
    return nodes, pairs.select(F.col("base_a").alias("src"), F.col("base_b").alias("dst"), F.col("shared").alias("weight"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = DAMPING, tolerance: float | None = None, every: int = 5) -> DataFrame:
    """node, rank: power iteration with uniform teleport, dangling mass spread evenly; 0 everywhere without edges.

    The lineage is cut every few rounds. With a tolerance, iteration stops once the ranks change by less than that per
    node in total.
    """
    nodes = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    n = nodes.count()
    if not edges.limit(1).count() or not n:
        return nodes.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    # co-partitioned on the source once; each round only moves (dst, share)
    links = cut(edges.join(out, "src").select("src", "dst", "out"))
    ranks = cut(nodes.withColumn("rank", F.lit(1.0 / n)))
    dangling = cut(nodes.join(out.select(F.col("src").alias("node")), "node", "left_anti"))
    for step in range(1, rounds + 1):
        lost = ranks.join(dangling, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        shares = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = (
            nodes.join(shares, nodes["node"] == shares["dst"], "left")
            .join(F.broadcast(lost), F.lit(True))
            .select("node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        )
        new = cut(new) if tolerance or step % every == 0 or step == rounds else new
        if tolerance:
            change = new.join(ranks.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if change < n * tolerance:
                return new
        ranks = new
    return ranks


def ranked(rows: DataFrame, key: str, name: str, k: int = 20) -> DataFrame:
    """The k rows of the largest positive key, ties by name."""
    return rows.filter(F.col(key) > 0).orderBy(F.col(key).desc(), name).limit(k)


def found_counts(rows: DataFrame, source: str) -> DataFrame:
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), source)


def debates(works: DataFrame, vectors: DataFrame, percentile: float = 0.66, k: int = 2) -> DataFrame:
    """anchor, newer, score, rank: each older, much cited work with the newer ones closest to it.

    Cutoffs are exact percentiles over the works with a year; fewer than four such works give no pairs. Anchors are the
    query side of a blocked vector search.
    """
    from . import vector

    known = works.filter(F.col("year").isNotNull())
    cuts = known.agg(
        F.expr(f"percentile(cited_by_count, {percentile})").alias("cites"), F.expr("percentile(year, 0.5)").alias("split"), F.count(F.lit(1)).alias("n")
    )
    placed = known.join(F.broadcast(cuts), F.lit(True)).filter("n >= 4")
    anchors = placed.filter("cited_by_count >= cites and year <= split").select("base")
    newer = placed.filter("year > split").select("base")
    sides = [vectors.join(side, vectors["base"] == side["base"], "left_semi").select("base", "embedding") for side in (newer, anchors)]
    found = vector.search(sides[0], sides[1], k, "base", "embedding", skip_self=False)
    return found.withColumnsRenamed({"query": "anchor", "other": "newer"})


#: Works that one pass over the records looks for.
WORK_BLOCK = 20_000


def linked(works: DataFrame, records: DataFrame, share: float = 0.7) -> DataFrame:
    """work, doi: the first record with a DOI whose title and first author agree with the work's name.

    A word of the work's title counts if the record's words, joined, hold it. One automaton over the words of a block of
    works finds all of them in one pass over each record's title; no pair of work and record is formed beforehand.
    """
    from ..functions import text as X

    titled = records.filter(F.coalesce(F.col("doi"), F.lit("")) != "").select(
        "pos", X.strip(F.col("doi")).alias("doi"), F.array_join(X.name_words(F.col("title")), "").alias("joined"), F.lower(F.array_join("authors", " ")).alias("names")
    )
    wanted = works.select("work", X.name_words(X.title_after(F.col("work"))).alias("words"), F.get(X.name_words(X.authors_of(F.col("work"))), F.lit(0)).alias("author")).distinct()
    blocks, out = max(1, -(-wanted.count() // WORK_BLOCK)), None
    for block in range(blocks):
        part = [(r.work, list(r.words), r.author) for r in wanted.filter(F.pmod(F.xxhash64("work"), F.lit(blocks)) == block).collect() if r.words]
        held = works.sparkSession.sparkContext.broadcast(part)

        def run(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton, of = ahocorasick.Automaton(), {}
            for k, (_, words, _) in enumerate(held.value):
                for w in words:
                    of.setdefault(w, []).append(k)
            for w, ks in of.items():
                automaton.add_word(w, np.array(ks))
            if of:
                automaton.make_automaton()
            size = np.array([len(words) for _, words, _ in held.value])
            for frame in frames:
                rows = []
                for pos, doi, joined, names in zip(frame["pos"], frame["doi"], frame["joined"], frame["names"]):
                    found = {id(ks): ks for _, ks in automaton.iter(joined)} if of else {}
                    if found:
                        hits = np.bincount(np.concatenate(list(found.values())), minlength=len(size))
                        for k in np.flatnonzero(hits >= share * size - 1e-12):
                            work, _, author = held.value[k]
                            if author is None or author in names:
                                rows.append((work, pos, doi))
                yield pd.DataFrame(rows, columns=["work", "pos", "doi"])

        got = titled.mapInPandas(run, "work string, pos long, doi string")
        out = got if out is None else out.unionByName(got)
    return out.groupBy("work").agg(F.min_by("doi", "pos").alias("doi"))
