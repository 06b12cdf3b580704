"""Writers: CSV tables, reference files, graphs, markdown, vector index."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
RIS_TYPES = {"article": "JOUR", "book": "BOOK", "book-chapter": "CHAP"}
WORK_COLUMNS = ["base", "doi", "ext_id", "title", "authors", "venue", "year", "type", "cited_by_count", "concepts", "match_confidence"]
# End of fixed values.


def works_table(works: DataFrame) -> DataFrame:
    """Works by authors and year, nulls first."""
    return works.select(*[c for c in WORK_COLUMNS if c in works.columns]).orderBy(F.col("authors").asc_nulls_first(), F.col("year").asc_nulls_first())


def citations_table(citations: DataFrame, works: DataFrame) -> DataFrame:
    """Citations with the citing work's title, authors and year."""
    w = works.select(F.col("base").alias("__b"), *[F.col(c).alias(f"citing_{c}") for c in ("title", "authors", "year")])
    return citations.join(w, F.col("citing_base") == F.col("__b"), "left").drop("__b").orderBy("citing_base", F.col("cited_year").asc_nulls_first())


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; as one file only where the caller has coalesced."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def citations_facts(works: DataFrame, edges: DataFrame) -> DataFrame:
    """Works with sorted lists of the works they cite and are cited by, both ends among the works (S33); edges (src, dst)."""
    cites = edges.groupBy(F.col("src").alias("base")).agg(F.array_sort(F.collect_set("dst")).alias("cites"))
    cited = edges.groupBy(F.col("dst").alias("base")).agg(F.array_sort(F.collect_set("src")).alias("cited_by"))
    out = works.join(cites, "base", "left").join(cited, "base", "left")
    empty = lambda c: F.coalesce(c, F.filter(F.array("base"), lambda x: F.lit(False)))
    return out.withColumn("cites", empty(F.col("cites"))).withColumn("cited_by", empty(F.col("cited_by")))


def ris_record(row: dict[str, Column]) -> Column:
    """One work as an RIS record; authors are joined by semicolons."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in RIS_TYPES.items() for x in p])[row["type"]], F.lit("GEN"))
    authors = F.transform(F.filter(F.split(F.coalesce(row["authors"], F.lit("")), r";\s*"), lambda a: a != ""), lambda a: F.concat(F.lit("AU  - "), a))
    tag = lambda name, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{name}  - "), c.cast("string")))
    lines = F.concat(F.array(F.concat(F.lit("TY  - "), kind)), F.array_compact(F.array(tag("TI", row["title"]))), authors,
                     F.array_compact(F.array(tag("PY", row["year"]), tag("JO", row["venue"]), tag("DO", row["doi"]))), F.array(F.lit("ER  - ")))
    return F.array_join(lines, "\n")


def write_markdown(docs: DataFrame, path: str) -> None:
    """(source, body) rows as texts: source, blank line, body."""
    docs.select(F.concat("source", F.lit("\n\n"), "body", F.lit("\n")).alias("value")).write.mode("overwrite").option("lineSep", "\x1e").text(path)


def graphml(nodes: list[tuple], edges: list[tuple], directed: bool) -> str:
    """A bounded graph as GraphML: (id, {attribute: value}) nodes and (source, target, {attribute: value}) edges."""
    names = {("node", k) for _, a in nodes for k in a} | {("edge", k) for _, _, a in edges for k in a}
    out = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    out += [f'<key id="{kind}_{k}" for="{kind}" attr.name={quoteattr(k)} attr.type="string"/>' for kind, k in sorted(names)]
    out.append(f'<graph edgedefault="{"directed" if directed else "undirected"}">')
    data = lambda kind, a: "".join(f'<data key="{kind}_{k}">{quoteattr(str(v))[1:-1]}</data>' for k, v in a.items() if v is not None)
    out += [f"<node id={quoteattr(str(i))}>{data('node', a)}</node>" for i, a in nodes]
    out += [f"<edge source={quoteattr(str(s))} target={quoteattr(str(t))}>{data('edge', a)}</edge>" for s, t, a in edges]
    return "\n".join([*out, "</graph>", "</graphml>"]) + "\n"


def write_index(index: DataFrame, path: str, model: str) -> None:
    """A vector index as Parquet, each row stamped with its model."""
    index.withColumn("model", F.lit(model)).write.mode("overwrite").parquet(path)


def read_index(spark, path: str, model: str | None = None) -> DataFrame:
    """The index; refuses another model's and rows without a vector."""
    found = spark.read.parquet(path)
    if found.filter(F.col("embedding").isNull()).limit(1).count():
        raise ValueError("records without vectors: rebuild the index")
    if model is not None and found.filter(~F.col("model").eqNullSafe(F.lit(model))).limit(1).count():
        raise ValueError("the index was built with another model")
    return found
