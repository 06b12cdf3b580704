"""Corpus maps end to end: consensus of base clusterings, threads with their works, lists and drill-downs, and what reviews
and drafts take from them. Rows are long; a map has thousands of works, a thread some dozens."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..runtime import cut
from . import lexical, themes, vector
from .library import dedupe_in_order

# Fixed values.
LEAST_WORKS, LIST_BAND, NAME_TERMS, LEAST_GROUPED = 6, (2, 12), 3, 8
REDUCED = 10
SECTION_BUDGET, SECTION_POOL, MOST_SECTIONS = 24_000, 80, 40
STYLE_WORDS = 20
OUTLINE_PARTS = 4
CONTENT_CHARS, HIT_CHARS, HIT_WORKS = 3000, 400, 8
# End of fixed values.

#: Label combinations whose distances are held at once; a map has hundreds.
MOST_COMBINATIONS = 5_000


def base_clusterings(rows: DataFrame, k: int, id_col: str = "base", vec_col: str = "features", seed: int = 42) -> DataFrame:
    """item, run, label of three base clusterings: k-means, bisecting k-means and Gaussian mixtures."""
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans

    out = None
    for run, kind in enumerate((KMeans, BisectingKMeans, GaussianMixture)):
        model = kind(k=k, seed=seed, featuresCol=vec_col, predictionCol="label").fit(rows)
        part = model.transform(rows).select(F.col(id_col).alias("item"), F.lit(run).alias("run"), "label")
        out = part if out is None else out.unionByName(part)
    return out


def consensus(base: DataFrame, k: int) -> DataFrame:
    """item, cluster: average linkage on one minus co-association.

    Items with the same labels in all runs have the same distances, so that the combinations of labels are clustered, each
    with its number of items; their number is checked.
    """
    combined = base.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "label"))), lambda x: x["label"]).alias("labels"))
    sizes = combined.groupBy("labels").agg(F.count(F.lit(1)).alias("n")).orderBy("labels").limit(MOST_COMBINATIONS + 1).collect()
    if len(sizes) > MOST_COMBINATIONS:
        raise ValueError("too many combinations of labels for one map")
    labels = np.array([r.labels for r in sizes])
    if not len(labels):
        return combined.select("item", F.lit(0).alias("cluster"))
    valid = labels >= 0
    agree = (labels[:, None, :] == labels[None, :, :]) & valid[:, None, :] & valid[None, :, :]
    found = themes.average_linkage(1 - agree.mean(axis=2), min(k, len(labels)), np.array([r.n for r in sizes], float))
    table = base.sparkSession.createDataFrame([(list(map(int, x)), int(c)) for x, c in zip(labels, found)], "labels array<int>, cluster int")
    return combined.join(F.broadcast(table), "labels").select("item", "cluster")


def reduced(rows: DataFrame, vec_col: str = "features", components: int = REDUCED) -> DataFrame:
    """Rows with their features in few dimensions, of unit length: the linear fallback where there is no manifold."""
    from pyspark.ml.feature import PCA, Normalizer

    made = PCA(k=components, inputCol=vec_col, outputCol="__p").fit(rows).transform(rows).drop(vec_col)
    return Normalizer(inputCol="__p", outputCol=vec_col).transform(made).drop("__p")


def clustered(records: DataFrame, terms: DataFrame, dense: str = "embedding", text_cols: list[str] | None = None, wanted: int | None = None, band: tuple[int, int] | None = None) -> DataFrame:
    """base, main, second, strength: threads of the records, null main for outliers.

    records (base, an embedding, texts), terms (base, term, tf). Features are reduced, the number of threads is swept, the
    consensus assigned softly, and threads that agree in place and terms are joined.
    """
    from pyspark.ml.functions import vector_to_array

    made = cut(reduced(themes.ensemble(records, dense, text_cols or [])).withColumn("place", vector_to_array("features")))
    k = themes.kmeans_sweep(made.select("base", "place"), "place", wanted, *([band] if band else []))[0]
    base = cut(base_clusterings(made, k))
    final = cut(consensus(base, k))
    assigned = themes.assign(themes.profiles(base, final))
    in_thread = assigned.filter("main is not null").select(F.col("item").alias("base"), F.col("main").alias("class"))
    counts = terms.join(in_thread, "base").groupBy("class", "term").agg(F.sum("tf").alias("tf"))
    centres = vector.centroids(made.select("base", F.col("place").alias("v")).join(in_thread, "base"), "class", "v").withColumnRenamed("group", "class")
    roots = themes.merged_threads(centres.select("class", "centroid"), lexical.ctfidf(counts))
    name = lambda c: roots.select(F.col("class").alias(c), F.col("root").alias(f"{c}_root"))
    out = assigned.join(name("main"), "main", "left").join(name("second"), "second", "left").join(themes.strength(base, final), "item")
    second = F.when(F.col("second_root") != F.col("main_root"), F.col("second_root"))
    return out.select(F.col("item").alias("base"), F.col("main_root").alias("main"), second.alias("second"), "strength")


def sections(members: DataFrame, terms: DataFrame, records: DataFrame) -> DataFrame:
    """pos, thread, name, works, also: threads by size, named by their first terms, works by authors.

    members (base, main, second), terms (class, term, rank), records (base, authors).
    """
    listed = members.join(records.select("base", F.lower("authors").alias("a")), "base")
    works = lambda c, name: listed.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("thread")).agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "base"))), lambda x: x["base"]).alias(name))
    named = terms.filter(F.col("rank") <= NAME_TERMS).groupBy(F.col("class").alias("thread")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("name"))
    rows = works("main", "works").join(works("second", "also"), "thread", "left").join(named, "thread", "left")
    rows = rows.withColumn("also", F.coalesce("also", F.array().cast(rows.schema["works"].dataType))).withColumn("name", F.coalesce("name", F.lit("Theme")))
    # one row a thread, some dozens in all
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(F.size("works").desc(), "thread"))).select("pos", "thread", "name", "works", "also")


def restricted(records: DataFrame, listed: DataFrame) -> DataFrame:
    """Records of a list, all or none: a map needs six."""
    kept = records.join(listed.select("base").distinct(), "base", "left_semi")
    enough = kept.agg((F.count(F.lit(1)) >= LEAST_WORKS).alias("__enough"))
    return kept.join(F.broadcast(enough), F.lit(True)).filter("__enough").drop("__enough")


def thread_works(threads: DataFrame) -> DataFrame:
    """thread, pos, base: a thread's works and shared ones, each once in order, threads of six or more."""
    both = threads.select("thread", F.array_distinct(F.concat("bases", "also_bases")).alias("b")).filter(F.size("b") >= LEAST_WORKS)
    return both.select("thread", F.posexplode("b").alias("pos", "base"))


def choose_threads(threads: DataFrame, wanted: str) -> DataFrame:
    """All threads, that of a number, or those whose name holds the words (K18); threads (pos from 1, name)."""
    if wanted.lower() == "all":
        return threads
    if wanted.isdigit():
        return threads.filter(F.col("pos") == int(wanted))
    return threads.filter(F.contains(F.lower("name"), F.lit(wanted.lower())))


def targeted_groups(candidates: DataFrame, members: DataFrame, terms: DataFrame) -> DataFrame:
    """base, group: one group of few candidates, else groups by thread named by its first terms (K21); members (base, main)."""
    names = terms.filter(F.col("rank") <= NAME_TERMS).groupBy(F.col("class").alias("main")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("name"))
    few = candidates.agg((F.count(F.lit(1)) < LEAST_GROUPED).alias("__few"))
    joined = candidates.join(F.broadcast(few), F.lit(True)).join(members.select("base", "main"), "base", "left").join(names, "main", "left")
    group = F.when(F.col("__few"), "Relevant works").when(F.col("main").isNotNull(), F.coalesce("name", F.lit("Theme")))
    return joined.select("base", group.alias("group")).filter(F.col("group").isNotNull())


def threads_from_text(maps: DataFrame, records: DataFrame) -> DataFrame:
    """map, thread, base: works of a rendered map found by "authors - title" alike but for dashes, space and case.

    maps (map, text), records (base, authors, title).
    """
    blocks = F.slice(F.split("text", r"\n## "), 2, 1 << 30)
    each = maps.select("map", F.explode(blocks).alias("b")).select("map", X.strip(F.regexp_replace(F.regexp_extract("b", r"^([^\n]*)", 1), r"^\d+\.\s*", "")).alias("thread"), F.explode(F.split("b", "\n")).alias("line"))
    listed = each.filter(~F.startswith(F.lower("thread"), F.lit("cross-cutting")) & F.col("line").rlike(r"^-\s+"))
    key = X.name_key(F.regexp_replace("line", r"^-\s+", ""))
    own = records.select("base", X.name_key(F.concat_ws(" - ", "authors", "title")).alias("key"))
    return listed.withColumn("key", key).join(own, "key").select("map", "thread", "base")


def work_list(briefs: DataFrame) -> DataFrame:
    """base, authors, title of the works, by authors without case (S11); briefs (base)."""
    return briefs.select("base", X.authors_of(F.col("base")).alias("authors"), F.replace(X.title_after(F.col("base")), F.lit("_"), F.lit(" ")).alias("title")).orderBy(F.lower("authors"), "base")


def review_parts(text: Column) -> Column:
    """Array of struct(section, title, text) of a review's parts up to the works drawn on (S28, H125)."""
    body = F.get(F.split(F.concat(F.lit("\n"), text), r"(?i)\n## Works drawn on"), F.lit(0))
    chapters = F.slice(F.split(body, r"\n## "), 2, 1 << 30)
    first_line = lambda c: X.strip(F.regexp_extract(c, r"^([^\n]*)", 1))
    rest = lambda c: X.strip(F.regexp_replace(c, r"^[^\n]*\n?", ""))
    own = lambda c: F.struct(first_line(c).alias("section"), F.lit("").alias("title"), rest(F.get(F.split(c, r"\n### "), F.lit(0))).alias("text"))
    subs = lambda c: F.transform(F.slice(F.split(c, r"\n### "), 2, 1 << 30), lambda s: F.struct(first_line(c).alias("section"), first_line(s).alias("title"), rest(s).alias("text")))
    return F.filter(F.flatten(F.transform(chapters, lambda c: F.concat(F.array(own(c)), subs(c)))), lambda x: x["text"] != "")


def outline_parts(text: Column) -> Column:
    """Array of struct(title, covers, works) of an outline's sections."""
    field = lambda b, name: X.strip(F.regexp_extract(b, rf"{name}:[ \t]*\n?\s*([^\n]+)", 1))
    title = lambda b: X.strip(F.btrim(X.strip(F.ltrim(X.strip(F.regexp_extract(X.strip(b), r"^([^\n]*)", 1)), F.lit(":"))), F.lit("*")))
    blocks = F.slice(F.split(text, r"\*\*Section:\*\*"), 2, 1 << 30)
    made = F.transform(blocks, lambda b: F.struct(title(b).alias("title"), field(b, "Covers").alias("covers"), field(b, "Works").alias("works")))
    return F.filter(made, lambda x: x["title"] != "")


def candidate_terms(terms: DataFrame, k: int = 12) -> DataFrame:
    """term, rank: distinctive terms of one class of works (G16); terms (term, tf)."""
    one = lexical.ctfidf(terms.withColumn("class", F.lit("all")), k)
    return one.select("term", "rank")


def footer_rows(selected: DataFrame, signals: DataFrame) -> DataFrame:
    """Works of a review with year and citations where known."""
    return selected.join(signals, "base", "left").select("base", "authors", "title", "year", F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"))


def attach_briefs(selected: DataFrame, records: DataFrame) -> DataFrame:
    """Selected works with their records; own columns win."""
    shared = [c for c in records.columns if c != "base" and c in selected.columns]
    other = records.withColumnsRenamed({c: f"__{c}" for c in shared})
    joined = selected.join(other, "base", "left")
    return joined.select(*[F.coalesce(c, f"__{c}").alias(c) if c in shared else F.col(c) for c in joined.columns if not c.startswith("__")])


def flattened(groups: DataFrame) -> DataFrame:
    """base, pos: groups (place, bases) as one list, each work once."""
    each = groups.select("place", F.posexplode("bases").alias("i", "base")).select("base", F.struct("place", "i").alias("pos"))
    return dedupe_in_order(each)


def debate_lines(debates: DataFrame, titles: DataFrame, only: DataFrame) -> DataFrame:
    """anchor, line: each old work with the newer ones close to it, for the works of a section (H16); debates (anchor, newer, rank)."""
    kept = debates.join(only.select(F.col("base").alias("anchor")).distinct(), "anchor", "left_semi")
    named = kept.join(titles.select(F.col("base").alias("newer"), "title"), "newer")
    lines = named.groupBy("anchor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]), "; ").alias("newer"))
    return lines.join(titles.select(F.col("base").alias("anchor"), "title"), "anchor").select("anchor", F.concat_ws(" <-> ", "title", "newer").alias("line"))


def style_paragraphs(samples: DataFrame, indexed: DataFrame | None = None) -> DataFrame:
    """path, pos, text: paragraphs of twenty words or more from samples that the index lacks (I20); samples (path, text)."""
    fresh = samples if indexed is None else samples.join(indexed.select("path").distinct(), "path", "left_anti")
    each = fresh.select("path", F.posexplode(F.split("text", "\n\n")).alias("pos", "text"))
    return each.filter(X.word_count(F.col("text")) >= STYLE_WORDS).withColumn("text", X.strip(F.col("text")))


def style_matches(index: DataFrame, query: list[float], k: int = 3) -> DataFrame:
    """The paragraphs closest to a vector (I21); index (id, text, embedding)."""
    found = vector.scores(index, query, "id")
    return index.select("id", "text").join(found, "id").orderBy(F.round("score", 9).desc(), "id").limit(k)


def budgeted_sections(rows: DataFrame, seed: int = 0, budget: int = SECTION_BUDGET, most: int = MOST_SECTIONS) -> DataFrame:
    """by, key, chars of the sections that a call shows (M13): of the longest eighty, in a hashed order, those that still fit.

    rows (by, key, n, chars). A section that doesn't fit is passed over, so each group is folded; the first always counts.
    """
    pool = rows.withColumn("r", F.row_number().over(Window.partitionBy("by").orderBy(F.col("n").desc(), "key"))).filter(F.col("r") <= SECTION_POOL)
    order = F.struct(F.xxhash64(F.lit(seed), "key").alias("h"), F.col("key"), F.col("chars").cast("long").alias("chars"))
    listed = pool.groupBy("by").agg(F.array_sort(F.collect_list(order)).alias("l"))
    kind = rows.schema["key"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<struct<key:{kind},chars:bigint>>").alias("out"), F.lit(0).cast("long").alias("sum"))

    def add(s: Column, x: Column) -> Column:
        fits = (F.size(s["out"]) < most) & ((F.size(s["out"]) == 0) | (s["sum"] + x["chars"] <= budget))
        one = F.array(F.struct(x["key"].alias("key"), x["chars"].alias("chars")))
        return F.struct(F.when(fits, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"), (s["sum"] + F.when(fits, x["chars"]).otherwise(0)).alias("sum"))

    return listed.select("by", F.explode(F.aggregate("l", start, add)["out"]).alias("x")).select("by", "x.key", "x.chars")


def json_reply(reply: Column, schema: str) -> Column:
    """A reply's JSON by a schema, its code fence gone; null if it is malformed."""
    bare = F.regexp_replace(F.regexp_replace(X.strip(reply), r"^```[a-z]*\s*", ""), r"\s*```$", "")
    return F.from_json(bare, schema, {"mode": "PERMISSIVE"})


def section_items(plan: DataFrame, assignment: DataFrame, section: str) -> DataFrame:
    """Plan items of a section (D03); plan (pos, ...), assignment (pos, section)."""
    return plan.join(assignment.filter(F.col("section") == section).select("pos"), "pos", "left_semi")


def prompt_shape(items: DataFrame, default: int = 600) -> DataFrame:
    """section, paragraphs, target of the calls that write sections: a paragraph for two hundred words (H126, H127);
    items (section, target or null)."""
    target = F.coalesce("target", F.lit(default))
    return items.select("section", target.alias("target"), F.greatest(F.lit(1), F.bround(target / 200).cast("int")).alias("paragraphs"))


def draft_cost(sections_: DataFrame) -> DataFrame:
    """One row: characters in and tokens out over the sections to write (D11); sections (chars, target)."""
    return sections_.agg(F.sum("chars").alias("chars"), F.sum(F.col("target") * 2).alias("tokens_out"), F.count(F.lit(1)).alias("calls"))


def gap_cost(sections_: DataFrame) -> DataFrame:
    """One row: characters of the calls that read a draft's sections with their hits (H19); sections (text)."""
    return sections_.agg(F.sum(F.least(F.length("text"), F.lit(CONTENT_CHARS)) + HIT_WORKS * HIT_CHARS).alias("chars"), F.count(F.lit(1)).alias("calls"))


def map_cost(n: Column, threads: Column, mean: Column) -> Column:
    """Characters of a map's calls: each thread shows twenty works at most, a third more for what is shared."""
    return F.floor(threads * F.least(F.lit(20), n) * mean * 1.3)


def review_calls(structure: str, parts: int = OUTLINE_PARTS) -> int:
    """Calls of a review: one, or one and one a section."""
    return 1 if structure == "single" else 1 + parts


def ask_cost(records: DataFrame, most: int = 40) -> DataFrame:
    """One row: characters of a question's call, forty works at the mean size (H32); records (chars)."""
    n = F.count(F.lit(1))
    mean = F.floor(F.coalesce(F.sum("chars"), F.lit(0)) / F.greatest(F.lit(1), n))
    return records.agg((F.least(F.lit(most), n) * mean).alias("chars"))


def labelling_cost(papers: DataFrame, batch: bool = False) -> DataFrame:
    """One row: tokens of labelling papers by their sentences, half price in batches (H120); papers (n)."""
    factor = 0.5 if batch else 1.0
    return papers.agg(F.sum(500 + 20 * F.col("n")).alias("tokens_in"), F.sum(16 * F.col("n") + 64).alias("tokens_out")).withColumn("factor", F.lit(factor))


def with_sentences(papers: DataFrame) -> DataFrame:
    """Papers that hold a sentence (H119); papers (base, sentences)."""
    return papers.filter(F.size("sentences") > 0)


def recovered_sequences(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """base, reply of batch results by their place in the sorted corpus (H121); results (custom_id, reply), corpus (base)."""
    placed = vector.global_rank(corpus.select("base").distinct(), [F.col("base")])
    return results.join(placed.select("base", F.concat(F.lit("p"), (F.col("rank") - 1).cast("string")).alias("custom_id")), "custom_id").select("base", "reply")


def renumbered(chunks: DataFrame) -> DataFrame:
    """doc, pos, text: replies of a rundown's chunks as one numbered list (H113); chunks (doc, chunk, reply)."""
    each = chunks.select("doc", "chunk", F.posexplode(X.bullet_items(F.col("reply"))).alias("i", "text"))
    return each.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("chunk", "i")).alias("pos"), "text")


def enough_sections(sections_: DataFrame, least: int = 4) -> DataFrame:
    """skeleton, move, n of moves with enough sections for a blueprint (H123)."""
    return sections_.groupBy("skeleton", "move").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
