"""Tables behind a console: papers and their stages, folders, jobs in chains, lists, maps and what links documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .library import dedupe_in_order, expand_books

# Fixed values.
FOLDER_PAGE, MOST_FILES, RELATED_SHOWN = 100, 4000, 8
DOCUMENT_KINDS = ["text", "sum", "para", "quote", "map"]
# End of fixed values.


def sort_papers(papers: DataFrame, column: str, falling: bool = False) -> list[Column]:
    """Order of a table of papers: names without case, unknown numbers as -1, ties by name."""
    key = F.lower(column) if column == "name" else F.coalesce(F.col(column), F.lit(-1))
    return [key.desc() if falling else key.asc(), F.col("name")]


def core_names(outputs: DataFrame) -> DataFrame:
    """name of the papers that outputs cover: the stem itself and, for chapters, its book."""
    both = F.array(F.col("stem"), F.regexp_replace("stem", r"_\d+$", ""))
    return outputs.select(F.explode(F.array_distinct(both)).alias("name")).distinct()


def stage_summary(papers: DataFrame, prepared: DataFrame, summarised: DataFrame) -> DataFrame:
    """One row: papers, those prepared and those summarised, a book by any of its chapters."""
    there = lambda made, name: core_names(made).withColumn(name, F.lit(1))
    joined = papers.join(there(prepared, "prepared"), "name", "left").join(there(summarised, "summarised"), "name", "left")
    return joined.agg(F.count(F.lit(1)).alias("papers"), F.count("prepared").alias("prepared"), F.count("summarised").alias("summarised"))


def unprepared(papers: DataFrame, prepared: DataFrame, marked: DataFrame, skipped: DataFrame) -> DataFrame:
    """name of papers to prepare: not prepared yet or marked again, and not left out."""
    fresh = papers.join(core_names(prepared), "name", "left_anti")
    again = papers.join(marked.select("name").distinct(), "name", "left_semi")
    return fresh.unionByName(again).select("name").distinct().join(skipped, "name", "left_anti")


def named_texts(files: DataFrame, chapters: DataFrame) -> DataFrame:
    """stem of the texts that PDF names stand for, books as their chapters (L09, H45); files (pos, file)."""
    stems = files.select("pos", X.stem_of(F.col("file")).alias("stem"))
    return expand_books(stems, chapters)


def only_named(rows: DataFrame, names: DataFrame | None, key: str = "name") -> DataFrame:
    """All rows without a list, else those that it names."""
    return rows if names is None else rows.join(names.select(key).distinct(), key, "left_semi")


def folder_page(entries: DataFrame, wanted: str, page: int = 1, size: int = FOLDER_PAGE) -> DataFrame:
    """Entries (name, folder, modified) with the word in their name, folders first, then the newest; one page."""
    found = entries.filter(F.contains(F.lower("name"), F.lit(wanted.lower())))
    order = [F.col("folder").desc(), F.when(F.col("folder"), F.lower("name")), F.col("modified").desc(), F.col("name")]
    return found.orderBy(*order).offset((page - 1) * size).limit(size)


def files_below(files: DataFrame, most: int = MOST_FILES) -> tuple[DataFrame, Column]:
    """The first files by path, and whether there were more (S44). The limit is the feature: a page answers at once."""
    return files.orderBy("path").limit(most), F.lit(files.limit(most + 1).count() > most)


def suffix_counts(files: DataFrame, suffix: str) -> DataFrame:
    """One row: files of a suffix in the folder itself and below it (H145); files (path relative to it)."""
    own = F.endswith(F.lower("path"), F.lit(suffix))
    deep = F.contains(F.col("path"), F.lit("/"))
    return files.agg(F.count_if(own & ~deep).alias("here"), F.count_if(own & deep).alias("deeper"))


def chain_states(steps: DataFrame) -> DataFrame:
    """Steps (chain, pos, outcome, dollars, approved) with ``state``: what follows a failure is skipped, and a chain waits at
    the first step that costs more than was approved (L13, H155). Outcomes are done, failed or null."""
    before = Window.partitionBy("chain").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    dear = F.coalesce(F.col("dollars") > F.coalesce("approved", F.lit(0.0)), F.lit(False)) & F.col("outcome").isNull()
    stopped = F.coalesce(F.max(F.when(F.col("outcome") == "failed", 2).when(dear, 1)).over(before), F.lit(0))
    state = F.when(stopped == 2, "skipped").when(stopped == 1, "waiting").when(dear, "paused").otherwise(F.coalesce("outcome", F.lit("ready")))
    return steps.withColumn("state", state)


def next_steps(states: DataFrame) -> DataFrame:
    """chain, pos of the first step that isn't done, where a chain goes on."""
    return states.filter("state <> 'done'").groupBy("chain").agg(F.min("pos").alias("pos"))


def next_id(records: DataFrame, key: str = "id") -> DataFrame:
    """One row: the largest whole number among the ids and one, 1 without any."""
    return records.agg((F.coalesce(F.max(F.col(key).try_cast("long")), F.lit(0)) + 1).alias("next"))


def last_line(log: Column) -> Column:
    """The last line of a log that isn't blank."""
    return F.element_at(F.filter(F.transform(F.split(log, "\n"), X.strip), lambda x: x != ""), F.lit(-1))


def flags(fields: DataFrame, values: DataFrame) -> DataFrame:
    """command, flag of filled form fields, bad ones named (L18); fields (command, field, kind, flag), values (command, field, value)."""
    value = X.strip(F.col("value"))
    good = F.when(F.col("kind") == "int", value.rlike(r"^-?\d+$")).when(F.col("kind") == "float", value.try_cast("double").isNotNull()).otherwise(F.lit(True))
    joined = values.join(fields, ["command", "field"]).filter(value != "")
    made = F.when(F.col("kind") == "bool", F.when(F.lower(value).isin("on", "true", "1"), F.col("flag"))).otherwise(F.concat_ws(" ", "flag", value))
    return joined.select("command", "field", F.when(good, made).alias("flag"), (~good).alias("bad")).filter("bad or flag is not null")


def list_counts(lists: DataFrame, items: DataFrame) -> DataFrame:
    """name, n of every list by name without case (H150)."""
    counts = items.groupBy(F.col("list_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return lists.join(counts, "id", "left").select("name", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.lower("name"), "name")


def newest_first(files: DataFrame, key: str = "name") -> DataFrame:
    """Files (key, modified), each once with its newest time, newest first (H128, H133, H151)."""
    return files.groupBy(key).agg(F.max("modified").alias("modified")).orderBy(F.col("modified").desc(), key)


def outline_of(review: Column) -> Column:
    """The outline's name in a review's file name, without its time and kind suffixes (H139)."""
    return F.regexp_replace(X.stem_of(review), r"_[^_]*_[^_]*$", "")


def books_of(chapters: DataFrame, prepared: DataFrame) -> DataFrame:
    """stem, book of chapters whose book's other files are there; null where the digits belong to the name (H140)."""
    named = chapters.select("stem", F.regexp_extract("stem", r"^(.+)_\d{2,3}$", 1).alias("head"))
    there = prepared.select(F.col("name").alias("head"), F.col("name").alias("book")).distinct()
    return named.join(there, "head", "left").select("stem", "book")


def related_documents(stems: DataFrame, files: DataFrame) -> DataFrame:
    """stem, place, file of the documents of five kinds that exist for a stem, in the kinds' order (H141); files (file)."""
    kinds = F.posexplode(F.array(*map(F.lit, DOCUMENT_KINDS))).alias("place", "kind")
    names = stems.select("stem", kinds).select("stem", "place", F.concat_ws("_", "kind", F.concat("stem", F.lit(".md"))).alias("file"))
    return names.join(files.select("file").distinct(), "file", "left_semi").select("stem", "place", "file")


def paper_facts(works: DataFrame, edges: DataFrame) -> DataFrame:
    """base, title, cites, cited_by (titles in order) of every work (H131); edges (src, dst) between works."""
    named = lambda end, other, name: edges.join(works.select(F.col("base").alias(other), "title"), other).groupBy(F.col(end).alias("base")).agg(F.array_sort(F.collect_list("title")).alias(name))
    joined = works.join(named("src", "dst", "cites"), "base", "left").join(named("dst", "src", "cited_by"), "base", "left")
    none = F.array().cast("array<string>")
    return joined.select("base", "title", F.coalesce("cites", none).alias("cites"), F.coalesce("cited_by", none).alias("cited_by"))


def detail_maps(maps: DataFrame, title: str, source: str) -> DataFrame:
    """Maps made of one thread of a map: those of its title that name that map as their source (H135)."""
    return maps.filter((F.col("title") == title) & (F.col("source") == source))


def first_related(related: Column, k: int = RELATED_SHOWN) -> Column:
    """The nearest stored neighbours that are shown."""
    return F.slice(related, 1, k)


def conversation_cards(turns: DataFrame) -> DataFrame:
    """conv_id, questions, last question of every conversation, the longest first (H137, H138)."""
    asked = turns.filter("role = 'user'")
    return asked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("questions"), F.max_by("text", "turn").alias("last")).orderBy(F.col("questions").desc(), "conv_id")


def conversation_works(stored: DataFrame, found: DataFrame, k: int = 40) -> DataFrame:
    """conv, base, pos: a conversation's stored works in their order, else the best found ones."""
    kept = dedupe_in_order(stored.withColumn("key", F.struct("conv", "base")), "key").select("conv", "base", "pos")
    fresh = found.join(kept.select("conv").distinct(), "conv", "left_anti").filter(F.col("rank") <= k).select("conv", "base", F.col("rank").alias("pos"))
    return kept.unionByName(fresh)


def page_numbers(values: Column, pages: Column) -> Column:
    """Distinct page numbers in order, null if one lies outside the document (H147)."""
    numbers = F.array_sort(F.array_distinct(values))
    return F.when(F.forall(numbers, lambda n: n.between(1, pages)), numbers)


def to_recount(files: DataFrame, cached: DataFrame) -> DataFrame:
    """name of files whose page count is unknown or was taken of another state of the file (H148); stamps are size and time."""
    stamp = F.concat_ws(":", "size", "modified")
    return files.withColumn("stamp", stamp).join(cached.select("name", "stamp"), ["name", "stamp"], "left_anti").select("name")


def marks_of(kinds: Column, kind: str) -> Column:
    """Page numbers that marks give a kind, in order."""
    return F.array_sort(F.transform(F.map_keys(F.map_filter(kinds, lambda _, v: v == kind)), lambda k: k.cast("int")))


def finished(outputs: DataFrame) -> DataFrame:
    """stem, single, chapters of what is there for each paper (H71, C04); outputs (name)."""
    key = X.split_chapter(X.stem_of(F.col("name")))
    rows = outputs.select(key["stem"].alias("stem"), key["chapter"].alias("chapter"))
    return rows.groupBy("stem").agg(F.bool_or(F.col("chapter").isNull()).alias("single"), F.count("chapter").alias("chapters"))


def fetch_estimate(works: DataFrame) -> DataFrame:
    """One row: works and papers to look up, by a DOI or by a search (B25); works (work, papers, doi)."""
    known = F.col("doi").isNotNull()
    return works.agg(F.count(F.lit(1)).alias("works"), F.sum("papers").alias("papers"), F.count_if(known).alias("by_doi"), F.count_if(~known).alias("by_search"))


def store(works: DataFrame, matched: DataFrame) -> DataFrame:
    """The works with a match's rows in place of those of its papers."""
    return works.join(matched.select("base").distinct(), "base", "left_anti").unionByName(matched)


def forget(works: DataFrame, citations: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Works and citations without those of the papers."""
    gone = bases.select("base").distinct()
    return works.join(gone, "base", "left_anti"), citations.join(gone.withColumnRenamed("base", "citing_base"), "citing_base", "left_anti")


def not_found(before: DataFrame, tried: DataFrame) -> DataFrame:
    """work of those without a match: found ones leave the set, others join it (H44); tried (work, source or null)."""
    found = tried.filter("source is not null").select("work")
    missed = tried.filter("source is null").select("work")
    return before.select("work").unionByName(missed).distinct().join(found, "work", "left_anti")


def looked_up(papers: DataFrame, works: DataFrame) -> DataFrame:
    """work, found of every work of the papers."""
    asked = papers.select(X.work_of(F.col("base")).alias("work")).distinct()
    known = works.select(X.work_of(F.col("base")).alias("work")).distinct().withColumn("found", F.lit(True))
    return asked.join(known, "work", "left").select("work", F.coalesce("found", F.lit(False)).alias("found"))


def text_paths(works: DataFrame, texts: DataFrame) -> DataFrame:
    """work, path of its whole text, else of its first chapter (H46); texts (stem, chapter, path)."""
    whole = texts.filter("chapter is null").select(F.col("stem").alias("work"), F.col("path").alias("whole"))
    first = texts.filter("chapter = '01'").select(F.col("stem").alias("work"), F.col("path").alias("first"))
    return works.join(whole, "work", "left").join(first, "work", "left").select("work", F.coalesce("whole", "first").alias("path"))


def plain_moves(text: Column, names: dict[str, str]) -> Column:
    """``[MOVE]:`` tags as bold words (H153)."""
    for move, words in names.items():
        text = F.replace(text, F.lit(f"[{move}]:"), F.lit(f"**{words}:**"))
    return text


def cancel(spark, job: str) -> None:
    """Stop what runs under a job's name (H154)."""
    spark.sparkContext.cancelJobGroup(job)
