"""Lists, snapshots and library tables: change detection, upserts, membership, progress and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vector import global_rank

# Fixed values.
PAGE_ROWS, BOOK_PAGES = 100, 100
# End of fixed values.


class DuplicateListName(ValueError):
    """A list of this name exists."""


def merged_scan(texts: DataFrame, summaries: DataFrame) -> DataFrame:
    """(stem, chapter, text_path, text_mtime, sum_path, sum_mtime): full outer merge, null chapters alike."""
    t, s = texts.alias("t"), summaries.alias("s")
    met = t.join(s, (F.col("t.stem") == F.col("s.stem")) & F.col("t.chapter").eqNullSafe(F.col("s.chapter")), "full_outer")
    return met.select(F.coalesce("t.stem", "s.stem").alias("stem"), F.coalesce("t.chapter", "s.chapter").alias("chapter"), "text_path", "text_mtime", "sum_path", "sum_mtime")


def what_changed(index: DataFrame, found: DataFrame, force: bool = False) -> DataFrame:
    """Found rows with ``change_row`` and ``change_body`` against the index."""
    i = index.select(F.col("stem").alias("__s"), F.col("chapter").alias("__c"), F.col("text_mtime").alias("__t"), F.col("sum_mtime").alias("__m"), F.col("body_rowid").alias("__b"), F.lit(True).alias("__in"))
    met = found.join(i, (F.col("stem") == F.col("__s")) & F.col("chapter").eqNullSafe(F.col("__c")), "left")
    text = ~F.col("text_mtime").eqNullSafe(F.col("__t"))
    new = F.col("__in").isNull() | F.lit(force)
    row = new | text | ~F.col("sum_mtime").eqNullSafe(F.col("__m"))
    body = F.col("text_path").isNotNull() & (new | text | F.col("__b").isNull())
    return met.withColumn("change_row", row).withColumn("change_body", body).drop("__s", "__c", "__t", "__m", "__b", "__in")


def upsert(current: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the changed rows in place of those with their keys, null keys alike; a merge without one."""
    c = changed.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        one = current[k].eqNullSafe(c[f"__{k}"])
        same = one if same is None else same & one
    return current.join(c, same, "left_anti").unionByName(changed, allowMissingColumns=True)


def by_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in rows.columns if c not in (key, version)]
    return rows.groupBy(key).agg(F.max_by(F.struct(version, *rest), F.col(version)).alias("r")).select(key, "r.*")


def list_summaries(lists: DataFrame, items: DataFrame) -> DataFrame:
    """Lists with their number of items, by name without case."""
    counts = items.groupBy(F.col("list_id").alias("__l")).agg(F.count("document_id").alias("n_items"))
    out = lists.join(counts, lists["id"] == F.col("__l"), "left").drop("__l").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    return out.orderBy(F.lower("name"), "id")


def list_by_name(lists: DataFrame, name: str) -> DataFrame:
    return lists.filter(F.col("name") == name)


def list_by_id(lists: DataFrame, list_id: int) -> DataFrame:
    return lists.filter(F.col("id") == list_id)


def _free(lists: DataFrame, name: str, but: int | None = None) -> str:
    name = name.strip()
    if not name:
        raise ValueError("a list needs a name")
    same = lists.filter(F.col("name") == name)
    if but is not None:
        same = same.filter(F.col("id") != but)
    if same.limit(1).count():
        raise DuplicateListName(name)
    return name


def create_list(lists: DataFrame, name: str, created_at: float) -> DataFrame:
    """The lists and a new one with the next id."""
    name = _free(lists, name)
    new = lists.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", F.lit(name).alias("name"), F.lit(created_at).alias("created_at"))
    return lists.unionByName(new)


def rename_list(lists: DataFrame, list_id: int, name: str) -> DataFrame:
    name = _free(lists, name, list_id)
    return lists.withColumn("name", F.when(F.col("id") == list_id, F.lit(name)).otherwise(F.col("name")))


def delete_list(lists: DataFrame, items: DataFrame, list_id: int) -> tuple[DataFrame, DataFrame]:
    return lists.filter(F.col("id") != list_id), items.filter(F.col("list_id") != list_id)


def add_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """Items with the new ones; a pair that is there keeps its first time."""
    return items.unionByName(new).groupBy("list_id", "document_id").agg(F.min("added_at").alias("added_at"))


def remove_item(items: DataFrame, list_id: int, document_id: int) -> DataFrame:
    return items.filter(~((F.col("list_id") == list_id) & (F.col("document_id") == document_id)))


def list_members(items: DataFrame, documents: DataFrame, list_id: int) -> DataFrame:
    """A list's documents by the time they were added."""
    own = items.filter(F.col("list_id") == list_id)
    return own.join(documents, own["document_id"] == documents["id"]).orderBy("added_at", "id")


def memberships(items: DataFrame, lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """document_id, lists (names in order) of the wanted documents."""
    own = items.join(wanted.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    named = own.join(lists.select(F.col("id").alias("list_id"), "name"), "list_id")
    return named.groupBy("document_id").agg(F.array_sort(F.collect_set("name")).alias("lists"))


def export_stems(items: DataFrame, documents: DataFrame, list_id: int) -> DataFrame:
    return list_members(items, documents, list_id).select("stem").distinct().orderBy("stem")


def append_distinct(listed: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """An ordered list with new names at its end, each name once."""
    both = listed.select(key, F.lit(0).alias("part"), "pos").unionByName(new.select(key, F.lit(1).alias("part"), "pos"))
    first = both.groupBy(key).agg(F.min(F.struct("part", "pos")).alias("at"))
    return global_rank(first, [F.col("at"), F.col(key)]).select(key, (F.col("rank") - 1).alias("pos"))


def progress(pdfs: DataFrame, texts: DataFrame, summaries: DataFrame) -> DataFrame:
    """stem, prepared, summarised: text files of each paper or its chapters, and how many have a summary."""
    named = texts.select("text", F.regexp_replace("text", r"_\d+$", "").alias("head"))
    known = pdfs.select("stem").distinct()
    own = named.join(known, named["text"] == known["stem"]).select("stem", "text")
    rest = named.join(known, named["text"] == known["stem"], "left_anti")
    chapters = rest.join(known, rest["head"] == known["stem"]).select("stem", "text")
    done = summaries.select(F.col("text").alias("__text")).distinct()
    all_texts = own.unionByName(chapters).join(done, F.col("text") == F.col("__text"), "left")
    counts = all_texts.groupBy("stem").agg(F.count(F.lit(1)).alias("prepared"), F.count("__text").alias("summarised"))
    return known.join(counts, "stem", "left").na.fill(0)


def fits_length(pages: Column, length: str, threshold: int = BOOK_PAGES) -> Column:
    """Books have more pages than the threshold; unknown lengths pass only without a filter."""
    if length == "any":
        return F.lit(True)
    over = pages > threshold if length == "books" else pages <= threshold
    return F.coalesce(over, F.lit(False))


def name_contains(name: Column, wanted: str) -> Column:
    return F.contains(F.lower(name), F.lit(wanted.lower()))


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = PAGE_ROWS) -> DataFrame:
    """The page, held between the first and the last one."""
    total = rows.count()
    last = max(1, -(-total // size))
    return rows.orderBy(*order).offset((min(max(page, 1), last) - 1) * size).limit(size)


def origins(steps: DataFrame, start: str, rounds: int = 20) -> DataFrame:
    """key, origin: follows each output's first input up to one that has none (L10); by pointer doubling."""
    out = steps.select(F.col("key"), F.col(start).alias("at"))
    for _ in range(max(1, (rounds - 1).bit_length())):
        up = out.select(F.col("key").alias("__k"), F.col("at").alias("__up"))
        out = out.join(up, out["at"] == up["__k"], "left").select("key", F.coalesce(F.col("__up"), F.col("at")).alias("at"))
    return out.select("key", F.coalesce("at", "key").alias("origin"))


def keep_recent(rows: DataFrame, at: Column, now: Column, days: int) -> DataFrame:
    """Rows that have not ended or started within the days; 0 keeps all."""
    return rows if not days else rows.filter(at.isNull() | (at >= now - F.make_dt_interval(F.lit(days))))


def expand_books(stems: DataFrame, chapters: DataFrame) -> DataFrame:
    """Each stem as its chapters if it has some, else itself."""
    met = stems.join(chapters.select(F.col("stem").alias("__s"), F.col("chapter_stem")), F.col("stem") == F.col("__s"), "left")
    return met.select(F.coalesce("chapter_stem", "stem").alias("stem")).distinct()


def select_listed(works: DataFrame, listed: DataFrame, key: str = "base") -> tuple[DataFrame, DataFrame]:
    """Works in the list's order, and the listed keys that no work has."""
    return listed.join(works, key).orderBy("pos"), listed.join(works, key, "left_anti")


def dedupe_in_order(rows: DataFrame, key: str = "base", order: str = "pos") -> DataFrame:
    """First row of each key."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.min_by(F.struct(order, *rest), F.col(order)).alias("r")).select(key, "r.*")
