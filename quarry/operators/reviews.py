"""Gap checks, review assembly, metadata lookup and work planning over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import lexical

# Fixed values.
PARAGRAPH_HITS, LEAST_PARAGRAPH, SECTION_HITS, REPORT_HITS, BACKFILL = 5, 40, 8, 15, 40
TITLE_SHARE, REVERSE_SHARE = 0.7, 0.5
SPEEDS = {"eco": 380, "balanced": 750, "turbo": 1200}
SERIAL_SECONDS, LOCAL_SECONDS, BATCH_PER_HOUR, BATCH_FLOOR_MINUTES = 50.0, 4.0, 6000, 55
BATCH_PRICE = 0.5
# End of fixed values.


def section_candidates(hits: DataFrame, cited: DataFrame, per_section: int = SECTION_HITS) -> DataFrame:
    """section, base, score, rank: best score of uncited works per section (G03 to G05); hits (section, base, score)."""
    best = hits.join(cited.select("base"), "base", "left_anti").groupBy("section", "base").agg(F.max("score").alias("score"))
    return lexical.top(best, ["section"], [F.round("score", 9).desc(), F.col("base")], per_section)


def gap_report(candidates: DataFrame, k: int = REPORT_HITS) -> DataFrame:
    """base, score: the best works over all sections."""
    best = candidates.groupBy("base").agg(F.max("score").alias("score"))
    return best.orderBy(F.round("score", 9).desc(), "base").limit(k)


def section_terms(terms: DataFrame, sections: DataFrame, k: int = 6) -> DataFrame:
    """section, term, rank: distinctive terms that the section's text doesn't hold (G06); terms (section, term, rank)."""
    new = terms.join(sections.select("section", "text"), "section").filter(~F.contains(F.lower("text"), F.lower("term")))
    return lexical.top(new.drop("text").withColumnRenamed("rank", "__o"), ["section"], [F.col("__o")], k).drop("__o")


def group_by_map(candidates: DataFrame, threads: DataFrame) -> DataFrame:
    """Candidates (base, key, score) with the first thread (pos, thread, key) that lists them, and their group's place.

    Scores are summed as decimals, so that groups with equal totals are placed by name whatever the order of their rows; groups
    with scores that no such decimal holds are summed as they are.
    """
    listed = threads.groupBy("key").agg(F.min(F.struct("pos", "thread")).alias("t"))
    claimed = candidates.join(listed, "key").groupBy("base", "score").agg(F.min("t").alias("t")).select("base", "score", "t.thread")
    exact = F.col("score").try_cast("decimal(38,18)")
    sums = claimed.groupBy("thread").agg(F.sum("score").alias("sum"), F.try_sum(exact).alias("exact"), F.count("score").alias("n"), F.count(exact).alias("held"))
    total = sums.select("thread", F.when(F.col("n") == F.col("held"), F.col("exact").cast("double")).alias("exact"), "sum").select("thread", F.coalesce("exact", "sum").alias("total"))
    place = F.dense_rank().over(Window.orderBy(F.round("total", 9).desc(), "thread"))
    return claimed.join(F.broadcast(total.withColumn("place", place)), "thread")


def backfill(selected: DataFrame, found: DataFrame, k: int = BACKFILL) -> DataFrame:
    """Selected works, then found ones by rank up to k in all (I15); rows (base, pos) and (base, rank)."""
    rest = found.join(selected.select("base"), "base", "left_anti").select("base", F.lit(1).alias("part"), F.col("rank").alias("at"))
    both = selected.select("base", F.lit(0).alias("part"), F.col("pos").alias("at")).unionByName(rest)
    return both.orderBy("part", "at").limit(k).select("base")


def works_for_section(section_works: Column, works: DataFrame, least: int = 2) -> DataFrame:
    """Works one of whose longer author words the section names, or all if fewer than two are."""
    named = F.exists(F.filter(F.split("authors", r"\s+"), lambda s: F.length(s) > 3), lambda s: F.contains(F.lower(section_works), F.lower(s)))
    marked = works.withColumn("__m", F.coalesce(named, F.lit(False)))
    return marked.withColumn("__n", F.count_if("__m").over(Window.partitionBy())).filter(F.col("__m") | (F.col("__n") < least)).drop("__m", "__n")


def keyword_select(works: DataFrame, word: str, k: int = 30) -> DataFrame:
    """Works with the word in authors or title, without case."""
    hit = lambda c: F.contains(F.lower(c), F.lit(word.lower()))
    return works.filter(hit("authors") | hit("title")).orderBy(F.lower("authors"), "base").limit(k)


def hit_lines(arguments: Column, conclusions: Column, authors: Column, title: Column) -> Column:
    """A work as lines of text with bounded fields."""
    return F.concat(authors, F.lit(" - "), title, F.lit("\nArguments: "), F.substring(arguments, 1, 500), F.lit("\nConclusions: "), F.substring(conclusions, 1, 300))


def works_to_fetch(papers: DataFrame, known: DataFrame, excluded: DataFrame | None = None, only: DataFrame | None = None, force: bool = False) -> DataFrame:
    """work, bases of papers whose work still needs a lookup."""
    rows = papers.select("base", X.work_of(F.col("base")).alias("work"))
    if not force:
        rows = rows.join(known.select("base"), "base", "left_anti")
    if excluded is not None:
        rows = rows.join(excluded.select("work"), "work", "left_anti")
    if only is not None:
        rows = rows.join(only.select("work"), "work", "left_semi")
    return rows.groupBy("work").agg(F.array_sort(F.collect_set("base")).alias("bases"))


def confirmed(tries: DataFrame) -> DataFrame:
    """work, doi, source, confidence: the first try whose record has the work's title, and its author where asked.

    Rows (work, place, source, doi, title, authors, need_author); places rise from own DOI over exports to searches.
    """
    share = X.title_share(X.title_after(F.col("work")), F.col("title"))
    good = (share >= TITLE_SHARE) & (~F.col("need_author") | X.has_author(F.col("work"), F.col("authors")))
    kept = tries.withColumn("confidence", F.bround(share, 2)).filter(good)
    return kept.groupBy("work").agg(F.min_by(F.struct("doi", "source", "confidence"), F.col("place")).alias("m")).select("work", "m.*")


def close_records(found: DataFrame) -> DataFrame:
    """Search results (work, pos, title, authors, doi) that agree both ways and by author."""
    a = X.title_share(X.title_after(F.col("work")), F.col("title")) >= TITLE_SHARE
    b = X.title_share(F.substring_index("title", ":", 1), X.title_after(F.col("work"))) >= REVERSE_SHARE
    return found.filter(a & b & X.has_author(F.col("work"), F.col("authors")))


def work_row(found: dict[str, Column]) -> dict[str, Column]:
    """Columns of a work from a catalogue record."""
    return {
        "doi": F.regexp_replace(found["doi"], r"^https?://(dx\.)?doi\.org/", ""),
        "authors": F.array_join(F.transform(found["authorships"], lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))), "; "),
    }


def plan_documents(sources: DataFrame, made: DataFrame, overwrite: bool = False) -> DataFrame:
    """Sources (stem, changed) with the documents to write: all if changed, else those missing (X23, X24); made (stem, kind)."""
    kinds = F.array(*map(F.lit, ["sum", "para", "quote"]))
    there = made.groupBy("stem").agg(F.collect_set("kind").alias("made"))
    out = sources.join(there, "stem", "left").withColumn("made", F.coalesce("made", F.array().cast("array<string>")))
    anew = F.col("changed") | F.lit(overwrite)
    return out.withColumn("todo", F.when(anew, kinds).otherwise(F.array_except(kinds, "made"))).filter(F.size("todo") > 0)


def stale_summaries(summaries: DataFrame, texts: DataFrame) -> DataFrame:
    """Summaries of chapters that are gone from books that are still there (X25); both (stem)."""
    book = X.book_of(F.col("stem"))
    chapters = summaries.withColumn("book", book).filter("book <> ''")
    alive = texts.select(X.book_of(F.col("stem")).alias("book")).filter("book <> ''").distinct()
    return chapters.join(alive, "book", "left_semi").join(texts.select("stem"), "stem", "left_anti").drop("book")


def failed_outputs(summaries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Summaries without a template and the files that go with them."""
    return summaries.filter(~X.has_template(F.col("text"))).select("stem", "path").join(pairs, "stem", "left")


def tickets(parts: DataFrame) -> DataFrame:
    """ticket, counts summed over its batches, and whether all have ended."""
    return parts.groupBy("ticket").agg(*[F.sum(c).alias(c) for c in ("processing", "succeeded", "errored")], F.bool_and(F.col("status") == "ended").alias("ended"))


def complete(requested: DataFrame, results: DataFrame) -> DataFrame:
    """plan, ok: whether every requested id has a result (X30); both by custom_id."""
    met = requested.join(results.select("custom_id", F.lit(True).alias("__r")), "custom_id", "left")
    return met.groupBy("plan").agg(F.bool_and(F.col("__r").isNotNull()).alias("ok"))


def pending(tickets: DataFrame, state: str = "open") -> DataFrame:
    """Distinct names planned in open tickets (H117, H146)."""
    return tickets.filter(F.col("state") == state).select(F.explode("plans").alias("name")).distinct()


def card(requests: Column, processing: Column) -> Column:
    """struct(answered, share): rounded percentage of requests answered."""
    answered = requests - processing
    return F.struct(answered.alias("answered"), F.bround(100 * answered / F.greatest(F.lit(1), requests), 0).cast("int").alias("share"))


def mode_seconds(n: int, speed: str = "balanced", workers: int = 8) -> dict[str, float]:
    """Seconds that n papers take in each mode."""
    local = n * LOCAL_SECONDS
    return {
        "serial": local + n * SERIAL_SECONDS,
        "parallel": max(local / max(1, workers), n / SPEEDS[speed] * 3600),
        "batch": local / max(1, workers) + max(BATCH_FLOOR_MINUTES * 60, n / BATCH_PER_HOUR * 3600),
    }


def choose_mode(n: int, asked: str | None = None, **options) -> str:
    """The asked mode, serial for one paper, else the quickest (H116)."""
    if asked:
        return asked
    seconds = mode_seconds(n, **options)
    return "serial" if n <= 1 else min(seconds, key=seconds.get)


def costs(calls: DataFrame, prices: DataFrame, batch: bool = False) -> DataFrame:
    """Calls (model, chars_in, tokens_out) with dollars by the first price whose name starts the model's.

    Prices (pos, prefix, per_in, per_out) are a short list whose size is checked.
    """
    if prices.count() > 1000:
        raise ValueError("too many prices")
    met = calls.join(F.broadcast(prices), F.startswith(calls["model"], prices["prefix"]), "left")
    first = met.groupBy(*calls.columns).agg(F.min_by(F.struct("per_in", "per_out"), F.col("pos")).alias("p"))
    tokens = F.floor((F.col("chars_in") + 3000) / 3)
    dollars = (tokens * F.col("p.per_in") + F.col("tokens_out") * F.col("p.per_out")) / 1e6 * (BATCH_PRICE if batch else 1)
    return first.withColumn("dollars", F.coalesce(dollars, F.lit(0.0))).drop("p")


def brief_chars_mean(records: DataFrame, fields: list[str]) -> DataFrame:
    """Whole mean of the records' characters; 0 without any."""
    size = sum((F.length(F.coalesce(F.col(c), F.lit(""))) for c in fields), F.lit(0))
    return records.agg(F.coalesce(F.floor(F.sum(size) / F.greatest(F.count(F.lit(1)), F.lit(1))), F.lit(0)).alias("chars"))


def used_in_order(uses: DataFrame) -> DataFrame:
    """Works by their first use."""
    first = uses.groupBy("base").agg(F.min("pos").alias("pos"))
    return first.orderBy("pos", "base")


def manuscript(sections: DataFrame) -> DataFrame:
    """One row: text and words of the sections that aren't empty, in order (D09); rows (pos, label, text)."""
    kept = sections.filter(X.strip(F.col("text")) != "")
    part = F.concat(F.lit("## "), F.col("label"), F.lit("\n\n"), X.strip(F.col("text")))
    listed = kept.agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))).alias("l"), F.coalesce(F.sum(X.word_count(F.col("text"))), F.lit(0)).alias("words"))
    return listed.select(F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("text"), "words")


def within_target(words: Column, target: Column, tolerance: float = 0.15) -> Column:
    """under, ok or over a section's word target."""
    return F.when(words < target * (1 - tolerance), "under").when(words > target * (1 + tolerance), "over").otherwise("ok")


def stage_shares(stages: DataFrame) -> DataFrame:
    """Stages with rounded percentages."""
    return stages.withColumn("percent", F.bround(100 * F.coalesce("typical_share", F.lit(0.0)), 0).cast("int"))


def merge_sequences(new: DataFrame, before: DataFrame, corpus: DataFrame) -> DataFrame:
    """New sequences, and earlier ones of papers still in the corpus that have no new one."""
    kept = before.join(corpus.select("base"), "base", "left_semi").join(new.select("base"), "base", "left_anti")
    return new.unionByName(kept)


def papers_to_label(papers: DataFrame, known: DataFrame, limit: int | None = None, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Papers without labels; a sample by hash order, a limit by name."""
    rows = papers.join(known.select("base"), "base", "left_anti")
    if sample is not None:
        rows = rows.orderBy(F.xxhash64(F.lit(seed), "base"), "base").limit(sample)
    return rows.orderBy("base").limit(limit) if limit is not None else rows


def earlier_questions(turns: DataFrame, k: int = 6) -> DataFrame:
    from .sequences import last_turns

    return last_turns(turns, k)


def recent(files: DataFrame, k: int = 12) -> DataFrame:
    """The newest files and how many there are (H144); rows (name, modified)."""
    newest = files.orderBy(F.col("modified").desc(), "name").limit(k)
    return newest.join(F.broadcast(files.agg(F.count(F.lit(1)).alias("total"))), F.lit(True))


def marked_again(marks: DataFrame, made: DataFrame) -> DataFrame:
    """Stems marked after their newest output was made (C05, H143); both (stem, modified)."""
    newest = made.groupBy("stem").agg(F.max("modified").alias("made"))
    return marks.join(newest, "stem").filter(F.col("modified") > F.col("made")).select("stem").distinct()
