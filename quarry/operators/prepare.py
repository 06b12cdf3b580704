"""From files to prepared texts and their signals: search tables, list pages, gold files, line streams, rundowns and phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import folds, lexical
from .layout import BULLET

# Fixed values.
INDEX_VERSION = 2
RULE_THICKNESS, ACROSS_SHARE, DOWN_SHARE = 3, 0.1, 0.02
SEARCH_PAGES, LEAST_SEARCH, SEARCH_SHARE, LEAST_TITLED = 40, 6, 0.1, 3
RUNDOWN_CHARS, PHRASES, ENTITIES, TRIPLETS = 400, 25, 25, 30
PHRASE_WORDS, PHRASE_CHARS, CARD_CHARS = 3, 4, 300
GOLD_TAGS = ["HEAD", "PARA", "CONT", "LIST", "DROP"]
# End of fixed values.


def index_rows(found: DataFrame) -> DataFrame:
    """Rows of a document index: stem, chapter, title (of the summary, else of the text, else the stem), authors_raw, and the
    summary's text (R06); found (stem, chapter, text, summary)."""
    title = F.coalesce(F.nullif(X.title_from_summary(F.col("summary")), F.lit("")), F.nullif(X.title_from_text(F.col("text")), F.lit("")), F.col("stem"))
    return found.select("stem", "chapter", title.alias("title"), X.authors_of(F.col("stem")).alias("authors_raw"), F.coalesce("summary", F.lit("")).alias("summary"))


def bodies(documents: DataFrame, indexed: DataFrame) -> DataFrame:
    """id, body of documents whose full text isn't indexed yet, to append (R05); documents (id, text), indexed (id)."""
    return documents.filter("text is not null").join(indexed.select("id"), "id", "left_anti").select("id", F.col("text").alias("body"))


def to_rebuild(version: int | None, tables: list[str], kept: list[str]) -> list[str]:
    """Tables to drop for a new layout: those that can be made anew, never what users entered."""
    return [] if version is not None and version >= INDEX_VERSION else [t for t in tables if t not in kept]


def index_exists(spark, table: str) -> bool:
    """Whether there is an index with a row in it."""
    return spark.catalog.tableExists(table) and not spark.table(table).isEmpty()


def search(documents: DataFrame, words: list[str], author: str | None = None, fields: dict[str, Column] | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """id, tier, score of a page of hits (R12): words alone search summaries first and full texts after them; with an author
    summaries only; nothing asked gives all documents by title, without scores.

    documents (id, title, authors_raw, summary, body).
    """
    if not words and not author:
        browse = documents.orderBy("title", "id").offset(offset).limit(limit)
        return browse.select("id", F.lit(0).alias("tier"), F.lit(None).cast("double").alias("score"))
    tokens = X.search_tokens
    own = fields or {"title": tokens(F.col("title")), "authors_raw": tokens(F.col("authors_raw")), "summary": tokens(F.col("summary"))}
    asked = documents
    if author:
        named = F.concat_ws(" ", tokens(F.lit(author)))
        asked = documents.filter(F.contains(F.concat(F.lit(" "), F.concat_ws(" ", tokens(F.col("authors_raw"))), F.lit(" ")), F.concat(F.lit(" "), named, F.lit(" "))))
    if not words:
        return asked.orderBy("title", "id").offset(offset).limit(limit).select("id", F.lit(0).alias("tier"), F.lit(None).cast("double").alias("score"))
    summaries = lexical.weighted(asked, "id", own, words, lexical.FIELD_WEIGHTS)
    if author:
        return lexical.page_of(summaries.withColumn("tier", F.lit(0)), limit, offset).select(F.col("doc").alias("id"), "tier", "score")
    full = lexical.weighted(documents, "id", {"body": tokens(F.col("body"))}, words, {})
    return lexical.page_of(lexical.two_tier(summaries, full), limit, offset).select(F.col("doc").alias("id"), "tier", "score")


def rule_counts(drawings: DataFrame) -> DataFrame:
    """doc, page, drawn, across, down: what is drawn, and thin strokes that run across or down (T33);
    drawings (doc, page, left, bottom, right, top, width, height)."""
    wide, high = F.col("right") - F.col("left"), F.col("top") - F.col("bottom")
    return drawings.groupBy("doc", "page").agg(
        F.count(F.lit(1)).alias("drawn"), F.count_if((high < RULE_THICKNESS) & (wide > ACROSS_SHARE * F.col("width"))).alias("across"),
        F.count_if((wide < RULE_THICKNESS) & (high > DOWN_SHARE * F.col("height"))).alias("down"),
    )


def list_pages(kinds: DataFrame) -> DataFrame:
    """doc, page of lists of figures and tables in a book's front: a page under such a heading with entries, and those that
    extend it (C15); kinds as of ``contents.page_kinds``."""
    window = F.least(F.col("pages"), F.lit(SEARCH_PAGES), F.greatest(F.lit(LEAST_SEARCH), F.bround(F.col("pages") * SEARCH_SHARE, 0).cast("int")))
    front = kinds.filter(F.col("page") < window)
    order = Window.partitionBy("doc").orderBy("page")
    opens = F.col("veto") & (F.col("entries") >= LEAST_TITLED)
    run = front.withColumn("opens_list", opens).withColumn("part", opens | (F.col("extends") & (F.lag("page").over(order) == F.col("page") - 1)))
    island = run.withColumn("g", F.sum((F.col("opens_list") | ~F.coalesce("part", F.lit(False))).cast("int")).over(order))
    led = island.withColumn("led", F.bool_or("opens_list").over(Window.partitionBy("doc", "g")))
    return led.filter("part and led").select("doc", "page")


def grouped(files: DataFrame) -> DataFrame:
    """stem, files (of chapters in the order of their numbers) of prepared books (V01); files (file)."""
    key = X.text_key_of(F.col("file"))
    rows = files.select(key["stem"].alias("stem"), key["chapter"].cast("int").alias("n"), "file").filter("n is not null")
    return rows.groupBy("stem").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "file"))), lambda x: x["file"]).alias("files"))


def rundown_paragraphs(text: Column, block_break: str = r"\n\s*\n") -> Column:
    """Paragraphs of a text's body, at least 400 characters long (H112)."""
    return folds.paragraphs(folds.body_span(text), RUNDOWN_CHARS, block_break=block_break)


def extractive_rundown(docs: DataFrame, id_col: str, paragraphs: Column, stop_words: list[str]) -> DataFrame:
    """doc, pos, sentence: the most central sentence of every paragraph, on one line."""
    each = docs.select(F.col(id_col).alias("doc"), F.posexplode(paragraphs).alias("pos", "text")).withColumn("id", F.struct("doc", "pos"))
    found = lexical.central_sentences(each, "id", F.col("text"), stop_words)
    return found.select("doc.doc", F.col("doc.pos").alias("pos"), X.collapse(F.col("sentence")).alias("sentence"))


def phrases(docs: DataFrame, id_col: str, text: Column, stop_words: list[str], k: int = PHRASES) -> DataFrame:
    """doc, phrase, n, rank: runs of one to three letter words without stop words that come back, most frequent first (X13, H111).

    A model's noun chunks are its own; where none is given, runs of words stand in.
    """
    order = Window.partitionBy("doc").orderBy("pos")
    words = docs.select(F.col(id_col).alias("doc"), F.posexplode(X.letter_tokens(text)).alias("pos", "w"))
    words = words.withColumn("w0", F.when(~F.col("w").isin(stop_words), F.col("w")))
    words = words.withColumns({f"w{n}": F.lead("w0", n).over(order) for n in range(1, PHRASE_WORDS)})
    # concat is null where a word of the run is missing or a stop word
    runs = F.array(*[F.concat(*[x for k in range(n) for x in (F.lit(" "), F.col(f"w{k}"))][1:]) for n in range(1, PHRASE_WORDS + 1)])
    each = words.select("doc", F.explode(F.array_compact(runs)).alias("phrase")).filter(F.length("phrase") >= PHRASE_CHARS)
    counted = each.groupBy("doc", "phrase").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return lexical.top(counted, ["doc"], [F.col("n").desc(), F.col("phrase")], k)


def entities(docs: DataFrame, id_col: str, text: Column, k: int = ENTITIES) -> DataFrame:
    """doc, entity, n, rank: names inside sentences by their capitals, most frequent first (X14); stands in for a model's labels."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{Ll},;] (\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)*)"), F.lit(1))
    counted = docs.select(F.col(id_col).alias("doc"), F.explode(found).alias("entity")).groupBy("doc", "entity").agg(F.count(F.lit(1)).alias("n"))
    return lexical.top(counted, ["doc"], [F.col("n").desc(), F.col("entity")], k)


def triplets(docs: DataFrame, id_col: str, text: Column, extract, k: int = TRIPLETS) -> DataFrame:
    """doc, pos, subject, verb, object by a given pandas function from texts to arrays of structs, the first thirty."""
    made = docs.select(F.col(id_col).alias("doc"), F.slice(extract(text), 1, k).alias("t"))
    return made.select("doc", F.posexplode("t").alias("pos", "t")).select("doc", "pos", "t.*")


def gold_bounds(text: Column) -> Column:
    """Array of struct(page from 0, title) of a gold file's lines, comments left out."""
    lines = F.filter(F.split(text, r"\R"), lambda x: (X.strip(x) != "") & ~F.startswith(X.strip(x), F.lit("#")) & x.rlike(r"^\s*\d+\t"))
    return F.transform(lines, lambda x: F.struct((F.regexp_extract(x, r"^\s*(\d+)\t", 1).cast("int") - 1).alias("page"), X.strip(F.regexp_extract(x, r"^\s*\d+\t(.*)$", 1)).alias("title")))


def gold_units(text: Column) -> Column:
    """Array of struct(occurrence, key) of a repair gold file's lines (H107)."""
    lines = F.filter(F.split(text, r"\R"), lambda x: x.rlike(r"^\d+\t\s*\S"))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\d+)\t", 1).cast("int").alias("occurrence"), X.strip(F.regexp_extract(x, r"^\d+\t(.*)$", 1)).alias("key")))


def tagged_lines(text: Column) -> Column:
    """Array of struct(tag, text) of a segmentation gold file: one bracketed tag a line (H105)."""
    rule = rf"^\[({'|'.join(GOLD_TAGS)})\]\s?(.*)$"
    lines = F.filter(F.split(text, r"\R"), lambda x: x.rlike(rule))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, rule, 1).alias("tag"), F.regexp_extract(x, rule, 2).alias("text")))


def graded(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc, f1 before and after a repair, and whether it got worse (E11); both (doc, f1)."""
    met = before.select("doc", F.col("f1").alias("before")).join(after.select("doc", F.col("f1").alias("after")), "doc")
    return met.withColumn("worse", F.col("after") < F.col("before"))


def line_stream(lines: DataFrame, running: DataFrame) -> DataFrame:
    """Lines to segment: not blank, no running header, no bare page number, with ``bid`` counted anew and ``blank_before``
    (E12, H100, H101). lines (doc, page, line, text, bid), running (doc, key)."""
    order = Window.partitionBy("doc").orderBy("page", "line")
    blank = X.strip(F.col("text")) == ""
    marked = lines.withColumn("blank_before", F.coalesce(F.lag(blank).over(order), F.lit(False)))
    live = marked.filter(~blank & ~X.is_page_number(F.col("text"))).withColumn("key", X.header_key(X.strip(F.col("text"))))
    kept = live.join(running.withColumn("gone", F.lit(True)), ["doc", "key"], "left").filter("gone is null").drop("gone", "key")
    new = F.lag("bid").over(order).isNull() | (F.lag("bid").over(order) != F.col("bid")) | (F.lag("page").over(order) != F.col("page"))
    return kept.withColumn("bid", F.sum(new.cast("int")).over(order) - 1)


def ocr_labels(stream: DataFrame, head: Column) -> DataFrame:
    """Lines with HEAD, PARA or CONT: a heading starts anew, as does a line after a blank one (H103)."""
    order = Window.partitionBy("doc").orderBy("page", "line")
    marked = stream.withColumn("head", head)
    fresh = F.coalesce(F.lag("head").over(order), F.lit(True)) | F.col("blank_before")
    label = F.when(F.col("head"), "HEAD").when(F.col("text").rlike(BULLET), "LIST").when(fresh, "PARA").otherwise("CONT")
    return marked.withColumn("label", label).drop("head")


def clean_pages(pages: Column) -> Column:
    """A document's pages as one text: line ends alike, soft hyphens at line ends joined, references gone (H109, H110, S31)."""
    plain = F.transform(pages, lambda p: X.strip(F.replace(F.replace(p, F.lit("\r\n"), F.lit("\n")), F.lit("￾\n"), F.lit(""))))
    return folds.strip_references(X.strip(F.array_join(F.filter(plain, lambda p: p != ""), "\n\n")))


def changed_texts(sources: DataFrame, made: DataFrame) -> DataFrame:
    """stem, changed: whether a text source is newer than its summary; scans never are (H115); sources (stem, name, modified),
    made (stem, modified)."""
    joined = sources.join(made.select("stem", F.col("modified").alias("made")), "stem", "left")
    return joined.select("stem", F.coalesce(~F.endswith(F.lower("name"), F.lit(".pdf")) & (F.col("modified") > F.col("made")), F.lit(False)).alias("changed"))


def collected(results: DataFrame, truncated: DataFrame) -> DataFrame:
    """ticket, custom_id, text, truncated over a ticket's sub-batches, the last result of each request (H118);
    results (ticket, batch, custom_id, text), truncated (custom_id)."""
    best = results.groupBy("ticket", "custom_id").agg(F.max_by("text", "batch").alias("text"))
    cut = truncated.select("custom_id").distinct().withColumn("truncated", F.lit(True))
    return best.join(cut, "custom_id", "left").select("ticket", "custom_id", "text", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def gap_briefs(question: Column, title: Column) -> Column:
    """A candidate's line in a gap check."""
    return F.concat_ws(": ", title, F.substring(question, 1, CARD_CHARS))


def suggestions(reply: Column, labels: list[str]) -> Column:
    """struct of the bullets under each label of a reply."""
    return F.struct(*[X.labelled_bullets(reply, label, [x for x in labels if x != label]).alias(label.lower().replace(" ", "_")) for label in labels])


def marked_chapters(before: Column, edited: Column) -> Column:
    """Chapters after an editor's marks, what was there before if fewer than two parts are marked."""
    parts = F.filter(F.transform(F.split(edited, r"(?im)^\s*<!--\s*chapter\s*-->\s*$"), X.strip), lambda p: p != "")
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array(before))
