"""Pages of lines: running headers, page numbers, verdicts on prepared files, and ordered elements.

Counting work is in long form over (doc, page, line, text); what decides line by line from what came before runs per
document in Python, with a document's rows as its bound.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed values.
LEAST_PAGES, LEAST_REPEATS, PAGE_SHARE = 4, 3, 0.3
EMPTY_CHARS, SHORT_CHARS, SHORT_SHARE = 250, 1200, 0.15
REFERENCE_SCORE, REFERENCE_SHARE, OVERSIZED_SHARE, OVERSIZED_CHARS = 0.55, 0.25, 0.70, 150_000
REFERENCE_LINE = r"^\s*#*\s*\(?\d{1,3}[.)]\s+\S"
CITATION = r"(?i)\(\s*(?:19|20)\d{2}[a-z]?\s*\)|,\s*(?:19|20)\d{2}\b|\bpp?\.\s*\d|\bvol\.\s*\d"
SAMPLED_PAGES, TEXT_CHARS, OCR_BELOW, BOOK_ABOVE = 24, 40, 0.10, 100
APPARATUS = {"stop_ratio": 0.18, "digit_density": 0.06, "short_share": 0.70, "caps_share": 0.30}
MARKER = r"(?i)\bISBN\b|©|Copyright\s+(?:19|20)\d{2}|Library of Congress|CIP-Titelaufnahme"
ORDINAL = r"(?i)^(?:(?:chapter|kapitel|part|teil)\s+)?(\d{1,3}|[ivxlcdm]{1,7})\b[.:)]?(?:\s|$)"
# End of fixed values.


def running_headers(lines: DataFrame, edge: int = 2) -> DataFrame:
    """doc, key of header keys that stand among the first or last ``edge`` lines of enough pages.

    A line that is both among the first and the last counts twice, as edges overlap on short pages. Documents of fewer
    than four pages have none.
    """
    page = Window.partitionBy("doc", "page")
    placed = lines.withColumn("__a", F.row_number().over(page.orderBy("line"))).withColumn("__b", F.row_number().over(page.orderBy(F.col("line").desc())))
    times = (F.col("__a") <= edge).cast("int") + (F.col("__b") <= edge).cast("int")
    keyed = placed.withColumn("key", X.header_key(F.col("text"))).withColumn("n", times)
    counts = keyed.filter("key is not null and n > 0").groupBy("doc", "key").agg(F.sum("n").alias("n"))
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    least = F.greatest(F.lit(LEAST_REPEATS), F.floor(F.col("pages") * PAGE_SHARE).cast("int"))
    return counts.join(pages.filter(F.col("pages") >= LEAST_PAGES), "doc").filter(F.col("n") >= least).select("doc", "key")


def without_headers(lines: DataFrame, edge: int = 3) -> DataFrame:
    """Lines without running headers and bare page numbers, in documents of four pages or more."""
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("__pages"))
    keyed = lines.withColumn("key", X.header_key(F.col("text")))
    kept = keyed.join(running_headers(lines, edge), ["doc", "key"], "left_anti").join(pages, "doc")
    return kept.filter((F.col("__pages") < LEAST_PAGES) | ~X.is_page_number(F.col("text"))).select(*lines.columns).unionByName(
        keyed.join(running_headers(lines, edge), ["doc", "key"], "left_semi").join(pages, "doc").filter(F.col("__pages") < LEAST_PAGES).select(*lines.columns)
    )


def statistics(lines: DataFrame) -> DataFrame:
    """doc, body (most common size by characters, the first of equals), heads (larger sizes, falling), lh."""
    chars = F.length(X.strip(F.col("text")))
    sized = lines.filter(chars > 0).withColumn("n", chars).withColumn("at", F.struct("page", "line"))
    sizes = sized.groupBy("doc", "size").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    order = Window.partitionBy("doc").orderBy(F.col("n").desc(), "at")
    body = sizes.withColumn("r", F.row_number().over(order)).filter("r = 1").select("doc", F.col("size").alias("body"))
    heads = sizes.join(body, "doc").groupBy("doc", "body").agg(F.sort_array(F.collect_list(F.when(F.col("size") > F.col("body") + 0.5, F.col("size"))), False).alias("heads"))
    height = sized.groupBy("doc").agg(F.median(F.col("y1") - F.col("y0")).alias("lh"))
    return heads.join(height, "doc")


def vocabulary(lines: DataFrame) -> DataFrame:
    """doc, word: words of two letters or more and hyphenated compounds, lower case."""
    words = F.concat(F.regexp_extract_all("text", F.lit(r"(\p{L}{2,})"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(\p{L}{2,}-\p{L}{2,})"), F.lit(1)))
    return lines.select("doc", F.explode(F.transform(words, F.lower)).alias("word")).distinct()


def is_heading(text: Column, size: Column | None = None, bold: Column | None = None, heads: Column | None = None) -> Column:
    """Heading by size, or a short section line that doesn't end like a sentence."""
    t = X.strip(text)
    short = (X.word_count(t) <= 14) & ~t.rlike(r"[.,;]$")
    caps = (t == F.upper(t)) & (t != F.lower(t))
    named = t.rlike(X.SECTION) | (caps if bold is None else (bold & caps))
    by_size = F.lit(False) if size is None else F.array_contains(heads, size)
    return (t != "") & (F.length(t) <= (120 if size is None else 160)) & (by_size | (short & named))


def heading_rank(size: Column, heads: Column) -> Column:
    """Level of a heading size, at most 4."""
    place = F.array_position(heads, size)
    return F.when(place > 0, F.least(place, F.lit(4))).when(F.size(heads) > 0, F.least(F.size(heads) + 1, F.lit(4))).otherwise(2).cast("int")


def ocr_elements(lines: DataFrame) -> DataFrame:
    """doc, pos, kind, level, text of pages without geometry: blank lines and page ends close a paragraph."""
    from . import folds

    dropped = running_headers(lines.filter(X.strip(F.col("text")) != ""), 2).withColumn("gone", F.lit(True))
    keyed = lines.withColumn("key", X.header_key(X.strip(F.col("text")))).join(dropped, ["doc", "key"], "left")
    live = keyed.filter(F.col("gone").isNull() & ((X.strip(F.col("text")) == "") | ~X.is_page_number(F.col("text"))))
    order = Window.partitionBy("doc").orderBy("page", "line")
    head, blank = is_heading(F.col("text")), X.strip(F.col("text")) == ""
    kind = live.withColumn("kind", F.when(blank, "blank").when(head, "heading").otherwise("para"))
    new = (F.col("kind") != "para") | (F.lag("kind").over(order) != "para") | (F.lag("page").over(order) != F.col("page"))
    numbered = kind.withColumn("g", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order)).filter("kind <> 'blank'")
    joined = numbered.groupBy("doc", "g", "kind").agg(F.array_sort(F.collect_list(F.struct("page", "line", X.strip(F.col("text")).alias("t")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["t"]), " ")
    items = joined.select("doc", "g", "kind", F.when(F.col("kind") == "para", X.norm(text)).otherwise(text).alias("text"))
    # paragraphs that continue each other: islands of neighbours of which each goes on from the last
    line = Window.partitionBy("doc").orderBy("g")
    goes_on = (F.col("kind") == "para") & (F.lag("kind").over(line) == "para") & folds.continues(F.lag("text").over(line), F.col("text"))
    islands = items.withColumn("i", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(line))
    merged = islands.groupBy("doc", "i").agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("g", "text"))).alias("l"))
    whole = F.aggregate(F.transform("l", lambda x: x["text"]), F.lit(""), lambda a, b: F.when(a == "", b).otherwise(X.norm(folds.concat_lines(a, b))))
    level = F.when(F.col("kind") == "heading", 2).otherwise(0)
    return merged.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("i")) - 1).alias("pos"), "kind", level.alias("level"), whole.alias("text"))


def render(elements: DataFrame) -> DataFrame:
    """doc, text: headings with #, bullets with -, blank lines between."""
    line = F.when(F.col("kind") == "heading", F.concat(F.expr("repeat('#', level)"), F.lit(" "), F.col("text"))).when(F.col("kind") == "bullet", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    listed = elements.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))).alias("l"))
    return listed.select("doc", F.concat(X.strip(F.array_join(F.transform("l", lambda x: x["t"]), "\n\n")), F.lit("\n")).alias("text"))


def table_markdown(rows: Column) -> Column:
    """Array of rows of cells as a table: cells on one line, bars as slashes, rows padded."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(X.collapse(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("/"))
    padded = F.transform(rows, lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))))
    lines = F.transform(padded, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1 << 30)), "\n")


def covering(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines with the first table of their page whose box holds their middle (T32); both by (doc, page)."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    t = tables.select("doc", "page", F.col("pos").alias("table_pos"), *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = x.between(F.col("t_x0"), F.col("t_x1")) & y.between(F.col("t_y0"), F.col("t_y1"))
    hits = lines.join(t, ["doc", "page"]).filter(inside).groupBy("doc", "page", "line").agg(F.min("table_pos").alias("table_pos"))
    return lines.join(hits, ["doc", "page", "line"], "left")


def sample_indices(n: Column) -> Column:
    """All pages of a short file, else evenly spaced ones, ends included."""
    step = (n - 1) / (SAMPLED_PAGES - 1)
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(SAMPLED_PAGES - 1)), lambda i: F.bround(i * step, 0).cast("int")))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= SAMPLED_PAGES, F.sequence(F.lit(0), n - 1)).otherwise(spread)


def route(pages: Column, fraction: Column) -> Column:
    """ocr, book or straight."""
    return F.when(fraction < OCR_BELOW, "ocr").when(pages > BOOK_ABOVE, "book").otherwise("straight")


def file_features(files: DataFrame) -> DataFrame:
    """Files (stem, idx, text) with chars, paras, ref_score and chapter_heads."""
    lines = F.split("text", "\n")
    body = F.filter(lines, lambda x: (X.strip(x) != "") & ~F.startswith(x, F.lit("#")))
    refs = F.filter(body, lambda x: x.rlike(REFERENCE_LINE) | x.rlike(CITATION))
    paras = F.filter(F.split("text", r"\n\s*\n"), lambda p: (X.strip(p) != "") & ~F.startswith(F.ltrim(p), F.lit("#")))
    heads = F.filter(lines, lambda x: F.startswith(F.ltrim(x), F.lit("#")) & X.strip(x).rlike(X.CHAPTER_HEADING))
    score = F.when(F.size(body) > 0, F.size(refs) / F.size(body)).otherwise(0.0)
    return files.withColumns({"chars": F.length(X.strip(F.col("text"))), "paras": F.size(paras), "ref_score": score, "chapter_heads": F.size(heads)})


def grade(features: DataFrame) -> DataFrame:
    """Files with share, typical and verdict in their book."""
    book = Window.partitionBy("stem")
    typical = F.coalesce(F.median(F.when(F.col("chars") >= SHORT_CHARS, F.col("chars"))).over(book), F.max("chars").over(book).cast("double"))
    total = F.sum("chars").over(book)
    share = F.col("chars") / F.when(total > 0, total).otherwise(1)
    out = features.withColumns({"typical": typical, "share": share, "lone": F.count(F.lit(1)).over(book) == 1})
    verdict = (
        F.when(F.col("chars") < EMPTY_CHARS, "reject:empty")
        .when((F.col("ref_score") >= REFERENCE_SCORE) & (F.col("share") < REFERENCE_SHARE), "reject:reference-block")
        .when((F.col("chars") < F.greatest(F.lit(SHORT_CHARS), SHORT_SHARE * F.col("typical"))) & (F.col("paras") < 3), "reject:too-short")
        .when(F.col("chapter_heads") >= 2, "flag:multiple-chapters")
        .when((F.col("lone") & (F.col("chars") >= OVERSIZED_CHARS)) | (~F.col("lone") & (F.col("share") >= OVERSIZED_SHARE)), "flag:oversized")
        .otherwise("keep")
    )
    return out.withColumn("verdict", verdict)


def renumbered(graded: DataFrame) -> DataFrame:
    """Survivors with their new file name, numbers as wide as needed but two at least."""
    kept = graded.filter(~F.startswith("verdict", F.lit("reject")))
    book = Window.partitionBy("stem")
    number = F.row_number().over(book.orderBy("idx")).cast("string")
    width = F.greatest(F.lit(2), F.length(F.count(F.lit(1)).over(book).cast("string")))
    padded = F.concat(F.expr("repeat('0', 20)"), number)
    return kept.withColumn("name", F.concat(F.lit("text_"), "stem", F.lit("_"), F.substring(padded, F.length(padded) - width + 1, width), F.lit(".md")))


def grade_counts(graded: DataFrame) -> DataFrame:
    """stem, kept, flagged, rejected."""
    starts = lambda p: F.count_if(F.startswith("verdict", F.lit(p)))
    return graded.groupBy("stem").agg(starts("keep").alias("kept"), starts("flag").alias("flagged"), starts("reject").alias("rejected"))


def folio_offset(lines: DataFrame, least: int = 10, share: float = 0.6, digits: int = 4) -> DataFrame:
    """doc, offset between page and printed number, where enough first and last lines agree.

    Printed numbers have ``digits`` digits at most, 18 at the very most; books of over 9,999 pages need more than four.
    """
    page = Window.partitionBy("doc", "page")
    live = lines.filter(X.strip(F.col("text")) != "")
    placed = live.withColumn("__a", F.row_number().over(page.orderBy("line"))).withColumn("__b", F.row_number().over(page.orderBy(F.col("line").desc())))
    times = (F.col("__a") <= 2).cast("int") + (F.col("__b") <= 2).cast("int")
    t = X.strip(F.col("text"))
    number = rf"(\d{{1,{digits}}})"
    folio = F.coalesce(F.nullif(F.regexp_extract(t, rf"^{number}\b(?:\s|$)", 1), F.lit("")), F.nullif(F.regexp_extract(t, rf"\s{number}$", 1), F.lit(""))).cast("int" if digits < 10 else "long")
    votes = placed.withColumn("n", times).withColumn("offset", F.col("page") - folio).filter("n > 0 and offset is not null")
    counts = votes.groupBy("doc", "offset").agg(F.sum("n").alias("n"), F.min(F.struct("page", "line")).alias("at"))
    order = Window.partitionBy("doc")
    best = counts.withColumn("all", F.sum("n").over(order)).withColumn("r", F.row_number().over(order.orderBy(F.col("n").desc(), "at"))).filter("r = 1")
    return best.filter((F.col("n") >= least) & (F.col("n") / F.col("all") >= share)).select("doc", "offset")


def ordinals(titles: Column) -> Column:
    """Leading numbers of titles, arabic or Roman, null where there is none."""
    token = lambda t: F.regexp_extract(X.strip(t), ORDINAL, 1)
    return F.transform(titles, lambda t: F.when(token(t).rlike(r"^\d+$"), token(t).try_cast("int")).when(token(t) != "", X.roman_value(token(t))))


def spans(bounds: DataFrame) -> DataFrame:
    """Bounds (doc, page, pages) with span: pages up to the next one."""
    return bounds.withColumn("span", F.lead("page").over(Window.partitionBy("doc").orderBy("page")).cast("long"))\
        .withColumn("span", F.coalesce("span", F.col("pages").cast("long")) - F.col("page"))


def plausible(bounds: DataFrame, most: int = 80) -> DataFrame:
    """doc, ok, note on a split into chapters."""
    s = spans(bounds).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.median("span").alias("median"), F.min("page").alias("lead"), F.max("pages").alias("pages"))
    note = (
        F.when(F.col("n") < 2, "fewer than 2 units").when(F.col("n") > most, "too many units")
        .when((F.col("n") >= 8) & (F.col("median") < 3), "over-split").when(F.col("lead") > 0.25 * F.col("pages"), "misses the start")
    )
    return s.select("doc", note.isNull().alias("ok"), F.coalesce(note, F.lit("")).alias("note"))


def chapters_by_marker(raw: Column) -> Column:
    """Parts between chapter marker lines, stripped, blank ones dropped."""
    return F.filter(F.transform(F.split(raw, r"(?im)^\s*<!--\s*chapter\s*-->\s*$"), X.strip), lambda p: p != "")


def nearest_snap(bounds: DataFrame, targets: DataFrame, window: int) -> DataFrame:
    """doc, bound, snapped: each bound moved to its nearest target in the window, unless another bound is nearer to it.

    Targets and bounds meet in buckets as wide as the window, so a bound is compared with three buckets only. The first
    bound, 0, stays.
    """
    bucket = lambda c: F.floor(F.col(c) / window)
    near = bounds.select("doc", "bound", F.explode(F.array(*[bucket("bound") + d for d in (-1, 0, 1)])).alias("b"))
    t = targets.select("doc", "target", bucket("target").alias("b"))
    met = near.join(t, ["doc", "b"]).withColumn("gap", F.abs(F.col("bound") - F.col("target"))).filter(F.col("gap") <= window)
    met = met.withColumn("least", F.min("gap").over(Window.partitionBy("doc", "target")))
    best = met.groupBy("doc", "bound").agg(F.min(F.struct("gap", "target", "least")).alias("m"))
    moves = (F.col("bound") != 0) & (F.col("m.gap") == F.col("m.least"))
    return bounds.join(best, ["doc", "bound"], "left").select("doc", "bound", F.when(moves, F.col("m.target")).otherwise(F.col("bound")).alias("snapped"))


def seam_broken(before: Column, after: Column) -> Column:
    """Whether text runs mid-sentence from one line to the next."""
    a, b = X.strip(before), X.strip(after)
    heading = F.startswith(a, F.lit("#")) | F.startswith(b, F.lit("#"))
    return (a != "") & (b != "") & ~heading & ~a.rlike("[.!?:;\"'”’)\\]…*\\d]$") & F.regexp_extract(b, r"(\p{L})", 1).rlike(r"^\p{Ll}")


def apparatus(units: DataFrame, function_words: Column) -> DataFrame:
    """Units (doc, unit, lines) with features, reasons and whether they are index, list or title pages."""
    body = F.filter(F.transform("lines", X.strip), lambda x: x != "")
    text = F.array_join("__b", "\n")
    toks = X.letter_tokens(text)
    letters = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    upper = lambda x: F.length(F.regexp_replace(x, r"[^\p{Lu}]", ""))
    n = F.size("__b")
    share = lambda part: F.when(n > 0, F.size(part) / n).otherwise(0.0)
    alnum, digits = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), F.length(F.regexp_replace(text, r"[^\p{Nd}]", ""))
    out = units.withColumn("__b", body).withColumns({
        "stop_ratio": F.when(F.size(toks) > 0, F.size(F.filter(toks, lambda t: F.array_contains(function_words, t))) / F.size(toks)).otherwise(0.0),
        "digit_density": F.when(alnum > 0, digits / alnum).otherwise(0.0),
        "short_share": share(F.filter("__b", lambda x: F.length(x) < 45)),
        "caps_share": share(F.filter("__b", lambda x: upper(x) >= 0.7 * F.greatest(F.lit(1), letters(x)))),
        "prose_lines": F.size(F.filter("__b", lambda x: F.length(x) >= 150)),
        "marker": F.exists(F.slice("__b", 1, 60), lambda x: x.rlike(MARKER)),
    })
    reasons = F.array_compact(F.array(
        F.when(F.col("stop_ratio") < APPARATUS["stop_ratio"], "low function-word share"), F.when(F.col("digit_density") >= APPARATUS["digit_density"], "digit-dense"),
        F.when(F.col("short_share") >= APPARATUS["short_share"], "list-like short lines"), F.when(F.col("caps_share") >= APPARATUS["caps_share"], "caps-heavy"),
        F.when(F.col("marker"), "ISBN/copyright markers"),
    ))
    judged = (n >= 20) & (F.col("prose_lines") < 5)
    out = out.withColumn("reasons", F.when(judged, reasons).otherwise(F.array().cast("array<string>")))
    return out.withColumn("apparatus", F.size("reasons") >= 2).drop("__b")


def char_offsets(lines: DataFrame) -> DataFrame:
    """Lines with the characters before them, line ends counted."""
    before = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))


def recurring_headings(heads: DataFrame) -> DataFrame:
    """doc, key, n, kind: headings that recur, as running heads or as template markers by their median gap.

    Rows (doc, line, offset, key, text).
    """
    order = Window.partitionBy("doc", "key").orderBy("line")
    gaps = heads.filter("key <> ''").withColumn("gap", F.col("offset") - F.lag("offset").over(order))
    g = gaps.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("n"), F.median("gap").alias("median"), F.min_by("text", "line").alias("first")).filter("n >= 3")
    kind = F.when((F.col("median") <= 5000) | X.strip(F.col("first")).rlike(ORDINAL), "running").when(F.col("median") >= 8000, "template")
    return g.withColumn("kind", kind).filter("kind is not null").select("doc", "key", "n", "kind")


def text_key(text: Column) -> Column:
    """Lower case without marks, other characters as spaces; compatibility forms need Python."""

    @F.pandas_udf("string")
    def key(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            plain = "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))
            return re.sub("[^a-z0-9]+", " ", plain).strip()

        return s.map(one)

    return key(text)


def composed(text: Column) -> Column:
    """Accents composed (NFC), which Spark has no function for."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return nfc(X.expand(text))
