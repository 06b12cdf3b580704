"""Printed contents pages: rows of lines, entries with page numbers, and which pages hold them.

Lines as in ``layout``; ``pages`` has (doc, page, width, pages). Rows depend on what came before them on the page only, so
a page is the unit of the one Python step; the rest is columns and windows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import folds

# Fixed values.
LEAST_ROWS, LEAST_TITLED, LEAST_MORE, DENSITY, RIGHT_BAND, MOST_INVERSIONS = 5, 3, 4, 0.40, 0.15, 0.30
SEARCH_PAGES, SEARCH_SHARE, LEAST_SEARCH = 40, 0.1, 6
INLINE = r"^(.{3,}?)(?:(?:[.·․…] ?){2,}|\s{2,})(\S{1,7})$"
LOOSE = r"^(\S.{2,}?)\s+(\S{1,7})\s*$"
VETO = r"(?i)^(?:list of (?:figures|tables|illustrations|maps|plates)|(?:abbildungs|tabellen)verzeichnis)\b"
TOC_WORDS = ["contents", "table of contents", "inhalt", "inhaltsverzeichnis"]
# End of fixed values.

ROWS = "row int, texts array<string>, x0 double, x1 double, bold boolean"


def _same_row(frame: pd.DataFrame) -> list[int]:
    """Row number of each line, lines sorted by top, then left: it joins the last row if half of the lower height overlaps."""
    out, top, bottom = [], 0.0, -1.0
    for y0, y1 in zip(frame["y0"], frame["y1"]):
        low = min(bottom - top, y1 - y0)
        if out and low > 0 and min(bottom, y1) - max(top, y0) >= 0.5 * low:
            out.append(out[-1])
            top, bottom = min(top, y0), max(bottom, y1)
        else:
            out.append(out[-1] + 1 if out else 0)
            top, bottom = y0, y1
    return out


def rows(lines: DataFrame) -> DataFrame:
    """doc, page, row, texts (of its lines from left to right), text, x0, x1, bold."""
    kind = lines.schema["doc"].dataType.simpleString()

    def assemble(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y0", "x0"], kind="stable")
        frame = frame.assign(row=_same_row(frame), n=frame["text"].str.strip().str.len()).sort_values(["row", "x0"], kind="stable")
        made = [
            (g["doc"].iloc[0], int(g["page"].iloc[0]), int(r), g["text"].tolist(), float(g["x0"].iloc[0]), float(g["x1"].max()), bool(g.loc[g["bold"], "n"].sum() > 0.5 * g["n"].sum()))
            for r, g in frame.groupby("row")
        ]
        return pd.DataFrame(made, columns=["doc", "page", "row", "texts", "x0", "x1", "bold"])

    live = lines.filter(X.strip(F.col("text")) != "").select("doc", "page", "text", "x0", "y0", "x1", "y1", "bold")
    found = live.groupBy("doc", "page").applyInPandas(assemble, f"doc {kind}, page int, {ROWS}")
    return found.withColumn("text", X.norm(F.array_join("texts", " ")))


def entries(page_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows with title, no and roman where they are entries (C10 to C12): strict ones if three, else loose ones that rise."""
    page = Window.partitionBy("doc", "page")
    r = page_rows.join(pages.select("doc", "page", "width", "pages"), ["doc", "page"]).withColumn("edge", F.max("x1").over(page))
    right = F.col("x1") >= F.col("edge") - RIGHT_BAND * F.col("width")
    many = F.size("texts") > 1
    last = X.page_number(F.element_at("texts", -1))
    led = F.coalesce(F.try_element_at("texts", F.lit(-2)).rlike(X.LEADER), F.lit(False))
    head = X.strip(F.regexp_replace(X.norm(F.array_join(F.slice("texts", F.lit(1), F.size("texts") - 1), " ")), X.LEADER, ""))
    column = F.when(many & last.isNotNull() & (right | led) & (head != ""), F.struct(head.alias("title"), last["no"].alias("no"), last["roman"].alias("roman")))
    inline = X.page_number(F.regexp_extract("text", INLINE, 2))
    within = F.when(F.col("text").rlike(INLINE) & right & inline.isNotNull(), F.struct(X.strip(F.regexp_extract("text", INLINE, 1)).alias("title"), inline["no"].alias("no"), inline["roman"].alias("roman")))
    free = X.page_number(F.regexp_extract("text", LOOSE, 2))
    fits = F.col("text").rlike(LOOSE) & free.isNotNull() & (free["roman"] | (free["no"] <= F.greatest(2 * F.col("pages"), F.lit(400))))
    loose = F.when(fits, F.struct(X.strip(F.regexp_extract("text", LOOSE, 1)).alias("title"), free["no"].alias("no"), free["roman"].alias("roman")))
    marked = r.withColumn("strict", F.coalesce(column, within)).withColumn("loose", loose)
    arabic = F.array_sort(F.collect_list(F.when(F.col("loose").isNotNull() & ~F.col("loose.roman"), F.struct("row", "loose.no"))).over(page))
    counted = marked.withColumns({"n_strict": F.count("strict").over(page), "n_loose": F.count("loose").over(page), "falls": folds.inversions(F.transform(arabic, lambda x: x["no"]))})
    use_loose = (F.col("n_strict") < LEAST_TITLED) & (F.col("n_loose") >= LEAST_ROWS) & (F.col("falls") <= MOST_INVERSIONS)
    chosen = counted.withColumn("e", F.when(use_loose, F.col("loose")).otherwise(F.col("strict")))
    return chosen.select("doc", "page", "row", "text", "x0", "bold", "pages", F.col("e.title").alias("title"), F.col("e.no").alias("no"), F.col("e.roman").alias("roman"))


def page_kinds(found: DataFrame, words: list[str] | None = None) -> DataFrame:
    """doc, page, opens, extends, veto: whether a page may open or extend the contents, or lists figures."""
    first = F.col("row") < 4
    e = F.count("no")
    stats = found.groupBy("doc", "page", "pages").agg(
        e.alias("entries"), F.count(F.lit(1)).alias("rows"), F.bool_or(first & F.lower("text").isin(words or TOC_WORDS)).alias("titled"), F.bool_or(first & F.col("text").rlike(VETO)).alias("veto")
    )
    dense = (F.col("entries") >= DENSITY * F.col("rows")) & ~F.col("veto")
    least = F.when(F.col("titled"), LEAST_TITLED).otherwise(LEAST_ROWS)
    return stats.select("doc", "page", "pages", "veto", "entries", (dense & (F.col("entries") >= least)).alias("opens"), (dense & (F.col("entries") >= LEAST_MORE)).alias("extends"))


def contents_pages(kinds: DataFrame) -> DataFrame:
    """doc, page of the printed contents: the first page of the front that opens them, and those after it that extend them (C14)."""
    window = F.least(F.col("pages"), F.lit(SEARCH_PAGES), F.greatest(F.lit(LEAST_SEARCH), F.bround(F.col("pages") * SEARCH_SHARE, 0).cast("int")))
    first = kinds.filter(F.col("opens") & (F.col("page") < window)).groupBy("doc").agg(F.min("page").alias("first"))
    after = kinds.join(first, "doc").filter(F.col("page") >= F.col("first"))
    order = Window.partitionBy("doc").orderBy("page")
    run = after.withColumn("gap", (F.col("page") > F.col("first")) & (~F.col("extends") | (F.lag("page").over(order) != F.col("page") - 1)))
    return run.withColumn("gaps", F.sum(F.col("gap").cast("int")).over(order)).filter("gaps = 0").select("doc", "page")


def carried(found: DataFrame, pages: DataFrame, words: list[str] | None = None) -> DataFrame:
    """doc, pos, title, no, roman, bold of the contents' entries; rows without a number open the next title."""
    t = F.lower("text")
    toc = words or TOC_WORDS
    rest = F.filter(F.split(t, " "), lambda w: ~w.isin(toc) & ~w.rlike(r"^\d{1,4}$") & (w != ""))
    live = found.join(pages, ["doc", "page"], "left_semi").filter(~t.isin(toc) & (F.size(rest) > 0))
    order = Window.partitionBy("doc").orderBy("page", "row")
    ends = live.withColumn("g", F.coalesce(F.sum(F.col("no").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    listed = ends.groupBy("doc", "g").agg(
        F.array_sort(F.collect_list(F.struct("page", "row", F.coalesce("title", "text").alias("t")))).alias("l"), F.max("no").alias("no"), F.max(F.col("roman")).alias("roman"),
        F.max(F.when(F.col("no").isNotNull(), F.col("bold"))).alias("bold"),
    )
    title = X.norm(F.array_join(F.transform("l", lambda x: x["t"]), " "))
    return listed.filter("no is not null").select("doc", F.col("g").cast("int").alias("pos"), title.alias("title"), "no", "roman", "bold")
