"""Lines with geometry: glyphs to lines, lines to blocks, blocks to ordered elements, by windows and islands.

Glyphs: (doc, page, pos, text, x0, y0, x1, y1, size, bold, brk). Lines: (doc, page, block, line, text, x0, y0, x1, y1,
size, bold). ``line`` orders the lines of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import folds
from .pages import covering, heading_rank, is_heading, running_headers, statistics, vocabulary

# Fixed values.
GAP, INDENT, SHORT_LINE, FLUSH, OVERLAP = 0.6, 0.4, 0.20, 0.05, -0.3
BULLET = r"^(?:[•·●▪◦⁃*]|-)\s+\S"
BULLET_MARK = r"^(?:[•·●▪◦⁃*]|-)\s+"
NUMBER = r"(?i)^\(?(?:\d{1,2}|[a-z]|[ivx]{1,4})[.)]\s+\S"
MOST_RULES, LEAST_RULES, TABLE_SHARE = 5000, 3, 0.8
# End of fixed values.


def lines_from_glyphs(glyphs: DataFrame) -> DataFrame:
    """doc, page, line, text, box, size and bold of runs of glyphs between break marks.

    The size is the most common one to half a point, bold means more than 60 % of the glyphs.
    """
    order = Window.partitionBy("doc", "page").orderBy("pos")
    marked = glyphs.withColumn("line", F.sum(F.col("brk").cast("int")).over(order)).filter(~F.col("brk"))
    half = F.bround(F.col("size") * 2, 0) / 2
    sized = marked.withColumn("half", half)
    common = sized.groupBy("doc", "page", "line", "half").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    size = common.groupBy("doc", "page", "line").agg(F.max_by("half", F.struct("n", -F.col("first"))).alias("size"))
    made = sized.groupBy("doc", "page", "line").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        (F.avg(F.col("bold").cast("int")) > 0.6).alias("bold"),
    )
    return made.withColumn("text", F.array_join(F.transform("l", lambda x: x["text"]), "")).drop("l").join(size, ["doc", "page", "line"])


def blocks(lines: DataFrame, page_width: Column) -> DataFrame:
    """Lines with their block: a new one after a gap, a step back, or a move to the side."""
    order = Window.partitionBy("doc", "page").orderBy("line")
    before = lambda c: F.lag(c).over(order)
    height, gap = F.col("y1") - F.col("y0"), F.col("y0") - before("y1")
    apart = (F.col("x0") > before("x1")) | (F.col("x1") < before("x0"))
    new = before("y1").isNull() | (gap > height) | (gap < -height) | (apart & (F.abs(F.col("x0") - before("x0")) > 0.3 * page_width))
    return lines.withColumn("block", F.sum(new.cast("int")).over(order) - 1)


def block_geometry(lines: DataFrame) -> DataFrame:
    """Lines with left, right, width and line height of their block."""
    block = Window.partitionBy("doc", "page", "block")
    left, right = F.min("x0").over(block), F.max("x1").over(block)
    return lines.withColumns({"left": left, "right": right, "width": F.greatest(right - left, F.lit(1.0)), "lh": F.median(F.col("y1") - F.col("y0")).over(block)})


def breaks(before: dict[str, Column], now: dict[str, Column], left: Column, right: Column, width: Column, lh: Column) -> Column:
    """Whether a paragraph ends between two lines of a block."""
    gap = now["y0"] - before["y1"]
    ended = (before["x1"] < right - SHORT_LINE * width) & (now["x0"] <= left + FLUSH * width) & (gap >= OVERLAP * lh)
    return (gap > GAP * lh) | (now["x0"] > left + INDENT * lh) | ended


def item_starts(lines: DataFrame) -> DataFrame:
    """Lines with ``item``: bullet, or number where the block has two of them."""
    t = X.strip(F.col("text"))
    number = ~t.rlike(BULLET) & t.rlike(NUMBER)
    numbers = F.sum(number.cast("int")).over(Window.partitionBy("doc", "page", "block"))
    return lines.withColumn("item", F.when(t.rlike(BULLET), "bullet").when(number & (numbers >= 2), "number"))


def elements(lines: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """doc, pos, kind, level, text in reading order: headings, paragraphs, list items and tables.

    Lines of running headers and bare page numbers drop out. A block's lines fall into regions opened by a heading, a
    table or a list item; an item goes on until a gap, what follows is a paragraph, and paragraphs part where the
    geometry breaks. Paragraphs that go on over a block or page are joined; words that a hyphen broke are, too.
    """
    stats = statistics(lines)
    words = vocabulary(lines).groupBy("doc").agg(F.collect_set("word").alias("vocab"))
    rows = item_starts(block_geometry(lines)).join(stats.withColumnRenamed("lh", "page_lh"), "doc").join(words, "doc", "left")
    rows = rows.withColumn("lh", F.when(F.coalesce("lh", F.lit(0.0)) > 0, F.col("lh")).otherwise(F.col("page_lh")))
    keys = running_headers(lines, 2).withColumn("gone", F.lit(True))
    rows = rows.withColumn("key", X.header_key(X.strip(F.col("text")))).join(keys, ["doc", "key"], "left").filter(F.col("gone").isNull() & ~X.is_page_number(F.col("text")))
    if tables is None:
        rows = rows.withColumn("table_pos", F.lit(None).cast("int"))
    else:
        rows = covering(rows, tables)
    special = F.when(F.col("table_pos").isNotNull(), "table").when(is_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("heads")), "heading")
    rows = rows.withColumn("special", special)

    block = Window.partitionBy("doc", "page", "block").orderBy("line")
    old = {c: F.lag(c).over(block) for c in ("x1", "y1", "special", "line")}
    fresh = old["line"].isNull() | old["special"].isNotNull()  # nothing to go on from
    far = fresh | (F.col("y0") - old["y1"] > GAP * F.col("lh"))
    now = {c: F.col(c) for c in ("x0", "y0")}
    part = ~fresh & breaks(old, now, F.col("left"), F.col("right"), F.col("width"), F.col("lh"))
    opens = F.col("special").isNotNull() | F.col("item").isNotNull()
    rows = rows.withColumns({"far": far, "part": part, "opens": opens})
    rows = rows.withColumn("region", F.sum(F.col("opens").cast("int")).over(block))
    region = Window.partitionBy("doc", "page", "block", "region").orderBy("line")
    kind0 = F.first(F.coalesce("special", "item")).over(region)
    gaps = F.sum((F.col("far") & ~F.col("opens")).cast("int")).over(region)
    in_item = kind0.isin("bullet", "number") & (gaps == 0)
    kind = F.when(F.col("special").isNotNull(), F.col("special")).when(in_item, kind0).otherwise("para")
    rows = rows.withColumn("kind", kind)
    changed = F.lag("kind").over(block).isNull() | (F.lag("kind").over(block) != F.col("kind"))
    new = F.col("opens") | changed | ((F.col("kind") == "para") & F.col("part"))
    rows = rows.withColumn("segment", F.sum(new.cast("int")).over(block))
    made = rows.groupBy("doc", "page", "block", "segment", "kind").agg(
        F.array_sort(F.collect_list(F.struct("line", X.strip(F.col("text")).alias("t")))).alias("l"), F.min(F.col("line")).alias("line"), F.first("vocab").alias("vocab"),
        F.min(heading_rank(F.col("size"), F.col("heads"))).alias("rank"), F.min("table_pos").alias("table_pos"),
    )
    texts = F.filter(F.transform("l", lambda x: x["t"]), lambda t: t != "")
    joined = F.aggregate(texts, F.lit(""), lambda a, t: folds.concat_lines(a, t, F.col("vocab")))
    text = F.when(F.col("kind") == "bullet", F.regexp_replace(joined, BULLET_MARK, "")).when(F.col("kind") == "heading", F.get(texts, F.lit(0))).otherwise(joined)
    out = made.withColumn("text", X.norm(text)).withColumn("level", F.when(F.col("kind") == "heading", F.col("rank")).otherwise(0))
    if tables is not None:
        once = Window.partitionBy("doc", "page", "table_pos").orderBy("line")
        out = out.withColumn("__r", F.when(F.col("kind") == "table", F.row_number().over(once)).otherwise(1)).filter("__r = 1").drop("__r")
        out = out.join(tables.select("doc", "page", F.col("pos").alias("table_pos"), "markdown"), ["doc", "page", "table_pos"], "left")
        out = out.withColumn("text", F.when(F.col("kind") == "table", F.col("markdown")).otherwise(F.col("text")))
    book = Window.partitionBy("doc").orderBy("page", "line")
    on = (F.col("kind") == "para") & (F.lag("kind").over(book) == "para") & folds.continues(F.lag("text").over(book), F.col("text"))
    placed = out.withColumn("island", F.sum((~F.coalesce(on, F.lit(False))).cast("int")).over(book))
    merged = placed.groupBy("doc", "island").agg(F.first("kind").alias("kind"), F.min("level").alias("level"), F.array_sort(F.collect_list(F.struct("page", "line", "text"))).alias("l"))
    whole = F.aggregate(F.transform("l", lambda x: x["text"]), F.lit(""), lambda a, b: F.when(a == "", b).otherwise(X.norm(folds.concat_lines(a, b))))
    return merged.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("island")) - 1).alias("pos"), "kind", "level", whole.alias("text"))


def may_hold_table(drawn: Column, across: Column, down: Column) -> Column:
    """Whether a page's drawn rules may be a table's."""
    return (drawn <= MOST_RULES) & ((across >= LEAST_RULES) | (down >= LEAST_RULES))


def is_table(rows: Column, box_area: Column, page_area: Column) -> Column:
    """Two by two at least, and not the whole page."""
    return (F.size(rows) >= 2) & (F.array_max(F.transform(rows, F.size)) >= 2) & (box_area < TABLE_SHARE * page_area)


def labels(lines: DataFrame) -> DataFrame:
    """Lines with HEAD, PARA, CONT or LIST as the geometry tells (E01, H102)."""
    stats = statistics(lines)
    rows = item_starts(block_geometry(lines)).join(stats.withColumnRenamed("lh", "page_lh"), "doc")
    block = Window.partitionBy("doc", "page", "block").orderBy("line")
    head = is_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("heads"))
    rows = rows.withColumn("head", head)
    fresh = F.lag("line").over(block).isNull() | F.lag("head").over(block)
    old = {c: F.lag(c).over(block) for c in ("x1", "y1")}
    part = breaks(old, {c: F.col(c) for c in ("x0", "y0")}, F.col("left"), F.col("right"), F.col("width"), F.col("lh"))
    label = F.when(F.col("head"), "HEAD").when(F.col("item").isNotNull(), "LIST").when(fresh | part, "PARA").otherwise("CONT")
    return rows.withColumn("label", label).select(*lines.columns, "label")
