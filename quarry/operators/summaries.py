"""Briefs, prompts, replies and search requests as column expressions: what goes into a model call and what comes out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed values.
BRIEF_FIELDS = ["Question & context", "Empirical context", "Literature drawn on", "Methods", "Arguments", "Key conclusions", "Discussion items"]
FIELDS_MISSING = 2
SCANNED_SHARE = 0.5
MAP_FIELDS = ["Thread name", "Discussion", "Key arguments", "Key concepts", "Methods", "Empirical contexts"]
MOST_ARGUMENTS, MOST_CONCEPTS = 7, 6
# End of fixed values.


def complete_template(text: Column) -> Column:
    """A title line and all but two of a brief's field labels."""
    there = sum((F.contains(text, F.lit(f"**{f}")).cast("int") for f in BRIEF_FIELDS), F.lit(0))
    return (F.startswith(F.ltrim(text, F.lit(X.WHITE)), F.lit("## ")) | F.contains(text, F.lit("\n## "))) & (there >= len(BRIEF_FIELDS) - FIELDS_MISSING)


def pooled_text(*parts: Column) -> Column:
    """Title, question and arguments that aren't empty, joined by a space."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def match_expression(text: Column, author: Column) -> Column:
    """The text with its aliases rewritten, and the author as a phrase."""
    phrase = F.concat(F.lit('authors_raw:"'), author, F.lit('"'))
    return F.concat_ws(" AND ", F.nullif(X.field_query(text), F.lit("")), phrase)


def plain_words(text: Column, author: Column) -> Column:
    """Whether a request is words alone, without author and fields: such ones search in two tiers."""
    aliases = "|".join(X.FIELD_ALIASES)
    return (X.strip(text) != "") & (F.coalesce(author, F.lit("")) == "") & ~text.rlike(rf"\b(?:{aliases}):\S")


def labelled_field(reply: Column, label: str, stops: list[str]) -> Column:
    """Text of a bold label up to the next one, closing stars gone."""
    ahead = "".join(rf"\*\*{s}|" for s in stops)
    found = X.strip(F.regexp_extract(reply, rf"(?s)\*\*{label}:\*\*\s*(.+?)(?={ahead}\z)", 1))
    return F.regexp_replace(found, r"\s*\*+\s*$", "")


def map_reply(reply: Column, default: Column) -> Column:
    """struct(name, discussion, arguments, concepts, methods, empirical) of a thread's reply."""
    field = lambda k: labelled_field(reply, MAP_FIELDS[k], MAP_FIELDS[k + 1 :])
    bullets = lambda k, most: F.slice(F.filter(F.transform(F.split(field(k), "\n"), lambda x: X.strip(F.regexp_replace(x, r"^[-•· ]+", ""))), lambda x: x != ""), 1, most)
    return F.struct(
        F.coalesce(F.nullif(field(0), F.lit("")), default).alias("name"), field(1).alias("discussion"), bullets(2, MOST_ARGUMENTS).alias("arguments"),
        bullets(3, MOST_CONCEPTS).alias("concepts"), field(4).alias("methods"), field(5).alias("empirical"),
    )


def prompt_text(text: Column, passages: Column, budget: int) -> Column:
    """The whole text within the budget, else its first third and the selected passages."""
    opening = F.substring(text, 1, budget // 3)
    return F.when(F.length(text) <= budget, text).otherwise(F.concat_ws("\n\n", opening, F.array_join(passages, "\n\n")))


def quotes_document(sentences: Column) -> Column:
    """Quoted sentences, one a line."""
    return F.array_join(F.transform(sentences, lambda s: F.concat(F.lit('- "'), s, F.lit('"'))), "\n")


def needs_ocr(scanned: Column, pages: Column, mode: str = "auto") -> Column:
    """Whether a document's scanned pages are recognised: never, always, or if half of its pages are scanned."""
    if mode in ("off", "force"):
        return F.lit(mode == "force")
    return F.coalesce((scanned > 0) & (pages > 0) & (scanned / F.nullif(pages, F.lit(0)) >= SCANNED_SHARE), F.lit(False))


def cost_words(dollars: Column) -> Column:
    """A price in words (H149)."""
    return F.when(dollars.isNull(), "no price known").when(dollars < 0.01, "under one cent").otherwise(F.format_string("about $%.2f", dollars))


def summary_status(body: Column, truncated: Column) -> Column:
    """Why a summary call counts as failed, or ok (H114)."""
    return F.when(F.coalesce(truncated, F.lit(False)), "truncated").when(~F.coalesce(complete_template(body), F.lit(False)), "no template").otherwise("ok")


def result_row(text_path: Column, sum_path: Column) -> list[Column]:
    """has_text and has_sum of a found document."""
    there = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return [there(text_path).alias("has_text"), there(sum_path).alias("has_sum")]


def file_to_show(text_path: Column, sum_path: Column, which: Column) -> Column:
    """The asked file of a document; without a wish its summary, else its text."""
    kept = lambda c: F.nullif(c, F.lit(""))
    return F.when(which == "text", kept(text_path)).when(which == "sum", kept(sum_path)).otherwise(F.coalesce(kept(sum_path), kept(text_path)))
