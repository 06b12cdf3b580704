"""Column functions over text: normalisation, tokens, sentences, names, identifiers.

Everything here is a JVM-side expression. Patterns, tables and limits marked "fixed values" define the results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
INVISIBLE = "[­​‌‍﻿]"
PAGE_NUMBER = r"(?i)^\s*(?:\d{1,4}|[ivxlcdm]{1,6})\s*$"
REFERENCE_HEADING = (
    r"(?i)^\s*#*\s*(?:\d+\.?\s*)?(references|bibliography|works cited|literature cited|reference list)\s*$"
)
SECTION = (
    r"(?i)^(?:\d+(?:\.\d+){0,3}\.?\s+\S|(?:chapter|section|part)\s+(?:\d+|[ivxlcdm]+)\b|abstract|introduction|background"
    r"|related work|methods?|methodology|materials and methods|results?|discussion|conclusions?|summary)\b"
)
KEPT_SECTION = (
    r"(?i)^\s*(?:\d+\.?\s*)?(abstract|introduction|background|related work|method|methods|methodology"
    r"|materials and methods|results|findings|discussion|conclusion|conclusions)\b"
)
INTRODUCTION = r"(?im)^\s*(?:\d+\.?\s*|[ivx]+\.?\s*)?introduction\b"
BACK_MATTER = (
    r"(?im)^\s*(?:\d+\.?\s*)?(acknowledge?ments?|appendix|appendices|notes?|endnotes?|funding|conflicts? of interest"
    r"|competing interests?|author contributions?|declarations?|disclosure statement|supplementary( material)?"
    r"|about the authors?|author biograph(y|ies)|biographical notes?|orcid)\b"
)
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9])"
QUOTABLE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])"
CUE_TERMS = (
    "argue contribution contributions propose hypothesis research question method methods approach data dataset sample "
    "analysis results findings conclude conclusion discussion implications limitations framework theory evidence "
    "demonstrate significant"
).split()
DOI = r"(?i)\b10\.\d{4,9}/[^\s\"<>]+"
DOI_TRAILING = ".,;:)]}'"
DOI_CHARACTERS, DOIS_TRIED = 8000, 5
SENTENCE_END = ".?!:’‘”“)\"'"
PIECE_CHARS, MOST_PIECES = 5000, 40
FIELD_ALIASES = {
    "author": "authors_raw", "title": "title", "context": "question_context", "empirical": "empirical_context",
    "lit": "literature", "methods": "methods", "arguments": "arguments", "conclusions": "conclusions",
    "discussion": "discussion",
}
# End of fixed values.

WHITE = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """The body with the value worked out once, however often it uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def expand(c: Column) -> Column:
    """Ligatures as letters, invisible characters gone (T01, without accent composition; see ``functions.unicode``)."""
    for ligature, plain in LIGATURES.items():
        c = F.replace(c, F.lit(ligature), F.lit(plain))
    return F.regexp_replace(c, INVISIBLE, "")


def norm(c: Column) -> Column:
    return collapse(expand(c))


def loose(c: Column) -> Column:
    """Lower case with white space collapsed, for containment tests."""
    return F.lower(collapse(c))


def verify_quote(quote: Column, source: Column) -> Column:
    return F.contains(loose(source), loose(quote))


def header_key(c: Column) -> Column:
    key = F.regexp_replace(F.lower(c), "[^a-z]", "")
    return F.when(F.length(key) >= 5, key)


def is_page_number(c: Column) -> Column:
    return c.rlike(PAGE_NUMBER)


def word_list(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(word_list(c))


def search_tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: w != "")


def letter_tokens(c: Column) -> Column:
    """Runs of letters of any script, lower case."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+)"), F.lit(1)), F.lower)


def name_words(c: Column) -> Column:
    """Words longer than two characters, lower case, of letters and digits of any script."""
    spaced = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.trim(spaced), " +"), lambda w: F.length(w) > 2)


def title_share(wanted: Column, found: Column) -> Column:
    """Share of the wanted title's words in the found one, split words included."""
    words, there = name_words(wanted), name_words(found)
    joined = F.array_join(there, "")
    hit = F.filter(words, lambda w: F.array_contains(there, w) | F.contains(joined, w))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.size(hit) / F.size(words))


def same_title(a: Column, b: Column) -> Column:
    return F.greatest(title_share(a, b), title_share(b, a))


def has_author(work: Column, names: Column) -> Column:
    """First surname of ``Authors_Title`` among an array of names."""
    first = F.get(name_words(F.substring_index(work, "_", 1)), F.lit(0))
    return F.when(first.isNull(), F.lit(True)).otherwise(F.contains(F.array_join(name_words(F.array_join(names, " ")), ""), first))


def own_dois(c: Column) -> Column:
    """Distinct identifiers of the first characters, in order."""
    found = F.regexp_extract_all(F.substring(c, 1, DOI_CHARACTERS), F.lit(f"({DOI})"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(found, lambda d: F.lower(F.rtrim(d, F.lit(DOI_TRAILING))))), 1, DOIS_TRIED)


def sentences(c: Column, pattern: str = SENTENCE_BREAK) -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip), lambda s: s != "")


def looks_noisy(s: Column) -> Column:
    """Footnotes, logs, headers and citation dumps."""
    digits = F.length(s) - F.length(F.regexp_replace(s, r"\p{Nd}", ""))
    return (
        ~F.coalesce(s.rlike(r"^\p{Lu}"), F.lit(False))
        | ~s.rlike("[.!?\"'”’]$")
        | (digits / F.length(s) > 0.06)
        | s.rlike(r"\b\d{4}\.\d{1,3}\b")
        | s.rlike(r"\bInterviews?\b")
        | (F.regexp_count(s, F.lit(r"\b(?:19|20)\d\d\b")) >= 3)
    )


def quotable(c: Column, least: int = 8, most: int = 60) -> Column:
    """Candidate sentences in order: words joined over line ends, one line each, of fair length, not noisy."""
    joined = F.transform(
        sentences(c, QUOTABLE_BREAK), lambda s: collapse(F.regexp_replace(s, r"(?<=[a-z])-\s*\n\s*(?=[a-z])", ""))
    )
    return F.filter(joined, lambda s: word_count(s).between(least, most) & ~looks_noisy(s))


def stem_of(name: Column) -> Column:
    """File name without its suffix, and without ``text_`` for prepared texts."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    prepared = name.rlike(r"(?i)\.(md|markdown|txt)$") & F.startswith(stem, F.lit("text_"))
    return F.when(prepared, F.substring(stem, 6, 1 << 30)).otherwise(stem)


def split_chapter(stem: Column) -> Column:
    """struct(stem, chapter) by two or three closing digits."""
    rule = r"(?s)^(.+)_(\d{2,3})$"
    hit = stem.rlike(rule)
    return F.struct(
        F.when(hit, F.regexp_extract(stem, rule, 1)).otherwise(stem).alias("stem"),
        F.when(hit, F.regexp_extract(stem, rule, 2)).alias("chapter"),
    )


def summary_key(name: Column) -> Column:
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return split_chapter(F.when(F.startswith(stem, F.lit("sum_")), F.substring(stem, 5, 1 << 30)).otherwise(stem))


def text_key_of(name: Column) -> Column:
    return split_chapter(stem_of(name))


def work_of(base: Column) -> Column:
    """The work of a chapter: any closing digits, if the head still has an underscore."""
    return F.when(base.rlike(r"^.*_.*_\d+$"), F.regexp_replace(base, r"_\d+$", "")).otherwise(base)


def book_of(stem: Column) -> Column:
    """The book of a two- or three-digit chapter, else empty."""
    return F.when(stem.rlike(r"^.+_\d{2,3}$"), F.regexp_replace(stem, r"_\d{2,3}$", "")).otherwise(F.lit(""))


def authors_of(stem: Column) -> Column:
    return F.substring_index(stem, "_", 1)


def title_after(stem: Column) -> Column:
    return F.when(F.contains(stem, F.lit("_")), F.regexp_replace(stem, r"^[^_]*_", "")).otherwise(F.lit(""))


def last_component(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def title_from_text(text: Column) -> Column:
    """First line that isn't blank, without leading #."""
    line = F.get(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), F.lit(0))
    return strip(F.ltrim(line, F.lit("#")))


def title_from_summary(text: Column) -> Column:
    """First # line among the first six."""
    line = F.get(F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 6), strip), lambda x: F.startswith(x, F.lit("#"))), F.lit(0))
    return strip(F.ltrim(line, F.lit("#")))


def has_template(text: Column) -> Column:
    return F.startswith(text, F.lit("## ")) | F.contains(text, F.lit("\n## "))


def label(title: Column) -> Column:
    return F.when(F.length(title) > 60, F.concat(F.substring(title, 1, 57), F.lit("..."))).otherwise(title)


def slug(name: Column) -> Column:
    made = F.substring(F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_")), 1, 40)
    return F.when(made == "", F.lit("map")).otherwise(made)


def gist(text: Column, most: int = 260) -> Column:
    """Cut at the last space before the limit, with an ellipsis (H136)."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r" [^ ]*\z", ""), F.lit("…")))


def name_key(c: Column) -> Column:
    """Dashes alike, white space collapsed, lower case, no closing dots."""
    return F.rtrim(F.lower(collapse(F.regexp_replace(c, "[—–]", "-"))), F.lit("."))


def work_key(authors: Column, title: Column) -> Column:
    return F.concat_ws(" - ", F.lower(strip(authors)), F.lower(strip(title)))


def size_words(n: Column) -> Column:
    """Bytes, KB rounded up, or MB with one decimal, halves to even (H142)."""
    return (
        F.when(n < 1024, F.format_string("%d bytes", n))
        .when(n < 1024 * 1024, F.format_string("%d KB", F.ceil(n / 1024)))
        .otherwise(F.format_string("%.1f MB", F.bround(n / (1024 * 1024), 1)))
    )


def pieces_of(text: Column) -> Column:
    """Windows of characters, stripped, blank ones dropped, the first forty."""
    last = F.greatest(F.ceil(F.length(text) / PIECE_CHARS) - 1, F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(text, i * PIECE_CHARS + 1, F.lit(PIECE_CHARS))))
    return F.slice(F.filter(cut, lambda p: p != ""), 1, MOST_PIECES)


def brief_text(title: Column, question: Column, arguments: Column, conclusions: Column) -> Column:
    """What is embedded of a brief."""
    parts = [F.nullif(c, F.lit("")) for c in (title, question, arguments, conclusions)]
    return F.substring(F.concat_ws("\n\n", *parts), 1, 5000)


def short_brief_chars(record: dict[str, Column]) -> Column:
    whole = sum((F.length(record[k]) for k in ("authors", "title", "question")), F.lit(0))
    return whole + F.least(F.lit(500), F.length(record["arguments"])) + F.least(F.lit(300), F.length(record["conclusions"]))


def field_query(text: Column) -> Column:
    """``alias:term`` becomes ``column:term``."""
    out = F.trim(text)
    for alias, column in FIELD_ALIASES.items():
        out = F.regexp_replace(out, rf"\b{alias}:(?=\S)", f"{column}:") if alias != column else out
    return out


def field_terms(name: str, text: Column) -> Column:
    """``field:word`` for each word of two characters or more."""
    words = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), " "), lambda w: F.length(w) > 1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit(f"{name}:"), w)), " ")


def snippet_parts(snippet: Column) -> Column:
    """Plain and bracketed pieces in order, as struct(text, matched)."""
    pieces = F.regexp_extract_all(snippet, F.lit(r"(\[[^\]]*\]|[^\[]+)"), F.lit(1))
    bracketed = lambda p: F.startswith(p, F.lit("[")) & F.endswith(p, F.lit("]"))
    return F.transform(pieces, lambda p: F.struct(F.when(bracketed(p), F.btrim(p, F.lit("[]"))).otherwise(p).alias("text"), bracketed(p).alias("matched")))


def try_int(c: Column) -> Column:
    """Blank, NULL and malformed numbers become null."""
    return strip(null_text(c)).try_cast("int")


def try_double(c: Column, default: float | None = None) -> Column:
    found = strip(null_text(c)).try_cast("double")
    return found if default is None else F.coalesce(found, F.lit(default))


def null_text(c: Column) -> Column:
    """Empty, NULL and null become null (ingest coercion)."""
    return F.when(~c.isin("", "NULL", "null"), c)


# Fixed values.
ROMAN = "(?i)^[ivxlcdm]+$"
LEADER = r"(?:[.·․…] ?){2,}\s*$"
# End of fixed values.


def roman_value(token: Column) -> Column:
    """Subtractive value of a Roman numeral."""
    letters = F.split(F.lower(token), "")
    value = F.create_map(*[F.lit(x) for pair in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000)) for x in pair])
    numbers = F.transform(letters, lambda x: F.element_at(value, x))
    signed = F.transform(numbers, lambda v, i: F.when(v < F.coalesce(F.get(numbers, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(token.rlike(ROMAN), F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def page_number(token: Column) -> Column:
    """struct(no, roman) of a page token, with letters that scanning confuses with digits repaired; null if none."""
    plain = F.btrim(strip(F.regexp_replace(token, LEADER, "")), F.lit("()[]"))
    repaired = F.replace(F.translate(plain, "Il|OoSsB", "11100558"), F.lit(" "), F.lit(""))
    found = lambda c, roman: F.struct(c.alias("no"), F.lit(roman).alias("roman"))
    return (
        F.when(plain.rlike(r"^\d{1,4}$"), found(plain.try_cast("int"), False))
        .when(plain.rlike(r"(?i)^[ivxlcdm]{1,7}$"), found(roman_value(plain), True))
        .when(repaired.rlike(r"^\d{1,4}$") & plain.rlike(r"\d"), found(repaired.try_cast("int"), False))
    )


# Fixed values.
NUMBER_WORDS = (
    r"(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:[-\s](?:one|two|three|four|five|six|seven|eight|nine))?"
    r"|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
    r"|one|two|three|four|five|six|seven|eight|nine"
    r"|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth|thirteenth|fourteenth|fifteenth|sixteenth"
    r"|seventeenth|eighteenth|nineteenth|twentieth"
)
PART = r"(?i)^(?:part|teil|unit)\b"
DOTTED = r"^(\d{1,3}(?:\.\d{1,3}){0,3})[.:)]?\s"
ORDINAL_TITLE = r"(?i)^(?:(?:chapter|kapitel)\s+\S|[ivxlcdm]{1,7}[.:)]?\s|(?:" + NUMBER_WORDS + r")[.:)]?\s)"
CHAPTER_HEADING = r"(?i)^\s*#*\s*(?:chapter|kapitel|part|teil)\s+(?:\d{1,3}|[ivxlcdm]+|" + NUMBER_WORDS + r")\b"
# End of fixed values.


def numbered_depth(title: Column) -> Column:
    """Level that a heading's numbering gives: part 0, dots + 1 up to 3, chapter ordinals 1, else null."""
    t = strip(title)
    number = F.regexp_extract(t, DOTTED, 1)
    return F.when(t.rlike(PART), 0).when(number != "", F.least(F.size(F.split(number, r"\.")), F.lit(3))).when(t.rlike(ORDINAL_TITLE), 1)


def numbered_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def bullet_items(reply: Column) -> Column:
    """Numbered lines of a reply, or all lines that aren't blank if none is numbered."""
    lines = F.filter(F.transform(F.split(reply, "\n"), strip), lambda x: x != "")
    numbered = F.filter(lines, lambda x: x.rlike(r"^\d+[.)]\s*\S"))
    return F.when(F.size(numbered) > 0, F.transform(numbered, lambda x: F.regexp_replace(x, r"^\d+[.)]\s*", ""))).otherwise(lines)


def labelled_bullets(reply: Column, name: str, stops: list[str]) -> Column:
    """Bullets between a bold label and the next one, without ``none``."""
    stop = "|".join(stops)
    body = F.regexp_extract(reply, rf"(?s)\*\*{name}:?\*\*:?(.*?)(?=\*\*(?:{stop}):?\*\*|$)", 1)
    lines = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(strip(x), r"^[-*•]\s*", ""))
    return F.filter(lines, lambda x: (x != "") & (F.lower(F.rtrim(x, F.lit("."))) != "none"))


def cost_tokens(chars: Column) -> Column:
    return F.ceil(chars / 3)


def heading_level(line: Column) -> Column:
    return F.when(line.rlike(r"^#{1,6}\s*\S"), F.length(F.regexp_extract(line, "^(#{1,6})", 1)))


def title_like(text: Column) -> Column:
    """Short, no closing punctuation, first letter not lower case."""
    first = F.regexp_extract(text, r"(\p{L})", 1)
    return (F.length(text) <= 60) & (text != "") & ~text.rlike(r"[.,;:!?]$") & ~first.rlike(r"\p{Ll}")


def letter_or_digit_tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores of any script, lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
