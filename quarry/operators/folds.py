"""Per-row folds over a text's blocks, lines and labels, as higher-order functions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed values.
PARAGRAPH_CHARS, RUNDOWN_CHARS, MOST_CHARS = 200, 400, 1500
QUALITY_FILLERS = [
    "it is important to note", "it should be noted", "needless to say", "as mentioned above", "as noted above", "in order to",
    "due to the fact that", "at this point in time", "the fact that", "it is worth noting", "in terms of", "with regard to",
    "with respect to",
]
TRIMS = [
    (r"\bIt is (important|worth noting|clear) that\b,?\s*", ""),
    (r"\bAs (mentioned|noted|discussed) (above|previously|earlier)\b,?\s*", ""),
    (r"\bIn (terms|light) of\b", "regarding"),
    (r"\bdue to the fact that\b", "because"),
    (r"\bin order to\b", "to"),
    (r"\bat this point in time\b", "now"),
    (r"\bthe fact that\b", "that"),
    (r"\bvery (important|significant|relevant)\b", "$1"),
    (r"\bquite (important|significant|relevant)\b", "$1"),
    (r"\bbasically\b,?\s*", ""),
    (r"\bessentially\b,?\s*", ""),
    (r"\bfundamentally\b,?\s*", ""),
    (r"\boverall\b,?\s*", ""),
]
# End of fixed values.

NONE = "array<string>"


def blocks(text: Column, block_break: str = r"\n\s*\n") -> Column:
    return F.filter(F.transform(F.split(text, block_break), X.strip), lambda b: b != "")


def pack_blocks(items: Column, least: int, joint: str) -> Column:
    """struct(done, rest): blocks joined until a run has ``least`` characters; the last run may be shorter."""
    start = F.struct(F.array().cast(NONE).alias("done"), F.lit("").alias("rest"))

    def step(state: Column, block: Column) -> Column:
        grown = F.when(state["rest"] == "", block).otherwise(F.concat(state["rest"], F.lit(joint), block))
        return F.when(
            F.length(grown) >= least, F.struct(F.concat(state["done"], F.array(grown)).alias("done"), F.lit("").alias("rest"))
        ).otherwise(F.struct(state["done"].alias("done"), grown.alias("rest")))

    return F.aggregate(items, start, step)


def split_long(paragraph: Column, most: int = MOST_CHARS) -> Column:
    """A paragraph of over ``most`` characters as runs of sentences that reach that length."""
    packed = pack_blocks(X.sentences(paragraph), most, " ")
    parts = F.concat(packed["done"], F.when(packed["rest"] != "", F.array(packed["rest"])).otherwise(F.array().cast(NONE)))
    return F.when(F.length(paragraph) <= most, F.array(paragraph)).otherwise(F.when(F.size(parts) > 0, parts).otherwise(F.array(paragraph)))


def paragraphs(text: Column, least: int = PARAGRAPH_CHARS, most: int = MOST_CHARS, block_break: str = r"\n\s*\n") -> Column:
    """Blocks merged up to the least length, overlong ones split by sentences."""
    packed = pack_blocks(blocks(text, block_break), least, " ")
    every = F.concat(packed["done"], F.when(packed["rest"] != "", F.array(packed["rest"])).otherwise(F.array().cast(NONE)))
    return F.flatten(F.transform(every, lambda p: split_long(p, most)))


def passages(text: Column, least: int = PARAGRAPH_CHARS, most: int = MOST_CHARS, block_break: str = r"\n\s*\n") -> Column:
    """Blocks merged up to the least length and cut at the most; a shorter last one stays whole."""
    packed = pack_blocks(blocks(text, block_break), least, "\n\n")
    cut = F.transform(packed["done"], lambda p: F.substring(p, 1, most))
    return F.concat(cut, F.when(packed["rest"] != "", F.array(packed["rest"])).otherwise(F.array().cast(NONE)))


def body_span(text: Column) -> Column:
    """From an introduction in the first 40 % to the first closing matter in the second half."""
    at = F.regexp_instr(text, F.lit(X.INTRODUCTION))
    begin = F.when((at > 0) & (at - 1 <= F.length(text) * 0.4), at - 1).otherwise(0)
    floor = F.greatest(begin, F.floor(F.length(text) * 0.5).cast("int"))
    # the tail keeps the line end before it, so that ^ still means a line's start
    tail = F.substring(text, floor + F.lit(1), F.length(text))
    opens = (floor == 0) | (F.substring(text, floor, F.lit(1)) == "\n")
    rest = F.when(opens, tail).otherwise(F.concat(F.lit("\x00"), tail))
    hit = F.regexp_instr(rest, F.lit(X.BACK_MATTER))
    end = F.when(hit > 0, floor + hit - 1 - F.when(opens, 0).otherwise(1)).otherwise(F.length(text))
    return X.strip(F.substring(text, begin + 1, end - begin))


def strip_references(text: Column) -> Column:
    """Cut at the last heading of a reference list that starts in the second half."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("cut"))

    def step(s: Column, line: Column) -> Column:
        here = line.rlike(X.REFERENCE_HEADING) & (s["at"] >= F.length(text) * 0.5)
        return F.struct((s["at"] + F.length(line) + 1).alias("at"), F.when(here, s["at"]).otherwise(s["cut"]).alias("cut"))

    cut = F.aggregate(lines, start, step)["cut"]
    return F.when(cut > 0, F.rtrim(F.substring(text, F.lit(1), cut), F.lit(X.WHITE))).otherwise(text)


def concat_lines(text: Column, line: Column, vocabulary: Column | None = None) -> Column:
    """Two lines as one, joining a word that a hyphen broke unless the vocabulary has it hyphenated only."""
    tail = F.regexp_extract(text, r"(\p{L}{2,})-$", 1)
    lead = F.regexp_extract(F.ltrim(line), r"^(\p{L}{2,})", 1)
    rest = F.ltrim(line, F.lit(X.WHITE))
    keeps = F.lit(False)
    if vocabulary is not None:
        compound = F.lower(F.concat(tail, F.lit("-"), lead))
        keeps = (tail != "") & (lead != "") & F.array_contains(vocabulary, compound) & ~F.array_contains(vocabulary, F.lower(F.concat(tail, lead)))
    broken = text.rlike(r"\p{L}-$")
    return (
        F.when(text == "", line)
        .when(broken & keeps, F.concat(text, rest))
        .when(broken, F.concat(F.substring(text, F.lit(1), F.length(text) - 1), rest))
        .otherwise(F.concat(text, F.lit(" "), rest))
    )


def continues(a: Column, b: Column) -> Column:
    """Whether paragraph b goes on where a stopped."""
    left, right = F.rtrim(a, F.lit(X.WHITE)), F.ltrim(b, F.lit(X.WHITE))
    ended = F.contains(F.lit(X.SENTENCE_END), F.substring(left, -1, 1))
    return (left != "") & (right != "") & ~ended & right.rlike(r"^[\p{Ll}\p{Nd}(\"]")


def merge_continuations(texts: Column) -> Column:
    """Consecutive paragraphs that continue each other as one."""
    start = F.array().cast(NONE)

    def step(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = X.norm(concat_lines(last, p))
        return F.when(
            (F.size(done) > 0) & continues(F.coalesce(last, F.lit("")), p), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        ).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(texts, start, step)


def run_lengths(labels: Column) -> Column:
    """Runs of equal labels as array of struct(label, n)."""
    start = F.array().cast("array<struct<label:string,n:int>>")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        more = F.struct(x.alias("label"), (last["n"] + 1).alias("n"))
        return F.when((F.size(done) > 0) & last["label"].eqNullSafe(x), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(more))).otherwise(
            F.concat(done, F.array(F.struct(x.alias("label"), F.lit(1).alias("n"))))
        )

    return F.aggregate(labels, start, step)


def collapsed(labels: Column) -> Column:
    """``A x2, B, A``."""
    return F.array_join(F.transform(run_lengths(labels), lambda r: F.when(r["n"] > 1, F.concat(r["label"], F.lit(" x"), r["n"].cast("string"))).otherwise(r["label"])), ", ")


def pack_by_size(sizes: Column, most_count: int, most_size: int) -> Column:
    """Batch number of each size: a batch closes before it would pass either limit."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"))

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] > 0) & ((s["n"] >= most_count) | (s["sum"] + x > most_size))
        batch = s["batch"] + full.cast("int")
        return F.struct(
            F.concat(s["out"], F.array(batch)).alias("out"), batch.alias("batch"),
            F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, x).otherwise(s["sum"] + x).cast("long").alias("sum"),
        )

    return F.aggregate(sizes, start, step)["out"]


def increasing_runs(numbers: Column) -> Column:
    """Runs of rising numbers, nulls skipped."""
    start = F.array().cast("array<array<int>>")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        return F.when((F.size(done) > 0) & (x > F.try_element_at(last, F.lit(-1))), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.array(x))))).otherwise(
            F.concat(done, F.array(F.array(x)))
        )

    return F.aggregate(F.filter(numbers, lambda x: x.isNotNull()), start, step)


def missing_numbers(numbers: Column) -> Column:
    """What is left out in rising runs of three or more."""
    gaps = F.transform(F.filter(increasing_runs(numbers), lambda r: F.size(r) >= 3), lambda r: F.array_except(F.sequence(F.element_at(r, 1), F.try_element_at(r, F.lit(-1))), r))
    return F.array_sort(F.array_distinct(F.flatten(gaps)))


def inversions(numbers: Column) -> Column:
    """Share of neighbours that fall."""
    falls = F.filter(F.transform(numbers, lambda x, i: F.get(numbers, i + 1) < x), lambda f: F.coalesce(f, F.lit(False)))
    return F.when(F.size(numbers) < 2, 0.0).otherwise(F.size(falls) / (F.size(numbers) - 1))


def trim_to_target(text: Column, target: int) -> Column:
    """Filler phrases go one by one until the word count is met."""
    def shorter(pattern: str, put: str):
        cut = lambda t: X.strip(F.regexp_replace(F.regexp_replace(t, f"(?i){pattern}", put), "  +", " "))
        return lambda t: F.when(X.word_count(t) > target, cut(t)).otherwise(t)

    for pattern, put in TRIMS:
        text = X.let(text, shorter(pattern, put))
    return text


def quality_issues(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """doc, pos, type, sentence, detail: sentences of over 45 words and filler phrases."""
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text, r"(?<=[.!?])\s+")).alias("pos", "s"))
    n, shown = X.word_count(F.col("s")), F.concat(F.substring("s", 1, 80), F.lit("..."))
    long = F.when(n > 45, F.struct(F.lit("long_sentence").alias("type"), F.concat(n.cast("string"), F.lit(" words")).alias("detail")))
    fillers = [F.when(F.contains(F.lower("s"), F.lit(f)), F.struct(F.lit("filler").alias("type"), F.lit(f).alias("detail"))) for f in QUALITY_FILLERS]
    issues = rows.select("doc", "pos", shown.alias("sentence"), F.explode(F.array_compact(F.array(long, *fillers))).alias("x"))
    return issues.select("doc", "pos", "x.type", "sentence", "x.detail")


def guarded_count(text: Column) -> Column:
    """Word count with quotations guarded and put back, which changes nothing."""
    return X.word_count(text)


def quotations(text: Column) -> Column:
    """Quoted stretches in order."""
    pattern = "([“”][^“”\n]{1,600}[“”]|[‘’][^‘’\n]{1,600}[‘’]|⟪[^⟫]{1,4000}⟫)"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def snap_labels(reply: Column, vocabulary: list[str], n: Column) -> Column:
    """One label per sentence from a numbered reply, OTHER where it is unknown or missing."""
    rows = F.filter(F.split(reply, "\n"), lambda x: x.rlike(r"^\s*\d+[.)]\s*\S"))
    clean = F.transform(rows, lambda x: F.regexp_replace(F.upper(X.strip(F.regexp_replace(x, r"^\s*\d+[.)]\s*", ""))), "[ -]", "_"))
    snapped = F.transform(clean, lambda x: F.when(x.isin(vocabulary), x).otherwise("OTHER"))
    return F.slice(F.concat(snapped, F.array_repeat(F.lit("OTHER"), F.greatest(n - F.size(snapped), F.lit(0)))), F.lit(1), n)
