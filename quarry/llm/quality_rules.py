"""Quality rules whose cutoffs adapt to each language and source.

Each document's signals become integers (parts per thousand). A quantile sketch per language and source counts them in
log-linear bins: a value keeps its ``PRECISION`` leading bits, so a quantile is off by under 1/32 of itself. Bins add
up, so sketches merge in any order with map-side combine, and a group with too few documents takes the merged sketch
of its language, or of everything. Fences around the quartiles take the place of fixed cutoffs; slim rows of signals
are joined with them and filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..runtime import cut

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Leading bits that a bin keeps.
PRECISION = 6
#: Rule: (signal, which side of the fence fails, least distance of the fence from the quartile in parts per thousand).
RULES = {
    "symbols": ("upper", 150),
    "word_length": ("both", 1200),
    "dup_lines": ("upper", 400),
    "repeats": ("upper", 400),
}
#: Fences lie so many interquartile ranges beyond the quartiles.
REACH = 3
#: A group of fewer documents takes the merged sketch of its language, then of everything.
LEAST_DOCS = 200


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def words_of(text: Column) -> Column:
    """Array of the maximal runs free of ASCII white space."""
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+", -1))


def let(value: Column, body) -> Column:
    """The body with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more in the array.

    Windows become 64-bit hashes. Few distinct repeated hashes are looked up one by one; many are found by sorting
    hashes with their positions. The length of the union of [p, p + 3) over the repeated positions p is the sum of
    min(3, gap to the next one).
    """
    n = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def positions(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k + 1))))
        few = lambda t: F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(t, x), i)), lambda i: i.isNotNull())
        return let(twice, lambda t: F.when(F.size(t) <= 16, few(t)).otherwise(_sorted_positions(h)))

    covered = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(positions(h), _union_length)),
    )
    return F.when(n < 4, F.lit(0)).otherwise(covered).cast("long")


def _sorted_positions(hashes: Column) -> Column:
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marked(r: Column) -> Column:
        twin = lambda x, k: (x["h"] == F.get(r, k - 1)["h"]) | (x["h"] == F.get(r, k + 1)["h"])
        return F.filter(F.transform(r, lambda x, k: F.when(twin(x, k), x["i"])), lambda p: p.isNotNull())

    return let(ranked, lambda r: F.sort_array(marked(r)))


def _union_length(at: Column) -> Column:
    steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def base_signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns given plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_word_lines (long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.withColumn("__t", text).withColumn("__w", words_of(F.col("__t")))
    held = held.withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    t = F.col("__t")
    white = F.octet_length(t) - F.octet_length(_without(t, WHITE))
    return held.select(
        "*",
        F.size("__w").cast("long").alias("n_words"),
        (F.char_length(t) - white).cast("long").alias("word_chars"),
        (F.octet_length(t) - F.octet_length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__w")).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_word_lines"),
    ).drop("__t", "__w", "__l")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _signals() -> dict[str, Column]:
    """Parts per thousand of words or lines; a document that passes the base has words and lines."""
    return {
        "symbols": F.expr("1000 * n_symbols div n_words"),
        "word_length": F.expr("1000 * word_chars div n_words"),
        "dup_lines": F.expr("1000 * n_dup_lines div n_word_lines"),
        "repeats": F.expr("1000 * n_repeat_words div n_words"),
    }


def sketch(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule, bin, n of rows with a map ``v`` of rule to value; sketches of parts merge by adding n."""
    shift = "greatest(length(bin(value)) - {p}, 0)".format(p=PRECISION)
    return (
        values.select(*keys, F.explode("v").alias("rule", "value"))
        .select(*keys, "rule", F.expr(f"shiftleft(shiftright(value, {shift}), {shift})").alias("bin"))
        .groupBy(*keys, "rule", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merged(bins: DataFrame, keys: list[str]) -> DataFrame:
    """The same sketch for fewer keys."""
    return bins.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))


def quartiles(bins: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule, docs, q25, q75: the lower edge of the bin that holds the quantile."""
    group = Window.partitionBy(*keys, "rule")
    ranked = bins.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("docs", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("docs") * q, F.col("bin")))
    return ranked.groupBy(*keys, "rule").agg(F.max("docs").alias("docs"), at(25).alias("q25"), at(75).alias("q75"))


def thresholds(values: DataFrame, lang: str, source: str) -> DataFrame:
    """lang, source, fences: map of rule to struct(low, high)."""
    own = sketch(values, [lang, source])
    by_lang = merged(own, [lang])
    fine = quartiles(own, [lang, source])
    mid = quartiles(by_lang, [lang]).withColumnsRenamed({lang: "__l", "rule": "__r", "docs": "docs1", "q25": "q25_1", "q75": "q75_1"})
    top = quartiles(merged(by_lang, []), []).withColumnsRenamed({"rule": "__r2", "docs": "docs2", "q25": "q25_2", "q75": "q75_2"})
    joined = fine.join(mid, fine[lang].eqNullSafe(F.col("__l")) & (fine["rule"] == F.col("__r"))).join(
        top, fine["rule"] == F.col("__r2")
    )
    pick = lambda q: F.when(F.col("docs") >= LEAST_DOCS, F.col(q)).when(F.col("docs1") >= LEAST_DOCS, F.col(f"{q}_1")).otherwise(F.col(f"{q}_2"))
    sides = F.create_map(*[x for r, (side, _) in RULES.items() for x in (F.lit(r), F.lit(side))])
    slack = F.create_map(*[x for r, (_, least) in RULES.items() for x in (F.lit(r), F.lit(least))])
    a, b = pick("q25"), pick("q75")
    reach = REACH * (b - a) + F.element_at(slack, F.col("rule"))
    fence = F.struct(
        F.when(F.element_at(sides, F.col("rule")) == "both", a - reach).alias("low"), (b + reach).alias("high")
    )
    return joined.groupBy(lang, source).agg(F.map_from_entries(F.collect_list(F.struct("rule", fence))).alias("fences"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One slim row per document: id, text hash, lang, source, base signals, base_failed, kept and failed rules.

    Null text has no words and fails the base. Null languages and sources are groups like any other. Rows that repeat
    an id are judged one by one. A document fails a rule beyond the fence of its group, never on it. The sketches hold
    the documents that pass the base. An empty table gives an empty table.
    """
    slim = base_signals(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(lang_col).alias("lang"),
            F.col(source_col).alias("source"),
            F.col(text_col).alias("text"),
        )
    )
    slim = slim.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).drop("text")
    slim = cut(slim.withColumn("base_failed", base_failed()))
    signals = F.create_map(*[x for rule, value in _signals().items() for x in (F.lit(rule), value)])
    values = slim.filter(~F.col("base_failed")).withColumn("v", signals)
    cuts = thresholds(values, "lang", "source").withColumnsRenamed({"lang": "__lang", "source": "__source"})
    met = slim.withColumn("v", F.when(~F.col("base_failed"), signals)).join(
        cuts, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left"
    )

    def beyond(rule: str) -> Column:
        v, f = F.col("v")[rule], F.col("fences")[rule]
        return F.when((v > f["high"]) | (v < f["low"]), F.lit(rule))

    failed = F.array_compact(F.array(*[beyond(r) for r in RULES]))
    met = met.withColumn("failed_rules", F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(failed))
    return met.withColumn("kept", F.size("failed_rules") == 0).drop("v", "fences", "__lang", "__source")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The documents that the rules keep, columns as given."""
    good = judge(docs, id_col, text_col, **columns).filter("kept").select(F.col("doc_id").alias("__did"), F.col("text_hash").alias("__dth"))
    hashed = docs.withColumn("__th", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return hashed.join(
        good, hashed[id_col].eqNullSafe(F.col("__did")) & (F.col("__th") == F.col("__dth")), "left_semi"
    ).drop("__th")
