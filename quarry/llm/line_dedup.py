"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

Only hashes and positions travel: the text is shuffled at most once, when positions to drop meet their document.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: The ASCII white space a key is stripped of.
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at both ends and with A-Z lower-cased; other letters stay as they are."""
    stripped = F.btrim(line, F.lit(WHITE))
    plain = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(plain, F.lower(stripped)).otherwise(
        F.translate(stripped, string.ascii_uppercase, string.ascii_lowercase)
    )


def _hashes(key: Column) -> list[Column]:
    """128 bits in two columns: the second hash is seeded by the first's constant."""
    return [F.xxhash64(key).alias("__h1"), F.xxhash64(F.lit(1), key).alias("__h2")]


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """Drop lines whose key many documents hold; the largest id that holds a key keeps its lines.

    Returns the input's columns with the text rewritten, plus ``n_lines`` and ``n_dropped`` (input columns of these
    two names are replaced). A null or empty text is one empty line. Rows that repeat an id count as one holder of a
    line; if they hold the largest id, each keeps its lines. A null id is smaller than any other and a holder, too. An
    empty table gives an empty table.
    """
    docs = docs.drop("n_lines", "n_dropped")
    given = docs.columns
    # columns of the input may have any name, so they are numbered while the operator's own stand beside them
    numbered = {c: f"__given{k}" for k, c in enumerate(given) if c != text_col}
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in numbered.items()], F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    lines = F.split("__t", "\n", -1)
    base = docs.select("__id", "__t")

    long_keys = F.array_distinct(
        F.filter(F.transform(F.split("__t", "\n", -1), line_key), lambda k: F.char_length(k) >= min_chars)
    )
    held = (
        base.select("__id", F.explode(long_keys).alias("__k"))
        .select("__id", *_hashes(F.col("__k")))
        .distinct()
        .groupBy("__h1", "__h2")
        .agg(F.count(F.lit(1)).alias("__n"), F.max("__id").alias("__keep"))
        .filter(F.col("__n") >= min_docs)
        .drop("__n")
    )
    held = cut(held)  # adaptive execution splits a frequent line only if both sides of the join come from a shuffle
    placed = (
        base.select("__id", F.xxhash64("__t").alias("__th"), F.posexplode(F.split("__t", "\n", -1)).alias("__p", "__l"))
        .filter(F.char_length("__l") >= min_chars)
        .select("__id", "__th", "__p", line_key(F.col("__l")).alias("__k"))
        .filter(F.char_length("__k") >= min_chars)
        .select("__id", "__th", "__p", *_hashes(F.col("__k")))
    )
    drops = (
        placed.join(held, ["__h1", "__h2"])
        .filter(~F.col("__id").eqNullSafe(F.col("__keep")))
        .groupBy("__id", "__th")
        .agg(F.collect_set("__p").alias("__drop"))
        .withColumnsRenamed({"__id": "__did", "__th": "__dth"})
    )
    out = docs.withColumn("__th", F.xxhash64("__t"))
    out = out.join(drops, F.col("__id").eqNullSafe(F.col("__did")) & (F.col("__th") == F.col("__dth")), "left")
    n = F.size(lines)
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__drop"))
    rebuilt = F.when(F.col("__drop").isNull(), F.col("__t")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    )
    return out.select(
        *[rebuilt.alias(c) if c == text_col else F.col(numbered[c]).alias(c) for c in given],
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
