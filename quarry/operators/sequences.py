"""Ordered label sequences: runs, distributions, distances, bands and monotone assignment; rows are (base, pos, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MOVES = [
    "HOOK_PROBLEM", "BACKGROUND", "GAP", "THESIS_AIM", "CONTRIBUTION_PREVIEW", "ROADMAP", "LIT_POSITIONING",
    "THEORY_CONCEPT", "METHOD", "DATA_SETTING", "ANALYSIS_FINDING", "INTERPRETATION", "COUNTERPOINT_LIMITATION",
    "IMPLICATION", "FUTURE_WORK", "CONCLUSION",
]
SECTIONS = ["introduction", "literature_review", "methods", "findings", "discussion", "conclusion"]
MOVE_SECTIONS = {
    "HOOK_PROBLEM": "introduction", "GAP": "introduction", "THESIS_AIM": "introduction", "OVERVIEW": "introduction",
    "THEORY_CONCEPT": "literature_review", "THEORY_FRAMEWORK": "literature_review",
    "LITERATURE_REVIEW": "literature_review", "PRIOR_WORK": "literature_review", "SYNTHESIS": "literature_review",
    "METHOD_DESIGN": "methods", "METHOD_DATA": "methods", "METHOD_ANALYSIS": "methods", "METHOD_VALIDITY": "methods",
    "METHOD_SAMPLE": "methods", "METHOD_INSTRUMENT": "methods", "METHOD_ANALYTICAL": "methods", "METHOD": "methods",
    "DATA_COLLECTION": "methods", "DATA_ANALYSIS": "methods", "ANALYSIS_FINDING": "findings", "FINDING": "findings",
    "RESULT": "findings", "DATA_RESULT": "findings", "DATA_SETTING": "findings", "INTERPRETATION": "discussion",
    "INTERPRETATION_THEORY": "discussion", "IMPLICATION": "discussion", "COUNTERPOINT": "discussion",
    "LIMITATION": "discussion", "CONCLUSION": "conclusion", "FUTURE_WORK": "conclusion", "CLOSING": "conclusion",
}
MAJOR_SHARE, EXAMPLES = 0.10, 20
# End of fixed values.


def _order(base: str = "base"):
    return Window.partitionBy(base).orderBy("pos")


def islands(rows: DataFrame) -> DataFrame:
    """base, run, label, first, last, n of maximal runs of equal labels."""
    starts = ~F.lag("label").over(_order()).eqNullSafe(F.col("label")) | F.lag("pos").over(_order()).isNull()
    numbered = rows.withColumn("__new", starts.cast("int")).withColumn("run", F.sum("__new").over(_order()))
    return numbered.groupBy("base", "run", "label").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"))


def run_length_text(rows: DataFrame) -> DataFrame:
    """base, runs as ``A x2, B``."""
    part = F.when(F.col("n") > 1, F.concat_ws(" x", "label", F.col("n").cast("string"))).otherwise(F.col("label"))
    listed = islands(rows).groupBy("base").agg(F.array_sort(F.collect_list(F.struct("run", part.alias("t")))).alias("l"))
    return listed.select("base", F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("runs"))


def distribution(rows: DataFrame, labels: list[str]) -> DataFrame:
    """base, label, share among the known labels; labels that don't occur have none."""
    known = rows.filter(F.col("label").isin(labels)).groupBy("base", "label").agg(F.count(F.lit(1)).alias("n"))
    return known.select("base", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("base"))).alias("share"))


def skeleton_distribution(stages: DataFrame, labels: list[str]) -> DataFrame:
    """skeleton, label, share from (skeleton, label, typical_share) rows."""
    known = stages.filter(F.col("label").isin(labels)).groupBy("skeleton", "label").agg(F.sum(F.coalesce("typical_share", F.lit(0.0))).alias("n"))
    total = F.sum("n").over(Window.partitionBy("skeleton"))
    return known.filter("n > 0").select("skeleton", "label", (F.col("n") / total).alias("share"))


def hellinger_nearest(papers: DataFrame, skeletons: DataFrame, bases: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """skeleton, base, distance, rank: the k papers nearest to each skeleton.

    The square of the distance is |p| + |q| - 2 sum sqrt(p q), so only shared labels are joined. Skeletons are few, and
    their list is checked before it is spread.
    """
    total = lambda d, key, name: d.groupBy(key).agg(F.sum("share").alias(name))
    names = [r[0] for r in skeletons.select("skeleton").distinct().limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("too many skeletons to compare with every paper")
    each = bases.select("base", F.explode(F.array(*[F.lit(n) for n in names])).alias("skeleton")) if names else bases.select("base", F.lit(None).alias("skeleton")).limit(0)
    shared = papers.join(F.broadcast(skeletons.withColumnRenamed("share", "q")), "label")
    common = shared.groupBy("base", "skeleton").agg(F.sum(F.sqrt(F.col("share") * F.col("q"))).alias("common"))
    joined = each.join(common, ["base", "skeleton"], "left").join(total(papers, "base", "p"), "base", "left").join(F.broadcast(total(skeletons, "skeleton", "q")), "skeleton", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    squared = zero(F.col("p")) + zero(F.col("q")) - 2 * zero(F.col("common"))
    scored = joined.select("skeleton", "base", F.sqrt(F.greatest(squared, F.lit(0.0))).alias("distance"))
    order = Window.partitionBy("skeleton").orderBy(F.round("distance", 6), "base")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exclusive_quantile(sorted_values: Column, quarter: int) -> Column:
    """Quartile by the (n + 1) p rule, which differs from the inclusive percentile."""
    n = F.size(sorted_values)
    place = (n + 1) * quarter / 4
    low = F.greatest(F.lit(1), F.least(F.floor(place).cast("int"), n - 1))
    a, b = F.get(sorted_values, low - 1), F.get(sorted_values, low)
    return a + (place - low) * (b - a)


def length_band(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, low, high: quartiles of run lengths, at least 1, halves to even; least and most of fewer than four.

    Lengths are counted per value before they are gathered, so a group's list is as long as its distinct lengths.
    """
    counted = runs.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("times"))
    listed = counted.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", "times"))).alias("l"))
    # (distinct length, number of runs up to and with it)
    upto = F.aggregate(
        "l", F.array().cast("array<struct<n:bigint,upto:bigint>>"),
        lambda acc, x: F.concat(acc, F.array(F.struct(x["n"].cast("bigint").alias("n"), (F.coalesce(F.try_element_at(acc, F.lit(-1))["upto"], F.lit(0)) + x["times"]).cast("bigint").alias("upto")))),
    )
    made = listed.select(*by, upto.alias("u")).withColumn("total", F.try_element_at("u", F.lit(-1))["upto"])
    nth = lambda k: F.get(F.filter("u", lambda x: x["upto"] >= k), F.lit(0))["n"]

    def quartile(q: int) -> Column:
        place = (F.col("total") + 1) * q / 4
        low = F.greatest(F.lit(1), F.least(F.floor(place), F.col("total") - 1))
        return F.greatest(F.lit(1.0), F.bround(nth(low) + (place - low) * (nth(low + 1) - nth(low)), 0)).cast("long")

    few = F.col("total") < 4
    return made.select(*by, F.when(few, nth(F.lit(1))).otherwise(quartile(1)).alias("low"), F.when(few, nth(F.col("total"))).otherwise(quartile(3)).alias("high"))


def section_of(move: Column) -> Column:
    """Section of the first known move that the normalised one starts with."""
    plain = F.btrim(F.regexp_replace(F.upper(move), "[^A-Z0-9]+", "_"), F.lit("_"))
    out = None
    for key, section in MOVE_SECTIONS.items():
        hit = F.startswith(plain, F.lit(key))
        out = F.when(hit, section) if out is None else out.when(hit, section)
    return out.otherwise("findings")


def monotone(rows: DataFrame, section: Column, by: str = "base") -> DataFrame:
    """Rows with ``assigned``: the section's number never falls along the plan."""
    number = F.coalesce(F.array_position(F.array(*map(F.lit, SECTIONS)), section), F.lit(0)) - 1
    number = F.when(number < 0, SECTIONS.index("findings")).otherwise(number)
    upto = Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("assigned", F.max(number.cast("int")).over(upto))


def major_moves(stages: DataFrame, floor: float = MAJOR_SHARE) -> DataFrame:
    """skeleton, label, intent, typical_share: the first stage by share of each move over the floor."""
    order = Window.partitionBy("skeleton", "label").orderBy(F.col("typical_share").desc(), "pos")
    return stages.filter(F.col("typical_share") >= floor).withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def paired(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(base, pos, text, label) where both have the position."""
    return texts.join(labels, ["base", "pos"])


def gathered(pairs: DataFrame) -> DataFrame:
    """base, label, run, texts in order of each maximal run."""
    starts = ~F.lag("label").over(_order()).eqNullSafe(F.col("label")) | F.lag("pos").over(_order()).isNull()
    numbered = pairs.withColumn("__new", starts.cast("int")).withColumn("run", F.sum("__new").over(_order()))
    listed = numbered.groupBy("base", "run", "label").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"))
    return listed.select("base", "run", "label", F.transform("l", lambda x: x["text"]).alias("texts"))


def budgeted_sample(rows: DataFrame, size: Column, budget: int, seed: int = 0, key: str = "base") -> DataFrame:
    """Whole table if it fits the budget, else the share of rows that the mean size allows, by a hash order."""
    sized = rows.withColumn("__size", size)
    total = sized.agg(F.sum("__size").alias("all"), F.count(F.lit(1)).alias("n")).first()
    if (total["all"] or 0) <= budget:
        return rows
    keep = max(1, int(budget // (total["all"] / total["n"])))
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(keep)


def last_turns(turns: DataFrame, k: int = 6, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last k rows of each conversation."""
    back = Window.partitionBy(by).orderBy(F.col(order).desc())
    return turns.withColumn("__r", F.row_number().over(back)).filter(F.col("__r") <= k).drop("__r")


def chunks(rows: DataFrame, size: int = 15, by: str = "doc", order: str = "pos") -> DataFrame:
    """by, chunk, items: consecutive rows in groups of ``size``."""
    listed = rows.groupBy(by, F.floor(F.col(order) / size).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("l"))
    return listed.select(by, "chunk", F.transform("l", lambda x: x["text"]).alias("items"))
