"""Segmentation scores: boundary F1, Pk, WindowDiff, tolerant matching; rows are (doc, pos, gold, pred)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
BOUNDARY, DROP, PAGE_TOLERANCE, LINE_TOLERANCE = ("HEAD", "PARA", "LIST"), "DROP", 1, 3
# End of fixed values.


def kept(rows: DataFrame) -> DataFrame:
    """Rows without dropped gold lines, with ``i`` from 0 and boundary and segment-end flags of both sides."""
    order = Window.partitionBy("doc").orderBy("pos")
    out = rows.filter(F.col("gold") != DROP).withColumn("i", F.row_number().over(order) - 1)
    for side in ("gold", "pred"):
        bound = F.col(side).isin(*BOUNDARY)
        out = out.withColumn(f"{side}_b", bound & (F.col("i") > 0)).withColumn(f"{side}_end", F.coalesce(F.lead(bound).over(order), F.lit(True)).cast("int"))
    return out


def share(a: Column, b: Column, empty: float = 1.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def boundary_scores(rows: DataFrame) -> DataFrame:
    """doc, lines, junk, gold_boundaries, pred_boundaries, precision, recall, f1, over_seg, under_seg, type_acc, pk, windowdiff."""
    flagged = kept(rows)
    both = F.col("gold_b") & F.col("pred_b")
    counts = flagged.groupBy("doc").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("gold_b").alias("gold_boundaries"), F.count_if("pred_b").alias("pred_boundaries"),
        F.count_if(both).alias("tp"), F.count_if(both & (F.col("gold") == F.col("pred"))).alias("typed"), F.sum("gold_end").alias("segments"),
    )
    junk = rows.groupBy("doc").agg(F.count_if(F.col("gold") == DROP).alias("junk"))
    k = F.greatest(F.lit(2), F.bround(F.col("lines") / (2 * F.greatest("segments", F.lit(1))), 0).cast("int"))
    counts = counts.withColumn("k", k)
    windows = _window_errors(flagged, counts.select("doc", "lines", "k"))
    scored = junk.join(counts, "doc", "left").join(windows, "doc", "left").na.fill(0)
    p, r = share(F.col("tp"), F.col("pred_boundaries")), share(F.col("tp"), F.col("gold_boundaries"))
    return scored.select(
        "doc", "lines", "junk", "gold_boundaries", "pred_boundaries", p.alias("precision"), r.alias("recall"),
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), (F.col("pred_boundaries") - F.col("tp")).alias("over_seg"),
        (F.col("gold_boundaries") - F.col("tp")).alias("under_seg"), share(F.col("typed"), F.col("tp")).alias("type_acc"), "k",
        share(F.col("pk_errors"), F.col("windows"), 0.0).alias("pk"), share(F.col("wd_errors"), F.col("windows"), 0.0).alias("windowdiff"),
    )


def _window_errors(flagged: DataFrame, sizes: DataFrame) -> DataFrame:
    """Disagreements over the n - k windows of k ends: prefix sums joined at i and i + k, as k differs by document."""
    upto = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    sums = flagged.select("doc", "i", *[F.coalesce(F.sum(f"{s}_end").over(upto), F.lit(0)).alias(s) for s in ("gold", "pred")])
    starts = sums.join(sizes, "doc").filter(F.col("i") < F.col("lines") - F.col("k")).withColumn("j", F.col("i") + F.col("k"))
    ends = sums.select("doc", F.col("i").alias("j"), F.col("gold").alias("gold_j"), F.col("pred").alias("pred_j"))
    g, p = F.col("gold_j") - F.col("gold"), F.col("pred_j") - F.col("pred")
    return starts.join(ends, ["doc", "j"]).groupBy("doc").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if((g > 0) != (p > 0)).alias("pk_errors"), F.count_if(g != p).alias("wd_errors")
    )


def match_within(gold: list[int], pred: list[int], tolerance: int) -> list[tuple[int, int]]:
    """Each gold position in order takes the nearest free prediction, the lower one of two equally near."""
    free, pairs = sorted(pred), []
    for g in sorted(gold):
        near = [p for p in free if abs(p - g) <= tolerance]
        if near:
            best = min(near, key=lambda p: (abs(p - g), p))
            free.remove(best)
            pairs.append((g, best))
    return pairs


def tolerant_scores(gold: DataFrame, pred: DataFrame, tolerance: int = PAGE_TOLERANCE) -> DataFrame:
    """doc, n_gold, n_pred, precision, recall, f1, exact, over, under from (doc, at) rows (E06); greedy, so by document in Python."""
    listed = lambda d, name: d.groupBy("doc").agg(F.array_sort(F.collect_list(F.col("at").cast("long"))).alias(name))
    none = F.array().cast("array<long>")
    both = listed(gold, "gold").join(listed(pred, "pred"), "doc", "full_outer").select("doc", F.coalesce("gold", none).alias("gold"), F.coalesce("pred", none).alias("pred"))

    @F.pandas_udf("struct<tp long, exact long>")
    def matched(g: pd.Series, p: pd.Series) -> pd.DataFrame:
        pairs = [match_within(list(a), list(b), tolerance) for a, b in zip(g, p)]
        return pd.DataFrame({"tp": [len(x) for x in pairs], "exact": [sum(a == b for a, b in x) for x in pairs]})

    m = both.withColumn("m", matched("gold", "pred"))
    tp, n_gold, n_pred = F.col("m.tp"), F.size("gold"), F.size("pred")
    p, r = share(tp, n_pred), share(tp, n_gold)
    return m.select(
        "doc", n_gold.alias("n_gold"), n_pred.alias("n_pred"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        share(F.col("m.exact"), tp, 0.0).alias("exact"), (n_pred - tp).alias("over"), (n_gold - tp).alias("under"),
    )


def overall(scores: DataFrame) -> DataFrame:
    """files, mean F1 and exact share, sums of over and under; zeros without scores (H108)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scores.agg(
        F.count(F.lit(1)).alias("files"), zero(F.avg("f1")).alias("f1"), zero(F.avg("exact")).alias("exact"), F.coalesce(F.sum("over"), F.lit(0)).alias("over"), F.coalesce(F.sum("under"), F.lit(0)).alias("under")
    )


def overall_boundaries(scores: DataFrame) -> DataFrame:
    """Mean F1, median Pk and WindowDiff, sums of the rest."""
    return scores.agg(
        F.count(F.lit(1)).alias("files"), F.avg("f1").alias("f1"), F.median("pk").alias("pk"), F.median("windowdiff").alias("windowdiff"),
        F.sum("lines").alias("lines"), F.sum("junk").alias("junk"), F.sum("over_seg").alias("over_seg"), F.sum("under_seg").alias("under_seg"),
    )


def pages_of(spec: Column) -> Column:
    """``1-4,9`` as sorted page numbers from 0; null for no spec."""
    parts = F.filter(F.split(spec, ","), lambda p: F.trim(p) != "")
    ends = F.transform(parts, lambda p: F.split(F.trim(p), "-"))
    each = F.transform(ends, lambda e: F.sequence(F.get(e, F.lit(0)).cast("int") - 1, F.element_at(e, -1).cast("int") - 1))
    return F.when(F.coalesce(F.trim(spec), F.lit("")) != "", F.array_sort(F.array_distinct(F.flatten(each))))


def locate(gold: DataFrame, lines: DataFrame) -> DataFrame:
    """gold rows (doc, key, occurrence) with the line where the key stands for the n-th time."""
    nth = F.row_number().over(Window.partitionBy("doc", "key").orderBy("line"))
    return gold.join(lines.withColumn("occurrence", nth), ["doc", "key", "occurrence"], "left")


def occurrences(lines: DataFrame) -> DataFrame:
    """Lines with the number of times their key has stood so far (H106)."""
    return lines.withColumn("occurrence", F.row_number().over(Window.partitionBy("doc", "key").orderBy("line")))
