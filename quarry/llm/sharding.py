"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows fall into logical partitions by a hash. How many rows go from each partition to each shard is drawn exactly:
the rows of a partition are a sample without replacement from the shards' free places, so the matrix of counts is
multivariate hypergeometric. Then rows are permuted locally, exchanged, and permuted again. Only counts, a number
bounded by ``max_partitions`` * shards, reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Exact draw of how many of each partition's rows go to each shard; row sums ``counts``, column sums ``sizes``."""
    rng, free = np.random.default_rng(seed), np.asarray(sizes, dtype=np.int64)
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, n in enumerate(counts):
        out[p] = _draw(rng, free, n)
        free = free - out[p]
    return out


def _draw(rng: np.random.Generator, free: np.ndarray, n: int) -> np.ndarray:
    """One multivariate hypergeometric draw, a shard at a time."""
    out, left = np.zeros_like(free), n
    for s in range(len(free) - 1):
        out[s] = hypergeometric(rng, int(free[s]), int(free[s + 1 :].sum()), left)
        left -= int(out[s])
    out[-1] = left
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good; numpy's sampler, and a ratio of uniforms beyond its range."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total, low, m = good + bad, min(good, bad), min(n, good + bad - n)
    share = low / total
    spread = math.sqrt(m * share * (1 - share) * (total - m) / (total - 1) + 0.5)
    centre, width = m * share + 0.5, 1.7155277699214135 * spread + 0.8989161620588988
    mode = (m + 1) * (low + 1) // (total + 2)
    top, peak = min(min(m, low) + 1, int(centre + 16 * spread)), _log_ways(mode, low, total - low, m)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        x = centre + width * (v - 0.5) / u
        if 0 <= x < top and 2 * math.log(u) <= peak - _log_ways(int(x), low, total - low, m):
            k = int(x) if good == low else m - int(x)
            return k if m == n else good - k


def _log_ways(k: int, low: int, high: int, m: int) -> float:
    """Minus the log weight of k, up to a constant."""
    return math.lgamma(k + 1) + math.lgamma(low - k + 1) + math.lgamma(m - k + 1) + math.lgamma(high - m + k + 1)


def shard_rows(
    df: DataFrame,
    shards: int = 16,
    seed: int = 7,
    id_col: str = "doc_id",
    rows_per_partition: int = 25_000,
    max_partitions: int = 65_536,
) -> DataFrame:
    """Every row with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard); shard sizes differ by one at most.

    All columns pass through (``shard`` and ``slot`` of the input are replaced). The order is decided by hashes of the
    whole row with the seed, so a lost executor's rows come out the same. Equal rows are interchangeable. Nulls and
    repeated ids are ordinary rows. An empty table gives an empty table.
    """
    df = df.drop("shard", "slot")
    content = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    total = df.count()
    parts = int(min(max_partitions, max(1, -(-total // rows_per_partition))))
    keyed = df.withColumn("__c", content).withColumn(
        "__p", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("__c")), F.lit(parts)).cast("int")
    )
    found = {r["__p"]: r["n"] for r in keyed.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [found.get(p, 0) for p in range(parts)]
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    ends = np.cumsum(communication_matrix(counts, sizes, seed), axis=1)
    # 65,536 partitions of 16 shards are 8 MB at most
    bounds = df.sparkSession.createDataFrame([(p, [int(x) for x in ends[p]]) for p in range(parts)], "__p int, __ends array<long>")

    local = Window.partitionBy("__p").orderBy(F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col("__c")), F.col(id_col), F.col("__c"))
    placed = keyed.withColumn("__r", F.row_number().over(local).cast("long") - 1).join(F.broadcast(bounds), "__p")
    shard = F.size(F.filter("__ends", lambda e: e <= F.col("__r"))).cast("int")
    cells = max(1, -(-total // (shards * rows_per_partition)))
    cell = F.pmod(F.shiftrightunsigned(F.col("__h"), 20), F.lit(cells))
    placed = (
        placed.withColumn("shard", shard)
        .withColumn("__h", F.xxhash64(F.lit(seed + 2), F.col(id_col), F.col("__c")))
        .withColumn("__cell", cell.cast("int"))
        .drop("__p", "__r", "__ends")
    )
    placed = cut(placed)
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "__cell")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy("shard", "__cell").orderBy("__h", F.col(id_col), "__c")
    return (
        placed.withColumn("__r", F.row_number().over(inside).cast("long") - 1)
        .join(starts, ["shard", "__cell"])
        .withColumn("slot", F.col("__start") + F.col("__r"))
        .drop("__c", "__h", "__cell", "__r", "__start")
    )
