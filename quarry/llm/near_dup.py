"""N-gram Jaccard join by MinHash banding.

Documents with equal shingle sets are one class from the start. Band and row counts follow from the target recall at
the threshold. Class representatives meet on band hashes; what meets forms candidate groups through linear chains of
edges, never all pairs. Groups are verified on full shingle sets, in blocks of bounded size, and each representative
gets its number of links; only a spanning forest of the links leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..runtime import cut
from . import rolling

#: Members and shingles of a block in verification.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 2_000_000
#: Cells of the dense incidence matrix worked on at once.
CELLS = 8_000_000


def bands_and_rows(threshold: float, recall: float, most_rows: int = 6) -> tuple[int, int]:
    """Fewest bands for the recall at the threshold, with as many rows as keeps hashes under 200."""
    for rows in range(most_rows, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= 200 or rows == 1:
            return max(1, bands), rows
    raise ValueError("no such recall")


def _signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes of non-empty sets, one line a set."""
    joined = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    rng = np.random.default_rng(5)
    out = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b, np.uint64)
        for _ in range(rows):
            factor = rng.integers(1, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            shift = rng.integers(0, 2**63, dtype=np.uint64)
            key = rolling.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((joined ^ shift) * factor, starts))
        out[:, b] = key
    return out


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set of hashes."""
    a, b = rolling.mix(s + np.uint64(1)), rolling.mix(s ^ np.uint64(0xD6E8FEB86659FD93))
    both = rolling.mix(np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64)]) + np.uint64(len(s))).view(np.int64)
    return int(both[0]), int(both[1])


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """id, node (hash of the shingle set), check (another one), size of the set, band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets = rolling.shingles(rolling.split_words([t and t.lower() for t in part.column(1).to_pylist()]), n)
                marks = [_set_hash(s) for s in sets]
                full = [s for s in sets if len(s)]
                flat = _signatures(full, bands, rows).view(np.int64).ravel() if full else np.zeros(0, np.int64)
                ends = np.cumsum([bands * bool(len(s)) for s in sets])
                offsets = pa.array(np.concatenate([[0], ends]).astype("int32"))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([m[0] for m in marks], pa.int64()),
                        pa.array([m[1] for m in marks], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(flat)),
                    ],
                    names=["id", "node", "check", "size", "bands"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"id {kind}, node long, check long, size long, bands array<long>"
    )


def _links(left: list[np.ndarray], right: list[np.ndarray], tenths: int) -> np.ndarray:
    """Which sets of the left and right are at least ``tenths`` / 1000 similar, as a matrix."""
    joined = np.concatenate([*left, *right])
    values, local = np.unique(joined, return_inverse=True)
    of = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    inner = np.zeros((len(left), len(right)), np.float64)
    order = np.argsort(local, kind="stable")
    local, of = local[order], of[order]
    width = max(1, CELLS // (len(left) + len(right)))
    for low in range(0, len(values), width):
        a, b = np.searchsorted(local, [low, low + width])
        present = np.zeros((len(left) + len(right), min(width, len(values) - low)), np.float32)
        present[of[a:b], local[a:b] - low] = 1
        inner += present[: len(left)] @ present[len(left) :].T
    size_l, size_r = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    return 1000 * inner >= tenths * (size_l[:, None] + size_r[None, :] - inner)


def _labels(linked: np.ndarray) -> np.ndarray:
    """Least index each of the symmetric matrix's rows is connected to."""
    label, n = np.arange(len(linked)), len(linked)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(frame: pd.DataFrame, tenths: int) -> list[tuple[int, int, int, int]]:
    """(node, node it is connected to, linked classes, linked documents) from one candidate group or pair of blocks."""
    frame = frame.sort_values("node")
    node, count = frame["node"].to_numpy(), frame["count"].to_numpy()
    sets = [np.asarray(s).view(np.uint64) for s in frame["set"]]
    i, j, own = frame["i"].iloc[0], frame["j"].iloc[0], frame["block"].to_numpy()
    if i == j:
        linked = _links(sets, sets, tenths)
        np.fill_diagonal(linked, False)
    else:
        linked = np.zeros((len(sets), len(sets)), bool)
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if len(a) and len(b):
            part = _links([sets[k] for k in a], [sets[k] for k in b], tenths)
            linked[np.ix_(a, b)], linked[np.ix_(b, a)] = part, part.T
    label, classes, documents = _labels(linked), linked.sum(axis=1), linked @ count
    return [(int(node[k]), int(node[label[k]]), int(classes[k]), int(documents[k])) for k in np.flatnonzero(classes)]


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9995
) -> DataFrame:
    """One row per input row: id, class_id, n_links, n_set_links, node.

    ``class_id`` is the least id among the documents that links connect, ``n_links`` the number of other documents of
    at least the threshold's Jaccard similarity, ``n_set_links`` the number of other shingle sets among them. Words are
    lower-cased and split at ASCII white space; a text of fewer than ``n`` words is one shingle. Null, empty and blank
    texts have equal (empty) sets and form one class. Rows that repeat an id are documents of their own; null ids never
    name a class unless no other id is in it. An empty table gives an empty table.
    """
    bands, rows = bands_and_rows(threshold, recall)
    signed = cut(signatures(docs, id_col, text_col, n, bands, rows))
    classes = cut(
        signed.groupBy("node", "check", "size").agg(
            F.min("id").alias("rep"), F.count(F.lit(1)).alias("count"), F.first("bands").alias("bands")
        )
    )
    banded = classes.select("node", F.explode("bands").alias("band"))
    # both sides of a join come from a shuffle or a checkpoint, so that adaptive execution can split frequent keys
    hubs = cut(banded.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"))
    met = connected_components(banded.join(hubs, "band").select("hub", "node").distinct(), "hub", "node")

    members = classes.join(met, "node").select("node", "rep", "size", "count", F.col("component").alias("comp"))
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("volume"))
    members = cut(
        members.join(
            sizes.select(
                "comp", F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("volume") / BLOCK_SHINGLES)).cast("int").alias("blocks")
            ),
            "comp",
        ).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    tenths = round(1000 * threshold)
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    texts = held.join(members, held["id"].eqNullSafe(members["rep"])).drop("id", "rep", "size")

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = rolling.shingles(rolling.split_words([t and t.lower() for t in frame.pop("t")]), n)
            own = np.array([_set_hash(s)[0] for s in found]) == frame["node"].to_numpy()
            frame["set"] = [s.view(np.int64) for s in found]
            yield frame[own].drop_duplicates("node")

    found = texts.mapInPandas(sets, "node long, count long, comp long, blocks int, block int, set array<long>")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x")
    units = max(1, -(-members.count() // 2000))
    dealt = (
        found.select("*", other)
        .withColumn("i", F.least("block", "x"))
        .withColumn("j", F.greatest("block", "x"))
        .withColumn("unit", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(units))).otherwise(F.xxhash64("comp")))
        .drop("x")
    )

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["comp", "node"])
        out = [row for _, group in frame.groupby("comp") for row in _verify(group, tenths)]
        return pd.DataFrame(out, columns=["node", "root", "classes", "documents"])

    verified = cut(dealt.groupBy("unit", "i", "j", F.col("blocks") > 1).applyInPandas(verify, "node long, root long, classes long, documents long"))
    degrees = verified.groupBy("node").agg(F.sum("classes").alias("classes"), F.sum("documents").alias("documents"))
    groups = connected_components(verified, "node", "root").join(classes.select("node", "rep"), "node")
    least = groups.groupBy("component").agg(F.min("rep").alias("least"))
    placed = classes.select("node", "check", "rep", "count").join(
        groups.select("node", "component").join(least, "component").drop("component"), "node", "left"
    ).join(degrees, "node", "left")
    return signed.select("id", "node", "check").join(cut(placed), ["node", "check"]).select(
        F.col("id").alias(id_col),
        F.coalesce("least", "rep").alias("class_id"),
        (F.coalesce("documents", F.lit(0)) + F.col("count") - 1).alias("n_links"),
        F.coalesce("classes", F.lit(0)).alias("n_set_links"),
        "node",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, columns as given: that of the least id, then of the least hash of its text.

    Null ids come last. Rows that repeat an id are told apart by their text; of rows equal in both one stays.
    """
    given = docs.columns
    key = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("hash")).alias("__key")
    # columns of the input may have any name, so they are numbered while the operator's own stand beside them
    docs = docs.select(*[F.col(f"`{c}`").alias(f"__given{k}") for k, c in enumerate(given)], key, F.col(text_col).alias("__text"))
    found = near_duplicates(docs.select("__key", "__text"), "__key", "__text", **options)
    keep = cut(found.filter("__key = class_id").groupBy(F.col("__key").alias("__keep")).agg(F.count(F.lit(1)).alias("__rows")))
    kept = docs.join(keep, F.col("__key") == F.col("__keep"))
    if keep.filter("__rows > 1").limit(1).count():
        kept = kept.filter("__rows = 1").unionByName(kept.filter("__rows > 1").dropDuplicates(["__key"]))
    return kept.select(*[F.col(f"__given{k}").alias(c) for k, c in enumerate(given)])
