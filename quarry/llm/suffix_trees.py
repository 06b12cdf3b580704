"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix starts at every word, and its first ``min_words`` words are its path to the node that tells a repeat: what
passes a node and isn't its first occurrence is a later copy, and longer repeats are covered by the suffixes that start
inside them. Suffixes are split by prefixes: each goes to the winnowed anchor of its path, which follows from the path's
words, so that equal paths always meet. Neighbouring suffixes that share an anchor travel as one run, and runs equal in all their
words are one. A group that fits in memory is built into a tree from the top: each step splits the suffixes of a node by
their next words, and the nodes left at full depth with two leaves or more are the repeats. The prefix of a group that
doesn't fit is lengthened to the whole path, where a node is an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import step
from . import rolling
from .license_scan import _joined, _steps, those_in

#: Words of a suffix that are compared; runs that a group should hold at most, and contexts of an anchor beyond which its prefix grows.
DEPTH, GROUP_SUFFIXES = 50, 20_000
#: Shares of a path's words at which a tree's nodes are split.
LEVELS = (0.04, 0.16, 0.5, 1.0)
#: Words of a gram that can be an anchor.
GRAM = 16


def anchored(hashes: np.ndarray, first: np.ndarray, min_words: int) -> dict[str, np.ndarray]:
    """of (document), mark, context and run of all suffixes of documents whose words lie between offsets ``first``."""
    found: dict[str, list[np.ndarray]] = {"of": [], "mark": [], "context": [], "run": []}
    for held in rolling.blocks(np.diff(first).tolist(), min_words):
        cuts = [hashes[first[k] + a : first[k] + b] for k, a, b in held]
        runs = rolling.anchor_runs(np.concatenate(cuts), np.concatenate([[0], np.cumsum([len(c) for c in cuts])]), min(GRAM, min_words), min_words)
        shift = np.array([a for _, a, _ in held])[runs["part"]]
        found["of"].append(np.array([k for k, _, _ in held])[runs["part"]])
        found["mark"].append(runs["mark"].view(np.int64))
        found["context"].append(runs["context"].view(np.int64))
        found["run"].append(rolling.pack_run(*(runs[x] + shift for x in ("low", "anchor", "high"))))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in found.items()}


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def suffix_runs(base: DataFrame, min_words: int) -> DataFrame:
    """row, twin, id, mark, context, run of the suffixes of (row, twin, id, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            found = anchored(*rolling.word_hashes(rolling.split_words(part.column(3).to_pylist())), min_words)
            of = pa.array(found["of"])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k).take(of) for k in range(3)), *(pa.array(found[x]) for x in ("mark", "context", "run"))],
                names=["row", "twin", "id", "mark", "context", "run"],
            )

    return base.mapInArrow(find, f"row long, twin int, id {base.schema['id'].dataType.simpleString()}, mark long, context long, run long")


def counted(base: DataFrame) -> DataFrame:
    """row, twin, id, n_words of (row, twin, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            n = [len(w) for w in rolling.split_words(part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(n, pa.int64())], names=["row", "twin", "id", "n_words"])

    return base.mapInArrow(run, f"row long, twin int, id {base.schema['id'].dataType.simpleString()}, n_words long")


def deep_nodes(words: np.ndarray, start: np.ndarray, node: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes (indexes into ``start``) below inner nodes of ``depth`` words, and their nodes, node by node.

    The tree is built from the top: ``node`` has each suffix's subtree to begin with. A node is split by its suffixes'
    next words; a child with one suffix is a leaf and goes no deeper.
    """
    alive, above, labels = np.arange(len(start)), 0, rolling.Stretches(words)
    for below in sorted({max(1, round(depth * x)) for x in LEVELS}):
        label = labels.hash(start[alive] + above, start[alive] + below)
        order = np.lexsort((label, node))
        alive, node, label = alive[order], node[order], label[order]
        new = np.ones(len(alive), bool)
        new[1:] = (node[1:] != node[:-1]) | (label[1:] != label[:-1])
        inner = ~(new & np.append(new[1:], True))
        alive, node, above = alive[inner], np.cumsum(new)[inner], below
    return alive, node


def later_copies(node: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether another suffix of the node has a smaller rank."""
    order = np.lexsort((rank, node))
    told = np.zeros(len(node), bool)
    told[order[1:]] = node[order[1:]] == node[order[:-1]]
    return told


def remove_later(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = DEPTH) -> DataFrame:
    """One row per input row: id, n_words, n_removed, n_spans and spans (of words) of passages that repeat earlier ones.

    Words stand between ASCII white space. A word goes if it lies in ``min_words`` consecutive words of its document
    that also start earlier, in the same document or another one; the first occurrence by id, then position, stays.
    A null or empty text has no words. Null ids come first. Rows that repeat an id are documents of their own, ordered
    by a hash of the text; rows equal in id and text are one document. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [F.xxhash64(F.col(id_col), text).alias("row"), F.hash(F.col(id_col), text).alias("twin")]  # 96 bits tell rows apart
    base = docs.select(*key, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    found = suffix_runs(base, min_words)
    # within a document and context runs are ordered as their first words are
    order = F.struct("id", "row", "twin", "run")
    # both sides of a join come from a shuffle or a checkpoint, so that adaptive execution can split frequent anchors
    shared = step(found.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark"))
    met = step(found.join(shared, "mark"))
    classes = step(met.groupBy("mark", "context").agg(F.min(order).alias("first")))
    low, high = F.shiftright("run", 24), F.shiftright("run", 24) + F.col("run").bitwiseAND(4095)
    settled = met.join(classes, ["mark", "context"]).filter(order != F.col("first")).select("row", "twin", low.alias("a"), (high + min_words).alias("b"))
    settled = step(_merged(settled))

    part = classes.groupBy("mark").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
    part = step(part.select("mark", (F.col("contexts") > GROUP_SUFFIXES).alias("hot")))
    open_runs = step(classes.join(part, "mark").select("first.row", "first.twin", "first.run", "mark", "hot"))
    cells = open_runs.groupBy(F.col("row").alias("__row"), F.col("twin").alias("__twin")).agg(F.collect_list(F.struct("mark", "run", "hot")).alias("runs"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _slices(batches, 256):
            hashes, first = rolling.word_hashes(rolling.split_words(piece.column(3).to_pylist()))
            runs = piece.column(4)
            of, _ = _steps(runs.value_lengths().to_numpy().astype(np.int64))
            flat = runs.flatten()
            a, _, b = rolling.unpack_run(flat.field("run").to_numpy())
            n = b - a + min_words
            words = hashes[np.repeat(first[of] + a, n) + _steps(n)[1]]
            held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype("int32")), pa.array(words.view(np.int64)))
            own = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(k).take(own) for k in range(3)), flat.field("mark"), flat.field("hot"), pa.array(a), held],
                names=["row", "twin", "id", "mark", "hot", "low", "words"],
            )

    same = (F.col("row") == F.col("__row")) & (F.col("twin") == F.col("__twin"))
    together = those_in(base, open_runs.select("row")).join(cells, same).select("row", "twin", "id", "text", "runs")
    cut_out = together.mapInArrow(contexts, f"row long, twin int, id {kind}, mark long, hot boolean, low long, words array<long>")

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        # a row that stands twice in the table gives its runs twice
        keep = np.unique(np.stack([whole.column(c).to_numpy() for c in ("row", "twin", "low")]), axis=1, return_index=True)[1]
        whole = whole.take(pa.array(keep)).combine_chunks()
        row, twin, low = (whole.column(c).to_numpy() for c in ("row", "twin", "low"))
        ids = whole.column("id").to_pandas()
        known = ids.notna().to_numpy()
        by = np.lexsort([low, twin, row, ids.where(known, ids[known].min() if known.any() else 0).to_numpy(), known])
        rank = np.empty(len(row), np.int64)
        rank[by] = np.arange(len(row))
        lists = whole.column("words").chunk(0)
        first = lists.offsets.to_numpy().astype(np.int64)
        of, at = _steps(np.diff(first) - min_words + 1)
        group = np.unique(whole.column("mark").to_numpy(), return_inverse=True)[1]
        leaves, node = deep_nodes(lists.values.to_numpy().view(np.uint64), first[of] + at, group[of], min_words)
        told = leaves[later_copies(node, rank[of[leaves]])]
        who, a, b = _joined(of[told], low[of[told]] + at[told], min_words)
        yield pa.RecordBatch.from_arrays([pa.array(row[who]), pa.array(twin[who]), pa.array(a), pa.array(b)], names=["row", "twin", "a", "b"])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _slices(batches, 10_000):
            held = piece.column("words")
            first = held.offsets.to_numpy().astype(np.int64)
            of, at = _steps(np.diff(first) - min_words + 1)
            path = rolling.Stretches(held.values.to_numpy().view(np.uint64)).hash(first[of] + at, first[of] + at + min_words)
            own = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c).take(own) for c in ("row", "twin", "id")), pa.array(piece.column("low").to_numpy()[of] + at), pa.array(path.view(np.int64))],
                names=["row", "twin", "id", "a", "path"],
            )

    units = max(1, -(-open_runs.filter("not hot").count() // GROUP_SUFFIXES))
    cool = cut_out.filter("not hot").repartition(units, "mark").select("row", "twin", "id", "mark", "low", "words")
    spans = settled.select("row", "twin", F.inline("spans")).unionByName(cool.mapInArrow(tree, "row long, twin int, a long, b long"))
    if open_runs.filter("hot").limit(1).count():
        each = step(cut_out.filter("hot").select("row", "twin", "id", "low", "words").mapInArrow(paths, f"row long, twin int, id {kind}, a long, path long"))
        place = F.struct("id", "row", "twin", "a")
        least = step(each.groupBy("path").agg(F.min(place).alias("least")))
        later = each.join(least, "path").filter(place != F.col("least"))
        spans = spans.unionByName(later.select("row", "twin", "a", (F.col("a") + min_words).alias("b")))
    out = counted(base).join(_merged(spans), ["row", "twin"], "left")
    empty = F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>"))
    gone = F.aggregate(empty, F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return out.select(F.col("id").alias(id_col), "n_words", gone.alias("n_removed"), F.size(empty).cast("long").alias("n_spans"), empty.alias("spans"))


def _merged(spans: DataFrame) -> DataFrame:
    """row, twin and its disjoint spans, of (row, twin, a, b)."""
    raw = spans.groupBy("row", "twin").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("raw"))
    return raw.select("row", "twin", _union(F.col("raw")).alias("spans"))


def _union(spans: Column) -> Column:
    """Sorted spans as disjoint ones that don't touch."""
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    start = F.struct(none.alias("done"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"))

    def add(state: Column, s: Column) -> Column:
        joins = s["a"] <= state["b"]
        closed = F.when(state["a"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(F.struct(state["a"].alias("a"), state["b"].alias("b")))))
        return F.when(joins, F.struct(state["done"].alias("done"), state["a"].alias("a"), F.greatest(state["b"], s["b"]).alias("b"))).otherwise(
            F.struct(closed.alias("done"), s["a"].alias("a"), s["b"].alias("b"))
        )

    return F.aggregate(spans, start, add, lambda s: F.when(s["a"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))))
