"""Substring dedup over bytes by a sparse suffix array.

Only suffixes that start at winnowed anchors are kept, and a suffix stands for the run of windows that select its
anchor. Runs whose whole context occurs twice are settled by hash with map-side combine. What is left, runs that meet
others in part, goes to buckets: sampled splitters range-partition suffixes by their leading bytes, each bucket sorts
the suffixes of its windows by multikey quicksort, eight bytes at a time, and neighbours equal to the full depth are
repeats. A splitter never cuts equal leading bytes, so no equal neighbours lie across a boundary; anchors too frequent for one bucket are compared across all
tasks by window hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import step
from . import rolling
from .license_scan import those_in

#: Runs of a bucket and of what is sorted at once, and distinct contexts of one anchor beyond which windows are compared by hash.
BUCKET_RUNS, SORTED_RUNS, HOT_CONTEXTS = 10_000, 2_000, 50_000
#: Windows that are sorted at once; those at other distances from their anchor come next.
SORTED_WINDOWS = 400_000
#: Suffixes of a segment that isn't split further but sorted.
SHORT = 4096


def _texts(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _batches(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


def runs_of(base: DataFrame, window: int, gram: int) -> DataFrame:
    """row, twin, mark, context, run of every anchor in the texts of (row, twin, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch):
                texts = _texts(part.column(2))
                for held in rolling.blocks([len(t) for t in texts], window):
                    cuts = [texts[k][a:b] for k, a, b in held]
                    offsets = np.concatenate([[0], np.cumsum([len(c) for c in cuts])])
                    found = rolling.anchor_runs(rolling.IMAGE[np.frombuffer(b"".join(cuts), np.uint8)], offsets, gram, window)
                    of, shift = found["part"], np.array([a for _, a, _ in held])
                    run = rolling.pack_run(*(found[x] + shift[of] for x in ("low", "anchor", "high")))
                    own = pa.array(np.array([k for k, _, _ in held])[of])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(own), part.column(1).take(own), *(pa.array(found[x].view(np.int64)) for x in ("mark", "context")), pa.array(run)],
                        names=["row", "twin", "mark", "context", "run"],
                    )

    return base.mapInArrow(find, "row long, twin int, mark long, context long, run long")


def multikey_groups(words: np.ndarray, at: np.ndarray, depth: int, group: np.ndarray | None = None) -> np.ndarray:
    """For each suffix, whether another one (of its group, if there are groups) has the same first ``depth`` bytes.

    ``words`` has the eight bytes from every position as a big-endian number, a symbol here; the last one overlaps the
    one before if the depth isn't a multiple of eight. Multikey quicksort: a segment is split three ways around a pivot,
    less and greater stay at their symbol, equal goes on to the next one. Short segments are finished together.
    """
    out = np.zeros(len(at), bool)
    steps = [*range(0, depth - 7, 8)] + [depth - 8] * bool(depth % 8)
    group = np.zeros(len(at), np.int64) if group is None else group
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1], [True]])) if len(at) else np.zeros(1, np.int64)
    size = np.diff(edges)
    rest = np.repeat((size > 1) & (size <= SHORT), size)
    short = [(order[rest], group[order[rest]], 0)]
    stack = [(order[edges[k] : edges[k + 1]], 0) for k in np.flatnonzero(size > SHORT).tolist()]
    last = int(group.max(initial=0))
    while stack:
        held, level = stack.pop()
        if level == len(steps):
            out[held] = len(held) > 1
        elif len(held) > SHORT:
            key = words[at[held] + steps[level]]
            sample = key[:: len(key) // 31]
            pivot = np.partition(sample, len(sample) // 2)[len(sample) // 2]
            stack += [(held[key < pivot], level), (held[key == pivot], level + 1), (held[key > pivot], level)]
        elif len(held) > 1:
            last += 1
            short.append((held, np.full(len(held), last), level))
    alive, group = (np.concatenate([x[k] for x in short]) for k in (0, 1))
    _finish(words, at, np.array(steps), alive, group, np.repeat([x[2] for x in short], [len(x[0]) for x in short]), out)
    return out


def _finish(words: np.ndarray, at: np.ndarray, steps: np.ndarray, alive: np.ndarray, group: np.ndarray, level: np.ndarray, out: np.ndarray) -> None:
    """Short segments, one after another, sorted a symbol at a time; only those with different symbols need it."""
    while len(alive):
        key = words[at[alive] + steps[level]]
        new = np.ones(len(alive), bool)
        new[1:] = group[1:] != group[:-1]
        group = np.cumsum(new)
        odd = np.zeros(group[-1] + 1, bool)
        odd[group[1:][~new[1:] & (key[1:] != key[:-1])]] = True
        mixed = np.flatnonzero(odd[group])
        order = mixed[np.lexsort((key[mixed], group[mixed]))]
        alive[mixed], level[mixed], key[mixed] = alive[order], level[order], key[order]
        new[1:] |= key[1:] != key[:-1]
        on = ~(new & np.append(new[1:], True))
        alive, group, level = alive[on], np.cumsum(new)[on], level[on] + 1
        done = level == len(steps)
        out[alive[done]] = True
        alive, group, level = alive[~done], group[~done], level[~done]


def _eight_bytes(joined: np.ndarray) -> np.ndarray:
    """The big-endian number in the eight bytes from each position."""
    wide, out = np.concatenate([joined, np.zeros(8, np.uint8)]), np.zeros(len(joined), np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= wide[k : k + len(joined)]
    return out


def _bucket(runs: np.ndarray, copies: np.ndarray, contexts: list[bytes], window: int, gram: int):
    """(index of the run, first byte, end) of what repeats in a bucket's runs that have no copy.

    Equal windows lie alike around equal anchors, so that an anchor's windows at one distance are sorted by themselves.
    """
    low, anchor, high = rolling.unpack_run(runs)
    starts = np.concatenate([[0], np.cumsum([len(c) for c in contexts])[:-1]]).astype(np.int64)
    words = _eight_bytes(np.frombuffer(b"".join(contexts) + b"\0" * 8, np.uint8))
    head = [words[starts + anchor - low + k] for k in range(0, gram, 8)]
    head[-1] = head[-1] >> np.uint64(-gram % 8 * 8)
    mark = np.unique(np.stack(head, axis=1), axis=0, return_inverse=True)[1].ravel()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    distances = window - gram + 1
    width = max(1, distances * SORTED_WINDOWS // max(1, int((high - low + 1).sum())))
    for near in range(0, distances, width):
        first = np.maximum(anchor - low - (near + width - 1), 0)
        count = np.maximum(np.minimum(high - low, anchor - low - near) - first + 1, 0)
        of = np.repeat(np.arange(len(runs)), count)
        step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
        told = multikey_groups(words, starts[of] + step, window, mark[of] * window + (anchor - low)[of] - step) & (copies[of] == 1)
        found.append((of[told], low[of[told]] + step[told]))
    return _joined(*(np.concatenate([f[k] for f in found]) for k in (0, 1)), window)


def _joined(rows: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that follow each other become one span."""
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    if not len(rows):
        return rows, starts, starts
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(rows) - 1]])
    return rows[first], starts[first], starts[last] + window


SPANS = "row long, twin int, a long, b long"


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 200, gram: int = 24) -> DataFrame:
    """The input's columns plus ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans`` and ``spans``.

    Each byte of the UTF-8 text goes that lies in a string of ``window`` bytes which also starts anywhere else, in the
    same document or another one; all of its occurrences go. Matches never cross documents. A null or empty text has no
    bytes. Rows that repeat an id are documents of their own; a row that repeats another one wholly repeats its text.
    Input columns with the new names are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans", "spans")
    given, text = docs.columns, F.coalesce(F.col(text_col), F.lit(""))
    key = [F.xxhash64(F.col(id_col), text).alias("row"), F.hash(F.col(id_col), text).alias("twin")]  # 96 bits tell rows apart
    others = F.struct(*[F.col(f"`{c}`") for c in given if c != text_col])
    base = docs.select(*key, F.col(text_col).alias("text"), others.alias("given"))
    found = runs_of(base.select("row", "twin", "text"), window, gram)
    # both sides of a join come from a shuffle or a checkpoint, so that adaptive execution can split frequent anchors
    shared = step(found.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark"))
    met = step(found.join(shared, "mark"))
    classes = met.groupBy("mark", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "twin", "run")).alias("one"))
    classes = step(classes.select("mark", "context", "copies", "one.row", "one.twin", "one.run"))
    whole = met.join(classes.filter("copies > 1").select("mark", "context"), ["mark", "context"], "left_semi")
    low, high = F.shiftright("run", 24), F.shiftright("run", 24) + F.col("run").bitwiseAND(4095)
    settled = whole.select("row", "twin", low.alias("a"), (high + window).alias("b")).distinct()

    part = classes.groupBy("mark").agg(F.count(F.lit(1)).alias("contexts"), F.min("copies").alias("least")).filter("contexts > 1 and least = 1")
    part = step(part.select("mark", (F.col("contexts") > HOT_CONTEXTS).alias("hot")))
    open_runs = step(classes.join(part, "mark").select("row", "twin", "run", "copies", "hot"))
    cells = open_runs.groupBy(F.col("row").alias("__row"), F.col("twin").alias("__twin")).agg(F.collect_list(F.struct("run", "copies", "hot")).alias("runs"))
    same = (F.col("row") == F.col("__row")) & (F.col("twin") == F.col("__twin"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            size = 0
            for row, twin, t, runs in zip(*(batch.column(k).to_pylist() for k in (0, 1)), _texts(batch.column(2)), batch.column(3).to_pylist()):
                for x in runs:
                    a, at, b = rolling.unpack_run(np.int64(x["run"]))
                    ctx = t[a : b + window]
                    for held, v in zip(out, (row, twin, x["run"], x["copies"], x["hot"], t[at : at + gram], ctx)):
                        held.append(v)
                    size += len(ctx)
                if size > 8 << 20:
                    yield _context_batch(out)
                    out, size = [[] for _ in range(7)], 0
            yield _context_batch(out)

    together = those_in(base.select("row", "twin", "text"), open_runs.select("row")).join(cells, same).select("row", "twin", "text", "runs")
    cut_out = together.mapInArrow(contexts, "row long, twin int, run long, copies long, hot boolean, head binary, context binary")

    def sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            whole = pa.Table.from_batches(held)
            # a row that stands twice in the table gives its contexts twice
            keep = np.unique(np.stack([whole.column(c).to_numpy() for c in ("row", "twin", "run")]), axis=1, return_index=True)[1]
            mark = whole.column("head").combine_chunks().dictionary_encode().indices.to_numpy()[keep]
            order = np.argsort(mark, kind="stable")
            keep, mark = keep[order], mark[order]
            # equal windows have equal anchors, so that a bucket can be sorted in parts that cut between anchors
            edges = np.flatnonzero(np.diff(mark, prepend=-1, append=-1))
            cuts = sorted({0, len(keep), *edges[np.flatnonzero(np.diff(edges // SORTED_RUNS)) + 1].tolist()})
            for low, high in zip(cuts, cuts[1:]):
                part = whole.take(pa.array(keep[low:high]))
                of, a, b = _bucket(part.column("run").to_numpy(), part.column("copies").to_numpy(), part.column("context").to_pylist(), window, gram)
                own = pa.array(of)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(own).combine_chunks() for c in ("row", "twin")), pa.array(a), pa.array(b)], names=["row", "twin", "a", "b"])

    buckets = max(1, -(-open_runs.filter("not hot").count() // BUCKET_RUNS))
    cool = cut_out.filter("not hot").repartitionByRange(buckets, "head").select("row", "twin", "run", "copies", "head", "context")
    spans = settled.unionByName(cool.mapInArrow(sort_bucket, SPANS))
    if open_runs.filter("hot").limit(1).count():
        spans = spans.unionByName(_hot_spans(cut_out.filter("hot"), window))
    spans = spans.groupBy(F.col("row").alias("__row"), F.col("twin").alias("__twin")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            for part in _batches(batch):
                kept, removed, runs = [], [], []
                texts = _texts(part.column(1))
                for t, found in zip(texts, part.column(2).to_pylist()):
                    both = rolling.merged(np.array([x["a"] for x in found]), np.array([x["b"] for x in found])) if found else []
                    ends = [0, *(b for _, b in both)]
                    kept.append(b"".join(t[a:b] for a, b in zip(ends, [*(a for a, _ in both), len(t)])) if both else t)
                    removed.append(len(t) - len(kept[-1]))
                    runs.append([{"a": a, "b": b} for a, b in both])
                numbers = [[len(t) for t in texts], removed, [len(r) for r in runs]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in numbers), pa.array(runs, kind)],
                    names=["given", "text", "kept", "n_bytes", "n_removed", "n_spans", "spans"],
                )

    schema = f"given {base.schema['given'].dataType.simpleString()}, text string, kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<a:long,b:long>>"
    out = base.join(spans, same, "left").select("given", "text", "spans").mapInArrow(remove, schema)
    own = [F.col("text").alias(c) if c == text_col else F.col("given")[c].alias(c) for c in given]
    return out.select(*own, "kept", "n_bytes", "n_removed", "n_spans", "spans")


def _context_batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["row", "twin", "run", "copies", "hot", "head", "context"])


def _hot_spans(runs: DataFrame, window: int) -> DataFrame:
    """Spans of anchors with very many contexts: one row a window, counted by hash with map-side combine."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch, 64):
                low, _, high = rolling.unpack_run(part.column("run").to_numpy())
                for k, ctx in enumerate(part.column("context").to_pylist()):
                    n = int(high[k] - low[k]) + 1
                    start = np.arange(n)
                    marks = rolling.Stretches(rolling.IMAGE[np.frombuffer(ctx, np.uint8)]).hash(start, start + window)
                    same = [pa.repeat(part.column(c)[k], n) for c in ("row", "twin", "copies")]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(low[k] + start), pa.array(marks.view(np.int64))], names=["row", "twin", "copies", "a", "hash"])

    each = step(runs.mapInArrow(windows, "row long, twin int, copies long, a long, hash long").distinct())
    twice = step(each.groupBy("hash").agg(F.sum("copies").alias("n")).filter("n > 1").select("hash"))
    return each.filter("copies = 1").join(twice, "hash", "left_semi").select("row", "twin", "a", (F.col("a") + window).alias("b"))
