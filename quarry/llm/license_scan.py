"""License scans: winnowed fingerprints, an inverted index for candidates, and banded alignment for coverage and spans.

``scan`` looks for a bounded set of templates in documents. ``remove_copied`` takes every document as a template of
those with larger ids, so its inverted index is distributed: fingerprints meet by shuffle, runs of windows with equal
content collapse to one candidate, and candidates that agree in part are aligned in buckets along the diagonal of their
common fingerprint. Its contract asks for exact windows, so the band is that diagonal alone.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import step
from . import rolling

#: Candidates of a bucket, and distinct contexts of one fingerprint beyond which windows are compared across all tasks.
BUCKET_RUNS, HOT_CONTEXTS = 20_000, 50_000
#: Bytes of templates that one pass over the documents holds; measured before anything is broadcast.
BLOCK_BYTES = 4 << 20
#: Bits of the filter that keeps documents without open runs out of the text's shuffle; 16 MB at most, however many there are.
FILTER_BITS = 1 << 27


def _batches(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


def fingerprints(base: DataFrame, window: int, gram: int) -> DataFrame:
    """row, doc, mark, context, run of every winnowed fingerprint in (row, doc, text); positions count words."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch):
                rows, docs = part.column(0).to_numpy(), part.column(1)
                hashes, first = rolling.word_hashes(rolling.split_words(part.column(2).to_pylist()))
                for held in rolling.blocks(np.diff(first).tolist(), window):
                    cuts = [hashes[first[k] + a : first[k] + b] for k, a, b in held]
                    offsets = np.concatenate([[0], np.cumsum([len(c) for c in cuts])])
                    found = rolling.anchor_runs(np.concatenate(cuts), offsets, gram, window)
                    of, shift = found["part"], np.array([a for _, a, _ in held])
                    source = np.array([k for k, _, _ in held])[of]
                    run = rolling.pack_run(*(found[x] + shift[of] for x in ("low", "anchor", "high")))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[source]), docs.take(pa.array(source)), *(pa.array(found[x].view(np.int64)) for x in ("mark", "context")), pa.array(run)],
                        names=["row", "doc", "mark", "context", "run"],
                    )

    return base.mapInArrow(find, f"row long, doc {base.schema['doc'].dataType.simpleString()}, mark long, context long, run long")


def _align(key: np.ndarray, docs: np.ndarray, low: np.ndarray, anchor: np.ndarray, contexts: pa.Array, window: int):
    """(index of the candidate, first word, end) of each candidate's words that match a smaller document's in the bucket.

    The index of windows names each window's least document, and every candidate is aligned with those that it names, along
    the diagonal on which their anchors lie: the contract's windows are exact, so the band is the diagonal alone. A stretch
    of ``window`` equal words or more is a match.
    """
    first = contexts.offsets.to_numpy().astype(np.int64)
    words = contexts.values.to_numpy().view(np.uint64)
    size = np.diff(first)
    count = size - window + 1
    of, step = _steps(count)
    start = first[of] + step
    marks = rolling.Stretches(words).hash(start, start + window)
    order = np.lexsort((docs[of], marks))
    new = np.concatenate([[True], marks[order][1:] != marks[order][:-1]])
    least = order[new][np.cumsum(new) - 1]
    later = docs[of[order]] > docs[of[least]]
    pairs = np.unique(np.stack([of[order[later]], of[least[later]]], axis=1), axis=0)
    mine, other = pairs[:, 0], pairs[:, 1]
    shift = (anchor - low)[other] - (anchor - low)[mine]
    begin = np.maximum(0, -shift)
    length = np.minimum(size[mine], size[other] - shift) - begin
    pair, at = _steps(length)
    at = at + begin[pair]
    equal = words[first[mine[pair]] + at] == words[first[other[pair]] + at + shift[pair]]
    edge = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (equal[1:] != equal[:-1]), [True]])) if len(pair) else np.zeros(1, np.int64)
    run, end = edge[:-1], edge[1:]
    told = equal[run] & (end - run >= window)
    who = mine[pair[run[told]]]
    a = low[who] + at[run[told]]
    return key[who], a, a + (end - run)[told]


def _steps(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which sequence each element belongs to and its place there, of sequences of these lengths."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def _joined(rows: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    if not len(rows):
        return rows, starts, starts
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(rows) - 1]])
    return rows[first], starts[first], starts[last] + window


def those_in(base: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents of (row, ...) whose row may be among ``rows``: all of these, and a few others by chance."""
    word, bit = F.shiftright("row", 6).bitwiseAND(FILTER_BITS // 64 - 1), F.expr("shiftleft(1L, cast(row & 63 as int))")
    told = rows.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    held = np.zeros(FILTER_BITS // 64, np.int64)
    held[told["word"].to_numpy().astype(np.int64)] = told["bits"].to_numpy().astype(np.int64)
    spread = base.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0).to_numpy()
            yield batch.filter(pa.array((spread.value[(row >> 6) & (FILTER_BITS // 64 - 1)] >> (row & 63)) & 1 == 1))

    return base.mapInArrow(run, base.schema)


def remove_copied(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 8) -> DataFrame:
    """The input's columns plus ``kept`` (string), ``n_words``, ``n_removed`` and ``spans`` (of words).

    Words stand between ASCII white space. A word goes if it lies in a window of ``window`` consecutive words that also
    starts in a document with a smaller id; windows are judged on the input. Kept words are joined by one space. A null
    text has no words. Rows with a null id neither lose words nor take any from others. Rows that repeat an id are one
    document here: they take nothing from each other. Input columns with the new names are replaced. An empty table
    gives an empty table.
    """
    docs = docs.drop("kept", "n_words", "n_removed", "spans")
    given, kind = docs.columns, docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = F.struct(*[F.col(f"`{c}`") for c in given if c != text_col])
    base = docs.select(F.xxhash64(F.col(id_col), text).alias("row"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"), others.alias("given"))
    found = fingerprints(base.filter("doc is not null").select("row", "doc", "text"), window, gram)
    # both sides of a join come from a shuffle or a checkpoint, so that adaptive execution can split frequent marks
    shared = step(found.groupBy("mark").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("mark", "least"))
    met = step(found.join(shared, "mark"))
    classes = step(met.groupBy("mark", "context").agg(F.min("doc").alias("first"), F.first("least").alias("least")))
    low, high = F.shiftright("run", 24), F.shiftright("run", 24) + F.col("run").bitwiseAND(4095)
    placed = met.drop("least").join(classes, ["mark", "context"])
    settled = placed.filter("doc > first").select("row", "doc", low.alias("a"), (high + window).alias("b")).distinct()

    part = classes.groupBy("mark").agg(F.count(F.lit(1)).alias("contexts"), F.max("first").alias("last"), F.min("least").alias("least0")).filter("last > least0")
    part = step(part.select("mark", (F.col("contexts") > HOT_CONTEXTS).alias("hot")))
    open_runs = step(placed.filter("doc = first").join(part, "mark").select("row", "doc", "mark", "run", "hot").distinct())
    cells = open_runs.groupBy(F.col("row").alias("__row"), F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("mark", "run", "hot")).alias("runs"))
    same = (F.col("row") == F.col("__row")) & (F.col("doc") == F.col("__doc"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _batches(batch, 256):
                hashes, first = rolling.word_hashes(rolling.split_words(piece.column(2).to_pylist()))
                runs = piece.column(3)
                of, _ = _steps(runs.value_lengths().to_numpy().astype(np.int64))
                flat = runs.flatten()
                a, at, b = rolling.unpack_run(flat.field("run").to_numpy())
                n = b - a + window
                _, step = _steps(n)
                words = hashes[np.repeat(first[of] + a, n) + step]
                held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype("int32")), pa.array(words.view(np.int64)))
                own = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(own), piece.column(1).take(own), flat.field("mark"), flat.field("hot"), pa.array(a), pa.array(at), held],
                    names=["row", "doc", "mark", "hot", "low", "anchor", "words"],
                )

    together = those_in(base.select("row", "doc", "text"), open_runs.select("row")).join(cells, same).select("row", "doc", "text", "runs")
    cut_out = together.mapInArrow(contexts, f"row long, doc {kind}, mark long, hot boolean, low long, anchor long, words array<long>")
    buckets = max(1, -(-open_runs.filter("not hot").count() // BUCKET_RUNS))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            rank = np.unique(whole.column("doc").to_numpy(), return_inverse=True)[1]
            at, a, b = _align(np.arange(len(rank)), rank, *(whole.column(c).to_numpy() for c in ("low", "anchor")), whole.column("words").chunk(0), window)
            own = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(whole.column(c).take(own).combine_chunks() for c in ("row", "doc")), pa.array(a), pa.array(b)], names=["row", "doc", "a", "b"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _batches(batch):
                held = piece.column("words")
                first = held.offsets.to_numpy().astype(np.int64)
                of, step = _steps(np.diff(first) - window + 1)
                start = first[of] + step
                marks = rolling.Stretches(held.values.to_numpy().view(np.uint64)).hash(start, start + window)
                own = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("row").take(own), piece.column("doc").take(own), pa.array(piece.column("low").to_numpy()[of] + step), pa.array(marks.view(np.int64))],
                    names=["row", "doc", "a", "hash"],
                )

    spans_of = f"row long, doc {kind}, a long, b long"
    cool = cut_out.filter("not hot").repartition(buckets, "mark").select("row", "doc", "low", "anchor", "words")
    spans = settled.unionByName(cool.mapInArrow(align, spans_of))
    if open_runs.filter("hot").limit(1).count():
        each = step(cut_out.filter("hot").select("row", "doc", "low", "words").mapInArrow(windows, f"row long, doc {kind}, a long, hash long"))
        least = step(each.groupBy("hash").agg(F.min("doc").alias("least")))
        hot = each.join(least, "hash").filter("doc > least").select("row", "doc", "a", (F.col("a") + window).alias("b"))
        spans = spans.unionByName(hot.distinct())
    spans = spans.groupBy(F.col("row").alias("__row"), F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            for piece in _batches(batch):
                kept, removed, count, runs = [], [], [], []
                for words, spans in zip(rolling.split_words(piece.column(1).to_pylist()), piece.column(2).to_pylist()):
                    both = rolling.merged(np.array([x["a"] for x in spans]), np.array([x["b"] for x in spans])) if spans else []
                    left = words if not both else [w for a, b in zip([0, *(b for _, b in both)], [*(a for a, _ in both), len(words)]) for w in words[a:b]]
                    kept.append(b" ".join(left).decode())
                    count.append(len(words))
                    removed.append(len(words) - len(left))
                    runs.append([{"a": a, "b": b} for a, b in both])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(kept, pa.string()), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, arrow)],
                    names=["given", "text", "kept", "n_words", "n_removed", "spans"],
                )

    schema = f"given {base.schema['given'].dataType.simpleString()}, text string, kept string, n_words long, n_removed long, spans array<struct<a:long,b:long>>"
    out = base.join(spans, same, "left").select("given", "text", "spans").mapInArrow(remove, schema)
    own = [F.col("text").alias(c) if c == text_col else F.col("given")[c].alias(c) for c in given]
    return out.select(*own, "kept", "n_words", "n_removed", "spans")


def banded_alignment(left: np.ndarray, right: np.ndarray, diagonal: int, band: int) -> list[tuple[int, int]]:
    """(left index, right index) of the words that a best alignment near a diagonal matches.

    Only cells with |right - left - diagonal| <= band count; the score is the number of equal words (a longest common
    subsequence in the band).
    """
    wide = 2 * band + 1
    score = np.zeros((len(left) + 1, wide + 2), np.int32)
    for i, word in enumerate(left, 1):
        at = i - 1 + diagonal - band + np.arange(wide)  # right index of each cell
        inside = (at >= 0) & (at < len(right))
        equal = np.zeros(wide, bool)
        equal[inside] = right[at[inside]] == word
        best = np.maximum(score[i - 1, 1:-1] + equal, score[i - 1, 2:])
        score[i, 1:-1] = np.maximum.accumulate(best)
    pairs, i, c = [], len(left), int(np.argmax(score[-1, 1:-1])) + 1
    while i > 0 and score[i, c]:
        j = i - 1 + diagonal - band + c - 1
        if score[i, c] == score[i, c - 1]:
            c -= 1
        elif 0 <= j < len(right) and right[j] == left[i - 1] and score[i, c] == score[i - 1, c] + 1:
            pairs.append((i - 1, j))
            i -= 1
        else:
            i, c = i - 1, c + 1
    return pairs[::-1]


class Index:
    """Templates' words and the inverted index of their fingerprints."""

    def __init__(self, templates: list[tuple[object, str]], window: int, gram: int):
        self.keys = [k for k, _ in templates]
        hashes, first = rolling.word_hashes(rolling.split_words([t.lower() for _, t in templates]))
        self.words = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        self.window, self.gram, self.places = window, gram, defaultdict(list)
        for k, words in enumerate(self.words):
            for mark, at in _winnow(words, window, gram):
                self.places[mark].append((k, at))


def _winnow(words: np.ndarray, window: int, gram: int) -> set[tuple[int, int]]:
    """(hash, position) of the fingerprints; a text shorter than a window is one window."""
    if len(words) < gram:
        return set()
    window = min(window, len(words))
    found = rolling.anchor_runs(words, np.array([0, len(words)]), gram, window)
    return set(zip(found["mark"].tolist(), found["anchor"].tolist()))


@functools.lru_cache(maxsize=2)
def _index(name: str, held, window: int, gram: int) -> Index:
    return Index(held.broadcast.value, window, gram)


class _Held:
    def __init__(self, name: str, broadcast):
        self.name, self.broadcast = name, broadcast

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other) -> bool:
        return self.name == other.name


def _runs_only(pairs: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """The pairs that stand in runs of at least ``least`` consecutive words on both sides."""
    steps = np.diff(np.array(pairs, np.int64).reshape(-1, 2), axis=0)
    cuts = np.flatnonzero((steps != 1).any(axis=1)) + 1
    edges = [0, *cuts.tolist(), len(pairs)]
    return [p for a, b in zip(edges, edges[1:]) if b - a >= least for p in pairs[a:b]]


def _diagonal_run(left: np.ndarray, right: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
    """The equal words around a place, on its diagonal."""
    low, high = 0, 0
    while i - low > 0 and j - low > 0 and left[i - low - 1] == right[j - low - 1]:
        low += 1
    while i + high < len(left) and j + high < len(right) and left[i + high] == right[j + high]:
        high += 1
    return [(i + d, j + d) for d in range(-low, high)]


def matches(index: Index, text: str | None, band: int, least_coverage: float) -> Iterator[tuple]:
    """(template key, coverage in the template, matched words, spans of the text's words) of each candidate.

    The likeliest diagonal is aligned first, then that of every fingerprint whose words no alignment has matched yet,
    over the words still free. A further alignment counts wholly if it covers the template by itself, else with its runs
    of ``gram`` words or more, so that stray equal words don't add up to a template.
    """
    words = rolling.word_hashes(rolling.split_words([text and text.lower()]))[0]
    votes: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for mark, at in _winnow(words, index.window, index.gram):
        for k, place in index.places.get(mark, ()):
            votes[k].append((at, place))
    for k, anchors in sorted(votes.items()):
        template = index.words[k]
        gone = next(v for v in range(len(template) + 1) if v not in template)  # equals no word of the template
        diagonals = Counter((at - place) // (band + 1) for at, place in anchors)
        slot = max(diagonals, key=lambda d: (diagonals[d] + diagonals.get(d + 1, 0), -d))
        pairs = set(banded_alignment(template, words, slot * (band + 1) + band // 2, 2 * band))
        taken = np.zeros(len(words), bool)
        taken[[j for _, j in pairs]] = True
        for at, place in sorted(anchors):
            if taken[at : at + index.gram].all():
                continue
            free = np.where(taken, np.uint64(gone), words)
            more = banded_alignment(template, free, at - place, 2 * band)
            if len(more) < least_coverage * len(template):
                more = _runs_only(more, index.gram)
            more += _diagonal_run(template, words, place, at)
            pairs.update(more)
            taken[[j for _, j in more]] = True
        coverage = len({i for i, _ in pairs}) / len(template)
        if coverage >= least_coverage:
            at = np.flatnonzero(taken)
            yield index.keys[k], coverage, len(at), rolling.merged(at, at + 1)


def scan(
    docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str = "item_id", template_col: str = "text",
    window: int = 8, gram: int = 4, band: int = 16, least_coverage: float = 0.5,
) -> DataFrame:
    """One row per document and template found in it: id, key, coverage, n_matched, spans of matched words.

    Words are lower-cased. Candidates share a fingerprint; coverage is the share of the template's words that alignments
    in bands around the diagonals of the fingerprints match; n_matched and spans count the document's words. Templates of fewer than ``gram`` words and null or
    empty texts match nothing. Templates are taken in blocks of bounded size. No templates: no rows.
    """
    spark = docs.sparkSession
    chosen = templates.select(F.col(key_col).alias("k"), F.col(template_col).alias("t")).filter("t is not null")
    blocks = max(1, -(-(chosen.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES))
    kinds = (docs.schema[id_col].dataType.simpleString(), templates.schema[key_col].dataType.simpleString())
    schema = f"`{id_col}` {kinds[0]}, `{key_col}` {kinds[1]}, coverage double, n_matched long, spans array<struct<a:long,b:long>>"
    out = None
    for block in range(blocks):
        part = [(r.k, r.t) for r in chosen.filter(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == block).collect()]
        held = _Held(uuid.uuid4().hex, spark.sparkContext.broadcast(part))

        def run(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = _index(held.name, held, window, gram)
            for frame in frames:
                rows = [
                    (d, k, coverage, n, [{"a": int(a), "b": int(b)} for a, b in spans])
                    for d, t in zip(frame[id_col], frame[text_col])
                    for k, coverage, n, spans in matches(index, t, band, least_coverage)
                ]
                yield pd.DataFrame(rows, columns=[id_col, key_col, "coverage", "n_matched", "spans"])

        found = docs.select(id_col, text_col).mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
