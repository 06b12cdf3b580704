"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k is split into k + 1 pieces: a passage within k edits of it holds one piece unchanged.
An automaton finds all pieces' exact hits in one pass over each whole text; Myers' bit-parallel distance verifies the
stretch around them. Verification climbs a tree: a run of j pieces with j errors or more has no part within its budget,
so a run of j pieces may have j - 1 errors, one of its halves must keep to its own budget, and a hit whose neighbours
don't fit is given up after a few characters. Items are taken in blocks of bounded size, one pass over the documents for
each block.
"""

from __future__ import annotations

import functools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut

#: Bytes of item text whose automaton one pass holds; measured before anything is broadcast.
BLOCK_BYTES = 1 << 20


def normalise(text: str | None) -> str:
    """Lower case, with each run of white space as one space."""
    return " ".join(text.lower().split()) if text else ""


def budget_of(length: int, share: float, least_chars: int) -> int:
    """Edits allowed: a share of the length; short items must match exactly."""
    return int(length * share) if length >= least_chars else 0


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """Offset and text of budget + 1 pieces of nearly equal length."""
    n, parts = len(item), budget + 1
    ends = [n * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:]) if b > a]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and where the first such stretch ends."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Run:
    """A run of an item's pieces: how to tell whether it lies within its errors in a stretch of text."""

    def __init__(self, item: str, begin: int, end: int, errors: int):
        self.begin, self.end, self.errors = begin, end, errors
        self.peq: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item[begin:end]):
            self.peq[c] |= 1 << i
        self.peq = dict(self.peq)

    def fits(self, text: str, at: int) -> bool:
        """Whether the run stands around where the item would begin at ``at``; Myers' recurrence with an early end."""
        m, errors = self.end - self.begin, self.errors
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, peq = full, 0, m, self.peq
        for c in text[max(0, at + self.begin - errors) : max(0, at + self.end + errors)]:
            eq = peq.get(c, 0)
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score <= errors:
                    return True
            xv = eq | mv
            ph, mh = (ph << 1) & full, (mh << 1) & full
            pv, mv = mh | (full & ~(xv | ph)), ph & xv
        return score <= errors


def runs_above(item: str, pieces: list[tuple[int, str]]) -> list[list[Run]]:
    """For each piece, the ever longer runs that hold it, without the item itself."""
    ends = [offset for offset, _ in pieces] + [len(item)]
    above: list[list[Run]] = [[] for _ in pieces]

    def split(low: int, high: int) -> None:
        if high - low < 2:
            return
        middle = (low + high) // 2
        split(low, middle)
        split(middle, high)
        if high - low < len(pieces):
            run = Run(item, ends[low], ends[high], high - low - 1)
            for k in range(low, high):
                above[k].append(run)

    split(0, len(pieces))
    return above


class Matcher:
    """The automaton of a block of items and the matches of a text."""

    def __init__(self, items: list[tuple[int, str]], share: float, least_chars: int):
        import ahocorasick

        self.items, at = [], defaultdict(list)
        for key, text in items:
            text = normalise(text)
            if text:
                budget = budget_of(len(text), share, least_chars)
                pieces = pieces_of(text, budget)
                for (offset, piece), above in zip(pieces, runs_above(text, pieces)):
                    at[piece].append((len(self.items), offset, above))
                self.items.append((key, text, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item key, distance, start, end) of the best stretch for each item within its budget."""
        if not self.items:
            return
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(text):
            for item, offset, above in places:
                start = end + 1 - size - offset
                if start not in starts[item] and all(run.fits(text, start) for run in above):
                    starts[item].add(start)
        for item, found in starts.items():
            if not found:
                continue
            key, wanted, budget = self.items[item]
            best = None
            for low, high in _merged(sorted(found), budget):
                a, b = max(0, low - budget), high + len(wanted) + budget
                stretch = text[a:b]
                at = stretch.find(wanted)
                if at >= 0:
                    best = (0, a + at, a + at + len(wanted))
                    break
                distance, end = myers(wanted, stretch)
                if distance <= budget and (best is None or distance < best[0]):
                    size = myers(wanted[::-1], stretch[:end][::-1])[1]
                    best = (distance, a + end - size, a + end)
            if best:
                yield key, *best


def _merged(starts: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Runs of starts whose stretches overlap nearly wholly are verified together."""
    low = high = starts[0]
    for s in starts[1:]:
        if s - high > budget + 1:
            yield low, high
            low = s
        high = s
    yield low, high


@functools.lru_cache(maxsize=2)
def _matcher(_name: str, held) -> Matcher:
    return Matcher(*held.value)


class _Held:
    """A broadcast that compares by name, so that a worker builds one automaton for a block."""

    def __init__(self, name: str, broadcast):
        self.name, self.broadcast = name, broadcast

    @property
    def value(self):
        return self.broadcast.value

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other) -> bool:
        return self.name == other.name


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", error_share: float = 0.1, least_chars: int = 40,
) -> DataFrame:
    """One row per document and item found in it: id, item, distance, start and end in the normalised text.

    An item may differ from its passage by ``error_share`` of its length in edits; items of fewer than ``least_chars``
    characters must stand there exactly. Null or empty documents and items match nothing. Items that repeat are
    reported under each key; rows that repeat a document's id are searched one by one. No benchmark: no rows.
    """
    spark = docs.sparkSession
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField(item_col, benchmark.schema[item_col].dataType),
            T.StructField("distance", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
    items = benchmark.select(F.col(item_col).alias("k"), F.col(item_text_col).alias("t")).filter("t is not null")
    volume = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-volume // BLOCK_BYTES))
    out = None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == block).collect()
        held = _Held(uuid.uuid4().hex, spark.sparkContext.broadcast(([(r.k, r.t) for r in part], error_share, least_chars)))

        def run(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            matcher = _matcher(held.name, held)
            for frame in frames:
                rows = [(key, *m) for key, text in zip(frame[id_col], frame[text_col]) for m in matcher.matches(normalise(text))]
                yield pd.DataFrame(rows, columns=schema.names)

        found = docs.select(id_col, text_col).mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents in which no item was found, columns as given. Rows that repeat an id are told apart by their text."""
    own = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat_ws("|", F.xxhash64(id_col).cast("string"), F.md5(own.cast("binary")))
    slim = docs.select(key.alias("__key"), F.col(text_col).alias("__text"))
    hits = contaminated(slim, benchmark, id_col="__key", text_col="__text", **options).select(F.col("__key").alias("__hit")).distinct()
    return docs.join(cut(hits), key == F.col("__hit"), "left_anti")
