"""Packing: best-fit decreasing with a segment tree indexed by remaining capacity.

Documents are tokenised, overlong ones are cut into full windows, and the pieces are packed group by group. A group is
a hash share of the pieces whose number grows with the table, so a task holds a bounded number of slim rows.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct words a worker remembers the ids of, some 100 MB; beyond it the half learned last is forgotten, as frequent
#: words are met early.
REMEMBERED = 400_000
#: Bytes of text worked on at once.
BLOCK_BYTES = 2 << 20
#: The byte-level alphabet's letter for a space (fixed value).
SPACE = "\u0120"


class Words:
    """Ids of a block of texts by way of their space-separated words.

    The pre-tokeniser never joins what stands before a single space with what follows it, so each word with its leading
    space has ids of its own, and words met before are looked up: their ids lie one after another in one array. New
    words are tokenised many at once; the first id of each is the one whose token begins with a space. Texts with two
    spaces in a row are tokenised as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[k for token, k in vocabulary.items() if token.startswith(SPACE)]] = True
        self.inner: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> range:
        """Append sequences of ids; their numbers."""
        used, n = int(self.ends[-1]), len(self.ends) - 1
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(max(used, len(ids)), np.uint32)])
        self.ids[used : used + len(ids)] = ids
        self.ends = np.concatenate([self.ends, used + np.cumsum(lengths)])
        return range(n, n + len(lengths))

    def _add_each(self, texts: list[str]) -> range:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self._add(np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.array([len(f) for f in found], np.int64))

    def _learn(self, words: list[str]) -> None:
        if "" in words:  # what follows a last space; it must not meet another one
            words.remove("")
            self.inner[""] = self._add_each([" "])[0]
        lines = [" " + " ".join(words[low : low + 512]) for low in range(0, len(words), 512)]
        found = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in found), np.uint32)
        starts = np.flatnonzero(self.opens[ids])
        self.inner.update(zip(words, self._add(ids, np.diff(np.append(starts, len(ids))))))

    def _forget(self) -> None:
        """Keep the half of the words that was learned first."""
        if len(self.inner) + len(self.heads) > REMEMBERED:
            n = sorted([*self.inner.values(), *self.heads.values()])[REMEMBERED // 2]
            self.inner, self.heads = ({w: k for w, k in held.items() if k < n} for held in (self.inner, self.heads))
            self.ends = self.ends[: n + 1]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id after it, and where each text's begin (one more at the end)."""
        self._forget()
        texts = texts.fill_null("")
        odd = np.flatnonzero(pc.match_substring(texts, "  ").to_numpy(zero_copy_only=False))
        whole = texts.take(pa.array(odd)).to_pylist()
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        split = pc.split_pattern(texts, " ")
        count = split.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(count) - count
        flat = split.flatten()
        heads = flat.take(pa.array(first)).to_pylist()
        new = list(set(heads).difference(self.heads))
        self.heads.update(zip(new, self._add_each(new)))
        told = flat.dictionary_encode()
        words = told.dictionary.to_pylist()
        known = list(map(self.inner.get, words))
        unknown = [k for k, at in enumerate(known) if at is None]
        self._learn([words[k] for k in unknown])
        for k in unknown:
            known[k] = self.inner[words[k]]
        at = np.array(known, np.int64)[told.indices.to_numpy()]
        at[first] = np.fromiter(map(self.heads.__getitem__, heads), np.int64, len(heads))
        after = len(self.ends) - 1  # what follows is not remembered
        at[first[odd]] = np.array(self._add_each(whole), np.int64)
        end = self._add(np.array([end_id], np.uint32), np.array([1]))[0]
        at = np.insert(at, first + count, end)
        start, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        upto = np.cumsum(size)
        place = np.repeat((start - upto + size).astype(np.int32), size)
        place += np.arange(upto[-1], dtype=np.int32)
        ids = self.ids[place]
        self.ends = self.ends[: after + 1]
        return ids, np.concatenate([[0], upto[np.cumsum(count + 1) - 1]])


@functools.lru_cache(maxsize=2)
def _words(path: str) -> Words:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Words(path)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of rows with about BLOCK_BYTES of text, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    part = (np.cumsum(size) - size) // BLOCK_BYTES
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
        yield batch.slice(low, high - low)


def tokenise(
    docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = True,
) -> DataFrame:
    """Pieces of at most ``window`` tokens: id, start, length, ids_crc32, doc_tokens and, if asked for, ids.

    Each document is its ids and ``end_id``; a null or empty text is the end id alone. All pieces but a document's last
    are full windows. Rows that repeat an id are documents of their own.
    """
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
    fields += [T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer_path)
        for batch in batches:
            for part in _blocks(batch):
                ids, ends = words.encode(part.column(1), end_id)
                total = np.diff(ends)
                count = -(-total // window)
                of = np.repeat(np.arange(len(total)), count)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * window
                length = np.minimum(window, total[of] - start)
                low = ends[of] + start
                held = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(held[a:b]) for a, b in zip(low.tolist(), (low + length).tolist())]
                out = [part.column(0).take(pa.array(of)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[of]))]
                if with_ids:
                    offsets = np.append(low, ends[-1]).astype("int32")
                    out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


class OpenWindows:
    """Segment tree over remaining capacities; each leaf holds the open windows with just that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def push(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        self._add(room, 1)

    def pop(self, room: int) -> int:
        self._add(room, -1)
        return self.stacks[room].pop()

    def _add(self, room: int, n: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += n
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least ``need`` among open windows."""
        node, count = need + self.size, self.count
        if not count[node]:
            while True:  # climb until a right neighbour holds a window
                if node == 1:
                    return None
                if not node & 1 and count[node + 1]:
                    node += 1
                    break
                node >>= 1
        while node < self.size:
            node = 2 * node if count[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each length; lengths come longest first."""
    tree, opened = OpenWindows(capacity), 0
    window, offset = np.empty(len(lengths), "int64"), np.empty(len(lengths), "int64")
    for k, need in enumerate(lengths):
        room = tree.tightest(need)
        if room is None:
            at, room, opened = opened, capacity, opened + 1
        else:
            at = tree.pop(room)
        window[k], offset[k] = at, capacity - room
        if room > need:
            tree.push(room - need, at)
    return window, offset


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length", pieces_per_group: int = 25_000) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset`` (long; input columns of these names are replaced).

    Lengths lie between 1 and ``capacity``. Ties go by all the columns' hash, so equal rows are interchangeable.
    A sequence id is its group's number times 2**32 plus the window's number there.
    """
    pieces = pieces.drop("sequence_id", "offset")
    groups = max(1, -(-pieces.count() // pieces_per_group))
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns])
    dealt = pieces.withColumn("__m", mark).withColumn("__g", F.pmod(F.col("__m"), F.lit(groups)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([length_col, "__m"], ascending=[False, True], kind="stable")
        window, offset = best_fit_decreasing(part[length_col].tolist(), capacity)
        part["sequence_id"], part["offset"] = part["__g"].to_numpy("int64") * 2**32 + window, offset
        return part.drop(columns=["__m", "__g"])

    return dealt.groupBy("__g").applyInPandas(run, schema)
