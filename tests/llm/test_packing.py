import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import packing
from quarry.llm.queries import op6_packing, tokenizer_path
from tests.conftest import SF


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def plain():
    """The tokenizer as anybody would load it."""
    return Tokenizer.from_file(tokenizer_path())


ODD = st.lists(st.sampled_from([*" ab'sé1.,\n\t\r-\x00日\u3000\x0b", "  ", "<|endoftext|>", "the", "\n "]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | ODD, min_size=1, max_size=6))
def test_words_give_the_tokenizers_ids(plain, texts):
    ids, ends = packing._words(tokenizer_path()).encode(pa.array(texts, pa.string()), 1)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ids_of(plain, t) for t in texts]


def test_forgotten_words_are_learned_again(plain, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    words = packing.Words(tokenizer_path())
    for k in range(30):
        texts = [f"common w{k}a w{k}b  x" if k % 3 else f"common w{k}a w{k - 1}b w{k // 2} "]
        ids, _ = words.encode(pa.array(texts), 1)
        assert ids.tolist() == ids_of(plain, texts[0])
    assert len(words.inner) + len(words.heads) < 60


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_decreasing_is_the_plain_one(lengths):
    lengths = sorted(lengths, reverse=True)
    window, offset = packing.best_fit_decreasing(lengths, 20)
    rooms: list[int] = []
    for need, w, o in zip(lengths, window, offset):
        fits = [r for r in rooms if r >= need]
        if fits:
            assert rooms[w] == min(fits) and o == 20 - rooms[w]
            rooms[w] -= need
        else:
            assert w == len(rooms) and o == 0
            rooms.append(20 - need)


def check(rows, docs, tokenizer):
    ids = {d: ids_of(tokenizer, t) for d, t in docs}
    at, windows = {d: 0 for d in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and 1 <= r.length <= 2048 and r.doc_tokens == len(ids[r.doc_id])
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(piece)
        at[r.doc_id] += r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(at[d] == len(v) for d, v in ids.items())
    for held in windows.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    return len(windows)


def test_whole_table(spark, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = op6_packing(spark, SF).collect()
    used = check(rows, docs, plain)
    assert sum(r.length for r in rows) > 0.97 * 2048 * (used - 1)


def test_odd_rows(spark):
    schema = "doc_id long, text string, offset string"
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a  b\n", "x"), (4, "word " * 5000, "x"), (None, "n", "x")], schema)
    rows = packing.pack(packing.tokenise(docs, tokenizer_path(), with_ids=True)).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, None}
    assert all(len(r.ids) == r.length for r in rows)
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    assert packing.pack(packing.tokenise(docs.limit(0), tokenizer_path())).count() == 0
