import hashlib
from collections import Counter

import numpy as np

from quarry.llm import suffix_dedup
from quarry.llm.queries import op10_suffix_array
from tests.conftest import SF


def brute(texts, window):
    """(bytes, removed, spans, kept) of each text."""
    data, seen = [(t or "").encode() for t in texts], Counter()
    for d in data:
        for s in range(len(d) - window + 1):
            seen[hash(d[s : s + window])] += 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int32)
        for s in range(len(d) - window + 1):
            if seen[hash(d[s : s + window])] > 1:
                gone[s] += 1
                gone[s + window] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((len(d), int(gone.sum()), int((edges == 1).sum()), bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def got(df, key="doc_id"):
    return sorted((r[key] if r[key] is not None else -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = [(d, a, b, c, hashlib.sha256(k).hexdigest()) for (d, _), (a, b, c, k) in zip(docs, brute([t for _, t in docs], 200))]
    assert sorted(map(tuple, op10_suffix_array(spark, SF).collect())) == sorted(expected)


def planted():
    rng = np.random.default_rng(1)
    text = lambda n: "".join(rng.choice(list("abcdé "), n))
    passage, rows = text(90), []
    for k in range(30):
        rows.append((k, text(int(rng.integers(0, 80))) + passage[int(rng.integers(0, 20)) : 60 + int(rng.integers(0, 30))] + text(30)))
    same = text(400)
    rows += [(100 + k, same) for k in range(3)] + [(200, "x" * 300), (201, None), (202, ""), (203, same[:150] + "Z" + same[151:])]
    return rows


def test_planted_passages_buckets_and_hot_anchors(spark, monkeypatch):
    rows = planted()
    expected = sorted((d, *b) for (d, _), b in zip(rows, brute([t for _, t in rows], 40)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda: got(suffix_dedup.remove_repeats(table, window=40, gram=8))
    assert run() == expected
    monkeypatch.setattr(suffix_dedup, "BUCKET_RUNS", 5)
    monkeypatch.setattr(suffix_dedup, "SORTED_RUNS", 2)
    monkeypatch.setattr(suffix_dedup, "SORTED_WINDOWS", 40)
    assert run() == expected
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 1)
    assert run() == expected


def test_long_texts_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup.rolling, "BLOCK", 128)
    rows = planted()
    table = spark.createDataFrame(rows, "doc_id long, text string").collect()
    from quarry.llm import rolling

    lengths = [len((r.text or "").encode()) for r in table]
    windows = [(k, s) for held in rolling.blocks(lengths, 40) for k, a, b in held for s in range(a, b - 39)]
    assert sorted(windows) == [(k, s) for k, n in enumerate(lengths) for s in range(n - 39)]


def test_odd_rows(spark):
    long = "The same text stands here twice, and so it all goes. " * 6
    table = spark.createDataFrame(
        [(1, long, "a", 1), (1, long, "a", 1), (None, "short", "b", None), (1, "other", None, 2)], "doc_id long, text string, row string, spans int"
    )
    out = suffix_dedup.remove_repeats(table, window=40, gram=8)
    assert got(out) == [(-1, 5, 0, 0, b"short"), (1, 5, 0, 0, b"other"), (1, len(long), len(long), 1, b""), (1, len(long), len(long), 1, b"")]
    assert suffix_dedup.remove_repeats(table.limit(0)).count() == 0


def test_multikey_quicksort_finds_equal_suffixes(monkeypatch):
    rng = np.random.default_rng(4)
    data = np.frombuffer(bytes(rng.choice(list(b"ab"), 900)) + b"abcd" * 100 + bytes(60), np.uint8)
    at = rng.permutation(len(data) - 60)
    for depth in (8, 13, 24, 40):
        seen = Counter(bytes(data[a : a + depth]) for a in at)
        expected = [seen[bytes(data[a : a + depth])] > 1 for a in at]
        for short in (40, 4096):
            monkeypatch.setattr(suffix_dedup, "SHORT", short)
            assert suffix_dedup.multikey_groups(suffix_dedup._eight_bytes(data), at, depth).tolist() == expected


def test_clashing_columns_pass_through(spark):
    names = ["__row", "__of", "row", "twin", "given", "mark", "__twin"]
    table = spark.createDataFrame([(1, "some text", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert tuple(suffix_dedup.remove_repeats(table).drop("kept", "spans").first()) == (1, "some text", *names, 9, 0, 0)
