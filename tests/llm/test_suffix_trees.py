import numpy as np

from quarry.llm import rolling, suffix_trees
from quarry.llm.queries import op2_suffix_trees
from tests.conftest import SF


def word_brute(docs, min_words=50):
    """id -> (words, removed, spans) by every window of words, without anything of the operator's."""
    seen, out = {}, {}
    for d, t in sorted(docs):
        words = (t or "").encode().split()
        gone = np.zeros(len(words) + 2, int)
        for i in range(len(words) - min_words + 1):
            if seen.setdefault(tuple(words[i : i + min_words]), (d, i)) != (d, i):
                gone[i + 1 : i + min_words + 1] = 1
        out[d] = (len(words), int(gone.sum()), int((np.diff(gone) == 1).sum()))
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.n_spans) for r in df.collect()}


def test_longer_prefixes_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    passage = text(400)
    rows = [(k, " ".join(text(30) + passage[: 150 + 20 * (k % 5)] + text(60))) for k in range(25)]
    rows += [(50, " ".join(passage)), (51, " ".join(passage)), (60, None), (61, "a b")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = word_brute(rows)
    assert sum(v[1] for v in expected.values()) > 2000
    assert got(suffix_trees.remove_later(table)) == expected
    monkeypatch.setattr(suffix_trees, "GROUP_SUFFIXES", 4)
    assert got(suffix_trees.remove_later(table)) == expected


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(300))
    table = spark.createDataFrame([(1, long, 1), (1, long, 1), (None, long, 2), (2, "", None)], "doc_id long, text string, row int")
    rows = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in suffix_trees.remove_later(table).collect())
    assert rows[0] == (0, 300, 0) and rows[1] == rows[2] == (1, 300, 300) and rows[3] == (2, 0, 0)
    assert suffix_trees.remove_later(table.limit(0)).count() == 0


def test_short_passages_go_to_the_word(spark, monkeypatch):
    rng = np.random.default_rng(7)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows = []
    for k, n in enumerate([49, 50, 51, 55, 60, 70, 80, 100, 135]):
        passage = text(n)
        rows += [(3 * k, " ".join(text(40) + passage + text(45))), (3 * k + 1, " ".join(text(37) + passage + text(52) + passage)), (3 * k + 2, " ".join(passage))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = word_brute(rows)
    assert expected[0] == (134, 0, 0) and expected[2] == (49, 0, 0) and expected[4] == (189, 100, 2) and expected[5] == (50, 50, 1)
    assert got(suffix_trees.remove_later(table)) == expected
    monkeypatch.setattr(suffix_trees, "GROUP_SUFFIXES", 1)
    assert got(suffix_trees.remove_later(table)) == expected


def test_cycling_text_goes(spark):
    rows = []
    for p in range(1, 8):
        cycle = [f"c{p}x{k}" for k in range(p)] * (1000 // p)
        around = [f"a{p}x{k}" for k in range(30)], [f"b{p}x{k}" for k in range(30)]
        rows += [(2 * p, " ".join(around[0] + cycle)), (2 * p + 1, " ".join(around[1] + cycle))]
    expected = word_brute(rows)
    assert expected[2] == (1030, 999, 1) and expected[3] == (1030, 1000, 1)
    assert got(suffix_trees.remove_later(spark.createDataFrame(rows, "doc_id long, text string"))) == expected


def test_whole_table_to_the_word(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(op2_suffix_trees(spark, SF)) == word_brute(docs)


def test_long_documents_have_the_same_suffixes(monkeypatch):
    hashes = rolling.mix(np.random.default_rng(0).integers(0, 50, 3000).astype(np.uint64))

    def suffixes():
        found = suffix_trees.anchored(hashes, np.array([0, 0, 3000]), 50)
        low, at, high = rolling.unpack_run(found["run"])
        return {(m, s, a) for m, l, h, a in zip(found["mark"], low, high, at) for s in range(l, h + 1)}

    whole = suffixes()
    monkeypatch.setattr(rolling, "BLOCK", 200)
    assert suffixes() == whole and len(whole) == 2951


def test_nodes_are_those_of_equal_paths():
    rng = np.random.default_rng(5)
    words = rolling.mix(rng.integers(0, 2, 400).astype(np.uint64))
    start = np.concatenate([rng.permutation(380), [5]])
    for depth in (1, 7, 20):
        leaves, node = suffix_trees.deep_nodes(words, start, np.zeros(len(start), np.int64), depth)
        paths = {}
        for k, s in enumerate(start):
            paths.setdefault(tuple(words[s : s + depth]), set()).add(k)
        expected = {frozenset(p) for p in paths.values() if len(p) > 1}
        assert {frozenset(leaves[node == n].tolist()) for n in set(node.tolist())} == expected
