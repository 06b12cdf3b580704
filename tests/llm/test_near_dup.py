import numpy as np

from quarry.llm import near_dup, rolling
from quarry.llm.queries import op7_jaccard_join
from tests.conftest import SF


def brute(docs, n=5):
    """id -> (class id, links, set links)."""
    sets = {}
    for i, t in docs:
        w = (t or "").lower().encode().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    ids, root = list(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, distinct = {i: 0 for i in ids}, {i: set() for i in ids}
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a == b or (a and b and 10 * len(a & b) >= 8 * len(a | b)):
                links[i] += 1
                links[j] += 1
                if a != b:
                    distinct[i].add(b)
                    distinct[j].add(a)
                ri, rj = sorted((find(i), find(j)))
                root[rj] = ri
    return {i: (find(i), links[i], len(distinct[i])) for i in ids}


def got(df):
    return {r.doc_id: (r.class_id, r.n_links, r.n_set_links) for r in df.collect()}


def test_table_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(op7_jaccard_join(spark, SF)) == brute(docs)


def test_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    docs = [(k, " ".join(w if rng.random() > 0.01 else "x" for w in base)) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "one two"), (103, "ONE  two"), (104, " ".join(base) + " z")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute(docs)
    assert got(near_dup.near_duplicates(table)) == expected
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", 7)
    assert got(near_dup.near_duplicates(table)) == expected


def test_odd_rows(spark):
    schema = "doc_id long, text string, node string, id int"
    rows = [(1, "a b c d e f", "x", 1), (1, "other words in this text here", "x", 1), (None, "a b c d e f", "x", 1), (2, None, None, None)]
    table = spark.createDataFrame(rows, schema)
    found = near_dup.near_duplicates(table).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.n_links) for r in found) == [(0, 1, 1), (1, 1, 0), (1, 1, 1), (2, 2, 0)]
    assert near_dup.keep_one(table).columns == table.columns
    same = " ".join(f"w{k}" for k in range(30))
    twins = [(2, same, "a"), (5, same, "b"), (5, "quite another text of some seven words", "c"), (None, same, "d"), (7, "one of two rows", "e"), (7, "one of two rows", "e")]
    kept = near_dup.keep_one(spark.createDataFrame(twins, "doc_id long, text string, __key string"))
    assert sorted(tuple(r) for r in kept.collect()) == [twins[0], twins[2], twins[4]]
    assert near_dup.near_duplicates(table.limit(0)).count() == 0


def test_hashes_agree_with_a_plain_loop():
    words = rolling.split_words(["a bb ccc", None, "bb ccc"])
    hashes, offsets = rolling.word_hashes(words)
    assert offsets.tolist() == [0, 3, 3, 5] and hashes[1] == hashes[3] and hashes[2] == hashes[4]
    values = np.random.default_rng(0).integers(0, 9, 200)
    for width in (1, 2, 5, 13, 200):
        at = rolling.sliding_least(values, width)
        assert all(values[a] == min(values[s : s + width]) and a == max(k for k in range(s, s + width) if values[k] == values[a]) for s, a in enumerate(at))
