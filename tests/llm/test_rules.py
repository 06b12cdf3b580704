"""Line dedup, quality rules, sharding, WARC and decontamination on odd rows and against plain versions."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import decontam, line_dedup, oracles, quality_rules, sharding, warc
from quarry.llm.queries import op1_decontamination, op3_warc, op9_sharding, queries
from tests.compare import difference, duck
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_against_sql(spark, name):
    assert difference(queries()[name](spark, SF), duck(SF), oracles.oracle_sql()[name]) == ""


LINE = "This line is long enough to count as shared by documents"


def test_line_dedup_odd_rows(spark):
    rows = [(k, f"own {k}\n {LINE.upper()}\t\n", "x", k) for k in range(4)] + [(None, LINE, None, 0), (9, f"{LINE}\n{LINE}", "x", 1)]
    rows += [(10, None, "x", 1), (11, "", "x", 1), (11, LINE + "É", "x", 1), (3, "\n" + LINE, "x", 9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, __p string, n_lines long")
    out = sorted(((r.doc_id if r.doc_id is not None else -1), r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(table).collect())
    assert out == [
        (-1, "", 1, 1), (0, "own 0\n", 3, 1), (1, "own 1\n", 3, 1), (2, "own 2\n", 3, 1), (3, "", 2, 1), (3, "own 3\n", 3, 1),
        (9, f"{LINE}\n{LINE}", 2, 0), (10, "", 1, 0), (11, "", 1, 0), (11, LINE + "É", 1, 0),
    ]
    assert line_dedup.dedup_lines(table.limit(0)).count() == 0
    few = spark.createDataFrame([(1, LINE, "a")] * 5 + [(9, LINE, "b")], "doc_id long, text string, __id string")
    assert [tuple(r) for r in line_dedup.dedup_lines(few).filter("n_dropped = 0").collect()] == [(1, LINE, "a", 1, 0)] * 5 + [(9, LINE, "b", 1, 0)]


def test_quality_odd_rows(spark):
    good = " ".join(f"word{k}" for k in range(80))
    rows = [(1, None, None, None, 1), (1, "", "en", "s", 1), (2, "a b " * 60, "en", "s", 1), (3, good, None, None, None), (3, good, "en", "s", 2)]
    rows += [(4, " ".join(f"w*&{k}" for k in range(80)), "en", "s", 1), (None, good, "en", "s", 1)]
    rows += [(10 + k, " ".join(f"w{k}x{j}" for j in range(80)), "en", "s", 1) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, v int")
    verdicts = {(r.doc_id, r.lang, r.n_words): (r.base_failed, r.kept) for r in quality_rules.judge(table).collect()}
    assert verdicts[1, None, 0] == (True, False) and verdicts[1, "en", 0] == (True, False) and verdicts[2, "en", 120] == (True, False)
    assert verdicts[3, None, 80] == (False, True) and verdicts[3, "en", 80] == (False, True) and verdicts[None, "en", 80] == (False, True)
    assert verdicts[4, "en", 80] == (False, False)
    assert all(kept for (d, _, _), (_, kept) in verdicts.items() if d and d >= 10)
    kept = quality_rules.keep_good(table)
    assert kept.columns == table.columns and kept.count() == 303
    assert quality_rules.judge(table.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=80))
def test_repeated_words_by_hand(spark, words):
    from pyspark.sql import functions as F

    seen = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) for j in range(3) if seen[tuple(words[k : k + 3])] > 1}
    got = spark.createDataFrame([(words,)], "w array<string>").select(quality_rules.repeated_words(F.col("w"))).first()[0]
    assert got == len(covered)


def test_many_repeats_take_the_sorting_path(spark):
    from pyspark.sql import functions as F

    words = [f"w{k % 40}" for k in range(100)] + ["end"]
    got = spark.createDataFrame([(words,)], "w array<string>").select(quality_rules.repeated_words(F.col("w"))).first()[0]
    assert got == 100


def test_sharding_law(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_sharding(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    assert all(r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_is_uniform_and_repeatable(spark):
    table = spark.range(4000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "doc_id as shard", "'x' as slot")
    run = lambda seed: sharding.shard_rows(table, shards=4, seed=seed, rows_per_partition=300).collect()
    one = run(1)
    assert sorted(map(tuple, one)) == sorted(map(tuple, run(1))) != sorted(map(tuple, run(2)))
    low = Counter(r.shard for r in one if r.doc_id < 1000)
    assert all(180 < n < 320 for n in low.values())  # 250 each, standard deviation 12
    assert abs(np.corrcoef([r.doc_id for r in one], [r.slot for r in one])[0, 1]) < 0.06
    assert sharding.shard_rows(table.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None), (1, "a"), (1, "a"), (1, None)], "doc_id long, t string")
    assert sorted(r.slot for r in sharding.shard_rows(odd, shards=2).collect()) == [0, 0, 1, 1]


def test_matrix_and_large_urns():
    rng = np.random.default_rng(0)
    m = sharding.communication_matrix([5, 0, 30, 15], [20, 20, 10], 3)
    assert m.sum(axis=1).tolist() == [5, 0, 30, 15] and m.sum(axis=0).tolist() == [20, 20, 10]
    draws = np.array([sharding.hypergeometric(rng, 3 * 10**9, 10**9, 1000) for _ in range(2000)])
    assert abs(draws.mean() - 750) < 2 and abs(draws.std() - 13.7) < 1


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row), row.index(min(row))


@settings(max_examples=300, deadline=None)
@given(st.text("ab c", min_size=1, max_size=90), st.text("ab c", max_size=60))
def test_myers_is_the_plain_distance(pattern, text):
    assert decontam.myers(pattern, text) == plain_distance(pattern, text)


def test_decontamination_against_plain_search(spark):
    docs = [(r.doc_id, decontam.normalise(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, decontam.normalise(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id) for r in op1_decontamination(spark, SF).collect() if r.distance == 0}
    assert found == {(d, i) for d, t in docs for i, x in items if x and x in t}


def test_decontamination_finds_edited_passages(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(6)] + [(90, None), (91, ""), (92, "tiny")]
    docs, expected = [(500, None), (501, "")], {}
    for k, text in items[:6]:
        for edits in (0, 3, 11, 14):
            changed = list(text.upper())
            for at in rng.choice(len(changed), edits, replace=False):
                changed[at] = "~"
            docs.append((10 * k + len(docs), " ".join([word() for _ in range(30)] + ["".join(changed)] + [word()])))
            distance = plain_distance(text, decontam.normalise(docs[-1][1]))[0]
            if distance <= len(text) // 10:
                expected[docs[-1][0], k] = distance
    docs += [(700, "a tiny thing"), (None, items[0][1])]
    expected |= {(700, 92): 0, (None, 0): 0}
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contaminated(table, bench).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in rows} == expected
    texts = dict(docs)
    for r in rows:
        stretch = decontam.normalise(texts[r.doc_id])[r.start : r.end]
        assert plain_distance(dict(items)[r.item_id], stretch)[0] == r.distance
    clean = decontam.keep_clean(table, bench)
    assert clean.count() == len(docs) - len(expected) and clean.columns == table.columns
    twins = spark.createDataFrame([(None, "clean"), (None, docs[2][1]), (3, "clean"), (3, docs[2][1])], "doc_id long, text string")
    assert [r.text for r in decontam.keep_clean(twins, bench).collect()] == ["clean"] * 2
    assert decontam.contaminated(table, bench.limit(0)).count() == 0 and decontam.contaminated(table.limit(0), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, decontam.contaminated(docs, bench).collect()))
    monkeypatch.undo()
    assert one == sorted(map(tuple, decontam.contaminated(docs, bench).collect()))


def test_warc_round_trip(spark, tmp_path):
    trap = "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "http://a/\r\nx", "same", 1), (2, "http://b", "same", 1), (3, None, None, 1), (4, "u", "", 1), (5, "u", trap, 1), (6, "u", "é" * 70_000, 1), (7, "u", "own", 1), (7, "u", "own", 1), (7, "v", "own", 1), (6, "w", "own", 1), (None, "u", "own", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, type int")
    warc.write_captures(pages, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    captures = warc.resolve_revisits(warc.assemble(records)).collect()
    assert len(captures) == len(rows)
    found = {dict(c.metadata[0].fields).get("page-id"): c for c in captures}
    own = sorted((dict(c.metadata[0].fields).get("page-id", ""), c.uri, c.type) for c in captures if c.uri in "uvw" and (c.original or c).response.payload == b"own")
    assert own == [("", "u", "response"), ("6", "w", "revisit"), ("7", "u", "response"), ("7", "u", "response"), ("7", "v", "response")]
    assert all(len(c.requests) == 1 and len(c.metadata) == 1 for c in captures)
    assert bytes(found["5"].response.payload) == trap.encode() and any(bytes(c.response.payload) == ("é" * 70_000).encode() for c in captures)
    assert (found["1"].type, found["2"].type, found["3"].type, found["4"].type) == ("revisit", "response", "revisit", "response")
    assert found["1"].original.capture_id == found["2"].capture_id and found["1"].uri == "http://a/ x"
    warc.write_captures(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_records(spark, str(tmp_path / "none")).count() == 0


def test_warc_query_takes_odd_pages(spark, tmp_path):
    rows = [(None, None, None), (None, "u", "a"), (1, "u", "a"), (1, "u", "a"), (2, "u", None), (3, "u", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in op3_warc(spark, str(tmp_path)).collect())
    assert got == [(0, 0, "response", None), (0, 1, "response", None), (1, 1, "response", None), (1, 1, "response", None), (2, 0, "revisit", 3), (3, 0, "response", None)]


def test_warc_links_in_other_directions(spark):
    schema = "record_id string, type string, uri string, date string, concurrent_to array<string>, refers_to string, fields map<string,string>, payload binary, payload_bytes long, payload_digest string"
    row = lambda i, kind, to: (i, kind, "u", "d", to, None, None, b"p", 1, "x")
    records = [row("r1", "response", ["q1"]), row("q1", "request", []), row("m1", "metadata", ["q1"]), row("m9", "metadata", ["nowhere"]), row("r2", "response", None)]
    out = {c.capture_id: c for c in warc.assemble(spark.createDataFrame(records, schema)).collect()}
    assert [x.record_id for x in out["r1"].requests] == ["q1"] and [x.record_id for x in out["r1"].metadata] == ["m1"]
    assert out["r2"].requests == [] and out["r2"].metadata == []
