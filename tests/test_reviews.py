"""Review assembly and properties of the operators by hand."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import lexical as L
from quarry.operators import library, metrics, sequences
from quarry.operators import reviews as R
from quarry.operators import themes as K
from quarry.operators import vector as V


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_planning(spark):
    sources = make(spark, [("A", False), ("B", True), ("C", False)], "stem string, changed boolean")
    made = make(spark, [("A", "sum"), ("C", "sum"), ("C", "para"), ("C", "quote")], "stem string, kind string")
    assert {r.stem: r.todo for r in R.plan_documents(sources, made).collect()} == {"A": ["para", "quote"], "B": ["sum", "para", "quote"]}
    stale = R.stale_summaries(make(spark, [("X_B_01",), ("X_B_02",), ("Y_C_01",), ("Z",)], "stem string"), make(spark, [("X_B_01",)], "stem string"))
    assert [r.stem for r in stale.collect()] == ["X_B_02"]
    assert R.choose_mode(1) == "serial" and R.choose_mode(5, "batch") == "batch" and R.choose_mode(10_000) == "batch"
    assert spark.range(1).select(R.card(F.lit(8), F.lit(3)).alias("c")).first().c.asDict() == {"answered": 5, "share": 62}


def test_lookup_order(spark):
    schema = "work string, place int, source string, doi string, title string, authors array<string>, need_author boolean"
    tries = [
        ("Smith_Big idea here", 0, "own_doi", "10.1/a", "Another thing", ["Smith"], False), ("Smith_Big idea here", 1, "export", "10.1/b", "The big idea here", ["Jones"], False),
        ("Smith_Big idea here", 2, "search", "10.1/c", "Big idea here", ["Smith"], True), ("Jones_Late entry", 2, "search", "10.1/d", "Late entry", ["Smith"], True),
    ]
    assert [tuple(r) for r in R.confirmed(make(spark, tries, schema)).collect()] == [("Smith_Big idea here", "10.1/b", "export", 1.0)]
    papers = make(spark, [("A_B_01",), ("A_B_02",), ("C_D",), ("E_F",)], "base string")
    got = R.works_to_fetch(papers, make(spark, [("C_D",)], "base string"), excluded=make(spark, [("E_F",)], "work string"))
    assert [tuple(r) for r in got.collect()] == [("A_B", ["A_B_01", "A_B_02"])]


def test_drafts(spark):
    text = make(spark, [(0, "One", "Some words here."), (1, "Two", "  "), (2, "Three", "More.")], "pos int, label string, text string")
    assert tuple(R.manuscript(text).first()) == ("## One\n\nSome words here.\n\n## Three\n\nMore.", 4)
    words = make(spark, [(84, 100), (100, 100), (116, 100)], "w int, t int")
    assert [r.v for r in words.select(R.within_target(F.col("w"), F.col("t")).alias("v")).collect()] == ["under", "ok", "over"]
    works = make(spark, [("a", "Smith Ann"), ("b", "Jones Bob"), ("c", "Li Wu")], "base string, authors string")
    pick = lambda line: sorted(r.base for r in R.works_for_section(F.lit(line), works).collect())
    assert pick("Smith; Jones") == ["a", "b"] and pick("Smith") == ["a", "b", "c"]
    filled = R.backfill(make(spark, [("a", 0)], "base string, pos int"), make(spark, [("a", 1), ("c", 2), ("b", 3)], "base string, rank int"), 2)
    assert [r.base for r in filled.collect()] == ["a", "c"]


def test_fusion_is_a_permutation_and_follows_the_ranks(spark):
    ranks = lambda order: make(spark, [(d, k + 1) for k, d in enumerate(order)], "doc int, rank int")
    fused = V.fuse(ranks([0, 1, 2]), ranks([2, 0, 1])).orderBy(F.col("rrf").desc()).collect()
    assert [(r.doc, round(r.rrf, 6)) for r in fused] == [(0, 0.032522), (2, 0.032266), (1, 0.032002)]


def test_global_rank_is_row_number(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 7919 % 1000).alias("v"))
    got = V.global_rank(rows, [F.col("v").desc(), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and [r.v for r in got] == sorted((r.v for r in got), reverse=True)


def test_islands_rebuild_their_sequence(spark):
    labels = [("p", k, "ABBACCC"[k % 7]) for k in range(30)] + [("q", 0, None), ("q", 1, None)]
    rows = make(spark, labels, "base string, pos int, label string")
    runs = sequences.islands(rows).orderBy("base", "run").collect()
    assert [(r.base, p, r.label) for r in runs for p in range(r.first, r["last"] + 1)] == labels


def test_scores_of_a_perfect_prediction(spark):
    rows = make(spark, [("d", k, x, x) for k, x in enumerate(["HEAD", "PARA", "CONT", "CONT", "PARA", "CONT"])], "doc string, pos int, gold string, pred string")
    s = metrics.boundary_scores(rows).first()
    assert (s.f1, s.pk, s.windowdiff, s.type_acc) == (1.0, 0.0, 0.0, 1.0)


def test_search_block_by_block(spark, monkeypatch):
    rows = make(spark, [(k, [float(k % 5), float(k % 3), 1.0]) for k in range(40)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, V.search(rows, rows, 4).collect()))
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    again = sorted(map(tuple, V.search(rows, rows, 4).collect()))
    assert [(a, b, r) for a, b, _, r in whole] == [(a, b, r) for a, b, _, r in again]


def test_index_embeds_only_new_works(spark):
    embed = V.hashing_embedder(8)
    one = V.build_index(make(spark, [("a", "some text")], "base string, text string"), None, embed)
    two = V.build_index(make(spark, [("a", "changed"), ("b", "more text")], "base string, text string"), one, embed)
    assert sorted((r.base, r.text) for r in two.collect()) == [("a", "some text"), ("b", "more text")]


def test_strength_and_bands(spark):
    runs = make(spark, [(i, r, c) for i, cs in enumerate([(0, 0), (0, 0), (0, 1), (-1, 1)]) for r, c in enumerate(cs)], "item int, run int, label int")
    final = make(spark, [(0, 0), (1, 0), (2, 1), (3, 1)], "item int, cluster int")
    assert {r.item: r.strength for r in K.strength(runs, final).collect()} == {0: 1.0, 1: 1.0, 2: 0.5, 3: 0.5}
    assert K.thread_band(100) == [6, 8, 10, 12] and K.thread_band(100, 5) == [5] and K.least_cluster(100, 5) == 6


def test_library_cases(spark):
    files = make(spark, [("p1", "text_A.md"), ("p2", "A.pdf"), ("p3", "B.pdf")], "path string, name string")
    from quarry.sources import files as S

    assert sorted((r.stem, r.path) for r in S.discover(files).collect()) == [("A", "p1"), ("B", "p3")]
    pages = make(spark, [(None,), (100,), (101,)], "n int")
    for length, expected in (("any", [True, True, True]), ("books", [False, False, True]), ("papers", [False, True, False])):
        assert [r.v for r in pages.select(library.fits_length(F.col("n"), length).alias("v")).collect()] == expected


def test_no_terms_no_scores(spark):
    docs = make(spark, [(1, ["a"]), (2, [])], "id int, t array<string>")
    assert {r.doc: r.score for r in L.okapi(docs, "id", F.col("t"), ["zzz"]).collect()} == {1: 0.0, 2: 0.0}
    with pytest.raises(ValueError):
        R.costs(make(spark, [("m", 1, 1)], "model string, chars_in int, tokens_out int"), spark.range(2000).select(F.col("id").alias("pos"), F.lit("x").alias("prefix"), F.lit(1.0).alias("per_in"), F.lit(1.0).alias("per_out")))


def test_equal_groups_are_placed_by_name(spark):
    # a and d hold many scores, whose sum as floating-point numbers isn't quite that of b and c
    rows = [(k, "a", 900.1) for k in range(1000)] + [(1000, "b", 900100.0), (1001, "c", 1800200.0)] + [(2000 + k, "d", 1800.2) for k in range(1000)]
    threads = make(spark, [(k, t, t) for k, t in enumerate("abcd")] + [(9, "z", t) for t in "abcd"], "pos long, thread string, key string")
    placed = R.group_by_map(make(spark, rows, "base long, key string, score double"), threads)
    assert sorted({(r.thread, r.place) for r in placed.collect()}) == [("a", 3), ("b", 4), ("c", 1), ("d", 2)]
    assert placed.count() == 2002
    huge = R.group_by_map(make(spark, [(1, "a", 1e30), (2, "b", 2e30)], "base long, key string, score double"), threads)
    assert {(r.thread, r.place) for r in huge.collect()} == {("a", 2), ("b", 1)}
