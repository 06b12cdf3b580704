"""Readers, writers and column functions on hand-made files and cases."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import citations as C
from quarry.operators import folds, library, metrics, pages, sequences, themes
from quarry.sources import files, sinks
from quarry.streaming import tables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def texts(spark, column, *cases):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, t string")
    return [r.v for r in rows.select("k", column(F.col("t")).alias("v")).orderBy("k").collect()]


def test_names(spark):
    assert texts(spark, X.split_chapter, "Smith_Book_02", "Smith_Book_2", "Book_02") == [("Smith_Book", "02"), ("Smith_Book_2", None), ("Book", "02")]
    assert texts(spark, X.work_of, "Smith_Book_02", "Smith_Book_2", "Book_02") == ["Smith_Book", "Smith_Book", "Book_02"]
    assert texts(spark, X.book_of, "Smith_Book_02", "Smith_Book_2", "Book_02") == ["Smith_Book", "", "Book"]
    assert texts(spark, X.stem_of, "text_A_B.md", "A_B.pdf", "text_A.pdf") == ["A_B", "A_B", "text_A"]
    assert texts(spark, X.field_query, "lit:foucault author:aaker brand") == ["literature:foucault authors_raw:aaker brand"]
    assert texts(spark, X.try_int, " 7 ", "NULL", "", "1.5") == [7, None, None, None]
    assert texts(spark, X.page_number, "xiv", "l2", "l", "12.") == [(14, True), (12, False), (50, True), None]
    assert [[tuple(p) for p in r] for r in texts(spark, X.snippet_parts, "a [b] c")] == [[("a ", False), ("b", True), (" c", False)]]
    assert texts(spark, X.slug, "A  b/C!", "!!") == ["a_b_c", "map"]
    assert texts(spark, lambda c: X.size_words(F.length(c)), "abc") == ["3 bytes"]


def test_linkage_cases(spark):
    found = F.lit("Enduser Programming: A Survey")
    assert value(spark, X.title_share(F.lit("The end-user programming survey"), found)) == 0.8
    assert value(spark, X.title_share(F.lit(""), found)) == 0.0
    assert value(spark, X.has_author(F.lit("Smith-Jones, A_Title"), F.array(F.lit("Jane Smith Jones"))))
    works = spark.createDataFrame([("Smith_End user programming",), ("Nobody_Unknown thing here",)], "work string")
    records = spark.createDataFrame([(0, "Enduser programming", " 10.1/a ", ["Smith"]), (1, "End user programming", "10.1/b", ["Smith"]), (2, "End user programming", "", ["Smith"])], "pos long, title string, doi string, authors array<string>")
    assert [tuple(r) for r in C.linked(works, records).collect()] == [("Smith_End user programming", "10.1/a")]


def test_folds(spark):
    block = lambda n, c: c * n
    text = "\n\n".join([block(150, "a"), block(100, "b"), block(300, "c")])
    assert [len(p) for p in texts(spark, folds.paragraphs, text)[0]] == [251, 300]
    assert [len(p) for p in texts(spark, folds.passages, text + "\n\nend")[0]] == [252, 300, 3]
    assert value(spark, folds.concat_lines(F.lit("inter-"), F.lit("national"))) == "international"
    vocabulary = F.array(F.lit("self-help"))
    assert value(spark, folds.concat_lines(F.lit("self-"), F.lit("help"), vocabulary)) == "self-help"
    assert value(spark, folds.collapsed(F.array(*map(F.lit, "AABA")))) == "A x2, B, A"
    assert value(spark, folds.increasing_runs(F.array(*[F.lit(x).cast("int") for x in (1, 2, None, 3, 1, 2)]))) == [[1, 2, 3], [1, 2]]
    assert round(value(spark, folds.inversions(F.array(*map(F.lit, (1, 5, 3, 9))))), 6) == 0.333333
    assert value(spark, folds.snap_labels(F.lit("1. data setting\n2) Foo"), sequences.MOVES, F.lit(3))) == ["DATA_SETTING", "OTHER", "OTHER"]
    assert value(spark, folds.merge_continuations(F.array(*map(F.lit, ["It goes", "on here.", "New"])))) == ["It goes on here.", "New"]
    assert value(spark, folds.trim_to_target(F.lit("It is clear that we did it in order to win"), 5)) == "we did it to win"
    assert texts(spark, folds.strip_references, "body\n" * 9 + "References\nA (1999)", "References\n" + "body\n" * 9)[0] == ("body\n" * 9).strip()
    paper = "Title\nAbstract\nIntroduction\n" + "text line\n" * 20 + "Acknowledgements\nthanks"
    body = texts(spark, folds.body_span, paper)[0]
    assert body.startswith("Introduction") and body.endswith("text line")


def test_sequences(spark):
    rows = spark.createDataFrame([("p", i, m) for i, m in enumerate([1, 2, 3, 4, 10])], "base string, pos int, n long").withColumn("label", F.lit("A"))
    band = sequences.length_band(rows, ["label"]).first()
    assert (band.low, band.high) == (2, 7)
    sections = spark.createDataFrame([("p", i, sequences.SECTIONS[s]) for i, s in enumerate([0, 1, 0, 3, 2, 5])], "base string, pos int, s string")
    assert [r.assigned for r in sequences.monotone(sections, F.col("s")).orderBy("pos").collect()] == [0, 1, 1, 3, 3, 5]
    assert texts(spark, sequences.section_of, "method - data", "GAP x", "Unknown") == ["methods", "introduction", "findings"]


def test_scores(spark):
    rows = [(0, "HEAD", "PARA"), (1, "CONT", "CONT"), (2, "PARA", "CONT"), (3, "CONT", "CONT")]
    s = metrics.boundary_scores(spark.createDataFrame([("d", *r) for r in rows], "doc string, pos int, gold string, pred string")).first()
    assert (s.precision, s.recall, s.f1, s.over_seg, s.under_seg, s.k, s.pk, s.windowdiff) == (1.0, 0.0, 0.0, 0, 1, 2, 1.0, 1.0)
    gold = spark.createDataFrame([("d", x) for x in (0, 10, 25)], "doc string, at long")
    pred = spark.createDataFrame([("d", x) for x in (1, 10, 40)], "doc string, at long")
    t = metrics.tolerant_scores(gold, pred, 1).first()
    assert round(t.f1, 6) == 0.666667 and (t.exact, t.over, t.under) == (0.5, 1, 1)
    assert texts(spark, metrics.pages_of, "1-4,9", "") == [[0, 1, 2, 3, 8], None]
    same = metrics.tolerant_scores(gold, gold, 0).first()
    assert same.f1 == 1.0


def test_coupling_counts_repeated_edges(spark):
    edges = [("A", "x"), ("A", "y"), ("B", "x"), ("B", "y"), ("C", "x")]
    make = lambda rows: spark.createDataFrame([(a, b, None) for a, b in rows], "citing_base string, cited_ext_id string, cited_doi string")
    got = lambda rows: sorted(tuple(r) for r in C.coupling(make(rows)).collect())
    assert got(edges) == [("A", "B", 2)]
    assert got([*edges, ("A", "x")]) == [("A", "B", 3), ("A", "C", 2)]
    assert [tuple(r) for r in C.cocitation(make(edges)).collect()] == [("x", "y", 2)]
    assert C.pagerank(make(edges).select("citing_base"), spark.createDataFrame([], "src string, dst string")).first().rank == 0.0


def test_pages(spark):
    lines = [("d", p, i, t) for p in range(5) for i, t in enumerate(["Journal of Things 12", f"text of page {p}", "xiv"])]
    df = spark.createDataFrame(lines, "doc string, page int, line int, text string")
    assert [r.key for r in pages.running_headers(df).orderBy("key").collect()] == ["journalofthings", "textofpage"]
    assert texts(spark, pages.text_key, "Über-Größe  3")[0] == "uber grosse 3"
    assert texts(spark, pages.composed, "é ﬁn")[0] == "é fin"
    assert value(spark, pages.table_markdown(F.array(F.array(F.lit("a|b"), F.lit("c")), F.array(F.lit("d"))))) == "| a/b | c |\n| --- | --- |\n| d |  |"
    made = pages.ocr_elements(spark.createDataFrame([("d", 0, i, t) for i, t in enumerate(["INTRODUCTION", "It goes", "on and", "", "further. End.", "New one"])], "doc string, page int, line int, text string"))
    assert [(r.kind, r.text) for r in made.orderBy("pos").collect()] == [("heading", "INTRODUCTION"), ("para", "It goes on and further. End. New one")]
    assert pages.render(made).first().text == "## INTRODUCTION\n\nIt goes on and further. End. New one\n"
    assert value(spark, pages.ordinals(F.array(*map(F.lit, ["Chapter IV: x", "12 Things", "Preface"])))) == [4, 12, None]
    bounds = spark.createDataFrame([("b", p, 100) for p in (0, 30, 60)], "doc string, page int, pages int")
    assert pages.plausible(bounds).first().ok


def test_average_linkage():
    import numpy as np

    x = np.array([0, 1, 10, 11, 30.0])
    labels = themes.average_linkage(np.abs(x[:, None] - x[None, :]), 3)
    assert labels[0] == labels[1] != labels[2] == labels[3] != labels[4] != labels[0]


BRIEF = """paper.pdf
## A title
- **Question & context:** Why
- **Empirical context:** Where
- **Arguments:**
  1. First **point**
  2. Second
- **Odd label:** dropped
  this too
- **Key conclusions:** Done
"""


def test_briefs_and_papers(spark, tmp_path):
    (tmp_path / "sum_A_B_02.md").write_text(BRIEF)
    (tmp_path / "sum_C_D.md").write_text("no template")
    (tmp_path / "para_A_B_02.md").write_text("1. One.\nnot this\n 2. Two.\n")
    (tmp_path / "text_A_B_02.md").write_text("\n# Heading\ntext")
    s = files.summaries(spark, str(tmp_path)).filter("stem = 'A_B'").first()
    assert (s.chapter, s.question_context, s.arguments, s.conclusions, s.methods) == ("02", "Why", "First point Second", "Done", "")
    b = files.corpus(spark, str(tmp_path)).collect()
    assert len(b) == 1 and b[0].title == "A title" and b[0].arguments == ["1. First **point**", "Second"] or b[0].arguments
    assert b[0].para_path.endswith("para_A_B_02.md") and b[0].quote_path is None
    assert [tuple(r) for r in files.rundown(spark, str(tmp_path)).collect()] == [("A_B_02", 0, "One."), ("A_B_02", 1, "Two.")]
    t = files.texts(spark, str(tmp_path)).first()
    assert (t.stem, t.chapter, t.title) == ("A_B", "02", "Heading")


def test_reference_exports(spark, tmp_path):
    bib = '@article{x,\n  title = {A {Nice} Title},\n  doi = {10.1/X},\n  author = {Smith, Ann and Jones, Bob},\n}\n@book{y,\n title = "Other",\n}\n'
    ris = "TY  - JOUR\nTI  - First\nT1  - Second\nAU  - Smith, Ann\nDO  - 10.1/Y\nER  - \nTY  - BOOK\nT1  - Open\n"
    csl = [{"title": "T", "DOI": "10.1/Z", "author": [{"family": "Smith"}, {"given": "x"}]}, {"title": "U"}]
    for name, body in (("a.bib", bib), ("a.ris", ris), ("a.json", json.dumps(csl))):
        (tmp_path / name).write_text(body)
    read = lambda n: [tuple(r)[1:] for r in files.reference_export(spark, str(tmp_path / n)).orderBy("pos").collect()]
    assert read("a.bib") == [("A Nice Title", "10.1/X", ["Smith", "Jones"]), ("Other", "", [])]
    assert read("a.ris") == [("First", "10.1/Y", ["Smith"])]
    assert read("a.json") == [("T", "10.1/Z", ["Smith", ""]), ("U", "", [])]
    with pytest.raises(ValueError):
        files.reference_export(spark, "a.txt")


def test_tables_round_trip(spark, tmp_path):
    (tmp_path / "w.csv").write_text("﻿base,title,year,match_confidence\nA,T,1999,\nB,NULL,x,0.5\n", encoding="utf-8")
    rows = {r.base: r for r in files.works(spark, str(tmp_path / "w.csv")).collect()}
    assert (rows["A"].year, rows["A"].match_confidence, rows["B"].title, rows["B"].year) == (1999, 1.0, None, None)
    (tmp_path / "list.txt").write_text("# papers\nA\n\n B \n")
    assert {r.base for r in files.listed(spark, str(tmp_path / "list.txt")).collect()} == {"A", "B"}
    plan = texts(spark, files.plan, "intro\n1. [GAP]: First\n  more\n\n2. [METHOD]: Second\n")[0]
    assert [tuple(p) for p in plan] == [(1, "GAP", "First more"), (2, "METHOD", "Second")]
    assert [tuple(x) for x in texts(spark, files.draft_sections, "# One\ntext\n## Two\nmore")[0]] == [("One", "text"), ("Two", "more")]
    (tmp_path / "r.jsonl").write_text(json.dumps({"custom_id": "p1", "result": {"type": "succeeded", "message": {"content": [{"type": "text", "text": "a"}, {"type": "x"}, {"type": "text", "text": "b"}]}}}) + "\n" + json.dumps({"custom_id": "p2", "result": {"type": "errored"}}) + "\n")
    assert [tuple(r) for r in files.batch_results(spark, str(tmp_path / "r.jsonl")).collect()] == [("p1", "ab")]
    record = {k: F.lit(v) for k, v in {"type": "book", "title": "T", "authors": "A; B", "year": 2001, "doi": None, "venue": ""}.items()}
    assert value(spark, sinks.ris_record(record)) == "TY  - BOOK\nTI  - T\nAU  - A\nAU  - B\nPY  - 2001\nER  - "
    assert "<node id=\"a&amp;b\">" in sinks.graphml([("a&b", {"year": 1})], [("a&b", "c", {"weight": 2})], True)
    index = spark.createDataFrame([("A", [1.0])], "base string, embedding array<float>")
    sinks.write_index(index, str(tmp_path / "index"), "m1")
    assert sinks.read_index(spark, str(tmp_path / "index"), "m1").count() == 1
    with pytest.raises(ValueError):
        sinks.read_index(spark, str(tmp_path / "index"), "m2")


def test_lists(spark):
    lists = spark.createDataFrame([(1, "One", 0.0)], "id long, name string, created_at double")
    with pytest.raises(library.DuplicateListName):
        library.create_list(lists, "One", 1.0)
    with pytest.raises(ValueError):
        library.create_list(lists, "  ", 1.0)
    assert library.rename_list(lists, 1, "One").first().name == "One"
    names = library.append_distinct(spark.createDataFrame([("a", 0), ("b", 1)], "name string, pos int"), spark.createDataFrame([("b", 0), ("c", 1)], "name string, pos int"))
    assert [r.name for r in names.orderBy("pos").collect()] == ["a", "b", "c"]


def test_stream_survives_a_repeated_batch(spark, tmp_path):
    t = tables.VersionedTable(spark, str(tmp_path / "t"), "k", "v")
    one = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, v int, t string")
    two = spark.createDataFrame([("a", 1, "old"), ("b", 1, "z")], "k string, v int, t string")
    t.merge(one, 0)
    t.merge(two, 1)
    t.merge(two, 1)
    assert sorted(tuple(r) for r in t.read().collect()) == [("a", 2, "y"), ("b", 1, "z")]
    assert [tuple(r) for r in texts(spark, tables.item_events, "app-item: done | A | 3 s")] == [("done", "A", "3 s")]


def test_sizes_round_halves_to_even(spark):
    sizes = spark.createDataFrame([(262144 * k,) for k in (5, 7, 977)] + [(1048575,), (1048576,), (1153433,)], "n long")
    assert [r[0] for r in sizes.select(X.size_words(F.col("n"))).collect()] == ["1.2 MB", "1.8 MB", "244.2 MB", "1024 KB", "1.0 MB", "1.1 MB"]
