"""Geometry by hand: glyphs, blocks and elements."""

from pyspark.sql import functions as F

from quarry.operators import layout as G

LINE = "doc string, page int, block int, line int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean"


def page(rows):
    """(block, text, x0, y0, x1, size, bold) rows of one page."""
    return [("d", 0, b, i, t, float(x0), float(y0), float(x1), float(y0 + 10), float(s), bold) for i, (b, t, x0, y0, x1, s, bold) in enumerate(rows)]


def test_glyphs_become_lines(spark):
    rows = [("d", 0, i, c, float(i), 0.0, i + 1.0, 10.0, 10.1, c == "a", c == "|") for i, c in enumerate("aab|cd")]
    df = spark.createDataFrame(rows, "doc string, page int, pos int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, brk boolean")
    got = G.lines_from_glyphs(df).orderBy("line").collect()
    assert [(r.text, r.x0, r.x1, r.size, r.bold) for r in got] == [("aab", 0.0, 3.0, 10.0, True), ("cd", 4.0, 6.0, 10.0, False)]


def test_blocks(spark):
    rows = page([(0, "a", 0, 0, 90, 10, False), (0, "b", 0, 11, 90, 10, False), (0, "c", 0, 40, 90, 10, False)])
    got = G.blocks(spark.createDataFrame(rows, LINE).drop("block"), F.lit(100.0)).orderBy("line").collect()
    assert [r.block for r in got] == [0, 0, 1]


def test_elements(spark):
    rows = page([
        (0, "A Big Title", 0, 0, 60, 16, True),
        (1, "A paragraph that is inter-", 0, 30, 100, 10, False), (1, "rupted and goes on here.", 0, 41, 60, 10, False), (1, "A second one begins at the left.", 0, 52, 100, 10, False),
        (2, "• one item", 5, 80, 60, 10, False), (2, "wrapped line", 5, 91, 100, 10, False), (2, "• two", 5, 102, 30, 10, False), (2, "after a gap, text.", 5, 130, 100, 10, False),
        (3, "This goes on over", 0, 150, 100, 10, False), (4, "the block.", 0, 170, 100, 10, False), (5, "xii", 0, 190, 10, 10, False),
    ])
    got = G.elements(spark.createDataFrame(rows, LINE)).orderBy("pos").collect()
    assert [(r.kind, r.level, r.text) for r in got] == [
        ("heading", 1, "A Big Title"), ("para", 0, "A paragraph that is interrupted and goes on here."), ("para", 0, "A second one begins at the left."),
        ("bullet", 0, "one item wrapped line"), ("bullet", 0, "two"), ("para", 0, "after a gap, text."), ("para", 0, "This goes on over the block."),
    ]


def test_tables_stand_once(spark):
    rows = page([(0, "cell a", 10, 10, 40, 10, False), (0, "cell b", 10, 22, 40, 10, False), (1, "Text below.", 0, 80, 100, 10, False)])
    tables = spark.createDataFrame([("d", 0, 0, 0.0, 0.0, 50.0, 50.0, "| a |")], "doc string, page int, pos int, x0 double, y0 double, x1 double, y1 double, markdown string")
    got = G.elements(spark.createDataFrame(rows, LINE), tables).orderBy("pos").collect()
    assert [(r.kind, r.text) for r in got] == [("table", "| a |"), ("para", "Text below.")]


def test_labels(spark):
    rows = page([(0, "A Big Title", 0, 0, 60, 16, True), (1, "first line of text", 0, 30, 100, 10, False), (1, "and the next one", 0, 41, 100, 10, False), (1, "- item", 0, 52, 30, 10, False)])
    got = G.labels(spark.createDataFrame(rows, LINE)).orderBy("line").collect()
    assert [r.label for r in got] == ["HEAD", "PARA", "CONT", "LIST"]


def test_printed_numbers_of_long_books(spark, tmp_path):
    import duckdb

    from quarry.operators import pages as P
    from quarry.plans import layout
    from tests.compare import difference

    # book 2 has pages from 9,990 on, book 4 from 10 million on; both have over 9,999
    rows = [(20 * (9990 + p) + 2, "old plate", 5) for p in range(40)] + [(20 * (10_000_000 + p) + 4, "hot bolt", 5) for p in range(40)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = layout.folio_offsets(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [(2, -5), (4, -5)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert difference(got, con, layout.FOLIOS) == ""
    assert P.folio_offset(spark.createDataFrame([(1, 12000 + p, 0, str(12000 + p)) for p in range(20)], "doc long, page long, line long, text string")).count() == 0
