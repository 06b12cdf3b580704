"""Contents pages by hand, and records behind given functions."""

from quarry.operators import contents as T
from quarry.sources import remote

LINE = "doc string, page int, line int, text string, x0 double, y0 double, x1 double, y1 double, bold boolean"


def book(spark):
    rows, k = [], 0
    pages = {
        1: ["Contents"] + [f"{n} Title number {n} ..... {10 * n}" for n in range(1, 7)],
        2: ["A title over", "two rows ..... 70", "8 Eight ..... 80", "9 Nine ..... 90", "10 Ten ..... 100", "11 Eleven ..... 110"],
        3: ["Plain text of the book that has no numbers at its end at all", "and goes on"],
    }
    for page, texts in pages.items():
        for i, t in enumerate(texts):
            title, _, no = t.partition(" ..... ")
            rows.append(("b", page, k, title, 10.0, 20.0 * i, 200.0, 20.0 * i + 10, False))
            if no:
                rows.append(("b", page, k + 1, no, 380.0, 20.0 * i + 1, 400.0, 20.0 * i + 11, False))
            k += 2
    lines = spark.createDataFrame(rows, LINE)
    sizes = spark.createDataFrame([("b", p, 420.0, 200) for p in pages], "doc string, page int, width double, pages int")
    return lines, sizes


def test_contents(spark):
    lines, sizes = book(spark)
    rows = T.rows(lines)
    assert [r.text for r in rows.filter("page = 1").orderBy("row").collect()][:2] == ["Contents", "1 Title number 1 10"]
    found = T.entries(rows, sizes)
    kinds = {r.page: (r.opens, r.extends) for r in T.page_kinds(found).collect()}
    assert kinds == {1: (True, True), 2: (True, True), 3: (False, False)}
    pages = T.contents_pages(T.page_kinds(found))
    assert sorted(r.page for r in pages.collect()) == [1, 2]
    got = T.carried(found, pages).orderBy("pos").collect()
    assert [(r.title, r.no) for r in got][5:8] == [("6 Title number 6", 60), ("A title over two rows", 70), ("8 Eight", 80)]
    assert len(got) == 11 and not any(r.roman for r in got)


def test_services(spark):
    served = [{"key": f"k{i}", "version": i} for i in range(7)]
    got = remote.paged(spark, lambda start, count: served[start : start + count], 7, "key string, version long", size=3)
    assert sorted(r.version for r in got.collect()) == list(range(7)) and remote.changed_since(got) == 6 and remote.changed_since(None) == 0
    known = {"a": {"title": "A"}}
    keys = spark.createDataFrame([("a",), ("a",), ("b",)], "doi string")
    assert [tuple(r) for r in remote.looked_up(keys, "doi", known.get, "title string").collect()] == [("a", "A")]
