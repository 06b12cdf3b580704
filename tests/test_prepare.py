"""Preparation and search helpers that need no table."""

import pandas as pd
from pyspark.sql import functions as F

from quarry.operators import prepare as P
from quarry.operators import summaries as S


def test_only_rebuildable_tables_go():
    assert P.to_rebuild(1, ["documents", "lists"], ["lists"]) == ["documents"]
    assert P.to_rebuild(2, ["documents"], []) == [] and P.to_rebuild(None, ["a"], ["a"]) == []


def test_index_exists(spark):
    assert not P.index_exists(spark, "no_such_table")
    spark.range(1).write.mode("overwrite").saveAsTable("some_index")
    assert P.index_exists(spark, "some_index")
    spark.sql("DROP TABLE some_index")


def test_triplets_of_a_given_function(spark):
    @F.pandas_udf("array<struct<subject:string,verb:string,object:string>>")
    def first_three(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("subject", "verb", "object"), t.split()[:3]))] * 40)

    docs = spark.createDataFrame([(1, "boats cross rivers daily")], "doc_id long, text string")
    rows = P.triplets(docs, "doc_id", F.col("text"), first_three).collect()
    assert len(rows) == 30 and (rows[0].subject, rows[0].verb, rows[0].object) == ("boats", "cross", "rivers")


def test_odd_requests(spark):
    rows = [(1, "B", "Al Smith", "rivers run", "rivers"), (2, "A", "Bo Jones", "", "rivers and towns"), (3, "C", "Smithson", None, None)]
    docs = spark.createDataFrame(rows, "id long, title string, authors_raw string, summary string, body string")
    ids = lambda *a, **k: [r.id for r in P.search(docs, *a, **k).collect()]
    assert ids([]) == [2, 1, 3] and ids([], "smith") == [1] and ids(["rivers"]) == [1, 2] and ids(["rivers"], "Jones") == []
    assert ids(["nothing"]) == []


def test_modes_of_recognition(spark):
    row = spark.range(1).select(S.needs_ocr(F.lit(1), F.lit(2)).alias("half"), S.needs_ocr(F.lit(0), F.lit(0)).alias("none"), S.needs_ocr(F.lit(0), F.lit(9), "force").alias("forced"), S.needs_ocr(F.lit(9), F.lit(9), "off").alias("off")).first()
    assert (row.half, row.none, row.forced, row.off) == (True, False, True, False)
