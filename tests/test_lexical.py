"""Ranking within a document on texts that hold no term at all."""

from quarry.operators import lexical as L
from quarry.functions import text as X
from pyspark.sql import functions as F

OTHER = "Это очень длинное предложение без единой латинской буквы или цифры в нём вообще."


def test_salient_sentences_without_tokens(spark):
    docs = spark.createDataFrame([(1, OTHER), (2, "The method of data is the best one of all."), (3, None)], "id long, text string")
    got = L.salient(docs, "id", F.col("text"), ["the", "of"]).collect()
    assert sorted((r.doc, r.pos, r.rank) for r in got) == [(1, 0, 1), (2, 0, 1)]


def test_selected_passages_without_tokens(spark):
    docs = spark.createDataFrame([(1, "|".join(["…"] * 20)), (2, "of it|other"), (3, "")], "id long, text string")
    kept = L.select_passages(docs, "id", F.filter(F.split("text", r"\|"), lambda x: x != ""), ["the", "of"])
    assert sorted((r.doc, r.pos) for r in kept.collect()) == [(1, k) for k in range(12)] + [(2, 0), (2, 1)]


def test_selected_passages_scores_once(spark):
    docs = spark.createDataFrame([(1, "of it|other")], "id long, text string")
    kept = L.select_passages(docs, "id", F.split("text", r"\|"), ["the", "of"])
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    # no filter works the scores out again below the last explode
    assert not [x for x in plan.splitlines() if "Filter " in x and "array_sort" in x]
