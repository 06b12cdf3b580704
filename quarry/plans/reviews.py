"""Registered queries of review assembly; orders, parts and lines stand for hits, works and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reviews as R
from ..runtime import table


def _hits(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 30).alias("section"), (F.col("l_partkey") % 200).alias("base"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("score"))


HITS = "h AS (SELECT l_suppkey % 30 AS section, l_partkey % 200 AS base, l_extendedprice / l_quantity AS score FROM lineitem)"
SECTIONS = f"""{HITS}, b AS (SELECT section, base, max(score) AS score FROM h WHERE base % 9 <> 0 GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY round(score, 9) DESC, base)::INT AS rank FROM b QUALIFY rank <= 8)"""


def _cited(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("base")).filter("base % 9 = 0").unionByName(spark.range(1).select(F.lit(0).cast("long").alias("base")))


def section_candidates(spark, sf_dir):
    return R.section_candidates(_hits(spark, sf_dir), _cited(spark, sf_dir)).select("section", "base", F.round("score", 6).alias("score"), "rank")


def gap_report(spark, sf_dir):
    return R.gap_report(R.section_candidates(_hits(spark, sf_dir), _cited(spark, sf_dir))).select("base", F.round("score", 6).alias("score"))


GAPS = f"WITH {SECTIONS} SELECT base, round(max(score), 6) AS score FROM s GROUP BY base ORDER BY round(max(score), 9) DESC, base LIMIT 15"


def map_groups(spark, sf_dir):
    candidates = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("base"), (F.col("p_partkey") % 60).alias("key"), F.col("p_retailprice").alias("score"))
    threads = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.concat(F.lit("t"), (F.col("s_suppkey") % 11).cast("string")).alias("thread"), (F.col("s_suppkey") % 47).alias("key"))
    return R.group_by_map(candidates, threads).select("base", "thread", "place")


MAP = """
WITH t AS (SELECT s_suppkey % 47 AS key, arg_min('t' || (s_suppkey % 11), s_suppkey) AS thread FROM supplier GROUP BY 1),
c AS (SELECT p_partkey AS base, thread, p_retailprice AS score FROM part JOIN t ON p_partkey % 60 = key),
g AS (SELECT thread, dense_rank() OVER (ORDER BY round(sum(score), 9) DESC, thread)::INT AS place FROM c GROUP BY thread)
SELECT base, thread, place FROM c JOIN g USING (thread)
"""


def batch_complete(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    requested = lines.select(F.col("l_orderkey").alias("plan"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("custom_id")).distinct()
    results = lines.filter("l_quantity > 3").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("custom_id")).distinct()
    return R.complete(requested, results)


COMPLETE = """
WITH q AS (SELECT l_orderkey AS plan, l_linenumber, max(l_quantity) > 3 AS there FROM lineitem GROUP BY ALL) SELECT plan, bool_and(there) AS ok FROM q GROUP BY plan
"""


def ticket_state(spark, sf_dir):
    parts = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 90).alias("ticket"), F.lit(1).alias("processing"), F.col("o_custkey").alias("succeeded"), F.lit(0).alias("errored"), F.when(F.col("o_orderstatus") == "F", "ended").otherwise("open").alias("status")
    )
    return R.tickets(parts)


TICKETS = "SELECT o_custkey % 90 AS ticket, count(*) AS processing, sum(o_custkey)::BIGINT AS succeeded, 0::BIGINT AS errored, bool_and(o_orderstatus = 'F') AS ended FROM orders GROUP BY 1"


def call_costs(spark, sf_dir):
    calls = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("chars_in"), F.col("p_size").alias("tokens_out"))
    names = table(spark, sf_dir, "part").select(F.substring("p_brand", 1, 7).alias("prefix")).distinct()
    prices = names.select(F.substring("prefix", -1, 1).alias("pos"), "prefix", F.lit(3.0).alias("per_in"), F.lit(15.0).alias("per_out"))
    return R.costs(calls, prices).groupBy("model").agg(F.round(F.sum("dollars"), 6).alias("dollars"), F.count(F.lit(1)).alias("calls"))


COSTS = """
SELECT p_brand AS model, round(sum(((p_partkey + 3000) // 3 * 3.0 + p_size * 15.0) / 1e6), 6) AS dollars, count(*) AS calls FROM part GROUP BY 1
"""

QUERIES = {
    "section_candidates": (section_candidates, f"WITH {SECTIONS} SELECT section, base, round(score, 6) AS score, rank FROM s"),
    "gap_report": (gap_report, GAPS),
    "map_groups": (map_groups, MAP),
    "batch_complete": (batch_complete, COMPLETE),
    "ticket_state": (ticket_state, TICKETS),
    "call_costs": (call_costs, COSTS),
}
