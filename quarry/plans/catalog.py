"""Registered queries of the library's own operators, each with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chapters, console, graph, layout, lexical, maps, pages, prepare, refine, relational, reviews, sequences, streams, texts, work

MODULES = (chapters, console, maps, refine, layout, prepare, lexical, graph, sequences, relational, pages, reviews, streams, texts, work)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
