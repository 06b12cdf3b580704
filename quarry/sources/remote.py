"""Records from services, behind a function the caller gives; nothing here opens a connection of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def paged(spark: SparkSession, fetch: Callable[[int, int], list[dict]], total: int, schema: str, size: int = 100, at_once: int = 4) -> DataFrame:
    """All records of a service that serves pages: ``fetch(start, count)`` runs on executors, a few pages at once."""
    starts = spark.range(0, max(total, 0), size).repartition(at_once)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in frame["id"]:
                yield pd.DataFrame(fetch(int(start), size), columns=names)

    return starts.mapInPandas(run, schema)


def looked_up(keys: DataFrame, key: str, fetch: Callable[[str], dict | None], schema: str, at_once: int = 4) -> DataFrame:
    """Keys with the record a service has for them; keys it doesn't know drop out."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k, fetch(k)) for k in frame[key]]
            yield pd.DataFrame([{key: k, **r} for k, r in found if r is not None], columns=[key, *names])

    kind = keys.schema[key].dataType.simpleString()
    return keys.select(key).distinct().repartition(at_once).mapInPandas(run, f"{key} {kind}, {schema}")


def changed_since(copy: DataFrame | None, version: str = "version") -> int:
    """High-water mark of a kept copy, 0 without one."""
    return 0 if copy is None else copy.agg(F.coalesce(F.max(version), F.lit(0))).first()[0]
