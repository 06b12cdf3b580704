"""Run registered queries against their DuckDB oracle: python -m tests.compare [sf_dir] [name ...]."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return bytes(v) if isinstance(v, bytearray) else v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both sides agree."""
    mine, got = rows(df.columns, df.collect()), con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    theirs = rows(names, got.fetchall())
    if mine == theirs:
        return ""
    odd = next(((a, b) for a, b in zip(mine, theirs) if a != b), None)
    return f"{len(mine)} rows against {len(theirs)}; first difference {str(odd)[:600]}"


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e

    sf_dir, wanted = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"), set(sys.argv[2:])
    spark, con, sql, bad = session(), duck(sf_dir), e.oracle_sql(), 0
    for name, f in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            df = f(spark, sf_dir)
            said = difference(df, con, sql[name]) if name in sql else f"ok without oracle: {df.count()} rows"
        except Exception as x:  # noqa: BLE001  reported per query
            said = f"{type(x).__name__}: {str(x)[:700]}"
        bad += bool(said) and not said.startswith("ok")
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
