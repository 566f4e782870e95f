"""Compare registered queries with their SQL on DuckDB.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "replace") and hasattr(value, "year"):
        return value.replace(tzinfo=None).isoformat()
    return value


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def compare(spark, connection, run, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a description of the difference."""
    result = run(spark, sf_dir)
    names = sorted(result.columns)
    ours = [tuple(_plain(r[n]) for n in names) for r in result.collect()]
    relation = connection.sql(sql)
    if sorted(relation.columns) != names:
        return f"columns {names} against {sorted(relation.columns)}"
    order = [relation.columns.index(n) for n in names]
    theirs = [tuple(_plain(row[i]) for i in order) for row in relation.fetchall()]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    ours, theirs = _sorted(ours), _sorted(theirs)
    for a, b in zip(ours, theirs, strict=True):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            return f"first difference\n   spark {a}\n   sql   {b}\n   in {names}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as registry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    runs, oracles = registry.queries(), registry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or runs:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, connection, runs[name], oracles[name], sf_dir)
            else:
                problem = None if runs[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "oracle" if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {time.time() - start:.1f}s", flush=True)
        if problem:
            failed += 1
            print("   " + problem, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
