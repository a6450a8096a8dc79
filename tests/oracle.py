"""Run registered queries next to their SQL and report differences: ``python -m tests.oracle [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

import __spark_entry__ as entry

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark
labels conversations""".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value))
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = entry.queries()[name](spark, folder)
    mine = normal(df.columns, df.collect())
    query = entry.oracle_sql().get(name)
    if query is None:
        return None if mine[1] else "no rows"
    cursor = con.execute(query)
    theirs = normal([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} against {theirs[0]}"
    if not mine[1]:
        return "no rows"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return f"{len(mine[1])} rows against {len(theirs[1])}; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"
    return None


if __name__ == "__main__":
    from saldo.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:] or list(entry.queries())
    spark, con = local_session(8), connect(str(Path(folder)))
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "" if name in entry.oracle_sql() else " (rows only)"
        print(f"{'ok ' if problem is None else 'BAD'} {name}{kind} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
