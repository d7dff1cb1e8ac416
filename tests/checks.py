"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows.

As a program: ``python tests/checks.py [--sf 0.01] [--time] [name-prefix ...]``.
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
import traceback
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{DATA}/sf{sf}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(cells, key=lambda r: [(v is None, str(type(v)), v) for v in r])


def spark_rows(df):
    return _sorted(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    result = con.execute(sql)
    return _sorted([d[0] for d in result.description], result.fetchall())


def differences(mine, theirs, show=3) -> list[str]:
    if mine[0] != theirs[0]:
        return [f"columns {mine[0]} != {theirs[0]}"]
    problems = []
    if len(mine[1]) != len(theirs[1]):
        problems.append(f"{len(mine[1])} rows != {len(theirs[1])} rows")
    wrong = [(a, b) for a, b in zip(mine[1], theirs[1], strict=False) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} rows differ")
        problems += [f"  spark {str(a)[:300]}\n  sql   {str(b)[:300]}" for a, b in wrong[:show]]
    types = lambda rows: [next((type(r[i]).__name__ for r in rows[1] if r[i] is not None), None) for i in range(len(rows[0]))]
    if not problems and types(mine) != types(theirs):
        problems.append(f"types {dict(zip(mine[0], zip(types(mine), types(theirs))))}")
    return problems


def main(args: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from floorspark.session import local_session

    sf = args[args.index("--sf") + 1] if "--sf" in args else "0.001"
    names = [a for i, a in enumerate(args) if not a.startswith("--") and (i == 0 or args[i - 1] != "--sf")]
    spark = local_session()
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        started = time.time()
        try:
            mine = spark_rows(build(spark, f"{DATA}/sf{sf}"))
            took = time.time() - started
            found = differences(mine, sql_rows(con, oracles[name])) if name in oracles else []
            note = "ok" if name in oracles else "rows only"
        except Exception as error:  # noqa: BLE001
            mine, took, found = ([], []), time.time() - started, [str(error)[:1500]]
            if "--trace" in args:
                traceback.print_exc()
        if found:
            bad += 1
        print(f"{name:12s} {len(mine[1]):8d} rows {took:6.2f}s  {'FAIL' if found else note}", *found, sep="\n   " if found else " ", flush=True)
        if "--show" in args:
            print("   ", mine[0], *[str(r)[:200] for r in mine[1][:4]], sep="\n    ")
    print(f"{bad} failed")
    spark.stop()
    return bad


if __name__ == "__main__":
    raise SystemExit(min(1, main(sys.argv[1:])))
