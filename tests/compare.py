"""Run registered queries beside their SQL twins in DuckDB and compare.

    python -m tests.compare [--sf 0.01] [name-part ...]
"""

from __future__ import annotations

import argparse
import math
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = os.environ.get("SPANLOOM_DATA", "/root/testdata")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else ("f", repr(value + 0.0))
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return (type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, fn, sql):
    start = time.time()
    df = fn(spark, folder)
    spark_rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return "rows-only", len(spark_rows), took, ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    other = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return "SCHEMA", len(spark_rows), took, f"{sorted(df.columns)} / {sorted(names)}"
    if len(spark_rows) != len(other):
        return "COUNT", len(spark_rows), took, f"spark {len(spark_rows)} sql {len(other)}"
    a, b = rows_of(df.columns, spark_rows), rows_of(names, other)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return ("ok", len(a), took, "") if not bad else ("VALUES", len(a), took, f"{len(bad)} differ; {bad[0]}")


def main():
    from spanloom.plans import all_queries, all_sql
    from tests.conftest import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session()
    folder = f"{DATA}/sf{args.sf}"
    con = connect(folder)
    sql = all_sql()
    bad = total = 0
    for name, fn in all_queries().items():
        if args.names and not any(n in name for n in args.names):
            continue
        total += 1
        try:
            status, n, took, note = compare(spark, con, folder, fn, sql.get(name))
        except Exception as error:  # report and go on with the next query
            status, n, took, note = "ERROR", 0, 0.0, str(error)[:700]
        bad += status not in ("ok", "rows-only")
        print(f"{name:42s} {status:9s} {n:8d} {took:6.2f}s {note[:900]}", flush=True)
    print(f"{total - bad}/{total} agree")


if __name__ == "__main__":
    main()
