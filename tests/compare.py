"""Runs catalogue queries on Spark and their SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value == int(value) else round(value, 6))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql) -> tuple[str | None, int]:
    names, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    other, right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != other:
        return f"columns {names} against {other}", 0
    if left != right:
        return (f"{sum(left.values())} against {sum(right.values())} rows; "
                f"only Spark: {list((left - right).items())[:3]}; only SQL: {list((right - left).items())[:3]}"), 0
    return None, sum(left.values())


if __name__ == "__main__":
    from pagesieve.plans import catalog
    from pagesieve.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    for name, fn in catalog.QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in catalog.ORACLE:
                diff, n = difference(df, con, catalog.ORACLE[name])
            else:
                diff, n = None, f"{df.count()} (rows only)"
        except Exception as err:  # noqa: BLE001
            diff, n = f"{type(err).__name__}: {str(err)[:600]}", ""
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - start:.1f}s {n} {diff or ''}", flush=True)
