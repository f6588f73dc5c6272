"""Runs registered queries beside their SQL: python tests/compare.py [sf] [name...]."""

from __future__ import annotations

import datetime
import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

import __spark_entry__ as entry
from bandwright.session import builder


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in data)


def connection(d: str):
    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def compare(spark, con, d: str, name: str) -> str:
    t = time.time()
    df = entry.queries()[name](spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only {len(got[1])} {took:.1f}s"
    t = time.time()
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    if got == want:
        return f"ok {len(got[1])} {took:.1f}s (sql {time.time() - t:.1f}s)"
    a, b = set(got[1]), set(want[1])
    return f"DIFFERENT columns {got[0]} {want[0]} rows {len(got[1])} {len(want[1])}\n   ours {sorted(a - b)[:2]}\n   sql  {sorted(b - a)[:2]}"


if __name__ == "__main__":
    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "sf0.01"), sys.argv[2:]
    spark = builder(cores="8").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    d = f"/root/testdata/{sf}"
    con = connection(d)
    for n in entry.queries():
        if not names or any(n.startswith(x) for x in names):
            try:
                print(n, compare(spark, con, d, n), flush=True)
            except Exception:
                print(n, "ERROR", traceback.format_exc()[-700:], flush=True)
