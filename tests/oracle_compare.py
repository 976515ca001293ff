"""Run registered Spark queries and their DuckDB oracle side by side.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Compares sorted column names, row counts and the multiset of rows.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v) if v is not None else "None"


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    cols = sorted(sdf.columns)
    srows = [tuple(_norm(r[c]) for c in cols) for r in sdf.collect()]
    t1 = time.time()
    out = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    rel = con.sql(sql)
    dcols = sorted(rel.columns)
    out["cols_match"] = dcols == cols
    if dcols != cols:
        out["status"] = "schema-mismatch"
        out["spark_cols"], out["duck_cols"] = cols, dcols
        return out
    data = rel.fetchall()
    idx = [rel.columns.index(c) for c in cols]
    drows = [tuple(_norm(r[i]) for i in idx) for r in data]
    out["duck_rows"] = len(drows)
    out["duck_sec"] = round(time.time() - t1, 2)
    ss, ds = sorted(srows), sorted(drows)
    out["status"] = "ok" if ss == ds else "value-mismatch"
    if ss != ds:
        a, b = set(ss), set(ds)
        out["only_spark"] = sorted(a - b)[:3]
        out["only_duck"] = sorted(b - a)[:3]
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from pkgsift.session import build_session
    spark = build_session("local[8]")
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for n in (names or list(qs)):
        try:
            r = compare(spark, con, n, qs[n], sqls.get(n), sf_dir)
        except Exception as e:  # report and continue
            r = {"name": n, "status": "error", "error": repr(e)[:600]}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("BAD", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
