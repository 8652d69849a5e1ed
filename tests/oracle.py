"""Compare registered queries with their SQL twins in DuckDB.

Run as a script: ``python tests/oracle.py SF_DIR [name part ...]``.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"create view {name} as select * from '{path}'")
    return con


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, Decimal):
        raise TypeError("decimal in output")
    if isinstance(x, float):
        return None if math.isnan(x) else repr(x + 0.0)
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    if hasattr(x, "item"):
        return cell(x.item())
    return str(x)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(cell(r[i])) for i in order) for r in rows), sorted(columns)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a short text that says what differs."""
    df = fn(spark, sf_dir)
    mine, my_cols = canonical([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(sql)
    theirs, their_cols = canonical(rel.fetchall(), [c[0] for c in rel.description])
    if my_cols != their_cols:
        return f"columns {my_cols} != {their_cols}"
    if len(mine) != len(theirs):
        extra = [r for r in mine if r not in set(theirs)][:2]
        missing = [r for r in theirs if r not in set(mine)][:2]
        return f"{len(mine)} rows != {len(theirs)}; extra {extra}; missing {missing}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{my_cols}: {a} != {b}"
    return None if mine else "EMPTY"


def main():
    from __spark_entry__ import oracle_sql, queries
    from ticklake.session import local_session

    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    sqls, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in sqls:
                result = compare(spark, con, fn, sqls[name], sf_dir)
                label = "ok" if result is None else ("ok (empty)" if result == "EMPTY" else "DIFF")
            else:
                result, label = f"{len(fn(spark, sf_dir).collect())} rows", "rows"
        except Exception as e:  # report and go on
            result, label = f"{type(e).__name__}: {str(e)[:600]}", "ERROR"
        bad += label in ("DIFF", "ERROR")
        print(f"{label:10} {time.time() - start:6.2f}s {name} {result or ''}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
