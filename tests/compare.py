"""Runs queries and their SQL side by side: python tests/compare.py SF_DIR [NAME...]."""

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from graphloom.session import get_spark  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list):
        return tuple(map(norm, v))
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, con, name, sf):
    t = time.time()
    df = entry.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(x.asDict(True).values()) if False else tuple(x) for x in df.collect()])
    took = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"{sum(got[1].values())} rows, no SQL, {took:.1f} s"
    rel = con.execute(sql)
    want = rows([c[0] for c in rel.description], rel.fetchall())
    same = got == want
    note = f"{sum(got[1].values())} rows, {took:.1f} s"
    if not same:
        note += f" WANTED {sum(want[1].values())}; columns {got[0]} {want[0]}; only here {list((got[1] - want[1]).items())[:3]}; only SQL {list((want[1] - got[1]).items())[:3]}"
    return same, note


def connect(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


if __name__ == "__main__":
    sf = sys.argv[1]
    spark = get_spark("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[2:] or list(entry.queries())
    con = connect(sf)
    for n in names:
        try:
            ok, note = compare(spark, con, n, sf)
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", n, note, flush=True)
