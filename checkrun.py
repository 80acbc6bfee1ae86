"""Compare registered queries with their SQL on one scale factor.

usage: python checkrun.py [sf_dir] [name ...]
PLAIN_SESSION=1 uses a session with Spark's own defaults.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

import argusframe.plans.all_queries as A
from argusframe.sources.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v + 0.0:.6f}".replace("-0.000000", "0.000000")
    if isinstance(v, int):
        return str(v)
    if type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.001"
    names = argv[1:] or list(A.QUERIES)
    if os.environ.get("PLAIN_SESSION"):
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    else:
        spark = local_session("checkrun")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = []
    for name in names:
        t0 = time.time()
        try:
            df = A.QUERIES[name](spark, sf)
            got = [tuple(r) for r in df.collect()]
            dt = time.time() - t0
            if name not in A.ORACLES:
                print(f"rows  {name:28s} {len(got):7d} rows {dt:6.2f}s", flush=True)
                continue
            cur = con.execute(A.ORACLES[name])
            want = cur.fetchall()
            g, gc = rows_of(df.columns, got)
            w, wc = rows_of([d[0] for d in cur.description], want)
            ok = g == w and gc == wc
            print(f"{'ok   ' if ok else 'DIFF '} {name:28s} {len(g):7d} vs {len(w):7d} {dt:6.2f}s", flush=True)
            if not ok:
                bad.append(name)
                print("   cols", gc, wc if gc != wc else "")
                gs, ws = set(g), set(w)
                for tag, s in (("spark", gs - ws), ("sql  ", ws - gs)):
                    for r in sorted(s)[:3]:
                        print("   ", tag, r)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:900]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
