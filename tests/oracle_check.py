"""Local stand-in for the driver's correctness gate: run every ``queries()`` entry
and its ``oracle_sql()`` at one scale and compare row count, column names and
the multiset of rows (columns sorted by name).

    python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


EXACT = os.environ.get("EXACT") == "1"


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else float(f"{v:.10g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = set(argv[1:])
    import __spark_entry__ as E
    from kpiloom.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    for kv in filter(None, os.environ.get("SPARK_CONF", "").split(",")):
        k, v = kv.split("=", 1)
        spark.conf.set(k, v)
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    skip_unchecked = os.environ.get("ORACLE_ONLY") == "1"
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if skip_unchecked and name not in sqls:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"rows {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(sqls[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: oracle error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(ocols):
            print(f"FAIL {name}: columns {sorted(scols)} vs {sorted(ocols)}")
            bad += 1
            continue
        a, b = _rows(scols, srows), _rows(ocols, orows)
        if a != b:
            diff = [x for x in a if x not in b][:3]
            diff2 = [x for x in b if x not in a][:3]
            print(f"FAIL {name}: {len(a)} vs {len(b)} rows; spark-only {diff}; oracle-only {diff2}")
            bad += 1
        else:
            print(f"ok   {name}: {len(a)} rows {ts:.1f}s")
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
