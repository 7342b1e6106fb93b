"""Compare every registered query with its DuckDB oracle (like the driver).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: name, status, spark rows, oracle rows, seconds.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

EXACT = bool(os.environ.get("EXACT"))  # compare floats bit for bit
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, dict):
        return {k: norm(x) for k, x in v.items()}
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr([norm(r[i]) for i in order]) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    import __spark_entry__ as E
    from tidewater import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in sorted(qs):
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"{name:28s} rows-only   spark={len(srows)} {ts:.1f}s")
            continue
        try:
            cur = con.execute(sqls[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SQL-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ok_cols = sorted(scols) == sorted(ocols)
        ok_n = len(srows) == len(orows)
        ok_h = ok_cols and digest(scols, srows) == digest(ocols, orows)
        status = "OK" if (ok_cols and ok_n and ok_h) else "MISMATCH"
        if status != "OK":
            bad += 1
        print(f"{name:28s} {status:9s} spark={len(srows)} oracle={len(orows)} cols={ok_cols} {ts:.1f}s")
        if status != "OK" and os.environ.get("SHOW"):
            if not ok_cols:
                print("   spark cols", sorted(scols), "\n   sql cols  ", sorted(ocols))
            else:
                o1 = sorted(range(len(scols)), key=lambda i: scols[i])
                o2 = sorted(range(len(ocols)), key=lambda i: ocols[i])
                a = sorted(repr([norm(r[i]) for i in o1]) for r in srows)
                b = sorted(repr([norm(r[i]) for i in o2]) for r in orows)
                diff_a = [x for x in a if x not in set(b)][:3]
                diff_b = [x for x in b if x not in set(a)][:3]
                print("   spark-only", diff_a, "\n   sql-only  ", diff_b)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
