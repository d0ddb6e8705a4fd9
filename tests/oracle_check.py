"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

Mirrors the driver's gate: row count, column names, and an
order-insensitive comparison of values. Usage:

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    return v if isinstance(v, (int, str, bool)) else str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = rows_of(s_cols, [tuple(r) for r in sdf.collect()])
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = rows_of(d_cols, res.fetchall())
    t2 = time.time()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    ok_n = len(s_rows) == len(d_rows)
    ok_v = s_rows == d_rows
    status = "OK " if (ok_cols and ok_n and ok_v) else "BAD"
    print(f"{status} {name:32s} rows spark={len(s_rows)} duck={len(d_rows)} "
          f"cols={'ok' if ok_cols else (sorted(s_cols), sorted(d_cols))} "
          f"vals={'ok' if ok_v else 'DIFF'} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s", flush=True)
    if not ok_v and ok_cols:
        diff_s = [r for r in s_rows if r not in set(d_rows)][:3]
        diff_d = [r for r in d_rows if r not in set(s_rows)][:3]
        print("   spark-only:", diff_s)
        print("   duck-only: ", diff_d)
    return status == "OK "


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    import __spark_entry__ as entry
    from quaystack.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = args or list(qs)
    bad = []
    for n in names:
        if n not in sqls:
            t0 = time.time()
            try:
                cnt = qs[n](spark, sf_dir).count()
                print(f"ROW {n:32s} rows={cnt} (no oracle) {time.time() - t0:.1f}s", flush=True)
            except Exception as e:
                print(f"ERR {n}: {type(e).__name__}: {str(e)[:400]}", flush=True)
                bad.append(n)
            continue
        try:
            if not compare(spark, con, n, qs[n], sqls[n], sf_dir):
                bad.append(n)
        except Exception as e:  # report and continue
            print(f"ERR {n}: {type(e).__name__}: {str(e)[:400]}", flush=True)
            bad.append(n)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
