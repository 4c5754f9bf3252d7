"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, sf_dir, name, fn, sql, con):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = df.collect()
    t1 = time.time()
    scols = df.columns
    if sql is None:
        return f"{name}: rows-only {len(srows)} rows spark={t1 - t0:.1f}s"
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    t2 = time.time()
    if sorted(scols) != sorted(dcols):
        return f"{name}: COLUMNS differ spark={scols} duck={dcols}"
    a, b = canon(scols, srows), canon(dcols, drows)
    if a == b:
        return f"{name}: OK {len(a)} rows spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"
    diff = [x for x in a if x not in set(b)][:3]
    diff2 = [x for x in b if x not in set(a)][:3]
    return f"{name}: MISMATCH spark={len(a)} duck={len(b)}\n  spark-only {diff}\n  duck-only {diff2}"


def main():
    import __spark_entry__ as entry
    from canonry.session import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            msg = compare(spark, sf_dir, name, fn, sqls.get(name), con)
        except Exception as e:  # report and go on
            msg = f"{name}: ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += ("OK" not in msg and "rows-only" not in msg)
        print(msg, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
