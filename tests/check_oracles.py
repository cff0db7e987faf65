"""Run registered queries against their oracle SQL: python tests/check_oracles.py [sf] [name-prefix ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(v):
    import datetime
    import math
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{type(v).__name__}:{v}"


def rows_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def compare(spark_df, con, sql):
    got = rows_of(spark_df.columns, spark_df.collect())
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(spark_df.columns) != sorted(rel.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(rel.columns)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, e.g.\n   spark {str(bad[0][0])[:400]}\n   sql   {str(bad[0][1])[:400]}", len(got)
    return None, len(got)


def main():
    import __spark_entry__ as entry
    from folioframe.session import build_session
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("0") else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = build_session(), connect(sf_dir)
    oracles, failed, done = entry.oracle_sql(), [], 0
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            t1 = time.time()
            if name in oracles:
                problem, n = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                problem = None
        except Exception as exc:  # noqa: BLE001
            problem, n, t1 = (traceback.format_exc()[-700:] if "-v" in args else str(exc)[:500]), -1, t0
        done += 1
        mark = "ok" if problem is None else "FAIL"
        print(f"{mark:4} {name} rows={n} {time.time()-t0:.1f}s {'' if name in oracles else '(no oracle)'}", flush=True)
        if problem:
            failed.append(name)
            print("     ", problem, flush=True)
    print(f"{done} run, {len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
