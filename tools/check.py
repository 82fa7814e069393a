"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

usage: python tools/check.py [--sf DIR] [--quiet] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from mdq.plans import load_all
from mdq.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return str(v)


def compare(names, rows_a, cols_a, rows_b, cols_b):
    if sorted(cols_a) != sorted(cols_b):
        return f"columns {sorted(cols_a)} vs {sorted(cols_b)}"
    ia = [cols_a.index(c) for c in sorted(cols_a)]
    ib = [cols_b.index(c) for c in sorted(cols_b)]
    a = sorted(tuple(canon(r[i]) for i in ia) for r in rows_a)
    b = sorted(tuple(canon(r[i]) for i in ib) for r in rows_b)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, cols {sorted(cols_a)}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    if not a:
        return "EMPTY"
    return None


def main(argv):
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i : i + 2]
    quiet = "--quiet" in argv
    argv = [a for a in argv if not a.startswith("--")]
    queries, sql = load_all()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    spark = local_session(name="check")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="check-"))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    failed = []
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, sf)
            rows = df.collect()
            t1 = time.time()
            if name in sql:
                rel = con.execute(sql[name])
                cols = [d[0] for d in rel.description]
                msg = compare(name, [tuple(r) for r in rows], df.columns, rel.fetchall(), cols)
            else:
                msg = None if rows else "EMPTY"
            t2 = time.time()
        except Exception as e:  # report and go on with the next query
            msg, t1, t2, rows = f"{type(e).__name__}: {str(e)[:1500]}", time.time(), time.time(), []
        if msg:
            failed.append(name)
        if msg or not quiet:
            print(f"{'FAIL' if msg else 'ok  '} {name:34s} {len(rows):7d} rows spark {t1-t0:5.1f}s sql {t2-t1:5.1f}s {'' if name in sql else '(no sql)'} {msg or ''}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
