"""Run queries against their DuckDB statements on one data directory.

    python -m verification.check [sf_dir] [name or prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from barquet.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        return v + 0.0 if v != 0 else 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def stored_names(names):
    """Column names as DuckDB stores them: the second of two `a` is `a_1`."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        n = seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}_{n}" if n else name)
    return out


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """(problem or None, number of rows)"""
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = stored_names([d[0] for d in cur.description])
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(set(df.columns) ^ set(names))}", 0
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(a)
    cols = sorted(names)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diff = {c: (p, q) for c, p, q in zip(cols, x, y) if p != q}
        return f"{len(bad)} of {len(a)} rows differ, e.g. {diff}", len(a)
    kinds = [
        (c, type(p).__name__, type(q).__name__)
        for x, y in zip(a, b) for c, p, q in zip(cols, x, y)
        if p is not None and type(p) is not type(q)
    ]
    return (f"types differ {sorted(set(kinds))}" if kinds else None), len(a)


def main(argv):
    from verification import ORACLES, QUERIES

    sf = next((a for a in argv if "/" in a), "/root/testdata/sf0.01")
    picks = [a for a in argv if "/" not in a]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name, fn in QUERIES.items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in ORACLES:
                problem, count = compare(df, con, ORACLES[name])
                n = f"{count} rows" if count else "NO ROWS"
            else:
                n, problem = f"rows only: {df.count()}", None
        except Exception as exc:  # report and go on
            problem, n = f"{type(exc).__name__}: {str(exc)[:600]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {time.time() - t0:6.2f}s {problem or n}",
              flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
