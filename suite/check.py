"""Run registered queries and compare them with their SQL: `python -m suite.check [sf_dir] [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(x) for x in value)
    return float(value) if type(value).__name__ == "Decimal" else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0][0]} against {bad[0][1]}"
    if not a:
        return "no rows on either side"
    return None


def main(argv) -> int:
    from suite import session
    from suite.all import ORACLES, QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    spark, con, failed = session.local(), connect(sf_dir), 0
    for name in argv[1:] or QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        state = "FAIL" if problem else ("ok" if name in ORACLES else "rows")
        print(f"{state:5s}{time.time() - start:6.1f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
