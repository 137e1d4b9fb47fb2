"""Run registered queries against their SQL twins: ``python tools/check.py [pattern] [folder]``."""
from __future__ import annotations

import math
import re
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b and type(a) is type(b)


def near(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-6)
    return same(a, b)


def compare(spark, con, folder, name, fn, sql):
    t = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    dt = time.time() - t
    if sql is None:
        return f"rows-only {len(got)}", dt, True
    rel = con.sql(sql)
    cols, want = rel.columns, rel.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {df.columns} {cols}", dt, False
    g, w = rows_of(df.columns, got), rows_of(cols, want)
    if len(g) != len(w):
        return f"ROWS {len(g)} != {len(w)}", dt, False
    exact = all(same(a, b) for r, s in zip(g, w) for a, b in zip(r, s))
    if exact:
        return f"ok {len(g)}", dt, True
    bad = [(r, s) for r, s in zip(g, w) if not all(near(a, b) for a, b in zip(r, s))]
    return (f"DIFF {len(bad)}/{len(g)} {bad[:2]}" if bad else f"NEAR {len(g)}"), dt, False


def connect(folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


if __name__ == "__main__":
    from canopyframe.plans import ORACLES, QUERIES
    from canopyframe.session import local_session

    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    folder = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    total, failed = 0.0, []
    for name, fn in QUERIES.items():
        if not re.search(pattern, name):
            continue
        try:
            msg, dt, ok = compare(spark, con, folder, name, fn, ORACLES.get(name))
        except Exception as e:  # report and go on
            msg, dt, ok = "ERROR " + str(e)[:500], 0.0, False
        total += dt
        if not ok:
            failed.append(name)
        print(f"{name:42s} {dt:6.2f}s {msg[:700]}", flush=True)
    print(f"{total:.1f}s failed: {failed}")
