"""Compares queries with their SQL on the given tables; also a command: python -m tests.oracle [SF] [QUERY...]."""

from __future__ import annotations

import glob
import math
import os
import sys

import duckdb

DATA = os.environ.get("VERILOOM_TESTDATA", "/root/testdata")


def _key(row: tuple) -> tuple:
    return tuple("\0" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in row)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None if both have the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{"/*.parquet" if os.path.isdir(p) else ""}')")
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    if sorted(cols) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} against {sorted(cols)}"
    names = sorted(cols)
    want = [tuple(r[cols.index(c)] for c in names) for r in rel.fetchall()]
    got = [tuple(r[c] for c in names) for r in df.collect()]
    a, b = sorted(got, key=_key), sorted(want, key=_key)
    if len(a) != len(b):
        return f"{name}: {len(a)} rows against {len(b)}"
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            same = math.isclose(u, v, rel_tol=1e-6, abs_tol=2e-6) if isinstance(u, float) and isinstance(v, float) else u == v or (isinstance(u, float) or isinstance(v, float)) and None not in (u, v) and math.isclose(float(u), float(v), rel_tol=1e-6, abs_tol=2e-6)
            if not same:
                return f"{name}: {dict(zip(names, x))} against {dict(zip(names, y))}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from veriloom.session import get_spark

    spark = get_spark()
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    for k, sql in entry.oracle_sql().items():
        if len(sys.argv) < 3 or any(a in k for a in sys.argv[2:]):
            try:
                print(k, compare(spark, k, entry.queries()[k], sql, f"{DATA}/{sf}") or "ok", flush=True)
            except Exception as e:  # noqa: BLE001
                print(k, "FAILED", str(e)[:600], flush=True)
