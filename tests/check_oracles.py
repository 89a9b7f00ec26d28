"""Runs the named queries against their checking SQL and reports every difference.

    python tests/check_oracles.py [sf_dir] [name or prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (round(value, 6) + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, plan, sf_dir):
    """None when equal, else a description of the difference."""
    df = plan.run(spark, sf_dir)
    left_cols, left = rows(df.columns, [tuple(r) for r in df.collect()])
    if plan.sql is None:
        return None, len(left)
    rel = con.execute(plan.sql)
    right_cols, right = rows([d[0] for d in rel.description], rel.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}", len(left)
    if left != right:
        lefts, rights = set(map(repr, left)), set(map(repr, right))
        only_left = [r for r in left if repr(r) not in rights][:4]
        only_right = [r for r in right if repr(r) not in lefts][:4]
        return f"{left_cols}\n  rows {len(left)} != {len(right)}\n  spark only {only_left}\n  check only {only_right}", len(left)
    return None, len(left)


def main() -> int:
    from siftlake.plans import PLANS
    from siftlake.session import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, p in PLANS.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, p, sf_dir)
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        state = "ok  " if problem is None else "FAIL"
        bad += problem is not None
        print(f"{state} {name:32s} rows={n:<7d} {time.time() - start:5.1f}s{'' if p.sql else '  (no check)'}", flush=True)
        if problem:
            print("  " + problem, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
