"""Compare every registered query with its SQL on DuckDB, row by row.

Run as a script: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from redactstream.sources.views import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def _kind(rows, i):
    kinds = {type(r[i]).__name__ for r in rows if r[i] is not None}
    return sorted(kinds)


def compare(columns, rows, o_columns, o_rows) -> str:
    """Empty when equal, else what differs."""
    if sorted(columns) != sorted(o_columns):
        return f"columns {sorted(columns)} vs {sorted(o_columns)}"
    at = [columns.index(c) for c in sorted(columns)]
    o_at = [o_columns.index(c) for c in sorted(columns)]
    for c, i, j in zip(sorted(columns), at, o_at):
        a, b = _kind(rows, i), _kind(o_rows, j)
        if a and b and a != b:
            return f"column {c}: types {a} vs {b}"
    left = sorted((tuple(_cell(r[i]) for i in at) for r in rows), key=repr)
    right = sorted((tuple(_cell(r[i]) for i in o_at) for r in o_rows), key=repr)
    if len(left) != len(right):
        return f"{len(left)} rows vs {len(right)}; first {left[:2]} vs {right[:2]}"
    bad = [(x, y) for x, y in zip(left, right) if x != y]
    return f"{len(bad)} of {len(left)} rows differ, e.g. {bad[0]}" if bad else ""


def check(spark, con, sf_dir: str, query, sql: str | None) -> tuple[str, int]:
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return "", len(rows)
    cur = con.execute(sql)
    o_columns = [d[0] for d in cur.description]
    return compare(df.columns, rows, o_columns, cur.fetchall()), len(rows)


def main(argv: list[str]) -> int:
    from redactstream.plans.catalog import ORACLES, QUERIES
    from redactstream.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con = local_session("8"), connect(sf_dir)
    failed = 0
    for name in names:
        started = time.time()
        try:
            verdict, n = check(spark, con, sf_dir, QUERIES[name], ORACLES.get(name))
        except Exception as exc:
            verdict, n = f"{type(exc).__name__}: {str(exc)[:700]}", 0
        failed += bool(verdict)
        tag = "FAIL" if verdict else ("ok" if name in ORACLES else "rows")
        print(f"{tag:4} {name:28} {n:>7} rows {time.time() - started:6.2f}s {verdict}", flush=True)
    print(f"{failed} failed of {len(names)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
