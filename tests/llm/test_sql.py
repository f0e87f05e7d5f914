"""Every query of the subpackage that has SQL gives its rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from redactstream.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    rows = cur.fetchall()
    df = QUERIES[name](spark, SF).select(*columns)
    got = [tuple(r) for r in df.collect()]

    def cell(v):
        return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v

    def order(rows):
        return sorted((tuple(map(cell, r)) for r in rows), key=repr)

    assert order(got) == order(rows)
