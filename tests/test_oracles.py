"""Every registered query gives the rows of its SQL on DuckDB."""

from __future__ import annotations

import pytest
from conftest import SF
from oracle_check import check, connect

from redactstream.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    verdict, _ = check(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert verdict == ""


def test_entry_runs(spark):
    import __spark_entry__ as contract

    rows = contract.entry(spark)
    assert rows.columns == ["doc_id", "redacted", "n_findings"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
