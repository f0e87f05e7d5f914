"""Filters in front of the detection barrier.

Detection columns are evaluated once and in place, so Catalyst moves no filter below them. A job
that takes `where=` splits it here instead: conditions that the source's columns can answer are
applied to the source, where they reach the scan; the others wait for the columns they name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.logger import PySparkLogger
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Conditions = str | Column | Sequence[str | Column] | None


def conditions(where: Conditions) -> list[str | Column]:
    """The conditions, all of which must hold; one that is null for a row drops the row."""
    if where is None:
        return []
    return [where] if isinstance(where, (str, Column)) else list(where)


@contextmanager
def _quietly() -> Iterator[None]:
    """A name that does not resolve is an answer here, not an error to log."""
    logs = [PySparkLogger.getLogger(f"{kind}QueryContextLogger") for kind in ("SQL", "DataFrame")]
    before = [log.disabled for log in logs]
    for log in logs:
        log.disabled = True
    try:
        yield
    finally:
        for log, was in zip(logs, before):
            log.disabled = was


def apply_known(
    df: DataFrame, where: list[str | Column], columns: Sequence[str] | None = None
) -> tuple[DataFrame, list[str | Column]]:
    """The rows that meet every condition answerable from `columns` (all by default), and the rest.

    A condition counts as answerable when all names in it resolve; one with any other mistake raises.
    """
    known = df if columns is None else df.select(*columns)
    waiting = []
    for condition in where:
        try:
            # As a column, not as a filter: a filter may see columns that were dropped before.
            with _quietly():
                known.select(F.expr(condition) if isinstance(condition, str) else condition).schema
        except AnalysisException as problem:
            if "UNRESOLVED_COLUMN" not in (problem.getCondition() or ""):
                raise
            waiting.append(condition)
        else:
            df = df.where(condition)
    return df, waiting


def apply_rest(df: DataFrame, where: list[str | Column]) -> DataFrame:
    """Conditions on the finished columns; a name that is not there either raises."""
    for condition in where:
        df = df.where(condition)
    return df
