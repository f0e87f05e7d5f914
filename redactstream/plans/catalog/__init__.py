"""Every registered query, with the SQL that must give the same rows."""

from __future__ import annotations

from redactstream.plans.catalog import (  # noqa: F401
    corpus,
    detection,
    evaluation,
    reporting,
    routing,
    streams,
)
from redactstream.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
