"""The audit trail: what was decided about each message, never what it said."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactstream.operators.routing import finding_action
from redactstream.schema import FINDING_COLUMNS, MESSAGE_COLUMNS


def audit_messages(
    decided: DataFrame,
    processed_ts: Column | None = None,
    latency_ms: Column | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """One row per record: table one of the trail."""
    return decided.withColumns(
        {
            "source_topic": F.col("topic"),
            "processed_ts": F.current_timestamp() if processed_ts is None else processed_ts,
            "latency_ms": F.lit(0.0) if latency_ms is None else latency_ms,
        }
    ).select(*MESSAGE_COLUMNS, *extra)


def audit_findings(decided: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per finding: type, field, position, tier, confidence - table two."""
    return (
        decided.select("message_id", "action", *extra, F.explode("findings").alias("f"))
        .select(
            "message_id",
            "f.entity_type",
            "f.field",
            "f.span_start",
            "f.span_end",
            "f.tier",
            "f.confidence",
            finding_action(F.col("action")).alias("action"),
            *extra,
        )
        .select(*FINDING_COLUMNS, *extra)
    )


# On a repeated message these describe the latest decision; the rest keep first values.
UPDATED = ["processed_ts", "max_tier", "action", "latency_ms", "failure_class", "failure_detail"]
KEPT = ["source_topic", "event_ts", "schema_version"]


def upsert_messages(trail: DataFrame, version: list[str]) -> DataFrame:
    """Last write wins per message over an append-only trail.

    `version` columns order the writes (batch, then offset inside it). Both picks are
    aggregates with a map-side partial, so a message redelivered without end shrinks
    before the shuffle.
    """
    order = F.struct(*version)
    last = F.max_by(F.struct(*version, *UPDATED), order).alias("last")
    first = F.min_by(F.struct(*KEPT), order).alias("first")
    return (
        trail.groupBy("message_id")
        .agg(last, first)
        .select(
            "message_id",
            *[F.col(f"first.{c}") for c in KEPT],
            *[F.col(f"last.{c}") for c in version],
            *[F.col(f"last.{c}") for c in UPDATED],
        )
    )


def upsert_findings(winners: DataFrame, findings: DataFrame, version: list[str]) -> DataFrame:
    """Only the findings of each message's winning write.

    The join key includes the version, so the writes of one hot message spread out.
    """
    return findings.join(winners.select("message_id", *version), ["message_id", *version], "left_semi")


def audit_upsert(
    messages: DataFrame, findings: DataFrame, version: list[str]
) -> tuple[DataFrame, DataFrame]:
    winners = upsert_messages(messages, version)
    return winners, upsert_findings(winners, findings, version)


def delete_where_in(findings: DataFrame, batch: DataFrame) -> DataFrame:
    """Findings of messages that the batch does not redeliver."""
    return findings.join(batch.select("message_id").distinct(), "message_id", "left_anti")


def highest_offset(raw: DataFrame) -> DataFrame:
    """Per partition, the position after the last record seen (for lag reports)."""
    return raw.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("position"))
