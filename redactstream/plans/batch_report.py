"""The report over a file scan: the audit report's functions on exploded scan rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactstream.plans import report

__all__ = ["as_trail", "batch_coverage", "batch_queue", "batch_report"]


def as_trail(scanned: DataFrame, key: str, source: str, scanned_at: Column) -> tuple[DataFrame, DataFrame]:
    """A scan in the shape of the audit trail, so both share one implementation.

    A row of a file has no event time; it stays null rather than guessed.
    """
    row_id = F.concat(F.lit("row "), F.col(key).cast("string"))
    messages = scanned.select(
        row_id.alias("message_id"),
        F.lit(source).alias("source_topic"),
        F.lit(None).cast("timestamp").alias("event_ts"),
        scanned_at.alias("processed_ts"),
        "max_tier",
        "action",
        F.lit(None).cast("string").alias("failure_class"),
        F.lit(None).cast("string").alias("failure_detail"),
        F.col(key).alias("row"),
    )
    findings = scanned.select(row_id.alias("message_id"), F.explode("findings").alias("f")).select(
        "message_id", "f.*"
    )
    return messages, findings


def batch_queue(
    messages: DataFrame, findings: DataFrame, max_queue: int = report.DEFAULT_QUEUE
) -> DataFrame:
    """Held rows in row order: a capped list; the total comes uncapped with the counts."""
    held = messages.where(F.col("action") == "quarantined").orderBy("row").limit(max_queue)
    listed = report.uncertain(held, findings)
    return listed.join(held.select("message_id", "row"), "message_id").orderBy("row")


def batch_coverage(scanned: DataFrame) -> DataFrame:
    return scanned.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum("masked_chars"), F.lit(0)).alias("masked_chars"),
        F.coalesce(F.sum("identifying_chars"), F.lit(0)).alias("identifying_chars"),
        F.count_if("truncated").alias("truncated_rows"),
        F.count_if("saturated").alias("saturated_rows"),
    ).withColumn(
        "coverage",
        F.coalesce(F.try_divide(F.col("masked_chars"), F.col("identifying_chars")), F.lit(0.0)),
    )


def batch_report(
    scanned: DataFrame,
    key: str,
    source: str,
    scanned_at: Column,
    lookup: DataFrame,
    max_queue: int = report.DEFAULT_QUEUE,
) -> dict[str, DataFrame]:
    """Sections of a scan. Persist `scanned` first if all sections will be read."""
    messages, findings = as_trail(scanned, key, source, scanned_at)
    ent = report.entities(findings)
    return {
        "scope": report.scope(messages),
        "disposition": report.disposition(messages),
        "by_tier": report.by_tier(messages),
        "entities": report.classify(ent, lookup),
        "entity_fields": report.entity_fields(findings),
        "unclassified": report.unclassified(ent, lookup),
        "uncertain": batch_queue(messages, findings, max_queue),
        "totals": report.queue_totals(messages),
        "coverage": batch_coverage(scanned),
    }
