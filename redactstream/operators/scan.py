"""Batch scan of one text column: the stream's decision over rows of a table or file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactstream.functions import spans
from redactstream.functions.rules import Detector, rule_column
from redactstream.operators.model import Predictor, detect_model
from redactstream.operators.pushdown import Conditions, apply_known, apply_rest, conditions
from redactstream.operators.routing import max_tier, route_action
from redactstream.schema import FREE_TEXT_FIELDS


@spans.built_once
def _free_text(field: str) -> Column:
    part = F.struct(
        F.lit(field).alias("field"),
        spans.shield(F.col("_text"), F.col("findings")).alias("text"),
    )
    worth = F.col("_text").rlike(rf"[^{spans.SPACE}]")
    return spans.once(F.when(worth, F.array(part)))


@spans.built_once
def _all_findings() -> Column:
    return spans.combine(F.col("findings"), F.col("model_findings"))


@spans.built_once
def _kept_findings(types: tuple[str, ...] | None) -> Column:
    return spans.once(spans.by_position(spans.keep_types(F.col("findings"), types)))


@spans.built_once
def _merged() -> Column:
    return spans.once(spans.merge_spans(F.col("findings")))


@spans.built_once
def _figures() -> dict[str, Column]:
    return {
        "redacted": spans.redact_merged(F.col("_text"), F.col("merged")),
        "masked_chars": spans.masked_chars(F.col("_text"), F.col("merged")),
        "identifying_chars": spans.identifying_chars(F.col("_text")),
        "action": route_action(F.col("findings")),
        "max_tier": max_tier(F.col("findings")),
        "saturated": (F.length("_text") > 0)
        & (spans.span_length(F.col("merged")) == F.length("_text")),
    }


def scan(
    df: DataFrame,
    text: str,
    *,
    field: str = FREE_TEXT_FIELDS[0],
    entity_types: Sequence[str] | None = None,
    predictor: Predictor | None = None,
    extra_detectors: dict[str, Detector] | None = None,
    where: Conditions = None,
) -> DataFrame:
    """Adds findings, merged, redacted, counts, coverage and action to every row.

    `where` keeps rows: conditions on the table's own columns are applied to the table, so
    they reach its scan and only kept rows are searched; conditions on what is found here are
    applied at the end. A name that the table has itself means the table's column. Rows are never reordered or joined: the model result arrives in the row itself. Texts
    of any length are scanned whole, so `truncated` is always false; a model with an input
    length reads overlapping windows (`BatchPredictor.max_chars`).
    """
    df, late = apply_known(df, conditions(where))
    out = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("truncated", F.lit(False))
    extra = tuple((extra_detectors or {}).items())
    out = out.withColumn("findings", rule_column("_text", field, extra))
    if predictor is not None:
        out = out.withColumn("_free", _free_text(field))
        out = detect_model(out, "_free", predictor)
        out = out.withColumn("findings", _all_findings())
    types = None if entity_types is None else tuple(entity_types)
    out = out.withColumn("findings", _kept_findings(types))
    out = out.withColumn("merged", _merged()).withColumns(_figures())
    share = F.try_divide(F.col("masked_chars"), F.col("identifying_chars"))
    out = out.withColumn("coverage", F.coalesce(share, F.lit(0.0)))
    out = out.withColumn("scanned", F.col("_text")).drop("_text", "_free", "model_findings")
    return apply_rest(out, late)


def without_text(scanned: DataFrame, text: str) -> DataFrame:
    """Drop everything the value could be read from once the figures exist."""
    return scanned.drop(text, "scanned", "merged", "redacted")


def findings_detail(scanned: DataFrame, key: str) -> DataFrame:
    """Findings with their matched text, for a reader on demand; never to be stored."""
    return scanned.select(key, "scanned", F.explode("findings").alias("f")).select(
        key,
        "f.entity_type",
        F.substring("scanned", F.col("f.span_start") + 1, F.col("f.span_end") - F.col("f.span_start"))
        .alias("matched"),
        "f.tier",
        "f.confidence",
        "f.span_start",
        "f.span_end",
    )


def merge_spans_rel(
    findings: DataFrame,
    keys: Sequence[str],
    s: str = "span_start",
    e: str = "span_end",
    kind: str = "entity_type",
    max_gap: int | None = None,
) -> DataFrame:
    """Relational twin of the span merge: gaps and islands over a findings table.

    Exact repeats leave map-side first, so the rows of one text are bounded by its length.
    `max_gap` None joins on strict overlap; a number joins gaps up to that many characters.
    """
    from pyspark.sql import Window

    keys = list(keys)
    distinct = findings.groupBy(*keys, F.col(s).alias("s"), F.col(kind).alias("kind")).agg(
        F.max(e).alias("e")
    )
    seen = Window.partitionBy(*keys).orderBy("s", "e", "kind")
    before = F.max("e").over(seen.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("s") >= before) if max_gap is None else (F.col("s") - before > max_gap)
    starts = F.when(before.isNull() | opens, 1).otherwise(0)
    island = F.sum("starts").over(seen.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        distinct.withColumn("starts", starts)
        .withColumn("island", island)
        .groupBy(*keys, "island")
        .agg(
            F.min("s").alias("s"),
            F.max("e").alias("e"),
            F.array_join(F.sort_array(F.collect_set("kind")), "+").alias("label"),
        )
        .drop("island")
    )


def combine_rel(rules: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Relational twin of `combine`: a range anti-join without pairs.

    A model span lies inside some rule span exactly when the furthest end among rule
    spans that start no later reaches its own end - a running maximum, not a join.
    """
    from pyspark.sql import Window

    keys = list(keys)
    cols = [*keys, "entity_type", "span_start", "span_end", "tier", "confidence"]
    both = rules.select(*cols).withColumn("is_rule", F.lit(1)).unionByName(
        model.select(*cols).withColumn("is_rule", F.lit(0))
    )
    upto = (
        Window.partitionBy(*keys)
        .orderBy("span_start", F.desc("is_rule"))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    reach = F.max(F.when(F.col("is_rule") == 1, F.col("span_end"))).over(upto)
    kept = (F.col("is_rule") == 1) | reach.isNull() | (reach < F.col("span_end"))
    return both.withColumn("kept", kept).where("kept").select(*cols)
