"""From envelopes to decisions: dispatch by field, detect, redact, route, re-encode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactstream.functions import spans
from redactstream.functions.rules import Detector, detect_declared, detect_rules
from redactstream.functions.identity import poison_id
from redactstream.operators.envelope import envelopes
from redactstream.operators.model import Predictor, PythonDetector, all_of, detect_model, detect_python
from redactstream.operators.pushdown import Conditions, apply_known, apply_rest, conditions
from redactstream.schema import (
    CLEAN_TOPIC,
    FINDINGS,
    FULL_CONFIDENCE,
    QUARANTINE_TOPIC,
    TIER_RULES,
    Policy,
)

OUTCOME_COLUMNS = [
    "topic", "partition", "offset", "message_id", "event_ts", "schema_version", "findings",
    "action", "max_tier", "failure_class", "failure_detail", "out_value", "model_ms",
]


def is_trigger(f: Column) -> Column:
    """A rule finding below full confidence; model scores never quarantine."""
    return (f["tier"] == TIER_RULES) & (f["confidence"] < FULL_CONFIDENCE)


def route_action(found: Column, failure_class: Column | None = None) -> Column:
    action = (
        F.when(F.size(found) == 0, "clean")
        .when(F.exists(found, is_trigger), "quarantined")
        .otherwise("redacted")
    )
    if failure_class is None:
        return action
    return F.when(failure_class.isNotNull(), "quarantined").otherwise(action)


def max_tier(found: Column) -> Column:
    return F.coalesce(F.array_max(found["tier"]), F.lit(0))


def finding_action(action: Column) -> Column:
    return F.when(action == "quarantined", "quarantined").otherwise("redacted")


def payload_entries(payload: Column) -> Column:
    """Payload members as array<struct<key, text>>; text is null for non-strings."""
    return F.transform(
        F.map_entries(payload),
        lambda m: F.struct(
            m["key"].alias("key"),
            F.when(
                F.schema_of_variant(m["value"]) == "STRING",
                F.variant_get(m["value"], "$", "string"),
            ).alias("text"),
        ),
    )


def _declared_type(key: Column, policy: Policy) -> Column:
    out = F.lit(None).cast("string")
    for name, entity in policy.declared.items():
        out = F.when(key == name, F.lit(entity)).otherwise(out)
    return out


def rule_fields(
    entries: Column, policy: Policy, extra: dict[str, Detector] | None = None
) -> Column:
    """Findings per string member: declared fields by contract, all others by rules."""

    def detect(m: Column) -> Column:
        entity = _declared_type(m["key"], policy)
        found = F.when(
            entity.isNotNull(), detect_declared(m["text"], m["key"], entity)
        ).otherwise(detect_rules(m["text"], m["key"], extra))
        return F.struct(
            m["key"].alias("key"),
            m["text"].alias("text"),
            F.when(m["text"].isNotNull(), found).otherwise(spans.empty(FINDINGS)).alias("findings"),
        )

    return F.transform(entries, detect)


def free_text_prefilter(fields: Column, policy: Policy) -> Column:
    """Non-blank free-text members, with the characters rules already own blanked out."""
    wanted = F.filter(
        fields,
        lambda m: m["key"].isin(list(policy.free_text))
        & ~_declared_type(m["key"], policy).isNotNull()
        & m["text"].isNotNull()
        & m["text"].rlike(rf"[^{spans.SPACE}]"),
    )
    return F.transform(
        wanted,
        lambda m: F.struct(
            m["key"].alias("field"), spans.shield(m["text"], m["findings"]).alias("text")
        ),
    )


def undeclared_parts(fields: Column, policy: Policy) -> Column:
    """All string members that detectors look at."""
    wanted = F.filter(
        fields, lambda m: m["text"].isNotNull() & _declared_type(m["key"], policy).isNull()
    )
    return F.transform(wanted, lambda m: F.struct(m["key"].alias("field"), m["text"].alias("text")))


def add_rule_findings(fields: Column, custom: Column) -> Column:
    """Each member's findings with those of a custom rule detector, overlaps resolved."""

    def join(m: Column) -> Column:
        own = F.filter(custom, lambda f: f["field"] == m["key"])
        return F.struct(
            m["key"].alias("key"),
            m["text"].alias("text"),
            spans.dedupe_longest(F.concat(m["findings"], own)).alias("findings"),
        )

    return F.transform(fields, join)


def add_model_findings(fields: Column, model: Column) -> Column:
    """Combine each member's rule findings with the model findings for that member."""

    def join(m: Column) -> Column:
        own = F.filter(model, lambda f: f["field"] == m["key"])
        both = spans.let(own, lambda o: spans.combine(m["findings"], o))
        combined = F.struct(
            m["key"].alias("key"), m["text"].alias("text"), both.alias("findings")
        )
        return F.when(F.exists(model, lambda f: f["field"] == m["key"]), combined).otherwise(m)

    return F.when(F.size(model) > 0, F.transform(fields, join)).otherwise(fields)


PolicyKey = tuple[tuple[tuple[str, str], ...], tuple[str, ...]]


def _key(policy: Policy) -> PolicyKey:
    return tuple(policy.declared.items()), tuple(policy.free_text)


def _policy(key: PolicyKey) -> Policy:
    return Policy(dict(key[0]), key[1])


@spans.built_once
def _rule_column(policy: PolicyKey, extra: tuple[tuple[str, Detector], ...]) -> Column:
    return spans.once(rule_fields(payload_entries(F.col("payload")), _policy(policy), dict(extra)))


@spans.built_once
def _undeclared_column(policy: PolicyKey) -> Column:
    return spans.once(undeclared_parts(F.col("fields"), _policy(policy)))


@spans.built_once
def _custom_column() -> Column:
    return spans.once(add_rule_findings(F.col("fields"), F.col("custom_findings")))


@spans.built_once
def _free_column(policy: PolicyKey) -> Column:
    return spans.once(free_text_prefilter(F.col("fields"), _policy(policy)))


@spans.built_once
def _model_column() -> Column:
    return spans.once(add_model_findings(F.col("fields"), F.col("model_findings")))


@spans.built_once
def _findings_column() -> Column:
    found = F.flatten(F.col("fields")["findings"])
    return spans.once(F.coalesce(found, spans.empty(FINDINGS)))


def dispatch_fields(
    df: DataFrame,
    policy: Policy | None = None,
    predictor: Predictor | None = None,
    extra_detectors: dict[str, Detector] | None = None,
    python_detector: PythonDetector | None = None,
) -> DataFrame:
    """Adds `fields` (per member text and findings) and `findings` (all of them).

    Detection is one projection over the payload; the model, if any, adds one Arrow stage
    that only sees free text. No step shuffles.
    """
    key = _key(policy or Policy())
    out = df.withColumn("fields", _rule_column(key, tuple((extra_detectors or {}).items())))
    if python_detector is not None:
        out = out.withColumn("_parts", _undeclared_column(key))
        out = detect_python(out, "_parts", python_detector)
        out = out.withColumn("fields", _custom_column())
    if predictor is not None:
        out = out.withColumn("_free", _free_column(key))
        out = detect_model(out, "_free", predictor)
        out = out.withColumn("fields", _model_column())
    return out.withColumn("findings", _findings_column())


@spans.built_once
def _out_value() -> Column:
    # Fields are the payload's members in their order.
    def member(p: Column, m: Column) -> Column:
        redacted = spans.redact(m["text"], m["findings"]).cast("variant")
        value = F.when(F.size(m["findings"]) > 0, redacted).otherwise(p["value"])
        return F.struct(p["key"].alias("key"), value.alias("value"))

    body = F.to_json(
        F.struct(
            F.map_from_entries(
                F.zip_with(F.map_entries(F.col("payload")), F.col("fields"), member)
            ).alias("payload"),
            "message_id",
            F.col("event_ts_text").alias("event_ts"),
            "schema_version",
        )
    )
    original = F.coalesce(F.col("value"), F.lit(b""))
    return F.when(F.col("action") == "quarantined", original).otherwise(F.encode(body, "UTF-8"))


def reencode_envelope(df: DataFrame) -> DataFrame:
    """Adds out_value: the redacted envelope as UTF-8 JSON.

    Quarantined rows carry their original bytes, so a reviewer sees what arrived.
    """
    return df.withColumn("out_value", _out_value())


def decide(
    raw: DataFrame,
    policy: Policy | None = None,
    predictor: Predictor | None = None,
    extra_detectors: dict[str, Detector] | None = None,
    processing_time: Column | None = None,
    python_detector: PythonDetector | Sequence[PythonDetector] | None = None,
    where: Conditions = None,
) -> DataFrame:
    """The whole per-record decision: one wide row per raw record.

    A detector or model that fails on a record turns that record into a failure; it
    never reaches the clean output.

    `where` keeps records: conditions on the raw columns are applied to the source, those on
    the envelope before any detection, those on the outcome at the end.
    """
    if python_detector is not None and not isinstance(python_detector, PythonDetector):
        python_detector = all_of(*python_detector)
    raw, late = apply_known(raw, conditions(where))
    out = envelopes(raw, processing_time)
    early = ["event_ts", "schema_version"]
    if python_detector is None and predictor is None:
        # Otherwise a failing detector may still change these.
        early += ["message_id", "failure_class", "failure_detail"]
    out, late = apply_known(out, late, early)
    out = dispatch_fields(out, policy, predictor, extra_detectors, python_detector)
    if predictor is None:
        out = out.withColumn("model_ms", F.lit(0.0))
    errors = [F.col("detector_error")] if python_detector is not None else []
    errors += [F.col("model_error")] if predictor is not None else []
    if errors:
        error = F.coalesce(*errors)
        broke = F.col("failure_class").isNull() & error.isNotNull()
        poison = poison_id(F.col("topic"), F.col("partition"), F.col("offset"))
        failed = {
            "message_id": poison,
            "findings": spans.empty(FINDINGS),
            "failure_class": error,
            "failure_detail": F.lit("a detector or the model failed on this record"),
        }
        out = spans.stage(
            out, {c: F.when(broke, v).otherwise(F.col(c)) for c, v in failed.items()}
        )
    out = spans.stage(
        out,
        {
            "action": route_action(F.col("findings"), F.col("failure_class")),
            "max_tier": max_tier(F.col("findings")),
        },
    )
    return apply_rest(reencode_envelope(out).select(*OUTCOME_COLUMNS), late)


def routed(
    decided: DataFrame, clean_topic: str = CLEAN_TOPIC, quarantine_topic: str = QUARANTINE_TOPIC
) -> DataFrame:
    """Records ready for a broker: topic, key, value, headers."""
    header = F.array(
        F.struct(
            F.lit("failure_class").alias("key"),
            F.encode(F.col("failure_class"), "UTF-8").alias("value"),
        )
    )
    return decided.select(
        F.when(F.col("action") == "quarantined", quarantine_topic)
        .otherwise(clean_topic)
        .alias("topic"),
        F.encode(F.col("message_id"), "UTF-8").alias("key"),
        F.col("out_value").alias("value"),
        F.when(F.col("failure_class").isNotNull(), header).alias("headers"),
    )
