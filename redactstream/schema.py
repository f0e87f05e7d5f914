"""Column types shared by every stage, and the policy a job runs under."""

from __future__ import annotations

from dataclasses import dataclass, field

FINDING = (
    "struct<entity_type:string,field:string,span_start:int,span_end:int,"
    "tier:int,confidence:double>"
)
FINDINGS = f"array<{FINDING}>"
HIT = "struct<s:int,e:int,m:string>"
MERGED = "struct<s:int,e:int,label:string>"
MODEL_SPAN = "struct<entity_type:string,s:int,e:int,score:double>"

RAW_SCHEMA = "value BINARY, topic STRING, partition INT, offset BIGINT"

MESSAGE_COLUMNS = [
    "message_id", "source_topic", "event_ts", "processed_ts", "max_tier", "action",
    "latency_ms", "schema_version", "failure_class", "failure_detail",
]
FINDING_COLUMNS = [
    "message_id", "entity_type", "field", "span_start", "span_end", "tier",
    "confidence", "action",
]

TIER_RULES = 1
TIER_MODEL = 2

FULL_CONFIDENCE = 1.0

# The default policy for bank-transaction payloads and the topics.
DECLARED_FIELDS = {"account_holder": "PERSON_NAME"}
FREE_TEXT_FIELDS = ("memo",)
RAW_TOPIC = "txn.raw"
CLEAN_TOPIC = "txn.clean"
QUARANTINE_TOPIC = "txn.quarantine"
RETENTION_HOURS = {RAW_TOPIC: 24, CLEAN_TOPIC: 168, QUARANTINE_TOPIC: 72}
UNVALIDATED_CONFIDENCE = 0.5
FAILURE_DETAIL_CHARS = 500
MODEL_THRESHOLD = 0.55


@dataclass(frozen=True)
class Policy:
    """Which payload fields are personal by contract and which are free text."""

    declared: dict[str, str] = field(default_factory=lambda: dict(DECLARED_FIELDS))
    free_text: tuple[str, ...] = FREE_TEXT_FIELDS
