"""DuckDB SQL shared by the oracles.

Transactions are built so that every identifier's place is known. The oracles state
those places instead of searching for them, so they share no logic with the detectors.
"""

from __future__ import annotations

from redactstream.sources.views import RAW_SQL, TXN_SQL, TXN_TEXT_FIELDS

TXN = f"txn AS ({TXN_SQL})"

FIELDS = "txn_fields AS (" + " UNION ALL ".join(
    f"SELECT k, message_id, '{c}' AS field, {c} AS value FROM txn" for c in TXN_TEXT_FIELDS
) + ")"

RAW = f"raw AS ({RAW_SQL})"

# Findings by construction: (k, field, entity_type, s, e, tier, confidence).
_PLACED = """
  SELECT k, 'account_holder' AS field, 'PERSON_NAME' AS entity_type, 0 AS s, length(account_holder) AS e, 1 AS tier, 1.0 AS confidence FROM txn
  UNION ALL SELECT k, 'cnic', 'CNIC', 0, length(cnic), 1, 1.0 FROM txn
  UNION ALL SELECT k, 'iban_from', 'IBAN_PK', 0, length(iban_from), 1, CASE WHEN k % 50 = 0 THEN 0.5 ELSE 1.0 END FROM txn
  UNION ALL SELECT k, 'iban_to', 'IBAN_PK', 0, length(iban_to), 1, 1.0 FROM txn
  UNION ALL SELECT k, 'phone', 'PHONE_PK', 0, length(phone), 1, 1.0 FROM txn
  UNION ALL SELECT k, 'email', 'EMAIL', 0, length(email), 1, 1.0 FROM txn
  UNION ALL SELECT k, 'memo', 'PHONE_PK', instr(memo, phone) - 1, instr(memo, phone) - 1 + length(phone), 1, 1.0 FROM txn WHERE k % 10 = 5
  UNION ALL SELECT k, 'memo', 'CNIC', instr(memo, cnic) - 1, instr(memo, cnic) - 1 + length(cnic), 1, 1.0 FROM txn WHERE k % 10 = 6
  UNION ALL SELECT k, 'memo', 'EMAIL', instr(memo, email) - 1, instr(memo, email) - 1 + length(email), 1, 1.0 FROM txn WHERE k % 10 = 7
"""
_MODEL = """
  SELECT k, 'memo' AS field, 'PERSON_NAME' AS entity_type, instr(memo, account_holder) - 1 AS s,
         instr(memo, account_holder) - 1 + length(account_holder) AS e, 2 AS tier, 0.9 AS confidence FROM txn WHERE k % 10 IN (4, 5, 6)
  UNION ALL SELECT k, 'memo', 'ADDRESS', instr(memo, 'Plot') - 1, instr(memo, 'Karachi') - 1 + length('Karachi'), 2, 0.9 FROM txn WHERE k % 10 = 8
"""
PLACED = f"rule_f AS ({_PLACED})"
MODEL_PLACED = f"model_f AS ({_MODEL})"

# Which of the fourteen ways a broken record fails: class, detail.
BROKEN = """
broken AS (SELECT * FROM (VALUES
  (0, 'AttributeError', 'record has no value'),
  (1, 'JSONDecodeError', 'value is not one JSON document'),
  (2, 'JSONDecodeError', 'value is not one JSON document'),
  (3, 'TypeError', 'top level is not an object'),
  (4, 'KeyError', 'payload is missing'),
  (5, 'KeyError', 'message_id is missing'),
  (6, 'KeyError', 'event_ts is missing'),
  (7, 'TypeError', 'message_id is not a string'),
  (8, 'ValueError', 'message_id is not a UUID'),
  (9, 'TypeError', 'event_ts is not a string'),
  (10, 'ValueError', 'event_ts is not an ISO-8601 time'),
  (11, 'TypeError', 'schema_version is not an integer'),
  (12, 'TypeError', 'payload is not an object'),
  (13, 'JSONDecodeError', 'value is not one JSON document')) AS t(b, failure_class, failure_detail))
"""

TOPIC = "CASE WHEN k % 4 = 3 THEN 'txn.backfill' ELSE 'txn.raw' END"
_SHA = (
    "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || "
    f"encode('kafka://' || {TOPIC} || '/' || (k % 3)::varchar || '/' || k::varchar))"
)
POISON = f"""
poison AS (SELECT k, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||
    substr('89ab', 1 + ('0x' || substr(h,17,1))::int % 4, 1)||substr(h,18,3)||'-'||substr(h,21,12) AS poison_id
  FROM (SELECT k, {_SHA} AS h FROM txn))
"""

EVENT = """
event_times AS (SELECT k, CASE WHEN k % 2 = 0
    THEN date_trunc('day', event_ts) + to_seconds((k % 24) * 3600 + 309)
    ELSE date_trunc('day', event_ts) + to_seconds((k % 24) * 3600 + 309) + to_milliseconds(250) - to_hours(5) END AS happened
  FROM txn)
"""

_MESSAGES = f"""
m AS (SELECT txn.k, CASE WHEN txn.k % 97 = 0 THEN poison_id ELSE message_id END AS message_id,
    {TOPIC.replace('k %', 'txn.k %')} AS source_topic,
    CASE WHEN txn.k % 97 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE happened END AS event_ts,
    CASE WHEN txn.k % 97 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE happened END + to_seconds(txn.k % 3600) AS processed_ts,
    CASE WHEN txn.k % 97 = 0 OR txn.k % 10 = 9 THEN 0 WHEN txn.k % 10 IN (4, 5, 6, 8) THEN 2 ELSE 1 END AS max_tier,
    CASE WHEN txn.k % 97 = 0 OR txn.k % 50 = 0 THEN 'quarantined' WHEN txn.k % 10 = 9 THEN 'clean' ELSE 'redacted' END AS action,
    (txn.k % 1000) / 100.0::double AS latency_ms, 1 AS schema_version, failure_class, failure_detail
  FROM txn JOIN poison ON txn.k = poison.k JOIN event_times ON txn.k = event_times.k
  LEFT JOIN broken ON txn.k % 97 = 0 AND broken.b = (txn.k // 97) % 14)
"""
_FINDINGS = """
f AS (SELECT m.k, m.message_id, entity_type, field, s AS span_start, e AS span_end, tier, confidence::double AS confidence,
    CASE WHEN action = 'quarantined' THEN 'quarantined' ELSE 'redacted' END AS action
  FROM (SELECT * FROM rule_f UNION ALL SELECT * FROM model_f) x JOIN m ON x.k = m.k
  WHERE x.k % 97 <> 0 AND x.k % 10 <> 9 AND x.k % 350 <> 0)
"""

TRAIL = ",".join([TXN, PLACED, MODEL_PLACED, BROKEN, POISON, EVENT, _MESSAGES, _FINDINGS])


def with_txn(sql: str) -> str:
    return f"WITH {TXN}, {PLACED}, {MODEL_PLACED} {sql}"


def with_fields(sql: str) -> str:
    return f"WITH {TXN}, {FIELDS}, {PLACED}, {MODEL_PLACED} {sql}"


def with_raw(sql: str) -> str:
    return f"WITH {TXN}, {RAW}, {PLACED}, {MODEL_PLACED}, {BROKEN}, {POISON}, {EVENT} {sql}"


def with_trail(sql: str) -> str:
    return f"WITH {TRAIL} {sql}"


# Space-delimited tokens of `documents` with offsets, and the e-mails among them.
_WS = r"\t-\r\x1c-\x20\x{85}\p{Z}"
EMAILS = rf"""
pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[{_WS}]+|[^{_WS}]+') AS p FROM documents)),
placed AS (SELECT doc_id, i, piece,
    coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS pos
  FROM pieces),
tried AS (SELECT *, ltrim(piece, '([{{<''"') AS l, rtrim(ltrim(piece, '([{{<''"'), '.,;:!?)]}}>''"') AS core FROM placed),
emails AS (SELECT doc_id, i, piece, l, core, (pos + length(piece) - length(l))::int AS s,
    (pos + length(piece) - length(l) + length(core))::int AS e
  FROM tried WHERE regexp_full_match(core, '[^@{_WS}]+@[^@{_WS}]+\.[A-Za-z]{{2,}}'))
"""


def with_emails(sql: str) -> str:
    return f"WITH {EMAILS} {sql}"
