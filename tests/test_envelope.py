"""Fail-closed parsing: every malformed shape is held, with a reason and no content."""

from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from redactstream.functions.identity import canonical_uuid, normalise_event_ts
from redactstream.operators.routing import decide
from redactstream.schema import RAW_SCHEMA

ID = "550e8400-e29b-41d4-a716-446655440000"
TS = "2024-01-01T00:00:00+00:00"


def body(**changes):
    base = {"message_id": ID, "event_ts": TS, "schema_version": 1, "payload": {}}
    base.update(changes)
    return json.dumps({k: v for k, v in base.items() if v is not ...}).encode()


MALFORMED = [
    (None, "AttributeError"),
    (b"", "JSONDecodeError"),
    (b"{not json", "JSONDecodeError"),
    (body() + b" trailing", "JSONDecodeError"),
    (body() + body(), "JSONDecodeError"),
    (b"\xff\xfe\x00binary", "UnicodeDecodeError"),
    (b"[1]", "TypeError"),
    (b'"text"', "TypeError"),
    (b"null", "TypeError"),
    (b'{"message_id":"x"}', "KeyError"),
    (body(message_id=...), "KeyError"),
    (body(event_ts=...), "KeyError"),
    (body(message_id="not-a-uuid"), "ValueError"),
    (body(message_id=123), "TypeError"),
    (body(message_id=None), "TypeError"),
    (body(event_ts="not-a-timestamp"), "ValueError"),
    (body(event_ts=12345), "TypeError"),
    (body(schema_version="abc"), "TypeError"),
    (body(schema_version=True), "TypeError"),
    (body(schema_version=1.5), "TypeError"),
    (body(payload="oops"), "TypeError"),
    (body(payload=[1, 2]), "TypeError"),
    (body(payload=None), "TypeError"),
]


def raw(spark, values):
    rows = [(None if v is None else bytearray(v), "txn.raw", i % 3, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def outcomes(spark, values, **options):
    return decide(raw(spark, values), **options).orderBy("offset").collect()


def test_malformed_messages_are_held_with_a_reason(spark):
    got = outcomes(spark, [v for v, _ in MALFORMED])
    for i, (row, (value, failure)) in enumerate(zip(got, MALFORMED)):
        assert row.failure_class == failure, value
        assert row.action == "quarantined"
        assert row.findings == []
        assert bytes(row.out_value) == (value or b"")
        assert len(row.failure_detail) <= 500
        name = f"kafka://txn.raw/{i % 3}/{i}"
        assert row.message_id == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_filtering_outcomes_keeps_all_failures(spark):
    """A filter on the outcome must neither change results nor blow up the plan."""
    df = decide(raw(spark, [v for v, _ in MALFORMED] + [body()]))
    assert df.where("failure_class IS NOT NULL").count() == len(MALFORMED)
    assert df.where("action = 'clean'").count() == 1


PAYLOAD = {
    "account_holder": "Ayesha Malik",
    "cnic": "42101-7654321-9",
    "iban_from": "PK68MEZN5748718428058488",
    "phone": "03011234567",
    "email": "ayesha@example.com",
    "amount_pkr": 1500.5,
    "vip": True,
    "nested": {"phone": "03011234567"},
    "note": "سلام",
    "empty": "",
    "absent": None,
}


def test_redacted_output(spark):
    (row,) = outcomes(spark, [body(payload=PAYLOAD, message_id="{" + ID.upper() + "}", event_ts="2024-01-01T00:00:00Z")])
    assert row.action == "redacted" and row.max_tier == 1
    out = json.loads(bytes(row.out_value))
    assert out["message_id"] == ID
    assert out["event_ts"] == TS
    assert out["schema_version"] == 1
    want = dict(
        PAYLOAD,
        account_holder="[PERSON_NAME]",
        cnic="[CNIC]",
        iban_from="[IBAN_PK]",
        phone="[PHONE_PK]",
        email="[EMAIL]",
    )
    assert out["payload"] == want
    assert "سلام" in bytes(row.out_value).decode()


def test_clean_message_passes_with_default_version(spark):
    (row,) = outcomes(spark, [body(payload={"note": "rent"}, schema_version=...)])
    assert row.action == "clean" and row.schema_version == 1
    assert json.loads(bytes(row.out_value))["payload"] == {"note": "rent"}


def test_uncertain_record_forwards_original_bytes(spark):
    value = body(payload=dict(PAYLOAD, iban_from="PK99MEZN5748718428058488"))
    (row,) = outcomes(spark, [value])
    assert row.action == "quarantined" and row.failure_class is None
    assert bytes(row.out_value) == value


@pytest.mark.parametrize(
    "text, expected",
    [
        ("urn:uuid:" + ID, ID),
        ("{" + ID + "}", ID),
        (ID.replace("-", ""), ID),
        (ID.upper(), ID),
        (ID[:-1], None),
        ("g" + ID[1:], None),
        ("", None),
    ],
)
def test_canonical_uuid(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(canonical_uuid(F.col("t"))).head()[0] == expected


TIMES = [
    ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00+00:00"),
    ("2024-01-01T00:00:00.123456Z", "2024-01-01T00:00:00.123456+00:00"),
    ("2024-02-29", "2024-02-29"),
    ("2024-01-01 10:11", "2024-01-01 10:11"),
    ("2024-01-01T10", "2024-01-01T10"),
    ("2024-01-01T10:11:12.123-05:30", "2024-01-01T10:11:12.123-05:30"),
    ("2023-02-29", None),
    ("2024", None),
    ("12:30", None),
    ("2024-13-01", None),
    ("2024-01-01T24:00:00", None),
    ("2024-01-01T10:60", None),
    ("2024-01-01T10:11:12.1", None),
    ("2024-01-01T", None),
    ("0000-01-01", None),
    ("yesterday", None),
    ("", None),
]


def test_normalise_event_ts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TIMES)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(normalise_event_ts(F.col("t"))).collect()]
    assert got == [e for _, e in TIMES]


def test_a_text_is_parsed_once(spark):
    from redactstream.operators.envelope import parse_envelope

    raw = spark.createDataFrame([], "value binary, topic string, partition int, offset bigint")
    plan = parse_envelope(raw)._jdf.queryExecution().optimizedPlan().toString()
    # Columns kept in their place share no common parts: each mention was another pass.
    assert plan.count("parseJson") == 1 and plan.count("md5(") == 1


def test_event_times_that_are_cast_equal_those_by_arithmetic(spark):
    from redactstream.functions.identity import _event_time, event_time

    texts = [
        "2024-02-29T23:59:59+05:00", "2024-01-01 00:00:00.250-17:59", "0001-01-01x00:00:00.123456+00:00",
        "9999-12-31T23:59:59-00:30", "2024-01-01T10:05:09+18:00", "2024-01-01T10:05", "2024-01-01", "1996-07-01€12:00:00+23:59",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = rows.select(F.unix_micros(event_time(F.col("t"))), F.unix_micros(_event_time(F.col("t")))).collect()
    assert all(a is not None and a == b for a, b in both)


def test_generated_methods_stay_small_enough_to_be_compiled(spark):
    from redactstream.session import prepare

    assert int(prepare(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_envelopes_are_read_by_expressions_that_compile(spark):
    from redactstream.operators.envelope import classify_failure, parse_envelope

    raw = spark.createDataFrame([], RAW_SCHEMA)
    plan = classify_failure(parse_envelope(raw))._jdf.queryExecution().optimizedPlan().toString()
    # Spark interprets a higher-order function with all that it holds.
    assert "lambda" not in plan


def test_content_after_the_value_and_odd_payloads(spark):
    good = body()
    values = [good + b"\n", b" \t" + good, good + b",1", good + b"],[1", b"1],[2", b"1,2", good[:-1], body(payload={"a": None, "b": {"c": 1}})]
    got = [r.failure_class for r in outcomes(spark, values)]
    assert got == [None, None, *["JSONDecodeError"] * 5, None]
