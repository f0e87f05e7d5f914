"""The model tier with a fake predictor: batching, grouping, span rules, failures."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from redactstream.functions.address import extend_address
from redactstream.operators import model as mdl
from redactstream.operators import scan as sc
from redactstream.operators.routing import decide
from redactstream.schema import RAW_SCHEMA


def find(words, score=0.8):
    """A loader for a predictor that finds given words per label group."""

    def load():
        def predict(texts, labels, threshold):
            assert len(texts) <= mdl.CHUNK
            if any("BOOM" in t for t in texts):
                raise RuntimeError("model bug")
            mine = words["person"] if "person" in labels else words["address"]
            out = []
            for t in texts:
                hits = [(t.index(w), t.index(w) + len(w), score) for w in mine if w in t]
                out.append([h for h in hits if h[2] >= threshold])
            return out

        return predict

    return mdl.BatchPredictor(load)


WORDS = {"person": ["Ayesha Malik"], "address": ["PECHS", "Karachi"]}


def test_results_stay_with_their_texts(spark):
    texts = [f"row {i} for Ayesha Malik" if i % 3 == 0 else ("" if i % 3 == 1 else "plain") for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, memo string").repartition(3)
    out = mdl.model_spans(df, "memo", find(WORDS)).orderBy("i").collect()
    for row in out:
        got = [row.memo[f.span_start : f.span_end] for f in row.spans]
        assert got == (["Ayesha Malik"] if row.i % 3 == 0 else [])
        assert row.model_error is None
        assert (row.model_ms > 0) == bool(row.memo)


def test_address_is_widened_and_bridged(spark):
    text = "Kitab Plot 12B, PECHS Block 2, Karachi bhijwa do"
    df = spark.createDataFrame([(1, text)], "i int, memo string")
    (row,) = mdl.model_spans(df, "memo", find(WORDS)).collect()
    (f,) = row.spans
    assert text[f.span_start : f.span_end] == "Plot 12B, PECHS Block 2, Karachi"
    assert f.tier == 2 and f.confidence == 0.8
    plain = mdl.BatchPredictor(find(WORDS).load, extend=False)
    (row,) = mdl.model_spans(df, "memo", plain).collect()
    assert [text[f.span_start : f.span_end] for f in row.spans] == ["PECHS", "Karachi"]


def test_threshold_reaches_the_model(spark):
    df = spark.createDataFrame([(1, "for Ayesha Malik")], "i int, memo string")
    strict = mdl.BatchPredictor(find(WORDS).load, threshold=0.9)
    assert mdl.model_spans(df, "memo", strict).head().spans == []


def raw(spark, memos):
    rows = []
    for i, memo in enumerate(memos):
        value = {
            "message_id": f"550e8400-e29b-41d4-a716-{i:012d}",
            "event_ts": "2024-01-01T00:00:00Z",
            "payload": {"memo": memo, "channel": "atm"},
        }
        rows.append((bytearray(json.dumps(value).encode()), "txn.raw", 0, i))
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_only_the_failing_record_is_held(spark):
    memos = ["to Ayesha Malik", "BOOM", "plain", "", "from Ayesha Malik"]
    rows = decide(raw(spark, memos), predictor=find(WORDS)).orderBy("offset").collect()
    assert [r.action for r in rows] == ["redacted", "quarantined", "clean", "clean", "redacted"]
    assert rows[1].failure_class == "RuntimeError"
    assert "BOOM" not in rows[1].failure_detail
    assert rows[1].message_id != "550e8400-e29b-41d4-a716-000000000001"
    assert json.loads(bytes(rows[0].out_value))["payload"]["memo"] == "to [PERSON_NAME]"


def test_model_scores_never_hold_a_record(spark):
    (row,) = decide(raw(spark, ["to Ayesha Malik"]), predictor=find(WORDS, 0.56)).collect()
    assert row.action == "redacted" and row.max_tier == 2


def test_model_does_not_see_what_rules_own(spark):
    """A name inside an e-mail address is blanked before the model reads it."""
    words = {"person": ["ayesha"], "address": []}
    rows = decide(raw(spark, ["mail ayesha@example.com now"]), predictor=find(words)).collect()
    assert [f.entity_type for f in rows[0].findings] == ["EMAIL"]


def test_scan_and_stream_agree(spark):
    memos = ["to Ayesha Malik, ring 03011234567", "Plot 4, PECHS, Karachi", "nothing"]
    decided = decide(raw(spark, memos), predictor=find(WORDS)).orderBy("offset").collect()
    df = spark.createDataFrame(list(enumerate(memos)), "i int, memo string")
    scanned = sc.scan(df, "memo", predictor=find(WORDS)).orderBy("i").collect()
    for d, s in zip(decided, scanned):
        assert sorted(map(tuple, d.findings)) == sorted(map(tuple, s.findings))


def test_long_rows_are_scanned_whole(spark):
    df = spark.createDataFrame([("x " * 600 + "03011234567",)], "memo string")
    row = sc.scan(df, "memo").head()
    assert not row.truncated and [f.entity_type for f in row.findings] == ["PHONE_PK"]
    assert row.redacted == "x " * 600 + "[PHONE_PK]"


def test_model_windows_find_names_past_and_across_their_edges():
    from redactstream.operators.model import windowed

    def predict(texts, labels, threshold):
        assert all(len(t) <= 50 for t in texts)
        return [[(m.start(), m.end(), 0.9) for m in re.finditer("Ayesha Malik", t)] for t in texts]

    text = "x" * 44 + "Ayesha Malik" + "y" * 200 + "Ayesha Malik"
    assert windowed(predict, 50, 20)([text, "", "Ayesha Malik"], ["name"], 0.5) == [
        [(44, 56, 0.9), (256, 268, 0.9)],
        [],
        [(0, 12, 0.9)],
    ]


@pytest.mark.parametrize(
    "result",
    [[], [[(0, 3, 0.9)], []], [[(-3, 2, 0.9)]], [[(0, 400, 0.9)]], [[(5, 5, 0.9)]]],
    ids=["short", "long", "negative", "overlong", "empty span"],
)
def test_misbehaving_models_fail_the_record(spark, result):
    from redactstream.operators.model import BatchPredictor

    predictor = BatchPredictor(load=lambda: lambda texts, labels, threshold: result, label_groups={"PERSON_NAME": ("name",)})
    row = decide(raw(spark, ["twelve chars"]), predictor=predictor).head()
    assert row.action == "quarantined" and row.failure_class is not None


EXTENSION = [
    ("parcel for 7 Garden East", "Garden East", "7 Garden East"),
    ("parcel for Flat 7, Garden East", "Garden East", "Flat 7, Garden East"),
    ("parcel for Plot No. 7, Garden East", "Garden East", "Plot No. 7, Garden East"),
    ("parcel for Makan No 7-A Garden East", "Garden East", "Makan No 7-A Garden East"),
    ("parcel for Ghar7, Garden East", "Garden East", "Ghar7, Garden East"),
    ("parcel for L204, Garden East", "Garden East", "L204, Garden East"),
    ("House D 9, Garden East", "Garden East", "House D 9, Garden East"),
    ("Flat B-3, Phase 6 Clifton", "Clifton", "Flat B-3, Phase 6 Clifton"),
    ("Flat B-3, Sector M Clifton", "Clifton", "Flat B-3, Sector M Clifton"),
    ("Blk-M, Clifton", "Clifton", "Blk-M, Clifton"),
    ("9GX4+7Q, , Canal View", "Canal View", "9GX4+7Q, , Canal View"),
    ("(31 Canal View)", "Canal View", "31 Canal View"),
    ("Ticket #77, Canal View", "Canal View", "Canal View"),
    ("Ticket # 77, Canal View", "Canal View", "Canal View"),
    ("Ticket # Shop 77, Canal View", "Canal View", "Canal View"),
    ("letters go to Canal View", "Canal View", "Canal View"),
    ("go to 5, Quetta", "Quetta", "5, Quetta"),
    ("near Canal View, Multan", "Canal View", "Canal View, Multan"),
    ("near Canal View Multan;", "Canal View", "Canal View Multan"),
    ("near Canal View, Multan jana hai", "Canal View", "Canal View, Multan"),
    ("near Canal View, Multan Bypass", "Canal View", "Canal View"),
    ("near Canal View, Multan chowk par", "Canal View", "Canal View"),
    ("near Canal View, Multani", "Canal View", "Canal View"),
    ("E 5, F 6, G 7, H 8, Canal View", "Canal View", "F 6, G 7, H 8, Canal View"),
]


@pytest.mark.parametrize("text, found, expected", EXTENSION)
def test_extend_address(spark, text, found, expected):
    s = text.index(found)
    df = spark.createDataFrame([(text, s, s + len(found))], "t string, s int, e int")
    w = df.select(extend_address(F.col("t"), F.col("s"), F.col("e")).alias("w")).head().w
    assert text[w.s : w.e] == expected


def test_relational_dictionary(spark):
    names = spark.createDataFrame([("Noor", "PERSON_NAME", 0.9)], "word string, entity_type string, score double")
    df = spark.createDataFrame([(1, "Noor ki roshni, noor, Noor.")], "k int, t string")
    rows = mdl.dictionary_spans(df, "k", "t", names).collect()
    assert sorted((r.s, r.e) for r in rows) == [(0, 4), (22, 26)]


def shouting():
    """A loader pickled by value, as a closure: tests are not importable in workers."""

    def load():
        def detect(text, field):
            if "BOOM" in text:
                raise ZeroDivisionError("detector bug")
            at = text.find("SECRET")
            return [("CODE_WORD", at, at + 6, 1.0)] if at >= 0 else []

        return detect

    return mdl.PythonDetector(load)


def test_custom_python_detector_fails_one_record_closed(spark):
    memos = ["a SECRET plan, ring 03011234567", "BOOM SECRET", "plain"]
    rows = decide(raw(spark, memos), python_detector=shouting()).orderBy("offset").collect()
    assert [r.action for r in rows] == ["redacted", "quarantined", "clean"]
    assert json.loads(bytes(rows[0].out_value))["payload"]["memo"] == "a [CODE_WORD] plan, ring [PHONE_PK]"
    assert rows[1].failure_class == "ZeroDivisionError" and rows[1].findings == []
    both = decide(raw(spark, memos), predictor=find(WORDS), python_detector=shouting())
    assert [r.action for r in both.orderBy("offset").collect()] == ["redacted", "quarantined", "clean"]


def test_custom_column_detector(spark):
    from redactstream.functions.spans import find_spans, finding

    def order_numbers(text, field):
        hits = find_spans(text, r"#[0-9]{4,}")
        return F.transform(hits, lambda h: finding(F.lit("ORDER"), field, h["s"], h["e"], 1, F.lit(1.0)))

    (row,) = decide(raw(spark, ["see #12345"]), extra_detectors={"order": order_numbers}).collect()
    assert json.loads(bytes(row.out_value))["payload"]["memo"] == "see [ORDER]"
