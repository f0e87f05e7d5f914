"""Filters in front of detection, the trail store, and user detectors on a stream."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from conftest import SF
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from redactstream.operators.audit import audit_findings, audit_messages, audit_upsert
from redactstream.operators.model import PythonDetector
from redactstream.operators.routing import decide
from redactstream.operators.scan import scan
from redactstream.sources import broker
from redactstream.sources.views import raw_messages, table
from redactstream.streaming import firewall as fw
from redactstream.streaming import store as st


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ where
def test_source_conditions_reach_the_scan(spark):
    docs = table(spark, SF, "documents").select("doc_id", "lang", "text")
    out = scan(docs, "text", where=["lang = 'en'", F.size("findings") > 0])
    assert "EqualTo(lang,en)" in plan_of(out)
    late = scan(docs, "text").where("lang = 'en' AND size(findings) > 0")
    assert "EqualTo(lang,en)" not in plan_of(late)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in late.collect())


def test_document_scans_count_emails_only(spark, workdir):
    from redactstream.plans.catalog import QUERIES

    texts = ["write to a@b.com", "token aa24f4db9308e03810347069cc6b5ccc", "none"]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{workdir}/documents.parquet")
    batch = {r.doc_id: (r.n_findings, r.masked_chars, r.action) for r in QUERIES["scan_batch"](spark, workdir).collect()}
    assert batch == {0: (1, 5, "redacted"), 1: (0, 0, "clean"), 2: (0, 0, "clean")}
    assert [tuple(r) for r in QUERIES["scan_where"](spark, workdir).collect()] == [(0, 1)]


def test_conditions_apply_where_their_columns_are_known(spark):
    raw = raw_messages(spark, SF)
    # The table behind the raw records has an event_ts of its own, which is not meant.
    where = ["topic = 'txn.raw'", "event_ts >= TIMESTAMP '1996-01-01'", F.col("action") == "quarantined"]
    now = F.to_timestamp(F.lit("2024-01-01"))
    got = decide(raw, processing_time=now, where=where)
    want = decide(raw, processing_time=now).where("topic = 'txn.raw' AND event_ts >= '1996-01-01' AND action = 'quarantined'")
    assert sorted(r.offset for r in got.collect()) == sorted(r.offset for r in want.collect())
    with pytest.raises(AnalysisException):
        decide(raw, where="no_such_column = 1")
    with pytest.raises(AnalysisException):
        scan(table(spark, SF, "documents"), "text", where="lang +")


def test_failures_of_detectors_count_before_conditions_on_failures(spark):
    body = json.dumps({"message_id": "7b0d3a52-3f4b-4a3e-9d57-0d2f6a2b9b11", "event_ts": "2024-01-01T00:00:00Z", "payload": {"memo": "BOOM"}})
    raw = spark.createDataFrame([(body.encode(), "t", 0, 1)], "value binary, topic string, partition int, offset long")
    assert decide(raw, python_detector=failing(), where="failure_class IS NULL").count() == 0
    assert decide(raw, python_detector=failing(), where="failure_class = 'ZeroDivisionError'").count() == 1


# ------------------------------------------------------------------ detectors on the stream
def failing():
    def load():
        def detect(text, field):
            if "BOOM" in text or text.startswith("For the savings"):
                raise ZeroDivisionError("detector bug")
            return []

        return detect

    return PythonDetector(load)


def plots():
    def load():
        def detect(text, field):
            at = text.find("Kitab")
            return [("BOOK", at, at + 5, 1.0)] if at >= 0 else []

        return detect

    return PythonDetector(load)


def test_stream_runs_user_detectors_with_topics_and_time(spark, workdir):
    raw_messages(spark, SF).drop("k").repartition(2, "offset").write.parquet(f"{workdir}/raw")
    source = broker.file_stream(spark, f"{workdir}/raw", "value BINARY, topic STRING, partition INT, offset BIGINT")
    now = F.to_timestamp(F.lit("2030-01-01"))
    options = dict(python_detector=[failing(), plots()], processing_time=now, where="topic = 'txn.raw'")
    query = fw.start_firewall(
        source, fw.Sinks.parquet(f"{workdir}/out"), f"{workdir}/checkpoint",
        clean_topic="ok", quarantine_topic="held", available_now=True, **options,
    )
    query.awaitTermination()
    messages, findings = st.TrailStore(spark, f"{workdir}/out").read()
    batch = decide(raw_messages(spark, SF), **options)
    cols = ["message_id", "action", "failure_class", "max_tier"]
    assert messages.select(cols).exceptAll(batch.select(cols)).count() == 0 and messages.count() == batch.count()
    broke = messages.where("failure_class = 'ZeroDivisionError'")
    assert broke.count() == broke.where("action = 'quarantined'").count() > 50
    assert findings.where("entity_type = 'BOOK'").count() > 50
    assert [r[0] for r in messages.select("processed_ts").distinct().collect()] == [datetime(2030, 1, 1)]
    routed = spark.read.parquet(f"{workdir}/out/routed").groupBy("topic").count().collect()
    assert {r.topic for r in routed} == {"ok", "held"}


# ------------------------------------------------------------------ trail store
DAYS = [datetime(2024, 3, d, 12, tzinfo=timezone.utc) for d in range(1, 11)]
OUTCOME = "message_id string, topic string, action string, max_tier int, day int, offset long, kinds array<string>"


def write(spark, path, batch, rows):
    """rows: (message_id, topic, action, day, offset, kinds)"""
    f = F.transform(
        "kinds",
        lambda k: F.struct(
            k.alias("entity_type"), F.lit("memo").alias("field"), F.lit(0).alias("span_start"), F.lit(3).alias("span_end"),
            F.lit(1).alias("tier"), F.lit(1.0).alias("confidence"),
        ),
    )
    at = F.timestamp_seconds(F.col("day") * 86400 + DAYS[0].timestamp() - 86400)
    df = spark.createDataFrame([(m, t, a, 1, d, o, k) for m, t, a, d, o, k in rows], OUTCOME)
    null = F.lit(None).cast("string")
    df = df.select(
        "message_id", "topic", "action", "max_tier", "offset", F.lit(0).alias("partition"), f.alias("findings"), at.alias("event_ts"),
        F.lit(1).alias("schema_version"), null.alias("failure_class"), null.alias("failure_detail"), at.alias("now"),
    )
    sinks = fw.Sinks.parquet(path)
    sinks.messages(audit_messages(df, F.col("now"), F.lit(1.0), extra=["offset", "partition"]), batch)
    sinks.findings(audit_findings(df, extra=["offset", "partition"]), batch)


def rows_of(store, since=None, until=None):
    messages, findings = store.read(since, until)
    m = {(r.message_id, r.source_topic, r.action, r.processed_ts.day) for r in messages.collect()}
    assert messages.count() == len(m)
    return m, sorted((r.message_id, r.entity_type) for r in findings.collect())


def test_reads_prune_and_redeliveries_replace_at_every_stage(spark, workdir):
    store = st.TrailStore(spark, workdir)
    assert rows_of(store) == (set(), [])
    write(spark, workdir, 0, [("a", "t1", "redacted", 1, 1, ["X", "Y"]), ("b", "t1", "clean", 2, 2, [])])
    write(spark, workdir, 1, [("c", "t1", "redacted", 3, 3, ["Z"]), ("d", "t1", "redacted", 5, 4, ["X"])])
    write(spark, workdir, 2, [("a", "t2", "quarantined", 4, 9, ["Q"]), ("a", "t2", "redacted", 4, 8, ["no"])])
    want = {("a", "t1", "quarantined", 4), ("b", "t1", "clean", 2), ("c", "t1", "redacted", 3), ("d", "t1", "redacted", 5)}
    found = [("a", "Q"), ("c", "Z"), ("d", "X")]
    for step in range(4):
        assert rows_of(store) == (want, found)
        # Day 1 held only the first delivery of a; day 4 is where it is now.
        assert rows_of(store, DAYS[0], DAYS[1]) == (set(), [])
        assert rows_of(store, DAYS[2], DAYS[4]) == ({r for r in want if r[3] in (3, 4)}, [("a", "Q"), ("c", "Z")])
        if step == 0:
            assert store.compact().upto == 1
            days = store.state().periods["messages"]
            assert sorted(days) == ["2024-03-01", "2024-03-02", "2024-03-03", "2024-03-05"]
        elif step == 1:
            state = store.compact(upto=2)
            assert state.periods["messages"] == {"2024-03-02": 1, "2024-03-03": 1, "2024-03-05": 1, "2024-03-04": 2}
        else:
            store.vacuum()
            assert store.batches() == []
    plan = plan_of(store.read(DAYS[2], DAYS[4])[0])
    assert "PartitionFilters: [isnotnull(period" in plan
    reads = [len(store.read(DAYS[2], DAYS[4])[0].inputFiles())]
    for batch in range(3, 9):
        write(spark, workdir, batch, [(f"n{batch}", "t1", "clean", 9, batch * 10, [])])
    store.compact(upto=8)
    reads.append(len(store.read(DAYS[2], DAYS[4])[0].inputFiles()))
    assert reads[0] == reads[1] == 3


def test_replay_half_batches_and_rivals(spark, workdir):
    store = st.TrailStore(spark, workdir)
    write(spark, workdir, 0, [("a", "t1", "redacted", 1, 1, ["X"])])
    write(spark, workdir, 0, [("a", "t1", "redacted", 1, 1, ["X"])])
    fw.parquet_sink(f"{workdir}/messages")(spark.read.parquet(f"{workdir}/messages").drop("batch_id"), 1)
    assert store.batches() == [0] and rows_of(store) == ({("a", "t1", "redacted", 1)}, [("a", "X")])
    assert store.compact() == st.EMPTY
    state = store.compact(upto=0)
    with pytest.raises(RuntimeError, match="another compaction"):
        store._publish(state)
    with pytest.raises(ValueError, match="kept by day"):
        st.TrailStore(spark, workdir, period="month").read()


def test_store_equals_the_plain_upsert(spark, workdir):
    rows = [(f"m{i % 7}", f"t{i}", ["clean", "redacted"][i % 2], 1 + i % 9, i, ["X"] * (i % 3)) for i in range(40)]
    store = st.TrailStore(spark, workdir)
    for batch in range(5):
        write(spark, workdir, batch, rows[batch * 8 : batch * 8 + 8])
    messages, findings = (spark.read.parquet(f"{workdir}/{t}") for t in ("messages", "findings"))
    winners, kept = audit_upsert(messages, findings, st.VERSION)
    want = {(r.message_id, r.source_topic, r.action, r.processed_ts.day) for r in winners.collect()}
    found = sorted((r.message_id, r.entity_type) for r in kept.collect())
    for upto in (None, 0, 2, 4):
        if upto is not None:
            store.compact(upto=upto)
        assert rows_of(store) == (want, found)
