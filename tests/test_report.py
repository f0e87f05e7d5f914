"""Report queries on a small trail whose figures are known by hand."""

from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from redactstream.operators import scan as sc
from redactstream.operators import stats as st
from redactstream.operators.audit import audit_upsert
from redactstream.plans import batch_report as br
from redactstream.plans import report as rp
from redactstream.plans.catalog import registry


def at(hour, minute=0):
    return datetime(2024, 5, 1, hour, minute, tzinfo=timezone.utc)


MESSAGES = [
    ("a", "txn.raw", at(8), at(9), 1, "redacted", None, None),
    ("b", "txn.raw", at(8), at(10), 0, "clean", None, None),
    ("c", "txn.raw", at(8), at(11), 2, "quarantined", None, None),
    ("d", "txn.two", at(8), at(12), 0, "quarantined", "KeyError", "payload is missing"),
    ("e", "txn.two", at(8), at(13), 0, "quarantined", None, None),
]
FINDINGS = [
    ("a", "EMAIL", "email", 1, 1.0),
    ("a", "EMAIL", "memo", 1, 1.0),
    ("c", "IBAN_PK", "iban", 1, 0.5),
    ("c", "CNIC", "memo", 1, 0.5),
    ("c", "PERSON_NAME", "memo", 2, 0.2),
    ("c", "PERSON_NAME", "name", 1, 1.0),
]


@pytest.fixture(scope="module")
def trail(spark):
    m = spark.createDataFrame(
        MESSAGES,
        "message_id string, source_topic string, event_ts timestamp, processed_ts timestamp, "
        "max_tier int, action string, failure_class string, failure_detail string",
    ).withColumn("latency_ms", F.lit(1.0))
    f = spark.createDataFrame(
        FINDINGS, "message_id string, entity_type string, field string, tier int, confidence double"
    )
    return m, f


def test_adjacent_windows_partition_the_records(trail):
    m, _ = trail
    first = rp.report_window(m, None, at(11))
    second = rp.report_window(m, at(11), None)
    assert first.count() + second.count() == m.count()
    assert "c" not in [r.message_id for r in first.collect()]
    assert rp.report_window(m).count() == 5


def test_window_reaches_the_scan(spark, trail, workdir):
    trail[0].write.parquet(f"{workdir}/m")
    stored = spark.read.parquet(f"{workdir}/m")
    for bounds, pushed in (((at(9), None), "GreaterThanOrEqual(processed_ts"), ((None, at(12)), "LessThan(processed_ts")):
        report = rp.by_topic(rp.report_window(stored, *bounds))
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan
        assert "ReadSchema: struct<source_topic:string,processed_ts:timestamp>" in plan


def test_entities(trail):
    m, f = trail
    rows = {r.entity_type: r for r in rp.entities(rp.join_findings(m, f)).collect()}
    assert (rows["EMAIL"].mentions, rows["EMAIL"].messages) == (2, 1)
    person = rows["PERSON_NAME"]
    assert (person.min_tier, person.max_tier, person.min_confidence) == (1, 2, 0.2)
    mixed = rp.mixed_provenance(rp.entities(rp.join_findings(m, f))).collect()
    assert [r.entity_type for r in mixed] == ["PERSON_NAME"]


def test_uncertain_queue_names_the_trigger_only(trail):
    rows = {r.message_id: r for r in rp.uncertain_queue(*trail).collect()}
    assert set(rows) == {"c", "e"}
    assert rows["c"].detail == "CNIC, IBAN_PK: uncertain at 0.50"
    assert rows["e"].detail == rp.NO_TRIGGER


def test_capped_list_uncapped_total(trail):
    m, f = trail
    assert rp.uncertain_queue(m, f, 1).count() == 1
    totals = rp.queue_totals(m).head()
    assert (totals.failclosed_total, totals.uncertain_total) == (1, 2)
    top = rp.top_trigger(rp.uncertain(m, f)).head()
    assert (top.trigger, top.n, top.uncertain_total) == ("CNIC, IBAN_PK", 1, 2)


def test_whole_report(trail, spark):
    sections = rp.report(*trail, rp.classes(spark))
    counts = {name: df.count() for name, df in sections.items()}
    assert counts["unclassified"] == 0
    assert counts["disposition"] == 3 and counts["by_topic"] == 2 and counts["failures"] == 1


def test_throughput_edges(trail):
    m, _ = trail
    assert rp.throughput(m.where("false")).head().basis == "--"
    assert rp.throughput(m.where("message_id = 'a'")).head().basis == "no time elapsed"


def test_parse_ts():
    assert rp.parse_ts(None) is None
    assert rp.parse_ts("2024-05-01T09:00:00Z") == at(9)
    assert rp.parse_ts("2024-05-01T09:00:00") == at(9)


@pytest.mark.parametrize("rule", ["round", "floor"])
def test_index_percentiles_are_exact(spark, rule):
    import random

    rng = random.Random(3)
    values = [("hot", float(rng.randrange(50))) for _ in range(3000)]
    values += [("wide", rng.random() * 1000) for _ in range(777)] + [("one", 4.0)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {r.g: r for r in st.index_percentiles(df, "v", (0, 50, 95, 99, 100), ["g"], rule).collect()}
    for g in ("hot", "wide", "one"):
        ordered = sorted(v for k, v in values if k == g)
        n = len(ordered)
        for p in (0, 50, 95, 99, 100):
            raw = round(p / 100 * (n - 1)) if rule == "round" else int(p / 100 * n)
            assert got[g][f"p{p}"] == ordered[min(n - 1, max(0, raw))]
        assert got[g].n == n


def test_bands_are_cut_until_a_task_can_rank_them(spark, monkeypatch):
    monkeypatch.setattr(st, "EDGES", 2)
    monkeypatch.setattr(st, "BAND_ROWS", 10)
    ranked, stored = [], st._stored

    def watched(live):
        rows, longest = stored(live)
        ranked.append((rows, longest))
        return rows, longest

    monkeypatch.setattr(st, "_stored", watched)
    values = [("wide", i * 7919 % 1000 / 8) for i in range(1000)] + [(None, float(i % 30)) for i in range(900)]
    df = spark.createDataFrame(values + [("wide", None), ("one", 5.0)], "g string, v double")
    got = {r.g: r for r in st.index_percentiles(df, "v", (0, 50, 99), ["g"]).collect()}
    for g in ("wide", None, "one"):
        ordered = sorted(v for k, v in [*values, ("one", 5.0)] if k == g)
        assert got[g].n == len(ordered)
        for p in (0, 50, 99):
            assert got[g][f"p{p}"] == ordered[round(p / 100 * (len(ordered) - 1))]
    rows, longest = ranked[-1]
    assert len(ranked) > 3 and longest <= 10 < ranked[0][1]
    assert rows.groupBy("g", "band").count().agg(F.max("count")).head()[0] == longest
    alone = st.index_percentiles(df.where("g = 'wide'"), "v", (50,)).head()
    assert (alone.n, alone.p50) == (1000, 62.5)


def test_totals_and_kept_rows_are_cut_by_the_same_edges(spark, monkeypatch):
    # Approximate quantiles may come out otherwise when they are evaluated again.
    import os

    noisy = F.udf(lambda v: v * int.from_bytes(os.urandom(2), "big") / 32768, "double")
    quantiles = F.percentile_approx
    monkeypatch.setattr(st.F, "percentile_approx", lambda c, cuts, n: quantiles(noisy(F.col(c)), cuts, n))
    values = [(g, float(i * 7919 % 1000)) for g in "ab" for i in range(1000)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {r.g: (r.n, r.p50, r.p90) for r in st.index_percentiles(df, "v", (50, 90), ["g"], "floor").collect()}
    assert got == {"a": (1000, 500.0, 900.0), "b": (1000, 500.0, 900.0)}


def test_percentiles_of_nothing(spark):
    none = spark.createDataFrame([("a", None)], "g string, v double")
    assert st.index_percentiles(none, "v", (50,), ["g"]).collect() == []
    # A total over no rows is one row, as with any aggregate.
    assert [tuple(r) for r in st.index_percentiles(none, "v", (50,)).collect()] == [(None, None)]


def test_index_percentile_of_an_array(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(st.index_percentile(F.col("v"), 50)).collect()] == [2.0, 0.0]


def test_upsert_keeps_first_identity_and_last_decision(spark, trail):
    m, f = trail
    first = m.withColumns({"batch_id": F.lit(0), "schema_version": F.lit(1)})
    again = first.where("message_id = 'a'").withColumns(
        {"batch_id": F.lit(1), "action": F.lit("clean"), "source_topic": F.lit("other"), "max_tier": F.lit(0)}
    )
    messages, findings = audit_upsert(first.unionByName(again), f.withColumn("batch_id", F.lit(0)), ["batch_id"])
    row = messages.where("message_id = 'a'").head()
    assert (row.action, row.max_tier, row.source_topic) == ("clean", 0, "txn.raw")
    assert findings.where("message_id = 'a'").count() == 0
    assert findings.where("message_id = 'c'").count() == 4


def test_batch_report_and_audit_report_share_figures(spark):
    rows = [(0, "PK99MEZN5748718428058488"), (1, "mail a@example.com"), (2, "plain")]
    scanned = sc.scan(spark.createDataFrame(rows, "row int, note string"), "note")
    out = br.batch_report(scanned, "row", "notes.csv", F.lit(at(9)), rp.classes(spark))
    assert {(r.action, r.n) for r in out["disposition"].collect()} == {
        ("clean", 1), ("quarantined", 1), ("redacted", 1),
    }
    (held,) = out["uncertain"].collect()
    assert held.message_id == "row 0" and "IBAN_PK" in held.detail
    cover = out["coverage"].head()
    assert (cover.rows, cover.masked_chars, cover.saturated_rows) == (3, 24 + 11, 1)
    stored = sc.without_text(scanned, "note")
    assert not {"note", "scanned", "redacted", "merged"} & set(stored.columns)
    assert not any("example.com" in str(r) for r in stored.collect())


def test_stats_window_and_labels(trail):
    m, _ = trail
    ticks = st.stats_actions(m, "1 hour").collect()
    assert sum(r.processed for r in ticks) == 5 and len(ticks) == 5
    assert m.select(rp.window_label(None, at(9))).head()[0] == "start of trail until 2024-05-01 09:00:00Z"
    assert m.select(rp.share_label(F.lit(1), F.lit(0))).head()[0] == "--"
    assert m.select(rp.share_label(F.lit(1), F.lit(3))).head()[0] == "33.3%"


def test_trail_tables_are_projections_of_one_stored_decision(spark):
    """Messages and findings are written once, together; what reads messages opens no findings."""
    messages, findings = registry.trail(spark, "/root/testdata/sf0.001")
    assert sorted(messages.inputFiles()) == sorted(findings.inputFiles())
    plan = messages.select("message_id", "action", "processed_ts")._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert "action" in read and "findings" not in read
    kinds = findings.select("entity_type")._jdf.queryExecution().executedPlan().toString()
    assert "span_start" not in kinds.split("ReadSchema: ")[1].splitlines()[0]
