"""Governance report, audit trail and statistics over the stored trail."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from redactstream.operators import audit as au
from redactstream.operators import scan as sc
from redactstream.operators import stats as st
from redactstream.plans import batch_report as br
from redactstream.plans import report as rp
from redactstream.plans.catalog.oracle import with_trail, with_txn
from redactstream.plans.catalog.registry import FIXED_NOW, micros, query, r6, trail
from redactstream.plans.catalog.routing import PREDICTOR
from redactstream.sources import broker
from redactstream.sources.views import raw_messages, txn

SINCE = datetime(1996, 1, 1, tzinfo=timezone.utc)
UNTIL = datetime(1998, 7, 1, tzinfo=timezone.utc)
_WINDOWED = "w AS (SELECT * FROM m WHERE processed_ts >= TIMESTAMP '1996-01-01' AND processed_ts < TIMESTAMP '1998-07-01')"


def with_window(sql: str) -> str:
    return with_trail(f", {_WINDOWED} {sql}")


def _window(spark, sf_dir):
    messages, findings = trail(spark, sf_dir)
    return rp.report_window(messages, SINCE, UNTIL), findings


# --------------------------------------------------------------------------- #
# Trail and sections
# --------------------------------------------------------------------------- #
@query(
    "src_audit_messages",
    with_trail(
        """
        SELECT message_id, source_topic, epoch_us(event_ts) AS event_us, epoch_us(processed_ts) AS processed_us, max_tier, action,
          latency_ms, schema_version, failure_class, failure_detail FROM m
        """
    ),
)
def audit_messages(spark, sf_dir):
    messages, _ = trail(spark, sf_dir)
    return messages.select(
        "message_id",
        "source_topic",
        micros("event_ts").alias("event_us"),
        micros("processed_ts").alias("processed_us"),
        "max_tier",
        "action",
        "latency_ms",
        "schema_version",
        "failure_class",
        "failure_detail",
    )


@query(
    "src_audit_findings",
    with_trail(
        """
        SELECT message_id, entity_type, field, span_start::int AS span_start, span_end::int AS span_end, tier, confidence, action FROM f
        """
    ),
)
def audit_findings(spark, sf_dir):
    _, findings = trail(spark, sf_dir)
    return findings.drop("offset", "partition")


@query(
    "window_label",
    with_window("SELECT '1996-01-01 00:00:00Z until 1998-07-01 00:00:00Z' AS label, count(*) AS n FROM w"),
)
def window_label(spark, sf_dir):
    """A window as it is written on a command line, its label and the records inside."""
    since, until = rp.parse_ts("1996-01-01T00:00:00Z"), rp.parse_ts("1998-07-01")
    inside = rp.report_window(trail(spark, sf_dir)[0], since, until)
    return inside.agg(F.count("*").alias("n")).select(rp.window_label(since, until).alias("label"), "n")


@query("report_window", with_window("SELECT message_id, action FROM w"))
def report_window(spark, sf_dir):
    return _window(spark, sf_dir)[0].select("message_id", "action")


_SCOPE = """
SELECT count(*) AS records, epoch_us(min(event_ts)) AS event_min, epoch_us(max(event_ts)) AS event_max,
  epoch_us(min(processed_ts)) AS processed_min, epoch_us(max(processed_ts)) AS processed_max FROM w
"""


@query("rep_scope", with_window(_SCOPE))
def scope(spark, sf_dir):
    out = rp.scope(_window(spark, sf_dir)[0])
    return out.select(
        "records",
        micros("event_ts_min").alias("event_min"),
        micros("event_ts_max").alias("event_max"),
        micros("processed_ts_min").alias("processed_min"),
        micros("processed_ts_max").alias("processed_max"),
    )


@query("rep_by_topic", with_window("SELECT source_topic, count(*) AS n FROM w GROUP BY 1"))
def by_topic(spark, sf_dir):
    return rp.by_topic(_window(spark, sf_dir)[0])


_DISPOSITION = "SELECT action, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::double AS share FROM w GROUP BY action"


@query("rep_disposition", with_window(_DISPOSITION))
def disposition(spark, sf_dir):
    return rp.disposition(_window(spark, sf_dir)[0]).withColumn("share", r6("share"))


@query(
    "share_of_total",
    with_trail("SELECT entity_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::double AS share FROM f GROUP BY 1"),
)
def share_of_total(spark, sf_dir):
    _, findings = trail(spark, sf_dir)
    return rp.with_share(rp.count_by(findings, "entity_type")).withColumn("share", r6("share"))


@query("rep_by_tier", with_window("SELECT max_tier, count(*) AS n FROM w GROUP BY 1"))
def by_tier(spark, sf_dir):
    return rp.by_tier(_window(spark, sf_dir)[0])


@query(
    "join_findings_messages",
    with_window(
        "SELECT f.message_id, f.entity_type, f.field, f.span_start::int AS span_start FROM f JOIN w USING (message_id)"
    ),
)
def join_findings(spark, sf_dir):
    joined = rp.join_findings(*_window(spark, sf_dir))
    return joined.select("message_id", "entity_type", "field", "span_start")


_ENTITIES = """
SELECT f.entity_type, count(*) AS mentions, count(DISTINCT f.message_id) AS messages, min(tier) AS min_tier, max(tier) AS max_tier,
  min(confidence) AS min_confidence FROM f JOIN w USING (message_id) GROUP BY 1
"""


def _entities(spark, sf_dir):
    return rp.entities(rp.join_findings(*_window(spark, sf_dir)))


@query("rep_entities", with_window(_ENTITIES))
def entities(spark, sf_dir):
    return _entities(spark, sf_dir)


@query(
    "rep_entity_fields",
    with_window("SELECT entity_type, field, count(*) AS n FROM f JOIN w USING (message_id) GROUP BY ALL"),
)
def entity_fields(spark, sf_dir):
    return rp.entity_fields(rp.join_findings(*_window(spark, sf_dir)))


@query(
    "rep_failures",
    with_trail("SELECT failure_class, count(*) AS n FROM m WHERE failure_class IS NOT NULL GROUP BY 1"),
)
def failures(spark, sf_dir):
    return rp.failures(trail(spark, sf_dir)[0])


@query(
    "filter_failures",
    with_trail("SELECT failure_class, failure_detail, count(*) AS n FROM m WHERE failure_class IS NOT NULL GROUP BY ALL"),
)
def filter_failures(spark, sf_dir):
    messages, _ = trail(spark, sf_dir)
    return rp.count_by(messages.where("failure_class IS NOT NULL"), "failure_class", "failure_detail")


@query(
    "rep_queue_totals",
    with_trail(
        """
        SELECT count(*) FILTER (action = 'quarantined' AND failure_class IS NOT NULL) AS failclosed_total,
          count(*) FILTER (action = 'quarantined' AND failure_class IS NULL) AS uncertain_total FROM m
        """
    ),
)
def queue_totals(spark, sf_dir):
    return rp.queue_totals(trail(spark, sf_dir)[0])


@query(
    "queue_failclosed",
    with_trail(
        """
        SELECT message_id, epoch_us(processed_ts) AS processed_us, failure_class, failure_detail FROM m
        WHERE action = 'quarantined' AND failure_class IS NOT NULL ORDER BY processed_ts DESC, message_id LIMIT 50
        """
    ),
)
def queue_failclosed(spark, sf_dir):
    out = rp.failclosed_queue(trail(spark, sf_dir)[0])
    return out.select("message_id", micros("processed_ts").alias("processed_us"), "failure_class", "failure_detail")


_UNCERTAIN = """
SELECT m.message_id, epoch_us(m.processed_ts) AS processed_us,
  string_agg(DISTINCT f.entity_type, ', ' ORDER BY f.entity_type) FILTER (WHERE f.tier = 1 AND f.confidence < 1.0) AS entity_types,
  min(f.confidence) FILTER (WHERE f.tier = 1 AND f.confidence < 1.0) AS min_confidence
FROM m LEFT JOIN f USING (message_id) WHERE m.action = 'quarantined' AND m.failure_class IS NULL GROUP BY ALL
"""
_DETAIL = """
SELECT *, CASE WHEN entity_types IS NULL THEN 'held, though every rule finding is certain'
  ELSE entity_types || ': uncertain at ' || printf('%.2f', min_confidence) END AS detail FROM u
"""


def _uncertain_columns(df):
    return df.select(
        "message_id", micros("processed_ts").alias("processed_us"), "entity_types", "min_confidence", "detail"
    )


@query("rep_uncertain", with_trail(f", u AS ({_UNCERTAIN}) {_DETAIL}"))
def uncertain(spark, sf_dir):
    return _uncertain_columns(rp.uncertain(*trail(spark, sf_dir)))


@query(
    "queue_uncertain",
    with_trail(f", u AS ({_UNCERTAIN} ORDER BY processed_us DESC, message_id LIMIT 50) {_DETAIL}"),
)
def queue_uncertain(spark, sf_dir):
    return _uncertain_columns(rp.uncertain_queue(*trail(spark, sf_dir)))


@query(
    "join_uncertain",
    with_trail(
        """
        SELECT m.message_id, count(f.entity_type) AS n_findings FROM m LEFT JOIN f USING (message_id)
        WHERE m.action = 'quarantined' AND m.failure_class IS NULL GROUP BY 1
        """
    ),
)
def join_uncertain(spark, sf_dir):
    """Held messages with all their findings counted; none is lost for having none."""
    messages, findings = trail(spark, sf_dir)
    held = messages.where("action = 'quarantined' AND failure_class IS NULL").select("message_id")
    counts = findings.groupBy("message_id").agg(F.count("*").alias("n_findings"))
    return held.join(counts, "message_id", "left").na.fill(0, ["n_findings"])


@query(
    "rep_throughput",
    with_window(
        """
        SELECT count(*) AS records, round((epoch_us(max(processed_ts)) - epoch_us(min(processed_ts))) / 1e6, 6)::double AS seconds,
          round(count(*) / ((epoch_us(max(processed_ts)) - epoch_us(min(processed_ts))) / 1e6), 9)::double AS rate, 'observed' AS basis FROM w
        """
    ),
)
def throughput(spark, sf_dir):
    out = rp.throughput(_window(spark, sf_dir)[0])
    return out.withColumns({"seconds": r6("seconds"), "rate": F.round("rate", 9)})


@query(
    "rep_top_trigger",
    with_trail(
        f"""
        , u AS ({_UNCERTAIN})
        SELECT entity_types AS trigger, count(*) AS n, (SELECT count(*) FROM u)::bigint AS uncertain_total
        FROM u WHERE entity_types IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1
        """
    ),
)
def top_trigger(spark, sf_dir):
    return rp.top_trigger(rp.uncertain(*trail(spark, sf_dir)))


_CLASSES = """
classes AS (SELECT * FROM (VALUES ('CNIC', 'National identity number'), ('IBAN_PK', 'Financial account identifier'),
  ('PHONE_PK', 'Contact identifier'), ('PERSON_NAME', 'Name'), ('ADDRESS', 'Residential or business address')) AS t(entity_type, data_category))
"""


def _partial_classes(spark):
    """The lookup without one detected type, so that the gap must show."""
    return rp.classes(spark).where("entity_type <> 'EMAIL'")


@query(
    "join_classification",
    with_trail(
        f"""
        , {_CLASSES} SELECT f.entity_type, coalesce(data_category, '**unclassified**') AS data_category, count(*) AS n
        FROM f LEFT JOIN classes USING (entity_type) GROUP BY ALL
        """
    ),
)
def join_classification(spark, sf_dir):
    _, findings = trail(spark, sf_dir)
    counts = rp.count_by(findings, "entity_type")
    return rp.classify(counts, _partial_classes(spark)).select("entity_type", "data_category", "n")


@query(
    "unclassified_types",
    with_trail(f", {_CLASSES} SELECT DISTINCT entity_type FROM f WHERE entity_type NOT IN (SELECT entity_type FROM classes)"),
)
def unclassified_types(spark, sf_dir):
    return rp.unclassified(trail(spark, sf_dir)[1], _partial_classes(spark))


@query(
    "every_entity_classified",
    with_trail(
        f"""
        , {_CLASSES} SELECT DISTINCT entity_type FROM f WHERE entity_type <> 'EMAIL' AND entity_type NOT IN (SELECT entity_type FROM classes)
        """
    ),
)
def every_entity_classified(spark, sf_dir):
    """With the whole lookup, no detected type is without a category."""
    return rp.unclassified(trail(spark, sf_dir)[1], rp.classes(spark))


@query("mixed_provenance", with_window(f", e AS ({_ENTITIES}) SELECT entity_type, min_tier, max_tier, min_confidence FROM e WHERE min_tier <> max_tier"))
def mixed_provenance(spark, sf_dir):
    return rp.mixed_provenance(_entities(spark, sf_dir))


@query(
    "fields_for_entity",
    with_trail(
        """
        , c AS (SELECT entity_type, field, count(*) AS n FROM f GROUP BY ALL)
        SELECT entity_type, string_agg(field, ', ' ORDER BY n DESC, field) AS fields FROM c GROUP BY 1
        """
    ),
)
def fields_for_entity(spark, sf_dir):
    _, findings = trail(spark, sf_dir)
    return rp.fields_for_entity(rp.entity_fields(findings))


_SECTIONS = """
SELECT 'scope' AS section, 'all' AS key, 'records' AS metric, count(*)::double AS value FROM m
UNION ALL SELECT 'by_topic', source_topic, 'records', count(*) FROM m GROUP BY source_topic
UNION ALL SELECT 'disposition', action, 'records', count(*) FROM m GROUP BY action
UNION ALL SELECT 'by_tier', max_tier::varchar, 'records', count(*) FROM m GROUP BY max_tier
UNION ALL SELECT 'failures', failure_class, 'records', count(*) FROM m WHERE failure_class IS NOT NULL GROUP BY failure_class
UNION ALL SELECT 'entities', entity_type, 'mentions', count(*) FROM f GROUP BY entity_type
UNION ALL SELECT 'entities', entity_type, 'messages', count(DISTINCT message_id) FROM f GROUP BY entity_type
UNION ALL SELECT 'entities', entity_type, 'min_tier', min(tier) FROM f GROUP BY entity_type
UNION ALL SELECT 'entities', entity_type, 'max_tier', max(tier) FROM f GROUP BY entity_type
UNION ALL SELECT 'entities', entity_type, 'min_confidence', min(confidence) FROM f GROUP BY entity_type
UNION ALL SELECT 'entity_fields', entity_type || '/' || field, 'mentions', count(*) FROM f GROUP BY entity_type, field
UNION ALL SELECT 'queues', 'all', 'failclosed', count(*) FROM m WHERE action = 'quarantined' AND failure_class IS NOT NULL
UNION ALL SELECT 'queues', 'all', 'uncertain', count(*) FROM m WHERE action = 'quarantined' AND failure_class IS NULL
"""


@query("report_sections", with_trail(_SECTIONS))
def report_sections(spark, sf_dir):
    return rp.report_sections(*trail(spark, sf_dir))


@query(
    "display_labels",
    with_trail(
        """
        SELECT message_id, CASE max_tier WHEN 0 THEN 'none' WHEN 1 THEN 'rules' WHEN 2 THEN 'model' ELSE '--' END AS tier,
          strftime(processed_ts, '%Y-%m-%d %H:%M:%S') || 'Z' AS at FROM m
        """
    ),
)
def display_labels(spark, sf_dir):
    messages, _ = trail(spark, sf_dir)
    return messages.select(
        "message_id", rp.tier_label(F.col("max_tier")).alias("tier"), rp.ts_label(F.col("processed_ts")).alias("at")
    )


@query(
    "quarantine_rate",
    with_trail(
        """
        SELECT count(*) AS records, count(*) FILTER (action = 'quarantined') AS quarantined,
          round(count(*) FILTER (action = 'quarantined') / count(*), 6)::double AS observed, 0.04::double AS expected FROM m
        """
    ),
)
def quarantine_rate(spark, sf_dir):
    return rp.quarantine_rate(trail(spark, sf_dir)[0], 0.02).withColumn("observed", r6("observed"))


# --------------------------------------------------------------------------- #
# Upsert, redelivery, offsets, retention
# --------------------------------------------------------------------------- #
def _redelivered(spark, sf_dir):
    """Every twentieth record comes again in a second batch, decided differently."""
    messages, findings = trail(spark, sf_dir)
    again = messages.where("offset % 20 = 0").withColumns(
        {
            "action": F.lit("redacted"),
            "processed_ts": F.col("processed_ts") + F.expr("INTERVAL 1 DAY"),
            "source_topic": F.lit("txn.replay"),
            "max_tier": F.lit(1),
        }
    )
    found = findings.where("offset % 20 = 0 AND entity_type <> 'EMAIL'")

    def both(first, second):
        return first.withColumn("batch_id", F.lit(0)).unionByName(second.withColumn("batch_id", F.lit(1)))

    return both(messages, again), both(findings, found)


@query(
    "audit_upsert_messages",
    with_trail(
        """
        SELECT message_id, source_topic, epoch_us(event_ts) AS event_us,
          epoch_us(processed_ts) + CASE WHEN k % 20 = 0 THEN 86400000000 ELSE 0 END AS processed_us,
          CASE WHEN k % 20 = 0 THEN 1 ELSE max_tier END AS max_tier, CASE WHEN k % 20 = 0 THEN 'redacted' ELSE action END AS action
        FROM m
        """
    ),
)
def upsert_messages(spark, sf_dir):
    messages, findings = _redelivered(spark, sf_dir)
    winners, _ = au.audit_upsert(messages, findings, ["batch_id", "offset"])
    return winners.select(
        "message_id",
        "source_topic",
        micros("event_ts").alias("event_us"),
        micros("processed_ts").alias("processed_us"),
        "max_tier",
        "action",
    )


@query(
    "audit_upsert_findings",
    with_trail("SELECT message_id, entity_type, field, span_start::int AS span_start FROM f WHERE NOT (k % 20 = 0 AND entity_type = 'EMAIL')"),
)
def upsert_findings(spark, sf_dir):
    messages, findings = _redelivered(spark, sf_dir)
    _, kept = au.audit_upsert(messages, findings, ["batch_id", "offset"])
    return kept.select("message_id", "entity_type", "field", "span_start")


@query(
    "delete_where_in",
    with_trail("SELECT message_id, count(*) AS n FROM f WHERE k % 20 <> 0 GROUP BY 1"),
)
def delete_where_in(spark, sf_dir):
    messages, findings = trail(spark, sf_dir)
    left = au.delete_where_in(findings, messages.where("offset % 20 = 0"))
    return left.groupBy("message_id").agg(F.count("*").alias("n"))


@query(
    "highest_offset",
    with_txn(
        """
        SELECT CASE WHEN k % 4 = 3 THEN 'txn.backfill' ELSE 'txn.raw' END AS topic, (k % 3)::int AS "partition", max(k) + 1 AS position
        FROM txn GROUP BY ALL
        """
    ),
)
def highest_offset(spark, sf_dir):
    return au.highest_offset(raw_messages(spark, sf_dir))


_PEEK = """
, ends AS (SELECT topic, p, max(k) AS last FROM (SELECT k, CASE WHEN k % 4 = 3 THEN 'txn.backfill' ELSE 'txn.raw' END AS topic, k % 3 AS p FROM txn) GROUP BY ALL)
SELECT t.topic, t.p::int AS "partition", t.k AS "offset", t.memo AS shown
FROM (SELECT k, memo, CASE WHEN k % 4 = 3 THEN 'txn.backfill' ELSE 'txn.raw' END AS topic, k % 3 AS p FROM txn) t JOIN ends USING (topic, p)
WHERE k > last - 400 AND k % 10 BETWEEN 4 AND 8 AND (k % 97 <> 0 OR (k // 97) % 14 IN (5, 6, 7, 8, 9, 10, 11, 13)) ORDER BY k DESC LIMIT 20
"""


@query("src_peek_latest", with_txn(_PEEK))
def peek_latest(spark, sf_dir):
    raw = raw_messages(spark, sf_dir)
    return broker.peek_latest(raw, 20, with_text="memo", field="memo")


@query(
    "retention_purge",
    with_trail(
        """
        , r AS (SELECT message_id, CASE action WHEN 'clean' THEN 'txn.clean' WHEN 'quarantined' THEN 'txn.quarantine' ELSE 'txn.clean' END AS topic, processed_ts FROM m)
        SELECT message_id, topic, topic = 'txn.quarantine' AS unreviewed FROM r
        WHERE (epoch_us(TIMESTAMP '1997-06-01') - epoch_us(processed_ts)) / 3600000000.0 > CASE topic WHEN 'txn.clean' THEN 168 ELSE 72 END
        """
    ),
)
def retention_purge(spark, sf_dir):
    messages, _ = trail(spark, sf_dir)
    topic = F.when(F.col("action") == "quarantined", "txn.quarantine").otherwise("txn.clean")
    rows = messages.select("message_id", topic.alias("topic"), F.col("processed_ts").alias("ts"))
    now = F.to_timestamp(F.lit("1997-06-01 00:00:00"))
    return broker.retention_purge(rows, now).drop("ts")


# --------------------------------------------------------------------------- #
# Statistics
# --------------------------------------------------------------------------- #
def _pick(p: float, n: str = "n") -> str:
    """Index percentile over a sorted list, rounding half to even."""
    return f"v[1 + round_even({p} / 100.0 * ({n} - 1), 0)::bigint]"


@query(
    "latency_percentiles",
    f"""
    WITH l AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)
    SELECT event_type, n, {_pick(50)} AS p50, {_pick(95)} AS p95, {_pick(99)} AS p99 FROM l
    """,
)
def latency_percentiles(spark, sf_dir):
    from redactstream.sources.views import table

    return st.index_percentiles(table(spark, sf_dir, "events"), "value", (50, 95, 99), ["event_type"])


@query(
    "latency_percentiles_all",
    f"""
    WITH l AS (SELECT list_sort(list(value)) AS v, count(*) AS n FROM events)
    SELECT n, {_pick(50)} AS p50, {_pick(95)} AS p95, {_pick(99)} AS p99 FROM l
    """,
)
def latency_percentiles_all(spark, sf_dir):
    from redactstream.sources.views import table

    return st.index_percentiles(table(spark, sf_dir, "events"), "value", (50, 95, 99))


@query(
    "pct_floor",
    """
    WITH l AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)
    SELECT event_type, n, v[1 + least(n - 1, floor(0.5 * n)::bigint)] AS p50, v[1 + least(n - 1, floor(0.9 * n)::bigint)] AS p90 FROM l
    """,
)
def pct_floor(spark, sf_dir):
    from redactstream.sources.views import table

    return st.index_percentiles(table(spark, sf_dir, "events"), "value", (50, 90), ["event_type"], rule="floor")


@query(
    "rolling_latency",
    with_trail(
        f"""
        , l AS (SELECT list_sort(list(latency_ms)) AS v, count(*) AS n FROM (SELECT latency_ms FROM m ORDER BY processed_ts DESC, message_id DESC LIMIT 10000))
        SELECT n, {_pick(50)} AS p50, {_pick(95)} AS p95, {_pick(99)} AS p99 FROM l
        """
    ),
)
def rolling_latency(spark, sf_dir):
    return st.rolling_latency(trail(spark, sf_dir)[0])


@query(
    "stats_actions",
    with_trail(
        """
        SELECT (epoch_us(processed_ts) // 86400000000) * 86400000000 AS tick_us, count(*) AS processed,
          count(*) FILTER (action = 'clean') AS clean, count(*) FILTER (action = 'redacted') AS redacted,
          count(*) FILTER (action = 'quarantined') AS quarantined, count(*) FILTER (failure_class IS NOT NULL) AS failed,
          round(count(*) / 86400.0, 9)::double AS rate FROM m GROUP BY 1
        """
    ),
)
def stats_actions(spark, sf_dir):
    out = st.stats_actions(trail(spark, sf_dir)[0], "1 day").withColumn("rate", F.round("rate", 9))
    return out.select(micros("tick").alias("tick_us"), "processed", "clean", "redacted", "quarantined", "failed", "rate")


@query(
    "stream_disposition_window",
    with_trail(
        """
        SELECT (epoch_us(processed_ts) // 604800000000) AS week, action, count(*) AS n FROM
          (SELECT action, processed_ts FROM m) GROUP BY ALL
        """
    ),
)
def disposition_window(spark, sf_dir):
    """Batch twin of the streaming window: adjacent half-open weeks partition all records."""
    out = st.disposition_window(trail(spark, sf_dir)[0], "7 days")
    return out.select((micros("since") / 604800000000).cast("bigint").alias("week"), "action", "n")


@query(
    "sample_per_group",
    "SELECT lang, source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) <= 6",
)
def sample_per_group(spark, sf_dir):
    from redactstream.sources.views import table

    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    return st.sample_per_group(docs, ["lang", "source"], 6, ["doc_id"]).drop("rn")


@query(
    "stratified_sample",
    "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::varchar || ':7'), doc_id) <= 25",
)
def stratified_sample(spark, sf_dir):
    from redactstream.sources.views import table

    docs = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return st.stratified_sample(docs, "lang", 25, "doc_id", 7)


@query(
    "stratum_shortfall",
    "SELECT source, count(*) AS available, 55 AS wanted FROM documents GROUP BY 1 HAVING count(*) < 55",
)
def stratum_shortfall(spark, sf_dir):
    from redactstream.sources.views import table

    return st.stratum_shortfall(table(spark, sf_dir, "documents"), "source", 55)


# --------------------------------------------------------------------------- #
# Batch report over a scan
# --------------------------------------------------------------------------- #
def _scan(spark, sf_dir):
    """Account numbers and memos of every transaction as one text column."""
    memo = F.when(F.col("memo") != "", F.col("memo"))
    text = F.concat_ws(" ", "iban_from", memo)
    rows = txn(spark, sf_dir).select("k", text.alias("note"))
    return sc.scan(rows, "note", predictor=PREDICTOR)


def _batch(spark, sf_dir):
    return br.as_trail(_scan(spark, sf_dir), "k", "notes.csv", F.to_timestamp(F.lit(FIXED_NOW)))


_BATCH_F = """
, bf AS (SELECT k, entity_type, tier, confidence::double AS confidence FROM rule_f WHERE field IN ('iban_from', 'memo')
  UNION ALL SELECT k, entity_type, tier, confidence::double FROM model_f)
"""


@query(
    "batch_entities",
    with_txn(
        f"""{_BATCH_F} SELECT entity_type, count(*) AS mentions, count(DISTINCT k) AS messages, min(tier)::int AS min_tier,
        max(tier)::int AS max_tier, min(confidence) AS min_confidence FROM bf GROUP BY 1"""
    ),
)
def batch_entities(spark, sf_dir):
    return rp.entities(_batch(spark, sf_dir)[1])


@query("batch_fields", with_txn(f"{_BATCH_F} SELECT entity_type, 'memo' AS field, count(*) AS n FROM bf GROUP BY 1"))
def batch_fields(spark, sf_dir):
    return rp.entity_fields(_batch(spark, sf_dir)[1])


@query(
    "batch_disposition",
    with_txn(
        """
        SELECT action, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::double AS share
        FROM (SELECT CASE WHEN k % 50 = 0 THEN 'quarantined' ELSE 'redacted' END AS action FROM txn) GROUP BY 1
        """
    ),
)
def batch_disposition(spark, sf_dir):
    return rp.disposition(_batch(spark, sf_dir)[0]).withColumn("share", r6("share"))


@query(
    "batch_tiers",
    with_txn("SELECT CASE WHEN k % 10 IN (4, 5, 6, 8) THEN 2 ELSE 1 END AS max_tier, count(*) AS n FROM txn GROUP BY 1"),
)
def batch_tiers(spark, sf_dir):
    return rp.by_tier(_batch(spark, sf_dir)[0])


@query(
    "batch_queue",
    with_txn(
        """
        SELECT k AS "row", 'row ' || k AS message_id, 'IBAN_PK: uncertain at 0.50' AS detail
        FROM txn WHERE k % 50 = 0 ORDER BY k LIMIT 50
        """
    ),
)
def batch_queue(spark, sf_dir):
    return br.batch_queue(*_batch(spark, sf_dir)).select("row", "message_id", "detail")


@query(
    "batch_coverage",
    with_txn(
        """
        , hits AS (SELECT k, 24 AS n FROM txn UNION ALL
          SELECT h.k, length(regexp_replace(substr(memo, s + 1, e - s), '[^0-9A-Za-z]', '', 'g'))
          FROM (SELECT k, s, e FROM rule_f WHERE field = 'memo' UNION ALL SELECT k, s, e FROM model_f) h JOIN txn ON txn.k = h.k),
        t AS (SELECT sum(24 + length(regexp_replace(memo, '[^0-9A-Za-z]', '', 'g')))::bigint AS ident, count(*) AS n FROM txn)
        SELECT t.n AS "rows", (SELECT sum(n) FROM hits)::bigint AS masked_chars, ident AS identifying_chars, 0::bigint AS truncated_rows,
          (SELECT count(*) FROM txn WHERE memo = '') AS saturated_rows, round((SELECT sum(n) FROM hits) / ident, 6)::double AS coverage FROM t
        """
    ),
)
def batch_coverage(spark, sf_dir):
    return br.batch_coverage(_scan(spark, sf_dir)).withColumn("coverage", r6("coverage"))
