"""The audit trail as a base and deltas, so that a report reads what its window needs.

Layout under one folder:

    messages/batch_id=N, findings/batch_id=N     one delta per micro-batch, replaced on replay
    base/messages/version=V/period=P, base/findings/version=V/period=P
    current/00000007.json                        which version holds each period, up to which batch

Compaction folds finished deltas into the base and rewrites only the periods they touch (days, or
months for a thin trail over many years); the others stay where they are. Nothing is changed in place: a new state is a new pointer file, put
under its final name by one rename, so a reader sees the old state or the new one, and a crash
leaves an unused version behind. Periods are those of the winning write's processed_ts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactstream.operators.audit import KEPT, UPDATED, audit_upsert
from redactstream.schema import FINDING_COLUMNS, MESSAGE_COLUMNS

VERSION = ["batch_id", "offset", "partition"]
MESSAGES = (
    "message_id STRING, source_topic STRING, event_ts TIMESTAMP, processed_ts TIMESTAMP, max_tier INT, action STRING, "
    "latency_ms DOUBLE, schema_version INT, failure_class STRING, failure_detail STRING"
)
FINDINGS = (
    "message_id STRING, entity_type STRING, field STRING, span_start INT, span_end INT, tier INT, confidence DOUBLE, "
    "action STRING"
)
PLACED = ", offset BIGINT, partition INT, batch_id BIGINT"
SCHEMAS = {"messages": MESSAGES, "findings": FINDINGS}


@dataclass(frozen=True)
class State:
    """What a pointer file says: versions of days, per table, and the last batch in them."""

    number: int
    upto: int
    periods: dict[str, dict[str, int]]


EMPTY = State(0, -1, {"messages": {}, "findings": {}})
# The date format that names a period; names sort by time.
PERIODS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}


def period_name(at: datetime | None, period: str) -> str | None:
    if at is None:
        return None
    at = (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
    return at.date().isoformat()[: len(PERIODS[period])]


class TrailStore:
    """Reads and compacts the trail that `Sinks.parquet` writes under `path`.

    `period` is that of a store from its first compaction on.
    """

    def __init__(self, spark: SparkSession, path: str, period: str = "day"):
        self.spark, self.path, self.period = spark, path.rstrip("/"), period
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------------ files
    def _list(self, folder: str) -> list[str]:
        at = self._fs_path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read_text(self, name: str) -> str:
        stream = self._fs.open(self._fs_path(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, state: State) -> None:
        """Write the pointer beside its place and rename it there; a name that is taken refuses."""
        part = self._fs_path(f"{self.path}/current/.{uuid.uuid4().hex}.part")
        final = self._fs_path(f"{self.path}/current/{state.number:08d}.json")
        out = self._fs.create(part, False)
        try:
            out.write(bytearray(json.dumps({"period": self.period, "upto": state.upto, "periods": state.periods}).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(part, final):
            self._fs.delete(part, False)
            raise RuntimeError(f"another compaction has published state {state.number}")

    def state(self) -> State:
        names = [n for n in self._list("current") if n.endswith(".json")]
        if not names:
            return EMPTY
        said = json.loads(self._read_text(f"current/{names[-1]}"))
        if said["period"] != self.period:
            raise ValueError(f"this trail is kept by {said['period']}, not by {self.period}")
        return State(int(names[-1].split(".")[0]), said["upto"], said["periods"])

    def batches(self, after: int = -1) -> list[int]:
        """Deltas whose two tables are both complete; the sink writes the findings last."""

        def complete(table: str) -> set[int]:
            found = {int(n.split("=")[1]) for n in self._list(table) if n.startswith("batch_id=")}
            return {b for b in found if b > after and self._fs.exists(self._fs_path(f"{self.path}/{table}/batch_id={b}/_SUCCESS"))}

        return sorted(complete("messages") & complete("findings"))

    # ------------------------------------------------------------------ tables
    def _deltas(self, table: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], SCHEMAS[table] + PLACED)
        reader = self.spark.read.schema(SCHEMAS[table] + PLACED).option("basePath", f"{self.path}/{table}")
        return reader.parquet(*[f"{self.path}/{table}/batch_id={b}" for b in batches])

    def _base(self, table: str, state: State, since: str | None = None, until: str | None = None) -> DataFrame:
        """The base's periods that the window touches; the partition filter says so in the plan, too."""
        held = state.periods[table].items()
        periods = {p: v for p, v in held if (not since or p >= since) and (not until or p <= until)}
        schema = SCHEMAS[table] + (", processed_ts TIMESTAMP" if table == "findings" else "") + ", version INT, period STRING"
        if not periods:
            return self.spark.createDataFrame([], schema)
        root = f"{self.path}/base/{table}"
        reader = self.spark.read.schema(schema).option("basePath", root)
        rows = reader.parquet(*[f"{root}/version={v}/period={p}" for p, v in sorted(periods.items())])
        if since:
            rows = rows.where(F.col("period") >= since)
        return rows.where(F.col("period") <= until) if until else rows

    def _winners(self, batches: list[int], state: State) -> tuple[DataFrame, DataFrame]:
        """Last writes among the deltas, with the first values of the base where it knows the message."""
        winners, findings = audit_upsert(self._deltas("messages", batches), self._deltas("findings", batches), VERSION)
        first = self._base("messages", state).select("message_id", F.struct(*KEPT).alias("_first"))
        known = winners.join(first, "message_id", "left")
        kept = [F.when(F.col("_first").isNull(), F.col(c)).otherwise(F.col(f"_first.{c}")).alias(c) for c in KEPT]
        return known.select("message_id", *kept, *UPDATED, *VERSION), findings

    def read(self, since: datetime | None = None, until: datetime | None = None) -> tuple[DataFrame, DataFrame]:
        """The current messages processed in [since, until), and their findings.

        Base periods outside the window are not read; deltas newer than the base are read whole,
        and their number is what the last compaction left.
        """
        state = self.state()
        batches = self.batches(state.upto)

        def inside(df: DataFrame) -> DataFrame:
            if since is not None:
                df = df.where(F.col("processed_ts") >= F.lit(since))
            return df.where(F.col("processed_ts") < F.lit(until)) if until is not None else df

        bounds = (period_name(since, self.period), period_name(until, self.period))
        messages = inside(self._base("messages", state, *bounds)).select(*MESSAGE_COLUMNS)
        findings = inside(self._base("findings", state, *bounds)).select(*FINDING_COLUMNS)
        if batches:
            winners, found = self._winners(batches, state)
            newer = winners.select("message_id")
            in_window = inside(winners)
            found = found.join(in_window.select("message_id"), "message_id", "left_semi")
            messages = messages.join(newer, "message_id", "left_anti").unionByName(in_window.select(*MESSAGE_COLUMNS))
            findings = findings.join(newer, "message_id", "left_anti").unionByName(found.select(*FINDING_COLUMNS))
        return messages, findings

    # ------------------------------------------------------------------ upkeep
    def compact(self, upto: int | None = None) -> State:
        """Fold complete deltas into the base: by default all but the newest, which may be replayed.

        Only periods of superseded or new rows are written anew. What comes to the driver is one
        row per such period.
        """
        state = self.state()
        found = self.batches(state.upto)
        batches = found[:-1] if upto is None else [b for b in found if b <= upto]
        if not batches:
            return state
        number = state.number + 1
        winners, found = self._winners(batches, state)
        # Decided once: two tables and the list of periods come from it.
        stage = f"{self.path}/base/stage-{number}-{uuid.uuid4().hex}"
        winners.withColumn("period", F.date_format("processed_ts", PERIODS[self.period])).write.parquet(stage)
        winners = self.spark.read.parquet(stage)
        ids = winners.select("message_id")
        superseded = self._base("messages", state).select("message_id", "period").join(ids, "message_id", "left_semi")
        touched = sorted(r.period for r in winners.select("period").union(superseded.select("period")).distinct().collect())
        old = {t: {d: v for d, v in state.periods[t].items() if d in set(touched)} for t in SCHEMAS}
        held = State(state.number, state.upto, old)
        messages = self._base("messages", held).drop("version").join(ids, "message_id", "left_anti")
        messages = messages.unionByName(winners.select(*MESSAGE_COLUMNS, "period"))
        placed = found.join(winners.select("message_id", "processed_ts", "period"), "message_id")
        findings = self._base("findings", held).drop("version").join(ids, "message_id", "left_anti")
        findings = findings.unionByName(placed.select(*FINDING_COLUMNS, "processed_ts", "period"))
        periods = {}
        for table, rows in (("messages", messages), ("findings", findings)):
            root = f"{self.path}/base/{table}/version={number}"
            rows.repartition("period").write.mode("overwrite").partitionBy("period").parquet(root)
            written = {n.split("=")[1] for n in self._list(f"base/{table}/version={number}") if n.startswith("period=")}
            kept = {d: v for d, v in state.periods[table].items() if d not in set(touched)}
            periods[table] = kept | dict.fromkeys(written, number)
        new = State(number, batches[-1], periods)
        self._publish(new)
        self._fs.delete(self._fs_path(stage), True)
        return new

    def vacuum(self, keep: int = 1) -> None:
        """Delete deltas and period folders that none of the last `keep` states refers to.

        Readers that started from an older state need it until they end; choose `keep` so.
        """
        names = [n for n in self._list("current") if n.endswith(".json")]
        states = [json.loads(self._read_text(f"current/{n}")) for n in names[-keep:]]
        if not states:
            return
        for name in names[:-keep]:
            self._delete(f"current/{name}")
        folded = min(s["upto"] for s in states)
        for table in SCHEMAS:
            self._delete_all(f"{table}/{n}" for n in self._list(table) if n.startswith("batch_id=") and int(n[9:]) <= folded)
            used = {(v, p) for s in states for p, v in s["periods"][table].items()}
            for version in self._list(f"base/{table}"):
                v = int(version.split("=")[1])
                if v > int(names[-1].split(".")[0]):
                    continue  # of a compaction that is still at work
                periods = [n for n in self._list(f"base/{table}/{version}") if n.startswith("period=")]
                self._delete_all(f"base/{table}/{version}/{n}" for n in periods if (v, n[7:]) not in used)

    def _delete(self, name: str) -> None:
        self._fs.delete(self._fs_path(f"{self.path}/{name}"), True)

    def _delete_all(self, names: Iterable[str]) -> None:
        for name in names:
            self._delete(name)
