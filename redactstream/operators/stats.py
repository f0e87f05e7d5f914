"""Order statistics and counters that stay exact at any size."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactstream.session import shared_folder

# Bands per cut, and the distinct values of one band that a task may rank.
EDGES = 64
BAND_ROWS = 1_000_000


def _index(p: float, n: Column, rule: str) -> Column:
    """Zero-based rank of the percentile: no interpolation between measured values."""
    if rule == "round":
        # Half to even, as the published figures were computed.
        raw = F.bround(F.lit(p) / 100 * (n - 1).cast("double"))
    elif rule == "floor":
        raw = F.floor(F.lit(p) / 100 * n.cast("double"))
    else:
        raise ValueError(f"unknown index rule {rule!r}")
    return F.least(n - 1, F.greatest(F.lit(0), raw.cast("bigint")))


def index_percentiles(
    df: DataFrame,
    value: str,
    percents: Sequence[float],
    keys: Sequence[str] = (),
    rule: str = "round",
) -> DataFrame:
    """Exact index percentiles per group as columns p<percent>, with the count `n`.

    No group is ever collected or sorted whole. Values are counted first (equal values and hot
    keys shrink map-side). Approximate quantiles cut each group into bands, band totals locate
    the band that holds each rank, and only the rows of those bands are kept, as a table in the
    shared folder. While a band has more than BAND_ROWS distinct values it is cut again, so no
    task ranks more than that. Null values do not count; null is a key like any other. Without keys
    there is always one row, of nulls if there are no values.
    """
    keys = list(keys)
    live = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    live, longest = _stored(_cut(live, value, keys, percents, rule))
    while longest > BAND_ROWS:
        live, shorter = _stored(_cut(live, value, [*keys, "band"]))
        if shorter == longest:
            # One value cannot be cut; a band of several always loses some.
            break
        longest = shorter
    running = Window.partitionBy(*keys, "band").orderBy(value)
    last = F.col("before") + F.sum("c").over(
        running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = live.withColumn("last", last).select(
        *keys,
        "n",
        value,
        F.explode(
            F.filter(
                "want", lambda w: (w["i"] < F.col("last")) & (w["i"] >= F.col("last") - F.col("c"))
            )
        ).alias("w"),
    )
    picks = [F.max(F.when(F.col("w.p") == _name(p), F.col(value))).alias(_name(p)) for p in percents]
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def _cut(
    live: DataFrame,
    value: str,
    groups: Sequence[str],
    percents: Sequence[float] | None = None,
    rule: str = "round",
) -> DataFrame:
    """The rows of `live` (value, count c) in those bands of each group that hold a wanted rank.

    Given `percents`, the groups are whole and get their ranks here; otherwise they are bands with
    n, before and want, of which the next finer bands are made. `in_band` is a band's row count.
    """
    groups = list(groups)
    whole = percents is not None
    cuts = [i / EDGES for i in range(1, EDGES)]
    carried = [] if whole else [F.first(c).alias(c) for c in ("n", "before", "want")]
    edges = live.groupBy(*groups).agg(
        F.percentile_approx(value, cuts, 1000).alias("edges"),
        *([F.sum("c").alias("n")] if whole else carried),
    )
    if whole:
        ranks = [F.struct(F.lit(_name(p)).alias("p"), _index(p, F.col("n"), rule).alias("i")) for p in percents]
        edges = edges.withColumns({"before": F.lit(0).cast("long"), "want": F.array(*ranks)})
    # Approximate quantiles depend on the order in which partial sketches arrive. Totals and kept rows
    # must be cut by the same edges, so these are made once and stored.
    edges = _table(edges)
    banded = _attach(live.select(*groups, value, "c"), edges, groups).withColumn(
        "finer", F.size(F.filter("edges", lambda x: x < F.col(value)))
    )
    totals = banded.groupBy(*groups, "finer").agg(
        F.sum("c").alias("held"), F.count("*").alias("in_band"), *[F.first(c).alias(c) for c in ("n", "before", "want")]
    )
    upto = Window.partitionBy(*groups).orderBy("finer").rowsBetween(Window.unboundedPreceding, -1)
    # At most EDGES rows per group reach this window.
    placed = totals.withColumn("before", F.col("before") + F.coalesce(F.sum("held").over(upto), F.lit(0)))
    inside = F.filter(
        "want", lambda w: (w["i"] >= F.col("before")) & (w["i"] < F.col("before") + F.col("held"))
    )
    targets = placed.select(*groups, "finer", "n", "before", "in_band", inside.alias("want")).where(
        F.size("want") > 0
    )
    kept = _attach(banded.select(*groups, "finer", value, "c"), targets, [*groups, "finer"])
    band = F.col("finer").cast("long") if whole else F.col("band") * EDGES + F.col("finer")
    return kept.withColumn("band", band).drop("finer")


def _stored(live: DataFrame) -> tuple[DataFrame, int]:
    """The rows as a table in the shared folder, and the row count of the longest band."""
    rows = _table(live)
    return rows, rows.agg(F.max("in_band")).head()[0] or 0


def _table(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/bands-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _name(p: float) -> str:
    return f"p{p:g}".replace(".", "_")


def _attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a table with one row per value of the keys; without keys it is one row, so one scalar."""
    if not keys:
        row = right.select(F.struct(*right.columns)).scalar()
        return left.withColumn("_row", row).select(
            *left.columns, *[F.col("_row")[c].alias(c) for c in right.columns]
        )
    theirs = {k: f"_right_{k}" for k in keys}
    same = [F.col(k).eqNullSafe(F.col(r)) for k, r in theirs.items()]
    return left.join(right.withColumnsRenamed(theirs), same).drop(*theirs.values())


def latency_percentiles(messages: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return index_percentiles(messages, "latency_ms", (50, 95, 99), keys)


def rolling_latency(messages: DataFrame, window: int = 10_000) -> DataFrame:
    """Percentiles over the last `window` records: a bounded top-k, then ranks."""
    last = messages.orderBy(F.desc("processed_ts"), F.desc("message_id")).limit(window)
    return latency_percentiles(last)


def index_percentile(values: Column, p: float, rule: str = "round") -> Column:
    """The same figure over a small array; 0.0 when it is empty."""
    n = F.size(values)
    return F.when(n == 0, F.lit(0.0)).otherwise(
        F.get(F.sort_array(values), _index(p, n, rule).cast("int"))
    )


def action_counts() -> list[Column]:
    """Running totals by action, for batch aggregates and for `observe` on a stream."""
    def of(name: str) -> Column:
        return F.count_if(F.col("action") == name).alias(name)

    return [
        F.count("*").alias("processed"),
        of("clean"),
        of("redacted"),
        of("quarantined"),
        F.count_if(F.col("failure_class").isNotNull()).alias("failed"),
    ]


def stats_actions(messages: DataFrame, every: str = "5 seconds") -> DataFrame:
    """Per tick: how many records took each action and at which rate."""
    tick = F.window("processed_ts", every)
    seconds = (F.unix_micros(F.col("w.end")) - F.unix_micros(F.col("w.start"))) / 1e6
    return (
        messages.groupBy(tick.alias("w"))
        .agg(*action_counts())
        .select(
            F.col("w.start").alias("tick"),
            "processed",
            "clean",
            "redacted",
            "quarantined",
            "failed",
            (F.col("processed") / seconds).alias("rate"),
        )
    )


def disposition_window(messages: DataFrame, every: str = "1 day") -> DataFrame:
    """Counts per half-open window and action; adjacent windows partition the records."""
    return (
        messages.groupBy(F.window("processed_ts", every).alias("w"), "action")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("since"), F.col("w.end").alias("until"), "action", "n")
    )


def sample_per_group(df: DataFrame, keys: Sequence[str], k: int, order: Sequence) -> DataFrame:
    """The first k rows per group; Spark limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rn", rank).where(F.col("rn") <= k)


def stratified_sample(df: DataFrame, stratum: str, n: int, key: str, seed: int) -> DataFrame:
    """A repeatable sample of n rows per stratum, ordered by a seeded digest of the key."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    picked = sample_per_group(df.withColumn("_digest", digest), [stratum], n, ["_digest", key])
    return picked.drop("_digest", "rn")


def stratum_shortfall(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """Strata that cannot fill their share."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("available"))
    return sizes.where(F.col("available") < n).withColumn("wanted", F.lit(n))
