"""Connected components of an edge table, by alternating star contractions as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactstream.llm.store import drop, keep


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges are (a, b) with a > b."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = keep(large.where("a <> b").distinct(), "stars")
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(lowest, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    return large, moved.unionAll(lowest.select("a", F.col("m").alias("b"))).distinct()


def _print(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex but each component's smallest, which names it.

    `edges` has columns a and b of type long; order, loops and repeats do not matter. Each
    round is a fixed number of joins and aggregates over the edges left, is written to the
    shared folder, and the rounds end when nothing changes. Nothing but two numbers per round
    comes to the driver.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = keep(now.where("a <> b").distinct(), "edges")
    mark = _print(now)
    while mark[0]:
        large, small = _stars(now)
        new = keep(small, "edges")
        drop(large)
        drop(now)
        now, old = new, mark
        mark = _print(now)
        if mark == old:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
