"""Joins on words and other values of which a few are in very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A value is hot if it is in more than one row of so many; so there are fewer hot values than this.
HOT = 1000
#: Rows of a hot value are dealt over so many keys.
SALTS = 64
#: A table of at most so many rows and bytes is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32_000_000


def hot_values(df: DataFrame, column: str, share: int | None = None) -> DataFrame:
    """(column, hot) of every value in more than one of `share` rows, counted over all rows.

    Equal values are counted before the shuffle. At most `share` rows by construction, so the
    result may be broadcast.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.where(F.col("n") * (share or HOT) > total).select(column, F.lit(True).alias("hot"))


def fits_broadcast(df: DataFrame) -> bool:
    """Whether all rows of a table stay below the broadcast bounds, by measuring them."""
    sizes = [F.octet_length(F.col(f.name).cast("string")) for f in df.schema]
    size = sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(0))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= BROADCAST_ROWS and total <= BROADCAST_BYTES


def salted_join(left: DataFrame, right: DataFrame, on: str, spread_by: Column) -> DataFrame:
    """Inner join in which the rows of a hot value of the left side are dealt over SALTS tasks.

    Only the right side's rows of hot values are repeated, once per salt. Neither side has a
    size bound, so neither is broadcast.
    """
    hot = F.broadcast(hot_values(left, on))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(spread_by), F.lit(SALTS))).otherwise(0)
    last = F.when(F.col("hot"), F.lit(SALTS - 1)).otherwise(0)
    dealt = left.join(hot, on, "left").withColumn("_salt", salt.cast("int")).drop("hot")
    copies = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("hot")
    return dealt.join(copies.hint("merge"), [on, "_salt"]).drop("_salt")
