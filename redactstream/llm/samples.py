"""A bounded sample of labelled documents to fit a model on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, where: Column | None = None
) -> tuple[list[str], list[int], dict[int, int]]:
    """Texts, their labels, and how many labelled ids of each class there are.

    At most `per_class` ids of each class come, those with the smallest hashes, so the choice
    is the same every time. An id that is labelled twice counts with its smaller label, null
    labels not at all; rows that repeat an id count once. Null texts are empty.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
    known = known.where("doc_id IS NOT NULL AND y IN (0, 1)")
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)
    ]
    # At most 2 * per_class rows of two numbers: small by construction.
    ids = F.broadcast(chosen[0].unionAll(chosen[1]))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    found = sorted(map(tuple, rows.collect()))
    return [r[1] for r in found], [r[2] for r in found], totals
