"""Joins in which one value holds most rows."""

from __future__ import annotations

import pytest
from conftest import SF
from pyspark.sql import functions as F

from redactstream.operators import corpus, model, skew


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def texts(spark):
    rows = [(i, f"the quick name{'abcdefghij'[i % 10]} the" + (" rare" if i % 50 == 0 else "")) for i in range(500)]
    return spark.createDataFrame(rows, "k long, t string")


def test_hot_values_are_counted_over_all_rows(spark, monkeypatch):
    df = spark.createDataFrame([("a",)] * 60 + [("b",)] * 30 + [(c,) for c in "cdefghijkl"], "v string")
    assert {r.v for r in skew.hot_values(df, "v", 3).collect()} == {"a"}
    assert {r.v for r in skew.hot_values(df, "v", 4).collect()} == {"a", "b"}
    assert skew.hot_values(df.limit(0), "v").collect() == []


@pytest.mark.parametrize("share", [1, 3, 1000])
def test_weak_sentences_do_not_depend_on_the_split(spark, monkeypatch, share):
    monkeypatch.setattr(skew, "HOT", share)
    sentences = spark.createDataFrame(
        [(i, "the cat sat" if i % 3 else "the dog zzz") for i in range(90)] + [(100, ""), (101, None), (102, "only new")],
        "k long, t string",
    )
    freq = spark.createDataFrame(
        [(w, c, 1) for w, n in (("the", 3), ("cat", 2), ("sat", 3), ("dog", 3)) for c in "xyz"[:n]],
        "word string, c string, n long",
    )
    got = {r.k: r.weak_tokens for r in corpus.weak_sentences(sentences, "k", "t", freq, "c").collect()}
    want = {i: "cat=2" if i % 3 else "zzz=0" for i in range(90)} | {102: "new=0,only=0"}
    assert got == want


def test_frequent_words_leave_before_the_shuffle(spark, texts):
    freq = corpus.token_frequency(texts.withColumn("c", F.explode(F.array(*map(F.lit, "xyz")))), "t", "c")
    weak = corpus.weak_sentences(texts, "k", "t", freq, "c")
    assert weak.collect() == [] and "BroadcastHashJoin" in plan_of(weak)


@pytest.mark.parametrize("rows, join", [(500_000, "BroadcastHashJoin"), (2, "SortMergeJoin")])
def test_dictionaries_of_both_sizes_find_the_same(spark, texts, monkeypatch, rows, join):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", rows)
    names = spark.createDataFrame(
        [("the", "X", 0.5), ("the", "Y", 0.6), ("rare", "X", 0.9), ("absent", "X", 0.9)],
        "word string, entity_type string, score double",
    )
    found = model.dictionary_spans(texts, "k", "t", names)
    assert f"{join} [word" in plan_of(found)
    got = sorted((r.k, r.entity_type, r.s, r.word) for r in found.collect())
    want = sorted(
        (r.k, kind, at, word)
        for r in texts.collect()
        for word, kinds in (("the", "XY"), ("rare", "X"))
        for at in range(len(r.t))
        if r.t[at:].split(" ")[0] == word and (at == 0 or r.t[at - 1] == " ")
        for kind in kinds
    )
    assert got == want


def test_rows_of_a_hot_value_are_dealt_over_the_salts(spark, monkeypatch):
    left = spark.range(5000).select("id", F.when(F.col("id") < 4900, "hot").otherwise(F.col("id").cast("string")).alias("w"))
    right = left.select("w").distinct().withColumn("x", F.lit(1))
    monkeypatch.setattr(skew, "SALTS", 8)
    joined = skew.salted_join(left, right, "w", F.col("id"))
    assert joined.count() == 5000 and joined.select("id").distinct().count() == 5000
    assert joined.columns == ["w", "id", "x"]


def test_transactions_are_dealt_evenly_whatever_the_row_groups(spark, workdir):
    from redactstream.sources.views import txn

    spark.read.parquet(f"{SF}/orders.parquet").coalesce(1).write.parquet(f"{workdir}/orders.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        sizes = [r[1] for r in txn(spark, workdir).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # Many splits, one row group: all rows were in one task.
    assert len(sizes) >= 8 and max(sizes) < sum(sizes) / 4
