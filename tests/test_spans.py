"""Span algebra against small brute-force models, on seeded random spans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from redactstream.functions import spans
from redactstream.operators import routing as rt
from redactstream.operators import scan as sc
from redactstream.schema import FINDINGS

KINDS = ["ADDRESS", "CNIC", "EMAIL", "PERSON_NAME"]


def random_rows(n=300, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "".join(rng.choice("abc éü😀 ,1") for _ in range(rng.randint(1, 60)))
        found = []
        for _ in range(rng.randint(0, 6)):
            s = rng.randrange(len(text))
            e = rng.randint(s + 1, len(text))
            tier = rng.choice([1, 2])
            found.append((rng.choice(KINDS), "memo", s, e, tier, rng.choice([0.5, 0.9, 1.0])))
        rows.append((i, text, found))
    # Texts with far more findings than one block of the scans holds.
    for j in range(6):
        text = "".join(rng.choice("abc éü😀 ,1") for _ in range(1500))
        found = []
        for _ in range(150 + 30 * j):
            s = rng.randrange(1490)
            e = s + rng.randint(1, 3 + 2 * j)
            found.append((rng.choice(KINDS), "memo", s, e, rng.choice([1, 2]), rng.choice([0.5, 0.9, 1.0])))
        rows.append((n + j, text, found))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(random_rows(), f"i int, text string, f {FINDINGS}").cache()


def brute_merge(found):
    out = []
    for kind, _, s, e, _, _ in sorted(found, key=lambda x: (x[2], x[3])):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2] | {kind})
        else:
            out.append((s, e, {kind}))
    return [(s, e, "+".join(sorted(k))) for s, e, k in out]


def test_merge_redact_shield(table):
    rows = table.select(
        "text",
        "f",
        spans.merge_spans(F.col("f")).alias("m"),
        spans.redact(F.col("text"), F.col("f")).alias("r"),
        spans.shield(F.col("text"), F.col("f")).alias("s"),
    ).collect()
    for row in rows:
        merged = brute_merge([tuple(x) for x in row.f])
        assert [tuple(x) for x in row.m] == merged
        text, blank = row.text, row.text
        for s, e, label in reversed(merged):
            text = text[:s] + f"[{label}]" + text[e:]
            blank = blank[:s] + " " * (e - s) + blank[e:]
        assert row.r == text
        assert row.s == blank and len(row.s) == len(row.text)


def test_twin_of_merge_agrees(table):
    flat = table.select("i", F.explode("f").alias("x")).select("i", "x.*")
    twin = sc.merge_spans_rel(flat, ["i"]).select("i", "s", "e", "label")
    own = table.select("i", F.explode(spans.merge_spans(F.col("f"))).alias("m")).select("i", "m.*")
    assert sorted(map(tuple, twin.collect())) == sorted(map(tuple, own.collect()))


def test_combine_and_its_twin(table):
    rule = F.filter("f", lambda x: x["tier"] == 1)
    model = F.filter("f", lambda x: x["tier"] == 2)
    rows = table.select("i", "f", spans.combine(rule, model).alias("c")).collect()
    for row in rows:
        rules = [tuple(x) for x in row.f if x.tier == 1]
        kept = [
            tuple(x)
            for x in row.f
            if x.tier == 2 and not any(r[2] <= x.span_start and x.span_end <= r[3] for r in rules)
        ]
        assert [tuple(x) for x in row.c] == rules + kept
    flat = table.select("i", F.explode("f").alias("x")).select("i", "x.*")
    twin = sc.combine_rel(flat.where("tier = 1"), flat.where("tier = 2"), ["i"])
    own = table.select("i", F.explode(spans.combine(rule, model)).alias("x")).select(
        "i", "x.entity_type", "x.span_start", "x.span_end", "x.tier", "x.confidence"
    )
    assert sorted(map(tuple, twin.collect())) == sorted(map(tuple, own.collect()))


def test_dedupe_longest(table):
    rows = table.select("f", spans.dedupe_longest(F.col("f")).alias("d")).collect()
    for row in rows:
        kept = []
        for x in sorted(row.f, key=lambda x: x.span_end - x.span_start, reverse=True):
            if not any(x.span_start < k.span_end and k.span_start < x.span_end for k in kept):
                kept.append(x)
        assert row.d == sorted(kept, key=lambda x: x.span_start)


@pytest.mark.parametrize("gap", [0, 5, 32])
def test_bridge(table, gap):
    parts = F.transform(
        "f",
        lambda x: F.struct(x["span_start"].alias("s"), x["span_end"].alias("e"), x["confidence"].alias("score")),
    )
    for row in table.select("f", spans.bridge_spans(parts, gap).alias("b")).collect():
        out = []
        for s, e, p in sorted((x.span_start, x.span_end, x.confidence) for x in row.f):
            if out and s - out[-1][1] <= gap:
                out[-1] = [out[-1][0], max(out[-1][1], e), max(out[-1][2], p)]
            else:
                out.append([s, e, p])
        assert [list(x) for x in row.b] == out


def test_routing(table):
    rows = table.select("f", rt.route_action(F.col("f")).alias("a"), rt.max_tier(F.col("f")).alias("t")).collect()
    for row in rows:
        held = any(x.tier == 1 and x.confidence < 1.0 for x in row.f)
        assert row.a == ("clean" if not row.f else "quarantined" if held else "redacted")
        assert row.t == max((x.tier for x in row.f), default=0)


def test_touching_spans_stay_apart(spark):
    df = spark.createDataFrame(
        [("abcdef", [("EMAIL", "m", 0, 3, 1, 1.0), ("PHONE_PK", "m", 3, 6, 1, 1.0)])], f"t string, f {FINDINGS}"
    )
    assert df.select(spans.redact(F.col("t"), F.col("f"))).head()[0] == "[EMAIL][PHONE_PK]"


def test_filter_on_a_staged_column_does_not_repeat_detection(spark):
    from redactstream.functions.rules import PHONE_PK

    df = spark.createDataFrame([("ring 03011234567",)], "t string")
    out = sc.scan(df, "t").where(F.size("findings") > 0).select("redacted")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Match and split: the phone pattern is evaluated in one place only.
    assert plan.count(PHONE_PK) == 2
    assert out.head()[0] == "ring [PHONE_PK]"
