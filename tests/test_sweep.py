"""The evaluation sweep and span containment against plain loops, their plans and their growth."""

from __future__ import annotations

import random
import time

from conftest import SF
from pyspark.sql import functions as F

from redactstream.functions import spans
from redactstream.operators import evaluate as ev
from redactstream.plans.catalog import QUERIES
from redactstream.schema import FINDINGS

LETTERS = "ab- é9"


def plan_of(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def random_case(rng, k, texts=True):
    n = rng.randrange(6, 40)
    text = "".join(rng.choice(LETTERS) for _ in range(n))
    gs = rng.randrange(n - 2)
    gold = (k, gs, rng.randrange(gs + 1, n), text)
    pred = [(k, s, s + rng.randrange(6), rng.choice([0.56, 0.7, 0.97])) for s in (rng.randrange(n) for _ in range(rng.randrange(5)))]
    if rng.random() < 0.3:
        pred.append((k, gold[1], gold[2], 0.8))
    return gold, pred


def frames(spark, seed, n=80):
    rng = random.Random(seed)
    cases = [random_case(rng, k) for k in range(n)]
    gold = spark.createDataFrame([g for g, _ in cases], "k int, gold_start int, gold_end int, text string")
    pred = [p for _, ps in cases for p in ps] + [(9999, 0, 3, 0.8)]
    return cases, gold, spark.createDataFrame(pred, "k int, span_start int, span_end int, score double")


def ident(text, positions):
    return sum(text[p].isalnum() for p in positions if p < len(text))


def test_evaluate_matches_loops(spark):
    cases, gold, pred = frames(spark, 1)
    got = {r.k: r for r in ev.evaluate(gold, pred).collect()}
    assert len(got) == len(cases)
    for (k, gs, ge, text), ps in cases:
        union = {p for _, s, e, _ in ps for p in range(max(s, gs), min(e, ge))}
        r = got[k]
        assert (r.n_pred, r.text, r.coverage) == (len(ps), text, len(union) / (ge - gs))
        assert r.hit == any(gs < e and s < ge for _, s, e, _ in ps) and r.exact == any((s, e) == (gs, ge) for _, s, e, _ in ps)


def test_leaks_and_bands_match_loops(spark):
    cases, gold, pred = frames(spark, 2)
    texts = gold.select("k", "text")
    rules = pred.where("k % 3 = 0").select("k", F.col("span_start"), (F.col("span_start") + 1).alias("span_end"))
    got = {r.k: r for r in ev.leaks(texts, gold, pred, rules).collect()}
    bands = {}
    for (k, gs, ge, text), ps in cases:
        hidden = {p for _, s, e, _ in ps for p in range(s, e)} | {s for _, s, e, _ in ps if k % 3 == 0}
        assert got[k].leaked == ident(text, set(range(gs, ge)) - hidden)
        assert (got[k].n_spans, got[k].min_score) == (len(ps), min((p[3] for p in ps), default=None))
        for _, s, e, score in ps:
            band = next(f"{a:.2f}-{b:.2f}" for a, b in ev.SCORE_BANDS if a <= score < b)
            n, good = bands.get(band, (1, 0))
            bands[band] = (n + 1, good + (ident(text, range(max(s, gs), min(e, ge))) > 0))
    scored = ev.precision_by_band(pred.where("k < 9999"), gold, texts).collect()
    assert {r.band: (r.n + 1, round(r.precision * r.n)) for r in scored} == bands


def test_arms_match_loops(spark):
    rng = random.Random(3)
    span = lambda: (lambda s: (s, s + rng.randrange(0, 6)))(rng.randrange(30))
    arms = [(a, k, *span()) for a in ("x", "y") for k in range(40) for _ in range(rng.randrange(4))]
    meant = [(k, *span()) for k in range(0, 40, 2) for _ in range(2)]
    cases = spark.createDataFrame([(k, 36) for k in range(40)], "k int, n_chars int")
    got = ev.arm_comparison(cases, spark.createDataFrame(arms, "arm string, k int, s int, e int"), spark.createDataFrame(meant, "k int, s int, e int"))
    ok = {(k, p) for k, s, e in meant for p in range(s, e)}
    for r in got.collect():
        mine = {(k, p) for a, k, s, e in arms if a == r.arm for p in range(s, e)}
        assert (r.masked, r.surplus) == (len(mine), len(mine - ok))
        assert round(r.fire_rate * 40) == len({k for k, _ in mine})


def test_evaluation_reads_each_table_once(spark):
    for name, scans, exchanges in (("eval_cube", 2, 3), ("leak_rate", 4, 3), ("arm_comparison", 5, 3)):
        logical, physical = plan_of(QUERIES[name](spark, SF))
        assert physical.count("FileScan") <= scans, name
        # Sorting and grouping share the exchange on the case; no joins bring results back.
        assert "Join" not in physical, name


def findings(rows):
    return [("X", "f", s, e, 1, 1.0) for s, e in rows]


def test_combine_is_containment_and_does_not_grow_with_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        rules = sorted((s, s + rng.randrange(1, 9)) for s in rng.sample(range(40), rng.randrange(6)))
        model = [(s, s + rng.randrange(0, 9)) for s in rng.choices(range(40), k=rng.randrange(6))]
        rows.append((i, findings(rules), findings(model)))
    df = spark.createDataFrame(rows, f"i int, r {FINDINGS}, m {FINDINGS}")
    for r in df.select("r", "m", spans.combine(F.col("r"), F.col("m")).alias("c")).collect():
        kept = [f for f in r.m if not any(x.span_start <= f.span_start and f.span_end <= x.span_end for x in r.r)]
        assert r.c == r.r + kept
    n = 30_000

    def many(step, width):
        x = F.sequence(F.lit(0), F.lit(n - 1))
        return F.transform(x, lambda i: spans.finding(F.lit("X"), F.lit("f"), i * step, i * step + width, 1, F.lit(1.0)))

    big = spark.range(1).select(spans.once(many(10, 8)).alias("r"), spans.once(many(10, 9)).alias("m"))
    started = time.time()
    assert big.select(F.size(spans.combine(F.col("r"), F.col("m")))).first()[0] == 2 * n
    assert time.time() - started < 15
