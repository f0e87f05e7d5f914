"""Detection-quality metrics over gold and predicted spans derived from the transactions.

The oracles count characters one by one; the jobs use interval arithmetic.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from redactstream.operators import evaluate as ev
from redactstream.plans.catalog.oracle import with_fields, with_txn
from redactstream.plans.catalog.registry import query, r6
from redactstream.sources.views import txn, txn_fields

# Gold spans of memos: the name, the phone or the address that was written into them.
GOLD_SQL = """
SELECT k, CASE WHEN k % 10 = 8 THEN 'ADDRESS' ELSE 'PERSON_NAME' END AS entity_type,
  CASE k % 3 WHEN 0 THEN 'english' WHEN 1 THEN 'codeswitch' ELSE 'roman_urdu' END AS style,
  CASE WHEN k % 4 = 0 THEN 'rare' ELSE 'common' END AS band, channel AS city, memo AS text,
  cast(CASE WHEN k % 10 = 8 THEN instr(memo, 'Plot') ELSE instr(memo, account_holder) END - 1 AS int) AS gold_start,
  cast(CASE WHEN k % 10 = 8 THEN instr(memo, 'Karachi') + 6 ELSE instr(memo, account_holder) - 1 + length(account_holder) END AS int) AS gold_end
FROM txn WHERE k % 10 IN (4, 5, 6, 8)
"""
# Predictions stand in for model output: shifted, split, doubled or dropped gold.
PRED_SQL = """
SELECT k, CASE WHEN k % 19 = 0 THEN 'ADDRESS' ELSE entity_type END AS entity_type, cast(greatest(0, gold_start + k % 5 - 2) AS int) AS span_start,
  cast(gold_end - k % 4 AS int) AS span_end, 0.55 + (k % 45) / 100.0 AS score FROM gold WHERE k % 11 <> 0
UNION ALL SELECT k, entity_type, gold_start, cast(gold_start + 3 AS int), 0.60 + (k % 40) / 100.0 FROM gold WHERE k % 7 = 0
UNION ALL SELECT k, 'PERSON_NAME', cast(gold_start + 4 AS int), cast(gold_end + 3 AS int), 0.90 FROM gold WHERE k % 6 = 0
UNION ALL SELECT k, 'PERSON_NAME', 0, 4, 0.57 FROM txn WHERE k % 30 = 9
"""

_GP = f", gold AS ({GOLD_SQL}), pred AS ({PRED_SQL})"
_POS = """
, gold_pos AS (SELECT k, text, unnest(range(gold_start, gold_end)) AS p FROM gold),
pred_pos AS (SELECT DISTINCT k, unnest(range(span_start, span_end)) AS p FROM pred)
"""
_CASES = """
, cov AS (SELECT gold_pos.k, count(pred_pos.p) AS chars FROM gold_pos LEFT JOIN pred_pos ON gold_pos.k = pred_pos.k AND gold_pos.p = pred_pos.p GROUP BY 1),
c AS (SELECT g.k, g.entity_type, style, band, city, cov.chars / (gold_end - gold_start) AS coverage,
    (SELECT count(*) FROM pred WHERE pred.k = g.k) AS n_pred,
    EXISTS (SELECT 1 FROM pred WHERE pred.k = g.k AND gold_start < span_end AND span_start < gold_end)::int AS hit,
    EXISTS (SELECT 1 FROM pred WHERE pred.k = g.k AND gold_start = span_start AND span_end = gold_end)::int AS exact
  FROM gold g JOIN cov ON g.k = cov.k)
"""


def with_gold(sql: str) -> str:
    return with_txn(f"{_GP} {sql}")


def with_positions(sql: str) -> str:
    return with_txn(f"{_GP} {_POS} {sql}")


def with_cases(sql: str) -> str:
    return with_txn(f"{_GP} {_POS} {_CASES} {sql}")


# The predictions of PRED_SQL, made in one scan: condition, type, start, end, score.
_PREDICTIONS = [
    ("is_gold AND k % 11 <> 0", "CASE WHEN k % 19 = 0 THEN 'ADDRESS' ELSE entity_type END",
     "greatest(0, gold_start + k % 5 - 2)", "gold_end - k % 4", "0.55 + (k % 45) / 100.0"),
    ("is_gold AND k % 7 = 0", "entity_type", "gold_start", "gold_start + 3", "0.60 + (k % 40) / 100.0"),
    ("is_gold AND k % 6 = 0", "'PERSON_NAME'", "gold_start + 4", "gold_end + 3", "0.90"),
    ("k % 30 = 9", "'PERSON_NAME'", "0", "4", "0.57"),
]


def _gold_pred(spark, sf_dir):
    rows = txn(spark, sf_dir)
    where = "k % 10 IN (4, 5, 6, 8)"
    gold = spark.sql(GOLD_SQL.replace("FROM txn", "FROM {txn}"), txn=rows)
    places = spark.sql(GOLD_SQL.replace("FROM txn", "FROM {txn}").replace(f"WHERE {where}", ""), txn=rows)
    made = F.array(
        *[
            F.expr(
                f"CASE WHEN {cond} THEN named_struct('entity_type', {kind}, 'span_start', cast({s} AS int), "
                f"'span_end', cast({e} AS int), 'score', cast({score} AS double)) END"
            )
            for cond, kind, s, e, score in _PREDICTIONS
        ]
    )
    pred = places.withColumn("is_gold", F.expr(where)).select("k", F.explode(made).alias("p"))
    return gold, pred.where("p IS NOT NULL").select("k", "p.*")


def _cases(spark, sf_dir):
    gold, pred = _gold_pred(spark, sf_dir)
    return ev.evaluate(gold, pred)


@query(
    "char_coverage",
    with_cases("SELECT k, n_pred, hit, exact, round(coverage, 6)::double AS coverage FROM c"),
)
def char_coverage(spark, sf_dir):
    """Per case: coverage by the union of predictions, exact and any hit, predictions."""
    return _cases(spark, sf_dir).select("k", "n_pred", "hit", "exact", r6("coverage").alias("coverage"))


@query(
    "gold_vs_pred_overlap",
    with_gold(
        """
        SELECT g.k, span_start, span_end, greatest(span_start, gold_start) AS s, least(span_end, gold_end) AS e
        FROM gold g JOIN pred p ON g.k = p.k AND gold_start < span_end AND span_start < gold_end
        """
    ),
)
def gold_vs_pred(spark, sf_dir):
    gold, pred = _gold_pred(spark, sf_dir)
    return ev.clip_to_gold(gold, pred, "k").select("k", "span_start", "span_end", "s", "e")


_METRICS = """
count(*) AS n, round(avg(exact), 6)::double AS exact_rate, round(avg(hit), 6)::double AS hit_rate, round(avg(coverage), 6)::double AS coverage,
round(avg(n_pred), 6)::double AS preds_per_case, round(avg((coverage >= 1)::int), 6)::double AS complete_rate
"""
_RATES = ["exact_rate", "hit_rate", "coverage", "preds_per_case", "complete_rate"]


def _rounded(df, columns):
    return df.withColumns({c: r6(c) for c in columns})


@query(
    "eval_cube",
    with_cases(
        f"""
        SELECT entity_type, CASE WHEN grouping(style) = 1 THEN 'ALL' ELSE style END AS style,
          CASE WHEN grouping(band) = 1 THEN 'ALL' ELSE band END AS band, {_METRICS}
        FROM c GROUP BY GROUPING SETS ((entity_type, style, band), (entity_type, style), (entity_type, band), (entity_type))
        """
    ),
)
def eval_cube(spark, sf_dir):
    return _rounded(ev.eval_cube(_cases(spark, sf_dir)), _RATES)


@query(
    "exact_any_complete",
    with_cases(f"SELECT entity_type, {_METRICS} FROM c GROUP BY 1"),
)
def exact_any(spark, sf_dir):
    out = _cases(spark, sf_dir).groupBy("entity_type").agg(*ev.case_metrics())
    return _rounded(out, _RATES)


@query(
    "eval_grouping_sets",
    with_cases(
        """
        SELECT CASE WHEN grouping(style) = 0 THEN 'style' WHEN grouping(city) = 0 AND grouping(band) = 0 THEN 'band/city'
            WHEN grouping(band) = 0 THEN 'band' WHEN grouping(city) = 0 THEN 'city' ELSE 'ALL' END AS dimension,
          CASE WHEN grouping(style) = 0 THEN style WHEN grouping(city) = 0 AND grouping(band) = 0 THEN band || '/' || city
            WHEN grouping(band) = 0 THEN band WHEN grouping(city) = 0 THEN city ELSE 'ALL' END AS value,
          count(*) AS n, round(avg(coverage), 6)::double AS coverage, round(avg(hit), 6)::double AS hit_rate
        FROM c GROUP BY GROUPING SETS ((), (style), (band), (city), (band, city))
        """
    ),
)
def eval_sets(spark, sf_dir):
    out = ev.eval_sets(_cases(spark, sf_dir), ["style", "band", "city"])
    return _rounded(out, ["coverage", "hit_rate"])


def _negatives(spark, sf_dir):
    """Field values and memos without a name or address, by field and channel."""
    rows = txn(spark, sf_dir).where("k % 10 NOT IN (4, 5, 6, 8) AND memo <> ''")
    return rows.select(
        "k",
        F.when(F.col("k") % 10 == 7, "refund").otherwise("bill").alias("category"),
        F.col("channel").alias("subkey"),
        F.length("memo").alias("n_chars"),
    )


@query(
    "eval_rollup",
    with_gold(
        """
        , neg AS (SELECT k, CASE WHEN k % 10 = 7 THEN 'refund' ELSE 'bill' END AS category, channel AS subkey, length(memo) AS n_chars
            FROM txn WHERE k % 10 NOT IN (4, 5, 6, 8) AND memo <> ''),
        red AS (SELECT k, count(DISTINCT p) AS masked FROM (SELECT k, unnest(range(span_start, span_end)) AS p FROM pred) GROUP BY 1)
        SELECT category, CASE WHEN grouping(subkey) = 1 THEN 'ALL' ELSE subkey END AS subkey, count(*) AS n,
          round(count(masked) / count(*), 6)::double AS fire_rate, sum(n_chars)::bigint AS chars, coalesce(sum(masked), 0)::bigint AS redacted_chars,
          round(coalesce(sum(masked), 0) / sum(n_chars), 6)::double AS over_redaction
        FROM neg LEFT JOIN red USING (k) GROUP BY GROUPING SETS ((category, subkey), (category))
        """
    ),
)
def over_redaction(spark, sf_dir):
    """Over-redaction on texts that hold nothing, by category with a rollup."""
    _, pred = _gold_pred(spark, sf_dir)
    out = ev.over_redaction(_negatives(spark, sf_dir), pred)
    return _rounded(out, ["fire_rate", "over_redaction"])


_MEASURES = """
, cases AS (SELECT txn.k, CASE WHEN txn.k % 10 IN (4, 5, 6, 8) THEN 'positive' ELSE 'negative' END AS kind,
    CASE txn.k % 10 WHEN 8 THEN 'address' WHEN 7 THEN 'refund' WHEN 9 THEN 'bill' ELSE 'person' END AS grp, length(memo) AS n_chars FROM txn WHERE memo <> ''),
pp AS (SELECT DISTINCT k, entity_type, p FROM (SELECT pred.k, entity_type, unnest(range(span_start, least(span_end, n_chars))) AS p FROM pred JOIN cases ON pred.k = cases.k)),
u AS (SELECT DISTINCT k, p FROM pp),
gp AS (SELECT k, unnest(range(gold_start, gold_end)) AS p FROM gold),
s AS (SELECT cases.*, (SELECT count(*) FROM u WHERE u.k = cases.k) AS masked,
    (SELECT count(*) FROM gp WHERE gp.k = cases.k) AS gold_n,
    (SELECT count(*) FROM u JOIN gp ON u.k = gp.k AND u.p = gp.p WHERE u.k = cases.k) AS inside,
    (SELECT count(*) FROM pp a JOIN pp b ON a.k = b.k AND a.p = b.p AND a.entity_type = 'PERSON_NAME' AND b.entity_type = 'ADDRESS' WHERE a.k = cases.k) AS both_n
  FROM cases),
rows AS (SELECT k, kind, grp, n_chars, masked, masked / n_chars AS masked_frac, (masked - inside) / n_chars AS surplus_frac,
    CASE WHEN gold_n > 0 THEN inside / gold_n END AS gold_covered_frac, CASE WHEN masked > 0 THEN both_n / masked ELSE 0 END AS conflict_frac FROM s)
"""


def with_measures(sql: str) -> str:
    return with_gold(f"{_MEASURES} {sql}")


def _measures(spark, sf_dir):
    gold, pred = _gold_pred(spark, sf_dir)
    k = F.col("k") % 10
    cases = txn(spark, sf_dir).where("memo <> ''").select(
        "k",
        F.when(k.isin(4, 5, 6, 8), "positive").otherwise("negative").alias("kind"),
        F.when(k == 8, "address").when(k == 7, "refund").when(k == 9, "bill").otherwise("person").alias("grp"),
        F.length("memo").alias("n_chars"),
    )
    return ev.span_measures(cases, gold, pred)


_FRACS = ["masked_frac", "surplus_frac", "gold_covered_frac", "conflict_frac"]


@query(
    "span_measures",
    with_measures(
        """
        SELECT k, kind, grp, masked, round(masked_frac, 6)::double AS masked_frac, round(surplus_frac, 6)::double AS surplus_frac,
          round(gold_covered_frac, 6)::double AS gold_covered_frac, round(conflict_frac, 6)::double AS conflict_frac FROM rows
        """
    ),
)
def span_measures(spark, sf_dir):
    """Masked, surplus, gold-covered and type-conflict shares per text."""
    return _rounded(_measures(spark, sf_dir), _FRACS).drop("n_chars")


@query(
    "distribution_table",
    with_measures(
        """
        , l AS (SELECT kind, grp, list_sort(list(round(masked_frac, 6)::double)) AS v, count(*) AS n, avg(masked_frac) AS mean, max(masked_frac) AS mx,
            avg((masked = 0)::int) AS untouched FROM rows GROUP BY ALL)
        SELECT kind, grp, n, v[1 + least(n - 1, floor(0.5 * n)::bigint)] AS p50, v[1 + least(n - 1, floor(0.9 * n)::bigint)] AS p90,
          round(mean, 6)::double AS mean, round(mx, 6)::double AS "max", round(untouched, 6)::double AS untouched FROM l
        """
    ),
)
def distribution_table(spark, sf_dir):
    out = ev.distribution_table(_measures(spark, sf_dir), "masked_frac", ["kind", "grp"])
    return _rounded(out, ["p50", "p90", "mean", "max", "untouched"])


@query(
    "type_conflict",
    with_measures(
        """
        SELECT kind, grp, count(*) AS n, round(avg((both_n > 0)::int), 6)::double AS any_conflict,
          round(avg(CASE WHEN masked > 0 THEN both_n / masked ELSE 0 END), 6)::double AS mean_conflict FROM s GROUP BY ALL
        """
    ),
)
def type_conflict(spark, sf_dir):
    out = ev.conflict_table(_measures(spark, sf_dir), ["kind", "grp"])
    return _rounded(out, ["any_conflict", "mean_conflict"])


_SWEEP = """
SELECT lvl AS {name}, count(*) FILTER (kind = 'positive' AND {flag}) AS flagged_pos, count(*) FILTER (kind = 'negative' AND {flag}) AS flagged_neg,
  round(count(*) FILTER ({flag}) / count(*), 6)::double AS flagged_share,
  round(coalesce(count(*) FILTER (kind = 'negative' AND {flag}) / nullif(count(*) FILTER (kind = 'negative' AND masked > 0), 0), 0), 6)::double AS damage_caught,
  round(coalesce(count(*) FILTER (kind = 'negative' AND {flag}) / nullif(count(*) FILTER ({flag}), 0), 0), 6)::double AS queue_yield
FROM rows, (SELECT unnest([{levels}])::double AS lvl) GROUP BY lvl
"""
_SHARES = ["flagged_share", "damage_caught", "queue_yield"]


@query(
    "boundary_sweep",
    with_measures(
        _SWEEP.format(name="boundary", flag="masked_frac >= lvl", levels=", ".join(map(str, ev.BOUNDARIES)))
    ),
)
def boundary_sweep(spark, sf_dir):
    return _rounded(ev.boundary_sweep(_measures(spark, sf_dir)), _SHARES)


@query(
    "combined_rule_sweep",
    with_measures(
        _SWEEP.format(
            name="conflict_level",
            flag="(masked_frac >= 1 OR conflict_frac >= lvl)",
            levels=", ".join(map(str, ev.CONFLICT_LEVELS)),
        )
    ),
)
def combined_rule_sweep(spark, sf_dir):
    return _rounded(ev.combined_rule_sweep(_measures(spark, sf_dir)), _SHARES)


@query(
    "worst_offenders",
    with_measures(
        """
        SELECT k, kind, round(masked_frac, 6)::double AS masked_frac, round(surplus_frac, 6)::double AS surplus_frac FROM
          (SELECT * FROM rows WHERE kind = 'negative' AND masked > 0 ORDER BY masked_frac DESC, k LIMIT 10)
        UNION ALL SELECT k, kind, round(masked_frac, 6)::double, round(surplus_frac, 6)::double FROM
          (SELECT * FROM rows WHERE kind = 'positive' AND surplus_frac > 0 ORDER BY surplus_frac DESC, k LIMIT 10)
        """
    ),
)
def worst_offenders(spark, sf_dir):
    out = ev.worst_offenders(_measures(spark, sf_dir), 10)
    return _rounded(out, ["masked_frac", "surplus_frac"])


_RESIDUAL = r"""
, flagged AS (SELECT g.k, g.p, regexp_matches(substr(text, g.p + 1, 1), '[\p{L}\p{N}]') AS ident, pred_pos.p IS NOT NULL AS cov
    FROM gold_pos g LEFT JOIN pred_pos ON g.k = pred_pos.k AND g.p = pred_pos.p),
edges AS (SELECT k, min(p) FILTER (cov) AS lo, max(p) FILTER (cov) AS hi FROM flagged GROUP BY 1),
res AS (SELECT f.k, count(*) AS gold_chars, count(*) FILTER (ident) AS gold_ident, count(*) FILTER (cov) AS covered_chars,
    count(*) FILTER (cov AND ident) AS covered_ident, count(*) FILTER (ident AND NOT cov AND p < lo) AS "leading",
    count(*) FILTER (ident AND NOT cov AND p > hi) AS "trailing", count(*) FILTER (ident AND NOT cov AND p > lo AND p < hi) AS interior,
    count(*) FILTER (ident AND NOT cov AND lo IS NULL) AS not_found, count(*) FILTER (NOT ident AND NOT cov) AS separators_missed,
    (NOT bool_or(cov))::int AS no_hit, bool_and(cov OR NOT ident)::int AS perfect
  FROM flagged f JOIN edges ON f.k = edges.k GROUP BY f.k)
"""


def with_residual(sql: str) -> str:
    return with_positions(f"{_RESIDUAL} {sql}")


def _residual(spark, sf_dir):
    gold, pred = _gold_pred(spark, sf_dir)
    return ev.residual(gold.drop("text"), pred, gold.select("k", "text"))


_PARTS = "gold_chars, gold_ident, covered_chars, covered_ident, leading, trailing, interior, not_found, separators_missed, no_hit, perfect"


@query("residual_position", with_residual("SELECT * FROM res"))
def residual_position(spark, sf_dir):
    out = _residual(spark, sf_dir)
    return out.select("k", *_PARTS.split(", "))


@query(
    "identifying_coverage",
    with_residual(
        """
        SELECT style, band, sum(covered_ident)::bigint AS covered_ident, sum(gold_ident)::bigint AS gold_ident,
          round(sum(covered_ident) / sum(gold_ident), 6)::double AS effective_coverage, round(sum(covered_chars) / sum(gold_chars), 6)::double AS raw_coverage,
          round((sum("leading") + sum("trailing")) / (sum(gold_ident) - sum(covered_ident)), 6)::double AS extension_ceiling
        FROM res JOIN gold USING (k) GROUP BY ALL
        """
    ),
)
def identifying_coverage(spark, sf_dir):
    out = ev.residual_summary(_residual(spark, sf_dir), ["style", "band"])
    rates = ["effective_coverage", "raw_coverage", "extension_ceiling"]
    return _rounded(out, rates).select("style", "band", "covered_ident", "gold_ident", *rates)


@query(
    "weakest_cells",
    with_residual(
        """
        SELECT city, band, count(*) AS n, round(sum(covered_chars) / sum(gold_chars), 6)::double AS raw_coverage,
          round(sum(covered_ident) / sum(gold_ident), 6)::double AS effective_coverage,
          coalesce(round(sum("leading") / nullif(sum(gold_ident) - sum(covered_ident), 0), 6), 0)::double AS "leading",
          coalesce(round(sum(interior) / nullif(sum(gold_ident) - sum(covered_ident), 0), 6), 0)::double AS interior
        FROM res JOIN gold USING (k) GROUP BY ALL
        """
    ),
)
def weakest_cells(spark, sf_dir):
    out = ev.weakest_cells(_residual(spark, sf_dir), ["city", "band"])
    return _rounded(out, ["raw_coverage", "effective_coverage", "leading", "interior"])


_ARMS = """
, base AS (SELECT k, span_start AS s, span_end AS e FROM pred WHERE entity_type = 'PERSON_NAME'),
other AS (SELECT k, greatest(0, span_start - 2) AS s, span_end AS e FROM pred),
intended AS (SELECT k, gold_start AS s, gold_end AS e FROM gold)
"""


def _arms(spark, sf_dir):
    gold, pred = _gold_pred(spark, sf_dir)
    base = pred.where("entity_type = 'PERSON_NAME'").selectExpr("k", "span_start AS s", "span_end AS e")
    other = pred.selectExpr("k", "greatest(0, span_start - 2) AS s", "span_end AS e")
    intended = gold.selectExpr("k", "gold_start AS s", "gold_end AS e")
    texts = txn(spark, sf_dir).where("memo <> ''").select("k", F.length("memo").alias("n_chars"))
    return texts, base, other, intended


@query(
    "incremental_damage",
    with_gold(
        f"""{_ARMS}
        , extra AS (SELECT k, count(*) AS n FROM (
            SELECT DISTINCT k, unnest(range(s, e)) AS p FROM other
            EXCEPT SELECT k, unnest(range(s, e)) FROM base EXCEPT SELECT k, unnest(range(s, e)) FROM intended) GROUP BY 1),
        t AS (SELECT k, length(memo) AS n_chars FROM txn WHERE memo <> '')
        SELECT count(*) AS texts, count(n) AS texts_changed, coalesce(sum(n), 0)::bigint AS new_chars,
          round(coalesce(sum(n), 0) / sum(n_chars), 6)::double AS new_share FROM t LEFT JOIN extra USING (k)
        """
    ),
)
def incremental_damage(spark, sf_dir):
    return _rounded(ev.arm_damage(*_arms(spark, sf_dir)), ["new_share"])


@query(
    "arm_comparison",
    with_gold(
        f"""{_ARMS}
        , arms AS (SELECT 'base' AS arm, * FROM base UNION ALL SELECT 'other', * FROM other),
        pos AS (SELECT DISTINCT arm, k, unnest(range(s, e)) AS p FROM arms),
        ok AS (SELECT k, unnest(range(s, e)) AS p FROM intended),
        t AS (SELECT count(*) AS n, sum(length(memo)) AS chars FROM txn WHERE memo <> '')
        SELECT arm, round(count(DISTINCT pos.k) / (SELECT n FROM t), 6)::double AS fire_rate, count(*) AS masked,
          count(*) FILTER (ok.p IS NULL) AS surplus, round(count(*) FILTER (ok.p IS NULL) / (SELECT chars FROM t), 6)::double AS over_redaction
        FROM pos LEFT JOIN ok ON pos.k = ok.k AND pos.p = ok.p GROUP BY arm
        """
    ),
)
def arm_comparison(spark, sf_dir):
    texts, base, other, intended = _arms(spark, sf_dir)
    arms = base.withColumn("arm", F.lit("base")).unionByName(other.withColumn("arm", F.lit("other")))
    return _rounded(ev.arm_comparison(texts, arms, intended), ["fire_rate", "over_redaction"])


_BANDS = "CASE " + " ".join(
    f"WHEN round(score, 2) >= {lo} AND round(score, 2) < {hi} THEN '{lo:.2f}-{hi:.2f}'" for lo, hi in ev.SCORE_BANDS
) + " ELSE 'other' END"


@query(
    "precision_by_band",
    with_gold(
        f"""
        , good AS (SELECT k, p FROM (SELECT k, text, unnest(range(gold_start, gold_end)) AS p FROM gold)
            WHERE regexp_matches(substr(text, p + 1, 1), '[A-Za-z0-9]')),
        spans AS (SELECT row_number() OVER () AS id, * FROM pred)
        SELECT {_BANDS} AS band, count(*) AS n, round(avg((EXISTS (SELECT 1 FROM good WHERE good.k = spans.k AND good.p >= span_start AND good.p < span_end))::int), 6)::double AS precision
        FROM spans GROUP BY 1
        """
    ),
)
def precision_by_band(spark, sf_dir):
    gold, pred = _gold_pred(spark, sf_dir)
    texts = txn(spark, sf_dir).select("k", F.col("memo").alias("text"))
    scored = pred.withColumn("score", F.round("score", 2))
    return _rounded(ev.precision_by_band(scored, gold, texts), ["precision"])


_LEAKS = """
, rules AS (SELECT k, s AS span_start, e AS span_end FROM rule_f WHERE field = 'memo'),
hidden AS (SELECT k, unnest(range(span_start, span_end)) AS p FROM pred UNION SELECT k, unnest(range(span_start, span_end)) FROM rules),
lost AS (SELECT g.k, count(*) AS leaked FROM (SELECT k, text, unnest(range(gold_start, gold_end)) AS p FROM gold) g
    LEFT JOIN hidden ON g.k = hidden.k AND g.p = hidden.p WHERE hidden.p IS NULL AND regexp_matches(substr(text, g.p + 1, 1), '[A-Za-z0-9]') GROUP BY 1),
low AS (SELECT k, min(score) AS min_score, count(*) AS n_spans FROM pred GROUP BY 1),
leaks AS (SELECT txn.k, coalesce(leaked, 0)::bigint AS leaked, round(min_score, 6)::double AS min_score, coalesce(n_spans, 0) AS n_spans
    FROM txn LEFT JOIN lost USING (k) LEFT JOIN low USING (k) WHERE memo <> '')
"""


def with_leaks(sql: str) -> str:
    return with_gold(f"{_LEAKS} {sql}")


def _leaks(spark, sf_dir):
    from redactstream.functions.rules import detect_rules
    from redactstream.functions.spans import once

    gold, pred = _gold_pred(spark, sf_dir)
    texts = txn(spark, sf_dir).where("memo <> ''").select("k", F.col("memo").alias("text"))
    found = texts.select("k", once(detect_rules(F.col("text"), F.lit("memo"))).alias("f"))
    rules = found.select("k", F.explode("f").alias("f")).select("k", "f.span_start", "f.span_end")
    return _rounded(ev.leaks(texts, gold, pred, rules), ["min_score"])


@query("leaks", with_leaks("SELECT k, leaked, min_score, n_spans FROM leaks"))
def leaks(spark, sf_dir):
    """Identifying characters that survive both tiers, per text."""
    return _leaks(spark, sf_dir)


@query(
    "leak_rate",
    with_leaks(
        """
        SELECT count(*) AS records, count(*) FILTER (leaked > 0) AS leaking, round(avg((leaked > 0)::int), 6)::double AS leak_rate,
          count(*) FILTER (leaked > 0 AND n_spans = 0) AS leaking_without_span FROM leaks
        """
    ),
)
def leak_rate(spark, sf_dir):
    return _rounded(ev.leak_rate(_leaks(spark, sf_dir)), ["leak_rate"])


@query(
    "escalation_sweep",
    with_leaks(
        f"""
        SELECT t AS threshold, round(count(*) FILTER (leaked > 0 AND min_score < t) / count(*) FILTER (leaked > 0), 6)::double AS leak_recall,
          round(count(*) FILTER (min_score < t) / count(*), 6)::double AS escalated_share,
          CASE WHEN count(*) FILTER (min_score < t) / count(*) <= 0.02 THEN 'ok' ELSE 'too many' END AS verdict
        FROM leaks, (SELECT unnest([{", ".join(map(str, ev.ESCALATION_THRESHOLDS))}])::double AS t) GROUP BY t
        """
    ),
)
def escalation_sweep(spark, sf_dir):
    return _rounded(ev.escalation_sweep(_leaks(spark, sf_dir)), ["leak_recall", "escalated_share"])


_THRESHOLDS = (0.56, 0.655, 0.755, 0.855)


@query(
    "threshold_recalibration",
    with_gold(
        f"""
        , t AS (SELECT unnest([{", ".join(map(str, _THRESHOLDS))}])::double AS threshold),
        kept AS (SELECT pred.*, threshold FROM pred, t WHERE score >= threshold),
        pos AS (SELECT DISTINCT k, threshold, unnest(range(span_start, span_end)) AS p FROM kept),
        cov AS (SELECT gold.k, threshold, count(*) AS chars FROM pos JOIN gold ON pos.k = gold.k AND p >= gold_start AND p < gold_end GROUP BY ALL),
        cnt AS (SELECT k, threshold, count(*) AS n_pred FROM kept GROUP BY ALL)
        SELECT entity_type, t.threshold, count(*) AS n, round(avg(coalesce(chars, 0) / (gold_end - gold_start)), 6)::double AS coverage,
          round(avg(coalesce(n_pred, 0)), 6)::double AS preds_per_case
        FROM gold CROSS JOIN t LEFT JOIN cov ON cov.k = gold.k AND cov.threshold = t.threshold
        LEFT JOIN cnt ON cnt.k = gold.k AND cnt.threshold = t.threshold GROUP BY ALL
        """
    ),
)
def recalibrate(spark, sf_dir):
    gold, pred = _gold_pred(spark, sf_dir)
    return _rounded(ev.recalibrate(gold, pred, _THRESHOLDS), ["coverage", "preds_per_case"])


# Sentence frames of the evaluation cases.
FRAMES = (
    ("english", "For the savings of {x}"),
    ("english", "Deposit by {x}, call 03001234567"),
    ("codeswitch", "Yeh amount {x} wale account mein"),
    ("roman_urdu", "{x} tak pohancha do"),
)


@query(
    "cases_cross",
    with_txn(
        """
        SELECT k, style, replace(t, '{x}', account_holder) AS text, (instr(t, '{x}') - 1)::int AS gold_start,
          (instr(t, '{x}') - 1 + length(account_holder))::int AS gold_end
        FROM txn, (VALUES %s) AS f(style, t)
        """
        % ", ".join(f"('{s}', '{t}')" for s, t in FRAMES)
    ),
)
def cases_cross(spark, sf_dir):
    """Every name in every sentence frame with exact gold offsets; no cross join."""
    names = txn(spark, sf_dir).select("k", "account_holder")
    return ev.cases_from_templates(names, FRAMES, "account_holder").drop("account_holder")


@query(
    "recall_detection_vs_validation",
    with_fields(
        """
        , want AS (SELECT k, field, entity_type, confidence FROM rule_f WHERE field NOT IN ('memo', 'account_holder'))
        SELECT entity_type, count(*) AS expected, 1.0::double AS detected_recall,
          round(count(*) FILTER (confidence = 1) / count(*), 6)::double AS validated_recall FROM want GROUP BY 1
        """
    ),
)
def detection_vs_validation(spark, sf_dir):
    from redactstream.functions.rules import detect_rules
    from redactstream.functions.spans import once

    kinds = F.create_map(
        *[F.lit(x) for p in (("cnic", "CNIC"), ("iban_from", "IBAN_PK"), ("iban_to", "IBAN_PK"),
                             ("phone", "PHONE_PK"), ("email", "EMAIL")) for x in p]
    )
    rows = txn_fields(spark, sf_dir).withColumn("entity_type", F.try_element_at(kinds, F.col("field")))
    rows = rows.where("entity_type IS NOT NULL").withColumn(
        "f", once(detect_rules(F.col("value"), F.col("field")))
    )
    same = F.filter("f", lambda x: x["entity_type"] == F.col("entity_type"))
    found = rows.select(
        "entity_type",
        F.lit(True).alias("expected"),
        (F.size(same) > 0).alias("detected"),
        F.exists(same, lambda x: x["confidence"] >= 1.0).alias("validated"),
    )
    return _rounded(ev.detection_and_validation(found), ["detected_recall", "validated_recall"])


@query(
    "union_arms",
    with_gold(
        """
        , runs AS (SELECT 'a' AS run, 1 AS seq, k, span_start FROM pred WHERE k % 2 = 0 UNION ALL SELECT 'b', 2, k, span_start FROM pred
          UNION ALL SELECT 'a', 3, k, span_start FROM pred WHERE k % 3 = 0)
        SELECT run, k, span_start FROM runs WHERE seq IN (2, 3)
        """
    ),
)
def union_arms(spark, sf_dir):
    """Results of several runs; a later run of the same name replaces the earlier one."""
    _, pred = _gold_pred(spark, sf_dir)
    rows = pred.select("k", "span_start")

    def run(df, name, seq):
        return df.withColumns({"run": F.lit(name), "seq": F.lit(seq)})

    runs = (
        run(rows.where("k % 2 = 0"), "a", 1)
        .unionByName(run(rows, "b", 2))
        .unionByName(run(rows.where("k % 3 = 0"), "a", 3))
    )
    latest = runs.groupBy("run").agg(F.max("seq").alias("seq"))
    return runs.join(latest, ["run", "seq"]).drop("seq")


@query(
    "position_sets",
    with_gold(
        """
        , g AS (SELECT k, unnest(range(gold_start, gold_end)) AS p FROM gold),
        q AS (SELECT DISTINCT k, unnest(range(span_start, span_end)) AS p FROM pred WHERE k IN (SELECT k FROM gold))
        SELECT coalesce(g.k, q.k) AS k, count(*) AS n_union, count(*) FILTER (g.p IS NOT NULL AND q.p IS NOT NULL) AS n_both,
          count(*) FILTER (g.p IS NULL) AS n_pred_only, count(*) FILTER (q.p IS NULL) AS n_gold_only
        FROM g FULL JOIN q ON g.k = q.k AND g.p = q.p GROUP BY 1
        """
    ),
)
def position_sets(spark, sf_dir):
    """Union, intersection and differences of character positions, as interval lengths."""
    gold, pred = _gold_pred(spark, sf_dir)
    cases = gold.select("k")
    both = gold.selectExpr("k", "gold_start AS s", "gold_end AS e", "true AS g").unionByName(
        pred.join(cases, "k", "left_semi").selectExpr("k", "span_start AS s", "span_end AS e", "false AS g")
    )
    n = ev.covered(both, ["k"], {"u": F.lit(True), "g": F.col("g"), "p": ~F.col("g")})
    return n.select(
        "k",
        F.col("u").alias("n_union"),
        (F.col("g") + F.col("p") - F.col("u")).alias("n_both"),
        (F.col("u") - F.col("g")).alias("n_pred_only"),
        (F.col("u") - F.col("p")).alias("n_gold_only"),
    )
