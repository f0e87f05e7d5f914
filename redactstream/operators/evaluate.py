"""Detection-quality metrics over tables of gold spans and predicted spans.

Everything rests on one measure: how many characters (or identifying characters) of a
text a set of spans covers. Spans that share a start are reduced to the longest before
the shuffle, so the rows of one text are bounded by its length however many predictions
it drew; a running maximum then cuts them into disjoint pieces. Set differences follow by
arithmetic: what is in A but not in B is cover(A and B together) minus cover(B).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactstream.functions.spans import identifying_chars

# Review boundaries, conflict levels, score bands and thresholds published
# figures were computed at.
BOUNDARIES = (0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 1.00)
CONFLICT_LEVELS = (0.01, 0.10, 0.25, 0.50, 1.01)
SCORE_BANDS = ((0.55, 0.65), (0.65, 0.75), (0.75, 0.85), (0.85, 0.95), (0.95, 1.01))
ESCALATION_THRESHOLDS = (0.60, 0.65, 0.70, 0.75, 0.85)
ESCALATION_BUDGET = 0.02


def covered(
    spans: DataFrame,
    keys: Sequence[str],
    groups: Mapping[str, Column],
    text: DataFrame | None = None,
) -> DataFrame:
    """Characters covered by the union of spans, per key and per named subset of spans.

    `spans` has keys, s, e and any columns the subset conditions use. With `text` (keys,
    text) each subset also gets `<name>_ident`, counting identifying characters only.
    """
    keys = list(keys)
    flags = {f"_in_{n}": cond for n, cond in groups.items()}
    tagged = spans.where(F.col("e") > F.col("s")).select(
        *keys, "s", "e", *[c.alias(n) for n, c in flags.items()]
    )
    longest = tagged.groupBy(*keys, "s").agg(
        *[F.max(F.when(F.col(n), F.col("e"))).alias(n) for n in flags]
    )
    before = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    out = longest
    for n in flags:
        reach = F.greatest(F.col("s"), F.coalesce(F.max(n).over(before), F.col("s")))
        out = out.withColumn(f"_from{n}", reach)
    sums = []
    for name, n in zip(groups, flags):
        start, length = F.col(f"_from{n}"), F.greatest(F.lit(0), F.col(n) - F.col(f"_from{n}"))
        sums.append(F.coalesce(F.sum(length), F.lit(0)).alias(name))
        if text is not None:
            piece = F.when(length > 0, F.struct(start.alias("at"), length.alias("n")))
            sums.append(F.collect_list(piece).alias(f"_pieces_{name}"))
    total = out.groupBy(*keys).agg(*sums)
    if text is None:
        return total

    # The text joins once per key, not once per span; its pieces are disjoint, so they are
    # no longer than the text together.
    def ident(name: str) -> Column:
        cut = F.transform(
            f"_pieces_{name}", lambda p: F.substring(F.col("text"), p["at"] + 1, p["n"])
        )
        return identifying_chars(F.array_join(cut, "")).alias(f"{name}_ident")

    return total.join(text, keys).select(*keys, *groups, *[ident(n) for n in groups])


def swept(
    spans: DataFrame,
    cases: DataFrame,
    keys: Sequence[str],
    groups: Mapping[str, Column],
    *,
    clip: tuple[str, str] | None = None,
    text: str | None = None,
    also: Mapping[str, tuple[Column, Callable[[str], Column] | None]] | None = None,
    flags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One sweep over spans and cases: each case with what the spans of its key cover.

    `spans` has keys, s, e and the columns that conditions use; `cases` has one row per key.
    Spans that share a start become one row, the cases join them in a union, and one exchange
    on the key serves the running maximum, the sums and the way back to the case: no joins.

    `groups` names subsets of spans; `clip` names case columns that spans are cut to. With
    `text`, a case column, each subset also gets `<name>_ident`, its identifying characters.
    `also` gives (aggregate over spans, aggregate over its results) per name. `flags` are
    conditions on s, `_reach` (the furthest end at s), `_ends` (all ends at s), `_lo` and `_hi`
    (the clip) that hold for at least one start. Keys without a case are left out.
    """
    keys, also, flags = list(keys), dict(also or {}), dict(flags or {})
    whole = F.col("e") > F.col("s")
    partial = [F.max(F.when(whole & cond, F.col("e"))).alias(f"_in_{n}") for n, cond in groups.items()]
    partial += [first.alias(n) for n, (first, _) in also.items()]
    if flags:
        partial += [F.max("e").alias("_reach"), F.collect_set("e").alias("_ends")]
    starts = spans.groupBy(*keys, "s").agg(*partial)
    named = [c for c in cases.columns if c not in keys]
    bounds = [F.col(c).alias(b) for b, c in zip(("_lo", "_hi"), clip or ())]
    carried = cases.select(*keys, F.struct(*(F.col(c) for c in named)).alias("_case"), *bounds)
    both = starts.unionByName(carried, allowMissingColumns=True)
    # The case stands first, then its spans by start.
    order = Window.partitionBy(*keys).orderBy(F.col("_case").isNull(), "s")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    for b in ("_lo", "_hi") if clip else ():
        both = both.withColumn(b, F.first(b, ignorenulls=True).over(upto))

    def cut(end: Column, bound: str, pick) -> Column:
        return F.when(end.isNotNull(), pick(end, F.col(bound))) if clip else end

    both = both.withColumns({f"_in_{n}": cut(F.col(f"_in_{n}"), "_hi", F.least) for n in groups})
    start = cut(F.col("s"), "_lo", F.greatest)
    both = both.withColumns(
        {f"_from_{n}": F.greatest(start, F.coalesce(F.max(f"_in_{n}").over(before), start)) for n in groups}
    )
    sums = [F.first("_case", ignorenulls=True).alias("_case")]
    for n in groups:
        length = F.greatest(F.lit(0), F.col(f"_in_{n}") - F.col(f"_from_{n}"))
        length = F.when(F.col(f"_in_{n}").isNotNull(), length)
        sums.append(F.coalesce(F.sum(length), F.lit(0)).alias(n))
        if text is not None:
            piece = F.when(length > 0, F.struct(F.col(f"_from_{n}").alias("at"), length.alias("n")))
            sums.append(F.collect_list(piece).alias(f"_pieces_{n}"))
    sums += [last(n).alias(n) for n, (_, last) in also.items()]
    sums += [F.coalesce(F.max(cond), F.lit(False)).alias(n) for n, cond in flags.items()]
    out = both.groupBy(*keys).agg(*sums).where(F.col("_case").isNotNull())

    def ident(name: str) -> Column:
        cuts = F.transform(f"_pieces_{name}", lambda p: F.substring(F.col(f"_case.{text}"), p["at"] + 1, p["n"]))
        return identifying_chars(F.array_join(cuts, "")).alias(f"{name}_ident")

    found = [*groups, *([ident(n) for n in groups] if text is not None else []), *also, *flags]
    return out.select(*keys, *[F.col(f"_case.{c}").alias(c) for c in named], *found)


def clip_to_gold(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Predictions that overlap their case's gold span, cut to it. One gold per case."""
    joined = pred.join(gold.select(key, "gold_start", "gold_end"), key)
    hit = (F.col("gold_start") < F.col("span_end")) & (F.col("span_start") < F.col("gold_end"))
    return joined.where(hit).select(
        key,
        "gold_start",
        "gold_end",
        "span_start",
        "span_end",
        F.greatest("span_start", "gold_start").alias("s"),
        F.least("span_end", "gold_end").alias("e"),
    )


def evaluate(gold: DataFrame, pred: DataFrame, key: str = "k") -> DataFrame:
    """Per case: coverage of the gold span, exact hit, any hit, predictions made."""
    out = swept(
        pred.select(key, F.col("span_start").alias("s"), F.col("span_end").alias("e")),
        gold,
        [key],
        {"chars": F.lit(True)},
        clip=("gold_start", "gold_end"),
        also={"n_pred": (F.count("*"), F.sum)},
        flags={
            "exact": (F.col("s") == F.col("_lo")) & F.array_contains("_ends", F.col("_hi")),
            "hit": (F.col("s") < F.col("_hi")) & (F.col("_reach") > F.col("_lo")),
        },
    )
    length = F.col("gold_end") - F.col("gold_start")
    return out.withColumns(
        {
            "n_pred": F.coalesce("n_pred", F.lit(0)),
            "hit": F.col("hit").cast("int"),
            "exact": F.col("exact").cast("int"),
            "coverage": F.coalesce(F.try_divide("chars", length), F.lit(0.0)),
        }
    ).drop("chars")


def case_metrics() -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.avg("exact").alias("exact_rate"),
        F.avg("hit").alias("hit_rate"),
        F.avg("coverage").alias("coverage"),
        F.avg("n_pred").alias("preds_per_case"),
        F.avg((F.col("coverage") >= 1.0).cast("int")).alias("complete_rate"),
    ]


def eval_cube(cases: DataFrame) -> DataFrame:
    """Metrics by entity type with every combination of style and band, ALL for a total."""
    return (
        cases.groupingSets(
            [
                ["entity_type", "style", "band"],
                ["entity_type", "style"],
                ["entity_type", "band"],
                ["entity_type"],
            ],
            "entity_type",
            "style",
            "band",
        )
        .agg(*case_metrics(), F.grouping("style").alias("gs"), F.grouping("band").alias("gb"))
        .withColumn("style", F.when(F.col("gs") == 1, "ALL").otherwise(F.col("style")))
        .withColumn("band", F.when(F.col("gb") == 1, "ALL").otherwise(F.col("band")))
        .drop("gs", "gb")
    )


def eval_sets(cases: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Metrics over all cases, by each column alone and by the last two together."""
    columns = list(columns)
    sets = [[], *[[c] for c in columns], columns[-2:]]
    marks = [F.grouping(c).alias(f"_g{i}") for i, c in enumerate(columns)]
    grouped = cases.groupingSets(sets, *columns).agg(*case_metrics(), *marks)
    part = [F.when(F.col(f"_g{i}") == 0, F.lit(c)) for i, c in enumerate(columns)]
    value = [F.when(F.col(f"_g{i}") == 0, F.col(c)) for i, c in enumerate(columns)]
    return grouped.select(
        F.coalesce(F.nullif(F.concat_ws("/", *part), F.lit("")), F.lit("ALL")).alias("dimension"),
        F.coalesce(F.nullif(F.concat_ws("/", *value), F.lit("")), F.lit("ALL")).alias("value"),
        "n",
        "coverage",
        "hit_rate",
    )


def over_redaction(negatives: DataFrame, pred: DataFrame, key: str = "k") -> DataFrame:
    """How often and how much detection fires on texts that hold nothing to find.

    `negatives` has key, category, subkey, n_chars. A rollup under a fixed category.
    """
    masked = covered(
        pred.select(key, F.col("span_start").alias("s"), F.col("span_end").alias("e")),
        [key],
        {"masked": F.lit(True)},
    )
    fired = pred.groupBy(key).agg(F.count("*").alias("n_pred"))
    rows = negatives.join(masked, key, "left").join(fired, key, "left")
    return (
        rows.groupingSets([["category", "subkey"], ["category"]], "category", "subkey")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("n_pred") > 0).alias("fired"),
            F.sum("n_chars").alias("chars"),
            F.coalesce(F.sum("masked"), F.lit(0)).alias("redacted_chars"),
            F.grouping("subkey").alias("g"),
        )
        .select(
            "category",
            F.when(F.col("g") == 1, "ALL").otherwise(F.col("subkey")).alias("subkey"),
            "n",
            F.try_divide("fired", "n").alias("fire_rate"),
            "chars",
            "redacted_chars",
            F.coalesce(F.try_divide("redacted_chars", "chars"), F.lit(0.0)).alias("over_redaction"),
        )
    )


def span_measures(cases: DataFrame, gold: DataFrame, pred: DataFrame, key: str = "k") -> DataFrame:
    """Per case: masked, surplus, gold-covered and conflict shares of its text.

    `cases` has key and n_chars. Surplus is what predictions mask outside gold; conflict
    is what they claim both as person and as address, over all they claim.
    """
    tagged = gold.select(
        key, F.col("gold_start").alias("s"), F.col("gold_end").alias("e"), F.lit("G").alias("src"),
        F.lit("").alias("entity_type"),
    ).unionByName(
        pred.select(
            key, F.col("span_start").alias("s"), F.col("span_end").alias("e"), F.lit("P").alias("src"), "entity_type"
        )
    )
    is_pred = F.col("src") == "P"
    rows = swept(
        tagged,
        cases.withColumn("_zero", F.lit(0)),
        [key],
        {
            "gold": ~is_pred,
            "masked": is_pred,
            "either": F.lit(True),
            "person": is_pred & (F.col("entity_type") == "PERSON_NAME"),
            "address": is_pred & (F.col("entity_type") == "ADDRESS"),
            "named": is_pred & F.col("entity_type").isin("PERSON_NAME", "ADDRESS"),
        },
        clip=("_zero", "n_chars"),
    )

    def ratio(num: Column, den: str) -> Column:
        return F.coalesce(F.try_divide(num, F.col(den)), F.lit(0.0))

    surplus = F.col("either") - F.col("gold")
    inside = F.col("gold") + F.col("masked") - F.col("either")
    both = F.col("person") + F.col("address") - F.col("named")
    return rows.select(
        *cases.columns,
        "masked",
        ratio(F.col("masked"), "n_chars").alias("masked_frac"),
        ratio(surplus, "n_chars").alias("surplus_frac"),
        F.try_divide(inside, F.col("gold")).alias("gold_covered_frac"),
        ratio(both, "named").alias("conflict_frac"),
    )


def residual(gold: DataFrame, pred: DataFrame, text: DataFrame, key: str = "k") -> DataFrame:
    """Where the missed identifying characters of each gold span sit.

    Leading and trailing are counted from the outermost covered characters; what neither
    reaches is interior. Without any covered character they are all not found.
    """
    hits = clip_to_gold(gold, pred, key)
    ends = hits.groupBy(key).agg(F.min("s").alias("first"), F.max("e").alias("last"))
    cover = covered(hits, [key], {"covered": F.lit(True)}, text)
    rows = gold.join(text, key).join(ends, key, "left").join(cover, key, "left")

    def ident(s: Column, e: Column) -> Column:
        return identifying_chars(F.substring(F.col("text"), s + 1, e - s))

    none = F.col("first").isNull()
    total = ident(F.col("gold_start"), F.col("gold_end"))
    hit = F.coalesce(F.col("covered_ident"), F.lit(0))
    raw_hit = F.coalesce(F.col("covered"), F.lit(0))
    out = rows.withColumns(
        {
            "gold_chars": F.col("gold_end") - F.col("gold_start"),
            "gold_ident": total,
            "covered_chars": raw_hit,
            "covered_ident": hit,
            "leading": F.when(none, 0).otherwise(ident(F.col("gold_start"), F.col("first"))),
            "trailing": F.when(none, 0).otherwise(ident(F.col("last"), F.col("gold_end"))),
        }
    )
    missed = F.col("gold_ident") - F.col("covered_ident")
    separators = (F.col("gold_chars") - F.col("gold_ident")) - (
        F.col("covered_chars") - F.col("covered_ident")
    )
    return out.select(
        *gold.columns,
        "gold_chars",
        "gold_ident",
        "covered_chars",
        "covered_ident",
        "leading",
        "trailing",
        F.when(none, 0).otherwise(missed - F.col("leading") - F.col("trailing")).alias("interior"),
        F.when(none, missed).otherwise(0).alias("not_found"),
        separators.alias("separators_missed"),
        none.cast("int").alias("no_hit"),
        (missed == 0).cast("int").alias("perfect"),
    )


def residual_summary(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals, effective coverage and the most a rule that widens spans could recover."""
    parts = ["gold_chars", "gold_ident", "covered_chars", "covered_ident", "leading", "trailing",
             "interior", "not_found", "separators_missed", "no_hit", "perfect"]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(p).alias(p) for p in parts])
    missed = F.col("gold_ident") - F.col("covered_ident")
    return sums.withColumns(
        {
            "raw_coverage": F.try_divide("covered_chars", "gold_chars"),
            "effective_coverage": F.try_divide("covered_ident", "gold_ident"),
            "extension_ceiling": F.coalesce(
                F.try_divide(F.col("leading") + F.col("trailing"), missed), F.lit(0.0)
            ),
        }
    )


def weakest_cells(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All cells, weakest first, with their number of cases: small cells are the reader's choice.

    `leading` and `interior` are shares of the identifying characters that were missed.
    """
    missed = F.col("gold_ident") - F.col("covered_ident")
    cells = residual_summary(rows, keys).select(
        *keys,
        "n",
        "raw_coverage",
        "effective_coverage",
        F.coalesce(F.try_divide("leading", missed), F.lit(0.0)).alias("leading"),
        F.coalesce(F.try_divide("interior", missed), F.lit(0.0)).alias("interior"),
    )
    return cells.orderBy("effective_coverage", *keys)


def arm_damage(
    clean: DataFrame, base: DataFrame, other: DataFrame, intended: DataFrame, key: str = "k"
) -> DataFrame:
    """What a second detector setting masks beyond the first and beyond what is intended.

    Each arm has key, s, e. Per text: cover(base, intended, other) - cover(base, intended).
    """
    def arm(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, "s", "e", F.lit(name).alias("arm"))

    allspans = arm(base, "base").unionByName(arm(other, "other")).unionByName(arm(intended, "intended"))
    cover = covered(
        allspans, [key], {"all3": F.lit(True), "known": F.col("arm").isin("base", "intended")}
    )
    per_text = clean.join(cover, key, "left").withColumn(
        "extra", F.coalesce(F.col("all3") - F.col("known"), F.lit(0))
    )
    return per_text.agg(
        F.count("*").alias("texts"),
        F.count_if(F.col("extra") > 0).alias("texts_changed"),
        F.sum("extra").alias("new_chars"),
        F.try_divide(F.sum("extra"), F.sum("n_chars")).alias("new_share"),
    )


def arm_comparison(cases: DataFrame, arms: DataFrame, intended: DataFrame, key: str = "k") -> DataFrame:
    """Several settings over the same texts: texts fired on, masked and surplus characters.

    `arms` has arm, key, s, e. Intended spans are attached to each arm's own texts.
    """
    wanted = intended.select(F.lit(None).cast("string").alias("arm"), key, "s", "e", F.lit(True).alias("_ok"))
    spans = arms.select("arm", key, "s", "e", F.lit(False).alias("_ok")).unionByName(wanted)
    spans = spans.where((F.col("e") > F.col("s")) & (F.col("arm").isNotNull() | F.col("_ok")))
    starts = spans.groupBy("arm", key, "s").agg(F.max("e").alias("e"))
    # Once dealt by text, its intended spans meet the arms that fired there without a join.
    here = F.collect_set("arm").over(Window.partitionBy(key))
    dealt = starts.withColumn("ok", F.col("arm").isNull()).withColumn("_arms", here)
    both = dealt.select(F.explode(F.when(F.col("ok"), F.col("_arms")).otherwise(F.array("arm"))).alias("arm"), key, "s", "e", "ok")
    groups = {"masked": ~F.col("ok"), "either": F.lit(True), "meant": F.col("ok")}
    before = Window.partitionBy(key, "arm").orderBy("s", "ok").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.withColumns({f"_{n}": F.when(c, F.col("e")) for n, c in groups.items()})
    new = {n: F.col(f"_{n}") - F.greatest(F.col("s"), F.coalesce(F.max(f"_{n}").over(before), F.col("s"))) for n in groups}
    cover = ends.withColumns(new).groupBy(key, "arm").agg(
        *[F.coalesce(F.sum(F.greatest(F.lit(0), F.when(F.col(f"_{n}").isNotNull(), F.col(n)))), F.lit(0)).alias(n) for n in groups]
    )
    total = cases.agg(F.struct(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))).scalar()
    texts, chars = total["n"], total["chars"]
    per_arm = cover.groupBy("arm").agg(
        F.count("*").alias("fired"),
        F.sum("masked").alias("masked"),
        F.sum(F.col("either") - F.col("meant")).alias("surplus"),
    )
    return per_arm.select(
        "arm",
        F.try_divide(F.col("fired"), texts).alias("fire_rate"),
        "masked",
        "surplus",
        F.try_divide(F.col("surplus"), chars).alias("over_redaction"),
    )


def distribution_table(rows: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Per group: n, mean, median, ninetieth percentile, maximum, share at zero."""
    from redactstream.operators.stats import index_percentiles

    keys = list(keys)
    base = rows.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
        F.avg((F.col(value) == 0).cast("int")).alias("untouched"),
    )
    return index_percentiles(rows, value, (50, 90), keys, rule="floor").join(base, keys)


def conflict_table(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: how often predictions contradict themselves, and by how much."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg((F.col("conflict_frac") > 0).cast("int")).alias("any_conflict"),
        F.avg("conflict_frac").alias("mean_conflict"),
    )


def _sweep(rows: DataFrame, levels: Sequence[float], flag, name: str) -> DataFrame:
    """One pass for all levels: conditional counts side by side, then unpivoted."""
    pos, neg = F.col("kind") == "positive", F.col("kind") == "negative"
    aggs = [
        F.count_if(pos).alias("n_pos"),
        F.count_if(neg).alias("n_neg"),
        F.count_if(neg & (F.col("masked_frac") > 0)).alias("damaged"),
    ]
    for i, level in enumerate(levels):
        aggs += [
            F.count_if(pos & flag(level)).alias(f"p{i}"),
            F.count_if(neg & flag(level)).alias(f"n{i}"),
        ]
    cells = F.array(
        *[
            F.struct(
                F.lit(float(level)).alias(name),
                F.col(f"p{i}").alias("flagged_pos"),
                F.col(f"n{i}").alias("flagged_neg"),
            )
            for i, level in enumerate(levels)
        ]
    )
    flagged = F.col("flagged_pos") + F.col("flagged_neg")

    def rate(num: Column, den: Column) -> Column:
        return F.coalesce(F.try_divide(num, den), F.lit(0.0))

    return (
        rows.agg(*aggs)
        .select("n_pos", "n_neg", "damaged", F.explode(cells).alias("c"))
        .select("n_pos", "n_neg", "damaged", "c.*")
        .select(
            name,
            "flagged_pos",
            "flagged_neg",
            rate(flagged, F.col("n_pos") + F.col("n_neg")).alias("flagged_share"),
            rate(F.col("flagged_neg"), F.col("damaged")).alias("damage_caught"),
            rate(F.col("flagged_neg"), flagged).alias("queue_yield"),
        )
    )


def boundary_sweep(rows: DataFrame, boundaries: Sequence[float] = BOUNDARIES) -> DataFrame:
    """Flag a text for review when its masked share reaches a boundary."""
    return _sweep(rows, boundaries, lambda b: F.col("masked_frac") >= b, "boundary")


def combined_rule_sweep(rows: DataFrame, levels: Sequence[float] = CONFLICT_LEVELS) -> DataFrame:
    """Flag full saturation, or a conflict share at the level; above 1 is conflict off."""
    full = F.col("masked_frac") >= 1.0
    return _sweep(rows, levels, lambda c: full | (F.col("conflict_frac") >= c), "conflict_level")


def worst_offenders(rows: DataFrame, n: int, key: str = "k") -> DataFrame:
    """The texts that lost most: negatives by masked share, positives by surplus."""
    neg = rows.where((F.col("kind") == "negative") & (F.col("masked_frac") > 0))
    pos = rows.where((F.col("kind") == "positive") & (F.col("surplus_frac") > 0))
    cols = [key, "kind", "masked_frac", "surplus_frac"]
    return (
        neg.orderBy(F.desc("masked_frac"), key).limit(n).select(*cols)
        .unionByName(pos.orderBy(F.desc("surplus_frac"), key).limit(n).select(*cols))
    )


def band_of(score: Column) -> Column:
    out = F.lit("other")
    for low, high in SCORE_BANDS:
        out = F.when((score >= low) & (score < high), f"{low:.2f}-{high:.2f}").otherwise(out)
    return out


def identifying_runs(gold: DataFrame, text: DataFrame, key: str = "k") -> DataFrame:
    """Per key the stretches (s, e) of letters and digits inside the union of gold spans."""
    from redactstream.functions.spans import find_spans, once
    from redactstream.operators.scan import merge_spans_rel

    islands = merge_spans_rel(
        gold.withColumn("_kind", F.lit("g")), [key], "gold_start", "gold_end", "_kind"
    ).where(F.col("e") > F.col("s"))
    # The text joins once per key; islands are disjoint, so they hold it at most once.
    nested = islands.groupBy(key).agg(F.collect_list(F.struct("s", "e")).alias("_islands"))

    def runs(g: Column) -> Column:
        inside = F.substring(F.col("text"), g["s"] + 1, g["e"] - g["s"])
        found = find_spans(inside, r"[\p{L}\p{N}]+")
        return F.transform(found, lambda h: F.struct((g["s"] + h["s"]).alias("s"), (g["s"] + h["e"]).alias("e")))

    found = nested.join(text.select(key, "text"), key)
    found = found.select(key, once(F.flatten(F.transform("_islands", runs))).alias("_runs"))
    return found.select(key, F.explode("_runs").alias("r")).select(key, "r.s", "r.e")


def precision_by_band(pred: DataFrame, gold: DataFrame, text: DataFrame, key: str = "k") -> DataFrame:
    """Per score band: predictions, and the share that holds an identifying gold character.

    A prediction holds one exactly when the furthest end among the identifying runs that start
    before its own end lies behind its start: a running maximum over both, no pairs. Equal
    predictions of a band are counted before they are dealt by text.
    """
    spans = pred.groupBy(key, "span_start", "span_end", band_of(F.col("score")).alias("band")).agg(F.count("*").alias("n"))
    asked = spans.select(
        key, F.col("span_end").alias("at"), F.lit(0).alias("is_run"), F.lit(None).cast("int").alias("e"), "span_start", "band", "n"
    )
    none = F.lit(None)
    known = identifying_runs(gold, text, key).select(
        key, F.col("s").alias("at"), F.lit(1).alias("is_run"), "e",
        none.cast("int").alias("span_start"), none.cast("string").alias("band"), none.cast("long").alias("n"),
    )
    # At one place predictions come first: a run that starts where a prediction ends is outside.
    before = Window.partitionBy(key).orderBy("at", "is_run").rowsBetween(Window.unboundedPreceding, -1)
    met = asked.unionByName(known).withColumn("_reach", F.max("e").over(before)).where("is_run = 0")
    correct = (F.col("_reach") > F.col("span_start")) & (F.col("at") > F.col("span_start"))
    hits = F.sum(F.when(F.coalesce(correct, F.lit(False)), F.col("n")).otherwise(0))
    return met.groupBy("band").agg(F.sum("n").alias("n"), F.try_divide(hits, F.sum("n")).alias("precision"))


def leaks(
    texts: DataFrame, gold: DataFrame, model: DataFrame, rules: DataFrame, key: str = "k"
) -> DataFrame:
    """Per text: identifying gold characters that neither tier masks, and the model's scores."""
    def part(df: DataFrame, s: str, e: str, src: str) -> DataFrame:
        score = F.col("score") if src == "M" else F.lit(None)
        return df.select(
            key, F.col(s).alias("s"), F.col(e).alias("e"), F.lit(src).alias("src"), score.cast("double").alias("score")
        )

    spans = (
        part(gold, "gold_start", "gold_end", "G")
        .unionByName(part(model, "span_start", "span_end", "M"))
        .unionByName(part(rules, "span_start", "span_end", "R"))
    )
    out = swept(
        spans,
        texts.select(key, "text"),
        [key],
        {"all3": F.lit(True), "masked": F.col("src") != "G"},
        text="text",
        also={
            "min_score": (F.min("score"), F.min),
            "n_spans": (F.count_if(F.col("src") == "M"), F.sum),
        },
    )
    leaked = (F.col("all3_ident") - F.col("masked_ident")).alias("leaked")
    return out.select(key, leaked, "min_score", F.coalesce("n_spans", F.lit(0)).alias("n_spans"))


def leak_rate(leak_rows: DataFrame) -> DataFrame:
    leaking = F.col("leaked") > 0
    return leak_rows.agg(
        F.count("*").alias("records"),
        F.count_if(leaking).alias("leaking"),
        F.avg(leaking.cast("int")).alias("leak_rate"),
        F.count_if(leaking & (F.col("n_spans") == 0)).alias("leaking_without_span"),
    )


def escalation_sweep(
    leak_rows: DataFrame, thresholds: Sequence[float] = ESCALATION_THRESHOLDS
) -> DataFrame:
    """Escalate a text when any model score is below a threshold: recall, cost, verdict."""
    leaking = F.col("leaked") > 0
    low = [F.coalesce(F.col("min_score") < t, F.lit(False)) for t in thresholds]
    aggs = [F.count("*").alias("records"), F.count_if(leaking).alias("leaking")]
    aggs += [F.count_if(c).alias(f"e{i}") for i, c in enumerate(low)]
    aggs += [F.count_if(c & leaking).alias(f"l{i}") for i, c in enumerate(low)]
    cells = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.col(f"e{i}").alias("escalated"),
                F.col(f"l{i}").alias("caught"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    share = F.try_divide("escalated", "records")
    return (
        leak_rows.agg(*aggs)
        .select("records", "leaking", F.explode(cells).alias("c"))
        .select("records", "leaking", "c.*")
        .select(
            "threshold",
            F.coalesce(F.try_divide("caught", "leaking"), F.lit(0.0)).alias("leak_recall"),
            share.alias("escalated_share"),
            F.when(share <= ESCALATION_BUDGET, "ok").otherwise("too many").alias("verdict"),
        )
    )


def recalibrate(gold: DataFrame, scored: DataFrame, thresholds: Sequence[float], key: str = "k") -> DataFrame:
    """Coverage and predictions per case at each threshold, from raw scores.

    Every threshold is one subset of the same spans, so all share one pass. Exact for
    unbridged spans: bridging looks at the set that survived the threshold.
    """
    names = [f"t{i}" for i in range(len(thresholds))]
    hits = scored.join(gold.select(key, "gold_start", "gold_end"), key).select(
        key,
        "score",
        F.greatest("span_start", "gold_start").alias("s"),
        F.least("span_end", "gold_end").alias("e"),
    )
    groups = {n: F.col("score") >= t for n, t in zip(names, thresholds)}
    cover = covered(hits, [key], groups)
    counts = scored.groupBy(key).agg(
        *[F.count_if(F.col("score") >= t).alias(f"c{n}") for n, t in zip(names, thresholds)]
    )
    length = F.col("gold_end") - F.col("gold_start")
    rows = gold.join(cover, key, "left").join(counts, key, "left")
    cells = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.coalesce(F.try_divide(F.coalesce(n, F.lit(0)), length), F.lit(0.0)).alias("cov"),
                F.coalesce(f"c{n}", F.lit(0)).alias("n_pred"),
            )
            for n, t in zip(names, thresholds)
        ]
    )
    return (
        rows.select("entity_type", F.explode(cells).alias("c"))
        .groupBy("entity_type", F.col("c.threshold").alias("threshold"))
        .agg(
            F.count("*").alias("n"),
            F.avg("c.cov").alias("coverage"),
            F.avg("c.n_pred").alias("preds_per_case"),
        )
    )


def cases_from_templates(values: DataFrame, templates: Sequence[tuple[str, str]], value: str) -> DataFrame:
    """Every value in every sentence frame, with exact gold offsets.

    Frames are a short parameter list, so each row unfolds in place; nothing is crossed.
    """
    frames = F.array(
        *[F.struct(F.lit(style).alias("style"), F.lit(t).alias("template")) for style, t in templates]
    )
    text = F.replace(F.col("f.template"), F.lit("{x}"), F.col(value))
    rows = values.withColumn("f", F.explode(frames)).withColumn("text", text)
    start = F.position(F.col(value), F.col("text")) - 1
    return rows.select(
        *values.columns,
        "f.style",
        "text",
        start.alias("gold_start"),
        (start + F.length(value)).alias("gold_end"),
    )


def detection_and_validation(found: DataFrame) -> DataFrame:
    """Recall at detection and at validation, reported apart.

    `found` has expected (bool), detected (bool), validated (bool) per case.
    """
    exp = F.col("expected")
    return found.groupBy("entity_type").agg(
        F.count_if(exp).alias("expected"),
        F.try_divide(F.count_if(exp & F.col("detected")), F.count_if(exp)).alias("detected_recall"),
        F.try_divide(F.count_if(exp & F.col("validated")), F.count_if(exp)).alias("validated_recall"),
    )
