"""Corpus jobs: address corpus, label and locale profiles, token statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactstream.functions import address as adr
from redactstream.functions import checksums as chk
from redactstream.operators.skew import SALTS, hot_values

# Shapes counted per locale and labels whose surfaces are sampled.
SHAPES = {
    "iban_shape_any_country": chk.IBAN_ANY_SHAPE,
    "pk_iban_shape": r"\bPK[0-9]{2}[A-Z0-9]{4}[0-9]{16}\b",
    "cnic_canonical_shape": r"\b[0-9]{5}-[0-9]{7}-[0-9]\b",
    "cnic_bare_13digit_shape": r"\b[0-9]{13}\b",
    "pk_phone_prefix": r"\+92|\b03[0-9]{2}",
}
SAMPLES_PER_LABEL = 12
FAILING_SAMPLES = 15


# --------------------------------------------------------------------------- #
# Address corpus
# --------------------------------------------------------------------------- #
def build_corpus(elements: DataFrame, order: Sequence[str] = ("source", "position")) -> DataFrame:
    """One record per distinct address.

    A duplicate with a known building kind beats an unknown one, else the first wins. The
    pick is an aggregate with a map-side partial, so an address mapped a million times
    does not gather in one task.
    """
    tags = adr.address_tags(F.col("tags"))
    rows = (
        elements.withColumn("t", tags)
        .withColumn("address", adr.compose_address(F.col("t")))
        .where(F.coalesce("address", F.lit("")) != "")
    )
    city = adr.normalise_city(F.coalesce(F.element_at("t", "city"), F.lit("")))
    record = rows.select(
        "address",
        F.coalesce(F.nullif(city, F.lit("")), F.lit("(unknown)")).alias("city"),
        adr.classify_kind(adr.safe_meta(F.col("tags"))).alias("kind"),
        F.map_contains_key("t", F.lit("housenumber")).alias("has_housenumber"),
        *order,
    )
    rank = F.struct((F.col("kind") == "unknown").alias("untyped"), *order)
    best = record.groupBy("address").agg(
        F.min_by(F.struct("city", "kind", "has_housenumber"), rank).alias("b")
    )
    return best.select(
        "address",
        "b.city",
        adr.classify_form(F.col("address")).alias("form"),
        "b.kind",
        "b.has_housenumber",
        adr.latin_only(F.col("address")).alias("latin"),
    )


def write_corpus(corpus: DataFrame, path: str) -> DataFrame:
    """Write first, report from what was written."""
    corpus.write.mode("overwrite").parquet(path)
    return corpus.sparkSession.read.parquet(path)


def corpus_composition(corpus: DataFrame) -> DataFrame:
    """Counts, shares and ranks by city, form and kind, and the two flag shares. No value is left out.

    One pass over the corpus: all dimensions are grouping sets of one aggregate.
    """
    dims = ["city", "form", "kind", "has_housenumber", "latin"]
    marks = [F.grouping(d).alias(f"_g{i}") for i, d in enumerate(dims)]
    grouped = corpus.groupingSets([[d] for d in dims], *dims).agg(F.count("*").alias("n"), *marks)

    def of_set(value) -> Column:
        return F.coalesce(*[F.when(F.col(f"_g{i}") == 0, value(d)) for i, d in enumerate(dims)])

    rows = grouped.select(
        of_set(F.lit).alias("dimension"),
        of_set(lambda d: F.col(d).cast("string")).alias("value"),
        "n",
    )
    same = Window.partitionBy("dimension")
    rank = F.row_number().over(same.orderBy(F.desc("n"), "value"))
    return (
        rows.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(same)))
        .withColumn("rank", rank)
    )


# --------------------------------------------------------------------------- #
# Labels, locales and shapes
# --------------------------------------------------------------------------- #
def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def label_totals(labels: DataFrame) -> DataFrame:
    return label_counts(labels).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"), F.count("*").alias("distinct_labels")
    )


def write_label_counts(labels: DataFrame, path: str) -> None:
    counts = label_counts(labels).select("label", F.col("n").alias("count"))
    counts.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def locale_profile(docs: DataFrame, locale: str, dims: Sequence[str]) -> DataFrame:
    """Documents per locale and per (locale, dimension) in one grouping-sets pass."""
    sets = [[locale], *[[locale, d] for d in dims]]
    marks = [F.grouping(d).alias(f"_g{i}") for i, d in enumerate(dims)]
    grouped = docs.groupingSets(sets, locale, *dims).agg(F.count("*").alias("n"), *marks)
    name = F.coalesce(
        *[F.when(F.col(f"_g{i}") == 0, F.lit(d)) for i, d in enumerate(dims)], F.lit("ALL")
    )
    value = F.coalesce(
        *[F.when(F.col(f"_g{i}") == 0, F.col(d).cast("string")) for i, d in enumerate(dims)],
        F.lit("ALL"),
    )
    return grouped.select(locale, name.alias("dimension"), value.alias("value"), "n")


def shape_hits(
    docs: DataFrame, locale: str, text: str, shapes: Mapping[str, str] = SHAPES
) -> DataFrame:
    """Documents with at least one match, per locale and shape: one scan for all shapes."""
    counts = docs.groupBy(locale).agg(
        *[F.count_if(F.col(text).rlike(p)).alias(n) for n, p in shapes.items()]
    )
    cells = F.array(
        *[F.struct(F.lit(n).alias("shape"), F.col(n).alias("n_docs")) for n in shapes]
    )
    return counts.select(locale, F.explode(cells).alias("c")).select(locale, "c.*")


def dial_codes(surfaces: DataFrame, locale: str, surface: str) -> DataFrame:
    return surfaces.groupBy(locale, chk.dial_code(F.col(surface)).alias("code")).agg(
        F.count("*").alias("n")
    )


def country_forms(surfaces: DataFrame, locale: str) -> DataFrame:
    countries = surfaces.where(F.col("label") == "country")
    return countries.groupBy(locale, F.trim("surface").alias("form")).agg(F.count("*").alias("n"))


def label_locale_pivot(
    labels: DataFrame, label: str, locale: str, locales: Sequence[str]
) -> DataFrame:
    """Label by locale matrix. Locales are named, so no pass is needed to find them."""
    cols = [F.count_if(F.col(locale) == x).alias(x) for x in locales]
    return labels.groupBy(label).agg(*cols)


def labels_missing_somewhere(pivot: DataFrame, locales: Sequence[str]) -> DataFrame:
    gap = F.lit(False)
    for x in locales:
        gap = gap | (F.col(x) == 0)
    return pivot.where(gap)


def labels_only_one_side(labels: DataFrame, label: str, locale: str, a: str, b: str) -> DataFrame:
    """Symmetric difference of two locales' label sets, in one aggregate."""
    sides = labels.where(F.col(locale).isin(a, b)).groupBy(label).agg(
        F.max(F.col(locale) == a).alias("in_a"), F.max(F.col(locale) == b).alias("in_b")
    )
    return sides.where(F.col("in_a") != F.col("in_b")).select(
        label, F.when(F.col("in_a"), a).otherwise(b).alias("only_in")
    )


def jaccard_groups(items: DataFrame, group: str, item: str, a: str, b: str) -> DataFrame:
    """Distinct items of two groups, how many are shared, and their Jaccard index."""
    sides = items.where(F.col(group).isin(a, b)).groupBy(item).agg(
        F.max(F.col(group) == a).alias("in_a"), F.max(F.col(group) == b).alias("in_b")
    )
    return sides.agg(
        F.count_if("in_a").alias("n_a"),
        F.count_if("in_b").alias("n_b"),
        F.count_if(F.col("in_a") & F.col("in_b")).alias("n_shared"),
        F.try_divide(F.count_if(F.col("in_a") & F.col("in_b")), F.count("*")).alias("jaccard"),
    )


def checksum_tests(values: DataFrame) -> DataFrame:
    """(label, value) as (label, test, value, ok): one row for every property a label's values should have."""
    v = F.col("value")
    digits = F.regexp_replace(v, r"[^0-9]", "")
    code = F.upper(F.regexp_replace(v, " ", ""))
    tests = (
        F.when(F.col("label") == "swift_bic", F.array(_test("strict_shape", chk.bic_shape(code)),
               _test("length_8_or_11", chk.bic_length_ok(code)),
               _test("country_iso", chk.bic_country(code))))
        .when(F.col("label") == "bank_routing_number", F.array(
            _test("nine_digits", F.length(digits) == 9), _test("aba_checksum", chk.aba_ok(digits))))
        .when(F.col("label") == "credit_debit_card", F.array(_test("luhn", chk.luhn_ok(digits))))
    )
    return values.select("label", "value", F.explode(tests).alias("t")).select(
        "label", F.col("t.name").alias("test"), "value", F.col("t.ok").alias("ok")
    )


def checksum_audit(values: DataFrame) -> DataFrame:
    """Per label: values, how many hold each property, the rate, from (label, value)."""
    return (
        checksum_tests(values)
        .groupBy("label", "test")
        .agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"))
        .withColumn("rate", F.try_divide("passed", "total"))
    )


def checksum_failures(values: DataFrame, n: int = FAILING_SAMPLES) -> DataFrame:
    """Up to n different failing values per label and test, the smallest first, with how often each occurs.

    Equal values are counted map-side, and Spark keeps n a group before the shuffle, so a
    property that almost nothing holds costs no more than one that almost everything does.
    """
    from redactstream.operators.stats import sample_per_group

    failing = checksum_tests(values).where("NOT ok").groupBy("label", "test", "value").agg(F.count("*").alias("n"))
    return sample_per_group(failing, ["label", "test"], n, ["value"])


def _test(name: str, ok: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"))


def length_histogram(values: DataFrame) -> DataFrame:
    digits = F.length(F.regexp_replace("value", r"[^0-9]", ""))
    whole = F.length(F.regexp_replace("value", " ", ""))
    size = F.when(F.col("label") == "swift_bic", whole).otherwise(digits)
    return values.groupBy("label", size.alias("length")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- #
# Tokens
# --------------------------------------------------------------------------- #
def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def token_frequency(docs: DataFrame, text: str, corpus: str) -> DataFrame:
    """Occurrences per word and corpus. Frequent words shrink before the shuffle."""
    words = docs.select(corpus, F.explode(tokenize(F.col(text))).alias("word"))
    return words.groupBy(corpus, "word").agg(F.count("*").alias("n"))


def corpus_sizes(freq: DataFrame, corpus: str) -> DataFrame:
    return freq.groupBy(corpus).agg(
        F.sum("n").alias("tokens"), F.count("*").alias("distinct_tokens")
    )


def per_million(freq: DataFrame, corpus: str) -> DataFrame:
    sizes = corpus_sizes(freq, corpus).select(corpus, "tokens")
    return freq.join(sizes, corpus).select(
        corpus, "word", "n", (F.col("n") * 1e6 / F.col("tokens")).alias("per_million")
    )


def attestation(freq: DataFrame, corpus: str) -> DataFrame:
    """In how many corpora each word occurs; `freq` has one row per word and corpus."""
    return freq.groupBy("word").agg(F.count("*").alias("corpora"))


def vocab_lookup(freq: DataFrame, corpus: str, vocab: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each probe word in each corpus: count and per-million rate, zero where absent.

    The vocabulary is a short parameter list; it unfolds over the corpus totals, and the
    frequency table is filtered to its words before anything is joined.
    """
    pairs = [(g, w) for g, words in vocab.items() for w in words]
    probe = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(w).alias("word")) for g, w in pairs])
    grid = corpus_sizes(freq, corpus).select(corpus, "tokens", F.explode(probe).alias("p")).select(
        corpus, "tokens", "p.grp", "p.word"
    )
    hits = freq.where(F.col("word").isin([w for _, w in pairs]))
    n = F.coalesce("n", F.lit(0))
    return grid.join(hits, [corpus, "word"], "left").select(
        "grp",
        "word",
        corpus,
        n.alias("n"),
        F.coalesce(F.try_divide(n * 1e6, F.col("tokens")), F.lit(0.0)).alias("per_million"),
    )


def weak_sentences(
    sentences: DataFrame, key: str, text: str, freq: DataFrame, corpus: str, min_corpora: int = 3
) -> DataFrame:
    """Sentences holding a word attested in fewer than `min_corpora` corpora.

    The words of one sentence are deduplicated first. Words in more than a thousandth of the rows
    (at most a thousand of them) get their attestation from a broadcast table: if it suffices, their
    rows leave there; otherwise they take part in the join under keys of their own that spread them.
    """
    words = sentences.select(key, F.explode(F.array_distinct(tokenize(F.col(text)))).alias("word"))
    strong = attestation(freq, corpus)
    hot = hot_values(words, "word").join(strong, "word", "left")
    hot = hot.select("word", F.coalesce("corpora", F.lit(0)).alias("known"))
    left = words.join(F.broadcast(hot), "word", "left").where(F.col("known").isNull() | (F.col("known") < min_corpora))
    # Words are letters, so no word begins with a zero byte.
    apart = F.concat(F.lit("\0"), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("string"))
    left = left.withColumn("met", F.when(F.col("known").isNull(), F.col("word")).otherwise(apart))
    joined = left.join(strong.withColumnRenamed("word", "met"), "met", "left")
    weak = joined.withColumn("corpora", F.coalesce("known", "corpora", F.lit(0))).where(F.col("corpora") < min_corpora)
    tokens = F.sort_array(
        F.collect_set(F.concat_ws("=", "word", F.coalesce("corpora", F.lit(0)).cast("string")))
    )
    return weak.groupBy(key).agg(F.array_join(tokens, ",").alias("weak_tokens"))
