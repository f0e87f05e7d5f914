"""Corpus jobs over documents, conversations and labelled rows derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from redactstream.functions import address as adr
from redactstream.operators import corpus as co
from redactstream.plans.catalog.detection import _BIC, _ROUTING
from redactstream.plans.catalog.evaluation import GOLD_SQL
from redactstream.plans.catalog.oracle import with_txn
from redactstream.plans.catalog.registry import query, r6, shared_folder
from redactstream.sources import files
from redactstream.sources.views import table, txn

# Labelled surfaces per transaction; the two locales do not share all labels.
LABELLED_SQL = f"""
SELECT k, locale, 'swift_bic' AS label, {_BIC} AS surface FROM loc
UNION ALL SELECT k, locale, 'bank_routing_number', {_ROUTING} FROM loc
UNION ALL SELECT k, locale, 'credit_debit_card', lpad(cast(k * 7919 * 104729 % 10000000000000000 AS string), 16, '0') FROM loc
UNION ALL SELECT k, locale, 'phone_number', phone FROM loc
UNION ALL SELECT k, locale, 'country', concat(' ', split_part('Pakistan,PK,Germany', ',', cast(1 + k % 3 AS int))) FROM loc WHERE locale = 'intl'
UNION ALL SELECT k, locale, 'tax_id', cnic FROM loc WHERE locale = 'us'
"""
_LOC = "SELECT *, CASE WHEN k % 3 = 0 THEN 'us' ELSE 'intl' END AS locale FROM txn"
LOCALES = ("us", "intl")


def with_labels(sql: str) -> str:
    return with_txn(f", loc AS ({_LOC}), lab AS ({LABELLED_SQL}) {sql}")


def _labelled(spark, sf_dir):
    rows = txn(spark, sf_dir).withColumn("locale", F.when(F.expr("k % 3 = 0"), "us").otherwise("intl"))
    return spark.sql(LABELLED_SQL.replace("FROM loc", "FROM {loc}"), loc=rows)


@query("label_counts", with_labels("SELECT label, count(*) AS n FROM lab GROUP BY 1"))
def label_counts(spark, sf_dir):
    return co.label_counts(_labelled(spark, sf_dir))


@query(
    "label_totals",
    with_labels("SELECT count(*) AS mentions, count(DISTINCT label) AS distinct_labels FROM lab"),
)
def label_totals(spark, sf_dir):
    return co.label_totals(_labelled(spark, sf_dir))


@query(
    "src_labelled_docs",
    with_txn(
        f", gold AS ({GOLD_SQL}) SELECT k, entity_type AS label, substr(text, gold_start + 1, gold_end - gold_start) AS surface FROM gold"
    ),
)
def labelled_docs(spark, sf_dir):
    """Label spans written as a Python list are parsed; surfaces come from the text."""
    gold = spark.sql(GOLD_SQL.replace("FROM txn", "FROM {txn}"), txn=txn(spark, sf_dir))
    listed = F.format_string(
        "[{'start': %d, 'end': %d, 'text': \"O'Neil\", 'label': '%s'}]", "gold_start", "gold_end", "entity_type"
    )
    docs = gold.select("k", "text", listed.alias("spans")).withColumn("spans", files.parse_spans("spans"))
    return files.labelled_spans(docs, ["k"]).drop("text")


@query(
    "locale_profile",
    """
    SELECT lang, CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(size) = 0 THEN 'size' ELSE 'ALL' END AS dimension,
      CASE WHEN grouping(source) = 0 THEN source WHEN grouping(size) = 0 THEN size ELSE 'ALL' END AS value, count(*) AS n
    FROM (SELECT lang, source, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS size FROM documents)
    GROUP BY GROUPING SETS ((lang), (lang, source), (lang, size))
    """,
)
def locale_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "lang", "source", F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("size")
    )
    return co.locale_profile(docs, "lang", ["source", "size"])


_EXTRA_SHAPES = {**co.SHAPES, "card_shape": r"\b[0-9]{16}\b", "intl_phone": r"\+[0-9]{1,3}[\s\-()]?[0-9]"}


@query(
    "shape_hits",
    " UNION ALL ".join(
        f"SELECT lang, '{n}' AS shape, count(*) FILTER (regexp_matches(text, '{p}')) AS n_docs FROM documents GROUP BY lang"
        for n, p in _EXTRA_SHAPES.items()
    ),
)
def shape_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return co.shape_hits(docs, "lang", "text", _EXTRA_SHAPES)


@query(
    "dial_codes",
    with_labels(
        r"""
        SELECT locale, CASE WHEN c = '' THEN '<no + prefix>' ELSE '+' || c END AS code, count(*) AS n
        FROM (SELECT locale, regexp_extract(surface, '\+([0-9]{1,3})[\s\-()]?[0-9]', 1) AS c FROM lab WHERE label = 'phone_number') GROUP BY ALL
        """
    ),
)
def dial_codes(spark, sf_dir):
    phones = _labelled(spark, sf_dir).where("label = 'phone_number'")
    return co.dial_codes(phones, "locale", "surface")


@query(
    "country_forms",
    with_labels("SELECT locale, trim(surface) AS form, count(*) AS n FROM lab WHERE label = 'country' GROUP BY ALL"),
)
def country_forms(spark, sf_dir):
    return co.country_forms(_labelled(spark, sf_dir), "locale")


@query(
    "top_n_counts",
    "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10",
)
def top_n_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "source").limit(10)


@query("first_n_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 500")
def first_n_rows(spark, sf_dir):
    """The head of a table in row order, as a reader pages through it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.orderBy("doc_id").limit(500)


@query(
    "label_locale_pivot",
    with_labels(
        "SELECT label, count(*) FILTER (locale = 'us') AS us, count(*) FILTER (locale = 'intl') AS intl FROM lab GROUP BY 1"
    ),
)
def label_locale_pivot(spark, sf_dir):
    return co.label_locale_pivot(_labelled(spark, sf_dir), "label", "locale", LOCALES)


@query(
    "labels_missing_somewhere",
    with_labels(
        """
        SELECT label, count(*) FILTER (locale = 'us') AS us, count(*) FILTER (locale = 'intl') AS intl FROM lab GROUP BY 1
        HAVING us = 0 OR intl = 0
        """
    ),
)
def labels_missing(spark, sf_dir):
    pivot = co.label_locale_pivot(_labelled(spark, sf_dir), "label", "locale", LOCALES)
    return co.labels_missing_somewhere(pivot, LOCALES)


@query(
    "labels_only_one_side",
    with_labels("SELECT label, min(locale) AS only_in FROM lab GROUP BY 1 HAVING count(DISTINCT locale) = 1"),
)
def labels_only_one_side(spark, sf_dir):
    return co.labels_only_one_side(_labelled(spark, sf_dir), "label", "locale", *LOCALES)


_WORDS = "(SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"


@query(
    "jaccard_groups",
    f"""
    WITH w AS (SELECT word, bool_or(lang = 'en') AS a, bool_or(lang = 'de') AS b FROM {_WORDS} WHERE lang IN ('en', 'de') GROUP BY 1)
    SELECT count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS n_shared,
      round(count(*) FILTER (a AND b) / count(*), 6)::double AS jaccard FROM w
    """,
)
def jaccard_groups(spark, sf_dir):
    out = co.jaccard_groups(_words(spark, sf_dir), "lang", "word", "en", "de")
    return out.withColumn("jaccard", r6("jaccard"))


def _words(spark, sf_dir):
    return co.token_frequency(table(spark, sf_dir, "documents"), "text", "lang")


@query("token_frequency", f"SELECT lang, word, count(*) AS n FROM {_WORDS} GROUP BY ALL")
def token_frequency(spark, sf_dir):
    return _words(spark, sf_dir)


@query(
    "corpus_sizes",
    f"SELECT lang, count(*) AS tokens, count(DISTINCT word) AS distinct_tokens FROM {_WORDS} GROUP BY 1",
)
def corpus_sizes(spark, sf_dir):
    return co.corpus_sizes(_words(spark, sf_dir), "lang")


@query(
    "per_million",
    f"""
    WITH c AS (SELECT lang, word, count(*) AS n FROM {_WORDS} GROUP BY ALL)
    SELECT lang, word, n, round(n * 1e6 / sum(n) OVER (PARTITION BY lang), 6)::double AS per_million FROM c
    """,
)
def per_million(spark, sf_dir):
    return co.per_million(_words(spark, sf_dir), "lang").withColumn("per_million", r6("per_million"))


@query(
    "attestation",
    f"SELECT word, count(DISTINCT lang) AS corpora FROM {_WORDS} GROUP BY 1",
)
def attestation(spark, sf_dir):
    return co.attestation(_words(spark, sf_dir), "lang")


VOCAB = {"articles": ("the", "die", "la", "el"), "absent": ("ghar", "gali")}


@query(
    "vocab_lookup",
    f"""
    WITH c AS (SELECT lang, word, count(*) AS n FROM {_WORDS} GROUP BY ALL), t AS (SELECT lang, sum(n) AS total FROM c GROUP BY 1),
    v AS (SELECT * FROM (VALUES {", ".join(f"('{g}', '{w}')" for g, ws in VOCAB.items() for w in ws)}) AS t(grp, word))
    SELECT grp, v.word, t.lang, coalesce(n, 0) AS n, round(coalesce(n, 0) * 1e6 / total, 6)::double AS per_million
    FROM v CROSS JOIN t LEFT JOIN c ON c.word = v.word AND c.lang = t.lang
    """,
)
def vocab_lookup(spark, sf_dir):
    out = co.vocab_lookup(_words(spark, sf_dir), "lang", VOCAB)
    return out.withColumn("per_million", r6("per_million"))


@query(
    "weak_sentences",
    f"""
    WITH a AS (SELECT word, count(DISTINCT lang) AS corpora FROM {_WORDS} GROUP BY 1),
    s AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)
    SELECT item_id, string_agg(s.word || '=' || coalesce(corpora, 0), ',' ORDER BY s.word || '=' || coalesce(corpora, 0)) AS weak_tokens
    FROM s LEFT JOIN a USING (word) WHERE coalesce(corpora, 0) < 3 GROUP BY 1
    """,
)
def weak_sentences(spark, sf_dir):
    return co.weak_sentences(table(spark, sf_dir, "benchmark"), "item_id", "text", _words(spark, sf_dir), "lang")


# Whether each value holds each property, by plain arithmetic on its characters.
_TESTED = r"""
        , d AS (SELECT label, surface AS v FROM lab), t AS (
        SELECT label, 'strict_shape' AS test, regexp_full_match(v, '[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?') AS ok, v FROM d WHERE label = 'swift_bic'
        UNION ALL SELECT label, 'length_8_or_11', length(v) IN (8, 11), v FROM d WHERE label = 'swift_bic'
        UNION ALL SELECT label, 'country_iso', substr(v, 5, 2) IN ('PK', 'US', 'DE', 'GB', 'FR'), v FROM d WHERE label = 'swift_bic'
        UNION ALL SELECT label, 'nine_digits', length(v) = 9, v FROM d WHERE label = 'bank_routing_number'
        UNION ALL SELECT label, 'aba_checksum', (3 * (v[1]::int + v[4]::int + v[7]::int) + 7 * (v[2]::int + v[5]::int + v[8]::int) + v[3]::int + v[6]::int + v[9]::int) % 10 = 0, v
          FROM d WHERE label = 'bank_routing_number'
        UNION ALL SELECT label, 'luhn', list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN substr(v, i, 1)::int
            WHEN substr(v, i, 1)::int > 4 THEN substr(v, i, 1)::int * 2 - 9 ELSE substr(v, i, 1)::int * 2 END)) % 10 = 0, v FROM d WHERE label = 'credit_debit_card')
"""


@query(
    "checksum_audit",
    with_labels(
        f"""{_TESTED}
        SELECT label, test, count(*) AS total, count(*) FILTER (ok) AS passed, round(count(*) FILTER (ok) / count(*), 6)::double AS rate FROM t GROUP BY ALL
        """
    ),
)
def checksum_audit(spark, sf_dir):
    values = _labelled(spark, sf_dir).select("label", F.col("surface").alias("value"))
    return co.checksum_audit(values).withColumn("rate", r6("rate"))


@query(
    "checksum_failures",
    with_labels(
        f"""{_TESTED}
        SELECT label, test, v AS value, count(*) AS n FROM t WHERE NOT ok GROUP BY label, test, v
        QUALIFY row_number() OVER (PARTITION BY label, test ORDER BY v) <= 15
        """
    ),
)
def checksum_failures(spark, sf_dir):
    """Samples of what fails, beside the rates."""
    values = _labelled(spark, sf_dir).select("label", F.col("surface").alias("value"))
    return co.checksum_failures(values).select("label", "test", "value", "n")


@query(
    "length_histogram",
    with_labels(
        r"""
        SELECT label, CASE WHEN label = 'swift_bic' THEN length(replace(surface, ' ', '')) ELSE length(regexp_replace(surface, '[^0-9]', '', 'g')) END::int AS length,
          count(*) AS n FROM lab GROUP BY ALL
        """
    ),
)
def length_histogram(spark, sf_dir):
    values = _labelled(spark, sf_dir).select("label", F.col("surface").alias("value"))
    return co.length_histogram(values)


@query(
    "label_samples",
    with_labels(
        "SELECT locale, label, surface FROM lab WHERE label IN ('swift_bic', 'phone_number') "
        "QUALIFY row_number() OVER (PARTITION BY locale, label ORDER BY k) <= 12"
    ),
)
def label_samples(spark, sf_dir):
    from redactstream.operators.stats import sample_per_group

    rows = _labelled(spark, sf_dir).where(F.col("label").isin("swift_bic", "phone_number"))
    picked = sample_per_group(rows, ["locale", "label"], co.SAMPLES_PER_LABEL, ["k"])
    return picked.select("locale", "label", "surface")


# --------------------------------------------------------------------------- #
# Address corpus: one map element per customer, many describing the same address
# --------------------------------------------------------------------------- #
def _elements(spark, sf_dir):
    c = F.col("c_custkey")
    city = F.element_at(
        F.array(*[F.lit(x) for x in ("Karachi", "lahore", "Rawalpindi, Punjab", "Sialkot", "")]),
        (c % 5 + 1).cast("int"),
    )
    street = F.when(c % 4 == 0, "Hill Road, F-6/3").when(c % 4 == 1, "Model Town").otherwise("Tariq Road")
    number = F.when(c % 3 != 0, (c % 50).cast("string"))
    building = F.when(c % 7 == 0, "house").when(c % 7 == 1, "retail").when(c % 7 == 2, "yes")
    tags = F.map_filter(
        F.create_map(
            F.lit("addr:city"), city,
            F.lit("addr:street"), F.when(c % 13 != 0, street),
            F.lit("addr:housenumber"), number,
            F.lit("building"), building,
            F.lit("name"), F.col("c_name"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("source"), c.alias("position"), F.lit("node").alias("type"), c.alias("id"), tags.alias("tags")
    )


_CORPUS = """
WITH e AS (SELECT c_custkey AS c,
    CASE c_custkey % 5 WHEN 0 THEN 'Karachi' WHEN 1 THEN 'Lahore' WHEN 2 THEN 'Rawalpindi' WHEN 3 THEN 'Sialkot' ELSE '' END AS city,
    CASE c_custkey % 4 WHEN 0 THEN 'Hill Road, F-6/3' WHEN 1 THEN 'Model Town' ELSE 'Tariq Road' END AS street,
    CASE c_custkey % 4 WHEN 0 THEN 'sector_code' WHEN 1 THEN 'block_phase' ELSE 'plain_street' END AS form,
    CASE c_custkey % 7 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' ELSE 'unknown' END AS kind FROM customer WHERE c_custkey % 13 <> 0),
a AS (SELECT *, CASE WHEN c % 3 <> 0 THEN (c % 50)::varchar || ', ' ELSE '' END || street || CASE WHEN city <> '' THEN ', ' || city ELSE '' END AS address FROM e),
corpus AS (SELECT address, CASE WHEN city = '' THEN '(unknown)' ELSE city END AS city, form, kind, c % 3 <> 0 AS has_housenumber, true AS latin FROM a
  QUALIFY row_number() OVER (PARTITION BY address ORDER BY kind = 'unknown', c) = 1)
"""


@query("best_typed_dedup", f"{_CORPUS} SELECT * FROM corpus")
def best_typed_dedup(spark, sf_dir):
    return co.build_corpus(_elements(spark, sf_dir))


@query(
    "corpus_composition",
    f"""{_CORPUS}, parts AS (SELECT 'city' AS dimension, city AS value FROM corpus UNION ALL SELECT 'form', form FROM corpus
      UNION ALL SELECT 'kind', kind FROM corpus UNION ALL SELECT 'has_housenumber', has_housenumber::varchar FROM corpus
      UNION ALL SELECT 'latin', latin::varchar FROM corpus)
    SELECT *, round(n / (SELECT count(*) FROM corpus), 6)::double AS share,
      (row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value NULLS FIRST))::int AS rank
    FROM (SELECT dimension, value, count(*) AS n FROM parts GROUP BY 1, 2)
    """,
)
def corpus_composition(spark, sf_dir):
    out = co.corpus_composition(co.build_corpus(_elements(spark, sf_dir)))
    return out.withColumn("share", r6("share"))


@query(
    "addr_whitelist",
    """
    SELECT c_custkey AS id, (1 + (c_custkey % 5 <> 4)::int + (c_custkey % 13 <> 0)::int + (c_custkey % 3 <> 0)::int - 1)::int AS n_tags,
      (c_custkey % 7 < 3)::int AS n_meta FROM customer
    """,
)
def addr_whitelist(spark, sf_dir):
    """Only address tags survive, blank ones do not; one safe tag says what a building is."""
    rows = _elements(spark, sf_dir)
    return rows.select(
        "id",
        F.size(adr.address_tags(F.col("tags"))).alias("n_tags"),
        F.size(adr.safe_meta(F.col("tags"))).alias("n_meta"),
    )


@query(
    "normalise_city",
    """
    SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'Lahore' WHEN 1 THEN 'Karachi' WHEN 2 THEN 'Islamabad'
      WHEN 3 THEN 'Rawalpindi' WHEN 4 THEN 'Sahiwal' ELSE 'Quetta' END AS city FROM customer
    """,
)
def normalise_city(spark, sf_dir):
    spellings = F.array(
        *[F.lit(x) for x in (" LAHORE ", "کراچی", "islamabad capital", "Rawalpindi, Punjab, Pakistan", " Sahiwal", "Quetta Cantt")]
    )
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.element_at(spellings, (F.col("c_custkey") % 6 + 1).cast("int")).alias("raw")
    )
    return rows.select("id", adr.normalise_city(F.col("raw")).alias("city"))


# --------------------------------------------------------------------------- #
# File reading helpers on tables
# --------------------------------------------------------------------------- #
_WIDTHS = ("account_holder", "cnic", "iban_from", "phone", "memo")


@query(
    "widest_column",
    with_txn(
        ", s AS (SELECT * FROM txn) SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT {i} AS ordinal, '{c}' AS \"column\", sum(length({c}))::bigint AS chars FROM s" for i, c in enumerate(_WIDTHS)
        )
        + ")"
    ),
)
def widest_column(spark, sf_dir):
    """Characters per column over all rows, the measure behind the default."""
    return files.width_table(txn(spark, sf_dir).select(*_WIDTHS))


# The memos as an uploaded file: padded names, quotes, and line breaks inside values.
_UPLOADED = "CASE WHEN k % 7 = 0 THEN concat('  \"', memo, '\",', chr(10), channel, ' ') ELSE memo END"


def _upload(spark, sf_dir) -> str:
    path = f"{shared_folder(spark)}/redactstream-upload-{uuid.uuid4().hex}.csv"
    rows = txn(spark, sf_dir).selectExpr("k AS ` k`", f"{_UPLOADED} AS `memo `")
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(header=True, escape='"', **keep).csv(path)
    return path


@query(
    "src_rows_file",
    with_txn(f", f AS (SELECT trim({_UPLOADED}) AS text FROM txn) SELECT text, count(*) AS n FROM f WHERE text <> '' GROUP BY 1"),
)
def src_rows_file(spark, sf_dir):
    """Rows read back from the chosen column of a CSV: trimmed, blank ones gone."""
    rows = files.read_rows(spark, _upload(spark, sf_dir), "memo")
    return rows.groupBy("text").agg(F.count("*").alias("n"))


@query(
    "csv_columns",
    with_txn(
        f"""
        , f AS (SELECT k, {_UPLOADED} AS memo FROM txn)
        SELECT 0 AS ordinal, 'k' AS "column", sum(length(k::varchar))::bigint AS chars FROM f
        UNION ALL SELECT 1, 'memo', sum(length(memo))::bigint FROM f
        """
    ),
)
def csv_columns(spark, sf_dir):
    """Names of a file's columns without their padding, with the characters in each."""
    return files.width_table(files.read_csv(spark, _upload(spark, sf_dir)))
