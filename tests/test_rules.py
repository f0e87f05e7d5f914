"""Detectors on single texts, and against Python's regular expressions on whole tables."""

from __future__ import annotations

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from redactstream.functions import rules, spans
from redactstream.schema import FINDINGS

CASES = [
    ("national id 42101-7654321-9 noted", ["CNIC"]),
    ("number 4210176543219 plain", ["CNIC"]),
    ("pay into PK68MEZN5748718428058488", ["IBAN_PK"]),
    ("ring 03011234567", ["PHONE_PK"]),
    ("ring +92 301 1234567", ["PHONE_PK"]),
    ("ring +923011234567", ["PHONE_PK"]),
    ("ring 0301-123-4567", ["PHONE_PK"]),
    ("ring 00923011234567", ["PHONE_PK"]),
    ("write to someone@example.com", ["EMAIL"]),
    ("write to some.one@mail.sub.example.org", ["EMAIL"]),
    ("nothing to see", []),
    ("", []),
    ("parcel 01234567890 left", []),
    ("ratio 0.5 of 92 301 1234567", []),
    ("a@b", []),
    ("x@@y.com", []),
    ("someone-at-example.com", []),
    ("@example.com", []),
    ("a@x.com,b@y.com", []),
    ("4210176543219@example.com", ["EMAIL"]),
    ("42101-7654321-9 or 4210176543219", ["CNIC", "CNIC"]),
    ("mail a@example.com, id 42101-7654321-9, ring 03011234567", ["CNIC", "EMAIL", "PHONE_PK"]),
    *[(f"id {d}210176543219 here", ["CNIC"]) for d in "1234567"],
    *[(f"id {d}210176543219 here", []) for d in "089"],
]


def detected(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = df.select("i", "t", rules.detect_rules(F.col("t"), F.lit("memo")).alias("f"))
    return [r for r in found.orderBy("i").collect()]


def test_detects_expected_types(spark):
    got = detected(spark, [t for t, _ in CASES])
    for row, (text, expected) in zip(got, CASES):
        assert sorted(f.entity_type for f in row.f) == expected, text
        starts = [f.span_start for f in row.f]
        assert starts == sorted(starts)
        assert all(0 <= f.span_start < f.span_end <= len(text) for f in row.f)
        assert all(f.tier == 1 and f.field == "memo" for f in row.f)


@pytest.mark.parametrize(
    "text, matched",
    [
        ("notify at someone@example.com.", "someone@example.com"),
        ("(someone@example.com)", "someone@example.com"),
        ("<a@example.com>", "a@example.com"),
        ("id 😀 42101-7654321-9 end", "42101-7654321-9"),
        ("mail:a@x.com", "mail:a@x.com"),
    ],
)
def test_spans_index_the_original_text(spark, text, matched):
    (row,) = detected(spark, [text])
    (f,) = row.f
    assert text[f.span_start : f.span_end] == matched


def test_failed_checksum_lowers_confidence(spark):
    bad, good = detected(spark, ["PK99MEZN5748718428058488", "PK68MEZN5748718428058488"])
    assert bad.f[0].confidence == 0.5
    assert good.f[0].confidence == 1.0


PATTERNS = {
    r"\d{3,}": rf"{spans.DIGIT}{{3,}}",
    r"\b\w{12,}\b": rf"{spans.WORD_START}[{spans.WORD}]{{12,}}{spans.WORD_END}",
    r"\S+@\S+": rules.EMAIL_CANDIDATE,
    r"[a-z]+(?=\.)": r"[a-z]+(?=\.)",
}


@pytest.mark.parametrize("python", sorted(PATTERNS))
def test_find_spans_equals_finditer_on_whole_documents(spark, python):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame(
        [(-1, "٣٤٥ abc 😀 x@y z@"), (-2, "@@ @a@b a@@ a@ \x1c x@y\x1cz"), (-3, "")], "doc_id long, text string"
    )
    rows = docs.unionByName(extra)
    found = rows.select("text", spans.find_spans(F.col("text"), PATTERNS[python]).alias("h")).collect()
    for row in found:
        expected = [(m.start(), m.end(), m.group()) for m in re.finditer(python, row.text)]
        assert [(h.s, h.e, h.m) for h in row.h] == expected


def test_very_long_token_is_linear(spark):
    text = "x" * 200_000
    (row,) = detected(spark, [text])
    assert row.f == []


def test_a_text_full_of_hits(spark):
    """Thousands of hits in one text stay practical and exact."""
    text = " ".join(f"u{i}@example.com 0301{i:07d}" for i in range(3000))
    (row,) = detected(spark, [text])
    assert len(row.f) == 6000
    assert [text[f.span_start : f.span_end] for f in row.f[:2]] == ["u0@example.com", "03010000000"]
    assert row.f[-1].span_end == len(text)


def test_detection_trees_are_built_once(spark):
    from redactstream.functions.spans import built_once
    from redactstream.operators.scan import scan

    assert rules.rule_column("t", "memo") is rules.rule_column("t", "memo")
    assert rules.rule_column("t", "memo") is not rules.rule_column("u", "memo")

    calls = []

    @built_once
    def tree(name, kinds):
        calls.append(name)
        return F.col(name).isin(list(kinds))

    assert tree("a", ("x",)) is tree("a", ("x",)) and calls == ["a"]
    # What cannot be hashed may change between calls, so it is never kept.
    tree("a", ["x"]), tree("a", ["x"])
    assert calls == ["a", "a", "a"]

    # One tree serves tables and sessions that have nothing in common.
    for session in (spark, spark.newSession()):
        for column in ("t", "other"):
            df = session.createDataFrame([("write to a@b.co",), (None,)], f"{column} string")
            got = [len(r.findings) for r in scan(df, column).collect()]
            assert got == [1, 0]

    def card(text, field):
        return spans.empty(FINDINGS)

    # A detector of its own name and identity gives a tree of its own.
    extra = (("card", card),)
    assert rules.rule_column("t", "memo", extra) is rules.rule_column("t", "memo", extra)
    assert rules.rule_column("t", "memo", extra) is not rules.rule_column("t", "memo")


def test_a_lone_match_is_placed_where_the_pattern_found_it(spark):
    # The same word stands before the match where the pattern refuses it, or around it twice.
    texts = ["ab12 12", "12", "x 12 y", "é€ 12", "1212 12", "12ab 12 ab12", "", "no"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    pattern = rf"{spans.WORD_START}12{spans.WORD_END}"
    found = rows.select("text", spans.find_spans(F.col("text"), pattern).alias("h")).collect()
    for text, hits in found:
        expected = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\b12\b", text)]
        assert [tuple(h) for h in hits] == expected, text


def test_ibans_of_the_common_shape_and_others_agree(spark):
    from redactstream.functions import checksums as ck

    ibans = [f"PK{c:02d}{bank}{n:016d}" for bank in ("RDKT", "LM9A", "ZZZZ") for n in (0, 7, 10**16 - 1) for c in range(100)]
    rows = spark.createDataFrame([(i,) for i in [*ibans, "GB82WEST12345698765432", "PK", "PK٣٦SCBL0000001123456702"]], "iban string")
    for iban, ok in rows.select("iban", ck.iban_mod97_ok(F.col("iban"))).collect():
        turned = "".join(str(int(c, 36)) for c in iban[4:] + iban[:4] if re.match("[A-Z0-9]", c))
        assert ok == (bool(turned) and int(turned) % 97 == 1), iban


def test_mobile_numbers_in_one_look_equal_trunk_and_subscriber(spark):
    texts = [
        "03011234567", "+92 301 1234567", "0092(301)1234567", "+92-0301-123-4567", "0092 0301 123 456",
        "00 9230 1123 4567", "092 301 1234", "0 92 3011 234567", "+92(3011)234 5678", "0٣011234567", "+92 211 2345678",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select("text", F.regexp_extract("text", rules.PHONE_PK, 0).alias("m")).withColumn(
        "mobile", F.col("m").rlike(rules.PHONE_MOBILE)
    )
    for text, m, mobile in got.collect():
        rest = re.sub(r"\A(?:0092|92|0)", "", re.sub(r"[^\d]", "", m))
        assert mobile == bool(re.search(r"\A3\d{9}\Z", rest)), text


def test_values_that_are_one_hit_equal_the_contest_of_all_hits(spark):
    texts = [
        "12345-1234567-1", "82345-1234567-1", "1234512345671", "7234-51234567-1", "1٢345-1234567-1", "12345-1234567-12",
        "PK36SCBL0000001123456702", "PK37SCBL0000001123456702", "PK36scbl0000001123456702", "PK36SCBL00000011234567021",
        "03011234567", "+92 301 1234567", "0092(301)1234567", "042 1234567", "0301123456", "0301 1234 567", "03011234567 ",
        "a@b.co", "(a@b.co", "a@b.co.", "03011234567@b.co", "12345-1234567-1@b.co", "a@b@c.co", "@b.co", "a@b.c", "é@b.co", "a @b.co",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    text, field = F.col("t"), F.lit("memo")
    # With a detector that finds nothing, every text goes through the contest.
    contest = rules.detect_rules(text, field, {"none": lambda t, f: spans.empty(FINDINGS)})
    one = F.size(rules._whole(text, field)) > 0
    got = rows.select("t", rules.detect_rules(text, field).alias("f"), contest.alias("c"), one.alias("one")).collect()
    assert [r.t for r in got if r.f != r.c] == []
    whole = [r.t for r in got if len(r.c) == 1 and (r.c[0].span_start, r.c[0].span_end) == (0, len(r.t))]
    assert whole and [r.t for r in got if r.one] == whole


def test_redacted_documents_equal_their_sql_on_odd_texts(spark, workdir):
    """Digits in the shape of another identifier stay; an e-mail goes even inside a longer number's reach."""
    import duckdb
    from oracle_check import check

    from redactstream.plans.catalog import ORACLES, QUERIES

    texts = [
        'token = "aa24f4db9308e03810347069cc6b5ccc3eab7c14"', "id 42101-7654321-9, ring 0301-123-4567, a@b.co",
        "+92 301 123 4567a@b.co", "PK68MEZN5748718428058488 (x.y@z.org).", "<a@b.co> a@b.co a@b.co,c@d.ef é@😀.info",
        "x@y.co x@y.co @z.co\x1cq@r.st\x85u@v.wx​y@z.ab", "", None, " ", "@", "''a@b.c a@b.co''",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.coalesce(1).write.parquet(f"{workdir}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{workdir}/documents.parquet/*.parquet')")
    name = "redact_documents"
    assert check(spark, con, workdir, QUERIES[name], ORACLES[name]) == ("", len(texts))
    first = QUERIES[name](spark, workdir).orderBy("doc_id").head()
    assert (first.redacted, first.n_findings) == (texts[0], 0)
