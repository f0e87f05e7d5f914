"""Format-and-checksum detectors for identifiers with a known shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactstream.functions.checksums import iban_mod97_ok
from redactstream.functions.spans import (
    DIGIT,
    SPACE,
    WORD_END,
    WORD_START,
    built_once,
    dedupe_longest,
    empty,
    find_spans,
    finding,
    joined,
    once,
)
from redactstream.schema import FINDINGS, FULL_CONFIDENCE, TIER_RULES, UNVALIDATED_CONFIDENCE

# The shapes of the identifiers and the punctuation around an e-mail.
# The e-mail candidate is a whole space-delimited token with an inner '@'; it is
# anchored at the token start so that long tokens without '@' cost one look each.
EMAIL_CANDIDATE = rf"(?<![^{SPACE}])[^{SPACE}][^{SPACE}@]*@[^{SPACE}]+"
EMAIL_SHAPE = rf"\A[^@{SPACE}]+@[^@{SPACE}]+\.[A-Za-z]{{2,}}\z"
EMAIL_LEADING = "([{<'\""
EMAIL_TRAILING = ".,;:!?)]}>'\""
EMAIL_BARE = r"""(?s)\A[^(\[{<'"].*[^.,;:!?)\]}>'"]\z"""
CNIC_CANONICAL = rf"{WORD_START}{DIGIT}{{5}}-{DIGIT}{{7}}-{DIGIT}{WORD_END}"
CNIC_BARE = rf"{WORD_START}{DIGIT}{{13}}{WORD_END}"
CNIC_FIRST_DIGITS = "1234567"
IBAN_PK = rf"{WORD_START}PK{DIGIT}{{2}}[A-Z0-9]{{4}}{DIGIT}{{16}}{WORD_END}"
_PHONE = (
    rf"(?:(?:\+|00)92|0)[{SPACE}-]?\(?{DIGIT}{{2,4}}\)?[{SPACE}-]?"
    rf"{DIGIT}{{3,4}}[{SPACE}-]?{DIGIT}{{3,4}}"
)
PHONE_PK = rf"(?<!{DIGIT}){_PHONE}(?!{DIGIT})"
# Of the digits alone: a trunk prefix, the longest that fits, then a 3 and nine more.
_GAP = rf"[^{DIGIT}]*"
PHONE_MOBILE = (
    rf"\A{_GAP}(?>0{_GAP}0{_GAP}9{_GAP}2|9{_GAP}2|0){_GAP}3(?:{_GAP}{DIGIT}){{9}}{_GAP}\z"
)

# Values that are one hit from end to end.
WHOLE_EMAIL = rf"""\A[^@{SPACE}(\[{{<'"][^@{SPACE}]*@[^@{SPACE}]+\.[A-Za-z]{{2,}}\z"""
WHOLE_CNIC = rf"\A[{CNIC_FIRST_DIGITS}](?:{DIGIT}{{4}}-{DIGIT}{{7}}-{DIGIT}|{DIGIT}{{12}})\z"
WHOLE_IBAN_PK = rf"\APK{DIGIT}{{2}}[A-Z0-9]{{4}}{DIGIT}{{16}}\z"
WHOLE_PHONE_PK = rf"\A{_PHONE}\z"

# Every numeric shape above holds at least three digits in a row, so one cheap look
# decides whether any of those patterns has to run on a text.
DIGIT_GATE = rf"{DIGIT}{{3}}"


def _rule(entity: str, field: Column, s: Column, e: Column, conf: Column | None = None) -> Column:
    conf = F.lit(FULL_CONFIDENCE) if conf is None else conf
    return finding(F.lit(entity), field, s, e, TIER_RULES, conf)


def detect_email(text: Column, field: Column) -> Column:
    def trimmed(h: Column) -> Column:
        return F.when(h["m"].rlike(EMAIL_BARE), h).otherwise(cut(h))

    def cut(h: Column) -> Column:
        left = F.ltrim(h["m"], F.lit(EMAIL_LEADING))
        core = F.rtrim(left, F.lit(EMAIL_TRAILING))
        s = h["s"] + F.length(h["m"]) - F.length(left)
        return F.struct(s.alias("s"), (s + F.length(core)).alias("e"), core.alias("m"))

    spans = F.transform(find_spans(text, EMAIL_CANDIDATE), trimmed)
    good = F.filter(spans, lambda h: h["m"].rlike(EMAIL_SHAPE))
    found = F.transform(good, lambda h: _rule("EMAIL", field, h["s"], h["e"]))
    return F.when(F.contains(text, F.lit("@")), found).otherwise(empty(FINDINGS))


def _cnic(text: Column, field: Column, pattern: str) -> Column:
    hits = F.filter(
        find_spans(text, pattern),
        lambda h: F.substring(h["m"], 1, 1).isin(list(CNIC_FIRST_DIGITS)),
    )
    return F.transform(hits, lambda h: _rule("CNIC", field, h["s"], h["e"]))


def detect_cnic(text: Column, field: Column) -> Column:
    def gated(seen: Column, pattern: str) -> Column:
        return F.when(seen, _cnic(text, field, pattern)).otherwise(empty(FINDINGS))

    dashed, bare = F.contains(text, F.lit("-")), text.rlike(CNIC_BARE)
    both = joined(gated(dashed, CNIC_CANONICAL), gated(bare, CNIC_BARE))
    return F.when(dashed | bare, both).otherwise(empty(FINDINGS))


def _iban_confidence(iban: Column) -> Column:
    return F.when(iban_mod97_ok(iban), FULL_CONFIDENCE).otherwise(UNVALIDATED_CONFIDENCE)


def detect_iban_pk(text: Column, field: Column) -> Column:
    def scored(h: Column) -> Column:
        return _rule("IBAN_PK", field, h["s"], h["e"], _iban_confidence(h["m"]))

    found = F.transform(find_spans(text, IBAN_PK), scored)
    return F.when(F.contains(text, F.lit("PK")), found).otherwise(empty(FINDINGS))


def detect_phone_pk(text: Column, field: Column) -> Column:
    hits = F.filter(find_spans(text, PHONE_PK), lambda h: h["m"].rlike(PHONE_MOBILE))
    return F.transform(hits, lambda h: _rule("PHONE_PK", field, h["s"], h["e"]))


def detect_declared(text: Column, field: Column, entity: Column) -> Column:
    """A field that is personal by contract: one finding over the whole value."""
    whole = F.array(
        finding(entity, field, F.lit(0), F.length(text), TIER_RULES, F.lit(FULL_CONFIDENCE))
    )
    return F.when(F.length(text) > 0, whole).otherwise(empty(FINDINGS))


Detector = Callable[[Column, Column], Column]

DETECTORS: dict[str, Detector] = {
    "email": detect_email,
    "cnic": detect_cnic,
    "iban_pk": detect_iban_pk,
    "phone_pk": detect_phone_pk,
}


def _whole(text: Column, field: Column) -> Column:
    """The finding of a text that is one hit from end to end, as a `when` that lacks its end.

    Any other hit overlaps that one and is no longer; of two such hits the earlier detector's
    stays, so the detectors' order is kept here.
    """

    def found(entity: str, conf: Column | None = None) -> Column:
        return F.array(_rule(entity, field, F.lit(0), F.length(text), conf))

    phone = text.rlike(WHOLE_PHONE_PK) & text.rlike(PHONE_MOBILE)
    return (
        F.when(text.rlike(WHOLE_EMAIL), found("EMAIL"))
        .when(text.rlike(WHOLE_CNIC), found("CNIC"))
        .when(text.rlike(WHOLE_IBAN_PK), found("IBAN_PK", _iban_confidence(text)))
        .when(phone, found("PHONE_PK"))
    )


def detect_rules(text: Column, field: Column, extra: dict[str, Detector] | None = None) -> Column:
    """All rule detectors over one text, overlaps resolved, in text order."""
    numeric = joined(
        detect_cnic(text, field), detect_iban_pk(text, field), detect_phone_pk(text, field)
    )
    parts = [
        detect_email(text, field),
        F.when(text.rlike(DIGIT_GATE), numeric).otherwise(empty(FINDINGS)),
    ]
    if not extra:
        # Most texts can hold no hit at all, and most others are one hit.
        hits = F.when(
            F.contains(text, F.lit("@")) | text.rlike(DIGIT_GATE),
            _whole(text, field).otherwise(dedupe_longest(joined(*parts))),
        )
        return F.coalesce(hits, empty(FINDINGS))
    parts += [d(text, field) for d in extra.values()]
    return F.coalesce(dedupe_longest(joined(*parts)), empty(FINDINGS))


@built_once
def rule_column(text: str, field: str, extra: tuple[tuple[str, Detector], ...] = ()) -> Column:
    """`detect_rules` over the named column, evaluated once and built once."""
    return once(detect_rules(F.col(text), F.lit(field), dict(extra)))
