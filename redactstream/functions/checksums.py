"""Check-digit arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactstream.functions.spans import let

# ISO 3166-1 alpha-2 codes accepted in the country position of a BIC.
ISO_COUNTRIES = (
    "AD AE AF AG AI AL AM AO AR AT AU AZ BA BB BD BE BF BG BH BI BJ BN BO BR BS BT BW BY BZ "
    "CA CD CF CG CH CI CL CM CN CO CR CU CV CY CZ DE DJ DK DM DO DZ EC EE EG ER ES ET FI FJ "
    "FR GA GB GD GE GH GM GN GQ GR GT GW GY HK HN HR HT HU ID IE IL IN IQ IR IS IT JM JO JP "
    "KE KG KH KI KM KN KP KR KW KY KZ LA LB LC LI LK LR LS LT LU LV LY MA MC MD ME MG MH MK "
    "ML MM MN MR MT MU MV MW MX MY MZ NA NE NG NI NL NO NP NZ OM PA PE PG PH PK PL PT PY QA "
    "RO RS RU RW SA SB SC SD SE SG SI SK SL SM SN SO SR SS ST SV SY SZ TD TG TH TJ TL TM TN "
    "TR TT TW TZ UA UG US UY UZ VC VE VN VU WS YE ZA ZM ZW"
).split()

# The digit weights and shapes of the standards.
ABA_WEIGHTS = (3, 7, 1, 3, 7, 1, 3, 7, 1)
BIC_SHAPE = r"\A[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?\n?\z"
COMMON_IBAN = r"\A[A-Z]{2}[0-9]{2}[A-Z]{4}[0-9]{16}\z"
IBAN_ANY_SHAPE = r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b"
DIAL_SHAPE = r"\+([0-9]{1,3})[\s\-()]?[0-9]"


def _letters_to_numbers(s: Column) -> Column:
    """A=10 ... Z=35, digits unchanged."""
    parts = F.transform(
        F.regexp_extract_all(s, F.lit("[A-Z]|[0-9]+"), F.lit(0)),
        lambda c: F.when(c >= "A", (F.ascii(c) - 55).cast("string")).otherwise(c),
    )
    return F.array_join(parts, "")


def mod97(number: Column) -> Column:
    """Remainder of a digit string of any length, nine digits at a time; null if it is none."""

    def fold(digits: Column) -> Column:
        return F.aggregate(
            F.regexp_extract_all(digits, F.lit("[0-9]{1,9}"), F.lit(0)),
            F.lit(0).cast("long"),
            lambda rest, part: (rest * F.pow(F.lit(10), F.length(part)).cast("long") + part.cast("long")) % 97,
        )

    return F.when(number.rlike(r"\A[0-9]+\z"), fold(number))


def _common_iban_rest(iban: Column) -> Column:
    """Remainder of an IBAN of COMMON_IBAN's shape, by arithmetic instead of its digit string."""

    def letters(start: int, n: int) -> Column:
        return sum(
            ((F.ascii(F.substring(iban, start + i, 1)) - 55) * 100 ** (n - 1 - i) for i in range(n)), F.lit(0)
        )

    bank = letters(5, 4) % 97 * (10**22 % 97)
    account = F.substring(iban, 9, 16).cast("long") % 97 * (10**6 % 97)
    return (bank + account + letters(1, 2) * 100 + F.substring(iban, 3, 2).cast("int")) % 97


def iban_mod97_ok(iban: Column) -> Column:
    turned = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    rest = F.when(iban.rlike(COMMON_IBAN), _common_iban_rest(iban)).otherwise(mod97(_letters_to_numbers(turned)))
    return F.coalesce(rest == 1, F.lit(False))


def iban_check_digits(country: Column, bban: Column) -> Column:
    """The two check digits that make country + digits + bban valid."""
    rest = mod97(_letters_to_numbers(F.concat(bban, country, F.lit("00")))).cast("int")
    return F.lpad((98 - rest).cast("string"), 2, "0")


def luhn_ok(digits: Column) -> Column:
    """At least 12 digits, Luhn sum divisible by ten."""

    def check(cells: Column) -> Column:
        n = F.size(cells)

        def weigh(c: Column, i: Column) -> Column:
            d = c.cast("int")
            twice = d * 2
            folded = F.when(twice > 9, twice - 9).otherwise(twice)
            return F.when((n - i) % 2 == 0, folded).otherwise(d)

        total = F.aggregate(F.transform(cells, weigh), F.lit(0), lambda acc, x: acc + x)
        return total % 10 == 0

    shaped = digits.rlike(r"\A[0-9]{12,}\z")
    cells = F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0))
    return F.coalesce(F.when(shaped, let(cells, check)), F.lit(False))


def aba_ok(digits: Column) -> Column:
    total = sum(
        (F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(ABA_WEIGHTS)),
        F.lit(0),
    )
    return F.coalesce(F.when(digits.rlike(r"\A[0-9]{9}\z"), total % 10 == 0), F.lit(False))


def bic_shape(code: Column) -> Column:
    return code.rlike(BIC_SHAPE)


def bic_length_ok(code: Column) -> Column:
    return F.length(code).isin(8, 11)


def bic_country(code: Column) -> Column:
    return (F.length(code) >= 6) & F.substring(code, 5, 2).isin(ISO_COUNTRIES)


def dial_code(text: Column) -> Column:
    code = F.regexp_extract(text, DIAL_SHAPE, 1)
    return F.when(code != "", F.concat(F.lit("+"), code)).otherwise(F.lit("<no + prefix>"))
