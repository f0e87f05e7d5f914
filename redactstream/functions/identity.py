"""Message identity and event-time scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactstream.functions.spans import let

# The RFC 4122 URL namespace and the accepted timestamp grammar
# (date, then optionally any one separator, a time, a fraction of 3 or 6 digits, an offset).
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"
VARIANT_DIGITS = "89ab"
_TIME = r"(?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:\.\d{3}(?:\d{3})?)?)?)?"
_ZONE = r"(?:[+-](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{6})?)?)?"
ISO_SHAPE = rf"(?s)\A\d{{4}}-\d{{2}}-\d{{2}}(?:.{_TIME}{_ZONE})?\z"

CAST_SHAPE = (
    r"(?s)\A\d{4}-\d{2}-\d{2}.\d{2}:\d{2}:\d{2}(?:\.\d{3}(?:\d{3})?)?[+-](?:0\d|1[0-7]):[0-5]\d\z"
)


def hyphenate(hex32: Column) -> Column:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(hex32, start, n) for start, n in cuts])


def uuid_digits(text: Column) -> Column:
    """What is left of any accepted spelling of a UUID without its marks."""
    bare = F.replace(F.replace(text, F.lit("urn:")), F.lit("uuid:"))
    return F.lower(F.replace(F.trim(bare, F.lit("{}")), F.lit("-")))


def uuid_of(digits: Column) -> Column:
    return F.when(digits.rlike(r"\A[0-9a-f]{32}\z"), hyphenate(digits))


def canonical_uuid(text: Column) -> Column:
    """Hyphenated lowercase form of any accepted spelling of a UUID, else null."""
    return let(uuid_digits(text), uuid_of)


def zoned(text: Column) -> Column:
    return F.when(
        text.endswith("Z"), F.concat(F.left(text, F.length(text) - 1), F.lit("+00:00"))
    ).otherwise(text)


def valid_time(t: Column) -> Column:
    day = F.left(t, F.lit(10))
    return F.when(t.rlike(ISO_SHAPE) & day.try_cast("date").isNotNull() & (day >= "0001"), t)


def normalise_event_ts(text: Column) -> Column:
    """A trailing Z becomes +00:00; anything that is not a valid ISO time is null."""
    return let(zoned(text), valid_time)


def event_time(normalised: Column) -> Column:
    """The instant behind a normalised event time; without an offset it is UTC.

    Full times whose offset Spark's cast knows are cast; the others go by arithmetic.
    """
    iso = F.concat(F.left(normalised, F.lit(10)), F.lit("T"), F.substr(normalised, F.lit(12)))
    return F.when(normalised.rlike(CAST_SHAPE), iso.try_cast("timestamp")).otherwise(_event_time(normalised))


def _event_time(normalised: Column) -> Column:
    """Minutes and seconds may be absent, and offsets may go up to a day: the offset is taken
    off by arithmetic.
    """
    rest = F.substr(normalised, F.lit(12))
    zone = F.regexp_extract(rest, r"[+-].*\z", 0)
    clock = F.left(rest, F.length(rest) - F.length(zone))
    clock = (
        F.when(F.length(clock) == 0, F.lit("00:00:00"))
        .when(F.length(clock) == 2, F.concat(clock, F.lit(":00:00")))
        .when(F.length(clock) == 5, F.concat(clock, F.lit(":00")))
        .otherwise(clock)
    )
    local = F.concat(F.left(normalised, F.lit(10)), F.lit("T"), clock).try_cast("timestamp")

    def micros(z: Column) -> Column:
        whole = (
            F.substr(z, F.lit(2), F.lit(2)).cast("long") * 3600
            + F.substr(z, F.lit(5), F.lit(2)).cast("long") * 60
            + F.when(F.length(z) > 6, F.substr(z, F.lit(8)).cast("decimal(8,6)")).otherwise(0)
        )
        return (F.when(z.startswith("-"), -whole).otherwise(whole) * 1_000_000).cast("long")

    def shifted(t: Column) -> Column:
        return let(zone, lambda z: F.when(z == "", t).otherwise(F.timestamp_micros(F.unix_micros(t) - micros(z))))

    return let(local, shifted)


def poison_id(topic: Column, partition: Column, offset: Column) -> Column:
    """Name-based (version 5) UUID of a record's coordinates: the same on every replay."""
    name = F.concat(
        F.lit("kafka://"),
        topic,
        F.lit("/"),
        partition.cast("string"),
        F.lit("/"),
        offset.cast("string"),
    )
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(name, "UTF-8")))

    def versioned(h: Column) -> Column:
        nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
        return F.concat(
            F.substring(h, 1, 12),
            F.lit("5"),
            F.substring(h, 14, 3),
            F.substring(F.lit(VARIANT_DIGITS), nibble + 1, F.lit(1)),
            F.substring(h, 18, 15),
        )

    return let(let(digest, versioned), hyphenate)
