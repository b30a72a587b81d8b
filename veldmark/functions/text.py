"""Parsers of delivered text: each gives a canonical value, or an error code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Groups: minute, second, fraction, sign of the offset, its hours, minutes and seconds.
ISO_INSTANT = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(?:Z|([+-])(\d{2}):(\d{2})(?::(\d{2}))?)$"


def outer_trim(c: Column) -> Column:
    """Without leading and trailing characters up to U+0020 (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def normalise_reference(c: Column) -> Column:
    """Without control and format characters, trimmed; empty becomes null."""
    return F.nullif(outer_trim(F.regexp_replace(c, r"[\p{Cc}\p{Cf}]", "")), F.lit(""))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count two."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def parsed_integer(c: Column) -> Column:
    """Canonical text of a whole number of any size; null if it is none."""
    t = outer_trim(c)
    digits = F.regexp_replace(F.regexp_replace(t, r"^[+-]", ""), r"^0+(?=\d)", "")
    sign = F.when(t.startswith("-") & (digits != "0"), "-").otherwise("")
    return F.when(t.rlike(r"^[+-]?\d+$"), F.concat(sign, digits))


def plain_decimal(c: Column, decimal_sep: str | None = None, grouping_sep: str | None = None) -> Column:
    """The number with a point; null if it can't be read. Without declared signs a comma or a point is the decimal sign."""
    t = outer_trim(c)
    if decimal_sep is None:
        return F.when(t.rlike(r"^[+-]?\d+([.,]\d+)?$"), F.replace(F.regexp_replace(t, r"^\+", ""), F.lit(","), F.lit(".")))
    d = "\\" + decimal_sep
    whole = rf"\d+|\d{{1,3}}(\{grouping_sep}\d{{3}})+" if grouping_sep else r"\d+"
    plain = F.replace(t, F.lit(grouping_sep), F.lit("")) if grouping_sep else t
    return F.when(t.rlike(rf"^[+-]?({whole})({d}\d+)?$"), F.replace(F.regexp_replace(plain, r"^\+", ""), F.lit(decimal_sep), F.lit(".")))


def price_error(c: Column, plain: Column, places: int = 6, digits: int = 18) -> Column:
    """Error code of a delivered amount, null if it is good. Scale is told from the text: a cast would round."""
    fraction = F.regexp_replace(F.regexp_extract(plain, r"\.(\d+)$", 1), "0+$", "")
    whole = F.regexp_replace(F.regexp_extract(plain, r"^-?(\d+)", 1), "^0+", "")
    return (
        F.when(c.isNull() | (outer_trim(c) == ""), "PRICE_MISSING").when(plain.isNull(), "PRICE_UNREADABLE")
        .when(F.length(fraction) > places, "PRICE_SCALE_EXCEEDED").when(F.length(whole) > digits, "PRICE_OUT_OF_RANGE")
    )


def micro_units(plain: Column) -> Column:
    """A plain decimal in whole micro-units, decimal(24,0): 18 digits before the point and six after. price_error tells what doesn't fit; here it is null."""
    return (plain.try_cast("decimal(24,6)") * F.lit(1_000_000).cast("decimal(7,0)")).try_cast("decimal(24,0)")


def parsed_boolean(c: Column) -> Column:
    t = F.lower(outer_trim(c))
    return F.when(t.isin("true", "1"), "true").when(t.isin("false", "0"), "false")


def parsed_date(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """ISO text of a date that exists; a round trip tells dates that were bent to fit."""
    d = F.try_to_date(outer_trim(c), pattern)
    return F.when(F.date_format(d, pattern) == outer_trim(c), F.date_format(d, "yyyy-MM-dd"))


def parsed_instant(c: Column, pattern: str, zone: str) -> Column:
    """A local time of a zone as an instant in UTC, ISO text."""
    t = F.try_to_timestamp(outer_trim(c), F.lit(pattern))
    return F.date_format(F.to_utc_timestamp(t, zone), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_instant(c: Column) -> Column:
    """The instant, in UTC, of an ISO time with an offset, to the nanosecond; null for other texts. It is worked out without a zone, so the session's doesn't matter."""
    t = outer_trim(c)
    part = lambda n: F.regexp_extract(t, ISO_INSTANT, n)
    seconds = F.when(part(2) == "", "00").otherwise(part(2))
    local = F.concat(F.replace(part(1), F.lit("T"), F.lit(" ")), F.lit(":"), seconds).try_cast("timestamp_ntz")
    number = lambda n: F.coalesce(part(n).try_cast("int"), F.lit(0))
    offset = F.make_dt_interval(F.lit(0), number(5), number(6), number(7).cast("decimal(18,6)"))
    utc = F.when(part(4) == "-", local + offset).otherwise(local - offset).cast("string")
    fraction = F.regexp_replace(F.rpad(part(3), 9, "0"), "(000)+$", "")
    return F.when(t.rlike(ISO_INSTANT) & (number(5) * 60 + number(6) <= 18 * 60), F.concat(F.replace(utc, F.lit(" "), F.lit("T")), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z")))


def local_instant(c: Column, pattern: str, zone: str) -> Column:
    """A local time in a declared format and zone as an instant; null for times that were bent to fit."""
    t = F.try_to_timestamp(outer_trim(c), F.lit(pattern))
    return F.when(F.date_format(t, pattern) == outer_trim(c), parsed_instant(c, pattern, zone))


def date_error(c: Column, parsed: Column, pattern: str | None) -> Column:
    """Why a date or time wasn't read: in a declared format, or where it begins as an ISO date does, it doesn't exist; anything else could be read in more than one way."""
    unread = c.isNotNull() & parsed.isNull()
    if pattern is not None:
        return F.when(unread, "DATE_UNREADABLE")
    return F.when(unread & outer_trim(c).rlike(r"^\d{4}-\d{2}-\d{2}"), "DATE_UNREADABLE").when(unread, "DATE_AMBIGUOUS")


def split_record(line: Column, delimiter: str, quote: str | None) -> Column:
    """Fields of one physical line, null where a quote is left open or stands inside a plain field. A doubled quote inside quotes is one.

    Cut at quotes, every second piece lies inside them, and an empty piece between
    two of these is a doubled quote. Delimiters outside become an escape that no
    text holds, so the work is linear in the line, without patterns that repeat.
    """
    d = "\\" + delimiter
    if not quote:
        return F.split(line, d, -1)
    letters = [c for c in "abcd" if c not in (delimiter, quote)]
    escape, nul, cut = "\x00", "\x00" + letters[0], "\x00" + letters[1]
    pieces = F.split(F.replace(line, F.lit(escape), F.lit(nul)), "\\" + quote, -1)

    def read(x: Column) -> Column:
        p, n = x["p"], x["n"]
        inner = lambda s, i: (s == "") & (i > 0) & (i < n - 1)
        good = lambda s, i: (i % 2 == 1) | (s == "") | (((i == 0) | s.startswith(delimiter)) & ((i == n - 1) | s.endswith(delimiter)))
        text = F.array_join(F.transform(p, lambda s, i: F.when(i % 2 == 1, s).when(inner(s, i), quote).otherwise(F.replace(s, F.lit(delimiter), F.lit(cut)))), "")
        fields = F.transform(F.split(text, cut, -1), lambda f: F.replace(f, F.lit(nul), F.lit(escape)))
        judged = F.transform(p, lambda s, i: good(s, i))
        return F.when((n % 2 == 1) & ~F.exists(judged, lambda g: ~g), fields)

    quoted = F.transform(F.array(F.struct(pieces.alias("p"), F.size(pieces).alias("n"))), read)[0]
    return F.when(F.contains(line, F.lit(quote)), quoted).otherwise(F.split(line, d, -1))
