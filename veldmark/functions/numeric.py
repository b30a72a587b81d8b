"""Exact decimal arithmetic on amounts held as whole micro-units (one millionth) in longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000
#: Shares and deviations are percentages at twelve places, held as whole 10^-12 units in decimal(38,0).
SHARE_UNIT = 10**12


def _wide(c: Column) -> Column:
    return F.abs(c.cast("decimal(25,0)"))


def _int(n: int) -> Column:
    return F.lit(str(n)).cast(f"decimal({len(str(n))},0)")


def whole_quotient(x: Column, y: Column) -> tuple[Column, Column]:
    """Quotient and remainder of whole numbers that aren't negative; null where y is 0 or the quotient has more than 32 digits."""
    y = F.nullif(y, F.lit(0))
    return F.try_divide(x - x % y, y).try_cast("decimal(38,0)"), x % y


#: Percentages from here on are held as this one: no limit is that high.
MOST_SHARE = 10**37


def half_up_percent(numerator: Column, denominator: Column) -> Column:
    """numerator * 100 / denominator at twelve places, half up, as whole 10^-12 units; null where the denominator is null or 0.

    Amounts have up to 25 digits. Long division in whole numbers: decimal division
    loses the scale, and one product would have more digits than a decimal holds.
    """
    den = _wide(denominator)
    whole, rest = whole_quotient(_wide(numerator) * _int(100), den)
    fraction, rest = whole_quotient((rest * _int(SHARE_UNIT)).cast("decimal(38,0)"), den)
    up = F.when(rest * 2 >= den, 1).otherwise(0)
    total = F.try_add(F.try_multiply(whole, _int(SHARE_UNIT)).try_cast("decimal(38,0)"), (fraction + up).cast("decimal(38,0)")).try_cast("decimal(38,0)")
    size = F.least(F.coalesce(total, _int(MOST_SHARE).cast("decimal(38,0)")), _int(MOST_SHARE).cast("decimal(38,0)"))
    sign = F.signum(numerator.cast("double")) * F.signum(denominator.cast("double"))
    return F.when(numerator.isNotNull() & denominator.isNotNull() & (denominator != 0), size * sign.cast("decimal(1,0)")).cast("decimal(38,0)")


def half_up_mean(total: Column, count: Column) -> Column:
    """total / count of micro-units, half up (away from zero) to a whole micro-unit; null without rows."""
    whole, rest = whole_quotient(F.abs(total).cast("decimal(34,0)"), count.cast("decimal(19,0)"))
    size = whole + F.when(rest * 2 >= count, 1).otherwise(0)
    return F.when(count > 0, F.when(total < 0, -size).otherwise(size)).cast("bigint")


def round_half_up(value: Column, unit: int) -> Column:
    """A whole number to the nearest multiple of unit, half away from zero, in multiples of unit."""
    whole, rest = whole_quotient(F.abs(value).cast("decimal(38,0)"), _int(unit))
    size = whole + F.when(rest * 2 >= _int(unit), 1).otherwise(0)
    return F.when(value < 0, -size).otherwise(size).cast("decimal(38,0)")


PLACES = 12
UNIT = 10**PLACES
_HALF = 10**15


def fixed_units(plain: Column) -> Column:
    """A plain decimal (text) in whole 10^-12 units; null with more than 18 digits before or 12 after the point."""
    digits = F.regexp_replace(F.regexp_replace(plain, r"^-?0*", ""), r"(\.\d*?)0+$", "$1")
    fits = (F.length(F.split_part(digits, F.lit("."), F.lit(1))) <= 18) & (F.length(F.split_part(digits, F.lit("."), F.lit(2))) <= PLACES)
    return F.when(fits, (plain.try_cast("decimal(30,12)") * _int(UNIT)).try_cast("decimal(30,0)"))


def _shown(units: Column, up: Column, places: int, negative: Column) -> Column:
    """Units of 10^-12 as text with so many places, half up; up: whether the digits beyond the twelfth are half or more."""
    step = _int(10 ** (PLACES - places))
    whole, rest = whole_quotient(units, step)
    beyond = (rest * 2 >= step) if places < PLACES else up
    whole = whole + F.when(beyond, 1).otherwise(0)
    front, back = whole_quotient(whole.cast("decimal(38,0)"), _int(10**places))
    number = front.cast("string") if not places else F.concat(front.cast("string"), F.lit("."), F.lpad(back.cast("decimal(38,0)").cast("string"), places, "0"))
    return F.when(negative & (whole > 0), F.concat(F.lit("-"), number)).otherwise(number)


def product(x: Column, y: Column, places: int) -> Column:
    """x * y of 10^-12 units as text, half up to places; null if it is too large. Halves of 15 digits keep all 60 digits of the product."""
    a, b = F.abs(x), F.abs(y)
    (a1, a0), (b1, b0) = whole_quotient(a, _int(_HALF)), whole_quotient(b, _int(_HALF))
    a1, a0, b1, b0 = (c.cast("decimal(15,0)") for c in (a1, a0, b1, b0))
    low, rest = whole_quotient((a0 * b0).cast("decimal(30,0)"), _int(UNIT))
    high = F.try_multiply((a1 * b1).cast("decimal(30,0)"), _int(10**18)).try_cast("decimal(38,0)")
    middle = ((a1 * b0 + a0 * b1).cast("decimal(31,0)") * _int(1000)).cast("decimal(38,0)")
    units = F.try_add(F.try_add(high, middle).try_cast("decimal(38,0)"), low).try_cast("decimal(37,0)")
    return _shown(units, rest * 2 >= _int(UNIT), places, (x < 0) != (y < 0))


def quotient(x: Column, y: Column, places: int, hundreds: bool = False) -> Column:
    """x / y (hundreds: x * 100 / y) as text, half up to places; null where y is 0 or the result is too large. Long division by six digits at a time."""
    a, b = F.abs(x).cast("decimal(30,0)"), F.abs(y).cast("decimal(30,0)")
    if hundreds:
        a = (a * _int(100)).cast("decimal(32,0)")
    whole, rest = whole_quotient(a, b)
    first, rest = whole_quotient((rest.cast("decimal(30,0)") * _int(10**6)).cast("decimal(36,0)"), b)
    second, rest = whole_quotient((rest.cast("decimal(30,0)") * _int(10**6)).cast("decimal(36,0)"), b)
    tail = (first.cast("decimal(6,0)") * _int(10**6) + second.cast("decimal(6,0)")).cast("decimal(13,0)")
    units = F.try_add(F.try_multiply(whole, _int(UNIT)).try_cast("decimal(38,0)"), tail).try_cast("decimal(37,0)")
    return _shown(units, rest * 2 >= b, places, (x < 0) != (y < 0))


def exact_sum(x: Column, y: Column, places: Column) -> Column:
    """x + y of 10^-12 units as text with so many places, which lose nothing."""
    total = (x + y).cast("decimal(31,0)")
    text = _shown(F.abs(total), F.lit(False), PLACES, total < 0)
    return F.when(places == 0, F.substring_index(text, ".", 1)).otherwise(F.substring(text, F.lit(1), F.length(text) - PLACES + places))
