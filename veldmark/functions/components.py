"""Price components of an offer: what it has beside its base price, held as one nested list a row, in order of code."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import SHARE_UNIT

#: amount in micro-units, share of the base price in 10^-12 percent.
TYPE = "array<struct<component_code: string, amount: decimal(24,0), share: decimal(38,0), currency: string>>"
#: The code under which base prices are observed and controlled.
BASE = "BASE"


@dataclass(frozen=True)
class PriceComponent:
    """A component that deliveries may have: its code and the target field of its amount, that of its currency if it comes with one, the largest share that is taken, and whether it may be zero or negative. An offer without a value just lacks the component; a mapping that is required refuses it."""

    code: str
    target: str
    currency: str | None = None
    most_percent: int | Decimal | None = None
    allow_zero: bool = False
    allow_negative: bool = False


def _empty() -> Column:
    return F.array().cast(TYPE)


def listed(parts: list[tuple[str, Column, Column]], currency: Column) -> Column:
    """The list of (code, amount, share) for which there is an amount."""
    if not parts:
        return _empty()
    kept = [F.when(amount.isNotNull(), F.struct(F.lit(code).alias("component_code"), amount.alias("amount"), share.alias("share"), currency.alias("currency"))) for code, amount, share in sorted(parts, key=lambda p: p[0])]
    return F.filter(F.array(*kept), lambda c: c.isNotNull()).cast(TYPE)


def share_text(share: Column) -> Column:
    """A share as a percentage with twelve places."""
    digits = F.abs(share).cast("string")
    digits = F.lpad(digits, F.greatest(F.length(digits), F.lit(13)), F.lit("0"))
    return F.concat(F.when(share < 0, "-").otherwise(""), F.left(digits, F.length(digits) - 12), F.lit("."), F.right(digits, F.lit(12)))


def printed(components: Column) -> Column:
    """The list as price fingerprints take it."""
    return F.transform(components, lambda c: F.struct(c["component_code"].alias("code"), share_text(c["share"]).alias("percentage")))


def of_code(components: Column, code: Column) -> Column:
    """The component of a code, null where the list has none."""
    return F.get(F.filter(components, lambda c: c["component_code"] == code), F.lit(0))


def changed_codes(new: Column, old: Column, assumed: Column) -> Column:
    """Codes, in order, that came, went, or have another share or currency. A currency that isn't known is no change beside one that is only assumed."""
    new, old = F.coalesce(new, _empty()), F.coalesce(old, _empty())
    codes = F.array_sort(F.array_union(F.transform(new, lambda c: c["component_code"]), F.transform(old, lambda c: c["component_code"])))

    def differs(code: Column) -> Column:
        a, b = of_code(new, code), of_code(old, code)
        same_currency = a["currency"].eqNullSafe(b["currency"]) | (b["currency"].isNull() & assumed)
        return ~(a.isNotNull() & b.isNotNull() & a["share"].eqNullSafe(b["share"]) & same_currency)

    return F.filter(codes, differs)


def share_limit(percent: int | Decimal) -> Column:
    return F.lit(str(int(Decimal(str(percent)) * SHARE_UNIT))).cast("decimal(38,0)")
