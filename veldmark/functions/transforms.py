"""Field transforms: each takes a value and gives (value, error code)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import exact_sum, fixed_units, product, quotient
from .text import date_error, iso_instant, local_instant, outer_trim, parsed_boolean, parsed_date, parsed_integer, plain_decimal, utf16_length


def _ok():
    return F.lit(None).cast("string")


def fixed(value: str):
    return F.lit(value), _ok()


def affix(c: Column, prefix: str = "", suffix: str = ""):
    """A null stays null."""
    return F.concat(F.lit(prefix), c, F.lit(suffix)), _ok()


def concat(columns: list[Column], separator: str = ""):
    """Nulls count as empty (concat_ws would skip them)."""
    parts = []
    for i, c in enumerate(columns):
        parts += ([F.lit(separator)] if i else []) + [F.coalesce(c, F.lit(""))]
    return F.concat(*parts), _ok()


def split_part(c: Column, separator: str, place: int):
    """The place-th part (from 1) at a literal separator; empty parts count."""
    part = F.try_element_at(F.split(c, re.escape(separator), -1), F.lit(place))
    return part, F.when(c.isNotNull() & part.isNull(), "TRANSFORM_FAILED")


def mapped(c: Column, table: dict[str, str], ignore_case: bool = False):
    """Exact first, then by lower case; what is unknown is an error."""
    if not table:
        return F.lit(None).cast("string"), F.when(c.isNotNull(), "MAPPING_VALUE_UNKNOWN")
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    value = F.try_element_at(pairs, c)
    if ignore_case:
        lower: dict[str, str] = {}
        for k, v in table.items():
            lower.setdefault(k.lower(), v)
        value = F.coalesce(value, F.try_element_at(F.create_map(*(F.lit(x) for kv in lower.items() for x in kv)), F.lower(c)))
    return value, F.when(c.isNotNull() & value.isNull(), "MAPPING_VALUE_UNKNOWN")


def arithmetic(c: Column, operation: str, operand: Column, places: int = 6, decimal_sep: str | None = None, grouping_sep: str | None = None):
    """add, subtract, multiply, divide or percentage on delivered numbers, as text. Sums keep the longer fraction; the others are rounded once, half up, to places (12 at most).

    Numbers have up to 18 digits before and 12 after the point; others, and results beyond what a decimal holds, are TRANSFORM_FAILED.
    """
    plain = [plain_decimal(x, decimal_sep, grouping_sep) for x in (c, operand)]
    x, y = map(fixed_units, plain)
    if operation in ("add", "subtract"):
        scale = F.greatest(*(F.length(F.split_part(p, F.lit("."), F.lit(2))) for p in plain))
        value = exact_sum(x, y if operation == "add" else -y, scale)
    elif operation == "multiply":
        value = product(x, y, places)
    else:
        value = quotient(x, y, places, hundreds=operation == "percentage")
    by_zero = F.lit(operation in ("divide", "percentage")) & (y == 0)
    return value, F.when(c.isNull(), None).when(x.isNull() | y.isNull(), "TRANSFORM_FAILED").when(by_zero, "TRANSFORM_DIVIDE_BY_ZERO").when(value.isNull(), "TRANSFORM_FAILED")


def defaulted(c: Column, default: str | Column):
    """Null (not empty) becomes the default."""
    return F.when(c.isNull(), default).otherwise(c), F.lit(None).cast("string")


def required_error(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), "VALUE_MISSING")


def length_error(length: Column, most: int) -> Column:
    return F.when(length > most, "VALUE_TOO_LONG")


@dataclass(frozen=True)
class Settings:
    """A parsed ``key=value`` text."""

    values: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str | None) -> "Settings":
        """Pairs parted by ``;``, the first ``=`` parts key from value; keys appear once."""
        values: dict[str, str] = {}
        for pair in filter(None, (text or "").split(";")):
            key, found, value = pair.partition("=")
            if not found or not key.strip():
                raise ValueError(f"setting without a value: {pair!r}")
            if key.strip() in values:
                raise ValueError(f"setting given twice: {key.strip()!r}")
            values[key.strip()] = value
        return cls(values)

    def items(self, key: str) -> list[str]:
        return self.values[key].split("|") if key in self.values else []

    def table(self, key: str) -> dict[str, str]:
        out = {}
        for item in self.items(key):
            left, found, right = item.partition(">")
            if not found:
                raise ValueError(f"no '>' in {item!r}")
            out[left] = right
        return out

    def check_used(self, known: set[str]) -> None:
        if unknown := sorted(set(self.values) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")


@dataclass(frozen=True)
class FieldMapping:
    """How a target field comes from the columns of a record; settings say what the kind of transform needs. Dates and times without a pattern are ISO ones; times with a pattern are local times of zone."""

    target: str
    source: str | None = None
    kind: str = "NONE"
    settings: str | None = None
    required: bool = False
    default: str | None = None
    longest: int | None = None
    type: str = "TEXT"  # or DECIMAL, INTEGER, DATE, DATETIME, BOOLEAN
    decimal_sep: str | None = None
    grouping_sep: str | None = None
    pattern: str | None = None
    zone: str | None = None


#: Kinds of transforms and the settings that they know.
KINDS = {
    "NONE": set(), "FIXED_VALUE": {"value"}, "PREFIX": {"prefix"}, "SUFFIX": {"suffix"}, "CONCAT": {"sources", "separator"}, "SPLIT": {"separator", "index"}, "MAP": {"values", "caseSensitive"},
    "ADD": {"operand", "operandField", "scale"}, "SUBTRACT": {"operand", "operandField", "scale"}, "MULTIPLY": {"operand", "operandField", "scale"}, "DIVIDE": {"operand", "operandField", "scale"}, "PERCENTAGE": {"base", "baseField", "scale"},
}


def transformed(m: FieldMapping) -> tuple[Column, Column]:
    """Value and error of a mapping's transform, from its settings. Settings that the kind doesn't know or lacks are errors of the plan."""
    if m.kind not in KINDS:
        raise ValueError(f"CONFIG_TRANSFORM_INVALID: {m.target}: {m.kind}")
    s = Settings.parse(m.settings)
    try:
        s.check_used(KINDS[m.kind])
        c = F.col(f"`{m.source}`") if m.source else F.lit(None).cast("string")
        if m.kind == "NONE":
            return c, _ok()
        if m.kind == "FIXED_VALUE":
            return fixed(s.values["value"])
        if m.kind in ("PREFIX", "SUFFIX"):
            return affix(c, s.values["prefix"], "") if m.kind == "PREFIX" else affix(c, "", s.values["suffix"])
        if m.kind == "CONCAT":
            return concat([F.col(f"`{x}`") for x in s.values["sources"].split("|")], s.values.get("separator", ""))
        if m.kind == "SPLIT":
            return split_part(c, s.values["separator"], int(s.values["index"]))
        if m.kind == "MAP":
            s.values["values"]
            return mapped(c, s.table("values"), s.values.get("caseSensitive", "false") != "true")
        key = "base" if m.kind == "PERCENTAGE" else "operand"
        if (key in s.values) == (f"{key}Field" in s.values):
            raise KeyError(key)
        operand = F.lit(s.values[key]) if key in s.values else F.col(f"`{s.values[f'{key}Field']}`")
        return arithmetic(c, m.kind.lower(), operand, int(s.values.get("scale", 6)), m.decimal_sep, m.grouping_sep)
    except (KeyError, ValueError) as e:
        raise ValueError(f"CONFIG_TRANSFORM_INVALID: {m.target}: {e}") from e


def default_applied(m: FieldMapping) -> Column:
    """Whether a record has the default of a mapping, as it has no value of its own (an empty one is a value)."""
    return F.lit(False) if m.default is None else transformed(m)[0].isNull()


def _instant(m: FieldMapping, value: Column) -> Column:
    if m.pattern is None:
        return iso_instant(value)
    # without a zone a local time is no instant; parsing it tells whether it exists
    return local_instant(value, m.pattern, m.zone or "UTC")


def field_of(m: FieldMapping) -> tuple[Column, Column]:
    """Canonical text and error code of a target field: transform, outer trim, default, required, length and type, in this order; the first error counts."""
    value, error = transformed(m)
    value = outer_trim(value)
    if m.default is not None:
        value = defaulted(value, outer_trim(F.lit(m.default)))[0]
    checks = [error]
    if m.required:
        checks.append(F.when(error.isNull(), required_error(value)))
    if m.longest is not None:
        checks.append(length_error(utf16_length(value), m.longest))
    given = value.isNotNull() & (value != "")
    typed = {
        "TEXT": lambda: value, "DECIMAL": lambda: plain_decimal(value, m.decimal_sep, m.grouping_sep), "INTEGER": lambda: parsed_integer(value), "DATE": lambda: parsed_date(value, m.pattern or "yyyy-MM-dd"), "DATETIME": lambda: _instant(m, value), "BOOLEAN": lambda: parsed_boolean(value),
    }[m.type]()
    if m.type in ("DATE", "DATETIME"):
        checks.append(date_error(F.when(given, value), typed, m.pattern))
        if m.type == "DATETIME" and m.pattern is not None and m.zone is None:
            checks.append(F.when(typed.isNotNull(), "DATE_AMBIGUOUS"))
    elif m.type not in ("TEXT", "DECIMAL"):  # amounts have codes of their own
        checks.append(F.when(given & typed.isNull(), "VALUE_TYPE_MISMATCH"))
    return (value if m.type == "DECIMAL" else typed), F.coalesce(*checks)
