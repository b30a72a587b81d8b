"""Record filters: ordered rules, the first exclusion or rejection decides, inclusions are an allow-list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import outer_trim

OPERATORS = ("EQUALS", "NOT_EQUALS", "BEGINS_WITH", "ENDS_WITH", "CONTAINS", "NOT_CONTAINS")


@dataclass(frozen=True)
class RecordFilter:
    action: str  # INCLUDE, EXCLUDE or REJECT
    column: str
    operator: str
    value: str
    ignore_case: bool = False
    trim: bool = False
    on_null: str = "COMPARE_AS_EMPTY"  # or EXCLUDE, REJECT
    on_missing: str = "BLOCK"  # or EXCLUDE, REJECT


def matches(f: RecordFilter, c: Column) -> Column:
    left, right = F.coalesce(c, F.lit("")), f.value
    if f.trim:
        left, right = outer_trim(left), right.strip("".join(map(chr, range(33))))
    if f.ignore_case:
        left, right = F.lower(left), right.lower()
    found = {"EQUALS": left == right, "BEGINS_WITH": left.startswith(right), "ENDS_WITH": left.endswith(right), "CONTAINS": left.contains(right)}
    return ~found[f.operator.removeprefix("NOT_")] if f.operator.startswith("NOT_") else found[f.operator]


def decision(filters: list[RecordFilter], columns: list[str]) -> Column:
    """KEEP, EXCLUDE or REJECT. A missing column under BLOCK is an error of the plan, not of a row."""
    out, allowed, lists = None, F.lit(False), False
    for f in filters:
        if f.column not in columns:
            if f.on_missing == "BLOCK":
                raise ValueError(f"FILTER_COLUMN_MISSING: {f.column}")
            hit, verdict = F.lit(True), f.on_missing
            out = F.when(hit, verdict) if out is None else out.when(hit, verdict)
            continue
        c = F.col(f"`{f.column}`")
        if f.on_null != "COMPARE_AS_EMPTY":
            empty = c.isNull() | (c == "")
            out = F.when(empty, f.on_null) if out is None else out.when(empty, f.on_null)
        if f.action == "INCLUDE":
            lists, allowed = True, allowed | matches(f, c)
        else:
            out = F.when(matches(f, c), f.action) if out is None else out.when(matches(f, c), f.action)
    last = F.when(allowed, "KEEP").otherwise("EXCLUDE") if lists else F.lit("KEEP")
    return last if out is None else out.otherwise(last)


def file_selected(name: Column, groups: list[list[tuple[str, str]]], ignore_case: bool = True) -> Column:
    """Or over groups, and inside a group, of (equals|starts|ends|contains|extension, value). No groups select all."""
    n = F.lower(name) if ignore_case else name
    fold = (lambda v: v.lower()) if ignore_case else (lambda v: v)
    test = {"equals": lambda v: n == v, "starts": lambda v: n.startswith(v), "ends": lambda v: n.endswith(v), "contains": lambda v: n.contains(v), "extension": lambda v: n.endswith("." + v.lstrip("."))}
    any_group = F.lit(not groups)
    for group in groups:
        every = F.lit(True)
        for kind, value in group:
            every = every & test[kind](fold(value))
        any_group = any_group | every
    return any_group
