"""Helpers on array columns whose work follows the array's length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """then(value), with value worked out once a row, and not in each turn of a lambda inside then."""
    return F.transform(F.array(value), then)[0]


def starts_of(lengths: Column) -> Column:
    """For each of the lengths (an array of ints) the sum of those before it.

    Blocks of about the square root of the array are summed alone and then shifted, so
    10,000 lengths cost 10,000 times 100 steps; to append one by one would copy all before each.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    before = lambda a: F.transform(a, lambda x, i: total(F.slice(a, 1, i)))

    def of(a: Column) -> Column:
        def cut(width: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")), lambda b: F.slice(a, b * width + 1, width))

            def put(blocks: Column) -> Column:
                shifts = let(F.transform(blocks, total), before)
                return F.flatten(F.zip_with(F.transform(blocks, lambda b: before(b)), shifts, lambda b, shift: F.transform(b, lambda x: x + shift)))

            return let(blocks, put)

        return F.when(F.size(a) > 0, let(F.ceil(F.sqrt(F.size(a))).cast("int"), cut)).otherwise(F.array().cast("array<int>"))

    return let(lengths, of)
