"""Price observations, their averages, and the deviation control."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldmark.functions import components as parts_of
from veldmark.functions.numeric import SHARE_UNIT, half_up_mean, half_up_percent, round_half_up, whole_quotient

KEY = ["identity_hash", "component_code"]


def averages(observations: DataFrame, wanted: DataFrame | None = None, short: int = 50, long: int = 200) -> DataFrame:
    """avg_short and avg_long of the latest observations of each key (micro-units, half up), from one ranked pass over wanted keys only."""
    rows = observations if wanted is None else observations.join(wanted.select(*KEY).distinct(), KEY, "left_semi")
    latest = Window.partitionBy(*KEY).orderBy(F.desc("observation_date"))
    ranked = rows.withColumn("rn", F.row_number().over(latest)).where(F.col("rn") <= max(short, long))
    total = lambda k: F.sum(F.when(F.col("rn") <= k, F.col("amount")))
    count = lambda k: F.count(F.when(F.col("rn") <= k, F.col("amount")))
    return ranked.groupBy(*KEY).agg(half_up_mean(total(short), count(short)).alias("avg_short"), half_up_mean(total(long), count(long)).alias("avg_long"))


VALUES = "array<struct<observation_date: date, amount: decimal(24,0)>>"


def latest_values(observations: DataFrame, most: int = 200) -> DataFrame:
    """The latest observations of each key as one bounded list, the newest first: KEY and ``values``."""
    latest = Window.partitionBy(*KEY).orderBy(F.desc("observation_date"))
    rows = observations.withColumn("rn", F.row_number().over(latest)).where(F.col("rn") <= most)
    value = F.struct("observation_date", F.col("amount").cast("decimal(24,0)").alias("amount"))
    return rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(value), asc=False).cast(VALUES).alias("values"))


def with_observations(latest: DataFrame, new: DataFrame, most: int = 200) -> DataFrame:
    """The lists of the keys that new observations (one a key and day) bear on, with these. A day that has a value keeps it; lists stay bounded, so no history is read."""
    lists = latest_values(new, most).withColumnRenamed("values", "incoming")
    rows = lists.join(latest.select(*KEY, "values"), KEY, "left").withColumn("values", F.coalesce("values", F.array().cast(VALUES)))
    days = F.transform("values", lambda v: v["observation_date"])
    fresh = F.filter("incoming", lambda v: ~F.array_contains(days, v["observation_date"]))
    return rows.select(*KEY, F.slice(F.sort_array(F.concat("values", fresh), asc=False), 1, most).alias("values"))


def averages_of(latest: DataFrame, short: int = 50, long: int = 200) -> DataFrame:
    """avg_short and avg_long from lists of latest values: what ``averages`` says of the whole history."""

    def mean(k: int) -> Column:
        part = F.slice("values", 1, k)
        total = F.aggregate(part, F.lit(0).cast("decimal(38,0)"), lambda s, v: (s + v["amount"]).cast("decimal(38,0)"))
        return half_up_mean(total, F.size(part))

    return latest.where(F.size("values") > 0).select(*KEY, mean(short).alias("avg_short"), mean(long).alias("avg_long"))


def deviation(new: Column, reference: Column) -> Column:
    """(new - reference) * 100 / reference in 10^-12 percent; null without a usable reference."""
    return half_up_percent(new - reference, reference)


def control(rows: DataFrame, limit_percent: int | Decimal) -> DataFrame:
    """Deviations from previous, avg_short and avg_long; strictly beyond the limit is exceeded, the first exceeded tells the direction."""
    names = ("previous", "avg_short", "avg_long")
    out = rows
    for n in names:
        out = out.withColumn(f"dev_{n}", deviation(F.col("amount"), F.col(n)))
    limit = F.lit(int(Decimal(str(limit_percent)) * SHARE_UNIT)).cast("decimal(38,0)")
    hits = [F.coalesce(F.abs(F.col(f"dev_{n}")) > limit, F.lit(False)) for n in names]
    direction = None
    for n, hit in zip(names, hits, strict=True):
        way = F.when(F.col(f"dev_{n}") < 0, "DOWN").otherwise("UP")
        direction = F.when(hit, way) if direction is None else direction.when(hit, way)
    return out.withColumn("exceeded", hits[0] | hits[1] | hits[2]).withColumn("direction", direction)


def missing_references(rows: DataFrame) -> DataFrame:
    """One row: evaluated, and how many lack each reference (null or zero)."""
    lacks = lambda c: F.count_if(F.col(c).isNull() | (F.col(c) == 0)).alias(f"no_{c}")
    return rows.agg(F.count(F.lit(1)).alias("evaluated"), lacks("previous"), lacks("avg_short"), lacks("avg_long"))


def values_of(staged: DataFrame) -> DataFrame:
    """row_number, identity_hash, component_code, amount and previous (the accepted amount): one row for the base price of each staged row and, where rows carry components, one for each of these."""
    base = F.struct(F.lit(parts_of.BASE).alias("component_code"), F.col("base_price").cast("decimal(24,0)").alias("amount"), F.col("old_base_price").cast("decimal(24,0)").alias("previous"))
    values = F.array(base)
    if "components" in staged.columns:
        own = lambda c: F.struct(c["component_code"].alias("component_code"), c["amount"].alias("amount"), parts_of.of_code(F.col("old_components"), c["component_code"])["amount"].alias("previous"))
        values = F.concat(values, F.transform("components", own))
    return staged.select("row_number", "identity_hash", F.inline(values))


def component_share(amount: Column, base: Column) -> Column:
    """Share of a component in 10^-12 percent; null without a base price, which rejects the row."""
    return half_up_percent(amount, base)


def derivation_holds(amount: Column, base: Column, share: Column, tolerance: int = 10_000) -> Column:
    """Whether base * share gives the amount again, both rounded to cents, within a tolerance in micro-units. What is too large to work out doesn't hold.

    Whole percents and the rest of a share are multiplied apart: one product would have more digits than a decimal holds.
    """
    size, parts = F.abs(base).cast("decimal(24,0)"), F.abs(share).cast("decimal(38,0)")
    rest = parts % F.lit(SHARE_UNIT)
    percents = ((parts - rest) / F.lit(SHARE_UNIT)).try_cast("decimal(38,0)")
    whole = F.try_multiply(size, percents).try_cast("decimal(38,0)")  # in millionths of a cent
    fine = F.try_multiply(size, rest.cast("decimal(12,0)")).try_cast("decimal(38,0)")  # in 10^-18 of one
    a, a_left = whole_quotient(whole, F.lit(1_000_000).cast("decimal(7,0)"))
    b, b_left = whole_quotient(fine, F.lit("1" + 18 * "0").cast("decimal(19,0)"))
    left = (a_left.cast("decimal(6,0)") * F.lit(SHARE_UNIT) + b_left.cast("decimal(18,0)") + F.lit(5 * 10**17)).cast("decimal(19,0)")  # and half a cent, to round
    cents = (a + b + F.floor(left / F.lit("1" + 18 * "0").cast("decimal(19,0)"))) * F.when((base < 0) != (share < 0), -1).otherwise(1)
    return F.coalesce(F.abs(cents - round_half_up(amount, 10_000)) * 10_000 <= tolerance, F.lit(False))


def base_price_error(amount: Column, allow_zero: bool = False, allow_negative: bool = False) -> Column:
    zero = F.when(amount == 0, F.lit(None if allow_zero else "PRICE_ZERO_NOT_ALLOWED"))
    return F.coalesce(zero, F.when(amount < 0, F.lit(None if allow_negative else "PRICE_NEGATIVE_NOT_ALLOWED")))


def currency(source: Column, link_default: str | None = None) -> tuple[Column, Column, Column]:
    """Effective currency, its origin, and how fingerprints see it: an assumed euro is null there."""
    link = F.lit(link_default).cast("string")
    origin = F.when(source.isNotNull(), "SOURCE").when(link.isNotNull(), "LINK_DEFAULT").otherwise("SYSTEM_DEFAULT")
    return F.coalesce(source, link, F.lit("EUR")), origin, F.coalesce(source, link)


def day_series(values: DataFrame, day: str, order: list[str]) -> DataFrame:
    """One observation for each key and day: the first of the day."""
    first = Window.partitionBy(*KEY, day).orderBy(*order)
    return values.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
