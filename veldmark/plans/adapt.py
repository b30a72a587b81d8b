"""The driver's tables in the shapes of deliveries, states and observations.

A part is an offer: supplier S0 to S9, its brand as group, its key as
reference. What shipped last before the cutoff is the accepted price, what
shipped first from then on the delivered one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.functions import fingerprint as fp

CUTOFF = "1998-06-01"
WHOLE = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with amount in micro-units (prices have two places) and the ship date."""
    amount = F.round(F.col("l_extendedprice") * 100).cast("bigint") * 10_000
    return table(spark, sf, "lineitem").withColumn("amount", amount).withColumn("day", F.to_date("l_shipdate"))


def _offers(spark: SparkSession, sf: str, prices: DataFrame) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    rows = part.join(prices, part["p_partkey"] == prices["l_partkey"]).drop("l_partkey")
    supplier, reference = F.concat(F.lit("S"), (F.col("p_partkey") % 10).cast("string")), F.col("p_partkey").cast("string")
    return rows.select(F.col("p_partkey").alias("row_number"), supplier.alias("supplier"), F.col("p_brand").alias("grp"), reference.alias("reference"), F.col("p_name").alias("description"), F.col("amount").alias("base_price"), F.lit("EUR").alias("currency"))


def fingerprinted(offers: DataFrame) -> DataFrame:
    rows = offers.withColumn("identity_hash", fp.identity(1, F.col("supplier"), F.col("grp"), F.col("reference")))
    rows = rows.withColumn("article_fingerprint", fp.sha(fp.canonical(1, F.col("description")))).withColumn("price_fingerprint", fp.price(1, fp.amount_text(F.col("base_price")), F.col("currency")))
    return rows.withColumn("combined_fingerprint", fp.combined(F.col("identity_hash"), F.col("article_fingerprint"), F.col("price_fingerprint")))


def state(spark: SparkSession, sf: str) -> DataFrame:
    before = lines(spark, sf).where(F.col("day") < F.lit(CUTOFF).cast("date")).groupBy("l_partkey").agg(F.max_by("amount", F.struct(*WHOLE)).alias("amount"))
    return fingerprinted(_offers(spark, sf, before.where("l_partkey % 10 <> 7")))


def stage(spark: SparkSession, sf: str) -> DataFrame:
    """The delivery: a third of it repeats the accepted price, every eleventh has another description."""
    rows = lines(spark, sf)
    after = rows.where(F.col("day") >= F.lit(CUTOFF).cast("date")).groupBy("l_partkey").agg(F.min_by("amount", F.struct(*WHOLE)).alias("amount"))
    before = rows.where(F.col("day") < F.lit(CUTOFF).cast("date")).groupBy("l_partkey").agg(F.max_by("amount", F.struct(*WHOLE)).alias("old"))
    prices = after.join(before, "l_partkey", "left").select("l_partkey", F.when(F.col("l_partkey") % 3 == 0, F.coalesce("old", "amount")).otherwise(F.col("amount")).alias("amount"))
    offers = _offers(spark, sf, prices)
    return fingerprinted(offers.withColumn("description", F.when(F.col("row_number") % 11 == 0, F.concat("description", F.lit(" II"))).otherwise(F.col("description"))))


def observations(spark: SparkSession, sf: str, key: str) -> DataFrame:
    """identity_hash (a key of lineitem as text), component_code, observation_date, amount: the first of each day."""
    rows = lines(spark, sf).groupBy(F.col(key).cast("string").alias("identity_hash"), F.col("day").alias("observation_date")).agg(F.min_by("amount", F.struct(*WHOLE, "l_partkey")).alias("amount"))
    return rows.withColumn("component_code", F.lit("BASE"))


def references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """refs, own and holders: EANs of parts by remainders, so that all results occur."""
    key = F.col("p_partkey")
    part = table(spark, sf, "part").select("p_partkey")
    ident = key.cast("string").alias("identity_hash")
    value = F.when(key % 9 == 0, None).when(key % 7 == 0, F.concat(F.lit("E"), (key + 1).cast("string"))).when(key % 5 == 0, F.concat(F.lit("X"), key.cast("string"))).otherwise(F.concat(F.lit("E"), key.cast("string")))
    refs = part.select(key.alias("row_number"), ident, F.lit("EAN").alias("reference_type"), value.alias("value"), (key % 4 != 0).alias("known"))
    own = part.where("p_partkey % 4 <> 0 and p_partkey % 6 <> 0").select(ident, F.lit("EAN").alias("reference_type"), F.concat(F.lit("E"), key.cast("string")).alias("value"))
    twice = part.where("p_partkey % 4 <> 0 and p_partkey % 13 = 0").select(ident, F.lit("EAN").alias("reference_type"), F.concat(F.lit("E2-"), key.cast("string")).alias("value"))
    own = own.unionByName(twice)
    return refs, own, own


# The same shapes in SQL, to be put before a query.
LINES_SQL = "li as (select *, cast(round(l_extendedprice * 100) as bigint) * 10000 as amount, cast(l_shipdate as date) as day from lineitem)"
_ORDER = ", ".join(WHOLE)
_DOWN = ", ".join(f"{c} desc" for c in WHOLE)
_PRINTS = """select *, sha256(unhex(identity_hash) || unhex(article_fingerprint) || unhex(price_fingerprint)) as combined_fingerprint from (
  select *, sha256('1' || chr(31) || supplier || chr(31) || grp || chr(31) || reference) as identity_hash, sha256('1' || chr(31) || description) as article_fingerprint,
    sha256('1' || chr(31) || cast(base_price // 1000000 as varchar) || '.' || lpad(cast(base_price % 1000000 as varchar), 6, '0') || chr(31) || currency) as price_fingerprint from (
  select p_partkey as row_number, 'S' || cast(p_partkey % 10 as varchar) as supplier, p_brand as grp, cast(p_partkey as varchar) as reference, {description} as description, {amount} as base_price, 'EUR' as currency
  from part join {prices} on p_partkey = l_partkey {where}))"""
SHAPES_SQL = f"""with {LINES_SQL},
before as (select l_partkey, amount from li where day < date '{CUTOFF}' qualify row_number() over (partition by l_partkey order by {_DOWN}) = 1),
after as (select l_partkey, amount from li where day >= date '{CUTOFF}' qualify row_number() over (partition by l_partkey order by {_ORDER}) = 1),
delivered as (select a.l_partkey, case when a.l_partkey % 3 = 0 then coalesce(b.amount, a.amount) else a.amount end as amount from after a left join before b on a.l_partkey = b.l_partkey),
state as ({_PRINTS.format(description="p_name", amount="amount", prices="before", where="where p_partkey % 10 <> 7")}),
stage as ({_PRINTS.format(description="case when p_partkey % 11 = 0 then p_name || ' II' else p_name end", amount="amount", prices="delivered", where="")}),
beside as (select g.*, s.identity_hash is not null as known, s.base_price as old_base_price, s.currency as old_currency, s.article_fingerprint as old_article_fingerprint, s.combined_fingerprint as old_combined_fingerprint,
  case when s.identity_hash is null then 'NEW' when s.combined_fingerprint = g.combined_fingerprint then 'UNCHANGED' else 'CHANGED' end as classification from stage g left join state s on g.identity_hash = s.identity_hash)
"""
OBSERVATIONS_SQL = LINES_SQL + """, obs as (select cast({key} as varchar) as identity_hash, day as observation_date, amount from li qualify row_number() over (partition by {key}, day order by """ + _ORDER + """, l_partkey) = 1)"""
REFERENCES_SQL = """with refs as (select p_partkey as row_number, cast(p_partkey as varchar) as identity_hash, case when p_partkey % 9 = 0 then null when p_partkey % 7 = 0 then 'E' || cast(p_partkey + 1 as varchar)
  when p_partkey % 5 = 0 then 'X' || cast(p_partkey as varchar) else 'E' || cast(p_partkey as varchar) end as value, p_partkey % 4 <> 0 as known from part),
own as (select cast(p_partkey as varchar) as identity_hash, 'E' || cast(p_partkey as varchar) as value from part where p_partkey % 4 <> 0 and p_partkey % 6 <> 0
  union all select cast(p_partkey as varchar), 'E2-' || cast(p_partkey as varchar) from part where p_partkey % 4 <> 0 and p_partkey % 13 = 0)"""
