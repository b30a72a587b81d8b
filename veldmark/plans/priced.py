"""A delivery with two price components, a reference type and observations, screened from its file on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldmark.functions import components as parts_of
from veldmark.functions import fingerprint as fp
from veldmark.functions.components import PriceComponent
from veldmark.functions.transforms import FieldMapping
from veldmark.operators import delta, prices, screening, state
from veldmark.plans import adapt
from veldmark.plans.catalog import query
from veldmark.plans.places import folder
from veldmark.sources.delimited import Structure, write_parts

AMOUNT = {"type": "DECIMAL", "decimal_sep": "."}
PROFILE = screening.Profile(
    structure=Structure(("SUP", "GRP", "REF", "NAME", "PRICE", "COST", "SALE", "EAN"), in_parts=True),
    mappings=(
        FieldMapping("supplier", "SUP"), FieldMapping("grp", "GRP"), FieldMapping("reference", "REF"), FieldMapping("description", "NAME"), FieldMapping("base_price", "PRICE", **AMOUNT),
        FieldMapping("AKP", "COST", **AMOUNT), FieldMapping("VKP", "SALE", **AMOUNT), FieldMapping("EAN", "EAN"),
    ),
    components=(PriceComponent("VKP", "VKP", most_percent=131), PriceComponent("AKP", "AKP")), reference_types=("EAN",), version=2, link_currency="EUR",
    short=5, long=20, deviation_percent=20, bulk_percent=100, critical_percent=None, creation_percent=100,
)


def _part(base: str, percent: str) -> str:
    """So many percent of a base price, in whole cents (micro-units)."""
    return f"((({base}) div 10000) * ({percent})) div 100 * 10000"


def _delivered(spark, sf: str) -> DataFrame:
    rows = adapt.stage(spark, sf).select("row_number", "supplier", "grp", "reference", "description", "base_price")
    rows = rows.withColumn("AKP", F.expr(f"if(row_number % 10 = 4, null, {_part('base_price', '60 + row_number % 25')})")).withColumn("VKP", F.expr(_part("base_price", "110 + row_number % 23")))
    return rows.withColumn("EAN", F.when(F.col("row_number") % 19 != 0, F.concat(F.lit("E"), "reference")))


def accepted(spark, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State, observations and active references."""
    rows = adapt.state(spark, sf).select("row_number", "supplier", "grp", "reference", "description", "base_price").withColumnRenamed("row_number", "line")
    rows = rows.withColumn("AKP", F.expr(f"if(line % 10 = 5, null, {_part('base_price', '60 + line % 25 + if(line % 6 = 0, 1, 0)')})")).withColumn("VKP", F.expr(_part("base_price", "110 + line % 23")))
    parts = [(c, F.col(c).cast("decimal(24,0)"), prices.component_share(F.col(c), F.col("base_price"))) for c in ("AKP", "VKP")]
    rows = rows.withColumn("base_price", F.col("base_price").cast("decimal(24,0)")).withColumn("EAN", F.concat(F.lit("E"), "reference")).withColumn("components", parts_of.listed(parts, F.lit("EUR")))
    none = F.lit(None).cast("string")
    rows = screening.normalised(rows.withColumn("route", none).withColumn("code", none).withColumn("field", none), PROFILE)
    known = rows.select("identity_hash", *delta.STATE_COLUMNS, "components", *screening.IDENTITY)
    active = rows.select("identity_hash", F.lit("EAN").alias("reference_type"), F.col("EAN").alias("value"))
    part = adapt.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"), fp.identity(2, F.concat(F.lit("S"), (F.col("p_partkey") % 10).cast("string")), F.col("p_brand"), F.col("p_partkey").cast("string")).alias("identity_hash"))
    seen = adapt.observations(spark, sf, "l_partkey").withColumnRenamed("identity_hash", "key").join(part, "key")
    both = F.array(F.struct(F.lit("BASE").alias("component_code"), F.col("amount").cast("decimal(24,0)").alias("amount")), F.struct(F.lit("AKP").alias("component_code"), F.expr("amount div 10 * 7").cast("decimal(24,0)").alias("amount")))
    return known, seen.select("identity_hash", "observation_date", F.inline(both)).select("identity_hash", "component_code", "observation_date", "amount"), active


def screened(spark, sf: str) -> tuple[screening.Screened, DataFrame, DataFrame]:
    """The run, the state and the observations that it was screened against."""
    path = folder(spark, "priced")
    k = F.col("row_number")
    amount = lambda c: F.coalesce(fp.amount_text(F.col(c)), F.lit(""))
    fields = ["supplier", "grp", "reference", "description", amount("base_price"), amount("AKP"), F.when(k % 17 == 0, "x1").otherwise(amount("VKP")), F.coalesce("EAN", F.lit(""))]
    rows = _delivered(spark, sf).select("row_number", F.concat_ws(";", *fields).alias("value"))
    header = spark.createDataFrame([(-1, "SUP;GRP;REF;NAME;PRICE;COST;SALE;EAN")], "row_number long, value string")
    write_parts(header.unionByName(rows), "row_number", f"{path}/in")
    tables = []
    for name, rows in zip(("state", "observations", "references"), accepted(spark, sf), strict=True):
        rows.write.parquet(f"{path}/{name}")
        tables.append(spark.read.parquet(f"{path}/{name}"))
    return screening.screen(spark, f"{path}/in", PROFILE, tables[0], tables[1], path, tables[2]), tables[0], tables[1]


def _part_sql(base: str, percent: str) -> str:
    return f"({base} // 10000 * ({percent})) // 100 * 10000"


def _share_sql(amount: str, base: str) -> str:
    return f"({amount}::hugeint * 200000000000000 + {base}) // (2 * {base}::hugeint)"


def _share_text_sql(share: str) -> str:
    return f"cast({share} // 1000000000000 as varchar) || '.' || lpad(cast({share} % 1000000000000 as varchar), 12, '0')"


_MEAN = "(2 * sum(amount) filter (rn <= {k})::hugeint + count(*) filter (rn <= {k})) // (2 * count(*) filter (rn <= {k}))"
_LISTED = f"concat_ws(',', 'AKP=' || {_share_text_sql('{p}akp_share')}, 'VKP=' || {_share_text_sql('{p}vkp_share')})"
#: n: delivered rows beside the state (old_*), v: those that are valid, m: with class and mask, values: what is compared.
PRICED = adapt.SHAPES_SQL + f""", new_ as (select row_number as k, supplier, grp, reference, description, base_price, case when row_number % 10 <> 4 then {_part_sql('base_price', '60 + row_number % 25')} end as akp, {_part_sql('base_price', '110 + row_number % 23')} as vkp from stage),
old_ as (select row_number as old_k, supplier as old_supplier, grp as old_grp, description as old_description, base_price as old_base, case when row_number % 10 <> 5 then {_part_sql('base_price', '60 + row_number % 25 + case when row_number % 6 = 0 then 1 else 0 end')} end as old_akp, {_part_sql('base_price', '110 + row_number % 23')} as old_vkp from state),
n as (select *, {_share_sql('akp', 'base_price')} as akp_share, {_share_sql('vkp', 'base_price')} as vkp_share from new_),
o as (select *, {_share_sql('old_akp', 'old_base')} as old_akp_share, {_share_sql('old_vkp', 'old_base')} as old_vkp_share from old_),
b as (select * from n left join o on k = old_k), v as (select * from b where k % 17 <> 0 and vkp_share <= 131000000000000),
c as (select *, case when old_k is null then 'NEW' when description = old_description and base_price = old_base and akp_share is not distinct from old_akp_share and vkp_share = old_vkp_share and k % 19 <> 0 then 'UNCHANGED' else 'CHANGED' end as class from v),
m as (select *, case when class = 'CHANGED' then nullif(concat_ws(',', case when description <> old_description then 'ARTICLE' end, case when base_price <> old_base then 'PRICE' end, case when akp_share is distinct from old_akp_share then 'PRICE:AKP' end, case when vkp_share is distinct from old_vkp_share then 'PRICE:VKP' end), '') end as mask, {_LISTED.format(p='')} as components from c),
obs as (select l_partkey as key, day, amount from li qualify row_number() over (partition by l_partkey, day order by {', '.join(adapt.WHOLE)}) = 1),
both_ as (select key, 'BASE' as code, day, amount from obs union all select key, 'AKP', day, amount // 10 * 7 from obs),
avgs as (select key, code, {_MEAN.format(k=5)} as a5, {_MEAN.format(k=20)} as a20 from (select *, row_number() over (partition by key, code order by day desc) as rn from both_) group by 1, 2),
compared as (select k, 'BASE' as code, 'base_price' as field, base_price as amount, old_base as previous from m where class <> 'UNCHANGED' union all select k, 'AKP', 'AKP', akp, old_akp from m where class <> 'UNCHANGED' and akp is not null union all select k, 'VKP', 'VKP', vkp, old_vkp from m where class <> 'UNCHANGED'),
far as (select x.k, x.field, case when abs(amount - previous) * 100 > 20 * previous then amount < previous when abs(amount - a5) * 100 > 20 * a5 then amount < a5 when abs(amount - a20) * 100 > 20 * a20 then amount < a20 end as down
  from compared x left join avgs a on a.key = x.k and a.code = x.code where previous is null or previous <> amount)
"""


@query("screening_components", PRICED + """select reference, case class when 'NEW' then 'CREATE' else 'UPDATE' end as action, case when class = 'CHANGED' and k % 19 = 0 then 'BLOCKED' else 'PLANNED' end as status, mask, components from m where class <> 'UNCHANGED'
union all select reference, 'IDENTITY_REFERENCE_INCIDENT', 'AWAITING_APPROVAL', null, components from m where class = 'CHANGED' and k % 19 = 0""")
def _(spark, sf):
    """Mutations of a delivery with components, a critical reference and a history."""
    run, _, _ = screened(spark, sf)
    listed = F.array_join(F.transform("components", lambda c: F.concat_ws("=", c["component_code"], parts_of.share_text(c["share"]))), ",")
    return run.mutations.join(run.staged.select("row_number", "reference", listed.alias("components")), "row_number").select("reference", "action", "status", "mask", "components")


@query("screening_component_issues", PRICED + """, i as (select case when k % 17 = 0 then 'PRICE_UNREADABLE' else 'PRICE_PERCENTAGE_OUT_OF_RANGE' end as code, 'FIELD=VKP' as signature from b where k % 17 = 0 or vkp_share > 131000000000000
  union all select 'PRICE_DEVIATION_EXCEEDED', 'FIELD=' || field || '|KIND=' || case when down then 'DOWN' else 'UP' end from far where down is not null
  union all select 'IDENTITY_REFERENCE_INCIDENT', 'FIELD=EAN|KIND=REMOVED' from m where class = 'CHANGED' and k % 19 = 0)
select code, signature, count(*) as n from i group by 1, 2""")
def _(spark, sf):
    """Its issues by code and signature: amounts that can't be read, shares out of range, deviations by component and direction, lost references."""
    run, _, _ = screened(spark, sf)
    return run.issues.groupBy("code", "signature").agg(F.count(F.lit(1)).alias("n"))


_TAKEN = "class in ('NEW', 'CHANGED')"


@query("screening_component_state", PRICED + f""", s as (select coalesce(k, old_k) as key, case when {_TAKEN} then base_price else old_base end as base, case when {_TAKEN} then akp_share else old_akp_share end as akp_share, case when {_TAKEN} then vkp_share else old_vkp_share end as vkp_share,
  coalesce(old_supplier, supplier) as sup, coalesce(old_grp, grp) as g from o full join (select k, supplier, grp, reference, base_price, akp_share, vkp_share, class from m) x on k = old_k)
select sha256('2' || chr(31) || sup || chr(31) || g || chr(31) || cast(key as varchar)) as identity_hash, {_LISTED.format(p='')} as components,
  sha256(concat_ws(chr(31), '2', cast(base // 1000000 as varchar) || '.' || lpad(cast(base % 1000000 as varchar), 6, '0'), 'EUR', 'AKP' || chr(31) || {_share_text_sql('akp_share')}, 'VKP' || chr(31) || {_share_text_sql('vkp_share')})) as price_fingerprint from s""")
def _(spark, sf):
    """The state that acceptance leaves: nested components and fingerprints of version 2."""
    run, known, observations = screened(spark, sf)
    columns = [*delta.STATE_COLUMNS, "components"]
    after = state.accept_baseline(run.staged, known, columns, observations, "2024-01-01")["state"]
    listed = F.array_join(F.transform("components", lambda c: F.concat_ws("=", c["component_code"], parts_of.share_text(c["share"]))), ",")
    return after.select("identity_hash", listed.alias("components"), "price_fingerprint")
