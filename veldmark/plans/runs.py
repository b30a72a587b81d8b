"""A whole screening run over a delivery file that is made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldmark.functions.filters import RecordFilter
from veldmark.functions.transforms import FieldMapping
from veldmark.operators import delta, screening, state
from veldmark.plans import adapt
from veldmark.plans.catalog import SHAPES, query
from veldmark.plans.places import folder
from veldmark.sources.delimited import Structure, write_parts

PROFILE = screening.Profile(
    structure=Structure(("SUP", "GRP", "REF", "NAME", "PRICE", "STATUS"), in_parts=True),
    mappings=(
        FieldMapping("supplier", "SUP", "PREFIX", "prefix=S", required=True), FieldMapping("grp", "GRP", required=True), FieldMapping("reference", "REF", "SPLIT", "separator=/;index=2", required=True),
        FieldMapping("description", "NAME", longest=1000), FieldMapping("base_price", "PRICE", type="DECIMAL", decimal_sep=",", grouping_sep="."), FieldMapping("currency", kind="FIXED_VALUE", settings="value=EUR"),
    ),
    filters=(RecordFilter("EXCLUDE", "STATUS", "EQUALS", "x", ignore_case=True), RecordFilter("REJECT", "STATUS", "EQUALS", "R")),
    deviation_percent=20, bulk_percent=5, critical_percent=None, creation_percent=10,
)

#: Rows by the last two digits of their number: 3 has an open quote, 5 is filtered, 7 rejected by a filter, 11 has an unreadable price.
DELIVERED = SHAPES + """, d as (select *, row_number % 100 as k from beside), v as (select * from d where k not in (3, 5, 7, 11)),
c as (select count(*) as raw, count(*) filter (k = 5) as filtered, count(*) filter (k = 3) as error_before_filter, count(*) filter (k in (7, 11)) as rejected, count(*) filter (k not in (3, 5, 7, 11)) as valid from d),
far as (select sign(base_price - old_base_price) as way, count(*) as n from v where classification <> 'UNCHANGED' and abs(base_price - old_base_price) * 100 > 20 * old_base_price group by 1),
o as (select c.*, (select count(*) from v where classification = 'NEW') as candidates, (select count(*) from state) as state_size, (select count(*) from far where n >= 10 and n * 100 > 5 * (raw - filtered)) as bulk_prices from c),
j as (select *, case when candidates <= 0 then 'AUTOMATIC' when state_size <= 0 then 'INITIAL_LOAD' when candidates * 100 > 10 * state_size then 'THRESHOLD_EXCEEDED' else 'AUTOMATIC' end as creation_outcome from o)
"""
MASK = "case when classification = 'CHANGED' then nullif(concat_ws(',', case when article_fingerprint <> old_article_fingerprint then 'ARTICLE' end, case when base_price <> old_base_price or currency <> old_currency then 'PRICE' end), '') end"


def _copied(offers, copies: int):
    """Each offer so many times, under references of their own."""
    if copies == 1:
        return offers
    more = offers.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("reference", F.concat_ws("-", "reference", "__c"))
    return adapt.fingerprinted(more.withColumn("row_number", F.col("row_number") * copies + F.col("__c")).drop("__c"))


def delivery(spark, sf: str, copies: int = 1) -> str:
    """One delivery in parts, with a header, lines in order of their number."""
    path = folder(spark, "run")
    k = F.col("row_number") % 100
    price = F.translate(F.format_number((F.col("base_price") / 1_000_000).cast("decimal(18,2)"), 2), ".,", ",.")
    fields = [
        F.regexp_replace("supplier", "^S", ""), "grp", F.concat(F.lit("P/"), "reference"), F.concat(F.lit('"'), "description", F.when(k == 3, "").otherwise('"')),
        F.when(k == 11, "12,3x").otherwise(price), F.when(k == 5, "X").when(k == 7, "R").otherwise("A"),
    ]
    rows = _copied(adapt.stage(spark, sf), copies).select("row_number", F.concat_ws(";", *fields).alias("value"))
    header = spark.createDataFrame([(-1, "SUP;GRP;REF;NAME;PRICE;STATUS")], "row_number long, value string")
    write_parts(header.unionByName(rows), "row_number", f"{path}/in")
    return path


def screened(spark, sf: str, path: str | None = None, known=None) -> screening.Screened:
    path = path or delivery(spark, sf)
    none = spark.createDataFrame([], "identity_hash string, component_code string, observation_date date, amount decimal(24,0)")
    return screening.screen(spark, f"{path}/in", PROFILE, adapt.state(spark, sf) if known is None else known, none, path)


def prepared(spark, sf: str, offers: int):
    """A delivery file and a written state of about so many offers, for the bench: what a run over them needs."""
    copies = max(1, -(-offers // adapt.table(spark, sf, "part").count()))
    path = delivery(spark, sf, copies)
    _copied(adapt.state(spark, sf), copies).write.parquet(f"{path}/state")
    return path, spark.read.parquet(f"{path}/state")


@query("screening_run", DELIVERED + f"""select '1:1:' || identity_hash || ':OFFER' as idempotency_key, case classification when 'NEW' then 'CREATE' else 'UPDATE' end as action,
  case when classification = 'NEW' then case when creation_outcome = 'AUTOMATIC' then 'PLANNED' else 'AWAITING_APPROVAL' end when {MASK} like '%PRICE%' and bulk_prices > 0 then 'AWAITING_APPROVAL' else 'PLANNED' end as status,
  cast(old_base_price as varchar) as before_price, cast(base_price as varchar) as after_price, {MASK} as mask from v, j where classification <> 'UNCHANGED'""")
def _(spark, sf):
    """The mutations that a delivery leads to, from its file on."""
    run = screened(spark, sf)
    return run.mutations.select("idempotency_key", "action", "status", F.col("before_price").cast("string").alias("before_price"), F.col("after_price").cast("string").alias("after_price"), "mask")


@query("screening_verdict", DELIVERED + "select raw, filtered, error_before_filter, rejected, valid, candidates, creation_outcome, bulk_prices, case when bulk_prices > 0 or creation_outcome <> 'AUTOMATIC' then 'REVIEW_REQUIRED' else 'VALID_WITH_WARNINGS' end as verdict from j")
def _(spark, sf):
    run = screened(spark, sf)
    return run.judgement.select("raw", "filtered", "error_before_filter", "rejected", "valid", "candidates", "creation_outcome", "bulk_prices", "verdict")


@query("screening_issues", DELIVERED + """, i as (select case k when 3 then 'CSV_UNCLOSED_QUOTE' when 7 then 'FILTER_RECORD_REJECTED' else 'PRICE_UNREADABLE' end as code, case when k = 11 then 'FIELD=base_price' else '' end as signature, 'ERROR' as severity from d where k in (3, 7, 11)
  union all select 'PRICE_DEVIATION_EXCEEDED', 'FIELD=base_price|KIND=' || case when base_price < old_base_price then 'DOWN' else 'UP' end, 'WARNING' from v where classification <> 'UNCHANGED' and abs(base_price - old_base_price) * 100 > 20 * old_base_price)
select code, signature, severity, count(*) as n from i group by 1, 2, 3""")
def _(spark, sf):
    run = screened(spark, sf)
    return run.issues.groupBy("code", "signature", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("screening_accepted", DELIVERED + """select coalesce(s.identity_hash, v.identity_hash) as identity_hash, cast(case when v.classification in ('NEW', 'CHANGED') then v.base_price else s.base_price end as varchar) as base_price,
  case when v.classification in ('NEW', 'CHANGED') then v.combined_fingerprint else s.combined_fingerprint end as combined_fingerprint from state s full join v on s.identity_hash = v.identity_hash""")
def _(spark, sf):
    """The state after the run was accepted as the baseline."""
    run = screened(spark, sf)
    old = adapt.state(spark, sf).withColumn("base_price", F.col("base_price").cast("decimal(24,0)"))
    none = spark.createDataFrame([], "identity_hash string, component_code string, observation_date date, amount decimal(24,0)")
    after = state.accept_baseline(run.staged, old, delta.STATE_COLUMNS, none, "2024-01-01")
    return after["state"].select("identity_hash", F.col("base_price").cast("string").alias("base_price"), "combined_fingerprint")


@query("c27_trial_read", DELIVERED + """, i as (select case k when 3 then 'CSV_UNCLOSED_QUOTE' when 7 then 'FILTER_RECORD_REJECTED' else 'PRICE_UNREADABLE' end as code, count(*) as n from d where k in (3, 7, 11) group by 1)
select raw, filtered, error_before_filter, rejected, valid, cast(0 as bigint) as duplicate_rows, cast(coalesce((select sum(least(n, 20)) from i), 0) as bigint) as n_samples from c""")
def _(spark, sf):
    path = delivery(spark, sf)
    counters, samples = screening.trial(spark, f"{path}/in", PROFILE, path, 20)
    return counters.join(samples.agg(F.count(F.lit(1)).alias("n_samples")), F.lit(True))
