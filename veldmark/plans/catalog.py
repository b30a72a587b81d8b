"""The registered queries of the screening engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldmark.functions import filters, fingerprint, issues as issue_names, text, transforms
from veldmark.functions.numeric import half_up_percent
from veldmark.operators import bundles, delta, issues, judge, prices, references, state
from veldmark.plans import adapt
from veldmark.plans.places import folder
from veldmark.sources import delimited, listing

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SHAPES = adapt.SHAPES_SQL


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _beside(spark, sf) -> DataFrame:
    return delta.classified(delta.beside_state(adapt.stage(spark, sf), adapt.state(spark, sf)))


# --- the delta ---------------------------------------------------------------------------------


@query("c01_delta_classify", SHAPES + "select classification, count(*) as n from beside group by 1")
def _(spark, sf):
    return _beside(spark, sf).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


@query("j01_stage_beside_state", SHAPES + "select identity_hash, row_number, classification, base_price, old_base_price, combined_fingerprint, old_combined_fingerprint from beside")
def _(spark, sf):
    return _beside(spark, sf).select("identity_hash", "row_number", "classification", "base_price", "old_base_price", "combined_fingerprint", "old_combined_fingerprint")


MASK = "case when classification = 'CHANGED' then nullif(concat_ws(',', case when article_fingerprint <> old_article_fingerprint then 'ARTICLE' end, case when base_price <> old_base_price or currency <> old_currency then 'PRICE' end), '') end"


@query("x30_change_mask", SHAPES + f"select row_number, {MASK} as mask from beside")
def _(spark, sf):
    return delta.change_mask(_beside(spark, sf)).select("row_number", "mask")


@query("f09_mask_pattern", SHAPES + f"select count(*) as n from (select {MASK} as mask from beside) where mask like '%PRICE%'")
def _(spark, sf):
    return delta.change_mask(_beside(spark, sf)).where(F.col("mask").contains("PRICE")).agg(F.count(F.lit(1)).alias("n"))


@query("c13_mutations", SHAPES + f"""select '7:3:' || identity_hash || ':OFFER' as idempotency_key, row_number, case classification when 'NEW' then 'CREATE' else 'UPDATE' end as action,
  case when row_number % 17 = 0 then 'BLOCKED' when classification = 'NEW' then 'AWAITING_APPROVAL' else 'PLANNED' end as status, case when classification = 'NEW' and row_number % 17 <> 0 then 'THRESHOLD_EXCEEDED' end as reason,
  old_base_price as before_price, base_price as after_price, {MASK} as mask from beside where classification <> 'UNCHANGED'""")
def _(spark, sf):
    masked = delta.change_mask(_beside(spark, sf))
    held = masked.where("row_number % 17 = 0").select("row_number")
    return delta.mutations(masked, "THRESHOLD_EXCEEDED", "7:3", held).select("idempotency_key", "row_number", "action", "status", "reason", "before_price", "after_price", "mask")


@query("c14_hold_price_updates", SHAPES + f"select row_number, case when classification = 'CHANGED' and {MASK} like '%PRICE%' then 'AWAITING_APPROVAL' else 'PLANNED' end as status from beside where classification <> 'UNCHANGED'")
def _(spark, sf):
    rows = delta.mutations(delta.change_mask(_beside(spark, sf)), "AUTOMATIC", "7:3")
    return delta.hold_price_updates(rows, True).select("row_number", "status")


@query("j07_insert_if_absent", SHAPES + "select row_number from stage where identity_hash not in (select identity_hash from state)")
def _(spark, sf):
    return delta.only_new(adapt.stage(spark, sf), adapt.state(spark, sf), ["identity_hash"]).select("row_number")


@query("a16_action_status_counts", SHAPES + "select case classification when 'NEW' then 'CREATE' else 'UPDATE' end as action, case classification when 'NEW' then 'AWAITING_APPROVAL' else 'PLANNED' end as status, count(*) as n from beside where classification <> 'UNCHANGED' group by 1, 2")
def _(spark, sf):
    rows = delta.mutations(delta.change_mask(_beside(spark, sf)), "INITIAL_LOAD", "7:3")
    return rows.groupBy("action", "status").agg(F.count(F.lit(1)).alias("n"))


def _lineitem_offers(spark, sf) -> DataFrame:
    return adapt.lines(spark, sf).select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("identity_hash"), F.col("l_partkey").alias("row_number"), "l_returnflag", "amount")


OFFERS = f"with {adapt.LINES_SQL}, o as (select cast(l_orderkey as varchar) || '/' || cast(l_linenumber as varchar) as identity_hash, l_partkey as row_number, l_returnflag, amount from li) "


@query("a02_duplicate_identity", OFFERS + "select identity_hash, count(*) as n_rows, min(row_number) as first_row from o group by 1 having count(*) > 1")
def _(spark, sf):
    return delta.duplicate_identities(_lineitem_offers(spark, sf))


@query("j09_duplicate_rows", OFFERS + "select identity_hash, row_number, first_row from o join (select identity_hash, min(row_number) as first_row from o group by 1 having count(*) > 1) using (identity_hash)")
def _(spark, sf):
    return delta.duplicate_rows(_lineitem_offers(spark, sf))


@query("a03_hash_collisions", OFFERS + "select identity_hash, min(row_number) as first_row from o group by 1 having min(l_returnflag) <> max(l_returnflag) or min(amount) <> max(amount)")
def _(spark, sf):
    return delta.hash_collisions(_lineitem_offers(spark, sf), ["l_returnflag", "amount"])


@query("j05_state_collisions", SHAPES + "select g.identity_hash, g.row_number from stage g join state s on g.identity_hash = s.identity_hash where g.supplier <> s.supplier or g.description <> s.description")
def _(spark, sf):
    return delta.collisions_with_state(adapt.stage(spark, sf), adapt.state(spark, sf), ["supplier", "description"])


def _components(spark, sf, salt: int) -> DataFrame:
    p = adapt.table(spark, sf, "part")
    rows = p.select(F.col("p_partkey").cast("string").alias("identity_hash"), F.explode(F.array(F.lit("AKP"), F.lit("VKP"))).alias("component_code"), "p_partkey", "p_size")
    return rows.where((F.col("p_partkey") + F.length("component_code") + F.when(F.col("component_code") == "AKP", 1).otherwise(2) + salt) % 5 != 0).withColumn("percentage", (F.col("p_size") + F.when(F.col("p_partkey") % 4 == 0, salt).otherwise(0)).cast("bigint"))


def _components_sql(salt: int) -> str:
    return f"select cast(p_partkey as varchar) as identity_hash, component_code, cast(p_size + case when p_partkey % 4 = 0 then {salt} else 0 end as bigint) as percentage from part, (values ('AKP', 1), ('VKP', 2)) c(component_code, k) where (p_partkey + 3 + k + {salt}) % 5 <> 0"


@query("j08_component_changes", f"select coalesce(n.identity_hash, o.identity_hash) as identity_hash, coalesce(n.component_code, o.component_code) as component_code, n.percentage as \"new\", o.percentage as \"old\" from ({_components_sql(1)}) n full join ({_components_sql(0)}) o on n.identity_hash = o.identity_hash and n.component_code = o.component_code where n.percentage is distinct from o.percentage")
def _(spark, sf):
    return delta.component_changes(_components(spark, sf, 1), _components(spark, sf, 0))


# --- prices ------------------------------------------------------------------------------------


def _averages_sql(key: str, short: int, long: int) -> str:
    mean = lambda k: f"((2 * sum(amount) filter (rn <= {k}))::hugeint + count(*) filter (rn <= {k})) // (2 * count(*) filter (rn <= {k}))"
    return f"with {adapt.OBSERVATIONS_SQL.format(key=key)}, avgs as (select identity_hash, cast({mean(short)} as bigint) as avg_short, cast({mean(long)} as bigint) as avg_long from (select *, row_number() over (partition by identity_hash order by observation_date desc) as rn from obs) group by 1)"


@query("w01_w02_last_k_means", _averages_sql("l_suppkey", 50, 200) + " select identity_hash, avg_short, avg_long from avgs")
def _(spark, sf):
    return prices.averages(adapt.observations(spark, sf, "l_suppkey")).select("identity_hash", "avg_short", "avg_long")


def _controlled(spark, sf) -> DataFrame:
    latest = adapt.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("identity_hash"), (F.round(F.col("p_retailprice") * 100).cast("bigint") * 10_000).alias("amount"), F.lit("BASE").alias("component_code"))
    obs = adapt.observations(spark, sf, "l_partkey")
    previous = obs.groupBy("identity_hash").agg(F.max_by("amount", "observation_date").alias("previous"))
    rows = latest.join(prices.averages(obs, latest, 2, 4), prices.KEY, "left").join(previous, "identity_hash", "left")
    return prices.control(rows, 20)


def _dev_sql(c: str) -> str:
    return f"cast(sign(amount - {c}) * sign({c}) * ((abs(amount - {c})::hugeint * 200000000000000 + abs({c})::hugeint) // (abs({c})::hugeint * 2)) as bigint)"


CONTROL = _averages_sql("l_partkey", 2, 4) + f""", prev as (select identity_hash, arg_max(amount, observation_date) as previous from obs group by 1),
r as (select cast(p_partkey as varchar) as identity_hash, cast(round(p_retailprice * 100) as bigint) * 10000 as amount, previous, avg_short, avg_long from part left join avgs a on a.identity_hash = cast(p_partkey as varchar) left join prev p on p.identity_hash = cast(p_partkey as varchar)),
d as (select *, {_dev_sql("previous")} as dev_previous, {_dev_sql("avg_short")} as dev_avg_short, {_dev_sql("avg_long")} as dev_avg_long from r),
c as (select *, coalesce(abs(dev_previous) > 20000000000000, false) as h1, coalesce(abs(dev_avg_short) > 20000000000000, false) as h2, coalesce(abs(dev_avg_long) > 20000000000000, false) as h3 from d)
"""
DIRECTION = "case when h1 then case when dev_previous < 0 then 'DOWN' else 'UP' end when h2 then case when dev_avg_short < 0 then 'DOWN' else 'UP' end when h3 then case when dev_avg_long < 0 then 'DOWN' else 'UP' end end"


@query("c07_price_deviation", CONTROL + f"select identity_hash, amount, previous, avg_short, avg_long, dev_previous, dev_avg_short, dev_avg_long, h1 or h2 or h3 as exceeded, {DIRECTION} as direction from c")
def _(spark, sf):
    return _controlled(spark, sf).select("identity_hash", "amount", "previous", "avg_short", "avg_long", *(F.col(f"dev_{n}").cast("bigint").alias(f"dev_{n}") for n in ("previous", "avg_short", "avg_long")), "exceeded", "direction")


@query("a06_c08_missing_references", CONTROL + "select count(*) as evaluated, count(*) filter (coalesce(previous, 0) = 0) as no_previous, count(*) filter (coalesce(avg_short, 0) = 0) as no_avg_short, count(*) filter (coalesce(avg_long, 0) = 0) as no_avg_long from c")
def _(spark, sf):
    return prices.missing_references(_controlled(spark, sf))


@query("x25_component_share", f"with {adapt.LINES_SQL} select l_orderkey, l_linenumber, l_partkey, amount, cast((cast(l_quantity as bigint)::hugeint * 1000000 * 200000000000000 + amount) // (amount::hugeint * 2) as bigint) as share from li where amount > 0")
def _(spark, sf):
    rows = adapt.lines(spark, sf).where("amount > 0")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "amount", half_up_percent(F.col("l_quantity").cast("bigint") * 1_000_000, F.col("amount")).cast("bigint").alias("share"))


@query("x26_derivation_check", f"with {adapt.LINES_SQL} select l_linenumber % 3 <> 0 as holds, count(*) as n from li where amount > 0 group by 1")
def _(spark, sf):
    """Every third line's amount is five cents off what its share gives."""
    rows = adapt.lines(spark, sf).where("amount > 0")
    part = F.col("l_quantity").cast("bigint") * 1_000_000
    told = part + F.when(F.col("l_linenumber") % 3 == 0, 50_000).otherwise(0)
    holds = prices.derivation_holds(told, F.col("amount"), prices.component_share(part, F.col("amount")))
    return rows.groupBy(holds.alias("holds")).agg(F.count(F.lit(1)).alias("n"))


@query("x24_base_price_error", "select p_partkey, case when p_size % 6 = 0 then 'PRICE_ZERO_NOT_ALLOWED' when p_size % 6 = 1 then 'PRICE_NEGATIVE_NOT_ALLOWED' when p_size % 6 = 2 then 'PRICE_UNREADABLE' when p_size % 6 = 3 then 'PRICE_SCALE_EXCEEDED' when p_size % 6 = 4 then 'PRICE_OUT_OF_RANGE' end as error, case p_size % 6 when 0 then '0.000000' when 1 then '-1.500000' when 5 then '123456789012' || lpad(cast(p_partkey % 1000000 as varchar), 6, '0') || '.123456' end as amount from part")
def _(spark, sf):
    size = F.col("p_size") % 6
    wide = F.concat(F.lit("123456789012"), F.lpad((F.col("p_partkey") % 1_000_000).cast("string"), 6, "0"))
    delivered = F.when(size == 0, "0").when(size == 1, "-1,5").when(size == 2, "12,3x").when(size == 3, "1.2345678").when(size == 4, F.concat(wide, F.lit("0"))).otherwise(F.concat(wide, F.lit(",1234560")))
    plain = text.plain_decimal(delivered)
    micro = text.micro_units(plain)
    error = text.price_error(delivered, plain)
    good = F.when(error.isNull(), fingerprint.amount_text(micro))
    return adapt.table(spark, sf, "part").select("p_partkey", F.coalesce(error, prices.base_price_error(micro)).alias("error"), good.alias("amount"))


@query("x23_currency", "select c_custkey, coalesce(case when c_mktsegment = 'BUILDING' then 'USD' end, 'EUR') as currency, case when c_mktsegment = 'BUILDING' then 'SOURCE' else 'SYSTEM_DEFAULT' end as origin, case when c_mktsegment = 'BUILDING' then 'USD' end as printed from customer")
def _(spark, sf):
    effective, origin, printed = prices.currency(F.when(F.col("c_mktsegment") == "BUILDING", "USD"))
    return adapt.table(spark, sf, "customer").select("c_custkey", effective.alias("currency"), origin.alias("origin"), printed.alias("printed"))


@query("c18_append_observations", SHAPES + f", obs as (select identity_hash, amount from (select identity_hash, base_price as amount, row_number from state where row_number % 2 = 0)) select identity_hash, date '2024-01-01' as observation_date, amount from obs union all select identity_hash, date '2024-01-01', base_price from beside where classification <> 'UNCHANGED' and identity_hash not in (select identity_hash from obs)")
def _(spark, sf):
    have = adapt.state(spark, sf).where("row_number % 2 = 0").select("identity_hash", F.lit("BASE").alias("component_code"), F.lit("2024-01-01").cast("date").alias("observation_date"), F.col("base_price").alias("amount"))
    return state.append_observations(have, _beside(spark, sf), "2024-01-01").select("identity_hash", "observation_date", "amount")


# --- references --------------------------------------------------------------------------------


@query("c04_reference_match", adapt.REFERENCES_SQL + """, mine as (select identity_hash, count(*) as n_active, min(value) as own_value from own group by 1),
f as (select r.row_number, count(distinct o.identity_hash) as n_foreign from refs r join own o on r.value = o.value and r.identity_hash <> o.identity_hash group by 1),
m as (select r.*, coalesce(n_active, 0) as a, coalesce(n_foreign, 0) as n, own_value from refs r left join mine using (identity_hash) left join f using (row_number)),
v as (select *, case when a > 1 then 'AMBIGUOUS' when value is null and a = 1 then 'REMOVED' when value is null then null when n >= 2 then 'AMBIGUOUS' when a = 1 and own_value = value then 'SAME'
  when not known and n = 1 then 'SAME' when not known then 'NEW' when n = 1 then 'REUSED' when a = 0 then 'NEW' else 'CHANGED' end as match_result from m)
select row_number, value, match_result, coalesce(match_result in ('AMBIGUOUS', 'REMOVED', 'REUSED', 'CHANGED'), false) as incident,
  not known and n = 1 and value is not null and not coalesce(match_result in ('AMBIGUOUS', 'REMOVED', 'REUSED', 'CHANGED'), false) as link_proposal from v""")
def _(spark, sf):
    return references.match(*adapt.references(spark, sf)).select("row_number", "value", "match_result", "incident", "link_proposal")


MATCHED = ORACLES["c04_reference_match"].partition("select row_number, value, match_result")[0]


@query("j10_c03_duplicate_references", adapt.REFERENCES_SQL + "select row_number, value from refs where value in (select value from refs where value is not null group by 1 having count(distinct identity_hash) > 1)")
def _(spark, sf):
    return references.duplicate_references(adapt.references(spark, sf)[0]).select("row_number", "value")


@query("c06_incident_mutations", MATCHED + "select '7:3:' || identity_hash || ':REFERENCE:EAN' as idempotency_key, identity_hash, row_number, 'IDENTITY_REFERENCE_INCIDENT' as action, 'AWAITING_APPROVAL' as status, match_result as reason from v where match_result in ('AMBIGUOUS', 'REMOVED', 'REUSED', 'CHANGED')")
def _(spark, sf):
    return references.incident_mutations(references.match(*adapt.references(spark, sf)), "7:3")


# --- issues ------------------------------------------------------------------------------------


def _issues(spark, sf) -> DataFrame:
    rows = adapt.lines(spark, sf)
    code = F.when(F.col("l_quantity") > 48, "QUANTITY_HIGH").when(F.col("l_discount") > 0.09, "DISCOUNT_HIGH").when(F.col("l_tax") > 0.07, "TAX_HIGH")
    severity = F.when(F.col("code") == "QUANTITY_HIGH", "ERROR").otherwise("WARNING")
    rows = rows.withColumn("code", code).where("code is not null").withColumn("severity", severity)
    sign = issue_names.signature(("FIELD", F.col("l_returnflag")), ("KIND", F.col("l_linestatus")))
    return rows.select("code", "severity", F.col("l_returnflag").alias("field"), sign.alias("signature"), F.col("l_orderkey").alias("row_number"), F.date_format("l_shipdate", "yyyy-MM").alias("batch_id"), F.col("day").alias("seen_at"))


ISSUES = f"""with {adapt.LINES_SQL}, i as (select case when l_quantity > 48 then 'QUANTITY_HIGH' when l_discount > 0.09 then 'DISCOUNT_HIGH' when l_tax > 0.07 then 'TAX_HIGH' end as code, l_returnflag as field,
  'FIELD=' || l_returnflag || '|KIND=' || l_linestatus as signature, l_orderkey as row_number, strftime(l_shipdate, '%Y-%m') as batch_id, day as seen_at from li),
issues as (select *, case when code = 'QUANTITY_HIGH' then 'ERROR' else 'WARNING' end as severity from i where code is not null),
tallied as (select code, signature, severity, count(*) as occurrences, min(row_number) as first_row from issues group by 1, 2, 3) """


@query("a08_issue_tally", ISSUES + "select * from tallied")
def _(spark, sf):
    return issues.tally(_issues(spark, sf))


GROUPED = ISSUES + """, sampled as (select code, signature, count(*) as recorded from (select * from issues qualify row_number() over (partition by code order by row_number, signature) <= 200) group by 1, 2),
grouped as (select t.* from tallied t left join sampled s using (code, signature) where occurrences >= 10 or occurrences > coalesce(recorded, 0)) """


def _grouped(spark, sf) -> tuple[DataFrame, DataFrame]:
    found = _issues(spark, sf)
    return issues.groups(issues.tally(found), issues.samples(found)), found


@query("a09_a10_issue_groups", GROUPED + "select code, signature, occurrences, cast((occurrences::hugeint * 200000000000000 + 1000) // 2000 as bigint) as share, occurrences * 100 > 5 * 1000 as bulk from grouped")
def _(spark, sf):
    return issues.judged_groups(_grouped(spark, sf)[0], F.lit(1000), 5).select("code", "signature", "occurrences", F.col("share").cast("bigint").alias("share"), "bulk")


@query("o04_first_samples", ISSUES + "select code, row_number, signature from issues qualify row_number() over (partition by code order by row_number, signature) <= 200")
def _(spark, sf):
    return issues.samples(_issues(spark, sf)).select("code", "row_number", "signature")


@query("c10_cap_notices", ISSUES + "select code, cast(sum(occurrences) as bigint) as occurrences, 200 as recorded from tallied group by 1 having sum(occurrences) > 200")
def _(spark, sf):
    found = _issues(spark, sf)
    return issues.cap_notices(issues.tally(found), issues.samples(found)).select("code", "occurrences", F.col("recorded").cast("int").alias("recorded"))


@query("a11_severity_totals", GROUPED + ", n as (select severity, occurrences as n from grouped union all select severity, 1 from issues anti join grouped using (code, signature)) select severity, cast(sum(n) as bigint) as n from n group by 1")
def _(spark, sf):
    return issues.severity_totals(*_grouped(spark, sf))


@query("a12_code_totals", ISSUES + "select code, cast(sum(occurrences) as bigint) as occurrences from tallied group by 1")
def _(spark, sf):
    return issues.tally(_issues(spark, sf)).groupBy("code").agg(F.sum("occurrences").alias("occurrences"))


@query("a13_case_counts", ISSUES + ", o as (select code, signature, batch_id, count(*) as occurrences, min(seen_at) as seen_at from issues group by 1, 2, 3) select code, signature, count(*) as n_observations, cast(sum(occurrences) as bigint) as occurrences, min(seen_at) as first_at, max(seen_at) as last_at, min(batch_id) as first_batch, max(batch_id) as last_batch from o group by 1, 2")
def _(spark, sf):
    seen = _issues(spark, sf).groupBy("code", "signature", "batch_id").agg(F.count(F.lit(1)).alias("occurrences"), F.min("seen_at").alias("seen_at"))
    return issues.case_counts(seen)


@query("a21_critical_lines", ISSUES + "select count(distinct row_number) as critical_lines from issues where severity = 'ERROR' and field = 'R'")
def _(spark, sf):
    return issues.critical_lines(_issues(spark, sf), ["R"])


@query("c19_sync_cases", ISSUES + """, s as (select distinct code, signature from issues where batch_id >= '1998-01'), c as (select distinct code, signature, case when signature like '%A%' then 'CORRECTED' when signature like '%N%' then 'REJECTED' else 'AWAITING_REVIEW' end as status, 1 as revision from issues where code <> 'TAX_HIGH')
select coalesce(c.code, s.code) as code, coalesce(c.signature, s.signature) as signature, case when c.code is null or (s.code is not null and status = 'CORRECTED') then 'AWAITING_REVIEW' else status end as status, case when s.code is not null then 1 else revision end as revision, case when c.code is null then 'OPENED' when s.code is not null and status = 'CORRECTED' then 'REOPENED' end as event from c full join s on c.code = s.code and c.signature = s.signature""")
def _(spark, sf):
    found = _issues(spark, sf)
    status = F.when(F.col("signature").contains("A"), "CORRECTED").when(F.col("signature").contains("N"), "REJECTED").otherwise("AWAITING_REVIEW")
    cases = found.where("code <> 'TAX_HIGH'").select("code", "signature").distinct().select("code", "signature", status.alias("status"), F.lit(1).alias("revision"))
    return issues.sync_cases(cases, found.where("batch_id >= '1998-01'").select("code", "signature", F.lit(1).alias("revision")).distinct())


@query("x32_issue_catalogue", """select case o_orderkey % 4 when 0 then 'ROW_TOO_LONG' when 1 then 'HEADER_FIELD_SHIFTED' when 2 then 'MAPPING_VALUE_UNKNOWN' else 'NEVER_SEEN' end as code, case o_orderkey % 4 when 1 then 'WARNING' else 'ERROR' end as severity,
  case when o_orderkey % 4 <> 3 then 'NONE' end as effect, o_orderkey % 4 <> 3 as catalogued, count(*) as n from orders group by 1, 2, 3, 4""")
def _(spark, sf):
    key = F.col("o_orderkey") % 4
    full = F.concat(F.when(key == 0, "ROW_TOO_LONG:").when(key == 1, "HEADER_FIELD_SHIFTED:").when(key == 2, "MAPPING_VALUE_UNKNOWN:").otherwise("NEVER_SEEN:"), "o_orderstatus")
    found = issue_names.catalogued(adapt.table(spark, sf, "orders").select(full.alias("code")))
    return found.groupBy("code", "severity", "effect", "catalogued").agg(F.count(F.lit(1)).alias("n"))


# --- judgement ---------------------------------------------------------------------------------

ROUTES = "case when l_returnflag = 'R' then 'FILTERED' when l_linestatus = 'O' and l_quantity > 45 then 'REJECTED' when l_quantity < 2 then 'ERROR_BEFORE_FILTER' else 'VALID' end"


def _routed(spark, sf) -> DataFrame:
    route = F.when(F.col("l_returnflag") == "R", "FILTERED").when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45), "REJECTED").when(F.col("l_quantity") < 2, "ERROR_BEFORE_FILTER").otherwise("VALID")
    return adapt.table(spark, sf, "lineitem").withColumn("route", route)


COUNTERS = f"with r as (select {ROUTES} as route from lineitem), k as (select count(*) as raw, count(*) filter (route = 'FILTERED') as filtered, count(*) filter (route = 'ERROR_BEFORE_FILTER') as error_before_filter, count(*) filter (route = 'REJECTED') as rejected, count(*) filter (route = 'VALID') as valid from r) "


@query("c16_counter_reconciliation", COUNTERS + "select *, raw = filtered + error_before_filter + rejected + valid as agrees from k")
def _(spark, sf):
    return judge.counters(_routed(spark, sf)).withColumn("agrees", F.expr("raw = filtered + error_before_filter + rejected + valid"))


@query("c11_thresholds", COUNTERS + "select case when rejected <= 0 then 'NOT_APPLICABLE' when raw - filtered <= 0 or rejected * 100 > 5 * (raw - filtered) then 'EXCEEDED' else 'WITHIN' end as rejected_threshold, case when error_before_filter <= 0 then 'NOT_APPLICABLE' when error_before_filter * 100 > 50 * (raw - filtered) then 'EXCEEDED' else 'WITHIN' end as critical_threshold from k")
def _(spark, sf):
    scope = F.col("raw") - F.col("filtered")
    return judge.counters(_routed(spark, sf)).select(judge.threshold(F.col("rejected"), scope, F.lit(5)).alias("rejected_threshold"), judge.threshold(F.col("error_before_filter"), scope, F.lit(50)).alias("critical_threshold"))


@query("c12_creation_policy", SHAPES + "select case when n <= 0 then 'AUTOMATIC' when scope <= 0 then 'INITIAL_LOAD' when n * 100 > scope then 'THRESHOLD_EXCEEDED' else 'AUTOMATIC' end as outcome from (select count(*) filter (classification = 'NEW') as n, (select count(*) from state) as scope from beside)")
def _(spark, sf):
    scope = adapt.state(spark, sf).agg(F.count(F.lit(1)).alias("scope"))
    new = _beside(spark, sf).agg(F.count_if(F.col("classification") == "NEW").alias("n"))
    return new.join(scope, F.lit(True)).select(judge.creation_outcome(F.col("n"), F.col("scope"), F.lit(1)).alias("outcome"))


@query("c15_verdict", "select o_orderstatus, o_orderpriority, case when o_orderstatus = 'P' then 'BLOCKING' when o_orderpriority = '1-URGENT' then 'REVIEW_REQUIRED' when o_orderpriority = '2-HIGH' then 'VALID_WITH_WARNINGS' else 'VALID' end as verdict, count(*) as n from orders group by 1, 2, 3")
def _(spark, sf):
    urgent, high = (F.col("o_orderpriority") == "1-URGENT").cast("int"), (F.col("o_orderpriority") == "2-HIGH").cast("int")
    v = judge.verdict(F.col("o_orderstatus") == "P", urgent, F.lit(False), F.lit(0), high)
    return adapt.table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", v.alias("verdict")).groupBy("o_orderstatus", "o_orderpriority", "verdict").agg(F.count(F.lit(1)).alias("n"))


# --- acceptance --------------------------------------------------------------------------------


@query("c17_accept_baseline", SHAPES + "select coalesce(s.identity_hash, b.identity_hash) as identity_hash, case when b.classification in ('NEW', 'CHANGED') then b.base_price else s.base_price end as base_price, case when b.classification in ('NEW', 'CHANGED') then b.combined_fingerprint else s.combined_fingerprint end as combined_fingerprint from state s full join beside b on s.identity_hash = b.identity_hash where s.identity_hash is not null or b.classification = 'NEW'")
def _(spark, sf):
    return state.accept(adapt.state(spark, sf), _beside(spark, sf), ["base_price", "combined_fingerprint"])


@query("c17_idempotent", SHAPES + "select count(*) as unchanged, 0 as changed from stage")
def _(spark, sf):
    staged = adapt.stage(spark, sf)
    accepted = state.accept(adapt.state(spark, sf), _beside(spark, sf), delta.STATE_COLUMNS)
    again = delta.classified(delta.beside_state(staged, accepted))
    return again.agg(F.count_if(F.col("classification") == "UNCHANGED").alias("unchanged"), F.count_if(F.col("classification") != "UNCHANGED").cast("int").alias("changed"))


@query("j12_stale_rows", SHAPES + "select b.row_number from beside b left join (select * from state where row_number % 19 <> 0) s on b.identity_hash = s.identity_hash where s.combined_fingerprint is distinct from b.old_combined_fingerprint")
def _(spark, sf):
    return state.stale(_beside(spark, sf), adapt.state(spark, sf).where("row_number % 19 <> 0")).select("row_number")


# --- bundles -----------------------------------------------------------------------------------


def _bundled(spark, sf) -> DataFrame:
    rows = adapt.lines(spark, sf)
    return rows.select(F.concat(F.year("day"), F.lit("Q"), F.quarter("day")).alias("bundle_id"), F.date_format("day", "yyyy-MM").alias("batch_id"), F.col("l_partkey").alias("identity_hash"), F.col("l_orderkey").alias("id"), "l_linenumber", "amount", F.when(F.col("l_returnflag") == "N", "PLANNED").when(F.col("l_returnflag") == "A", "AWAITING_APPROVAL").otherwise("RECORDED").alias("status"))


BUNDLES = f"with {adapt.LINES_SQL}, b as (select cast(year(day) as varchar) || 'Q' || cast(quarter(day) as varchar) as bundle_id, strftime(day, '%Y-%m') as batch_id, l_partkey as identity_hash, l_orderkey as id, l_linenumber, amount, case l_returnflag when 'N' then 'PLANNED' when 'A' then 'AWAITING_APPROVAL' else 'RECORDED' end as status from li) "


@query("a17_conflicts_inside", BUNDLES + "select bundle_id, identity_hash, count(distinct batch_id) as n_batches, min(batch_id) as first_batch, max(batch_id) as last_batch from b group by 1, 2 having count(distinct batch_id) > 1")
def _(spark, sf):
    return bundles.conflicts_inside(_bundled(spark, sf))


@query("j11_conflicts_between", BUNDLES + "select distinct bundle_id, identity_hash from b where identity_hash in (select identity_hash from b group by 1 having count(distinct bundle_id) > 1)")
def _(spark, sf):
    return bundles.conflicts_between(_bundled(spark, sf))


@query("c22_group_decision", BUNDLES + "select case when status = 'AWAITING_APPROVAL' and amount > 30000000000 then 'REJECTED' else status end as status, case when status = 'AWAITING_APPROVAL' and amount > 30000000000 then status end as decided_from, count(*) as n from b group by 1, 2")
def _(spark, sf):
    rows = bundles.decide(_bundled(spark, sf), F.col("amount") > 30_000_000_000, "AWAITING_APPROVAL", "REJECTED")
    return rows.groupBy("status", "decided_from").agg(F.count(F.lit(1)).alias("n"))


@query("c25_expire", BUNDLES + "select case when status in ('PLANNED', 'AWAITING_APPROVAL') then 'EXPIRED' else status end as status, count(*) as n from b group by 1")
def _(spark, sf):
    return bundles.expire(_bundled(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("f08_mutation_selection", BUNDLES + "select count(*) as n from b where status = 'PLANNED' and batch_id = '1998-03'")
def _(spark, sf):
    return bundles.selected(_bundled(spark, sf), status="PLANNED", batch_id="1998-03", identity_hash=None).agg(F.count(F.lit(1)).alias("n"))


@query("a15_bundle_totals", "select o_orderstatus as bundle_id, case when count(case when o_orderpriority <> '1-URGENT' then o_custkey end) = count(*) then cast(sum(case when o_orderpriority <> '1-URGENT' then o_custkey end) as bigint) end as some_unknown, cast(sum(o_custkey) as bigint) as all_known from orders group by 1")
def _(spark, sf):
    rows = adapt.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("bundle_id"), F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey")).alias("some_unknown"), F.col("o_custkey").alias("all_known"))
    return bundles.totals(rows, ["some_unknown", "all_known"])


@query("a18_ordered_hash", "select s_nationkey as bundle_id, sha256(string_agg(cast(s_suppkey as varchar) || chr(31) || s_name || chr(30), '' order by s_suppkey)) as content_hash from supplier group by 1")
def _(spark, sf):
    line = F.concat_ws(fingerprint.PART, F.col("s_suppkey").cast("string"), "s_name")
    return fingerprint.ordered_hash(adapt.table(spark, sf, "supplier").withColumn("bundle_id", F.col("s_nationkey")), "bundle_id", line, F.col("s_suppkey"), "content_hash")


@query("c24_snapshot", SHAPES + "select row_number, base_price from beside where classification <> 'UNCHANGED'")
def _(spark, sf):
    rows = delta.mutations(delta.change_mask(_beside(spark, sf)), "AUTOMATIC", "7:3").select("row_number", "action", F.lit("READY_FOR_PUBLICATION").alias("status"), F.lit(7).alias("batch_id"))
    return bundles.snapshot(rows, adapt.stage(spark, sf).select("row_number", "base_price", F.lit(7).alias("batch_id"))).select("row_number", "base_price")


@query("f10_f11_latest", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def _(spark, sf):
    return bundles.latest(adapt.table(spark, sf, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


def _batches(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = adapt.table(spark, sf, "orders")
    batches = o.select(F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "F", "SCREENED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("MUTATING").alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", "BLOCKING").when(F.col("o_orderpriority") != "5-LOW", "VALID").alias("verdict"))
    return batches, o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("batch_id"), (F.col("o_orderkey") % 2 == 0).alias("active"))


@query("f12_bundle_candidates", "select o_orderkey as batch_id from orders where o_orderstatus = 'F' and o_orderpriority not in ('1-URGENT', '5-LOW') and o_orderkey % 6 <> 0")
def _(spark, sf):
    return bundles.candidates(*_batches(spark, sf)).select("batch_id")


@query("s18_purgeable", "select o_orderkey as batch_id from orders where o_orderstatus in ('F', 'P') and o_orderkey % 6 <> 0 and o_orderkey % 5 <> 0")
def _(spark, sf):
    batches, members = _batches(spark, sf)
    return bundles.purgeable(batches, members, batches.where("batch_id % 5 = 0").select("batch_id")).select("batch_id")


@query("a14_batch_summary", "select case o_orderstatus when 'F' then 'SCREENED' when 'P' then 'FAILED' else 'MUTATING' end as status, case when o_orderpriority = '1-URGENT' then 'BLOCKING' when o_orderpriority <> '5-LOW' then 'VALID' end as verdict, count(*) as n from orders group by 1, 2")
def _(spark, sf):
    return _batches(spark, sf)[0].groupBy("status", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("o02_page", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 50")
def _(spark, sf):
    return adapt.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(50)


# --- reading, filters, functions ---------------------------------------------------------------

FILTERS = [
    filters.RecordFilter("EXCLUDE", "p_brand", "EQUALS", " brand#1 ", ignore_case=True, trim=True),
    filters.RecordFilter("REJECT", "p_type", "BEGINS_WITH", "STANDARD"),
    filters.RecordFilter("INCLUDE", "p_name", "CONTAINS", "a"),
    filters.RecordFilter("INCLUDE", "p_type", "ENDS_WITH", "STEEL"),
    filters.RecordFilter("EXCLUDE", "p_type", "NOT_CONTAINS", "E"),
]


@query("f01_record_filter", "select case when lower(p_brand) = 'brand#1' then 'EXCLUDE' when starts_with(p_type, 'STANDARD') then 'REJECT' when not contains(p_type, 'E') then 'EXCLUDE' when contains(p_name, 'a') or ends_with(p_type, 'STEEL') then 'KEEP' else 'EXCLUDE' end as decision, count(*) as n from part group by 1")
def _(spark, sf):
    part = adapt.table(spark, sf, "part")
    return part.select(filters.decision(FILTERS, part.columns).alias("decision")).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("s14_file_selection", "select event_id from events where (starts_with(event_type, 'p') and contains(event_type, 'u')) or event_type = 'click'")
def _(spark, sf):
    keep = filters.file_selected(F.col("event_type"), [[("starts", "P"), ("contains", "u")], [("equals", "CLICK")]])
    return adapt.table(spark, sf, "events").where(keep).select("event_id")


@query("x03_x07_transforms", """select p_partkey, 'P-' || p_name || '/x' as affixed, p_name || '|' || p_brand as joined, split_part(p_type, ' ', 1) as part, case when p_brand = 'Brand#1' then 'one' when lower(p_brand) = 'brand#2' then 'two' end as mapped,
  case when not (p_brand = 'Brand#1' or lower(p_brand) = 'brand#2') then 'MAPPING_VALUE_UNKNOWN' end as mapped_error, case when len(string_split(p_type, ' ')) < 3 then 'TRANSFORM_FAILED' end as third_error, 'F' as fixed from part""")
def _(spark, sf):
    t = transforms
    mapped, mapped_error = t.mapped(F.col("p_brand"), {"Brand#1": "one", "BRAND#2": "two"}, True)
    return adapt.table(spark, sf, "part").select(
        "p_partkey", t.affix(F.col("p_name"), "P-", "/x")[0].alias("affixed"), t.concat([F.col("p_name"), F.col("p_brand")], "|")[0].alias("joined"), t.split_part(F.col("p_type"), " ", 1)[0].alias("part"),
        mapped.alias("mapped"), mapped_error.alias("mapped_error"), t.split_part(F.col("p_type"), " ", 3)[1].alias("third_error"), t.fixed("F")[0].alias("fixed"),
    )


@query("x08_x12_arithmetic", """with p as (select p_partkey, cast(round(p_retailprice * 100) as bigint) as cents, p_size, p_size % 7 as k, case when p_partkey % 4 = 0 then -1 else 1 end as sg from part),
q as (select *, (2 * cents::hugeint * 10000 + p_size) // (2 * p_size) as d, (2 * cents::hugeint * 1000000 + p_size) // (2 * p_size) as pc, (cents::hugeint * p_size * 5 + 5) // 10 as m from p)
select p_partkey, cast(cast(sg * cents / 100 as decimal(18, 2)) + cast(p_size || '.125' as decimal(18, 3)) as varchar) as added, cast(cast(sg * cents / 100 as decimal(18, 2)) - cast(p_size || '.125' as decimal(18, 3)) as varchar) as subtracted,
  case when sg < 0 and m > 0 then '-' else '' end || m // 100 || '.' || lpad(cast(m % 100 as varchar), 2, '0') as halved, case when k <> 0 then case when sg < 0 and d > 0 then '-' else '' end || d // 1000000 || '.' || lpad(cast(d % 1000000 as varchar), 6, '0') end as divided,
  case when k <> 0 then case when sg < 0 and pc > 0 then '-' else '' end || pc // 1000000 || '.' || lpad(cast(pc % 1000000 as varchar), 6, '0') end as percent, case when k = 0 then 'TRANSFORM_DIVIDE_BY_ZERO' end as error,
  '123456789012' || lpad(cast(p_partkey % 1000000 as varchar), 6, '0') || '.75' as wide from q""")
def _(spark, sf):
    """Retail prices of both signs and the size: sums keep all places, half the size times the price is rounded at two, quotients at six; every seventh size divides by zero."""
    cents, size = F.round(F.col("p_retailprice") * 100).cast("bigint"), F.col("p_size").cast("string")
    price = F.concat(F.when(F.col("p_partkey") % 4 == 0, "-").otherwise(""), F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    half = F.concat(F.floor(F.col("p_size") / 2).cast("string"), F.when(F.col("p_size") % 2 == 1, ".5").otherwise(".0"))
    divisor = F.when(F.col("p_size") % 7 == 0, "0").otherwise(size)
    wide = F.concat(F.lit("123456789012"), F.lpad((F.col("p_partkey") % 1_000_000).cast("string"), 6, "0"), F.lit(".5"))
    a = transforms.arithmetic
    divided, error = a(price, "divide", divisor)
    # a row costs far more than its bytes tell, so the few splits of a small file are dealt to all cores; a number that is named isn't coalesced
    return adapt.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey").select(
        "p_partkey", a(price, "add", F.concat(size, F.lit(".125")))[0].alias("added"), a(price, "subtract", F.concat(size, F.lit(".125")))[0].alias("subtracted"), a(price, "multiply", half, 2)[0].alias("halved"),
        divided.alias("divided"), a(price, "percentage", divisor)[0].alias("percent"), error.alias("error"), a(wide, "add", F.lit("0.25"))[0].alias("wide"),
    )


@query("x21_normalise_reference", r"select doc_id, sha256(coalesce(nullif(regexp_replace(regexp_replace(text, '[\p{Cc}\p{Cf}]', '', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), ''), '')) as value_hash from documents")
def _(spark, sf):
    return adapt.table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce(text.normalise_reference(F.col("text")), F.lit("")), 256).alias("value_hash"))


@query("x28_fingerprints", SHAPES + "select row_number, identity_hash, article_fingerprint, price_fingerprint, combined_fingerprint from stage")
def _(spark, sf):
    return adapt.stage(spark, sf).select("row_number", "identity_hash", "article_fingerprint", "price_fingerprint", "combined_fingerprint")


@query("x17_decimal_parse", "select p_partkey, cast(round(p_retailprice * 100) as bigint) * 10000 as micro from part")
def _(spark, sf):
    delivered = F.format_number("p_retailprice", 2)
    comma = F.translate(delivered, ".,", ",.")
    return adapt.table(spark, sf, "part").select("p_partkey", text.micro_units(text.plain_decimal(comma, ",", ".")).alias("micro"))


@query("x18_date_parse", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def _(spark, sf):
    return adapt.table(spark, sf, "orders").select("o_orderkey", text.parsed_date(F.date_format("o_orderdate", "dd/MM/yyyy"), "dd/MM/yyyy").alias("day"))


@query("s01_delimited_scan", "select row_number() over (partition by p_brand order by p_partkey) + 1 as line, p_partkey, p_name, p_brand from part")
def _(spark, sf):
    """One delivery file for each brand, with a header; lines are numbered by file."""
    path = folder(spark, "delivery")
    part = adapt.table(spark, sf, "part")
    rows = part.select("p_brand", F.concat_ws(";", F.format_string("%012d", "p_partkey"), F.concat(F.lit('"'), "p_name", F.lit('"')), "p_brand").alias("value"))
    header = part.select("p_brand").distinct().withColumn("value", F.lit("         KEY;NAME;BRAND"))
    header.unionByName(rows).repartition("p_brand").sortWithinPartitions("p_brand", "value").write.partitionBy("p_brand").text(path)
    got = delimited.read_delivery(spark, path, delimited.Structure(("key", "NAME", "brand"))).where("error_code is null")
    return got.select("line", F.col("key").cast("bigint").alias("p_partkey"), F.col("NAME").alias("p_name"), F.col("brand").alias("p_brand"))


@query("s06_s07_malformed_records", """select p_brand, count(*) as records, count(*) filter (p_partkey % 10 = 3) as unclosed, count(*) filter (p_partkey % 10 = 5) as wrong_count, count(*) filter (p_partkey % 10 = 7) as too_long,
  sum(case when p_partkey % 10 in (0, 1, 2, 4, 6, 8, 9) then length(p_name) + 2 + case when p_partkey % 10 = 9 then 5000 else 0 end else 0 end) as good_length from part group by 1""")
def _(spark, sf):
    """Bad lines among good ones: quotes left open, a field too many, lines beyond the limit, very long quoted fields with doubled quotes; and blank lines, which are no records."""
    path = folder(spark, "malformed")
    key = F.col("p_partkey") % 10
    name = F.concat(F.lit('"""'), "p_name", F.when(key == 9, F.lit('""' * 5000)).otherwise(""), F.lit(';"'))
    value = F.when(key == 3, F.concat(F.lit('"open'), "p_name", F.lit(";x"))).when(key == 5, F.concat(name, F.lit(";"), "p_brand", F.lit(";more"))).when(key == 7, F.concat(name, F.lit(";"), F.lit("x" * 100_001))).otherwise(F.concat_ws(";", name, "p_brand"))
    value = F.when(F.col("o") == 0, "NAME;BRAND").when(F.col("p_partkey").isNull(), "").otherwise(value)
    part = adapt.table(spark, sf, "part").select("p_brand", "p_partkey", "p_name", (F.floor(F.col("p_partkey") / 10) % 8).alias("file"), F.lit(1).alias("o"))
    beside = part.select("p_brand").distinct().select("p_brand", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("file")).withColumn("o", F.explode(F.array(F.lit(0), F.lit(1))))  # a header and a blank line in each file
    lines = part.unionByName(beside, allowMissingColumns=True).repartition("p_brand", "file").sortWithinPartitions("p_brand", "file", "o")
    # lines beyond the limit are nearly all of the bytes: they are made behind the shuffle and the sort, and written compressed
    lines.select("p_brand", "file", value.alias("value")).write.partitionBy("p_brand", "file").text(path, compression="gzip")
    got = delimited.read_delivery(spark, path, delimited.Structure(("name", "brand")))
    brand = F.regexp_replace(F.regexp_extract("file", "p_brand=([^/]*)/", 1), "%(25)*23", "#")
    n = lambda code: F.count_if(F.col("error_code").eqNullSafe(code))
    return got.groupBy(brand.alias("p_brand")).agg(F.count(F.lit(1)).alias("records"), n("CSV_UNCLOSED_QUOTE").alias("unclosed"), n("ROW_COLUMN_COUNT_MISMATCH").alias("wrong_count"), n("ROW_TOO_LONG").alias("too_long"), F.sum(F.coalesce(F.length("name"), F.lit(0))).cast("bigint").alias("good_length"))


@query("s11_idempotent_intake", "select event_id, case when event_id % 3 = 0 then 'NEW' when event_id % 2 = 0 then 'EXISTING' else 'CONFLICT' end as outcome from events")
def _(spark, sf):
    e = adapt.table(spark, sf, "events").select("event_id", F.col("event_id").cast("string").alias("idempotency_key"), F.sha2(F.col("event_id").cast("string"), 256).alias("sha256"))
    known = e.where("event_id % 3 <> 0").select("idempotency_key", F.when(F.col("event_id") % 2 == 0, F.col("sha256")).otherwise("other").alias("sha256"))
    return delimited.intake(e, known).select("event_id", "outcome")


@query("s16_preview_lines", "select s_suppkey as ordinal, cast(s_suppkey as varchar) || ';' || s_name || ';' || case when s_acctbal < 0 then '''' else '' end || cast(cast(round(s_acctbal * 100) as bigint) as varchar) as line from supplier")
def _(spark, sf):
    rows = adapt.table(spark, sf, "supplier")
    return delimited.export_lines(rows, [("key", F.col("s_suppkey")), ("name", F.col("s_name")), ("balance", F.round(F.col("s_acctbal") * 100).cast("bigint"))], F.col("s_suppkey"))


@query("t02_file_watermark", """with f as (select user_id as task, cast(event_id as varchar) as name, cast(floor(epoch(ts)) as bigint) as mtime, event_id % 1000 as size from events),
w as (select task, max(mtime) - 86400 as mark_mtime, '' as mark_name from f where task % 2 = 0 group by 1),
a as (select f.*, mark_mtime, case when size = 7 then 'ALREADY_FETCHED' when mark_mtime is not null and mtime < mark_mtime then 'OLDER_THAN_WATERMARK' end as d from f left join w using (task)),
b as (select * replace (case when d is null and mark_mtime is null and row_number() over (partition by task, d is null order by mtime desc, name desc) > 1 then 'OLDER_THAN_WATERMARK' else d end as d) from a),
c as (select * replace (coalesce(d, case when size > 900 then 'TOO_LARGE' end) as d) from b)
select task, name, coalesce(d, case when row_number() over (partition by task, d is null order by mtime, name) = 1 then 'SELECTED' else 'DEFERRED' end) as decision from c""")
def _(spark, sf):
    files = adapt.table(spark, sf, "events").select(F.col("user_id").alias("task"), F.col("event_id").cast("string").alias("name"), F.unix_timestamp("ts").alias("mtime"), (F.col("event_id") % 1000).alias("size"))
    marks = files.where("task % 2 = 0").groupBy("task").agg((F.max("mtime") - 86_400).alias("mark_mtime"), F.lit("").alias("mark_name"))
    return listing.decide(files, marks, files.where("size = 7"), now=4_000_000_000, least_age=60, most_bytes=900).select("task", "name", "decision")


@query("t06_streamed_state", "select cast(user_id as varchar) as identity_hash, arg_max(value, event_id) as value from events group by 1")
def _(spark, sf):
    """Four files in order of events, one a micro-batch."""
    from veldmark.streaming.deliveries import StateVersions, follow

    root = folder(spark, "stream")
    columns = ["value", "combined_fingerprint"]
    rows = adapt.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("identity_hash"), F.col("event_id").alias("seq"), "value", F.col("value").cast("string").alias("combined_fingerprint"))
    bounds = rows.selectExpr("percentile_approx(seq, array(0.25, 0.5, 0.75), 1000) as b").head()["b"]
    for i in range(4):  # written one after another: a stream takes older files first
        part = rows.where(F.lit(True) if i == 0 else F.col("seq") > bounds[i - 1]).where(F.lit(True) if i == 3 else F.col("seq") <= bounds[i])
        part.write.mode("append").parquet(f"{root}/in")
    versions = StateVersions(spark, root, "identity_hash string, value double, combined_fingerprint string")
    lines = spark.readStream.schema("identity_hash string, seq long, value double, combined_fingerprint string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    follow(lines, versions, columns, f"{root}/checkpoint").awaitTermination()
    return versions.latest().select("identity_hash", "value")
