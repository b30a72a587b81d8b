"""Further registered queries: read models, set operations, values, publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldmark.functions import text, values
from veldmark.functions.issues import signature
from veldmark.operators import bundles, delta, issues, publication, references
from veldmark.operators.ordering import positions
from veldmark.plans import adapt, deliveries, previews, priced, runs  # noqa: F401 (register their queries)
from veldmark.plans.places import folder
from veldmark.plans.catalog import BUNDLES, ISSUES, ORACLES, QUERIES, SHAPES, _beside, _bundled, _components, _components_sql, _issues, _lineitem_offers, OFFERS, query

__all__ = ["ORACLES", "QUERIES"]
t = adapt.table


@query("a01_count_by_classification", SHAPES + "select classification, count(*) as n from (select case when row_number % 5 <> 0 then classification end as classification from beside) where classification is not null group by 1")
def _(spark, sf):
    """Rows that have no classification yet are not counted."""
    return delta.counted(_beside(spark, sf).withColumn("classification", F.when(F.col("row_number") % 5 != 0, F.col("classification"))))


@query("a04_a05_component_counts", f"select component_code, count(distinct identity_hash) as n_rows from ({_components_sql(0)}) group by 1")
def _(spark, sf):
    return _components(spark, sf, 0).groupBy("component_code").agg(F.countDistinct("identity_hash").alias("n_rows"))


@query("a19_snapshot_hash", f"""with c as ({_components_sql(0)}), k as (select cast(identity_hash as bigint) as id, string_agg(component_code || chr(31) || cast(percentage as varchar), chr(31) order by component_code) as children from c group by 1)
select p_brand as bundle_id, sha256(string_agg(cast(p_partkey as varchar) || chr(31) || regexp_replace(cast(cast(round(p_retailprice * 100) as bigint) // 100 as varchar) || '.' || lpad(cast(cast(round(p_retailprice * 100) as bigint) % 100 as varchar), 2, '0'), '\\.?0+$', '') || chr(31) || coalesce(children, 'null') || chr(30), '' order by p_partkey)) as snapshot_hash
from part left join k on id = p_partkey group by 1""")
def _(spark, sf):
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    rows = t(spark, sf, "part").select(F.col("p_brand").alias("bundle_id"), F.col("p_partkey").alias("id"), (cents * 10_000).alias("amount"))
    return publication.snapshot_hash(rows, _components(spark, sf, 0).withColumn("id", F.col("identity_hash").cast("bigint")))


@query("c26_simulation_run", f"""with c as ({_components_sql(0)}), k as (select cast(identity_hash as bigint) as id, string_agg(component_code || chr(31) || cast(percentage as varchar), chr(31) order by component_code) as children from c group by 1),
r as (select p_brand as bundle_id, max(p_size) + 1 as attempt from part where p_brand <> 'Brand#1' group by 1),
q as (select *, cast(round(p_retailprice * 100) as bigint) as cents from part)
select p_brand as bundle_id, cast(coalesce(any_value(attempt), 1) as bigint) as attempt, count(*) as n_rows, count(*) filter (p_partkey % 9 = 0) as n_incomplete, sha256(string_agg(cast(p_partkey as varchar) || chr(31) || case when p_partkey % 9 = 0 then 'null' else regexp_replace(cast(cents // 100 as varchar) || '.' || lpad(cast(cents % 100 as varchar), 2, '0'), '\\.?0+$', '') end || chr(31) || coalesce(children, 'null') || chr(30), '' order by p_partkey)) as snapshot_hash
from q left join k on id = p_partkey left join r on bundle_id = p_brand group by 1""")
def _(spark, sf):
    part = t(spark, sf, "part")
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    rows = part.select(F.col("p_brand").alias("bundle_id"), F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 9 != 0, cents * 10_000).alias("amount"))
    runs_of = part.where("p_brand <> 'Brand#1'").select(F.col("p_brand").alias("bundle_id"), F.col("p_size").alias("attempt"))
    return publication.simulation(rows, _components(spark, sf, 0).withColumn("id", F.col("identity_hash").cast("bigint")), runs_of, ["amount"])


@query("a20_bookmark_hash", "select c_nationkey as batch_id, sha256(string_agg(c_name || chr(31) || c_mktsegment || chr(30), '' order by c_name)) as value_hash from customer group by 1")
def _(spark, sf):
    from veldmark.functions.fingerprint import PART, ordered_hash

    return t(spark, sf, "customer").withColumn("batch_id", F.col("c_nationkey")).transform(ordered_hash, "batch_id", F.concat_ws(PART, "c_name", "c_mktsegment"), F.col("c_name"), "value_hash")


@query("a22_next_attempt", "select o_custkey as bundle_id, max(o_orderkey) + 1 as next_attempt from orders group by 1")
def _(spark, sf):
    return publication.next_attempt(t(spark, sf, "orders").select(F.col("o_custkey").alias("bundle_id"), F.col("o_orderkey").alias("attempt")))


@query("a23_usage_counts", "select n_name, count(s_suppkey) as n_suppliers from nation left join supplier on s_nationkey = n_nationkey group by 1")
def _(spark, sf):
    n, s = t(spark, sf, "nation"), t(spark, sf, "supplier")
    return n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n_suppliers"))


@query("a24_trial_duplicates", OFFERS + "select cast(coalesce(sum(n), 0) as bigint) as duplicate_rows from (select count(*) as n from o group by identity_hash having count(*) > 1)")
def _(spark, sf):
    return publication.trial_duplicates(_lineitem_offers(spark, sf))


@query("a25_existence", "select count(*) > 0 as found from orders where o_totalprice < 0")
def _(spark, sf):
    return t(spark, sf, "orders").where("o_totalprice < 0").agg((F.count(F.lit(1)) > 0).alias("found"))


@query("f07_optional_predicates", "select o_orderkey from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'")
def _(spark, sf):
    rows = bundles.selected(t(spark, sf, "orders"), o_orderstatus="F", o_orderpriority=None)
    return rows.where((F.col("o_orderdate") >= "1995-01-01") & (F.col("o_orderdate") < "1996-01-01")).select("o_orderkey")


@query("j02_semi_and_anti", SHAPES + "select (select count(*) from stage where identity_hash in (select identity_hash from state)) as known, (select count(*) from stage where identity_hash not in (select identity_hash from state)) as new")
def _(spark, sf):
    rows = _beside(spark, sf)
    return rows.agg(F.count("known").alias("known"), F.count_if(F.col("known").isNull()).alias("new"))


@query("j03_stage_with_components", f"select p_partkey, p_brand, component_code, percentage from part join ({_components_sql(0)}) c on c.identity_hash = cast(p_partkey as varchar)")
def _(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_partkey").cast("string").alias("identity_hash"))
    return p.join(_components(spark, sf, 0).drop("p_partkey", "p_size"), "identity_hash").select("p_partkey", "p_brand", "component_code", "percentage")


@query("j13_membership", BUNDLES + "select bundle_id, count(*) as n from b where batch_id in (select distinct batch_id from b where status = 'PLANNED') group by 1")
def _(spark, sf):
    rows = _bundled(spark, sf)
    return rows.join(rows.where("status = 'PLANNED'").select("batch_id").distinct(), "batch_id", "left_semi").groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n"))


@query("j14_snapshot_with_children", f"select p_partkey, (select string_agg(component_code, ',' order by component_code) from ({_components_sql(0)}) c where c.identity_hash = cast(p_partkey as varchar)) as codes from part")
def _(spark, sf):
    codes = _components(spark, sf, 0).groupBy("identity_hash").agg(F.array_join(F.array_sort(F.collect_list("component_code")), ",").alias("codes"))
    return t(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("identity_hash")).join(codes, "identity_hash", "left").select("p_partkey", "codes")


@query("j15_read_model_lookup", "select s_suppkey, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def _(spark, sf):
    s, n, r = (t(spark, sf, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("s_suppkey", "n_name", "r_name")


@query("o01_chunk_boundary", "select max(o_orderkey) as boundary from (select o_orderkey from orders where o_orderkey > 1000 order by o_orderkey limit 500)")
def _(spark, sf):
    return t(spark, sf, "orders").where("o_orderkey > 1000").orderBy("o_orderkey").limit(500).agg(F.max("o_orderkey").alias("boundary"))


@query("o03_nulls_last", "select c_custkey, case when c_custkey % 3 <> 0 then c_custkey % 10 end as issue_row, row_number() over (order by case when c_custkey % 3 <> 0 then c_custkey % 10 end asc nulls last, c_custkey) as position from customer")
def _(spark, sf):
    rows = t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 10).alias("issue_row"))
    return positions(rows, [F.col("issue_row").asc_nulls_last(), F.col("c_custkey").asc()], folder(spark, "positions"))


@query("o05_conflict_samples", BUNDLES + "select distinct identity_hash from b where identity_hash in (select identity_hash from b group by 1 having count(distinct bundle_id) > 1) order by 1 limit 10")
def _(spark, sf):
    return bundles.conflicts_between(_bundled(spark, sf)).select("identity_hash").distinct().orderBy("identity_hash").limit(10)


@query("o06_o07_first_file", "select user_id, arg_min(event_id, (ts, event_id)) as first_event from events group by 1")
def _(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))


@query("u01_union_base_and_components", f"select identity_hash, component_code, percentage from ({_components_sql(0)}) union all select cast(p_partkey as varchar), 'BASE', cast(p_size as bigint) from part")
def _(spark, sf):
    base = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("identity_hash"), F.lit("BASE").alias("component_code"), F.col("p_size").cast("bigint").alias("percentage"))
    return _components(spark, sf, 0).select("identity_hash", "component_code", "percentage").unionByName(base)


@query("u02_distinct", "select distinct l_returnflag, l_linestatus from lineitem")
def _(spark, sf):
    return t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("x13_x16_value_checks", "select c_custkey, case when c_custkey % 5 = 0 then 'none' else c_mktsegment end as defaulted, case when c_custkey % 7 = 0 then 'VALUE_MISSING' end as missing, length(c_name) > 18 as too_long, cast(c_custkey as varchar) as whole from customer")
def _(spark, sf):
    from veldmark.functions import transforms as tr

    c = t(spark, sf, "customer")
    return c.select("c_custkey", tr.defaulted(F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")), "none")[0].alias("defaulted"), tr.required_error(F.when(F.col("c_custkey") % 7 == 0, "").otherwise("x")).alias("missing"), tr.length_error(F.length("c_name"), 18).isNotNull().alias("too_long"), text.parsed_integer(F.concat(F.lit(" +00"), F.col("c_custkey").cast("string"))).alias("whole"))


@query("x19_x20_instants", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as instant, case when event_id % 2 = 0 then 'true' else 'false' end as flag from events")
def _(spark, sf):
    e = t(spark, sf, "events")
    return e.select("event_id", text.parsed_instant(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"), "dd/MM/yyyy HH:mm:ss", "UTC").alias("instant"), text.parsed_boolean(F.when(F.col("event_id") % 2 == 0, " TRUE ").otherwise("0")).alias("flag"))


@query("x31_signatures", "select o_orderkey, 'FIELD=' || o_orderstatus || '|DIRECTION=' || o_orderpriority as signature from orders")
def _(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", signature(("FIELD", F.col("o_orderstatus")), ("COMPONENT", F.lit(None).cast("string")), ("DIRECTION", F.col("o_orderpriority"))).alias("signature"))


@query("x34_description_state", "select doc_id, case when text is null then 'NULL' when regexp_replace(text, '[\\x00-\\x20]+', '', 'g') = '' then 'BLANK' else 'VALUE' end as state from documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", values.description_state(F.col("text")).alias("state"))


@query("x35_preview_states", "select p_partkey, case when p_size % 7 = 0 then 'NOT_CONTRACTED' when p_size % 4 = 0 then 'NOT_MAPPED' when p_size % 5 = 0 then 'NOT_AVAILABLE_IN_MUTATION' when p_size % 11 = 0 then 'NOT_SNAPSHOTTED' when p_size % 3 = 0 then 'UNKNOWN' else 'VALUE' end as state from part")
def _(spark, sf):
    size = F.col("p_size")
    return t(spark, sf, "part").select("p_partkey", publication.field_state(F.when(size % 3 != 0, size), snapshotted=size % 11 != 0, contracted=size % 7 != 0, mapped=size % 4 != 0, in_mutation=size % 5 != 0).alias("state"))


KINDS = ("INTEGER", "DECIMAL", "DATE", "BOOLEAN", "ENUM", "TEXT")


@query("x36_bookmark_values", "select p_partkey, kind, case when p_size % 10 = 0 then 'VALUE_MISSING' when kind <> 'TEXT' and p_size % 2 = 1 then kind || '_INVALID' when kind = 'TEXT' and p_size % 2 = 1 then 'PATTERN_MISMATCH' end as error from part, (values ('INTEGER'), ('DECIMAL'), ('DATE'), ('BOOLEAN'), ('ENUM'), ('TEXT')) k(kind)")
def _(spark, sf):
    """Each kind of bookmark with a value that fits, one that doesn't, and none."""
    good = {"INTEGER": "-12", "DECIMAL": "1,5", "DATE": "2024-02-29", "BOOLEAN": "true", "ENUM": "red", "TEXT": "abc"}
    bad = {"INTEGER": "1.5", "DECIMAL": "1,5x", "DATE": "2024-02-30", "BOOLEAN": "yes", "ENUM": "green", "TEXT": "abc1"}
    size, out = F.col("p_size"), None
    for kind in KINDS:
        value = F.when(size % 10 == 0, "").when(size % 2 == 1, bad[kind]).otherwise(good[kind])
        error = values.bookmark_error(value, kind, choices=("red", "blue"), pattern="[a-z]+" if kind == "TEXT" else None, most=20)
        rows = t(spark, sf, "part").select("p_partkey", F.lit(kind).alias("kind"), error.alias("error"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("c05_link_proposals", ORACLES["c04_reference_match"].partition("select row_number, value, match_result")[0] + "select row_number from v where not known and n = 1 and value is not null and not coalesce(match_result in ('AMBIGUOUS', 'REMOVED', 'REUSED', 'CHANGED'), false)")
def _(spark, sf):
    return references.match(*adapt.references(spark, sf)).where("link_proposal").select("row_number")


@query("c09_bulk_roll_up", ISSUES + "select 'BULK_PRICE_INCIDENT' as code, signature, occurrences from tallied where code = 'DISCOUNT_HIGH' and occurrences * 100 > 1000")
def _(spark, sf):
    kind = F.when(F.col("code") == "DISCOUNT_HIGH", "PRICE").otherwise("GENERIC")
    judged = issues.judged_groups(issues.tally(_issues(spark, sf)), F.lit(1000), 1).withColumn("incident_kind", kind)
    return publication.bulk_roll_up(judged)


STATUSES = ("AWAITING_REVIEW", "CORRECTED", "REJECTED", "AUTO_RESOLVED")


@query("c20_case_steps", """with s as (select * from (values ('AWAITING_REVIEW', 0), ('CORRECTED', 1), ('REJECTED', 2), ('AUTO_RESOLVED', 3)) v(status, k)),
o as (select a.status as old, b.status as new from orders join s a on a.k = o_orderkey % 4 join s b on b.k = (o_orderkey // 4) % 4)
select old, new, (old, new) in (('AWAITING_REVIEW', 'CORRECTED'), ('AWAITING_REVIEW', 'REJECTED'), ('CORRECTED', 'AWAITING_REVIEW'), ('REJECTED', 'AWAITING_REVIEW'), ('AUTO_RESOLVED', 'AWAITING_REVIEW')) as allowed, count(*) as n from o group by 1, 2""")
def _(spark, sf):
    """All pairs of statuses."""
    named = lambda k: F.get(F.array(*map(F.lit, STATUSES)), (k % 4).cast("int"))
    rows = t(spark, sf, "orders").select(named(F.col("o_orderkey")).alias("old"), named(F.floor(F.col("o_orderkey") / 4)).alias("new"))
    return rows.groupBy("old", "new", issues.allowed_step(F.col("old"), F.col("new")).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


@query("c21_single_decision", BUNDLES + "select count(*) as n from b where status = 'AWAITING_APPROVAL' and id % 100 = 1")
def _(spark, sf):
    rows = bundles.decide(_bundled(spark, sf), F.col("id") % 100 == 1, "AWAITING_APPROVAL", "READY_FOR_PUBLICATION")
    return rows.where("decided_from is not null").agg(F.count(F.lit(1)).alias("n"))


@query("c23_freeze_preflight", BUNDLES + """, c as (select bundle_id, count(*) as conflicts from (select bundle_id, identity_hash from b group by 1, 2 having count(distinct batch_id) > 1) group by 1)
select bundle_id, count(*) filter (status = 'AWAITING_APPROVAL') as undecided, count(*) filter (amount > 100000000000) as stale, coalesce(any_value(conflicts), 0) as conflicts from b left join c using (bundle_id) group by 1""")
def _(spark, sf):
    rows = _bundled(spark, sf)
    return publication.preflight(rows, rows.where("amount > 100000000000"))


@query("c23_sealed_freeze", BUNDLES + """, r as (select * exclude (batch_id, status), bundle_id as batch_id, case when bundle_id like '%Q1' then 'PLANNED' else status end as status from b qualify row_number() over (partition by bundle_id, identity_hash order by id, l_linenumber) = 1),
ok as (select bundle_id from r group by 1 having count(*) filter (status = 'AWAITING_APPROVAL') = 0)
select bundle_id, count(*) filter (status = 'PLANNED') as frozen, sum(amount) filter (status = 'PLANNED') as amount from r where bundle_id in (select * from ok) group by 1""")
def _(spark, sf):
    """Bundles of first quarters have all their mutations planned and freeze; the others hold undecided ones and stay open."""
    first = bundles.latest(_bundled(spark, sf), ["bundle_id", "identity_hash"], F.col("id"), F.col("l_linenumber"))
    rows = first.withColumn("batch_id", F.col("bundle_id")).withColumn("status", F.when(F.col("bundle_id").endswith("Q1"), "PLANNED").otherwise(F.col("status"))).withColumn("row_number", F.col("identity_hash")).withColumn("action", F.lit("UPDATE"))
    # written once: preflight, decisions and stage would each sort all lines for it
    path = folder(spark, "freeze")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    _, snapshot = publication.frozen(rows.drop("amount"), rows.limit(0), rows.select("batch_id", "row_number", "amount"))
    return snapshot.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("frozen"), F.sum("amount").cast("decimal(38,0)").alias("amount"))


@query("c23_approve_planned", BUNDLES + "select case when status = 'PLANNED' then 'READY_FOR_PUBLICATION' else status end as status, count(*) as n from b group by 1")
def _(spark, sf):
    return publication.approve_planned(_bundled(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("s17_incomplete_rows", "select count(*) as n_rows, count(*) filter (s_acctbal < 0) as n_incomplete from supplier")
def _(spark, sf):
    return publication.incomplete_rows(t(spark, sf, "supplier").withColumn("balance", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal"))), ["s_name", "balance"])


@query("s19_drop_batch", "select o_orderkey as batch_id, o_totalprice from orders where o_orderstatus <> 'P'")
def _(spark, sf):
    """Dropped twice, as a cleanup that is repeated after a crash."""
    batches = t(spark, sf, "orders").select(F.col("o_orderkey").alias("batch_id"), "o_orderstatus", "o_totalprice")
    failed = batches.where("o_orderstatus = 'P'")
    return bundles.without_batches(bundles.without_batches(batches, failed), failed).select("batch_id", "o_totalprice")


@query("t03_idempotent_replay", SHAPES + "select '7:3:' || identity_hash || ':OFFER' as idempotency_key, 1 as times from beside where classification <> 'UNCHANGED'")
def _(spark, sf):
    """A pass that ended half-way has written some mutations; the whole delivery comes again."""
    rows = delta.mutations(delta.change_mask(_beside(spark, sf)), "AUTOMATIC", "7:3")
    written = rows.where("row_number % 2 = 0 or row_number % 3 = 0")
    return written.unionByName(delta.only_new(rows, written, ["idempotency_key"])).groupBy("idempotency_key").agg(F.count(F.lit(1)).cast("int").alias("times"))
