"""A delivery whose offers are told apart by discount codes too, and the preview of its mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldmark.functions import fingerprint as fp
from veldmark.functions import values
from veldmark.functions.components import PriceComponent
from veldmark.functions.transforms import FieldMapping
from veldmark.operators import previews, screening
from veldmark.plans import adapt
from veldmark.plans.catalog import query
from veldmark.plans.places import folder
from veldmark.plans.priced import AMOUNT, _part, _part_sql, _share_sql, _share_text_sql
from veldmark.sources.delimited import Structure, write_parts

HEADER = "SUP;GRP;REF;CODE;NAME;PRICE;SALE;SINCE"
PROFILE = screening.Profile(
    structure=Structure(tuple(HEADER.split(";")), in_parts=True),
    mappings=(
        FieldMapping("supplier", "SUP"), FieldMapping("grp", "GRP"), FieldMapping("reference", "REF"), FieldMapping("discount", "CODE"), FieldMapping("description", "NAME"), FieldMapping("base_price", "PRICE", **AMOUNT),
        FieldMapping("VKP1", "SALE", **AMOUNT), FieldMapping("since", "SINCE", type="DATE"), FieldMapping("origin", default="BE"),
    ),
    components=(PriceComponent("VKP1", "VKP1"),), version=2, link_currency="EUR", discount=True, article_fields=("origin", "since"),
    deviation_percent=1_000_000, bulk_percent=100, critical_percent=None, creation_percent=100,
)
#: Deviations have queries of their own, so none is reached here. Of offer k: its discount code, its day as it is delivered, and whether that can be read.
CODE = "case when row_number % 3 = 0 then '' else 'D' || cast(row_number % 4 as {text}) end"
SINCE = "case when row_number % 29 = 0 then '01/02/2024' when row_number % 31 = 0 then '2024-02-30' else '2024-01-15' end"


def screened(spark, sf: str) -> screening.Screened:
    """Names of every fifth offer have commas and quotes, and those of every seventh a formula's first character; every tenth has no sales price."""
    path = folder(spark, "discounts")
    k, code = F.col("row_number"), F.expr(CODE.format(text="string"))
    sale = F.when(k % 10 != 4, fp.amount_text(F.expr(_part("base_price", "110 + row_number % 23"))))
    name = F.when(k % 5 == 0, F.concat("description", F.lit(', ""new""'))).when(k % 7 == 0, F.concat(F.lit("=1+"), "description")).otherwise(F.col("description"))
    fields = ["supplier", "grp", "reference", F.concat(F.lit(" "), code), F.concat(F.lit('"'), name, F.lit('"')), fp.amount_text(F.col("base_price")), F.coalesce(sale, F.lit("")), F.expr(SINCE)]
    rows = adapt.stage(spark, sf).select("row_number", F.concat_ws(";", *fields).alias("value"))
    header = spark.createDataFrame([(-1, HEADER)], "row_number long, value string")
    write_parts(header.unionByName(rows), "row_number", f"{path}/in")
    known = adapt.state(spark, sf).withColumn("identity_hash", fp.identity(2, F.col("supplier"), F.col("grp"), F.col("reference"), code))
    known = known.withColumn("discount", code).select("identity_hash", "article_fingerprint", "price_fingerprint", "combined_fingerprint", "base_price", "currency", *PROFILE.identity)
    known.write.parquet(f"{path}/state")
    none = spark.createDataFrame([], "identity_hash string, component_code string, observation_date date, amount decimal(24,0)")
    return screening.screen(spark, f"{path}/in", PROFILE, spark.read.parquet(f"{path}/state"), none, path)


def previewed(spark, sf: str) -> DataFrame:
    """The preview of the run's mutations. Every thirteenth wasn't kept when the bundle was frozen, and every seventeenth touches a reference."""
    run = screened(spark, sf)
    staged = run.staged.select("row_number", *PROFILE.identity, "discount_state", "base_price", "currency", "description", values.description_state(F.col("description")).alias("description_state"), "components")
    k = F.col("reference").cast("bigint")
    kind = F.when(k % 17 == 0, F.when(k % 2 == 0, "EAN").otherwise("PIM_ID")).when(k % 19 == 0, "MPN")
    rows = run.mutations.select("row_number", "action").join(staged, "row_number").select(F.lit(7).alias("batch_id"), (k + 1_000).alias("mutation_id"), "*", (k % 13 != 0).alias("snapshotted"), kind.alias("reference_type"), F.when(k % 4 != 0, F.concat(F.lit("E"), "reference")).alias("reference_value"))
    return previews.preview(rows)


_CODE = CODE.format(text="varchar")
VALID = adapt.SHAPES_SQL + f""", d as (select row_number as k, supplier, grp, reference, {_CODE} as code, base_price, {SINCE} as since,
  case when row_number % 5 = 0 then description || ', "new"' when row_number % 7 = 0 then '=1+' || description else description end as name,
  case when row_number % 10 <> 4 then {_part_sql('base_price', '110 + row_number % 23')} end as sale, row_number in (select row_number from state) as known from stage), v as (select * from d where since = '2024-01-15')
"""


@query("screening_discount_identities", VALID + """select reference, code as discount, case when code = '' then 'EMPTY' else 'VALUE' end as discount_state, case when known then 'UPDATE' else 'CREATE' end as action,
  sha256(concat_ws(chr(31), '2', supplier, grp, code, reference)) as identity_hash from v""")
def _(spark, sf):
    """Mutations of offers that are told apart by discount codes, of which empty ones are values too."""
    run = screened(spark, sf)
    return run.mutations.join(run.staged.select("row_number", "reference", "discount", "discount_state"), "row_number").select("reference", "discount", "discount_state", "action", "identity_hash")


@query("screening_record_notices", VALID + """select 'VALUE_DEFAULT_APPLIED' as code, 'origin' as field, 'INFO' as severity, count(*) as n from v having count(*) > 0
union all select case when since = '01/02/2024' then 'DATE_AMBIGUOUS' else 'DATE_UNREADABLE' end, 'since', 'ERROR', count(*) from d where since <> '2024-01-15' group by 1""")
def _(spark, sf):
    """Defaults that valid records got, days that could be read in two ways, and days that don't exist."""
    return screened(spark, sf).issues.groupBy("code", "field", "severity").agg(F.count(F.lit(1)).alias("n"))


def _cell_sql(c: str) -> str:
    return f"""(case when {c} similar to '[^,"]*' then {c} else '"' || replace({c}, '"', '""') || '"' end)"""


_BANNER = ("PROVISIONAL", "2", None)
_GUARDED = "(case when name like '=%' then '''' || name else name end)"
PREVIEW_SQL = VALID + f""", s as (select *, {_share_sql('sale', 'base_price')} as share, k % 13 <> 0 as kept, case when k % 17 = 0 then case when k % 2 = 0 then 'EAN' else 'PIM_ID' end when k % 19 = 0 then 'MPN' end as kind, case when k % 4 <> 0 then 'E' || reference end as ref from v),
r as (select k + 1000 as ordinal, concat_ws(',', '7', k + 1000, case when known then 'UPDATE' else 'CREATE' end,
  case when kept and coalesce(kind <> 'MPN', true) and (kind is null or ref is not null) then 'true' else 'false' end,
  supplier || ',VALUE', grp || ',VALUE', reference || ',VALUE', code || ',VALUE', cast(base_price // 1000000 as varchar) || '.' || lpad(cast(base_price % 1000000 as varchar), 6, '0') || ',VALUE', 'EUR,VALUE',
  case when kind = 'EAN' then coalesce(ref || ',VALUE', ',UNKNOWN') else ',NOT_AVAILABLE_IN_MUTATION' end, case when kind = 'PIM_ID' then coalesce(ref || ',VALUE', ',UNKNOWN') else ',NOT_AVAILABLE_IN_MUTATION' end,
  case when kind = 'MPN' then ',UNKNOWN' end, case when kept then {_cell_sql(_GUARDED)} || ',VALUE' else ',NOT_SNAPSHOTTED' end,
  case when not kept then ',NOT_SNAPSHOTTED' when sale is null then ',NOT_MAPPED' else {_share_text_sql('share')} || ',VALUE' end,
  case when kept then ',NOT_MAPPED,,NOT_MAPPED,,NOT_MAPPED,,NOT_MAPPED' else ',NOT_SNAPSHOTTED,,NOT_SNAPSHOTTED,,NOT_SNAPSHOTTED,,NOT_SNAPSHOTTED' end, ',NOT_CONTRACTED,,NOT_CONTRACTED,,NOT_CONTRACTED,,NOT_CONTRACTED') as line, kind from s),
h as (select concat_ws(',', 'batchId,mutationId,actionType,complete,SUPPLIER,SUPPLIER.state,SUPPLIER_GROUP,SUPPLIER_GROUP.state,SUPPLIER_REFERENCE,SUPPLIER_REFERENCE.state,DISCOUNT_CODE,DISCOUNT_CODE.state,BASE_PRICE,BASE_PRICE.state,BASE_PRICE_CURRENCY,BASE_PRICE_CURRENCY.state,EAN,EAN.state,PIM_ID,PIM_ID.state',
  case when (select kind from r order by ordinal limit 1) = 'MPN' then 'REFERENCE,REFERENCE.state' end, 'DESCRIPTION,DESCRIPTION.state,VKP1_PCT,VKP1_PCT.state,VKP2_PCT,VKP2_PCT.state,VKP3_PCT,VKP3_PCT.state,VKP4_PCT,VKP4_PCT.state,VKP5_PCT,VKP5_PCT.state,PROCESS,PROCESS.state,DELETE,DELETE.state,RECORD,RECORD.state,NUMBER,NUMBER.state') as line),
f as (select -2::bigint as ordinal, '{previews.banner(*_BANNER)}' as line union all select -1, line from h union all select ordinal, line from r)
"""


@query("s16_preview_file", PREVIEW_SQL + "select ordinal, line from f")
def _(spark, sf):
    """The preview file of the delivery's mutations, line by line."""
    return previews.preview_lines(previewed(spark, sf), previews.banner(*_BANNER))


@query("s16_preview_artifact", PREVIEW_SQL + "select sha256(string_agg(line || chr(10), '' order by ordinal)) as sha256, count(*) as n_lines, (select count(*) from r where line like '7,%,%,false,%' and split_part(line, ',', 4) = 'false') as incomplete from f")
def _(spark, sf):
    """The same file as an artifact of ordered pages: the hash of its bytes, its lines, and rows that are incomplete."""
    path = folder(spark, "preview")
    previewed(spark, sf).write.parquet(f"{path}/rows")
    told = previews.write_preview(spark.read.parquet(f"{path}/rows"), f"{path}/file", previews.banner(*_BANNER), seconds=3600)
    return spark.createDataFrame([(told["sha256"], told["rows"], told["incomplete"])], "sha256 string, n_lines bigint, incomplete bigint")
