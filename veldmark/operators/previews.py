"""What a frozen bundle would write for the target system: rows of fields that have a value or say why they have none, and their file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldmark.functions import components as parts_of
from veldmark.functions.fingerprint import amount_text
from veldmark.sources.artifact import write_artifact
from veldmark.sources.delimited import csv_text

# Types of references that have a field, and fields that no contract fills.
REFERENCES = ("EAN", "PIM_ID")
NOT_CONTRACTED = ("PROCESS", "DELETE", "RECORD", "NUMBER")
SALES_PRICES = 5
FIXED_COLUMNS = ("batchId", "mutationId", "actionType", "complete")


def _field(code: str, value: Column, state: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), F.when(state == "VALUE", value).alias("value"), state.alias("state"))


def _needed(value: Column) -> Column:
    return F.when(value.isNull(), "UNKNOWN").otherwise("VALUE")


def _told(value: Column, state: Column, unmapped: str) -> tuple[Column, Column]:
    """Value and state of a text that came with a state of its own: unmapped, EMPTY (mapped, with nothing in it) or VALUE. Others, and a value that isn't there, are unknown."""
    known = F.when(state == unmapped, "NOT_MAPPED").when((state == "EMPTY") | ((state == "VALUE") & value.isNotNull()), "VALUE").otherwise("UNKNOWN")
    return F.when(state == "EMPTY", "").otherwise(value), known


def preview(rows: DataFrame) -> DataFrame:
    """batch_id, mutation_id, action, fields (code, value and state, in order) and complete, false where a field is UNKNOWN or NOT_SNAPSHOTTED.

    rows: mutations with supplier, grp, reference, base_price (micro-units), currency, snapshotted (whether the freeze kept them), description and
    description_state; and perhaps discount and discount_state (else identities have no discount code), reference_type and reference_value (what the mutation does to a
    reference; null: nothing) and components (the nested list). A missing value is never written as 0 or as an empty text.
    """
    absent = F.lit(None).cast("string")
    has = lambda c: F.col(c) if c in rows.columns else absent
    kept = F.coalesce(F.col("snapshotted"), F.lit(False))
    of_snapshot = lambda state: F.when(~kept, "NOT_SNAPSHOTTED").otherwise(state)
    plain = {"SUPPLIER": F.col("supplier"), "SUPPLIER_GROUP": F.col("grp"), "SUPPLIER_REFERENCE": F.col("reference")}
    fields = [_field(code, value, _needed(value)) for code, value in plain.items()]
    fields.append(_field("DISCOUNT_CODE", *_told(has("discount"), has("discount_state") if "discount_state" in rows.columns else F.lit("NOT_USED"), "NOT_USED")))
    for code, value in (("BASE_PRICE", amount_text(F.col("base_price"))), ("BASE_PRICE_CURRENCY", F.col("currency"))):
        fields.append(_field(code, value, _needed(value)))
    kind, reference = has("reference_type"), has("reference_value")
    for code in REFERENCES:
        fields.append(_field(code, reference, F.when(kind.eqNullSafe(F.lit(code)), _needed(reference)).otherwise("NOT_AVAILABLE_IN_MUTATION")))
    # a type that has no field isn't guessed
    fields.append(F.when(kind.isNotNull() & ~kind.isin(*REFERENCES), _field("REFERENCE", absent, F.lit("UNKNOWN"))))
    value, state = _told(F.col("description"), F.col("description_state"), "NOT_MAPPED")
    fields.append(_field("DESCRIPTION", value, of_snapshot(state)))
    for n in range(1, SALES_PRICES + 1):
        part = parts_of.of_code(F.col("components"), F.lit(f"VKP{n}")) if "components" in rows.columns else None
        share = absent if part is None else parts_of.share_text(part["share"])
        fields.append(_field(f"VKP{n}_PCT", share, of_snapshot(F.lit("NOT_MAPPED") if part is None else F.when(part.isNull(), "NOT_MAPPED").otherwise(_needed(share)))))
    fields += [_field(code, absent, F.lit("NOT_CONTRACTED")) for code in NOT_CONTRACTED]
    listed = rows.select("batch_id", "mutation_id", "action", F.filter(F.array(*fields), lambda f: f.isNotNull()).alias("fields"))
    return listed.withColumn("complete", ~F.exists("fields", lambda f: f["state"].isin("UNKNOWN", "NOT_SNAPSHOTTED")))


def banner(contract_status: str, version: str, content_hash: str | None, snapshot: tuple[str | None, str | None] | None = None) -> str:
    """The first line of a preview; with snapshot (its version and hash, null for bundles that were frozen without one), that of an artifact, which says that nothing outside was touched."""
    said = lambda x: "(null)" if x is None else x
    line = f"# PREVIEW previewOnly=true contractStatus={contract_status} previewSpecVersion={version} bundleContentHash={said(content_hash)}"
    if snapshot is None:
        return line
    return f"{line} simulationOnly=true writesToProdis=false snapshotSpecVersion={said(snapshot[0])} snapshotHash={said(snapshot[1])}"


def preview_lines(previewed: DataFrame, first: str) -> DataFrame:
    """ordinal and line of the file: first (a banner) at -2, the header at -1, and rows at their mutation_id. The header has the fields of the first row, so one row reaches the driver; without rows it has the fixed columns only."""
    cell = lambda c: csv_text(c, ",")
    head = previewed.orderBy("mutation_id").select(F.transform("fields", lambda f: f["code"]).alias("codes")).head()
    columns = [*FIXED_COLUMNS, *(name for code in (head["codes"] if head else ()) for name in (code, f"{code}.state"))]
    cells = F.flatten(F.transform("fields", lambda f: F.array(cell(f["value"]), cell(f["state"]))))
    line = F.concat_ws(",", F.col("batch_id").cast("string"), F.col("mutation_id").cast("string"), cell(F.col("action")), F.col("complete").cast("string"), cells)
    top = previewed.sparkSession.createDataFrame([(-2, first), (-1, ",".join(columns))], "ordinal bigint, line string")
    return top.unionByName(previewed.select(F.col("mutation_id").cast("bigint").alias("ordinal"), line.alias("line")))


def write_preview(previewed: DataFrame, path: str, first: str, *, sealed: str | None = None, seconds: float | None = None) -> dict:
    """The file as an artifact of ordered pages; tells its manifest, with the rows that are incomplete."""
    incomplete = previewed.agg(F.count_if(~F.col("complete")).alias("n")).head()["n"]
    return write_artifact(preview_lines(previewed, first), path, sealed, seconds) | {"incomplete": incomplete}
