"""Critical references: duplicates inside a delivery, and each against who holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_references(refs: DataFrame) -> DataFrame:
    """Reference rows whose value more than one identity carries. refs: row_number, identity_hash, reference_type, value."""
    shared = refs.where("value is not null").groupBy("reference_type", "value").agg(F.countDistinct("identity_hash").alias("n")).where("n > 1")
    return refs.join(shared.drop("n"), ["reference_type", "value"], "left_semi")


def match(refs: DataFrame, own: DataFrame, holders: DataFrame) -> DataFrame:
    """match_result, incident and link_proposal for each row and type.

    refs: row_number, identity_hash, reference_type, value (null: mapped but empty), known (the offer has a state).
    own: identity_hash, reference_type, value of the offer's active references.
    holders: reference_type, value, identity_hash of all active references.
    """
    mine = own.groupBy("identity_hash", "reference_type").agg(F.count(F.lit(1)).alias("n_active"), F.min("value").alias("own_value"))
    others = holders.select("reference_type", "value", F.col("identity_hash").alias("holder"))
    foreign = refs.where("value is not null").join(others, ["reference_type", "value"]).where(F.col("holder") != F.col("identity_hash"))
    foreign = foreign.groupBy("row_number", "reference_type").agg(F.countDistinct("holder").alias("n_foreign"))
    rows = refs.join(mine, ["identity_hash", "reference_type"], "left").join(foreign, ["row_number", "reference_type"], "left")
    active, n_foreign, empty = F.coalesce("n_active", F.lit(0)), F.coalesce("n_foreign", F.lit(0)), F.col("value").isNull()
    result = (
        F.when(active > 1, "AMBIGUOUS").when(empty & (active == 1), "REMOVED").when(empty, None).when(n_foreign >= 2, "AMBIGUOUS")
        .when((active == 1) & (F.col("own_value") == F.col("value")), "SAME").when(~F.col("known") & (n_foreign == 1), "SAME").when(~F.col("known"), "NEW")
        .when(n_foreign == 1, "REUSED").when(active == 0, "NEW").otherwise("CHANGED")
    )
    rows = rows.withColumn("match_result", result)
    incident = F.coalesce(F.col("match_result").isin("AMBIGUOUS", "REMOVED", "REUSED", "CHANGED"), F.lit(False))
    return rows.select("row_number", "identity_hash", "reference_type", "value", "match_result", incident.alias("incident"), (~F.col("known") & (n_foreign == 1) & ~incident & ~empty).alias("link_proposal"))


def found(refs: DataFrame, active: DataFrame) -> DataFrame:
    """What of refs needs to be told: rows of ``match`` that are an incident or propose a link, and rows of ``duplicate_references`` (duplicate), each as a row of its own. active: all active references."""
    none = F.lit(False)
    matched = match(refs, active, active).where("incident or link_proposal").withColumn("duplicate", none)
    twice = duplicate_references(refs).select("row_number", "identity_hash", "reference_type", "value", F.lit(None).cast("string").alias("match_result"), none.alias("incident"), none.alias("link_proposal"), F.lit(True).alias("duplicate"))
    return matched.unionByName(twice)


def incident_mutations(matched: DataFrame, prefix: str) -> DataFrame:
    return matched.where("incident").select(F.concat(F.lit(f"{prefix}:"), "identity_hash", F.lit(":REFERENCE:"), "reference_type").alias("idempotency_key"), "identity_hash", "row_number", F.lit("IDENTITY_REFERENCE_INCIDENT").alias("action"), F.lit("AWAITING_APPROVAL").alias("status"), F.col("match_result").alias("reason"))
