"""A delivery against the accepted state: classification, duplicates, masks and mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldmark.functions import components as parts_of

STATE_COLUMNS = ["article_fingerprint", "price_fingerprint", "combined_fingerprint", "base_price", "currency"]


def differs(a: Column, b: Column) -> Column:
    """SQL's a <> b with unknown taken as no."""
    return F.coalesce(a != b, F.lit(False))


def beside_state(stage: DataFrame, state: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Stage rows with the state of their identity, as old_* columns; one row each, as the state's key is unique."""
    old = [F.col(c).alias(f"old_{c}") for c in columns or STATE_COLUMNS]
    return stage.join(state.select("identity_hash", F.lit(True).alias("known"), *old), "identity_hash", "left")


def classified(beside: DataFrame) -> DataFrame:
    """NEW, UNCHANGED or CHANGED; rows that have a classification keep it."""
    verdict = F.when(F.col("known").isNull(), "NEW").when(F.col("old_combined_fingerprint") == F.col("combined_fingerprint"), "UNCHANGED").otherwise("CHANGED")
    held = F.col("classification") if "classification" in beside.columns else F.lit(None).cast("string")
    return beside.withColumn("classification", F.coalesce(held, verdict))


def counted(rows: DataFrame) -> DataFrame:
    """classification and n; rows without one are not counted."""
    return rows.where("classification is not null").groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


def duplicate_identities(stage: DataFrame) -> DataFrame:
    """identity_hash, n_rows and first_row of identities delivered more than once; they block the delivery."""
    return stage.groupBy("identity_hash").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_number").alias("first_row")).where("n_rows > 1")


def duplicate_rows(stage: DataFrame) -> DataFrame:
    """Rows of identities that were delivered more than once, with the first row of each."""
    return stage.join(duplicate_identities(stage), "identity_hash").select("identity_hash", "row_number", "first_row")


def hash_collisions(stage: DataFrame, parts: list[str]) -> DataFrame:
    """Hashes under which parts differ, with their smallest row."""
    unequal = F.lit(False)
    for p in parts:
        unequal = unequal | differs(F.min(p), F.max(p))
    return stage.groupBy("identity_hash").agg(unequal.alias("collides"), F.min("row_number").alias("first_row")).where("collides").drop("collides")


def repeated_rows(stage: DataFrame, parts: list[str]) -> DataFrame:
    """row_number of each row whose identity was delivered more than once, and collides: on the first row of a hash under which parts differ. What ``duplicate_rows`` and ``hash_collisions`` tell, from one grouping."""
    unequal = F.lit(False)
    for p in parts:
        unequal = unequal | differs(F.min(p), F.max(p))
    repeated = stage.groupBy("identity_hash").agg(F.count(F.lit(1)).alias("n_rows"), unequal.alias("unequal"), F.min("row_number").alias("first_row")).where("n_rows > 1")
    return stage.select("identity_hash", "row_number").join(repeated, "identity_hash").select("row_number", (F.col("unequal") & (F.col("row_number") == F.col("first_row"))).alias("collides"))


def collisions_with_state(stage: DataFrame, state: DataFrame, parts: list[str]) -> DataFrame:
    """Stage rows whose hash the state holds for other parts."""
    old = state.select("identity_hash", *(F.col(p).alias(f"old_{p}") for p in parts))
    unequal = F.lit(False)
    for p in parts:
        unequal = unequal | differs(F.col(p), F.col(f"old_{p}"))
    return stage.join(old, "identity_hash").where(unequal).select("identity_hash", "row_number")


def component_changes(new: DataFrame, old: DataFrame, value: str = "percentage") -> DataFrame:
    """identity_hash and component_code where a component appears, goes or has another value."""
    both = new.select("identity_hash", "component_code", F.col(value).alias("new")).join(old.select("identity_hash", "component_code", F.col(value).alias("old")), ["identity_hash", "component_code"], "full")
    return both.where(~F.col("new").eqNullSafe(F.col("old")))


def change_mask(beside: DataFrame, components: DataFrame | None = None, codes: list[str] | None = None) -> DataFrame:
    """mask of CHANGED rows: ARTICLE, PRICE and PRICE:code parts; null where nothing of these changed (a reference alone, or a currency that was only assumed).

    Components come as a table of changes (``component_changes``), or nested in the rows as components and old_components; codes then names those that are configured.
    """
    rows = beside
    more = F.lit(None).cast("string")
    assumed = F.coalesce(F.col("currency_origin") == "SYSTEM_DEFAULT", F.lit(False)) if "currency_origin" in beside.columns else F.lit(True)
    if components is not None:
        changed = components.groupBy("identity_hash").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("PRICE:"), "component_code"))), ",").alias("codes"))
        rows, more = rows.join(changed, "identity_hash", "left"), F.nullif(F.col("codes"), F.lit(""))
    elif {"components", "old_components"} <= set(beside.columns):
        named = parts_of.changed_codes(F.col("components"), F.col("old_components"), assumed)
        named = named if codes is None else F.array_intersect(named, F.array(*map(F.lit, codes)))
        more = F.nullif(F.array_join(F.transform(named, lambda c: F.concat(F.lit("PRICE:"), c)), ","), F.lit(""))
    article = F.when(differs(F.col("article_fingerprint"), F.col("old_article_fingerprint")), "ARTICLE")
    other_currency = differs(F.col("currency"), F.col("old_currency")) | (F.col("old_currency").isNull() & ~assumed)
    price = F.when(differs(F.col("base_price"), F.col("old_base_price")) | other_currency, "PRICE")
    mask = F.nullif(F.concat_ws(",", article, price, more), F.lit(""))
    return rows.withColumn("mask", F.when(F.col("classification") == "CHANGED", mask)).drop("codes")


def mutations(masked: DataFrame, creation_outcome: str, prefix: str, held: DataFrame | None = None) -> DataFrame:
    """CREATE and UPDATE rows with before and after; creations wait unless they are automatic, rows with an identity incident are blocked."""
    rows = masked.where(F.col("classification").isin("NEW", "CHANGED"))
    blocked = F.lit(False)
    if held is not None:
        rows = rows.join(held.select("row_number", F.lit(True).alias("incident")).distinct(), "row_number", "left")
        blocked = F.coalesce("incident", F.lit(False))
    create = F.col("classification") == "NEW"
    waits = create & F.lit(creation_outcome != "AUTOMATIC")
    status = F.when(blocked, "BLOCKED").when(waits, "AWAITING_APPROVAL").otherwise("PLANNED")
    return rows.select(
        F.concat(F.lit(f"{prefix}:"), "identity_hash", F.lit(":OFFER")).alias("idempotency_key"), "identity_hash", "row_number", F.when(create, "CREATE").otherwise("UPDATE").alias("action"), status.alias("status"),
        F.when(waits & ~blocked, creation_outcome).alias("reason"), F.col("old_base_price").alias("before_price"), F.col("base_price").alias("after_price"), F.col("old_combined_fingerprint").alias("before_fingerprint"), F.col("combined_fingerprint").alias("after_fingerprint"), "mask",
    )


def only_new(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-if-absent: rows whose key is not known yet."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def hold_price_updates(rows: DataFrame, bulk_price_incident: bool) -> DataFrame:
    """Planned updates that touch prices wait when prices of the delivery are a bulk incident."""
    hit = (F.col("action") == "UPDATE") & (F.col("status") == "PLANNED") & F.coalesce(F.col("mask").contains("PRICE"), F.lit(False))
    return rows.withColumn("status", F.when(hit & F.lit(bulk_price_incident), "AWAITING_APPROVAL").otherwise(F.col("status")))
