"""Bundles of batches: conflicts, decisions, freezing and what is frozen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = ("PLANNED", "AWAITING_APPROVAL", "BLOCKED", "READY_FOR_PUBLICATION")


def conflicts_inside(mutations: DataFrame) -> DataFrame:
    """Identities that more than one batch of a bundle touches."""
    return mutations.groupBy("bundle_id", "identity_hash").agg(F.countDistinct("batch_id").alias("n_batches"), F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch")).where("n_batches > 1")


def conflicts_between(mutations: DataFrame) -> DataFrame:
    """bundle_id and identity_hash that another bundle's batch touches too, by counts per identity: no pairs are made."""
    per = mutations.groupBy("identity_hash", "bundle_id").agg(F.lit(1).alias("one"))
    many = per.groupBy("identity_hash").agg(F.count(F.lit(1)).alias("n_bundles")).where("n_bundles > 1")
    return per.join(many, "identity_hash", "left_semi").select("bundle_id", "identity_hash")


def candidates(batches: DataFrame, members: DataFrame) -> DataFrame:
    """Batches that are screened, judged, not blocking and in no active bundle."""
    good = batches.where((F.col("status") == "SCREENED") & F.col("verdict").isNotNull() & (F.col("verdict") != "BLOCKING"))
    return good.join(members.where("active"), "batch_id", "left_anti")


def decide(mutations: DataFrame, chosen: Column, expected: str, to: str) -> DataFrame:
    """Group decision: chosen rows in the expected status go on, and remember what they were; others stay."""
    hit = chosen & (F.col("status") == expected)
    return mutations.withColumn("decided_from", F.when(hit, F.col("status"))).withColumn("status", F.when(hit, to).otherwise(F.col("status")))


def selected(mutations: DataFrame, **wanted) -> DataFrame:
    """Rows by the arguments that are given (None: any)."""
    for column, value in wanted.items():
        if value is not None:
            mutations = mutations.where(F.col(column) == value)
    return mutations


def expire(mutations: DataFrame) -> DataFrame:
    return mutations.withColumn("status", F.when(F.col("status").isin(*OPEN), "EXPIRED").otherwise(F.col("status")))


def totals(members: DataFrame, columns: list[str]) -> DataFrame:
    """Sums by bundle, null unless all members know the number."""
    known = [F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(c) for c in columns]
    return members.groupBy("bundle_id").agg(*known)


def snapshot(mutations: DataFrame, stage: DataFrame) -> DataFrame:
    """What is published: ready creations and updates with their staged values."""
    ready = mutations.where((F.col("status") == "READY_FOR_PUBLICATION") & F.col("action").isin("CREATE", "UPDATE"))
    return ready.join(stage, ["batch_id", "row_number"])


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rn = 1").drop("rn")


def purgeable(batches: DataFrame, members: DataFrame, unsnapshotted: DataFrame) -> DataFrame:
    """Finished batches without a live bundle and with all snapshots present."""
    done = batches.where(F.col("status").isin("SCREENED", "BLOCKED", "FAILED", "BASELINE_ACCEPTED"))
    return done.join(members.where("active"), "batch_id", "left_anti").join(unsnapshotted, "batch_id", "left_anti")


def without_batches(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """A batch table without the rows of failed batches; to do it again changes nothing."""
    return rows.join(failed.select("batch_id").distinct(), "batch_id", "left_anti")
