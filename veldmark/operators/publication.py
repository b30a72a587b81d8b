"""Freezing a bundle, what its content hashes to, previews and simulated publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldmark.functions.fingerprint import MISSING, PART, ordered_hash
from veldmark.operators import bundles
from veldmark.sources.artifact import write_artifact


def preflight(mutations: DataFrame, stale: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """bundle_id, undecided, stale and conflicts of each bundle; all are 0 where it may be frozen. live: mutations (bundle_id, identity_hash) of bundles that aren't finished; with them also conflicts_between, the identities that such another bundle touches too."""
    counts = mutations.groupBy("bundle_id").agg(F.count_if(F.col("status") == "AWAITING_APPROVAL").alias("undecided"))
    of = lambda rows, name: rows.groupBy("bundle_id").agg(F.count(F.lit(1)).alias(name))
    rows = counts.join(of(stale, "stale"), "bundle_id", "left").join(of(bundles.conflicts_inside(mutations), "conflicts"), "bundle_id", "left")
    if live is None:
        return rows.fillna(0, ["stale", "conflicts"])
    # an identity is in conflict for a bundle if bundles beside that one touch it: counts by identity, no pairs
    own = mutations.select("bundle_id", "identity_hash").distinct()
    all_ = live.select("bundle_id", "identity_hash").unionByName(own).distinct()
    shared = all_.groupBy("identity_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(of(own.join(shared, "identity_hash", "left_semi"), "conflicts_between"), "bundle_id", "left")
    return rows.fillna(0, ["stale", "conflicts", "conflicts_between"])


def frozen(mutations: DataFrame, stale: DataFrame, stage: DataFrame, live: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A sealed freeze: bundles whose preflight is clear have their planned mutations approved and their content copied. Returns the mutations and the snapshot of frozen bundles, which no later decision changes."""
    clear = preflight(mutations, stale, live).where("undecided = 0 and stale = 0 and conflicts = 0" + ("" if live is None else " and conflicts_between = 0")).select("bundle_id")
    inside = approve_planned(mutations.join(clear, "bundle_id", "left_semi"))
    rest = mutations.join(clear, "bundle_id", "left_anti").withColumn("decided_from", F.lit(None).cast("string"))
    return inside.unionByName(rest), bundles.snapshot(inside, stage)


def approve_planned(mutations: DataFrame) -> DataFrame:
    """Planned mutations are approved by the freeze itself."""
    return bundles.decide(mutations, F.lit(True), "PLANNED", "READY_FOR_PUBLICATION")


def plain_amount(micro: Column) -> Column:
    """An amount without trailing zeros, as hashes take it; "null" where there is none."""
    digits = F.lpad(F.abs(micro).cast("string"), 7, "0")
    long = F.greatest(F.length(F.abs(micro).cast("string")), F.lit(7))
    digits = F.when(F.length(F.abs(micro).cast("string")) > 7, F.abs(micro).cast("string")).otherwise(digits)
    whole, part = F.substring(digits, F.lit(1), long - 6), F.regexp_replace(F.right(digits, F.lit(6)), "0+$", "")
    return F.coalesce(F.concat(F.when(micro < 0, "-").otherwise(""), whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise("")), F.lit("null"))


def snapshot_hash(snapshot: DataFrame, components: DataFrame) -> DataFrame:
    """bundle_id and hash over mutations in order of id, each with its components in order of code."""
    child = components.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("component_code", F.coalesce(F.col("percentage").cast("string"), F.lit(MISSING)).alias("p")))), lambda c: F.concat_ws(PART, c["component_code"], c["p"])), PART).alias("children"))
    line = F.concat_ws(PART, F.col("id").cast("string"), plain_amount(F.col("amount")), F.coalesce("children", F.lit("null")))
    return ordered_hash(snapshot.join(child, "id", "left"), "bundle_id", line, F.col("id"), "snapshot_hash")


def field_state(value: Column, *, mapped: Column | bool = True, in_mutation: Column | bool = True, contracted: Column | bool = True, snapshotted: Column | bool = True) -> Column:
    """Why a preview field has a value or has none."""
    lit = lambda b: b if isinstance(b, Column) else F.lit(b)
    return F.when(~lit(contracted), "NOT_CONTRACTED").when(~lit(mapped), "NOT_MAPPED").when(~lit(in_mutation), "NOT_AVAILABLE_IN_MUTATION").when(~lit(snapshotted), "NOT_SNAPSHOTTED").when(value.isNull(), "UNKNOWN").otherwise("VALUE")


def next_attempt(runs: DataFrame) -> DataFrame:
    """bundle_id and the number of its next run."""
    return runs.groupBy("bundle_id").agg((F.coalesce(F.max("attempt"), F.lit(0)) + 1).alias("next_attempt"))


def incomplete_rows(rows: DataFrame, needed: list[str]) -> DataFrame:
    """One row: rows of an artifact, and how many lack a needed field."""
    lacks = F.lit(False)
    for c in needed:
        lacks = lacks | F.col(c).isNull()
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(lacks).alias("n_incomplete"))


def bulk_roll_up(judged: DataFrame) -> DataFrame:
    """Delivery-level issues: bulk groups of price and identity incidents; others make none."""
    return judged.where(F.col("bulk") & F.col("incident_kind").isin("PRICE", "IDENTITY")).select(F.concat(F.lit("BULK_"), "incident_kind", F.lit("_INCIDENT")).alias("code"), "signature", "occurrences")


def trial_duplicates(identities: DataFrame) -> DataFrame:
    """One row: rows of a trial read whose identity occurs more than once. No bound on tracked identities is needed."""
    n = identities.groupBy("identity_hash").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"))


class ContentChanged(ValueError):
    """A frozen bundle whose content is no longer what was sealed."""

    def __init__(self, bundle: str):
        super().__init__(f"SNAPSHOT_CHANGED: {bundle}")
        self.bundle = bundle


def publish(bundle: str, snapshot: DataFrame, components: DataFrame, sealed: str, lines: DataFrame, path: str, *, sealed_bytes: str | None = None, seconds: float | None = None) -> dict:
    """Publishes the artifact of one frozen bundle: its content must still hash to what was sealed when it was frozen, and the bytes written to sealed_bytes, if given. Tells the artifact's manifest."""
    own = snapshot.where(F.col("bundle_id") == bundle)
    now = snapshot_hash(own, components).head()
    if now is None or now["snapshot_hash"] != sealed:
        raise ContentChanged(bundle)
    return write_artifact(lines, path, sealed_bytes, seconds)


def simulation(snapshot: DataFrame, components: DataFrame, runs: DataFrame, needed: list[str]) -> DataFrame:
    """A simulated publication of frozen bundles: bundle_id, the number of the attempt, n_rows, n_incomplete (rows that lack a needed field) and the hash of what would be sent. Nothing outside is touched."""
    lacks = F.lit(False)
    for c in needed:
        lacks = lacks | F.col(c).isNull()
    counts = snapshot.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(lacks).alias("n_incomplete"))
    rows = counts.join(snapshot_hash(snapshot, components), "bundle_id").join(next_attempt(runs), "bundle_id", "left")
    return rows.select("bundle_id", F.coalesce("next_attempt", F.lit(1)).cast("bigint").alias("attempt"), "n_rows", "n_incomplete", "snapshot_hash")
