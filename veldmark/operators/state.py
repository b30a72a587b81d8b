"""Acceptance of a delivery: the next version of the state, of prices and of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldmark.operators import prices


def stale(staged: DataFrame, state: DataFrame) -> DataFrame:
    """Rows whose state is not what they were compared with."""
    now = state.select("identity_hash", F.col("combined_fingerprint").alias("now"))
    return staged.join(now, "identity_hash", "left").where(~F.col("now").eqNullSafe(F.col("old_combined_fingerprint")))


def accept(state: DataFrame, staged: DataFrame, columns: list[str]) -> DataFrame:
    """State after acceptance: NEW rows come in, CHANGED ones replace columns; identities stay as they were."""
    new = staged.where(F.col("classification").isin("NEW", "CHANGED")).select("identity_hash", F.lit(True).alias("taken"), *(F.col(c).alias(f"new_{c}") for c in columns))
    rows = state.join(new, "identity_hash", "full")
    return rows.select("identity_hash", *(F.when(F.col("taken"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in columns))


class AcceptanceRefused(ValueError):
    """A delivery that may not become the baseline; code says why."""

    def __init__(self, code: str, n: int):
        super().__init__(f"{code}: {n} rows")
        self.code = code


def accept_baseline(
    staged: DataFrame, state: DataFrame, columns: list[str], observations: DataFrame, day, *, component_prices: DataFrame | None = None, staged_prices: DataFrame | None = None, references: DataFrame | None = None, staged_references: DataFrame | None = None, live_bundle: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """What the tables are after a delivery was accepted: state, observations, and prices and references where they are given.

    Refused if the state has moved since the delivery was compared with it, or if a live bundle (mutations of bundles that aren't finished) touches its identities.
    """
    changed = staged.where(F.col("classification").isin("NEW", "CHANGED"))
    if n := stale(staged, state).count():
        raise AcceptanceRefused("SOURCE_STATE_CHANGED_SINCE_SCREENING", n)
    if live_bundle is not None and (n := live_bundle.join(changed.select("identity_hash").distinct(), "identity_hash", "left_semi").count()):
        raise AcceptanceRefused("BUNDLE_STILL_LIVE", n)
    out = {"state": accept(state, staged, columns), "observations": append_observations(observations, staged, day)}
    touched = changed.select("identity_hash").distinct()
    if component_prices is not None:  # prices of touched offers are replaced as a whole
        new = staged_prices.join(touched, "identity_hash", "left_semi").select(*component_prices.columns)
        out["component_prices"] = component_prices.join(touched, "identity_hash", "left_anti").unionByName(new)
    if references is not None:  # references are only added; one that is active stays
        new = staged_references.where("value is not null").join(touched, "identity_hash", "left_semi").select(*references.columns).distinct()
        out["references"] = references.unionByName(new.join(references.select("reference_type", "value"), ["reference_type", "value"], "left_anti"))
    return out


def append_observations(observations: DataFrame, staged: DataFrame, day) -> DataFrame:
    """At most one value a key and day, the first: today's values of NEW and CHANGED rows where the day has none."""
    changed = staged.where(F.col("classification").isin("NEW", "CHANGED"))
    today = prices.values_of(changed).select("identity_hash", "component_code", F.lit(day).cast("date").alias("observation_date"), "amount")
    return observations.unionByName(today.join(observations, ["identity_hash", "component_code", "observation_date"], "left_anti"))


def skip_open(mutations: DataFrame) -> DataFrame:
    """Open mutations of an accepted batch are skipped."""
    return mutations.withColumn("status", F.when(F.col("status").isin("PLANNED", "AWAITING_APPROVAL", "BLOCKED", "READY_FOR_PUBLICATION"), "SKIPPED").otherwise(F.col("status")))
