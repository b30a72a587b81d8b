"""Thresholds, creation policy and the verdict on a delivery. Unknown counts stay null and are never taken for zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold(count: Column, scope: Column, percent: Column) -> Column:
    """UNDETERMINED, NOT_APPLICABLE, WITHIN or EXCEEDED (strictly more than percent of the scope)."""
    return (
        F.when(count.isNull() | scope.isNull(), "UNDETERMINED").when(count <= 0, "NOT_APPLICABLE").when(percent.isNull(), "WITHIN")
        .when(scope <= 0, "EXCEEDED").when(count * 100 > percent * scope, "EXCEEDED").otherwise("WITHIN")
    )


def blocking_threshold(critical: Column, rejected: Column) -> Column:
    """Which threshold blocks: critical lines lead."""
    return F.when(critical == "EXCEEDED", "CRITICAL").when(rejected == "EXCEEDED", "REJECTED")


def creation_outcome(candidates: Column, scope: Column, percent: Column) -> Column:
    return F.when(candidates <= 0, "AUTOMATIC").when(scope <= 0, "INITIAL_LOAD").when(candidates * 100 > percent * scope, "THRESHOLD_EXCEEDED").otherwise("AUTOMATIC")


def verdict(blocked: Column, critical: Column, review: Column, awaiting: Column, warnings: Column) -> Column:
    return F.when(blocked, "BLOCKING").when((critical > 0) | review | (awaiting > 0), "REVIEW_REQUIRED").when(warnings > 0, "VALID_WITH_WARNINGS").otherwise("VALID")


def counters(routed: DataFrame) -> DataFrame:
    """One row: raw, filtered, error_before_filter, rejected and valid of routed records; they add up."""
    n = lambda r: F.count_if(F.col("route") == r).alias(r.lower())
    return routed.agg(F.count(F.lit(1)).alias("raw"), n("FILTERED"), n("ERROR_BEFORE_FILTER"), n("REJECTED"), n("VALID"))
