"""Issue tallies, groups, shares, samples and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_LEAST = 10
SAMPLE_MOST = 200
#: Which case status may follow which.
CASE_STEPS = {("AWAITING_REVIEW", "CORRECTED"), ("AWAITING_REVIEW", "REJECTED"), ("CORRECTED", "AWAITING_REVIEW"), ("REJECTED", "AWAITING_REVIEW"), ("AUTO_RESOLVED", "AWAITING_REVIEW")}


def tally(issues: DataFrame) -> DataFrame:
    """code, signature: occurrences and first row of issues (code, signature, severity, row_number)."""
    return issues.groupBy("code", "signature", "severity").agg(F.count(F.lit(1)).alias("occurrences"), F.min("row_number").alias("first_row"))


def timed_tally(issues: DataFrame, at: Column) -> DataFrame:
    """A tally with the time of its delivery, as first_at and last_at: the state that ``merged_tallies`` adds up."""
    return tally(issues).withColumn("first_at", at).withColumn("last_at", at)


def merged_tallies(*tallies: DataFrame) -> DataFrame:
    """Tallies of several deliveries as one, whatever their order: counts add up, times widen, and the first row is that of the earliest delivery (of deliveries at one time, the least)."""
    rows = tallies[0]
    for t in tallies[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("code", "signature").agg(F.max("severity").alias("severity"), F.sum("occurrences").alias("occurrences"), F.min(F.struct("first_at", "first_row"))["first_row"].alias("first_row"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def samples(issues: DataFrame, most: int = SAMPLE_MOST) -> DataFrame:
    """The first issues of each code in order of rows; totals are kept elsewhere."""
    order = Window.partitionBy("code").orderBy("row_number", "signature")
    return issues.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")


def groups(tallied: DataFrame, sampled: DataFrame) -> DataFrame:
    """Tallies worth a group: ten or more, or more than were sampled."""
    n = sampled.groupBy("code", "signature").agg(F.count(F.lit(1)).alias("recorded"))
    rows = tallied.join(n, ["code", "signature"], "left").withColumn("recorded", F.coalesce("recorded", F.lit(0)))
    return rows.where((F.col("occurrences") >= GROUP_LEAST) | (F.col("occurrences") > F.col("recorded")))


def judged_groups(rows: DataFrame, scope: Column, bulk_percent: int) -> DataFrame:
    """share (10^-12 percent, half up) and bulk: occurrences * 100 > percent * scope, exactly."""
    from veldmark.functions.numeric import half_up_percent

    return rows.withColumn("share", half_up_percent(F.col("occurrences"), scope)).withColumn("bulk", F.col("occurrences") * 100 > scope * bulk_percent)


def severity_totals(grouped: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues by severity: occurrences of groups, and rows without one, none counted twice."""
    alone = issues.join(grouped.select("code", "signature"), ["code", "signature"], "left_anti").groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return grouped.groupBy("severity").agg(F.sum("occurrences").alias("n")).unionByName(alone).groupBy("severity").agg(F.sum("n").alias("n"))


def cap_notices(tallied: DataFrame, sampled: DataFrame) -> DataFrame:
    """Codes of which fewer were recorded than occurred."""
    n = sampled.groupBy("code").agg(F.count(F.lit(1)).alias("recorded"))
    return tallied.groupBy("code").agg(F.sum("occurrences").alias("occurrences")).join(n, "code").where("occurrences > recorded")


def critical_lines(issues: DataFrame, critical_fields: list[str], fields: list[str] | None = None) -> DataFrame:
    """One row: lines with an error on a critical field that no filter rejected. With fields (all that are mapped), an error on none of them, or on no field at all, counts too: nobody has said that it is harmless."""
    critical = F.coalesce(F.col("field").isin(*critical_fields), F.lit(False))
    if fields is not None:
        critical = critical | F.coalesce(~F.col("field").isin(*fields), F.lit(True))
    hit = (F.col("severity") == "ERROR") & critical & (F.col("code") != "FILTER_RECORD_REJECTED")
    return issues.agg(F.countDistinct(F.when(hit, F.col("row_number"))).alias("critical_lines"))


def case_counts(observations: DataFrame) -> DataFrame:
    """Per case (code, signature): observations, occurrences, first and last time, and batch of the first and last by (time, batch)."""
    at = F.struct("seen_at", "batch_id")
    return observations.groupBy("code", "signature").agg(F.count(F.lit(1)).alias("n_observations"), F.sum("occurrences").alias("occurrences"), F.min("seen_at").alias("first_at"), F.max("seen_at").alias("last_at"), F.min_by("batch_id", at).alias("first_batch"), F.max_by("batch_id", at).alias("last_batch"))


def sync_cases(cases: DataFrame, observed: DataFrame) -> DataFrame:
    """Cases after a batch: new ones await review; corrected and resolved ones reopen when they recur, rejected ones only under another revision."""
    new = observed.select("code", "signature", F.col("revision").alias("new_revision"), F.lit(True).alias("seen"))
    rows = cases.join(new, ["code", "signature"], "full")
    reopen = F.col("seen") & (F.col("status").isin("CORRECTED", "AUTO_RESOLVED") | ((F.col("status") == "REJECTED") & (F.col("new_revision") != F.col("revision"))))
    status = F.when(F.col("status").isNull() | F.coalesce(reopen, F.lit(False)), "AWAITING_REVIEW").otherwise(F.col("status"))
    event = F.when(F.col("status").isNull(), "OPENED").when(F.coalesce(reopen, F.lit(False)), "REOPENED")
    return rows.select("code", "signature", status.alias("status"), F.coalesce("new_revision", "revision").alias("revision"), event.alias("event"))


def allowed_step(old: Column, new: Column) -> Column:
    return F.concat(old, F.lit(">"), new).isin(*sorted(f"{a}>{b}" for a, b in CASE_STEPS))
