"""Which file of a listing to fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decide(listing: DataFrame, watermarks: DataFrame, fetched: DataFrame, *, now: int, least_age: int, most_bytes: int) -> DataFrame:
    """Adds decision to rows of task, name, mtime (seconds), size: one SELECTED file a task, the oldest that qualifies.

    watermarks: task, mark_mtime, mark_name of the last delivered file.
    fetched: task, name, mtime, size of files that were delivered before.
    A task without a watermark starts at its newest file.
    """
    rows = listing.join(fetched.select("task", "name", "mtime", "size", F.lit(True).alias("done")).distinct(), ["task", "name", "mtime", "size"], "left").join(watermarks, "task", "left")
    older = (F.col("mtime") < F.col("mark_mtime")) | ((F.col("mtime") == F.col("mark_mtime")) & (F.col("name") < F.col("mark_name")))
    first = F.when(F.col("mtime").isNull(), "TOO_YOUNG").when(F.col("done"), "ALREADY_FETCHED").when(F.col("mark_mtime").isNotNull() & older, "OLDER_THAN_WATERMARK")
    rows = rows.withColumn("decision", first)
    newest = F.max(F.when(F.col("decision").isNull(), F.struct("mtime", "name"))).over(Window.partitionBy("task"))
    late = F.col("decision").isNull() & F.col("mark_mtime").isNull() & (F.struct("mtime", "name") != newest)
    rows = rows.withColumn("decision", F.when(late, "OLDER_THAN_WATERMARK").otherwise(F.col("decision")))
    unfit = F.when(F.col("mtime") + least_age > now, "TOO_YOUNG").when(F.col("size") > most_bytes, "TOO_LARGE")
    rows = rows.withColumn("decision", F.coalesce("decision", unfit))
    oldest = F.min(F.when(F.col("decision").isNull(), F.struct("mtime", "name"))).over(Window.partitionBy("task"))
    chosen = F.when(F.struct("mtime", "name") == oldest, "SELECTED").otherwise("DEFERRED")
    return rows.withColumn("decision", F.coalesce("decision", chosen)).drop("done", "mark_mtime", "mark_name")
