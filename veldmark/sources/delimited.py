"""Delimited deliveries: one physical line is one record, errors stay with their line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldmark.functions.text import split_record
from veldmark.sources.archive import digests, files_at, listed


@dataclass(frozen=True)
class Structure:
    """Declared shape of a delivery; nothing is inferred."""

    fields: tuple[str, ...]  # header names, or 1-based places as text where by_index
    delimiter: str = ";"
    quote: str | None = '"'
    charset: str = "UTF-8"
    header_line: int = 1  # 0: none
    by_index: bool = False
    column_count: int | None = None
    max_line_length: int = 100_000
    in_parts: bool = False  # the files at a path are parts of one, in order of their names; only the first has a header


class DeliveryBlocked(ValueError):
    """A delivery that can't be read as declared; code says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def numbered_lines(spark: SparkSession, path: str, charset: str = "UTF-8", in_parts: bool = False) -> DataFrame:
    """file, line (from 1, in its file; in_parts: in all files by name) and value. Lines are numbered from counts by split, one row each, so neither a file nor what is written in parts is one task."""
    rows = spark.read.option("encoding", charset).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    before = (Window.orderBy("file", "split") if in_parts else Window.partitionBy("file").orderBy("split")).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("file", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.join(F.broadcast(starts.drop("n")), ["file", "split"]).select("file", (F.col("start") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def without_bom(value: Column, line: Column) -> Column:
    return F.when(line == 1, F.regexp_replace(value, "^﻿", "")).otherwise(value)


def header_places(header: list[str], s: Structure) -> dict[str, int]:
    """Place (from 0) of each declared field; names are trimmed and folded."""
    names = [h.strip().lower() for h in header]
    if s.column_count is not None and len(names) != s.column_count:
        raise DeliveryBlocked("HEADER_COLUMN_COUNT_MISMATCH", f"{len(names)} instead of {s.column_count}")
    places = {}
    for f in s.fields:
        if s.by_index:
            if not 1 <= int(f) <= len(names):
                raise DeliveryBlocked("CONFIG_COLUMN_INDEX_OUT_OF_RANGE", f)
            places[f] = int(f) - 1
            continue
        found = [i for i, n in enumerate(names) if n == f.strip().lower()]
        if len(found) != 1:
            raise DeliveryBlocked("HEADER_FIELD_MISSING" if not found else "HEADER_DUPLICATE_FIELD", f)
        places[f] = found[0]
    return places


def header_drift(header: list[str], expected: list[str], guarded: set[str]) -> list[tuple[str, str]]:
    """(code, field) of drift against the expected header: a field at another place warns, a guarded field that is nowhere blocks. Unknown columns behind the last known one warn only where nothing is shifted: there the source was extended."""
    fold = [h.strip().lower() for h in header]
    out, last, shifted = [], -1, False
    for i, name in enumerate(expected):
        if (key := name.strip().lower()) not in fold:
            if name in guarded:
                return [*out, ("HEADER_FIELD_SEMANTIC_CHANGE", name)]
            continue
        last = max(last, fold.index(key))
        if fold.index(key) != i:
            shifted = True
            out.append(("HEADER_FIELD_SHIFTED", name))
    known = {e.strip().lower() for e in expected}
    return out + ([] if shifted else [("HEADER_UNKNOWN_COLUMN", h) for h in header[last + 1 :] if h.strip().lower() not in known])


def records(lines: DataFrame, s: Structure, places: dict[str, int], width: int) -> DataFrame:
    """file, line, error_code and the declared fields of each data line. Empty lines are none; blank ones are."""
    rows = lines.where(F.col("line") > s.header_line).withColumn("value", without_bom(F.col("value"), F.col("line"))).where(F.length("value") > 0)
    rows = rows.withColumn("parts", F.when(F.length("value") <= s.max_line_length, split_record(F.col("value"), s.delimiter, s.quote)))
    error = F.when(F.length("value") > s.max_line_length, "ROW_TOO_LONG").when(F.col("parts").isNull(), "CSV_UNCLOSED_QUOTE").when(F.size("parts") != width, "ROW_COLUMN_COUNT_MISMATCH")
    fields = [F.when(F.col("error_code").isNull(), F.try_element_at("parts", F.lit(p + 1))).alias(f) for f, p in places.items()]
    return rows.withColumn("error_code", error).select("file", "line", "error_code", *fields)


def read_delivery(spark: SparkSession, path: str, s: Structure, expected_records: int | None = None, expected_bytes: int | None = None, expected_header: tuple[str, ...] | None = None, guarded: tuple[str, ...] = (), warnings: list | None = None) -> DataFrame:
    """The records of one delivery file, and in warnings (code, field) what is odd about its beginning; blocks on what makes the file unreadable, on a manifest that tells other numbers, and on a header that no longer has a guarded field."""
    if expected_bytes is not None and (n := byte_size(spark, path)) != expected_bytes:
        raise DeliveryBlocked("BYTE_SIZE_MISMATCH", f"{n} instead of {expected_bytes}")
    lines = numbered_lines(spark, path, s.charset, s.in_parts)
    warnings = [] if warnings is None else warnings
    first = lines.where(F.col("line") == max(1, s.header_line)).select(without_bom(F.col("value"), F.col("line")).alias("value")).head()
    if first is None:
        raise DeliveryBlocked("SOURCE_FILE_EMPTY" if not lines.head(1) else "HEADER_LINE_MISSING")
    if s.header_line <= 1 and has_bom(spark, path):
        warnings.append(("SOURCE_BOM_REMOVED", None))
    header = spark.range(1).select(split_record(F.lit(first["value"]), s.delimiter, s.quote).alias("h")).head()["h"]
    if header is None:
        raise DeliveryBlocked("CSV_UNCLOSED_QUOTE", "header")
    for code, field in header_drift(header, list(expected_header), set(guarded)) if expected_header else ():
        if code == "HEADER_FIELD_SEMANTIC_CHANGE":
            raise DeliveryBlocked(code, field)
        warnings.append((code, field))
    rows = records(lines, s, header_places(header, s), len(header))
    if expected_records is not None and (n := rows.count()) != expected_records:
        raise DeliveryBlocked("RECORD_COUNT_MISMATCH", f"{n} instead of {expected_records}")
    if not rows.head(1):
        raise DeliveryBlocked("SOURCE_NO_DATA_RECORDS")
    return rows


def has_bom(spark: SparkSession, path: str) -> bool:
    """Whether the first file at a path begins with the mark of UTF-8. Its first three bytes tell; Spark's reader takes the mark away."""
    for name, size, _ in files_at(spark, path):
        if size >= 3:
            at = spark._jvm.org.apache.hadoop.fs.Path(name)
            content = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
            try:
                return [content.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]
            finally:
                content.close()
    return False


def byte_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below path, from the listing alone."""
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def archive(spark: SparkSession, path: str) -> DataFrame:
    """file, byte_size and sha256 of delivered files, each read in ranges by one task (``sources.archive`` keeps them)."""
    files = listed(spark, path)
    return files.join(digests(files), "file").select("file", "byte_size", "sha256", "modified_at")


def intake(arrivals: DataFrame, known: DataFrame) -> DataFrame:
    """NEW, EXISTING (same key and hash) or CONFLICT (same key, other hash) for each arrival of idempotency_key and sha256."""
    k = known.select("idempotency_key", F.col("sha256").alias("known_sha256"))
    verdict = F.when(F.col("known_sha256").isNull(), "NEW").when(F.col("known_sha256") == F.col("sha256"), "EXISTING").otherwise("CONFLICT")
    return arrivals.join(k, "idempotency_key", "left").withColumn("outcome", verdict).drop("known_sha256")


def csv_text(c: Column, separator: str) -> Column:
    """A value as a field of a file: empty where it is null, guarded where a spreadsheet would see a formula, quoted where it holds the separator, a quote or a line's end."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    c = F.when(c.rlike("^[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.when(c.rlike(f'["{separator}\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def export_lines(rows: DataFrame, fields: list[tuple[str, Column]], order: Column) -> DataFrame:
    """line and ordinal: quoted fields, guarded where a spreadsheet would see a formula."""
    line = F.concat_ws(";", *(csv_text(c, ";") for _, c in fields))
    return rows.select(order.alias("ordinal"), line.alias("line"))


def write_parts(lines: DataFrame, order: str, path: str) -> None:
    """The values of lines as ordered text parts below path, which ``Structure(in_parts=True)`` reads as one delivery: no task writes it all."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select("value").write.text(path)


def write_export(lines: DataFrame, path: str, header: str) -> None:
    """Ordered text parts below path; the header stands in its own first part."""
    spark = lines.sparkSession
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
    lines.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select(F.col("line").alias("value")).write.mode("overwrite").text(f"{path}/part=1")
