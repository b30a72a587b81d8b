"""Deliveries as files, from lines to an accepted state; streams of deliveries."""

import pytest
from pyspark.sql import functions as F

from veldmark.functions import fingerprint as fp, text
from veldmark.operators import delta, state
from veldmark.sources import delimited as d
from veldmark.streaming.deliveries import StateVersions, follow

HEADER = "supplier;grp;ref;name;price"
SHAPE = d.Structure(("supplier", "grp", "ref", "name", "price"))
COLUMNS = ["article_fingerprint", "price_fingerprint", "combined_fingerprint", "base_price", "currency"]


def write(tmp_path, name, lines, bom=""):
    p = tmp_path / name
    p.write_text(bom + "\n".join(lines) + "\n", encoding="utf-8")
    return str(p)


def staged(rows):
    rows = rows.where("error_code is null").select("line", "supplier", "grp", "ref", "name", text.micro_units(text.plain_decimal(F.col("price"))).alias("base_price"), F.lit("EUR").alias("currency"))
    rows = rows.withColumn("identity_hash", fp.identity(1, F.col("supplier"), F.col("grp"), F.col("ref"))).withColumn("article_fingerprint", fp.sha(fp.canonical(1, F.col("name")))).withColumn("price_fingerprint", fp.price(1, fp.amount_text(F.col("base_price")), F.lit(None).cast("string")))
    return rows.withColumn("combined_fingerprint", fp.combined(F.col("identity_hash"), F.col("article_fingerprint"), F.col("price_fingerprint"))).withColumnRenamed("line", "row_number")


def test_malformed_lines_reject_themselves_only(spark, tmp_path):
    path = write(tmp_path, "a.csv", [HEADER, "S;G;1;n;1,5", "", '"S;G;2;n;1', "S;G;3;n", " ", 'S;G;4;"a ""b""";2'], bom="﻿")
    rows = d.read_delivery(spark, path, SHAPE).orderBy("line").collect()
    assert [(r.line, r.error_code) for r in rows] == [(2, None), (4, "CSV_UNCLOSED_QUOTE"), (5, "ROW_COLUMN_COUNT_MISMATCH"), (6, "ROW_COLUMN_COUNT_MISMATCH"), (7, None)]
    assert rows[-1]["name"] == 'a "b"'


def test_what_blocks_a_delivery(spark, tmp_path):
    for lines, code in (([], "SOURCE_FILE_EMPTY"), (["supplier;grp;ref;name"], "HEADER_FIELD_MISSING"), ([HEADER + ";ref"], "HEADER_DUPLICATE_FIELD")):
        p = tmp_path / "x.csv"
        p.write_text("\n".join(lines))
        with pytest.raises(d.DeliveryBlocked) as e:
            d.read_delivery(spark, str(p), SHAPE)
        assert e.value.code == code
    with pytest.raises(d.DeliveryBlocked, match="RECORD_COUNT"):
        d.read_delivery(spark, write(tmp_path, "y.csv", [HEADER, "S;G;1;n;1"]), SHAPE, expected_records=2)


def test_header_drift():
    got = d.header_drift(["ref", "price", "extra"], ["price", "ref"], {"price"})
    assert got == [("HEADER_FIELD_SHIFTED", "price"), ("HEADER_FIELD_SHIFTED", "ref")]
    assert d.header_drift(["price", "ref", "extra"], ["price", "ref"], {"price"}) == [("HEADER_UNKNOWN_COLUMN", "extra")]
    assert d.header_drift(["code"], ["price"], {"price"}) == [("HEADER_FIELD_SEMANTIC_CHANGE", "price")]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    path = write(tmp_path, "big.csv", [f"line {i}" for i in range(1, 3001)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert d.numbered_lines(spark, path).where(F.concat(F.lit("line "), F.col("line")) != F.col("value")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_initial_load_then_same_then_price_change(spark, tmp_path):
    first = [HEADER, *(f"S;G;{i};n{i};{i},50" for i in range(1, 11))]
    known = spark.createDataFrame([], "identity_hash string, article_fingerprint string, price_fingerprint string, combined_fingerprint string, base_price decimal(24,0), currency string")
    counts = []
    for lines in (first, first, [*first[:3], first[3].replace("3,50", "4,50"), *first[4:]]):
        rows = delta.change_mask(delta.classified(delta.beside_state(staged(d.read_delivery(spark, write(tmp_path, f"{len(counts)}.csv", lines), SHAPE)), known)))
        counts.append({(r.classification, r["mask"]): r["count"] for r in rows.groupBy("classification", "mask").count().collect()})
        known = spark.createDataFrame(state.accept(known, rows, COLUMNS).collect(), known.schema)
    assert counts == [{("NEW", None): 10}, {("UNCHANGED", None): 10}, {("UNCHANGED", None): 9, ("CHANGED", "PRICE"): 1}]


def test_streamed_deliveries_replay(spark, tmp_path):
    versions = StateVersions(spark, f"file://{tmp_path}", "identity_hash string, value string, combined_fingerprint string")
    schema = "identity_hash string, seq long, value string, combined_fingerprint string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), versions, ["value", "combined_fingerprint"], f"{tmp_path}/checkpoint").awaitTermination()
    put([("a", 1, "x", "x"), ("b", 2, "y", "y"), ("a", 3, "z", "z")])
    run()
    put([("b", 4, "y", "y"), ("c", 5, "q", "q")])
    run()
    assert {(r.identity_hash, r.value) for r in versions.read(2).collect()} == {("a", "z"), ("b", "y"), ("c", "q")}
    staged_rows = spark.read.parquet(f"{tmp_path}/staged/batch=1").select("identity_hash", "classification").collect()
    assert {tuple(r) for r in staged_rows} == {("b", "UNCHANGED"), ("c", "NEW")}
