"""A screening run: routes, references, guards, and going on after a crash."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from veldmark.functions import fingerprint as fp
from veldmark.functions.filters import RecordFilter
from veldmark.functions.issues import CATALOGUE
from veldmark.functions.transforms import FieldMapping, field_of, transformed
from veldmark.operators import delta, screening, state
from veldmark.sources.delimited import Structure

STATE = "identity_hash string, article_fingerprint string, price_fingerprint string, combined_fingerprint string, base_price decimal(24,0), currency string"
OBSERVED = "identity_hash string, component_code string, observation_date date, amount decimal(24,0)"
PROFILE = screening.Profile(
    Structure(("S", "G", "R", "N", "P", "E", "K")),
    (FieldMapping("supplier", "S"), FieldMapping("grp", "G", "MAP", "values=a>A|b>B"), FieldMapping("reference", "R"), FieldMapping("description", "N", longest=10), FieldMapping("base_price", "P", type="DECIMAL"), FieldMapping("EAN", "E")),
    (RecordFilter("EXCLUDE", "K", "EQUALS", "x"), RecordFilter("REJECT", "K", "EQUALS", "r")), reference_types=("EAN",), creation_percent=100, rejected_percent=90, critical_percent=None, deviation_percent=20, bulk_percent=5,
)


def put(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(["S;G;R;N;P;E;K", *lines]) + "\n")
    return str(path)


def run(spark, tmp_path, name, lines, known=None, refs=None, profile=PROFILE):
    known = spark.createDataFrame([], STATE) if known is None else known
    refs = spark.createDataFrame([], "identity_hash string, reference_type string, value string") if refs is None else refs
    return screening.screen(spark, put(tmp_path, name, lines), profile, known, spark.createDataFrame([], OBSERVED), f"file://{tmp_path}/{name}.out", refs)


def test_routes_and_counters(spark, tmp_path):
    out = run(spark, tmp_path, "a.csv", ["s;a;1;n;1,5;;", "s;b;2;n;2;;x", "s;a;3;n;3;;r", "s;c;4;n;4;;", "s;a;5;too long for it;5;;", 's;a;6;"open;6;;', "s;a;7;n;0;;", "s;a;8;n;-1;;", ";a;9;n;9;;", "s;a;10;n;1.1234567;;"])
    assert out.counters.head().asDict() == {"raw": 10, "filtered": 1, "error_before_filter": 1, "rejected": 7, "valid": 1}
    codes = {r.code: r.n for r in out.issues.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert codes == {"FILTER_RECORD_REJECTED": 1, "MAPPING_VALUE_UNKNOWN": 1, "VALUE_TOO_LONG": 1, "CSV_UNCLOSED_QUOTE": 1, "PRICE_ZERO_NOT_ALLOWED": 1, "PRICE_NEGATIVE_NOT_ALLOWED": 1, "IDENTITY_COMPONENT_EMPTY": 1, "PRICE_SCALE_EXCEEDED": 1}
    assert out.issues.where("not catalogued").count() == 0
    assert [(r.action, r.status, r.reason) for r in out.mutations.collect()] == [("CREATE", "AWAITING_APPROVAL", "INITIAL_LOAD")]
    assert out.judgement.head().verdict == "REVIEW_REQUIRED"


def test_references_hold_and_duplicates_block(spark, tmp_path):
    first = run(spark, tmp_path, "a.csv", ["s;a;1;n;1;e1;", "s;a;2;n;2;e2;"])
    known = first.staged.select("identity_hash", "article_fingerprint", "price_fingerprint", "combined_fingerprint", "base_price", "currency")
    refs = first.staged.select("identity_hash", F.lit("EAN").alias("reference_type"), F.col("EAN").alias("value"))
    second = run(spark, tmp_path, "b.csv", ["s;a;1;n;1,1;e2;", "s;a;2;n;2;e2;", "s;a;3;n;3;e1;"], known, refs)
    got = {(r.action, r.status) for r in second.mutations.collect()}
    assert ("UPDATE", "BLOCKED") in got and ("IDENTITY_REFERENCE_INCIDENT", "AWAITING_APPROVAL") in got
    assert {r.code for r in second.issues.collect()} >= {"IDENTITY_REFERENCE_INCIDENT", "DUPLICATE_REFERENCE_IN_DELIVERY", "REFERENCE_LINK_PROPOSED"}
    third = run(spark, tmp_path, "c.csv", ["s;a;1;n;1;e1;", "s;a;1;n;2;e1;"], known, refs)
    assert third.judgement.head().verdict == "BLOCKING" and third.mutations.count() == 0


def test_accepted_delivery_screens_as_unchanged_and_guards_refuse(spark, tmp_path):
    lines = [f"s;a;{i};n;{i},5;;" for i in range(1, 30)]
    out = run(spark, tmp_path, "a.csv", lines)
    none = spark.createDataFrame([], OBSERVED)
    empty = spark.createDataFrame([], STATE)
    refs = spark.createDataFrame([("other", "EAN", "e9")], "identity_hash string, reference_type string, value string")
    new_refs = out.staged.select("identity_hash", F.lit("EAN").alias("reference_type"), F.when(F.col("reference") == "3", "e9").when(F.col("reference") == "4", "e4").alias("value"))
    prices = spark.createDataFrame([("gone", "AKP", 1)], "identity_hash string, component_code string, percentage long")
    own = out.staged.select("identity_hash", F.lit("AKP").alias("component_code"), F.lit(7).cast("long").alias("percentage"))
    after = state.accept_baseline(out.staged, empty, delta.STATE_COLUMNS, none, "2024-01-01", component_prices=prices, staged_prices=own, references=refs, staged_references=new_refs)
    known = spark.createDataFrame(after["state"].collect(), after["state"].schema)
    assert known.count() == 29 and after["observations"].count() == 29 and after["component_prices"].count() == 30
    assert sorted(r.value for r in after["references"].collect()) == ["e4", "e9"]
    again = run(spark, tmp_path, "b.csv", lines, known)
    assert again.mutations.count() == 0 and {r.classification for r in again.staged.collect()} == {"UNCHANGED"}
    with pytest.raises(state.AcceptanceRefused, match="SOURCE_STATE_CHANGED"):
        state.accept_baseline(out.staged, known, delta.STATE_COLUMNS, none, "2024-01-02")
    with pytest.raises(state.AcceptanceRefused, match="BUNDLE_STILL_LIVE"):
        state.accept_baseline(out.staged, empty, delta.STATE_COLUMNS, none, "2024-01-02", live_bundle=out.mutations)


def test_a_crashed_pass_goes_on(spark, tmp_path, monkeypatch):
    lines = [f"s;a;{i};n;{i},5;;" for i in range(1, 9)]
    real = screening._judged
    monkeypatch.setattr(screening, "_judged", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        run(spark, tmp_path, "a.csv", lines)
    written = {p: p.stat().st_mtime_ns for p in (tmp_path / "a.csv.out").rglob("*.parquet")}
    assert written
    monkeypatch.setattr(screening, "_judged", real)
    out = run(spark, tmp_path, "a.csv", lines)
    assert out.mutations.count() == 8
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "a.csv.out").rglob("*.parquet")} == written


def test_settings_drive_transforms(spark):
    rows = spark.createDataFrame([("7", "b", None)], "x string, y string, z string")
    M = FieldMapping
    wanted = [
        (M("t", "x"), "7"), (M("t", kind="FIXED_VALUE", settings="value=v"), "v"), (M("t", "x", "PREFIX", "prefix=P-"), "P-7"), (M("t", "x", "SUFFIX", "suffix=/s"), "7/s"), (M("t", kind="CONCAT", settings="sources=x|z|y;separator=-"), "7--b"),
        (M("t", "x", "ADD", "operand=0.50"), "7.50"), (M("t", "x", "SUBTRACT", "operandField=x"), "0"), (M("t", "x", "MULTIPLY", "operand=1,5;scale=2"), "10.50"), (M("t", "x", "DIVIDE", "operand=3;scale=3"), "2.333"), (M("t", "x", "PERCENTAGE", "base=8;scale=1"), "87.5"),
        (M("t", "y", "MAP", "values=B>bee"), "bee"), (M("t", "z", default="d"), "d"), (M("t", "x", type="INTEGER"), "7"),
    ]
    for m, want in wanted:
        value, error = field_of(m)
        assert tuple(rows.select(value.alias("v"), error.alias("e")).head()) == (want, None), m
    errors = [(M("t", "y", "MAP", "values=B>bee;caseSensitive=true"), "MAPPING_VALUE_UNKNOWN"), (M("t", "x", "DIVIDE", "operand=0"), "TRANSFORM_DIVIDE_BY_ZERO"), (M("t", "z", required=True), "VALUE_MISSING"), (M("t", "y", type="INTEGER"), "VALUE_TYPE_MISMATCH"), (M("t", "y", type="DATE"), "DATE_AMBIGUOUS"), (M("t", "y", type="DATE", pattern="dd/MM/yyyy"), "DATE_UNREADABLE"), (M("t", "y", "SPLIT", "separator=/;index=2"), "TRANSFORM_FAILED")]
    for m, want in errors:
        assert rows.select(field_of(m)[1].alias("e")).head().e == want, m
    for bad in (M("t", "x", "TURN"), M("t", "x", "PREFIX"), M("t", "x", "ADD", "operand=1;operandField=y"), M("t", "x", "NONE", "what=1"), M("t", "x", "SPLIT", "separator=/;index=two")):
        with pytest.raises(ValueError, match="CONFIG_TRANSFORM_INVALID"):
            transformed(bad)


def test_catalogue_has_each_code_once():
    assert len(CATALOGUE) == len({c for c, *_ in CATALOGUE}) == 84


PLAIN = screening.Profile(PROFILE.structure, PROFILE.mappings, reference_types=("EAN",), creation_percent=100)


def test_identity_incidents_reach_the_critical_threshold(spark, tmp_path):
    lines = [f"s;a;{i};n;{i};e{i};" for i in range(1, 11)]
    first = run(spark, tmp_path, "a.csv", lines, profile=PLAIN)
    known = first.staged.select("identity_hash", "article_fingerprint", "price_fingerprint", "combined_fingerprint", "base_price", "currency")
    refs = first.staged.select("identity_hash", F.lit("EAN").alias("reference_type"), F.col("EAN").alias("value"))
    lost = run(spark, tmp_path, "b.csv", [f"s;a;{i};n;{i},1;;" for i in range(1, 11)], known, refs, PLAIN)
    judged = lost.judgement.head()
    assert (judged.critical_records, judged.critical_threshold, judged.verdict, lost.mutations.count()) == (10, "EXCEEDED", "BLOCKING", 0)
    assert {r.code for r in lost.notices.collect()} >= {"CRITICAL_RECORD_THRESHOLD_EXCEEDED", "BULK_IDENTITY_INCIDENT", "PRICE_REFERENCE_NOT_AVAILABLE"}
    assert {r.code for r in first.notices.collect()} == {"INITIAL_LOAD_REQUIRES_APPROVAL", "PRICE_REFERENCE_NOT_AVAILABLE"}
    assert lost.notices.where("not catalogued").count() == 0


def test_another_profile_or_state_has_its_own_stages(spark, tmp_path):
    lines = ["s;a;1;n;0;;", "s;a;2;n;2;;"]
    strict = run(spark, tmp_path, "a.csv", lines)
    assert strict.counters.head().valid == 1
    lax = run(spark, tmp_path, "a.csv", lines, profile=dataclasses.replace(PROFILE, allow_zero=True))
    assert lax.counters.head().valid == 2 and strict.counters.head().valid == 1


def test_version_2_tells_references_and_mapped_fields(spark, tmp_path):
    two = dataclasses.replace(PLAIN, version=2, article_fields=("K",), mappings=(*PLAIN.mappings, FieldMapping("K", "K")), critical_percent=None)
    first = run(spark, tmp_path, "a.csv", ["s;a;1;n;1;e1;x", "s;a;2;n;2;e2;x", "s;a;3;n;3;e3;x"], profile=two)
    known = first.staged.select("identity_hash", "article_fingerprint", "price_fingerprint", "combined_fingerprint", "base_price", "currency")
    again = run(spark, tmp_path, "b.csv", ["s;a;1;n;1;e9;x", "s;a;2;n;2;e2;y", "s;a;3;n;3;e3;x"], known, profile=two)
    assert {(r.reference, r.classification, r["mask"]) for r in again.staged.collect()} == {("1", "CHANGED", None), ("2", "CHANGED", "ARTICLE"), ("3", "UNCHANGED", None)}
    one = spark.range(1)
    pins = {None: "9bf26089077e52d71ce5bd4195eed1210c6f16486ff09b84617d0d614811b809", "5449000000996": "ad73e7363591799fc34fd31dd832d7225f1d2d3c3894feab1a8c706a403ecb83"}
    for value, want in pins.items():
        assert one.select(fp.references(2, {"EAN": F.lit(value).cast("string")}).alias("h")).head().h == want
    assert one.select(fp.references(2, {}).alias("h")).head().h == "d4735e3a265e16eee03f59718b9b5d03019c07d8b6c51f90da3a666eec13ab35"


def test_what_is_odd_about_the_file_is_told(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\ufeffG;S;R;N;P;E;K;NEW\na;s;1;n;1;;;q\n")
    profile = dataclasses.replace(PROFILE, expected_header=("S", "G", "R", "N", "P", "E", "K"), guarded=("P",))
    empty = spark.createDataFrame([], STATE)
    out = screening.screen(spark, f"{tmp_path}/x.csv", profile, empty, spark.createDataFrame([], OBSERVED), f"file://{tmp_path}/out", spark.createDataFrame([], "identity_hash string, reference_type string, value string"))
    assert {(r.code, r.field) for r in out.notices.where("scope = 'DELIVERY' and severity = 'WARNING'").collect()} == {("SOURCE_BOM_REMOVED", None), ("HEADER_FIELD_SHIFTED", "S"), ("HEADER_FIELD_SHIFTED", "G")}


def test_a_delivery_in_parts_is_one(spark, tmp_path):
    """Parts are numbered through in order of their names, and only the first has a header."""
    from veldmark.sources.delimited import Structure, read_delivery, write_parts

    rows = spark.range(-1, 1000).select(F.col("id").alias("n"), F.when(F.col("id") < 0, "A;B").otherwise(F.concat_ws(";", F.col("id").cast("string"), F.lit("x"))).alias("value"))
    write_parts(rows.repartition(7), "n", f"{tmp_path}/small")
    rows.repartitionByRange(3, "n").sortWithinPartitions("n").select("value").write.text(f"{tmp_path}/in")
    assert len(list((tmp_path / "in").glob("part-*.txt"))) == 3
    for name in ("small", "in"):
        got = read_delivery(spark, f"{tmp_path}/{name}", Structure(("A", "B"), in_parts=True)).select("line", "A").collect()
        assert sorted((r.line, r.A) for r in got) == [(i + 2, str(i)) for i in range(1000)]
