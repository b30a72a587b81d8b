"""Preview rows and their file, identities of four parts, defaults, days and times, and errors that belong to no field."""

import dataclasses
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veldmark.functions import components as parts_of
from veldmark.functions import fingerprint as fp
from veldmark.functions.transforms import FieldMapping, field_of
from veldmark.operators import previews, screening
from veldmark.plans.validation import profile_problems
from veldmark.sources.delimited import Structure

STATE = "identity_hash string, article_fingerprint string, price_fingerprint string, combined_fingerprint string, base_price decimal(24,0), currency string"
OBSERVED = "identity_hash string, component_code string, observation_date date, amount decimal(24,0)"
ROW = f"batch_id int, mutation_id long, action string, supplier string, grp string, reference string, discount string, discount_state string, base_price decimal(24,0), currency string, reference_type string, reference_value string, snapshotted boolean, description string, description_state string, components {parts_of.TYPE}"
GOOD = (1, 5, "UPDATE", "s", "g", "r", "d", "VALUE", Decimal(1_500_000), "EUR", None, None, True, "text", "VALUE", [("VKP2", Decimal(1), Decimal(12 * 10**12), "EUR"), ("VKP4", Decimal(1), None, "EUR")])


def changed(**to):
    names = [c.split()[0] for c in ROW.split(", ")[:15]] + ["components"]
    return tuple(to.get(n, v) for n, v in zip(names, GOOD, strict=True))


def told(spark, *rows):
    return [({f.code: (f.value, f.state) for f in r.fields}, r.complete) for r in previews.preview(spark.createDataFrame(list(rows), ROW)).orderBy("mutation_id").collect()]


def test_states_of_fields(spark):
    # a component without a share is unknown, one that isn't there is not mapped; nothing is made up
    cases = [
        GOOD, changed(mutation_id=6, components=[]), changed(mutation_id=7, discount=None, discount_state="NOT_USED"), changed(mutation_id=8, discount=None, discount_state="EMPTY"), changed(mutation_id=9, discount=None), changed(mutation_id=10, discount_state="ODD"),
        changed(mutation_id=11, base_price=None, currency=None, supplier=None), changed(mutation_id=12, snapshotted=False, components=[]), changed(mutation_id=13, snapshotted=None), changed(mutation_id=14, description=None, description_state="NOT_MAPPED"), changed(mutation_id=15, description=None),
        changed(mutation_id=16, reference_type="EAN", reference_value="1"), changed(mutation_id=17, reference_type="PIM_ID"), changed(mutation_id=18, reference_type="MPN", reference_value="1"), changed(mutation_id=19, description_state="EMPTY", components=None), changed(mutation_id=20, description_state=None, discount_state=None),
    ]
    got = told(spark, *cases)
    first, complete = got[0]
    assert first["VKP2_PCT"] == ("12.000000000000", "VALUE") and first["VKP4_PCT"] == (None, "UNKNOWN") and first["VKP1_PCT"] == (None, "NOT_MAPPED") and not complete
    assert first["BASE_PRICE"] == ("1.500000", "VALUE") and first["NUMBER"] == (None, "NOT_CONTRACTED") and first["EAN"] == (None, "NOT_AVAILABLE_IN_MUTATION")
    assert got[1][1] and [f for f in got[1][0]] == ["SUPPLIER", "SUPPLIER_GROUP", "SUPPLIER_REFERENCE", "DISCOUNT_CODE", "BASE_PRICE", "BASE_PRICE_CURRENCY", "EAN", "PIM_ID", "DESCRIPTION", *(f"VKP{n}_PCT" for n in range(1, 6)), "PROCESS", "DELETE", "RECORD", "NUMBER"]
    assert [g[0]["DISCOUNT_CODE"] for g in got[2:6]] == [(None, "NOT_MAPPED"), ("", "VALUE"), (None, "UNKNOWN"), (None, "UNKNOWN")]
    assert [got[6][0][c] for c in ("BASE_PRICE", "BASE_PRICE_CURRENCY", "SUPPLIER")] == [(None, "UNKNOWN")] * 3
    assert {got[i][0][c] for i in (7, 8) for c in ("DESCRIPTION", "VKP1_PCT", "VKP2_PCT")} == {(None, "NOT_SNAPSHOTTED")} and not got[7][1]
    assert [got[i][0]["DESCRIPTION"] for i in (9, 10, 14, 15)] == [(None, "NOT_MAPPED"), (None, "UNKNOWN"), ("", "VALUE"), (None, "UNKNOWN")]
    assert got[11][0]["EAN"] == ("1", "VALUE") and got[12][0]["PIM_ID"] == (None, "UNKNOWN") and got[13][0]["REFERENCE"] == (None, "UNKNOWN") and "REFERENCE" not in got[12][0]
    assert got[14][1] and got[14][0]["VKP2_PCT"] == (None, "NOT_MAPPED") and got[15][0]["DISCOUNT_CODE"] == (None, "UNKNOWN")


def test_file_and_banners(spark, tmp_path):
    rows = previews.preview(spark.createDataFrame([changed(mutation_id=2, supplier='a,"b"', grp="=1", reference="two\nlines", components=[]), changed(mutation_id=1, components=[], description="-")], ROW))
    assert previews.banner("X", "1", None) == "# PREVIEW previewOnly=true contractStatus=X previewSpecVersion=1 bundleContentHash=(null)"
    first = previews.banner("X", "1", "h", ("3", None))
    assert first.endswith("bundleContentHash=h simulationOnly=true writesToProdis=false snapshotSpecVersion=3 snapshotHash=(null)")
    made = previews.write_preview(rows, f"{tmp_path}/out", first)
    assert (made["rows"], made["incomplete"]) == (4, 0)
    text = "".join((tmp_path / "out" / p["name"]).read_text() for p in made["pages"])
    head, body = text.split("\n", 2)[:2], text.split("\n", 2)[2]
    assert head[0] == first and head[1].startswith("batchId,mutationId,actionType,complete,SUPPLIER,SUPPLIER.state,")
    assert body.startswith("1,1,UPDATE,true,s,VALUE,g,VALUE,r,VALUE,d,VALUE,1.500000,VALUE,EUR,VALUE,,NOT_AVAILABLE_IN_MUTATION,,NOT_AVAILABLE_IN_MUTATION,'-,VALUE,,NOT_MAPPED,")
    assert '\n1,2,UPDATE,true,"a,""b""",VALUE,\'=1,VALUE,"two\nlines",VALUE,' in body
    none = previews.preview_lines(rows.limit(0), "b").orderBy("ordinal").collect()
    assert [r.line for r in none] == ["b", "batchId,mutationId,actionType,complete"]


FIELDS = (FieldMapping("supplier", "S"), FieldMapping("grp", "G"), FieldMapping("reference", "R"), FieldMapping("discount", "D"), FieldMapping("description", "N"), FieldMapping("base_price", "P", type="DECIMAL"), FieldMapping("since", "T", type="DATE"), FieldMapping("origin", default=" BE "))
PROFILE = screening.Profile(Structure(("S", "G", "R", "D", "N", "P", "T")), FIELDS, discount=True, creation_percent=100, critical_percent=None, critical_fields=("since",))


def run(spark, tmp_path, lines, profile=PROFILE):
    (tmp_path / "a.csv").write_text("\n".join(["S;G;R;D;N;P;T", *lines]) + "\n")
    return screening.screen(spark, f"{tmp_path}/a.csv", profile, spark.createDataFrame([], STATE), spark.createDataFrame([], OBSERVED), f"file://{tmp_path}/{profile.discount}")


def test_discount_codes_tell_offers_apart(spark, tmp_path):
    long = "x" * 201
    lines = [" s ;g;1; a ;n;1;2024-01-01", "s;g;1;;n;1;", "s;g;1; ;n;2;2024-01-01", "s;g;2;b;n;1;01/02/2024", "s;g;3;b;n;1;2024-02-30", f"s;g;{long};b;n;1;", f"s;g;4;{long};n;1;", " ;g;5;b;n;1;", f"s;g;6;;{'y' * 1001};1;", "s;g;7", "s;g;8;b;n;x;"]
    out = run(spark, tmp_path, lines)
    rows = {r.row_number: r for r in out.staged.collect()}
    assert {k: (r.supplier, r.discount, r.discount_state) for k, r in rows.items()} == {2: ("s", "a", "VALUE"), 3: ("s", "", "EMPTY"), 4: ("s", "", "EMPTY")}
    want = spark.range(1).select(fp.identity(1, F.lit("s"), F.lit("g"), F.lit("1"), F.lit("a")).alias("h")).head().h
    assert rows[2].identity_hash == want and rows[3].identity_hash == rows[4].identity_hash != want
    found = {(r.row_number, r.code, r.field, r.severity) for r in out.issues.collect()}
    assert found == {
        *((k, "VALUE_DEFAULT_APPLIED", "origin", "INFO") for k in rows), *((k, "DUPLICATE_IDENTITY_IN_DELIVERY", "reference", "BLOCKING") for k in (3, 4)), (5, "DATE_AMBIGUOUS", "since", "ERROR"), (6, "DATE_UNREADABLE", "since", "ERROR"),
        (7, "VALUE_TOO_LONG", "reference", "ERROR"), (8, "VALUE_TOO_LONG", "discount", "ERROR"), (9, "IDENTITY_COMPONENT_EMPTY", "supplier", "ERROR"), (10, "VALUE_TOO_LONG", "description", "ERROR"), (11, "ROW_COLUMN_COUNT_MISMATCH", None, "ERROR"), (12, "PRICE_UNREADABLE", "base_price", "ERROR"),
    }
    assert {r.origin for r in rows.values()} == {"BE"}
    assert out.judgement.head().critical_lines == 3  # two days, and the line that nobody can tell a field of
    plain = run(spark, tmp_path, lines[:1], dataclasses.replace(PROFILE, discount=False)).staged.head()
    assert plain.identity_hash != want and "discount_state" not in plain.asDict()


def test_discount_wants_a_field():
    with pytest.raises(ValueError, match="CONFIG_DISCOUNT_FIELD_MISSING"):
        dataclasses.replace(PROFILE, mappings=FIELDS[:3])
    whole = dataclasses.replace(PROFILE, version=2, article_fields=("since", "origin"), critical_fields=("base_price",))
    assert not any(profile_problems(whole).values())


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_days_and_times(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        cases = [
            (dict(type="DATETIME"), "2024-01-01T00:30+01:00", "2023-12-31T23:30:00Z", None), (dict(type="DATETIME"), "2024-03-10T02:30:10.1Z", "2024-03-10T02:30:10.100Z", None), (dict(type="DATETIME"), "2024-01-01T00:30:10.0000012-05:30", "2024-01-01T06:00:10.000001200Z", None),
            (dict(type="DATETIME"), "2024-01-01T00:30", None, "DATE_UNREADABLE"), (dict(type="DATETIME"), "01/02/2024 10:00", None, "DATE_AMBIGUOUS"), (dict(type="DATETIME"), "2024-01-01T00:00+18:30", None, "DATE_UNREADABLE"), (dict(type="DATETIME"), "", None, None), (dict(type="DATETIME"), None, None, None),
            (dict(type="DATETIME", pattern="dd/MM/yyyy HH:mm", zone="Europe/Brussels"), "01/07/2024 10:00", "2024-07-01T08:00:00Z", None), (dict(type="DATETIME", pattern="dd/MM/yyyy HH:mm"), "31/02/2024 10:00", None, "DATE_UNREADABLE"), (dict(type="DATE", pattern="dd/MM/yyyy"), "31/02/2024", None, "DATE_UNREADABLE"),
            (dict(type="DATE", pattern="dd/MM/yyyy"), " 01/02/2024 ", "2024-02-01", None), (dict(type="DATE"), "2024-1-1", None, "DATE_AMBIGUOUS"),
        ]
        for how, given, value, error in cases:
            v, e = field_of(FieldMapping("t", "x", **how))
            assert tuple(spark.createDataFrame([(given,)], "x string").select(v, e).head()) == (value, error), (how, given)
        assert spark.createDataFrame([("01/02/2024 10:00",)], "x string").select(field_of(FieldMapping("t", "x", type="DATETIME", pattern="dd/MM/yyyy HH:mm"))[1].alias("e")).head().e == "DATE_AMBIGUOUS"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
