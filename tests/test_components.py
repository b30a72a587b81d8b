"""Price components from the file on: shares, refusals, masks, fingerprints, observations and the next version."""

import dataclasses
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veldmark.functions import components as parts_of
from veldmark.functions.components import PriceComponent
from veldmark.functions.transforms import FieldMapping
from veldmark.operators import delta, prices, screening, state
from veldmark.sources.delimited import Structure
from veldmark.streaming.library import Library

STATE = "identity_hash string, article_fingerprint string, price_fingerprint string, combined_fingerprint string, base_price decimal(24,0), currency string"
OBSERVED = "identity_hash string, component_code string, observation_date date, amount decimal(24,0)"
HEADER = "SUP;GRP;REF;PRICE;NAME;AKP;VKP1;CUR"
PROFILE = screening.Profile(
    Structure(tuple(HEADER.split(";"))),
    tuple(FieldMapping(t, s, type=k) for t, s, k in (("supplier", "SUP", "TEXT"), ("grp", "GRP", "TEXT"), ("reference", "REF", "TEXT"), ("base_price", "PRICE", "DECIMAL"), ("description", "NAME", "TEXT"), ("cost", "AKP", "DECIMAL"), ("sale", "VKP1", "DECIMAL"), ("sale_currency", "CUR", "TEXT"))),
    components=(PriceComponent("VKP1", "sale", currency="sale_currency", most_percent=Decimal("150.5")), PriceComponent("AKP", "cost")), version=2, creation_percent=100, critical_percent=None, allow_zero=True,
)
ROWS = ["ACME;G1;R1;100,00;Drill;80,00;120,00;", "ACME;G1;R2;200,00;Driver;160,00;240,00;EUR", "ACME;G1;R3;50,00;Hammer;40,00;60,00;"]


def put(tmp_path, name, lines):
    (tmp_path / name).write_text("\n".join([HEADER, *lines]) + "\n")
    return str(tmp_path / name)


def run(spark, tmp_path, name, lines, known=None, profile=PROFILE):
    known = spark.createDataFrame([], STATE) if known is None else known
    return screening.screen(spark, put(tmp_path, name, lines), profile, known, spark.createDataFrame([], OBSERVED), f"file://{tmp_path}/{name}.out")


def test_shares_and_refusals(spark, tmp_path):
    lines = [
        *ROWS, "ACME;G1;bad;200;n;12,3x;240;", "ACME;G1;zero;0;n;;;", "ACME;G1;nobase;0;n;40;;", "ACME;G1;nothing;10;n; ;;", "ACME;G1;free;10;n;0;;", "ACME;G1;less;10;n;-1;;", "ACME;G1;dollar;10;n;1;2;USD",
        "ACME;G1;dear;10;n;1;15,06;", "ACME;G1;just;10;n;1;15,05;", "ACME;G1;fine;10;n;1,1234567;;", "ACME;G1;huge;99999999999999999,99;n;33333333333333333,33;;", "ACME;G1;far;0,01;n;500000;;", "ACME;G1;third;3;n;1;2;",
    ]
    routed = screening.routed(screening.read_delivery(spark, put(tmp_path, "a.csv", lines), PROFILE.structure), PROFILE)
    rows = routed.withColumn("c", F.transform("components", lambda c: F.concat_ws(" ", c["component_code"], parts_of.share_text(c["share"]), c["currency"]))).collect()
    told = {r.reference: (r.route, r.code, r.field) for r in rows}
    wrong = {k: v[1:] for k, v in told.items() if v[0] != "VALID"}
    assert wrong == {
        "bad": ("PRICE_UNREADABLE", "cost"), "nobase": ("PRICE_PERCENTAGE_NOT_COMPUTABLE", "base_price"), "free": ("PRICE_ZERO_NOT_ALLOWED", "cost"), "less": ("PRICE_NEGATIVE_NOT_ALLOWED", "cost"),
        "dollar": ("PRICE_CURRENCY_MISMATCH", "sale"), "dear": ("PRICE_PERCENTAGE_OUT_OF_RANGE", "sale"), "fine": ("PRICE_SCALE_EXCEEDED", "cost"), "huge": ("PRICE_DERIVATION_MISMATCH", "cost"),
    }
    got = {r.reference: r.c for r in rows if r.route == "VALID"}
    assert got["R1"] == got["R3"] == ["AKP 80.000000000000 EUR", "VKP1 120.000000000000 EUR"] and got["nothing"] == got["zero"] == []
    assert got["third"] == ["AKP 33.333333333333 EUR", "VKP1 66.666666666667 EUR"] and got["far"] == ["AKP 5000000000.000000000000 EUR"] and got["just"][1] == "VKP1 150.500000000000 EUR"


def test_masks_prices_and_acceptance(spark, tmp_path):
    more = ["ACME;G1;R4;100,00;Saw;80,00;;", "ACME;G1;R5;100,00;Axe;80,00;120,00;", "ACME;G1;R6;100,00;Awl;80,00;120,00;"]
    first = run(spark, tmp_path, "a.csv", ROWS + more)
    none, columns = spark.createDataFrame([], OBSERVED), [*delta.STATE_COLUMNS, "components"]
    empty = spark.createDataFrame([], f"{STATE}, components {parts_of.TYPE}")
    after = state.accept_baseline(first.staged, empty, columns, none, "2024-01-01")
    known = spark.createDataFrame(after["state"].collect(), after["state"].schema)
    seen = {r.component_code: r.n for r in after["observations"].groupBy("component_code").agg(F.count("*").alias("n")).collect()}
    assert seen == {"BASE": 6, "AKP": 6, "VKP1": 5}
    # a share; base and amounts alike; all; a component that comes; one that goes; nothing
    lines = ["ACME;G1;R1;100,00;Drill;85,00;120,00;", "ACME;G1;R2;400,00;Driver;320,00;480,00;", "ACME;G1;R3;100,00;Mallet;75,00;120,00;", "ACME;G1;R4;100,00;Saw;80,00;120,00;", "ACME;G1;R5;100,00;Axe;;120,00;", more[2]]
    second = run(spark, tmp_path, "b.csv", lines, known)
    rows = {r.reference: (r.classification, r["mask"]) for r in second.staged.collect()}
    assert rows == {"R1": ("CHANGED", "PRICE:AKP"), "R2": ("CHANGED", "PRICE"), "R3": ("CHANGED", "ARTICLE,PRICE,PRICE:AKP"), "R4": ("CHANGED", "PRICE:VKP1"), "R5": ("CHANGED", "PRICE:AKP"), "R6": ("UNCHANGED", None)}
    assert second.mutations.count() == 5
    # 160 to 320 and 240 to 480, 40 to 75 and 60 to 120, both base prices; 80 to 85 is within 15 percent, and what has no reference exceeds nothing
    far = {(r.field, r.signature): r.n for r in second.issues.where("code = 'PRICE_DEVIATION_EXCEEDED'").groupBy("field", "signature").agg(F.count("*").alias("n")).collect()}
    assert far == {(f, f"FIELD={f}|KIND=UP"): 2 for f in ("base_price", "cost", "sale")}


def test_version_1_and_old_states(spark, tmp_path):
    """Fingerprints of version 1 don't see components, and a state without the column has none."""
    one = dataclasses.replace(PROFILE, version=1)
    first = run(spark, tmp_path, "a.csv", ROWS[:1], profile=one)
    known = first.staged.select("identity_hash", *delta.STATE_COLUMNS)
    assert [r.classification for r in run(spark, tmp_path, "b.csv", ["ACME;G1;R1;100,00;Drill;85,00;;"], known, one).staged.collect()] == ["UNCHANGED"]
    bare = dataclasses.replace(one, components=())
    other = run(spark, tmp_path, "c.csv", ROWS[:1], profile=bare).staged.head()
    assert other.price_fingerprint == first.staged.head().price_fingerprint
    for codes in (("AKP", "AKP"), ("BASE",)):
        with pytest.raises(ValueError, match="CONFIG_PRICE_COMPONENT_DUPLICATE"):
            dataclasses.replace(PROFILE, components=tuple(PriceComponent(c, "cost") for c in codes))


def test_library_keeps_components(spark, tmp_path):
    library = Library(spark, f"file://{tmp_path}/lib", PROFILE)
    library.advance(put(tmp_path, "a.csv", ROWS), "2024-01-01")
    library.advance(put(tmp_path, "b.csv", ["ACME;G1;R1;100,00;Drill;85,00;120,00;", *ROWS[1:]]), "2024-01-02")
    latest = {(r.component_code, len(r["values"])): r.n for r in library.read("latest").groupBy("component_code", "values").count().groupBy("component_code", "values").agg(F.sum("count").alias("n")).collect()}
    assert latest[("AKP", 2)] == latest[("VKP1", 2)] == 1
    shares = library.read("state").select(F.array_join(F.transform("components", lambda c: parts_of.share_text(c["share"])), " ").alias("s"))
    assert sorted(r.s for r in shares.collect()) == ["80.000000000000 120.000000000000"] * 2 + ["85.000000000000 120.000000000000"]
    assert [r["mask"] for r in library.read("mutations").where("action = 'UPDATE'").collect()] == ["PRICE:AKP"]


def test_derivation_of_any_size(spark):
    """Against whole numbers of any size."""

    def near(x, unit):
        return (abs(x) * 2 + unit) // (2 * unit) * (-1 if x < 0 else 1)

    cases = [(b, a) for b in (1, 7, 10**6, 123456789, 10**18 + 7, 10**24 - 1) for a in (1, 10**4, 333_333, 10**12 + 1, 10**23 + 12345, -5_000_000) if abs(a) * 10**14 // b < 10**37]
    rows = spark.createDataFrame([(Decimal(b), Decimal(a), Decimal(near(a * 10**14, b))) for b, a in cases], "b decimal(24,0), a decimal(24,0), s decimal(38,0)")
    got = rows.select(prices.derivation_holds(F.col("a"), F.col("b"), F.col("s")).alias("h"), (prices.component_share(F.col("a"), F.col("b")) == F.col("s")).alias("same")).collect()
    want = [abs(near(b * near(a * 10**14, b), 10**18) - near(a, 10**4)) * 10**4 <= 10**4 for b, a in cases]
    assert [r.h for r in got] == want and all(r.same for r in got) and len(set(want)) == 2
