"""Configuration checks, values and publication helpers."""

from pyspark.sql import functions as F

from veldmark.functions import values
from veldmark.functions.filters import RecordFilter
from veldmark.functions.transforms import FieldMapping
from veldmark.operators import publication
from veldmark.operators.screening import Profile
from veldmark.plans import validation as v
from veldmark.plans.runs import PROFILE
from veldmark.sources.delimited import Structure


def test_all_problems_at_once():
    bad = Structure(("a", "A"), delimiter=";;", quote="''", charset="nope", header_line=-1, column_count=0)
    assert v.structure_problems(bad) == ["CONFIG_CHARSET_UNKNOWN", "CONFIG_DELIMITER_INVALID", "CONFIG_QUOTE_INVALID", "CONFIG_HEADER_LINE_INVALID", "CONFIG_COLUMN_COUNT_INVALID", "CONFIG_FIELD_REFERENCE_INVALID"]
    good = Structure(("a", "b"))
    assert v.structure_problems(good) == []
    assert v.structure_problems(Structure(("1", "x"), by_index=True)) == ["CONFIG_FIELD_REFERENCE_INVALID"]
    assert v.filter_problems([RecordFilter("DROP", "a", "EQUALS", ""), RecordFilter("EXCLUDE", "z", "EQUALS", "")], good) == ["CONFIG_FILTER_INVALID:a", "FILTER_COLUMN_MISSING:z"]
    assert v.mapping_problems([("EAN", "a"), ("EAN", "q"), ("NEW", "b")], {"EAN": "TEXT"}, good) == ["CONFIG_MAPPING_DUPLICATE_TARGET:EAN", "CONFIG_MAPPING_SOURCE_UNRESOLVED:EAN", "CONFIG_MAPPING_TARGET_UNKNOWN:NEW"]
    assert v.readiness({"structure": [], "filters": ["CONFIG_FILTER_INVALID:a"]}) == [("structure", "READY"), ("filters", "CONFIG_FILTER_INVALID:a"), ("link", "NOT_READY")]
    assert v.readiness({"structure": []}, {"source": True}) == [("structure", "READY"), ("source", "READY"), ("link", "READY")]


def test_profiles():
    assert set(map(tuple, v.profile_problems(PROFILE).values())) == {()}
    M = FieldMapping
    bad = Profile(
        Structure(("a", "b")), (M("supplier", "a", "PREFIX"), M("supplier", "q"), M("description", "a", "TURN"), M("grp", "a", "ADD", "operand=1;operandField=b"), M("what", "b"), M("reference", "a", "SPLIT", "index=1"), M("currency", kind="CONCAT", settings="sources=a|z")),
        (RecordFilter("EXCLUDE", "z", "EQUALS", ""),), ("EAN",), version=9, link_currency="euro", critical_fields=("nothing",),
    )
    assert v.profile_problems(bad, "BOXPLOT") == {
        "structure": [], "filters": ["FILTER_COLUMN_MISSING:z"], "mappings": ["CONFIG_MAPPING_DUPLICATE_TARGET:supplier", "CONFIG_MAPPING_SOURCE_UNRESOLVED:supplier", "CONFIG_MAPPING_TARGET_UNKNOWN:what"],
        "transforms": ["CONFIG_TRANSFORM_INVALID:supplier", "CONFIG_TRANSFORM_INVALID:description", "CONFIG_TRANSFORM_INVALID:grp", "CONFIG_TRANSFORM_INVALID:reference", "CONFIG_MAPPING_SOURCE_UNRESOLVED:currency"], "identity": [],
        "prices": ["CONFIG_PRICE_FIELD_MISSING", "CONFIG_PRICE_CONTROL_MODEL_UNSUPPORTED"], "references": ["CONFIG_FIELD_NOT_RESOLVED:EAN"], "currency": ["CONFIG_LINK_CURRENCY_INVALID"], "criticality": ["CONFIG_FIELD_CRITICALITY_INVALID:nothing"], "version": ["CONFIG_CANONICALISATION_VERSION_UNSUPPORTED"],
    }
    assert v.profile_problems(Profile(Structure((), charset="nope"), ())) == {"structure": ["CONFIG_CHARSET_UNKNOWN", "CONFIG_FIELD_REFERENCE_INVALID"], "skipped": ["INFO_CONFIG_CHECKS_SKIPPED"]}


def test_config_hash_ignores_the_order_of_keys():
    assert values.config_hash([("a", "1"), ("b", None)]) == values.config_hash([("b", None), ("a", "1")]) != values.config_hash([("a", "1"), ("b", "")])


def test_amounts_in_hashes(spark):
    rows = spark.createDataFrame([(1_500_000,), (0,), (-10_000,), (12_345_678_000_000,), (None,)], "m long")
    assert [r[0] for r in rows.select(publication.plain_amount(F.col("m"))).collect()] == ["1.5", "0", "-0.01", "12345678", "null"]


def test_bookmark_values(spark):
    kinds = [("12", "INTEGER", None), ("1,5", "DECIMAL", None), ("2024-02-30", "DATE", "DATE_INVALID"), ("yes", "BOOLEAN", "BOOLEAN_INVALID"), ("", "TEXT", "VALUE_MISSING"), ("b", "ENUM", None)]
    for raw, kind, want in kinds:
        assert spark.range(1).select(values.bookmark_error(F.lit(raw), kind, choices=("a", "b"))).head()[0] == want
    assert spark.range(1).select(values.bookmark_error(F.lit("abc"), "TEXT", pattern="[0-9]+")).head()[0] == "PATTERN_MISMATCH"
