"""Golden values and table-driven cases of the functions."""

import random
import re
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from veldmark.functions import filters, fingerprint as fp, issues, numeric, text, transforms
from veldmark.operators import issues as issue_ops
from veldmark.operators import judge, prices


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).head()


def test_pinned_fingerprints(spark):
    lit, null = F.lit, F.lit(None).cast("string")
    got = one(
        spark,
        fp.identity(1, lit("ACME"), lit("G1"), lit("R-1")), fp.price(1, lit("1.500000"), null), fp.price(2, lit("1.500000"), null),
        fp.sha(fp.canonical(2, lit("EAN"), lit("5449000000996"))), fp.sha(fp.canonical(2)), fp.sha(fp.canonical(2, lit("EAN"), null)),
        fp.combined(fp.identity(1, lit("ACME"), lit("G1"), lit("R-1")), fp.sha(fp.canonical(1, lit("Boormachine"))), fp.price(1, lit("1.500000"), null)),
    )
    assert list(got) == [
        "dff236898555b53c1cc5d938b32aea5a7eb40352eef59d7e03e3422db13ae3ba",
        "a69bed13cadfe6a3868f53f3fb3f90f8eea9c1bcd2240b77fb45c010de227f39",
        "12f8cd1cae0b1aa9b0a6f4a29835e1f6e0a55f845823d42777f486e2b192e2c8",
        "ad73e7363591799fc34fd31dd832d7225f1d2d3c3894feab1a8c706a403ecb83",
        "d4735e3a265e16eee03f59718b9b5d03019c07d8b6c51f90da3a666eec13ab35",
        "9bf26089077e52d71ce5bd4195eed1210c6f16486ff09b84617d0d614811b809",
        "8d41d04385229e381addd8e615f5989cc7882fde949ba508be54a20bb6216875",
    ]


def test_half_up_percent_is_exact(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(-(10**15), 10**15), rng.choice([-1, 1]) * rng.randint(1, 10**15)) for _ in range(500)] + [(1, 8), (-1, 8), (1, 200_000_000_000_000), (5, 0)]
    rows = spark.createDataFrame(pairs, "n long, d long").select("n", "d", numeric.half_up_percent(F.col("n"), F.col("d")).alias("q")).collect()
    for r in rows:
        if r.d == 0:
            assert r.q is None
        else:
            n, d = abs(r.n) * 100 * 10**12, abs(r.d)
            q = (2 * n + d) // (2 * d)
            assert int(r.q) == (q if (r.n < 0) == (r.d < 0) else -q)


def test_half_up_mean(spark):
    rows = spark.createDataFrame([(3, 2), (-3, 2), (10, 4), (7, 7)], "t long, n long").select("t", "n", numeric.half_up_mean(F.col("t"), F.col("n")).alias("m")).collect()
    for r in rows:
        assert r.m == int((Decimal(r.t) / r.n).quantize(Decimal(1), ROUND_HALF_UP))


@pytest.mark.parametrize(
    ("raw", "code", "micro"),
    [("12,5", None, 12_500_000), ("12.5", None, 12_500_000), ("12,3x", "PRICE_UNREADABLE", None), ("  ", "PRICE_MISSING", None), (None, "PRICE_MISSING", None), ("1,2345678", "PRICE_SCALE_EXCEEDED", None), ("1234567890123456789", "PRICE_OUT_OF_RANGE", None), ("1.50000000", None, 1_500_000), ("1,2,3", "PRICE_UNREADABLE", None)],
)
def test_decimals(spark, raw, code, micro):
    c = F.lit(raw).cast("string")
    plain = text.plain_decimal(c)
    got = one(spark, text.price_error(c, plain), text.micro_units(plain))
    assert got[0] == code
    if micro is not None:
        assert got[1] == micro


def test_declared_notation(spark):
    got = one(spark, text.plain_decimal(F.lit("1.234,50"), ",", "."), text.plain_decimal(F.lit("12.5"), ",", "."), text.plain_decimal(F.lit("1234,5"), ",", "."))
    assert list(got) == ["1234.50", None, "1234.5"]


def test_text(spark):
    got = one(
        spark, text.outer_trim(F.lit("\t a b \n")), text.normalise_reference(F.lit(" ​12\x0034 ")), text.normalise_reference(F.lit("​")), text.parsed_integer(F.lit(" -000 ")), text.parsed_integer(F.lit("+0012345678901234567890")),
        text.parsed_boolean(F.lit("1")), text.parsed_boolean(F.lit("yes")), text.parsed_date(F.lit("2024-02-30")), text.parsed_date(F.lit("2024-02-29")), text.utf16_length(F.lit("a\U0001f600")), text.parsed_instant(F.lit("2024-07-01 12:00"), "yyyy-MM-dd HH:mm", "Europe/Brussels"),
    )
    assert list(got) == ["a b", "1234", None, "0", "12345678901234567890", "true", None, None, "2024-02-29", 3, "2024-07-01T10:00:00Z"]


def test_split_record(spark):
    split = lambda line: one(spark, text.split_record(F.lit(line), ";", '"'))[0]
    assert split('a;"b;c";"d ""e"""') == ["a", "b;c", 'd "e"']
    assert split("a;;") == ["a", "", ""]
    assert split('a;"open') is None
    assert split('""') == [""] and split('"";""') == ["", ""] and split('""""') == ['"'] and split('"a""";b') == ['a"', "b"]
    assert split('a"b;c') is None and split('"a"b;c') is None and split('a;"b" ;c') is None and split('"a\x00b";\x00') == ["a\x00b", "\x00"]


def test_split_record_as_a_reader_of_one_line(spark):
    rng = random.Random(8)
    lines = ["".join(rng.choice('ab;"') for _ in range(rng.randint(0, 9))) for _ in range(400)]
    field = r'(?:"((?:[^"]|"")*)"|([^;"]*))'
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").coalesce(1).select(text.split_record(F.col("x"), ";", '"')).collect()]
    for line, fields in zip(lines, got, strict=True):
        good = re.fullmatch(f"{field}(?:;{field})*", line)
        want = [m[1].replace('""', '"') if m[1] is not None else m[2] for m in re.finditer(f";{field}", ";" + line)] if good else None
        assert fields == want, line


def test_long_quoted_fields(spark):
    for field in ("x" * 100_000, 'y""' * 30_000, ";" * 50_000):
        got = one(spark, text.split_record(F.concat(F.lit("a;"), F.lit(f'"{field}"'), F.lit(";b")), ";", '"'))[0]
        assert got == ["a", field.replace('""', '"'), "b"]


def test_wide_amounts(spark):
    c = F.lit("123456789012345678,123456")
    plain = text.plain_decimal(c)
    got = one(spark, text.price_error(c, plain), text.micro_units(plain), fp.amount_text(text.micro_units(plain)), numeric.half_up_percent(text.micro_units(plain), text.micro_units(F.lit("0.000003"))), numeric.half_up_percent(text.micro_units(plain) * 2 + 1, text.micro_units(plain)))
    assert (got[0], int(got[1]), got[2]) == (None, 123456789012345678123456, "123456789012345678.123456")
    n = 123456789012345678123456
    assert int(got[3]) == (2 * n * 10**14 + 3) // 6 if (2 * n * 10**14 + 3) // 6 < numeric.MOST_SHARE else int(got[3]) == numeric.MOST_SHARE
    assert int(got[4]) == (2 * (2 * n + 1) * 10**14 + n) // (2 * n)


def test_arithmetic_is_exact(spark):
    rng = random.Random(5)
    number = lambda: f"{rng.choice(['', '-'])}{rng.randrange(10 ** rng.randint(1, 18))}" + rng.choice(["", f".{rng.randrange(10**6):06d}", f".{rng.randrange(10**12):012d}", ".5"])
    rows = [(i, number(), number()) for i in range(300)] + [(900, "0.000000499999", "1"), (901, "0.0000005", "1"), (902, "-0.0000005", "1"), (903, "1", "3"), (904, "5", "0"), (905, "x", "1"), (906, "2", "7000000"), (907, "1.10", "2.2"), (908, "999999999999999999", "999999999999999999")]
    df = spark.createDataFrame(rows, "i int, x string, y string").coalesce(1)
    for places in (0, 2, 6, 12):
        for op in ("add", "subtract", "multiply", "divide", "percentage"):
            value, error = transforms.arithmetic(F.col("x"), op, F.col("y"), places)
            with localcontext() as ctx:
                ctx.prec = 200
                for r in df.select("i", "x", "y", value.alias("v"), error.alias("e")).collect():
                    if r.x == "x":
                        assert r.e == "TRANSFORM_FAILED"
                        continue
                    x, y = Decimal(r.x), Decimal(r.y)
                    if op in ("divide", "percentage") and y == 0:
                        assert (r.v, r.e) == (None, "TRANSFORM_DIVIDE_BY_ZERO")
                        continue
                    want = {"add": lambda: x + y, "subtract": lambda: x - y, "multiply": lambda: x * y, "divide": lambda: x / y, "percentage": lambda: x * 100 / y}[op]()
                    if op not in ("add", "subtract"):
                        want = want.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)
                    if r.v is None:
                        assert r.e == "TRANSFORM_FAILED" and abs(want) >= 10**20
                    else:
                        assert r.e is None and r.v == f"{abs(want) if want == 0 else want:f}", (op, places, r)


def test_transforms(spark):
    t = transforms
    null = F.lit(None).cast("string")
    got = one(spark, t.affix(null, "p")[0], t.concat([null, F.lit("b")], "-")[0], t.split_part(F.lit("a||c"), "|", 2)[0], t.split_part(F.lit("a"), "|", 2)[1], t.mapped(F.lit("RED"), {"red": "r"}, True)[0], t.mapped(F.lit("blue"), {"red": "r"})[1], t.arithmetic(F.lit("1"), "divide", F.lit("0"))[1], t.defaulted(F.lit(""), "x")[0], t.arithmetic(F.lit("10"), "divide", F.lit("3"), 2)[0].cast("string"))
    assert list(got) == [None, "-b", "", "TRANSFORM_FAILED", "r", "MAPPING_VALUE_UNKNOWN", "TRANSFORM_DIVIDE_BY_ZERO", "", "3.33"]


def test_settings():
    s = transforms.Settings.parse("a=1;m=x>y|z>w")
    assert s.values["a"] == "1" and s.table("m") == {"x": "y", "z": "w"}
    with pytest.raises(ValueError, match="twice"):
        transforms.Settings.parse("a=1;a=2")
    with pytest.raises(ValueError, match="unknown"):
        s.check_used({"a"})


def test_filters(spark):
    R = filters.RecordFilter
    rows = spark.createDataFrame([("A", "x"), ("b", None), ("c", ""), ("d", "keep")], "k string, v string")
    rules = [R("EXCLUDE", "k", "EQUALS", "a", ignore_case=True), R("REJECT", "v", "EQUALS", "z", on_null="REJECT"), R("INCLUDE", "v", "BEGINS_WITH", "keep")]
    assert [r.d for r in rows.select("k", filters.decision(rules, rows.columns).alias("d")).orderBy(F.lower("k")).collect()] == ["EXCLUDE", "REJECT", "REJECT", "KEEP"]
    with pytest.raises(ValueError, match="FILTER_COLUMN_MISSING"):
        filters.decision([R("EXCLUDE", "nope", "EQUALS", "")], rows.columns)


def test_signature_is_cut(spark):
    got = one(spark, issues.signature(("FIELD", F.lit("f")), ("KIND", F.lit(None).cast("string"))), F.length(issues.signature(("FIELD", F.lit("x" * 400)))), issue_ops.allowed_step(F.lit("CORRECTED"), F.lit("REJECTED")))
    assert list(got) == ["FIELD=f", 300, False]


@pytest.mark.parametrize(("count", "scope", "percent", "want"), [(None, 5, 1, "UNDETERMINED"), (0, 5, 1, "NOT_APPLICABLE"), (1, 100, 1, "WITHIN"), (2, 100, 1, "EXCEEDED"), (1, 0, 1, "EXCEEDED"), (9, 1, None, "WITHIN")])
def test_threshold(spark, count, scope, percent, want):
    c = lambda v: F.lit(v).cast("bigint")
    assert one(spark, judge.threshold(c(count), c(scope), c(percent)))[0] == want


def test_deviation_on_the_limit_is_not_exceeded(spark):
    rows = spark.createDataFrame([(120, 100, 100, None), (121, 100, 200, 0), (80, 100, 100, 100), (79, 100, 100, 100)], "amount long, previous long, avg_short long, avg_long long")
    got = prices.control(rows, 20).select("amount", "exceeded", "direction", "dev_avg_long").orderBy("amount").collect()
    assert [(r.amount, r.exceeded, r.direction) for r in got] == [(79, True, "DOWN"), (80, False, None), (120, False, None), (121, True, "UP")]
    assert got[3].dev_avg_long is None
