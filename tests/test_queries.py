"""Every registered query of the screening engine against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from veldmark.plans import more as catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6))
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(catalog.ORACLES[name])
    own = [d[0] for d in found.description]
    assert sorted(own) == columns
    assert got == sorted(tuple(plain(r[own.index(c)]) for c in columns) for r in found.fetchall())


def test_arithmetic_is_dealt_to_all_cores(spark):
    """Few splits of a small file hold many rows that cost much."""
    assert catalog.QUERIES["x08_x12_arithmetic"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_malformed_records_are_written_small(spark, tmp_path, monkeypatch):
    """Lines beyond the limit are nearly all of the bytes: 20 of them have 2 MB."""
    monkeypatch.setattr("veldmark.plans.catalog.folder", lambda spark, name: f"{tmp_path}/{name}")
    assert catalog.QUERIES["s06_s07_malformed_records"](spark, SF).agg({"too_long": "sum"}).head()[0] == 20
    assert sum(f.stat().st_size for f in tmp_path.rglob("part-*")) < 1_000_000


def test_freeze_sorts_lines_once(spark):
    """Preflight, decisions and stage read the mutations that were written."""
    plan = catalog.QUERIES["c23_sealed_freeze"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
