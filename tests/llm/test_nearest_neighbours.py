import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldmark.llm import nearest_neighbours as nn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    f32 = lambda v: [float(np.float32(x)) for x in v]
    kept = [(i, f32(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in sorted(kept):
        if q % every == 0:
            near = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))), i) for i, b in kept if i != q and len(b) == len(a))
            out += [(q, r, i, pytest.approx(d, abs=1e-12)) for r, (d, i) in enumerate(near[:k], 1)]
    return out


def made(seed, n, width):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, rng.choice([0, 0.01, 1])) for x in rng.choice(centres)]) for i in range(n)]
    return rows


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in nn.neighbours(df, F.col("vec_id") % 10 == 0, **how).collect())


@pytest.mark.parametrize("how", [{}, {"query_block": 3, "slice_rows": 40}])
def test_brute_force_with_copies(spark, how):
    rows = made(1, 300, 12)  # many at one distance: a centre is drawn with no noise
    assert found(spark, rows, k=10, **how) == brute(rows, 10, 10)


def test_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ids, v = np.arange(500), rng.normal(size=(500, 1500)).astype(np.float32) * 10 ** rng.uniform(-3, 3, (500, 1)).astype(np.float32)
    monkeypatch.setattr(nn, "TILE_QUERIES", 7)
    monkeypatch.setattr(nn, "TILE_ROWS", 64)
    monkeypatch.setattr(nn, "PAIRS", 50)
    q, i, d = nn.nearest_in_block(ids[::25], v[::25], ids, v, 5)
    for n in ids[::25]:
        far = np.sqrt(((v[n].astype(float) - v.astype(float)) ** 2).sum(axis=1))
        want = sorted((x, int(j)) for j, x in enumerate(far) if j != n)[:5]
        assert sorted(i[q == n].tolist(), key=lambda j: (far[j], j)) == [j for _, j in want]


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (10, None), (20, []), (30, [0.0, 0.0]), (40, [1.0, None]), (50, [float("nan"), 1.0]), (60, [float("inf"), 1.0]), (None, [1.0, 2.0]),
        (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.5]), (70, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 4.0]), (80, [5.0]), (90, [3e38, -3e38]), (-10, [1.0, 2.0]),
    ]
    assert found(spark, rows, k=3) == brute(rows, 3, 10)
    assert found(spark, [], k=3) == []
    assert found(spark, [(1, [1.0]), (2, [2.0])], k=3) == []  # nobody asks
    twice = [(0, [9.0]), (0, [1.0]), (1, [1.5]), (2, [8.0])]
    assert found(spark, twice, k=1) == [(0, 1, 1, 0.5)]  # the least vector of a repeated query id counts


def test_other_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], i) for i in range(30)], "vec_id int, embedding array<double>, label int").withColumnsRenamed({"label": "nth"}).withColumn("vector", F.lit(0)).withColumn("slice", F.lit("x"))
    got = nn.neighbours(df, F.col("vec_id") == 5, k=2).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(5, 1, 4, 1.0), (5, 2, 6, 1.0)]
