import hashlib
import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from veldmark.llm import vector_codes as vc
from veldmark.llm.storage import HOT_ROWS

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    kept = [(i, [max(-(2**26), min(2**26, math.floor(256 * float(np.float32(x))))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = sorted(((i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(x) // len(groups[n]) for x in zip(*groups[n])) if n in groups else e for n, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded, totals = [], defaultdict(int)
    for (i, _, label), c in zip(kept, cut):
        found = [nearest(x, books[p]) for p, x in enumerate(c)]
        coded.append((i, label, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
        totals[label] += coded[-1][3]
    return sorted(((i, code, error, totals[label], digest) for i, label, code, error in coded), key=str)


def made(seed, n, width):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, 0.05), 3) for _ in range(width)], rng.choice([None, 1, 2])) for i in rng.sample(range(10 * n), n)]


def found(spark, rows, **how):
    return sorted(map(tuple, vc.compress(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=str)


def test_brute_force(spark):
    rows = made(1, 400, 12)
    assert found(spark, rows, parts=4, entries=8, rounds=2) == brute(rows, 4, 8, 2)


def test_hot_parts(spark):
    rows = made(2, 150, 8)
    rows += [(9000 + i, rows[3][1], 7) for i in range(2 * HOT_ROWS)] + rows[:5]
    assert found(spark, rows, parts=4, entries=16, rounds=3) == brute(rows, 4, 16, 3)


def test_odd_rows(spark):
    rows = [
        (5, [0.5, -0.25, 1.0], 1), (None, [0.1, 0.2, 0.3], None), (1, None, 1), (2, [None, 1.0, 1.0], 1), (3, [float("nan"), 0.0, 0.0], 2), (4, [float("-inf"), 0.0, 0.0], 2), (6, [0.0, 0.0, 0.0], None), (7, [], 3), (8, [0.1] * 9, 3),
        (9, [3e38, -3e38, 1e9], 2), (5, [0.5, -0.25, 1.0], 1), (5, [0.4, -0.25, 1.0], 4),
    ]
    assert found(spark, rows, parts=4, entries=4, rounds=2) == brute(rows, 4, 4, 2)
    assert found(spark, rows, parts=4, entries=64, rounds=0) == brute(rows, 4, 64, 0)
    assert found(spark, [], parts=4) == []
    assert found(spark, [(1, None, 1)], parts=4) == []


def test_other_columns(spark):
    df = spark.createDataFrame([(i, [i / 7, 1.0], "a") for i in range(30)], "vec_id int, embedding array<double>, label string").withColumn("cell", F.lit(0)).withColumn("ints", F.lit("x")).withColumn("of", F.lit(1))
    got = vc.compress(df, parts=2, entries=4)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 30
