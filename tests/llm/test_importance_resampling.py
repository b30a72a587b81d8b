import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldmark.llm import importance_resampling as ir
from veldmark.llm.hashing import words_of

from .helpers import odd_texts, passage, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def runs(text, longest):
    w = WORD.findall((text or "").translate(UPPER))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, buckets=10_000, longest=1, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw, aim = Counter(), Counter()
    for texts, total in (([t for _, t in docs], raw), (target, aim)):
        for t in texts:
            total.update(bucket(f) for f in runs(t, longest)[1])
    s_all, t_all = sum(raw.values()), sum(aim.values())
    out = []
    for i, t in docs:
        n, found = runs(t, longest)
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = place
    return sorted(map(tuple, out), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.text("aB9é \x00", max_size=300), st.integers(30, 2000).map("x7".__mul__)), max_size=6), st.integers(1, 3))
def test_crcs_of_runs(texts, longest):
    encoded = [t.encode("utf-8", "ignore") for t in texts]
    offsets = np.cumsum([0, *map(len, encoded)])
    words = words_of(np.frombuffer(b"".join(encoded), np.uint8), offsets, ir.OF_WORD)
    got = Counter(int(c) for _, crc in ir.features(words, longest) for c in crc)
    assert got == Counter(zlib.crc32(f.encode()) for t in encoded for f in runs(t.decode(), longest)[1])


@pytest.mark.parametrize("longest", [1, 2])
def test_brute_force(spark, longest):
    texts = [*odd_texts(), *(passage(i, 30 + i) for i in range(60)), "UPPER lower ÀÉ " * 9, "y" * 100_000 + " z" * 30]
    target = [passage(7, 40), passage(9, 50), None, ""]
    docs = table(spark, texts)
    got = ir.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, percent=40)
    assert sorted(map(tuple, got.collect()), key=str) == brute(list(enumerate(texts)), target, longest=longest, percent=40)


def test_odd_rows(spark):
    docs = table(spark, [passage(1, 40)] * 50 + [None, ""]).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 2)).withColumn("weight", F.lit("x")).withColumn("place", F.lit(1))
    got = ir.resample(docs, docs.limit(0), percent=50).collect()
    assert len(got) == 52 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 26))
    places = [(-r["score"], r["doc_id"] is None) for r in sorted(got, key=lambda r: r["rank"] or 99)[:25]]
    assert places == sorted(places)
    assert ir.resample(docs.limit(0), docs).collect() == []
    again = ir.resample(docs, docs.limit(0), percent=50).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
