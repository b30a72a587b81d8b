"""What Python workers hold at once: they keep the memory of their largest step while they wait, beside the executor's JVM."""

import tracemalloc

import numpy as np
import pyarrow as pa

from veldmark.llm import jaccard_join, repeats, storage
from veldmark.llm.quality_rules import _features


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def batch(n_docs: int, n_words: int) -> pa.RecordBatch:
    words = np.random.default_rng(3).integers(0, 1 << 40, (n_docs, n_words))
    ids = pa.array(range(n_docs), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, ids, pa.array([" ".join(f"{w:x}" for w in row) for row in words])], ["k1", "k2", "doc_id", "text"])


def test_senders_of_shingles_and_rules_hold_little():
    texts = batch(4_000, 300)  # 13 MB

    def send():
        sender = repeats.Sender(51, False, jaccard_join.LEAST)
        for part in jaccard_join._send(5, 75)([texts]):
            for _ in sender.add(*part):
                pass
        for _ in sender.flush():
            pass

    assert peak_mb(send) < 60  # 116 with slices of 2 MB and a million keys at once
    assert peak_mb(lambda: [None for _ in _features("text", ["doc_id"])([texts])]) < 60


def test_a_block_of_keys_is_counted_in_little_memory():
    keys = np.random.default_rng(5).integers(0, 1 << 21, 4_000_000, dtype=np.uint64).astype(np.uint32)
    asked = len(keys) - 1_000
    got = []
    assert peak_mb(lambda: got.append(repeats.seen_twice(keys, None, asked, False))) < 240  # 305 with counts of 64 bits
    _, of, n = np.unique(keys, return_inverse=True, return_counts=True)
    twice = n[of[:asked]] > 1
    twice |= np.isin(keys[:asked], keys[asked:])  # later keys count as two
    assert not (twice & ~got[0]).any() and (got[0] & ~twice).mean() < 0.05


def test_texts_go_to_workers_in_small_batches(spark):
    texts = spark.range(2_000).selectExpr("id", "repeat('word ', 1000) AS text").coalesce(1)  # 10 MB
    before = spark.conf.get(storage.BATCH)
    told = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    largest = storage.Workspace(spark, "test").write(told, "told", storage.SMALL_BATCH).agg({"n": "max"}).head()[0]
    assert largest < 4e6 and spark.conf.get(storage.BATCH) == before
