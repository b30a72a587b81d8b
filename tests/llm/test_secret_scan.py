"""Secrets that no pattern tells: recall and false discoveries on keys that are planted in the driver's texts."""

import random
import re
import string
import time

from pyspark.sql import functions as F

from veldmark.llm import secret_scan
from veldmark.llm.arrays import starts_of

from .helpers import SCHEMA, table

ALPHABETS = [
    string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_uppercase + "234567", "0123456789ABCDEF", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "-_",
]


def test_planted_keys_are_found_and_other_long_tokens_are_not(spark):
    rng = random.Random(1)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    pick = lambda words, n, by: by.join(rng.choice(words) for _ in range(n))
    other = [
        lambda: pick(["usr", "local", "share", "lib", "python", "data"], 5, "/"), lambda: "get" + pick(["User", "Name", "File", "Path", "Value", "Index"], 4, ""), lambda: pick(["the", "quick", "brown", "fox", "jumps", "over"], 5, "-"),
        lambda: f"2024-01-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}-00-00", lambda: "a" * rng.randint(16, 30), lambda: "AAAA1111BBBB2222", lambda: "MAX_BUFFER_SIZE_LIMIT", lambda: f"img_{rng.randrange(10**8):08d}_large_thumb",
    ]
    texts, keys = {}, set()
    for i, r in enumerate(rows):
        w = (r.text or "").split(" ")
        if i % 5 == 0:
            alphabet, n = rng.choice(ALPHABETS), rng.choice([20, 24, 32, 40, 64])
            keys.add(key := "".join(rng.choice(alphabet) for _ in range(n)))
            w.insert(rng.randrange(len(w) + 1), key)
        if i % 3 == 1:
            w.insert(rng.randrange(len(w) + 1), rng.choice(other)())
        texts[r.doc_id] = " ".join(w)
    found = secret_scan.find_secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    all_found = {texts[r.doc_id][s.start : s.end] for r in found for s in r.all_spans}
    added = {texts[r.doc_id][s.start : s.end] for r in found for s in r.all_spans if s.kind == 3}
    assert len(keys & all_found) >= 0.9 * len(keys)
    assert len(added - keys) <= 0.05 * len(added)


#: Recall that is asked of planted keys by length: at 16 and 20 characters, words joined look as random as some keys do.
FLOORS = {16: 0.6, 20: 0.85, 24: 0.9, 32: 0.95, 48: 0.95, 64: 0.95, 128: 0.95}


def test_recall_by_length(spark):
    rng = random.Random(3)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts, keys = {}, {}
    for i, r in enumerate(rows):
        w = (r.text or "").split(" ")
        n = list(FLOORS)[i % 9] if i % 9 < len(FLOORS) else None
        if n:
            keys[key := "".join(rng.choice(ALPHABETS[i % len(ALPHABETS)]) for _ in range(n))] = n
            w.insert(rng.randrange(len(w) + 1), key)
        texts[r.doc_id] = " ".join(w)
    found = secret_scan.find_secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    hits = {texts[r.doc_id][s.start : s.end] for r in found for s in r.all_spans}
    added = {texts[r.doc_id][s.start : s.end] for r in found for s in r.all_spans if s.kind == 3}
    for n, floor in FLOORS.items():
        own = [k for k, m in keys.items() if m == n]
        share = sum(k in hits for k in own) / len(own)
        print(n, len(own), round(share, 3))
        assert share >= floor, n
    print("false", len(added - set(keys)), "of", len(added))
    assert len(added - set(keys)) <= 0.05 * len(added)


def test_many_matches_cost_little(spark):
    text = " ".join(f"token={i:08d}" for i in range(8000))
    docs = table(spark, [text])
    began = time.time()
    (row,) = secret_scan.find_secrets(docs).collect()
    assert len(row.base) == 8000 and row.base[7999].end == len(text) and row.base[1].start == 15
    assert time.time() - began < 60


def test_starts(spark):
    rng = random.Random(2)
    lists = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 15, 16, 17, 100, 1000)]
    rows = spark.createDataFrame([(x,) for x in lists], "x array<int>").select("x", starts_of(F.col("x")).alias("s")).collect()
    for r in rows:
        assert r.s == [sum(r.x[:i]) for i in range(len(r.x))]


def test_no_decoys_nothing_added(spark):
    docs = spark.createDataFrame([(1, "Zx8k" * 4 + "q9", None, None, None), (1, None, None, None, None)], SCHEMA)
    rows = secret_scan.find_secrets(docs).collect()
    assert [len(r.all_spans) for r in rows] == [0, 0]


def test_decoys_are_all_words_of_whole_texts(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("the Quick brown fox jumps over a lazy dog deadbeef".split()) + rng.choice(["", ".", "7", "/x"]) for _ in range(n)) for n in (0, 3, 40, 500, 9000)] + [None, "ab" * 8, "fade " * 30]
    found = {(r.length, r.score): r.n for r in secret_scan.decoy_counts(table(spark, texts), F.col("text")).collect()}
    pieces = []
    for text in texts:
        letters = "".join(re.findall(secret_scan.WORD, text or ""))
        while len(letters) >= 16:
            for n in secret_scan.CLASSES:
                if len(letters) < n:
                    while len(letters) >= 16:
                        pieces, letters = [*pieces, letters[:16]], letters[16:]
                    break
                pieces, letters = [*pieces, letters[:n]], letters[n:]
    scored = spark.createDataFrame([(p,) for p in pieces], "p string").select(F.length("p").alias("n"), secret_scan._battery(F.col("p")).alias("score")).groupBy("n", "score").count().collect()
    assert found == {(secret_scan.CLASSES.index(r.n), r.score): r["count"] for r in scored}


def test_the_end_of_a_long_text_counts(spark):
    """Words that look random at the end of a long text are decoys too, however plain its beginning is."""
    rng = random.Random(6)
    plain = "aaaa " * 2000
    odd = " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(4000))
    counts = {t: {r.score for r in secret_scan.decoy_counts(table(spark, [t]), F.col("text")).where("length = 2").collect()} for t in (plain, plain + odd)}
    assert min(counts[plain]) > secret_scan.REJECTED and min(counts[plain + odd]) == 0


def test_base_spans_need_no_candidates(spark):
    from veldmark.llm import queries

    path = "/root/testdata/sf0.001"
    rows = queries.secret_base_spans(spark, path)
    # straight from the documents, not from a written scan with candidates
    assert all("/documents.parquet" in f for f in rows.inputFiles())
    whole = secret_scan.op5_secret_scan(spark, path).drop("spans")
    assert rows.columns == whole.columns and rows.exceptAll(whole).count() == whole.exceptAll(rows).count() == 0
