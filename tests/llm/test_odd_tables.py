"""Empty tables, repeated rows, and columns whose names clash with those inside the operators."""

import pytest
from pyspark.sql import functions as F

from veldmark.llm import decontamination, jaccard_join, preference_format, quality_classifier, quality_rules, secret_scan, source_mixing, substring_dedup, token_counts, warc_archive
from veldmark.llm.storage import Workspace

from .helpers import SCHEMA, odd_texts, table

BENCH = "item_id long, text string"
CLASH = ["k1", "k2", "parts", "node", "n", "component", "salt", "votes", "c0", "c1", "spans", "base", "tokens", "size", "target", "copies", "level", "item", "v", "pos", "score", "name", "label"]


def bench(spark):
    return spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p"), (2, None), (3, "")], BENCH)


def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda s, d: substring_dedup.remove_repeated_windows(d),
    "op2": lambda s, d: quality_classifier.score_documents(d, labels(s)),
    "op3": lambda s, d: jaccard_join.link_documents(d),
    "op4": lambda s, d: token_counts.count_tokens(d).where("section = 0"),
    "op5": lambda s, d: secret_scan.find_secrets(d),
    "op7": lambda s, d: source_mixing.copies_of(d),
    "op9": lambda s, d: quality_rules.score_quality(d),
}
STAGES = {
    "keep_good": lambda s, d: quality_rules.keep_good(d),
    "keep_one": lambda s, d: jaccard_join.keep_one_of_each(d),
    "remove_leaks": lambda s, d: decontamination.remove_leaks(d, bench(s)),
    "redact": lambda s, d: secret_scan.redact(d),
    "mix": lambda s, d: source_mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_return_every_row(spark, name):
    docs = table(spark, odd_texts()).unionByName(spark.createDataFrame([(None, "no id", None, None, None), (None, None, None, None, None)], SCHEMA))
    docs = docs.unionByName(docs)  # every row twice
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("clash"))
    rows = OPERATORS[name](spark, docs).collect()
    assert len(rows) == docs.count()
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, name):
    docs = table(spark, odd_texts()).unionByName(spark.createDataFrame([(None, "no id", None, None, None), (None, None, None, None, None)], SCHEMA))
    docs = docs.unionByName(docs)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("clash"))
    out = STAGES[name](spark, docs)
    assert set(out.columns) == set(docs.columns) | ({"mix_copies"} if name == "mix" else set())
    assert all(r[c] == "clash" for r in out.collect() for c in CLASH)  # their values too
    assert out.count() <= docs.count()
    assert STAGES[name](spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_equal_in_id_and_text_stay_apart(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", s, 5) for s in "ab"] + [(2, text + " x", "en", "a", None)], SCHEMA)
    got = [source_mixing.mix(docs.repartition(n)).select("doc_id", "source", "copies") for n in (1, 3)]
    want = source_mixing.copies_of(docs).select("source", "target").distinct().collect()
    assert {r.source for r in got[0].collect()} == {"a", "b"} == {r.source for r in want}
    assert sorted(got[0].collect()) == sorted(got[1].collect())
    assert got[0].where("source = 'b'").head().copies in (1, 2)
    kept = [sorted(map(tuple, jaccard_join.keep_one_of_each(docs.repartition(n)).collect())) for n in (1, 2, 3)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 1


def test_text_ids_and_long_turns(spark):
    said = lambda c, texts: [(c, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    rows = said("2", ["q", "a1"]) + said("3", ["q", "b1 " * 20_000]) + said("abc", ["q", "a2"]) + said("03", ["q", "zz"]) + said("4.0", ["q", "y"]) + said(None, ["q", "n"])
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("id", F.lit("x"))
    got = preference_format.format_pairs(preference_format.pairs_of(preference_format.conversations(turns))).collect()
    assert sorted(r.pair_id for r in got) == ["2", "3"]
    long = next(r for r in got if r.pair_id == "3")
    assert long.chosen_mask[-1].end == len(long.chosen_completion) and len(long.chosen_completion) > 60_000


def test_pages_and_conversations(spark):
    pages = spark.createDataFrame([(None, "u", "x" * 200), (1, "u", "x" * 200), (1, "u", "x" * 200), (2, None, None)], "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("salt", F.lit(1))
    path = Workspace(spark, "test").path("archive")
    warc_archive.write_archive(pages, path)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc_archive.archive_report(spark, path).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "revisit", 1), (2, "response", None), (None, "revisit", 1)], key=str)
    path = Workspace(spark, "test").path("archive")
    warc_archive.write_archive(pages.limit(0), path)
    assert warc_archive.archive_report(spark, path).collect() == []
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference_format.format_pairs(preference_format.pairs_of(preference_format.conversations(turns))).collect() == []


def test_no_benchmark_no_leaks(spark):
    docs = table(spark, odd_texts())
    assert decontamination.leaks(docs, spark.createDataFrame([], BENCH)).collect() == []


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secrets", "mixing"]
    assert {"doc_id", "text", "lang", "source", "n_chars", "copies"} == set(out.columns) and out.count() > 0
    assert out.where("copies < 1 or copies > 3").count() == 0
