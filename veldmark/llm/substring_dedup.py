"""Remove word windows that repeat anywhere in the corpus.

A window is ``size`` consecutive words of one document. Its *anchor* is the
leftmost least-hashed ``ANCHOR``-word gram inside it, so a window that starts
at two places has two anchor occurrences with the same key, and the number of
a key's anchor occurrences is never less than the number of such windows.

1. Count-min prefilter. Tasks send the anchors that they have (about one word
   in fourteen is one) as 32-bit codes with the document and place to answer to,
   those that repeat inside a task once; a block of the key space adds the codes of
   all tasks up in its sketch, and answers which anchors are estimated at two or
   more. The estimate is never below the number of windows, so no repeated
   window is lost. (A sketch that tasks fill and others read as a whole would have
   to be broadcast, and it grows with the corpus; so what travels is the addressed
   codes, and what the sketch saves is the memory of blocks, not their traffic.)
2. Exact pass. Only windows whose anchor passed are grouped, by 96 bits of
   their word sequence.
3. Words covered by a window that starts elsewhere too are removed.

Nothing is broadcast, the sketch of a block is as large as its own keys want,
and blocks follow the input. Keys repeated within one task travel once.

Defined cases: a null or empty text has no words; null ids are kept; equal
rows count as several documents; other columns of the input are ignored
(``k1`` and ``k2`` may be among them); very long texts are cut into overlapping
stretches only for the search of anchors; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U64, mix, slices, sliding_min, windows
from .repeats import answers, blocks_for, by_document, sent_by
from .storage import Workspace, row_keys

ANCHOR = 8
#: Low bits that hold a position while the leftmost least gram is sought.
PLACE = (1 << 24) - 1


def _anchors(word_hash, first, size):
    """The anchor of each whole window, as an index of words, else -1; and the gram hashes."""
    gram = min(ANCHOR, size)
    g, _ = windows(word_hash, first, gram)
    at = np.full(len(g), -1, np.int64)
    m = len(g) - size + 1
    if m > 0:
        place = np.arange(len(g), dtype=U64)
        _, whole = windows(word_hash, first, size)
        step = PLACE - size  # longer runs than PLACE are cut into overlapping stretches
        for a in range(0, m, step):
            to = min(m, a + step)
            end = to + size - gram
            low = sliding_min((g[a:end] & U64(~PLACE & (1 << 64) - 1)) | (place[a:end] - U64(a)), size - gram + 1)
            at[a:to] = (low[: to - a] & U64(PLACE)).astype(np.int64) + a
        at[~whole] = -1
    return at, g


def _columns(batch):
    return batch.column("k1").to_numpy(zero_copy_only=False), batch.column("k2").to_numpy(zero_copy_only=False)


def _send_anchors(size):
    def produce(batches):
        for batch, words in slices(batches):
            h = words.hashes()
            at, g = _anchors(h, words.first, size)
            chosen = np.zeros(len(h), bool)
            chosen[at[at >= 0]] = True
            i = np.flatnonzero(chosen)
            doc = words.document()[i]
            yield (*_columns(batch), doc, i - words.first[doc], mix(g[i], 8), None)  # mixed, as anchors are the least hashes

    return produce


def _flags(parts, n: int) -> np.ndarray:
    flag = np.zeros(n, bool)
    for x in parts or ():
        flag[np.frombuffer(x, np.uint32)] = True
    return flag


def _all_flags(batch, words, name="parts") -> np.ndarray:
    lists = batch.column(name).to_pylist()
    return np.concatenate([np.zeros(0, bool), *(_flags(p, n) for p, n in zip(lists, np.diff(words.first), strict=True))])


def _send_windows(size):
    def produce(batches):
        for batch, words in slices(batches):
            h = words.hashes()
            at, _ = _anchors(h, words.first, size)
            flag = _all_flags(batch, words)
            i = np.flatnonzero((at >= 0) & flag[np.maximum(at, 0)])
            key, _ = windows(h, words.first, size, salt=1)
            low, _ = windows(h, words.first, size, salt=2)
            doc = words.document()[i]
            yield (*_columns(batch), doc, i - words.first[doc], key[i], low[i].astype(np.uint32))

    return produce


def _covered(start: np.ndarray, size: int) -> np.ndarray:
    """Words under a window that starts at a flagged word."""
    n = len(start)
    step = np.zeros(n + size + 1, np.int64)
    at = np.flatnonzero(start)
    step[at] += 1
    step[at + size] -= 1
    return np.cumsum(step)[:n] > 0


def _whole(batches):
    """Every document as if nothing repeated: number of words, and the hash of all words."""
    for batch in batches:
        texts = [(x or b"").split() for x in batch.column("text").cast(pa.binary()).to_pylist()]
        hashes = [hashlib.sha256(b" ".join(w)).hexdigest() for w in texts]
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("doc_id"), pa.array([len(w) for w in texts], pa.int64()), pa.array(hashes, pa.string())], ["k1", "k2", "doc_id", "n_words", "all_sha256"])


def _cut(size, keep_text):
    def run(batches):
        for batch, words in slices(batches):
            removed, hashes, kept_texts = [], [], []
            starts = _all_flags(batch, words)
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for d, text in enumerate(texts):
                own = (text or b"").split()
                gone = _covered(starts[words.first[d] : words.first[d + 1]], size)
                kept = b" ".join([w for w, x in zip(own, gone.tolist(), strict=True) if not x])
                removed.append(int(gone.sum()))
                hashes.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pa.array(hashes, pa.string()), pa.array(kept_texts, pa.string())], ["k1", "k2", "n_removed", "cut_sha256", "kept_text"])

    return run


def remove_repeated_windows(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 35, keep_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with keep_text kept_text, the kept words of documents that lost any (null elsewhere: nothing was removed)."""
    if size < 2:
        raise ValueError("a window has two words at least")
    spark = documents.sparkSession
    work = Workspace(spark, "substring-dedup")
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_keys(F.col(id_col), F.col(text_col)))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    anchors = answers(sent_by(docs.select("k1", "k2", "text"), _send_anchors(size), blocks_for(n_chars // 60, partitions), False), False)
    estimated = work.write(by_document(anchors), "estimated")
    some = work.write(docs.select("k1", "k2", "text").join(estimated, ["k1", "k2"]), "candidates")
    work.drop(estimated)
    repeated = answers(sent_by(some, _send_windows(size), blocks_for(n_chars // 6, partitions), True), True)
    repeated = work.write(by_document(repeated), "repeated")
    cut = some.drop("parts").join(repeated, ["k1", "k2"]).mapInArrow(_cut(size, keep_text), "k1 long, k2 long, n_removed long, cut_sha256 string, kept_text string").dropDuplicates(["k1", "k2"])
    whole = docs.mapInArrow(_whole, f"k1 long, k2 long, doc_id {dict(docs.dtypes)['doc_id']}, n_words long, all_sha256 string")
    out = whole.join(cut, ["k1", "k2"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("cut_sha256", "all_sha256").alias("kept_sha256"), "kept_text")
    return out if keep_text else out.drop("kept_text")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=35, keep_text=False)
