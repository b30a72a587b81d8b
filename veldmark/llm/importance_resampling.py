"""Draw the documents that look most like a target text collection: importance weights on hashed words, then Gumbel top-k.

A byte automaton finds words and their CRCs. The bytes of an Arrow string buffer
are classed by a table of 256, word boundaries are where the class differs from
the byte before, and the CRCs of all words of a slice advance together, one byte
a step. CRC-32 is linear, so words are cut into pieces of PIECE bytes that
advance side by side, and a piece's CRC is moved over the bytes behind it by
tables for 1, 2, 4, ... zero bytes; a very long word costs no long loop, and
runs of several words are put together from their words.

Two passes read the texts: one counts features by bucket (each task sends its sum a bucket), one
weighs documents with the table of gains, which has one number a bucket. Ranks come
from a distributed sort: rows are numbered in their partition, partitions by their counts.

Defined cases: a null or empty text has no words, weight 0 and is never drawn where ``least_words``
is above 0; a null id is hashed as an empty one and comes last among ties; rows that are
equal in score and id are drawn in the order in which they were read; very long texts count whole; an empty
table gives an empty result, an empty target equal gains for unseen buckets; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import LOWER, Words, slices
from .storage import Workspace

#: Bytes of words: digits, letters (capital ones are lowered first) and all of characters beyond ASCII.
OF_WORD = np.zeros(256, bool)
OF_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
PIECE = 32


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


TABLE = _byte_table()


def _step(crc: np.ndarray, byte) -> np.ndarray:
    return TABLE[(crc ^ byte) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))


def _shift_tables(bits: int = 40) -> list[np.ndarray]:
    """For each k, four tables of 256 that move a CRC over 2^k zero bytes: one for each byte of the CRC."""
    basis = np.array([[v << 8 * b for v in range(256)] for b in range(4)], np.uint32)
    out = [_step(basis, np.uint32(0))]
    for _ in range(bits - 1):
        out.append(_shift_by(out[-1], out[-1]))
    return out


def _shift_by(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & np.uint32(0xFF)] ^ table[1][crc >> np.uint32(8) & np.uint32(0xFF)] ^ table[2][crc >> np.uint32(16) & np.uint32(0xFF)] ^ table[3][crc >> np.uint32(24)]


SHIFTS = _shift_tables()


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each CRC after so many zero bytes."""
    crc = crc.copy()
    for k in range(int(zeros.max(initial=0)).bit_length()):
        at = np.flatnonzero(zeros >> k & 1)
        crc[at] = _shift_by(SHIFTS[k], crc[at])
    return crc


def _advance(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC registers from 0 over data[start : start + length], all starts at once; the longest come first, so those still on the way are a prefix."""
    order = np.argsort(-lengths.astype(np.int8), kind="stable")
    at, crc = starts[order], np.zeros(len(starts), np.uint32)
    on_the_way = len(lengths) - np.cumsum(np.bincount(lengths, minlength=PIECE + 1))
    for k in range(int(lengths.max(initial=0))):
        n = on_the_way[k]
        crc[:n] = _step(crc[:n], data[at[:n] + k])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The linear part of the CRC of each data[start:end], none of which is empty."""
    lengths = ends - starts
    if lengths.max(initial=0) <= PIECE:
        return _advance(data, starts, lengths)
    pieces = -(-lengths // PIECE)
    first = np.cumsum(pieces) - pieces
    of = np.repeat(np.arange(len(starts)), pieces)
    begin = starts[of] + (np.arange(len(of)) - first[of]) * PIECE
    stop = np.minimum(begin + PIECE, ends[of])
    return np.bitwise_xor.reduceat(shifted(_advance(data, begin, stop - begin), ends[of] - stop), first)


FULL = np.uint32(0xFFFFFFFF)


def features(words: Words, longest: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to longest words: the word each starts at, and the CRC-32 of its words joined by one space."""
    n = len(words.starts)
    if not n:
        return
    lengths = words.ends - words.starts
    own = registers(LOWER[words.data], words.starts, words.ends)
    left = words.first[1:][words.document()] - np.arange(n)  # words from here to the document's end
    at, state = np.arange(n), np.full(n, FULL)
    for run in range(longest):
        if run:
            stay = left[at] > run
            at, state = at[stay], _step(state[stay], np.uint32(0x20))
        state = shifted(state, lengths[at + run]) ^ own[at + run]
        yield at, state ^ FULL


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """Features of all texts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, words in slices(batches, of_word=OF_WORD):
            for _, crc in features(words, longest):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # one row a bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's thousandths of log-ratio of its smoothed shares in target and raw."""
    n, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weights_of(documents: DataFrame, gains: np.ndarray, id_col: str, text_col: str, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in slices(batches, of_word=OF_WORD):
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            document = words.document()
            for at, crc in features(words, longest):
                n += np.bincount(document[at], minlength=len(n))
                np.add.at(total, document[at], gains[crc % np.uint32(len(gains))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(words.first)), pa.array(n), pa.array(total)], ["doc_id", "n_words", "n_features", "weight"])

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(weigh, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def ranked(rows: DataFrame, work: Workspace, *order) -> DataFrame:
    """rows with ``place``, from 1 on in the given order: rows are numbered in their range of the sort, and ranges follow each other."""
    placed = work.write(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("place", 33)
    before, n = {}, 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a partition of the sort
        before[r["part"]], n = n, n + r["count"]
    if not before:
        return placed
    starts = F.broadcast(rows.sparkSession.createDataFrame(list(before.items()), "part bigint, before bigint"))
    return placed.join(starts, part == F.col("part")).withColumn("place", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).drop("part", "before")


def resample(documents: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = 10_000, longest: int = 1, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score and rank (null: not drawn). Draws percent of the documents of least_words or more, without replacement, with odds that follow exp(weight / 1000)."""
    work = Workspace(documents.sparkSession, "importance-resampling")
    gains = gains_of(bucket_counts(documents, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest))
    rows = weights_of(documents, gains, id_col, text_col, longest)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
    rows = work.write(rows.withColumn("score", (F.col("weight") + noise).cast("bigint")).withColumn("nth", F.monotonically_increasing_id()), "weights")
    fit = F.col("n_words") >= least_words
    places = ranked(rows.where(fit), work, F.desc("score"), F.col("doc_id").asc_nulls_last(), "nth")
    most = percent * places.count() // 100
    own = ["doc_id", "n_words", "n_features", "weight", "score"]
    out = places.select(*own, F.when(F.col("place") <= most, F.col("place")).cast("bigint").alias("rank"))
    return out.unionByName(rows.where(~fit).select(*own, F.lit(None).cast("bigint").alias("rank")))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_words")


#: CRC-32 bit by bit, over distinct words.
ORACLE = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
aims AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
doc_words AS (SELECT doc_id, unnest(w) AS word FROM docs),
bytes AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM doc_words UNION SELECT word FROM aims)),
codes AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 10000 AS bucket FROM bytes),
s AS (SELECT bucket, count(*) AS s FROM doc_words JOIN codes USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aims JOIN codes USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0)::DOUBLE FROM s) AS s_all, (SELECT coalesce(sum(t), 0)::DOUBLE FROM t) AS t_all),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), sums),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM doc_words JOIN codes USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scores AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (doc_id)),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scores LEFT JOIN places USING (doc_id)
"""
