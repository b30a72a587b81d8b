"""Product codes of vectors, with codebooks fitted on all of them by integer Lloyd rounds over distinct parts.

Vectors become integers and are cut into equal parts. Equal parts of a position are
counted into one weighted row (a cell), so copies, however many, cost one distance
row; tasks send their own counts, so a hot part doesn't travel by its rows. Lloyd's rounds run over cells: a
task assigns them to the codebook's nearest entries and sends sums by entry. Codes and
errors are then joined back to the vectors, hot parts by broadcast, and put together by vector.

Codebooks (positions x entries x part) are bounded by the parameters and are all that the driver holds.

Defined cases: vectors that are null or hold null or non-finite components are dropped; vectors of
different lengths, empty ones too, are filled up with zeros to the longest, and that to a multiple of ``parts``; integers beyond
+-2^26 are cut to it; with fewer vectors than entries, a codebook has fewer entries; rows without an id come last for the
first codebook, rows of equal id go by their vector; repeated rows get their rows each; null labels are one label; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nearest_neighbours import finite
from .storage import Workspace, hot_bound, left_join_hot

MOST = 1 << 26
#: Cells that are held against a codebook at once.
CELLS = 1 << 14


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows of small ints as fixed-length binary values."""
    rows = np.ascontiguousarray(rows, dtype="<i4")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * 4), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    """The inverse of _packed: position, then components."""
    if not len(column):
        return np.zeros((0, 1), np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<i4").reshape(len(column), -1).astype(np.int64)


def _nearest(cells: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least index of the nearest entry of each cell, and the squared distance."""
    most = max(np.abs(cells).max(initial=0), np.abs(book).max(initial=0))
    kind = np.float64 if 4 * cells.shape[1] * int(most) ** 2 < 1 << 53 else np.int64  # exact in both
    cells, book = cells.astype(kind), book.astype(kind)
    far = (cells**2).sum(axis=1)[:, None] - 2 * (cells @ book.T) + (book**2).sum(axis=1)
    code = far.argmin(axis=1)
    return code, far[np.arange(len(code)), code].astype(np.int64)


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches with their cells (position first), codes and squared distances."""
    for batch in batches:
        for at in range(0, batch.num_rows, CELLS):
            piece = batch.slice(at, CELLS)
            cells = _unpacked(piece.column(0))
            code, error = np.zeros(len(cells), np.int64), np.zeros(len(cells), np.int64)
            for p in np.unique(cells[:, 0]):
                own = np.flatnonzero(cells[:, 0] == p)
                code[own], error[own] = _nearest(cells[own, 1:], books[p])
            yield piece, cells, code, error


def _round(cells: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round; entries without cells stay."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch, rows, code, _ in _assigned(batches, books):
            n, slot = batch.column(1).to_numpy(), rows[:, 0] * entries + code
            np.add.at(total, slot, rows[:, 1:] * n[:, None])
            np.add.at(count, slot, n)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["slot", "n", "total"])

    found = cells.mapInArrow(sums, "slot int, n bigint, total array<bigint>").groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)))
    books = books.copy()
    for r in found.collect():  # one row an entry at most
        books[r["slot"] // entries, r["slot"] % entries] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return books


def compress(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """One row per vector: vec_id, code (two hex digits a part), error, label_error and codebooks_sha256."""
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    spark = embeddings.sparkSession
    work = Workspace(spark, "vector-codes")
    vector = F.col(vector_col)
    ints = F.transform(vector, lambda x: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(x.cast("double") * scale).cast("double"))).cast("int"))
    kept = embeddings.where(finite(vector)).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), ints.alias("ints"), F.monotonically_increasing_id().alias("nth"))
    kept = work.write(kept, "vectors")
    n, longest = kept.agg(F.count(F.lit(1)), F.max(F.size("ints"))).head()
    width = max(1, -(-(longest or 0) // parts))
    filled = F.concat("ints", F.array_repeat(F.lit(0), F.lit(parts * width) - F.size("ints")))
    kept = kept.withColumn("ints", filled)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    books = np.array([r["ints"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(-1, width)
            positions = np.tile(np.arange(parts), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), parts)), _packed(np.column_stack([positions, rows]))], ["nth", "cell"])

    cut_up = kept.select("nth", "ints").mapInArrow(cut, "nth bigint, cell binary")
    cells = work.write(cut_up.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    for _ in range(rounds if n else 0):
        books = _round(cells, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, found, error in _assigned(batches, books):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows[:, 0], pa.int32()), pa.array(found, pa.int32()), pa.array(error)], ["cell", "n", "position", "entry", "off"])

    coded = work.write(cells.mapInArrow(code, "cell binary, n bigint, position int, entry int, off bigint"), "coded")
    hot = coded.where(F.col("n") > hot_bound(n * parts)).drop("n")  # at most HOT_SHARE cells, each with its share of the rows
    rest = coded.where(F.col("n") <= hot_bound(n * parts)).drop("n")
    joined = cut_up.join(rest, "cell")
    if hot.limit(1).count():
        joined = cut_up.join(F.broadcast(hot.select("cell")), "cell", "left_anti").join(rest, "cell").unionByName(cut_up.join(F.broadcast(hot), "cell"))
    by_vector = joined.groupBy("nth").agg(F.array_sort(F.collect_list(F.struct("position", "entry"))).alias("codes"), F.sum("off").alias("error"))
    text = F.array_join(F.transform("codes", lambda x: F.lower(F.lpad(F.hex(x["entry"]), 2, "0"))), "")
    out = work.write(kept.select("nth", "vec_id", F.struct("label").alias("of")).join(by_vector, "nth").select("vec_id", "of", text.alias("code"), "error"), "codes")
    totals = out.groupBy("of").agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return left_join_hot(out, totals, "of").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _assignment(n: int) -> str:
    """SQL of the assignment to codebook n."""
    return f"""
a{n} AS (
  SELECT nth, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT x.nth, x.p, x.v, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cut x JOIN b{n} b USING (p))
  GROUP BY nth, p, v)"""


def _book(n: int) -> str:
    """SQL of codebook n, from the assignment before."""
    return f"""
m{n} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, e, i, floor(sum(v[i]) / count(*))::BIGINT AS m FROM a{n - 1}, (SELECT unnest(range(1, 5)) AS i) GROUP BY p, e, i) GROUP BY p, e),
b{n} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{n - 1} b LEFT JOIN m{n} m USING (p, e))"""


ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS nth, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT nth, p, v[(4 * p + 1):(4 * p + 4)] AS v FROM kept, (SELECT unnest(range(16)) AS p)),
b0 AS (SELECT p, nth AS e, v FROM cut WHERE nth < 64),{_assignment(0)},{_book(1)},{_assignment(1)},{_book(2)},{_assignment(2)},
coded AS (SELECT nth, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY nth),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (nth), digest
"""
