"""Exact nearest neighbours of a stated query set by a block matrix join.

Queries and candidates are dealt into blocks, and each pair of a query block and a
candidate block is one group of a cogroup. In it vectors become int8 codes with a scale
each; tiles of code products give distances between the decoded vectors, and by the triangle
inequality the true distance differs by no more than the two rounding errors. A
query's k-th least upper bound and the worst of its heap tell which pairs can still be among the k nearest;
these are worked out again in double precision and pushed on the query's heap. Heaps
of different candidate blocks are merged by query. No index is fitted and nothing is cut, so recall is 1.

Products of int8 codes are summed in float32 blocks of at most 1,024 components, where integers below 2^24
are exact. Memory of a group is bounded by ``query_block``, ``slice_rows`` and the tile.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do rows without an id; vectors meet those of their own length only; rows with the query's id are
the query's own; where a query id repeats, its least vector counts; other repeated rows count each; ties go to the
smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace

TILE_QUERIES, TILE_ROWS = 1024, 4096
#: Pairs that are recomputed at once.
PAIRS = 1 << 16
FOUND = "query_id bigint, vec_id bigint, score double"


def finite(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


class Codes:
    """Vectors as int8 codes: decoded is scale * code; off bounds how far a vector is from its decoded one."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float64)
        most = np.abs(self.vectors).max(axis=1)
        self.scale = np.where(most > 0, most, 1.0) / 127
        codes = np.rint(self.vectors / self.scale[:, None])
        decoded = codes * self.scale[:, None]
        self.off = np.sqrt(((self.vectors - decoded) ** 2).sum(axis=1))
        self.norm = np.sqrt((decoded**2).sum(axis=1))
        self.codes = codes.astype(np.int8)


def _bounds(q: Codes, c: Codes, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
    """Distances of a tile's decoded vectors, and how far they may be off the true ones."""
    product = np.zeros((a.stop - a.start, b.stop - b.start))
    for k in range(0, q.codes.shape[1], 1024):
        product += q.codes[a, k : k + 1024].astype(np.float32) @ c.codes[b, k : k + 1024].astype(np.float32).T
    product *= q.scale[a, None] * c.scale[None, b]
    squares = q.norm[a, None] ** 2 + c.norm[None, b] ** 2
    near = np.sqrt(np.maximum(squares - 2 * product, 0))
    # cancellation: a relative error of 1e-14 in squares is one of at most 1e-7 of the norms in the root
    return near, q.off[a, None] + c.off[None, b] + 1e-6 * np.sqrt(squares)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of pairs, summed component after component."""
    return np.sqrt(np.cumsum((q - c) ** 2, axis=1)[:, -1])


def _first_of_each(group: np.ndarray, k: int) -> np.ndarray:
    """Which of rows sorted by group are among its first k."""
    new = np.r_[True, group[1:] != group[:-1]]
    return np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0)) < k


def nearest_in_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a query block and a candidate block: query ids, candidate ids and distances of each query's k nearest."""
    q, c = Codes(queries), Codes(vectors)
    heaps: list[list] = [[] for _ in query_ids]
    worst = np.full(len(query_ids), np.inf)  # the k-th distance so far
    for at in range(0, len(ids), TILE_ROWS):
        b = slice(at, min(at + TILE_ROWS, len(ids)))
        for top in range(0, len(query_ids), TILE_QUERIES):
            a = slice(top, min(top + TILE_QUERIES, len(query_ids)))
            near, off = _bounds(q, c, a, b)
            own = query_ids[a, None] == ids[None, b]
            near[own] = np.inf
            limit = worst[a]
            if near.shape[1] > k:
                limit = np.minimum(limit, np.partition(near + off, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero((near - off <= limit[:, None]) & ~own)
            for x in range(0, len(i), PAIRS):
                qi, cj = i[x : x + PAIRS] + top, j[x : x + PAIRS] + at
                d = _exact(q.vectors[qi], c.vectors[cj])
                order = np.lexsort((ids[cj], d, qi))
                order = order[_first_of_each(qi[order], k)]
                for n, away, name in zip(qi[order].tolist(), d[order].tolist(), ids[cj[order]].tolist()):
                    item = (-away, -name)
                    if len(heaps[n]) < k:
                        heapq.heappush(heaps[n], item)
                    elif item > heaps[n][0]:
                        heapq.heapreplace(heaps[n], item)
                    if len(heaps[n]) == k:
                        worst[n] = -heaps[n][0][0]
    size = [len(h) for h in heaps]
    flat = [x for h in heaps for x in h]
    return np.repeat(query_ids, size), np.array([-n for _, n in flat], np.int64), np.array([-d for d, _ in flat], np.float64)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").combine_chunks().to_numpy()
    values = table.column("vector").combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    return ids, values.flatten().to_numpy().reshape(len(ids), -1)


def neighbours(embeddings: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, query_block: int = 16_384, slice_rows: int = 131_072, least_rows: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest rows of each row for which is_query holds."""
    spark = embeddings.sparkSession
    work = Workspace(spark, "nearest-neighbours")
    vector = F.col(vector_col)
    fit = finite(vector) & F.exists(vector, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = embeddings.where(fit).select(F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("vector"), F.size(vector).alias("width"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("nth"))
    rows = work.write(rows, "vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("asks")).head()
    n_slices = max(1, -(-n // slice_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // least_rows)))
    n_blocks = max(1, -(-n_queries // query_block))
    queries = rows.where("asks").groupBy("vec_id").agg(F.min_by(F.struct("vector", "width"), F.struct("vector", "nth")).alias("q")).select("vec_id", "q.vector", "q.width")
    # every query block meets every slice of the candidates: blocks travel, not pairs
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
    # columns of its own: both sides of a cogroup that share columns lose one of them
    candidates = rows.select(*(F.col(c).alias(c) for c in ("vec_id", "vector", "width")), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.pmod(F.xxhash64("nth"), F.lit(n_slices)).cast("int").alias("slice"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            found = nearest_in_block(*_matrix(left), *_matrix(right), k)
        else:
            found = [np.zeros(0, t) for t in (np.int64, np.int64, np.float64)]
        return pa.table([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    key = ["width", "block", "slice"]
    found = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(meet, FOUND)

    def merge(table: pa.Table) -> pa.Table:
        best = heapq.nsmallest(k, zip(table.column("score").to_pylist(), table.column("vec_id").to_pylist()))
        query = table.column("query_id")[0].as_py()
        return pa.table([pa.array([query] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([x for _, x in best], pa.int64()), pa.array([d for d, _ in best], pa.float64())], ["query_id", "rank", "vec_id", "score"])

    return found.groupBy("query_id").applyInArrow(merge, "query_id bigint, rank int, vec_id bigint, score double")


def op12_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


#: The sum goes component after component, as the operator's does, for equal last digits.
ORACLE = """
WITH kept AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score FROM kept q JOIN kept c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 10
"""
