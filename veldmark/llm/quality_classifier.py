"""A quality classifier: support vectors on Naive Bayes features.

Features are indicators of hashed n-grams: words, pairs of words, and up to
three word shapes in a row (case, digits, symbols, end punctuation, and
whether a word repeats the one before). Each is scaled by its class log-count
ratio, a document's vector is brought to unit length, and a linear hinge-loss
model is fitted by dual coordinate descent on the whole sample. A logistic curve
makes margins scores; it is told by a fifth of the sample, from a fit on the others.

The model is fitted on at most ``sample`` labelled rows (default 8,000, the
least by a hash of their id; documented bound), whose ids are broadcast, and
in one task, as a row of the sample is at most 2^18 indicators. Scoring
covers all documents and carries the model, 2^18 weights, in its closure.

Defined cases: a null or empty text has no features and scores as the bias
alone says; labels that are null, or disagree for one id, are left out; with
no labels of one class the score is the share of the other; equal rows score
alike; ids that repeat with other texts are learned from one of them, always the same;
very long texts are cut between batches, never inside, and count once per feature; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U64, mix, slices, windows

BITS = 18
DIMENSION = 1 << BITS


def _shapes(words, h) -> np.ndarray:
    """A small code of each word's looks."""
    data, s, e = words.data, words.starts, words.ends

    def has(of):
        total = np.concatenate([[0], np.cumsum(of)])
        return total[e] > total[s]

    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    doc = words.document()
    again = np.zeros(len(s), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    last = data[e - 1] if len(s) else data[:0]
    parts = (has(upper), has(lower), has((data >= 48) & (data <= 57)), has(data >= 128), has(np.isin(data, list(b"#*$%&|<>@_~^=+\\/{}[]"))), np.isin(last, list(b".!?")), np.isin(last, list(b",;:")), again)
    return sum(p.astype(U64) << U64(i) for i, p in enumerate(parts))


def indicators(words) -> tuple[np.ndarray, np.ndarray]:
    """Document and index of each distinct feature, by document."""
    h, doc = words.hashes(), words.document()
    shape = mix(_shapes(words, h), 20)
    keys, docs = [h, mix(shape, 21)], [doc, doc]
    for grams, k, salt in ((h, 2, 22), (shape, 2, 23), (shape, 3, 24)):
        g, whole = windows(grams, words.first, k, salt)
        keys.append(g[whole])
        docs.append(doc[whole])
    index = np.concatenate(keys) >> U64(64 - BITS)
    both = np.unique(np.concatenate(docs).astype(np.int64) << BITS | index.astype(np.int64))
    return both >> BITS, both & (DIMENSION - 1)


def _sample_rows(batches):
    for batch, words in slices(batches):
        doc, index = indicators(words)
        cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        rows = [index[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("label"), pa.array(rows, pa.binary())], ["name", "label", "features"])


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """Weights (the last one the bias's) of the hinge-loss model with L2 penalty: each step solves one dual variable, 0 <= alpha <= cost, exactly."""
    w, alpha, rng = np.zeros(DIMENSION + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    square = np.array([float(v @ v) for _, v in rows])
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            if not square[i]:
                continue
            slope = y[i] * (w[at] @ v) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-4:
            break
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve that tells labels from margins, by Newton steps on smoothed labels."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[s @ (margin * margin) + 1e-3, s @ margin], [s @ margin, s.sum() + 1e-3]])
        step = np.linalg.solve(hessian, np.array([g @ margin + 1e-3 * (a - 1), g.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("name", kind="stable")
    y = np.where(group["label"].to_numpy() > 0, 1.0, -1.0)
    features = [np.frombuffer(x, np.int32) for x in group["features"]]
    if (y > 0).all() or (y < 0).all():
        share = (np.array([(y > 0).sum()]) + 1) / (len(y) + 2)
        zeros = np.zeros(DIMENSION)
        return pd.DataFrame([(zeros.tobytes(), zeros.tobytes(), float(np.log(share / (1 - share))[0]), 1.0, 0.0)], columns=["ratio", "weight", "bias", "slope", "offset"])
    counts = np.ones((2, DIMENSION))
    for x, label in zip(features, y, strict=True):
        counts[int(label > 0), x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows = []
    for x in features:
        v = ratio[x]
        v = v / (np.sqrt(v @ v) or 1.0)
        rows.append((np.append(x, DIMENSION), np.append(v, 0.3)))
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    seen = np.arange(len(y)) % 5 != 0
    if min((y[seen] > 0).sum(), (y[seen] < 0).sum()) == 0:
        seen[:] = True
    part = dual_coordinate_descent([r for r, s in zip(rows, seen, strict=True) if s], y[seen], cost[seen], 30, 1)
    test = ~seen if (~seen).any() else seen
    margin = np.array([part[at] @ v for (at, v), s in zip(rows, test, strict=True) if s])
    slope, offset = _logistic(margin, y[test])
    # the curve is told by rows that its model did not see; the weights that score are of all rows
    full = dual_coordinate_descent(rows, y, cost, 30, 1)
    return pd.DataFrame([(ratio.tobytes(), full[:-1].tobytes(), float(full[-1] * 0.3), slope, offset)], columns=["ratio", "weight", "bias", "slope", "offset"])


def _score(model, threshold):
    ratio, weight = np.frombuffer(model["ratio"]), np.frombuffer(model["weight"])
    scaled, square = ratio * weight, ratio * ratio

    def run(batches):
        for batch, words in slices(batches):
            doc, index = indicators(words)
            n = batch.num_rows
            margin = np.bincount(doc, scaled[index], n) / np.sqrt(np.maximum(np.bincount(doc, square[index], n), 1e-12)) + model["bias"]
            score = 1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["offset"], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return run


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 8000) -> dict:
    """The model: class log-count ratios, weights, bias, and the curve of scores."""
    known = labels.select(F.col(id_col).alias("name"), F.col(label_col).alias("label")).where("name is not null and label is not null")
    known = known.groupBy("name").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    chosen = F.broadcast(known.orderBy(F.xxhash64("name"), "name").limit(sample))
    rows = documents.select(F.col(id_col).alias("name"), F.col(text_col).alias("text")).join(chosen, "name").select(F.col("name").cast("string").alias("name"), F.col("label").cast("int").alias("label"), "text")
    # ids that repeat in documents count once, so the bound holds; which of their texts does is the same in each run
    once = rows.mapInArrow(_sample_rows, "name string, label int, features binary").groupBy("name").agg(F.min(F.struct("label", "features")).alias("row")).select("name", "row.label", "row.features")
    found = once.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_fit, "ratio binary, weight binary, bias double, slope double, offset double").collect()
    if found:
        return found[0].asDict()
    zeros = np.zeros(DIMENSION).tobytes()
    return {"ratio": zeros, "weight": zeros, "bias": 0.0, "slope": 1.0, "offset": 0.0}


def held_out(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def score_documents(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 8000, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted. Labels are learned only from rows that are not held out."""
    model = fit(documents, labels.where(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    rows = documents.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model, threshold), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
