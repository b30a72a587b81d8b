"""Quality rules combined by weak supervision.

Each rule votes good (1), bad (0) or abstains (-1) on a document's statistics.
Expectation-maximisation over the counts of vote patterns of *all* documents
estimates how often each rule gives each vote on good and on bad documents;
the posterior of "good" given a document's pattern replaces all-must-pass.
There are at most 3^9 patterns, whatever the input, so their counts are the
only thing that reaches the driver, and the table of posteriors the only thing
that is broadcast.

Defined cases: a null or empty text has no words and fails the base rules;
equal rows, and documents of one vote pattern, get equal verdicts; very long texts are
counted whole, in one row; an empty table gives an empty result; other columns are
ignored, whatever their names (``keep_good`` keeps them all).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import SMALL, slices, windows
from .storage import SMALL_BATCH, Workspace

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: rule: (bad where, good where) on the statistics s of a document.
RULES = {
    "marked": (lambda s: s.marked > 0.2 * s.words, lambda s: s.marked <= 0.03 * s.words),
    "letters": (lambda s: s.letters < 0.75 * s.bytes, lambda s: s.letters >= 0.85 * s.bytes),
    "symbols": (lambda s: s.symbols > 0.1 * s.words, lambda s: s.symbols <= 0.01 * s.words),
    "repetition": (lambda s: s.repeats > 0.3 * s.words, lambda s: s.repeats <= 0.1 * s.words),
    "lines": (lambda s: s.dup_lines > 0.5 * s.lines, lambda s: s.dup_lines <= 0.1 * s.lines),
    "capitals": (lambda s: s.capitals > 0.5 * s.words, lambda s: s.capitals <= 0.2 * s.words),
    "word_length": (lambda s: (s.chars < 2.5 * s.words) | (s.chars > 12 * s.words), lambda s: (s.chars >= 3 * s.words) & (s.chars <= 10 * s.words)),
    "variety": (lambda s: s.distinct < 2 * np.sqrt(s.words), lambda s: s.distinct > 5 * np.sqrt(s.words)),
    "stutter": (lambda s: s.stutter > 0.2 * s.words, lambda s: s.stutter <= 0.03 * s.words),
}


class Statistics(NamedTuple):
    words: np.ndarray
    chars: np.ndarray
    symbols: np.ndarray
    lines: np.ndarray
    dup_lines: np.ndarray
    repeats: np.ndarray
    capitals: np.ndarray
    distinct: np.ndarray
    stutter: np.ndarray
    marked: np.ndarray
    letters: np.ndarray
    bytes: np.ndarray


def _per_document(flag: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def _seen(key: np.ndarray, doc: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a valid key occurs twice in its document, and whether it is one of the first."""
    at = np.flatnonzero(valid)
    order = at[np.lexsort((key[at], doc[at]))]
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice, new = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    new[order[np.concatenate([np.ones(min(1, len(order)), bool), ~same])]] = True
    return twice, new


def _lines(text: bytes | None) -> tuple[int, int]:
    seen, n, again = set(), 0, 0
    for line in (text or b"").split(b"\n"):
        if line.strip():
            n += 1
            again += line in seen
            seen.add(line)
    return n, again


def statistics(batch, words, text_col: str) -> Statistics:
    data, first, n = words.data, words.first, len(words.starts)
    h, doc = words.hashes(), words.document()
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, words.starts, 1)
    np.add.at(inside, words.ends, -1)
    lead = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)
    letters = np.concatenate([[0], np.cumsum(lead)])
    chars = letters[words.ends] - letters[words.starts]
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    lower = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    capital = (upper[words.ends] - upper[words.starts] >= 2) & (lower[words.ends] == lower[words.starts])
    g, whole = windows(h, first, 3)
    twice, _ = _seen(g, doc, whole)
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    _, new = _seen(h, doc, np.ones(n, bool))
    stutter = np.zeros(n, bool)
    stutter[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    marks = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    marked = marks[words.ends] > marks[words.starts]
    letter = upper + lower + np.concatenate([[0], np.cumsum(data >= 128)])
    texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
    lines = np.array([_lines(t) for t in texts], np.int64).reshape(-1, 2)
    ends = np.concatenate([[0], np.cumsum([len(t or b"") for t in texts])])
    return Statistics(np.diff(first), _per_document(chars, first), _per_document(SYMBOL[data], ends), lines[:, 0], lines[:, 1], _per_document(covered, first), _per_document(capital, first), _per_document(new, first), _per_document(stutter, first), _per_document(marked, first), _per_document(letter[words.ends] - letter[words.starts], first), _per_document(words.ends - words.starts, first))


def votes(s: Statistics) -> np.ndarray:
    """documents x rules of 1, 0 and -1; documents without words are bad everywhere."""
    out = np.stack([np.where(bad(s), 0, np.where(good(s), 1, -1)) for bad, good in RULES.values()], 1)
    out[s.words == 0] = 0
    return out


def _features(text_col: str, carry: list[str]):
    def run(batches):
        for batch, words in slices(batches, text_col, SMALL):
            s = statistics(batch, words, text_col)
            pattern = ["".join("0?1"[x and (1 if x < 0 else 2)] for x in row) for row in votes(s).tolist()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in carry]
            columns += [pa.array(x, pa.int64()) for x in (s.words, s.chars, s.symbols, s.dup_lines, s.repeats)] + [pa.array(pattern, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*carry, *COUNTS, "votes"])

    return run


def features(documents: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    types = dict(documents.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carry), *(f"{c} long" for c in COUNTS), "votes string"])
    return documents.select(*dict.fromkeys([*carry, text_col])).mapInArrow(_features(text_col, carry), schema)


def fit(patterns: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """The posterior of "good" of each pattern, by expectation-maximisation over pattern counts.

    Rules begin as better than chance: a bad vote tells much, as a bad document
    passes most rules. And a rule's good votes are kept from
    being likelier on bad documents than on good ones (and so for bad votes),
    which fixes which class is which.
    """
    if not patterns:
        return {}
    code = np.array([["0?1".index(c) for c in p] for p in patterns])
    weight = np.array([float(n) for n in patterns.values()])
    n_rules = code.shape[1]
    p = np.tile(np.array([[[0.3, 0.2, 0.5]], [[0.02, 0.1, 0.88]]]), (1, n_rules, 1))  # class, rule, vote
    prior = 0.8
    good = np.zeros(len(code))
    for _ in range(rounds):
        log = np.log(p[:, np.arange(n_rules), code]).sum(2) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done, good = np.abs(new - good).max() < 1e-9, new
        prior = float(np.clip((weight @ good + 8) / (weight.sum() + 10), 0.05, 0.95))
        for y, r in ((0, weight * (1 - good)), (1, weight * good)):
            for v in range(3):
                p[y, :, v] = (r @ (code == v) + 1) / (r.sum() + 3)
        for v, y in ((0, 0), (2, 1)):
            p[1 - y, :, v] = np.minimum(p[1 - y, :, v], p[y, :, v])
        p = np.clip(p / p.sum(2, keepdims=True), 1e-3, 1)
        if done:
            break
    return dict(zip(patterns, good.tolist(), strict=True))


def judged(features_of: DataFrame, posterior: DataFrame) -> DataFrame:
    n, r = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < 50) | (100 * r > 50 * n)
    return features_of.join(F.broadcast(posterior), "votes", "left").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality_posterior") >= 0.5))


def posteriors(features_of: DataFrame) -> DataFrame:
    """votes, quality_posterior: at most 3^9 rows."""
    spark = features_of.sparkSession
    counts = {r["votes"]: r["count"] for r in features_of.groupBy("votes").count().collect()}
    return spark.createDataFrame(sorted(fit(dict(sorted(counts.items()))).items()), "votes string, quality_posterior double")


def score_quality(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the counts, votes, quality_posterior, base_failed and kept."""
    work = Workspace(documents.sparkSession, "quality-rules")
    table = work.write(features(documents, text_col, [id_col]).withColumnRenamed(id_col, "doc_id"), "features", SMALL_BATCH)
    return judged(table, posteriors(table))


def keep_good(documents: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents that the verdict keeps, with their own columns. They are written beside their votes, so texts are read and counted once."""
    own = documents.columns
    renamed = documents.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)))
    work = Workspace(documents.sparkSession, "quality-rules")
    table = work.write(features(renamed, f"c{own.index(text_col)}", renamed.columns), "features", SMALL_BATCH)
    return judged(table, posteriors(table)).where("kept").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own)))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *COUNTS, "base_failed", "kept", "quality_posterior")
