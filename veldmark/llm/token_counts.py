"""Token counts by section: whole documents are encoded once, tokens are mapped to sections by offset.

A document is encoded in one piece, as the model will see it. Tokens are then
spans of bytes, sections are spans too, and an interval join (both are in
order, so a merge) allots tokens to sections. A token that crosses a boundary
goes by ``rule``: "most" (the section with most of its bytes, ties to the
earlier), "start" or "end" (the section of its first or last byte). Counts of
a document's sections add up to its tokens under any rule.

Sections are what ``splitter`` matches end: by default lines, each with its
line feed. ``count_field_tokens`` takes columns of a document for sections. Positions are
given in code points. Rows of one task are
independent; a lost task is computed anew.

Defined cases: a null or empty text has one empty section without tokens;
equal rows are counted each; special tokens in a text are ordinary text;
other columns are ignored; an empty table gives an empty result. A document
of any length is encoded whole, in the memory of one task.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# A fixed value: how the public byte-level vocabulary parts a text before it merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
RULES = ("most", "start", "end")
_encoders: dict[int, tuple] = {}


def _encoder(vocabulary: bytes):
    """The encoder and the length in bytes of each token, once a worker."""
    import tiktoken

    name = hash(vocabulary)
    if name not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encoders[name] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[name]


def allot(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether the token crosses a boundary. bounds: 0, the ends of sections."""
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends, side="left") - 1
    crosses = last > first
    if rule == "start":
        return first, crosses
    if rule == "end":
        return last, crosses
    out = first.copy()
    for i in np.flatnonzero(crosses):  # few
        edges = np.clip(bounds[first[i] : last[i] + 2], starts[i], ends[i])
        out[i] = first[i] + int(np.argmax(np.diff(edges)))
    return out, crosses


def _by_line(splitter: bytes):
    """The text of a row and the ends of its sections in bytes, without the last: behind each of the splitter's characters."""

    def cut(row: tuple) -> tuple[str, np.ndarray]:
        text = row[0] or ""
        return text, np.flatnonzero(np.isin(np.frombuffer(text.encode(), np.uint8), list(splitter))) + 1

    return cut


def _by_field(joiner: str):
    """The fields of a row as one text; what joins two of them belongs to the first."""

    def cut(row: tuple) -> tuple[str, np.ndarray]:
        parts = [(x or "") + joiner for x in row[:-1]] + [row[-1] or ""]
        return "".join(parts), np.cumsum([len(p.encode()) for p in parts])[:-1]

    return cut


def _count(vocabulary: bytes, rule: str, cut, columns: int, keep_empty: bool):
    names = [f"text{i}" for i in range(columns)]

    def run(batches):
        encoder, lengths = _encoder(vocabulary)
        for batch in batches:
            rows, docs = [], []
            for d, row in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                text, cuts = cut(row)
                data = np.frombuffer(text.encode(), np.uint8)
                ends = np.cumsum(lengths[np.asarray(encoder.encode_ordinary(text), np.int64)])
                starts = ends - np.diff(ends, prepend=0)
                bounds = np.concatenate([[0], cuts, [len(data)]])
                if not keep_empty:
                    bounds = np.unique(bounds) if len(data) else np.zeros(2, np.int64)
                n = len(bounds) - 1
                at, crosses = allot(starts, ends, bounds, rule)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
                docs += [d] * n
                rows.append((np.arange(n), points[:-1], points[1:], np.bincount(at, minlength=n), np.bincount(at[crosses], minlength=n), np.full(n, len(ends))))
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(docs, pa.int64())), *(pa.array(c) for c in columns)], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    return run


def _counted(documents: DataFrame, id_col: str, texts: list[str], vocabulary: str, rule: str, cut, keep_empty: bool) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(vocabulary, "rb") as f:  # under 1 MB, read where the query is planned
        ranks = f.read()
    rows = documents.select(F.col(id_col).alias("doc_id"), *(F.col(c).alias(f"text{i}") for i, c in enumerate(texts)))
    return rows.mapInArrow(_count(ranks, rule, cut, len(texts), keep_empty), f"doc_id {dict(rows.dtypes)['doc_id']}, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long")


def count_tokens(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, rule: str = "most", splitter: str = "\n") -> DataFrame:
    """One row per section: doc_id, section, start, end (code points), n_tokens, n_crossing (of these, tokens that cross a boundary) and doc_tokens (of the whole document). splitter: ASCII characters of which each ends a section."""
    return _counted(documents, id_col, [text_col], vocabulary, rule, _by_line(splitter.encode("ascii")), False)


def count_field_tokens(documents: DataFrame, fields: list[str], *, id_col: str = "doc_id", vocabulary: str = VOCABULARY, rule: str = "most", joiner: str = "\n") -> DataFrame:
    """One row per document and field (``field``; also for null and empty ones) with the columns of count_tokens. Fields are encoded as one text, as a model will see them; the joiner between two counts for the first."""
    rows = _counted(documents, id_col, fields, vocabulary, rule, _by_field(joiner), True)
    return rows.withColumn("field", F.get(F.array(*map(F.lit, fields)), F.col("section").cast("int")))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
