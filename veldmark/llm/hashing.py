"""Vectorised word and window hashes over the buffers of Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the
same as ``[^\\x20\\x09-\\x0D]+`` on characters. Hashes are 64 bits, polynomial
with an avalanche step after each level, so equal words (windows) have equal
hashes and unequal ones collide with probability about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """An avalanche of 64 bits (the finaliser of the public splitmix64 generator)."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE = mix(np.arange(256, dtype=U64))
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), U64(base))
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


BASE = 0x9FB21C651E98DF25
INVERSE = pow(BASE, -1, 1 << 64)


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[starts[i]:ends[i]] for each i, in one pass."""
    total = np.zeros(len(values) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(BASE, len(values)), out=total[1:])
        return (total[ends] - total[starts]) * powers(INVERSE, len(values) + 1)[starts]


class Words(NamedTuple):
    """Words of several documents one after another. first[d]:first[d+1] are those of document d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return mix(spans_hash(BYTE[data], self.starts, self.ends) + (self.ends - self.starts).astype(U64))

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(data: np.ndarray, offsets: np.ndarray, of_word: np.ndarray | None = None) -> Words:
    """Words of the texts data[offsets[d]:offsets[d+1]]; none crosses a document's end. of_word: which of the 256 bytes belong to words."""
    inside = ~SEPARATOR[data] if of_word is None else of_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


#: Bytes of text for steps that hold many arrays of a text's length at once: a worker keeps the memory of its largest slice while it waits for its next task.
SMALL = 1 << 19


def slices(batches, text: str = "text", limit: int = 2 << 20, of_word: np.ndarray | None = None) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Batches cut so that each has about ``limit`` bytes of text, or one document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), words_of(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], of_word)
            at = to


def windows(word_hash: np.ndarray, first: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they lie in one document."""
    n = len(word_hash)
    out, ok = np.zeros(n, U64), np.zeros(n, bool)
    if n < k:
        return out, ok
    m = n - k + 1
    start = np.arange(m)
    with np.errstate(over="ignore"):
        out[:m] = mix(spans_hash(mix(word_hash, salt) if salt else word_hash, start, start + k), salt + 1)
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(n)
    ok[:] = left >= k
    return out, ok


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """min(x[i:i+k]) for each i, by doubling."""
    have, out = 1, x
    while have * 2 <= k:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (k - have)], out[k - have :]) if k > have else out
