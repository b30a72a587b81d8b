"""Which keys occur more than once: the exchange that two operators share.

Map tasks send, per block of the key space, the keys of many documents in one
row of binary columns; a block's task counts them and answers each document
with the positions whose key occurs at least twice. Keys that repeat within
one sender are sent once and answered there, so a key that holds a third of
all rows reaches its block once per sender, not once per row.

Two ways to count: ``count_min`` takes 32-bit codes and merges them in a
count-min sketch, which can only overestimate; ``exact`` takes 96 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64, U32 = np.uint64, np.uint32
SENT = "sender long, block int, hi binary, lo binary, pos binary, doc binary, each binary, mute_hi binary, mute_lo binary"
REPLY = "sender long, pos binary, doc binary, each binary"
ANSWER = "k1 long, k2 long, pos binary"
#: Keys that a task gathers before it sends rows, at least and at most: with many blocks more, so that a row still holds several keys.
FLUSH, FLUSH_MOST = 1 << 20, 1 << 22


def blocks_for(n_keys: int, partitions: int) -> int:
    """As many blocks as shuffle partitions, or as it takes to keep a block within 4 million keys; beyond 4,096 blocks they grow, to 16 million keys at most."""
    per_block = min(1 << 24, max(1 << 22, n_keys >> 12))
    return max(1, partitions, -(-n_keys // per_block))


class Sender:
    """Gathers (document, position, key) and packs them by block."""

    def __init__(self, blocks: int, exact: bool, least: int = FLUSH):
        self.blocks, self.exact = blocks, exact
        task = TaskContext.get()
        self.name = (task.partitionId() if task else 0) << 32
        self.parts: list[tuple] = []
        self.n, self.full = 0, min(FLUSH_MOST, max(least, 16 * blocks))

    def add(self, k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, pos: np.ndarray, key: np.ndarray, low: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """k1, k2: keys of documents; doc: index into them, for each pos and key, ascending."""
        self.parts.append((k1, k2, doc, pos.astype(U32), key, low))
        self.n += len(pos)
        if self.n >= self.full:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            self.parts = []
            return
        shift = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        k1, k2 = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        doc = np.concatenate([p[2] + s for p, s in zip(self.parts, shift, strict=False)])
        pos, key = (np.concatenate([p[i] for p in self.parts]) for i in (3, 4))
        low = np.concatenate([p[5] for p in self.parts]) if self.exact else None
        self.parts, self.n = [], 0
        block = ((key >> U64(32)) * U64(self.blocks) >> U64(32)).astype(np.int32)
        hi = key if self.exact else key.astype(U32)
        order = np.lexsort((low, key)) if self.exact else np.lexsort((hi, block))
        same = (hi[order][1:] == hi[order][:-1]) & (block[order][1:] == block[order][:-1])
        if self.exact:
            same &= low[order][1:] == low[order][:-1]
        known = np.zeros(len(key), bool)
        known[order[1:][same]] = True
        known[order[:-1][same]] = True
        lead = np.zeros(len(key), bool)  # one of each key that repeats here
        lead[order[:-1][same & ~np.concatenate([[False], same[:-1]])]] = True
        by_block = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[by_block], np.arange(self.blocks + 1))
        rows: list[tuple] = []
        for b in range(self.blocks):
            i = by_block[edges[b] : edges[b + 1]]
            if not len(i):
                continue
            ask, mute, done = i[~known[i]], i[lead[i]], i[known[i]]
            rows.append((b, hi[ask], low[ask] if self.exact else None, pos[ask], *self._docs(doc[ask], k1, k2), hi[mute], low[mute] if self.exact else None))
            if len(done):
                rows.append((b, hi[:0], low[:0] if self.exact else None, pos[done], *self._docs(doc[done], k1, k2), hi[:0], low[:0] if self.exact else None))
            if len(rows) >= 256:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)
        self.name += 1

    @staticmethod
    def _docs(doc: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents in order and the number of entries of each."""
        cut = np.flatnonzero(np.diff(doc, prepend=-1))
        own = doc[cut]
        return np.stack([k1[own], k2[own]], 1), np.diff(np.append(cut, len(doc))).astype(U32)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        names = ["sender", "block", "hi", "lo", "pos", "doc", "each", "mute_hi", "mute_lo"]
        columns = [pa.array([self.name] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32())]
        columns += [pa.array([None if r[i] is None else r[i].tobytes() for r in rows], pa.binary()) for i in range(1, 8)]
        return pa.RecordBatch.from_arrays(columns, names)


def sent_by(documents: DataFrame, produce: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], blocks: int, exact: bool, least: int = FLUSH) -> DataFrame:
    """produce yields (k1, k2, doc, pos, key, low) for slices of documents. least: keys that a task gathers at least before it sends rows."""

    def run(batches):
        sender = Sender(blocks, exact, least)
        for part in produce(batches):
            yield from sender.add(*part)
        yield from sender.flush()
        pa.default_memory_pool().release_unused()  # the worker waits for other tasks, of this step and later ones

    return documents.mapInArrow(run, SENT)


def seen_twice(hi: np.ndarray, lo: np.ndarray, asked: int, exact: bool) -> np.ndarray:
    """For the first ``asked`` keys, whether a key occurs twice in all; later keys count as two."""
    if exact:
        order = np.lexsort((lo, hi))
        same = (hi[order][1:] == hi[order][:-1]) & (lo[order][1:] == lo[order][:-1])
        twice = np.zeros(len(hi), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        return twice[:asked]
    width = max(10, int(np.ceil(np.log2(max(1, 4 * len(hi))))))
    nth = np.arange(len(hi), dtype=U32)
    twice = np.ones(asked, bool)
    for odd in (1, 0x9E3779B1):  # the rows of the sketch, whose counts end at two: a key that isn't the last of its cell is one of two
        cell = (hi * U32(odd)) >> U32(32 - width)
        last = np.zeros(1 << width, U32)
        last[cell] = nth
        more = np.zeros(1 << width, bool)
        more[cell[last[cell] != nth]] = True
        more[cell[asked:]] = True
        twice &= more[cell[:asked]]
    return twice


def answers(sent: DataFrame, exact: bool) -> DataFrame:
    """Per document, the positions whose keys occur at least twice. Blocks answer senders, one row for each that they got, and a sender's answers are then parted by document: rows grow with the documents, not with documents times blocks."""
    key_type = U64 if exact else U32

    def count(group: pd.DataFrame) -> pd.DataFrame:
        def joined(name, kind):
            return np.frombuffer(b"".join(x for x in group[name] if x is not None), kind)

        hi, pos, docs, each = joined("hi", key_type), joined("pos", U32), joined("doc", np.int64).reshape(-1, 2), joined("each", U32)
        lo, mute_lo = (joined("lo", U32), joined("mute_lo", U32)) if exact else (None, None)
        mute = joined("mute_hi", key_type)
        entries = group["pos"].map(len).to_numpy() // 4
        asks = np.repeat(group["hi"].map(len).to_numpy() > 0, entries)
        flag = np.ones(len(pos), bool)
        if exact:
            flag[asks] = seen_twice(np.concatenate([hi, mute]), np.concatenate([lo, mute_lo]), len(hi), True)
        else:
            flag[asks] = seen_twice(np.concatenate([hi, mute]), None, len(hi), False)
        doc = np.repeat(np.arange(len(docs)), each)[flag]
        pos = pos[flag]
        ends = np.concatenate([[0], np.cumsum(np.add.reduceat(np.append(flag, False).astype(np.int64), np.cumsum(entries) - entries) * (entries > 0))]) if len(entries) else np.zeros(1, np.int64)
        out = []
        for sender, a, b in zip(group["sender"], ends[:-1], ends[1:], strict=True):
            if b > a:
                cut = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
                out.append((sender, pos[a:b].tobytes(), docs[doc[a:b][cut]].tobytes(), np.diff(np.append(cut, b - a)).astype(U32).tobytes()))
        return pd.DataFrame(out, columns=["sender", "pos", "doc", "each"])

    def part(group: pd.DataFrame) -> pd.DataFrame:
        pos, docs, each = (np.frombuffer(b"".join(group[n]), t) for n, t in (("pos", U32), ("doc", np.int64), ("each", U32)))
        own = np.repeat(docs.reshape(-1, 2), each, axis=0)
        order = np.lexsort((pos, own[:, 1], own[:, 0]))
        own, pos = own[order], pos[order]
        cut = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)]))
        return pd.DataFrame({"k1": own[cut, 0], "k2": own[cut, 1], "pos": [pos[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(pos)), strict=True)]})

    return sent.groupBy("block").applyInPandas(count, REPLY).groupBy("sender").applyInPandas(part, ANSWER)


def by_document(answered: DataFrame) -> DataFrame:
    """All positions of a document: k1, k2 and parts, a list of different arrays of uint32 as bytes. Equal rows are answered alike, so however often a row repeats its list stays short."""
    return answered.groupBy("k1", "k2").agg(F.collect_set("pos").alias("parts"))
