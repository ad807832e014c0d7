"""Order-preserving packing of token streams into windows by dynamic programming.

Documents keep the order in which a task reads them. The stream of their ids may be
cut after documents and after sentences; a window is at most SIZE ids. The cuts
minimise padding (none where a window is full or as long as a power of two) plus a
penalty per cut inside a document. The best predecessor of a cut is the minimum of
cost plus position over the cuts within SIZE before it, which a monotone queue gives
in constant time; the padding-free windows of power-of-two length are looked up.

Each task packs what it reads, in segments of bounded size: no shuffle, and a lost
executor costs the re-reading of its own splits.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegauge.runtime import ship
from notegauge.llm.tokens import encoder, vocabulary_path

SIZE = 2048
END = 1
#: Cost of a cut after a sentence, and of one inside a sentence, in ids of padding.
AT_SENTENCE, INSIDE = 4, 64
#: Ids that a task packs at a time; a longer document is one segment.
SEGMENT = 1 << 20
POWERS = [1 << k for k in range(10, 4, -1)]
SENTENCE_ENDS = (".", "!", "?", "...", ".\"", "!\"", "?\"", ".)")


def sentence_ids(tokenizer) -> np.ndarray:
    """The ids that close a sentence: what its closing marks end in when encoded by themselves."""
    return np.unique([tokenizer.encode(s, add_special_tokens=False).ids[-1] for s in SENTENCE_ENDS])


def boundaries(ids: np.ndarray, ends: np.ndarray, closing: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(position, penalty) of every allowed cut, ascending, 0 and the end included.

    Where no document or sentence ends within ``size`` ids, cuts inside are allowed
    at every multiple of the window from the last boundary, at a higher penalty.
    """
    table = np.zeros(1 + int(max(closing.max(), ids.max())), bool)
    table[closing] = True
    after = np.flatnonzero(table[ids]) + 1
    pos = np.unique(np.concatenate(([0], after, ends)))
    gaps = np.diff(pos)
    forced = [np.arange(pos[i] + size, pos[i + 1], size) for i in np.flatnonzero(gaps > size)]
    cost = np.where(np.isin(pos, ends) | (pos == 0), 0, AT_SENTENCE)
    if forced:
        extra = np.concatenate(forced)
        pos, cost = np.concatenate((pos, extra)), np.concatenate((cost, np.full(len(extra), INSIDE)))
        order = np.argsort(pos, kind="stable")
        pos, cost = pos[order], cost[order]
    return pos, cost


def best_cuts(pos: np.ndarray, cost: np.ndarray, size: int = SIZE) -> list[int]:
    """Positions of the cheapest cuts, 0 and the end included."""
    p, c = pos.tolist(), cost.tolist()
    n = len(p)
    best, back = [0] * n, [0] * n
    index = dict(zip(p, range(n)))
    queue: deque[tuple[int, int]] = deque([(p[0], 0)])  # (best + position, cut), rising
    powers = [x for x in POWERS if x < size]
    for j in range(1, n):
        at = p[j]
        while p[queue[0][1]] < at - size:
            queue.popleft()
        low, i = queue[0]
        value = low + size - at
        if value:  # a padding-free window of a power of two may do better
            for w in powers:
                k = index.get(at - w)
                if k is not None and best[k] < value:
                    value, i = best[k], k
        best[j] = value = value + c[j]
        back[j] = i
        key = value + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [p[-1]], n - 1
    while j:
        j = back[j]
        cuts.append(p[j])
    return cuts[::-1]


def windows(cuts: list[int], size: int = SIZE) -> list[int]:
    """The last window, if it is short, is cut into powers of two, which need no padding."""
    if len(cuts) < 2:
        return cuts
    start, end = cuts[-2], cuts[-1]
    rest, out = end - start, cuts[:-1]
    while rest:
        step = min(size, 1 << (rest.bit_length() - 1))
        start, rest = start + step, rest - step
        out.append(start)
    return out


class Packer:
    """Packs documents as they come; sequence ids count up from ``first``."""

    COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def __init__(self, closing: np.ndarray, first: int = 0, size: int = SIZE):
        self.closing, self.sequence, self.size = closing, first, size
        self.held: list[tuple[int | None, bytes]] = []
        self.length = 0

    def add(self, doc_id: int | None, data: bytes) -> bool:
        """True when a segment is full."""
        self.held.append((doc_id, data))
        self.length += len(data) >> 2
        return self.length >= SEGMENT

    def flush(self) -> list[tuple]:
        docs, self.held, self.length = self.held, [], 0
        if not docs:
            return []
        data = b"".join(d for _, d in docs)
        lengths = [len(d) >> 2 for _, d in docs]
        ends = np.cumsum(lengths)
        cuts = windows(best_cuts(*boundaries(np.frombuffer(data, "<u4"), ends, self.closing, self.size), self.size), self.size)
        out, w, begin = [], 0, 0
        for (doc_id, own), n, end in zip(docs, lengths, ends.tolist()):
            at = begin
            while at < end:
                while cuts[w + 1] <= at:
                    w += 1
                stop = min(end, cuts[w + 1])
                s = at - begin
                out.append((doc_id, s, stop - at, zlib.crc32(own[4 * s : 4 * (stop - begin)]), n, self.sequence + w, at - cuts[w]))
                at = stop
            begin = end
        self.sequence += len(cuts) - 1
        return out


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row's text, and the closing ``end``, lies in exactly one piece;
    null and empty texts are the closing id alone. Repeated rows are packed as often
    as they come. Sequence ids are unique; they tell nothing about other tasks' order.
    """
    ship(docs.sparkSession)
    path = path or vocabulary_path()
    closed = np.array([end], "<u4").tobytes()
    types = pa.schema([(c, pa.int64()) for c in Packer.COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        context = TaskContext.get()
        packer = Packer(sentence_ids(enc.tokenizer), (context.partitionId() if context else 0) << 32, size)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                coded = enc.encode([t or "" for t in b.column(1)[at : at + 256].to_pylist()])
                for doc_id, data in zip(b.column(0)[at : at + 256].to_pylist(), coded):
                    if packer.add(doc_id, data + closed):
                        yield _batch(packer.flush(), types)
        yield _batch(packer.flush(), types)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"`{c}` long" for c in Packer.COLUMNS))


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(types))], schema=types)
