"""Packing of token sequences by multiway differencing (Karmarkar-Karp).

Each document's ids, ended by a separator id, are cut into pieces. Whole windows come off the
front; what remains is cut into pieces of at most ``piece`` ids. Pieces are gathered in blocks
of about ``block_windows`` windows, and each block is parted into k near-equal windows: two
partial partitions with the largest imbalance are merged again and again, the fullest windows
of one with the emptiest of the other. If a window then exceeds the capacity, k rises and the
block is parted anew. Nothing is shuffled: a block never leaves its partition, and memory is
bounded by one block.

Defined results: null and empty texts are the separator alone; repeated rows are documents of
their own; every id lies in exactly one piece; windows aren't shared between partitions; an
empty table gives no piece; columns other than the id and the text take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, slices
from .common import give_back

PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
    """k windows of the items, fullest first: their sums and their items.

    A partial partition holds the sums of its windows in falling order (windows beyond the
    last one are still empty); its imbalance is the fullest less the emptiest window.
    """
    heap = [(-int(s), i, np.array([s]), [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    born = len(heap)
    while len(heap) > 1:
        _, _, sums, groups = heapq.heappop(heap)
        _, _, others, more = heapq.heappop(heap)
        empty = k - len(sums)
        if (met := len(others) - empty) > 0:
            keep = len(sums) - met
            sums = np.concatenate([sums[:keep], sums[keep:] + others[empty:][::-1], others[:empty]])
            groups = groups[:keep] + [g + h for g, h in zip(groups[keep:], more[empty:][::-1], strict=True)] + more[:empty]
        else:
            sums, groups = np.concatenate([sums, others]), groups + more
        order = np.argsort(-sums, kind="stable")
        sums, groups = sums[order], [groups[i] for i in order.tolist()]
        imbalance = int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)
        heapq.heappush(heap, (-imbalance, born, sums, groups))
        born += 1
    return (heap[0][2], heap[0][3]) if heap else (np.zeros(0, np.int64), [])


def windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Few near-equal windows within the capacity; their number rises until none exceeds it."""
    total = int(sizes.sum())
    k = max(1, -(-(total + total // 400) // capacity)) if len(sizes) else 0
    while len(sizes):
        sums, groups = difference(sizes, k)
        if sums[0] <= capacity:
            return groups
        k += max(1, -(-int(np.maximum(sums - capacity, 0).sum()) // capacity))
    return []


class _Block:
    """Pieces that wait to be parted, and what is known of them."""

    def __init__(self, capacity: int, piece: int):
        self.capacity, self.piece, self.clear = capacity, piece, None
        self.rows: list[tuple] = []
        self.total = self.next = 0

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        n, at = len(ids) // 4, 0
        while n - at >= self.capacity:
            yield doc, at, self.capacity, ids[4 * at : 4 * (at + self.capacity)], n, self.next, 0
            at, self.next = at + self.capacity, self.next + 1
        while at < n:
            size = min(self.piece, n - at)
            self.rows.append((doc, at, size, ids[4 * at : 4 * (at + size)], n))
            self.total += size
            at += size

    def part(self) -> Iterator[tuple]:
        for group in windows(np.array([r[2] for r in self.rows], np.int64), self.capacity):
            offset = 0
            for i in sorted(group):
                yield *self.rows[i], self.next, offset
                offset += self.rows[i][2]
            self.next += 1
        self.rows, self.total = [], 0


def pack(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, piece: int = 512, end_id: int = 1, block_windows: int = 384, words_kept: int = 800_000) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``words_kept`` bounds the encoder's table of words in each Python worker, about 200 bytes each.
    """
    kind = dict(df.dtypes)[id_col]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, block = encoder(path), _Block(capacity, piece)
        enc.keep = words_kept
        first, id_type = TaskContext.get().partitionId() << 33, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, length, ids, n, seq, offset = zip(*rows, strict=True)
            longs = [pa.array(x, pa.int64()) for x in (start, length, n, [first + s for s in seq], offset)]
            return pa.RecordBatch.from_arrays([pa.array(doc, id_type), *longs[:2], pa.array(ids, pa.binary()), *longs[2:]], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for whole in batches:
            id_type = whole.schema.field(0).type
            for part, texts in slices(whole, "text"):
                out = []
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(texts, False)[0], strict=True):
                    out += block.add(doc, ids + end)
                    if block.total >= block_windows * capacity:
                        out += block.part()
                if out:
                    yield batch(out)
        if out := list(block.part()):
            yield batch(out)

    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(give_back(run), f"doc_id {kind}, {PIECES}")
