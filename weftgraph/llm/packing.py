"""Operator 10: fixed-length training sequences by best-fit decreasing.

Each document's ids (with an end id) are first cut into full windows; what remains, shorter than a window, goes by
descending length into the open window with the least room that still holds it. The open windows are counted in a
segment tree indexed by remaining capacity, so that each placement takes log2(window) steps.

Partitions pack on their own, in blocks of a bounded number of remainders: no shuffle, memory bounded by the block, and a
task that runs again gives the same rows. A sequence's number is the partition's number, 33 bits up, plus a running
number. Padding is at most one poorly filled end per block.

Defined results: null text is an empty text (its only id is the end id); rows are packed as they come, so repeated rows
and null or repeated doc_ids each get pieces of their own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import crc32, encoder


class OpenWindows:
    """Windows with room, in a segment tree over remaining capacity; a leaf's windows are a stack."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, which: int) -> None:
        self.at[room].append(which)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest window with at least so much room, and its room; it is taken out."""
        count, node = self.count, least + self.size
        while not count[node]:  # climb until a subtree to the right has a window
            while node & 1:
                node >>= 1
            if node <= 1:
                return None
            node += 1
            if node & (node - 1) == 0:  # past the last leaf of its level
                return None
        while node < self.size:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        which = self.at[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return which, room


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """For each length: its window and its offset there; and how many windows were opened."""
    where, offset, opened, windows = [0] * len(lengths), [0] * len(lengths), 0, OpenWindows(window)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        found = windows.take(n)
        if found is None:
            found, opened = (opened, window), opened + 1
        which, room = found
        where[k], offset[k] = which, window - room
        if room > n:
            windows.put(room - n, which)
    return where, offset, opened


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end: int = 0, block: int = 1 << 16, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if with_ids, ids."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        full: list[tuple] = []
        rest: list[tuple] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * (len(names) + 1)
            arrays = [pa.array(c, pa.int64()) for c in columns[: len(names)]]
            if with_ids:
                arrays.append(pa.array([x.tolist() for x in columns[len(names)]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        def placed() -> list[tuple]:
            nonlocal sequence, rest
            where, offset, opened = best_fit_decreasing([r[2] for r in rest], window)
            out = [(*r[:5], sequence + w, o, r[5]) for r, w, o in zip(rest, where, offset)]
            sequence, rest = sequence + opened, []
            return out

        for b in batches:
            ids, counts = encoder(tokenizer).encode([x or "" for x in b.column(1).to_pylist()], end)
            at = 0
            for doc, n in zip(b.column(0).to_pylist(), counts.tolist()):
                for start in range(0, n, window):
                    piece = ids[at + start : at + min(n, start + window)]
                    row = (doc, start, len(piece), crc32(piece), n)
                    if len(piece) == window:
                        full.append((*row, sequence, 0, piece if with_ids else None))
                        sequence += 1
                    else:
                        rest.append((*row, piece.copy() if with_ids else None))
                at += n
            if full:
                yield batch(full)
                full = []
            if len(rest) >= block:
                yield batch(placed())
        if rest:
            yield batch(placed())

    schema = ", ".join(f"{n} long" for n in names) + ", ids array<int>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partition, schema)
