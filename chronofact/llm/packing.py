"""Packing of documents into fixed windows by multiway differencing.

Every partition of the input packs for itself while it streams: nothing is
shuffled, and no key can be hot. A document longer than a window gives whole
windows first; what is left is cut into parts of at most `part` tokens. Parts
gather in a block until they nearly fill `block` windows, then the block is
divided by Karmarkar-Karp multiway differencing: the two partial partitions with
the largest spread are merged, heavy sides against light ones, until one
partition is left. Its windows are nearly equal; if one is over capacity, the
block is divided again into one window more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_schema
from .tokenise import library_encoder

FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def divide(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of `sizes` in k parts with nearly equal sums.

    A partial partition holds its non-empty parts only, heaviest first, as
    (sum, indexes); absent parts count as zero. Merging lays the heaviest part of
    one on the lightest of the other. Ties go to the earlier item.
    """
    heap = [(-n, i, [(n, [i])]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:  # the last `over` parts of a meet the last of b in opposite order
            keep = len(a) - over
            tail = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[keep:], reversed(b[len(b) - over :]), strict=True)]
            merged = a[:keep] + tail + b[: len(b) - over]
        merged.sort(key=lambda x: -x[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    return [ids for _, ids in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most `capacity`: their number rises while one is too large."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = divide(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return parts
        k += 1


def _pack(batches: Iterator[pa.RecordBatch], *, path: str, end_id: int, capacity: int, part: int, block: int, slack: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoder, end = library_encoder(path), np.array([end_id], "<u4").tobytes()
    next_id = TaskContext.get().partitionId() << 40
    held: list[tuple] = []
    held_tokens, full = 0, block * (capacity - slack)
    rows: list[tuple] = []

    def close() -> None:
        nonlocal next_id, held, held_tokens
        for window in windows([x[2] for x in held], capacity):
            at = 0
            for i in window:
                rows.append((*held[i], next_id, at))
                at += held[i][2]
            next_id += 1
        held, held_tokens = [], 0

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        rows.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = encoder.encode_bytes(text or "") + end
            n, at = len(raw) // 4, 0
            while at < n:
                left = n - at
                size = capacity if left >= capacity else min(left, part, full - held_tokens)
                piece = (doc_id, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), n)
                at += size
                if size == capacity:
                    rows.append((*piece, next_id, 0))
                    next_id += 1
                else:
                    held.append(piece)
                    held_tokens += size
                    if held_tokens == full:
                        close()
            if len(rows) >= 50_000:
                yield flush()
    if held:
        close()
    if rows:
        yield flush()


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int = 0, capacity: int = 1024, part: int = 192, block: int = 32, slack: int = 3) -> DataFrame:
    """One row for each piece of a document: where it starts, its sequence and its place there.

    Null and empty texts hold the end id alone. Repeated rows are packed as often as
    they occur; a null doc_id stays null; an empty table gives no row; other columns
    are ignored. Sequence ids are unique, in one range for each input partition; a
    sequence is full but for about `slack` tokens, and only the last block of a
    partition can be emptier.
    """
    schema, ddl = arrow_schema(FIELDS)
    run = partial(_pack, path=tokenizer_path, end_id=end_id, capacity=capacity, part=part, block=block, slack=slack, schema=schema)
    return docs.select("doc_id", "text").mapInArrow(run, ddl)
