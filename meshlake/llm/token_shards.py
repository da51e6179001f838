"""Packed token-id matrices: best-fit-decreasing packing with a segment tree, documents cut losslessly.

Method
    Every task takes its documents in shards of about ``SHARD_TOKENS`` ids. A document's ids and an end id form its stream;
    streams longer than a row are cut into full rows and one remainder, none of which is lost. The pieces of a shard are
    placed in order of decreasing length: the segment tree over the capacities 0..``width`` knows for which of them an open
    row exists, and finds the smallest one that is large enough in ``log(width)`` steps. Rows come out as little-endian
    matrices with the cumulative lengths of their segments and positions that restart with each segment.

Defined results
    Null texts count as empty: one segment that holds the end id. Repeated rows are separate documents. Unused places hold
    ``pad_id`` and position 0, and belong to no segment. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.llm.tokens import token_encoder

#: Ids that a task packs together.
SHARD_TOKENS = 1 << 22


class CapacityTree:
    """Counts of open rows per free capacity; ``fit(n)`` finds the smallest capacity of at least ``n`` that has one."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def fit(self, n: int) -> int | None:
        at = n + self.size
        if self.count[at]:
            return n
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows as lists of item numbers, each of at most ``width`` in total."""
    tree, open_rows, rows = CapacityTree(width), {}, []
    for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        free = tree.fit(lengths[item])
        if free is None:
            row, free = len(rows), width
            rows.append([])
        else:
            row = open_rows[free].pop()
            tree.add(free, -1)
        rows[row].append(item)
        if left := free - lengths[item]:
            open_rows.setdefault(left, []).append(row)
            tree.add(left, 1)
    return rows


def _shards(vocabulary: str, width: int, end_id: int, pad_id: int, shard_tokens: int):
    names = ["ids", "cu_seqlens", "positions", "doc_ids", "starts"]
    types = [pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def matrices(pieces):
        doc, start, ids = zip(*pieces, strict=True)
        out: list[list] = [[] for _ in names]
        for row in best_fit_decreasing([len(x) for x in ids], width):
            matrix, positions = np.full(width, pad_id, "<u4"), np.zeros(width, "<u4")
            ends = [0]
            for k in row:
                n = len(ids[k])
                matrix[ends[-1] : ends[-1] + n] = ids[k]
                positions[ends[-1] : ends[-1] + n] = np.arange(n)
                ends.append(ends[-1] + n)
            for column, value in zip(out, (matrix.tobytes(), ends, positions.tobytes(), [doc[k] for k in row], [start[k] for k in row]), strict=True):
                column.append(value)
        for a in range(0, len(out[0]), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 512], t) for c, t in zip(out, types, strict=True)], names)

    def run(batches):
        encode, pieces, held = token_encoder(vocabulary), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                pieces += [(doc_id, k, ids[k : k + width]) for k in range(0, len(ids), width)]
                held += len(ids)
                if held >= shard_tokens:
                    yield from matrices(pieces)
                    pieces, held = [], 0
        if pieces:
            yield from matrices(pieces)

    return run


def token_matrices(
    docs: DataFrame, vocabulary: str, *, width: int = 1024, end_id: int = 50256, pad_id: int = 50256, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """``ids, cu_seqlens, positions, doc_ids, starts`` of each row of ``width`` ids.

    ``ids`` and ``positions`` are little-endian unsigned 32-bit numbers; segment ``k`` of a row spans ``cu_seqlens[k]`` to
    ``cu_seqlens[k + 1]`` and continues document ``doc_ids[k]`` from its id number ``starts[k]`` on. Writing the frame as
    Parquet gives one self-contained file per task.
    """
    if width < 1:
        raise ValueError("width must be positive")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>"
    return rows.mapInArrow(_shards(vocabulary, width, end_id, pad_id, shard_tokens), schema)
