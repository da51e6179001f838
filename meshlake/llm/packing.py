"""Best-fit packing of tokenised documents into sequences of a fixed length, in bulk-synchronous rounds.

Method
    A document's ids, then an end id, form its stream. Streams over ``capacity`` are cut into pieces of ``capacity`` ids, the
    first of which may be shorter. Full pieces are sequences of their own. The others are packed in rounds:

    1. documents over half of the capacity, no two of which fit together, open a sequence each;
    2. waiting documents and gaps are range-sorted by size, documents before gaps of the same size. A hash of the id stands
       behind the size in the key, so one frequent size spreads over as many ranges as its rows need;
    3. each range is swept from small to large: a gap takes the largest documents that wait below it and fit, so a document
       goes to its successor among the gaps. What a range leaves are gaps that met no document, then documents that met no
       gap, each with its rank, and gaps that have shrunk, which wait for the next round;
    4. the sweep goes on across ranges on counts alone (one row per range): the gaps of a range take the documents that the
       nearest range below has left. Conflicts are settled by rank: the document of rank ``i`` goes to the gap of rank
       ``i // m``, where ``m`` is the number of documents of that range that are sure to fit each such gap, and at most what
       the documents are worth. An equi-join on (range, rank) brings the two together;
    5. gaps shrink, and the next round starts. When a round places few documents, the largest waiting ones open as many
       sequences as the total of those waiting needs.

    A round moves only ``(id, size)`` rows; the driver sees counts per size and per range. Texts are read once, for the ids.

Defined results
    Null texts count as empty: one piece that holds the end id. Repeated rows are packed like any other document, each
    separately; rows with a null doc_id are packed as well. An empty table gives an empty result. Texts of any length are encoded
    whole. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlake.llm.common import Scratch
from meshlake.llm.tokens import token_encoder

#: Rows of one range of a round.
SWEEP_ROWS = 100_000
#: A round that places less than this share of the waiting documents lets new sequences open.
FEW = 0.1


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a stream of ``total`` ids: only the first may be shorter than ``capacity``."""
    head = total % capacity or min(total, capacity)
    return [(0, head), *((s, capacity) for s in range(head, total, capacity))]


def _pieces(vocabulary: str, end_id: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        encode = token_encoder(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = batch.column("text")
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, out, strict=True)], names)

    return run


def token_pieces(docs: DataFrame, vocabulary: str, *, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(vocabulary, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def settle(docs: list[tuple[int, int]], gaps: list[tuple[int, int]]) -> tuple[list, list, list]:
    """Sweep ``(size, id)`` lists until nothing fits: ``(placed, waiting, gaps)``, placed as (doc, gap, room left before)."""
    placed: list[tuple[int, int, int]] = []
    docs.sort()
    while gaps:
        gaps.sort()
        waiting, left, at, before = [], [], 0, len(placed)
        for size, key in gaps:
            while at < len(docs) and docs[at][0] <= size:
                waiting.append(docs[at])
                at += 1
            while waiting and waiting[-1][0] <= size:
                placed.append((waiting[-1][1], key, size))
                size -= waiting.pop()[0]
            if size:
                left.append((size, key))
        docs, gaps = waiting + docs[at:], left
        if len(placed) == before:
            break
    return placed, docs, gaps


_STATE = "kind int, size long, id long, sequence_id long, offset long, range int, rank long"


def _sweeps(capacity: int):
    names = ["kind", "size", "id", "sequence_id", "offset", "range", "rank"]

    def run(batches):
        at = TaskContext.get().partitionId()  # ranges are numbered from small sizes to large ones
        docs, gaps, rows = [], [], []
        for batch in batches:
            for kind, size, key, opened in zip(*(batch.column(c).to_pylist() for c in ("kind", "size", "id", "opened")), strict=True):
                (gaps if kind else docs).append((size, key))
                if opened:
                    rows.append((2, 0, key, key, 0, at, 0))
        placed, docs, gaps = settle(docs, gaps)
        rows += [(2, 0, doc, key, capacity - room, at, 0) for doc, key, room in placed]
        # the largest document is the next one that a gap further up takes; the smallest gap is the first to be asked
        rows += [(0, size, key, None, None, at, k) for k, (size, key) in enumerate(reversed(docs))]
        # a gap that has shrunk may be below its range; it waits for the next round (kind 3)
        shrunk = {key for _, key, _ in placed}
        rows += [(3, size, key, None, None, at, 0) for size, key in gaps if key in shrunk]
        rows += [(1, size, key, None, None, at, k) for k, (size, key) in enumerate(g for g in gaps if g[1] not in shrunk)]
        for a in range(0, len(rows), 50_000):
            columns = zip(*rows[a : a + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("kind", "range") else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    return run


def across_ranges(left: list[tuple[int, int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the documents that ranges have left go: ``(range, from, to, gap_range, gap_from, m)``.

    ``left``: per range, from small sizes to large, its number, documents and gaps left, the largest of those documents,
    the smallest and the largest of those gaps. Document ``i`` of ``from .. to`` takes gap ``gap_from + (i - from) // m``.
    """
    out, stack = [], []  # of the stack: range, first rank, documents, largest size
    for at, n_docs, n_gaps, large, small_gap, _ in left:
        first = 0
        while first < n_gaps and stack:
            source, begin, n, size = stack[-1]
            gaps = n_gaps - first
            m = min(small_gap // size, -(-n // gaps))
            taken = min(n, m * gaps)
            out.append((source, begin, begin + taken, at, first, m))
            first += -(-taken // m)
            stack.pop()
            if taken < n:
                stack.append((source, begin + taken, n - taken, size))
        if n_docs:
            stack.append((at, 0, n_docs, large))
    return out


def _cross(spark: SparkSession, done: DataFrame, capacity: int) -> DataFrame:
    """Documents and gaps after the sweep across ranges, and what it has placed."""
    by_range = done.where("kind < 2").groupBy("range").agg(
        F.count_if(F.col("kind") == 0).alias("docs"), F.count_if(F.col("kind") == 1).alias("gaps"),
        F.max(F.when(F.col("kind") == 0, F.col("size"))).alias("large"), F.min(F.when(F.col("kind") == 1, F.col("size"))).alias("small"), F.max(F.when(F.col("kind") == 1, F.col("size"))).alias("high"),
    )
    moves = across_ranges(sorted(tuple(r) for r in by_range.collect()))  # one row per range
    schema = "source int, begin long, end long, gap_range int, gap_from long, m long"
    docs = done.where("kind = 0").join(spark.createDataFrame(moves, schema), (F.col("range") == F.col("source")) & (F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("end")), "left")
    docs = docs.select("size", "id", "rank", "gap_range", F.expr("gap_from + (rank - begin) div m").alias("gap_rank"))
    waiting = docs.where("gap_range is null").select(F.lit(0).alias("kind"), "size", "id", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    going = docs.where("gap_range is not null").select(F.col("size").alias("doc_size"), F.col("id").alias("doc"), F.col("rank").alias("doc_rank"), F.col("gap_range").alias("range"), F.col("gap_rank").alias("rank"))
    gaps = done.where("kind = 1").select("range", "rank", "size", F.col("id").alias("gap"))
    one_gap = Window.partitionBy("range", "rank").orderBy("doc_rank")  # at most as many rows as documents fit a sequence
    met = gaps.join(going, ["range", "rank"], "left").withColumn("used", F.coalesce(F.sum("doc_size").over(one_gap), F.lit(0))).withColumn("more", F.lead("doc").over(one_gap).isNotNull())
    rows = F.array(
        F.when(F.col("doc").isNotNull(), F.struct(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("size"), F.col("doc").alias("id"), F.col("gap").alias("sequence_id"), (capacity - F.col("size") + F.col("used") - F.col("doc_size")).alias("offset"))),
        F.when(~F.col("more"), F.struct(F.lit(1).alias("kind"), (F.col("size") - F.col("used")).alias("size"), F.col("gap").alias("id"), F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))),
    )
    shrunk = done.where("kind = 3").select(F.lit(1).alias("kind"), "size", "id", "sequence_id", "offset")
    return waiting.unionByName(shrunk).unionByName(met.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*"))


def best_fit(spark: SparkSession, items: DataFrame, capacity: int, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """Place ``items(item, length)`` (1 <= length <= capacity): ``item, sequence_id, offset``, gapless in each sequence.

    ``item`` is a distinct number; a sequence has the number of the item that opened it.
    """
    state = items.select(F.lit(0).alias("kind"), F.col("length").alias("size"), F.col("item").alias("id"))
    opens = F.col("size") * 2 > capacity
    n, n_rows, least, placed = None, items.count(), 1, []
    for turn in range(max_rounds):
        # a document that opens a sequence becomes its gap
        opened = (F.col("kind") == 0) & opens
        rows = state.select(
            F.when(opened, 1).otherwise(F.col("kind")).alias("kind"), F.when(opened, capacity - F.col("size")).otherwise(F.col("size")).alias("size"), "id", opened.alias("opened")
        ).where(F.col("opened") | (F.col("kind") == 0) | (F.col("size") >= least))
        dealt = rows.repartitionByRange(max(1, -(-n_rows // SWEEP_ROWS)), "size", "kind", F.xxhash64("id", F.lit(turn)))
        done = scratch.keep(dealt.mapInArrow(_sweeps(capacity), _STATE))
        crossed = scratch.keep(_cross(spark, done, capacity))
        placed += [df.where("kind = 2").select(F.col("id").alias("item"), "sequence_id", "offset") for df in (done, crossed)]
        sizes = crossed.where("kind < 2").groupBy("kind", "size").agg(F.count("*").alias("k")).toArrow().to_pylist()  # at most two rows per size
        waiting = sorted(((r["size"], r["k"]) for r in sizes if r["kind"] == 0), reverse=True)
        now = sum(k for _, k in waiting)
        if not now:
            break
        least = waiting[-1][0]
        fits = sum(r["k"] for r in sizes if r["kind"] == 1 and r["size"] >= least)
        n_rows = now + fits
        opens = F.lit(False)
        if not fits or (n is not None and now > (1 - FEW) * n):
            need = -(-sum(size * k for size, k in waiting) // capacity)
            for size, k in waiting:
                if k >= need:
                    # part of the documents of one size, picked by a hash
                    share = -(-need * (1 << 20) // k)
                    opens = (F.col("size") > size) | ((F.col("size") == size) & (F.pmod(F.xxhash64(F.lit(turn), "id"), F.lit(1 << 20)) < share))
                    break
                need -= k
        n = now
        state = crossed.where("kind < 2").select("kind", "size", "id")
    else:
        raise RuntimeError("packing did not settle")
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack(
    spark: SparkSession,
    docs: DataFrame,
    vocabulary: str,
    *,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Where each piece of each document goes: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    scratch = Scratch(spark, "packing")
    pieces = token_pieces(docs, vocabulary, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col)
    # rows are numbered once and stored, so that the numbers hold through all rounds
    pieces = scratch.keep(pieces.withColumn("item", F.monotonically_increasing_id()))
    full = F.col("length") == capacity
    placed = best_fit(spark, pieces.where(~full).select("item", "length"), capacity, scratch)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    alone = pieces.where(full).select(*columns[:5], F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(pieces.where(~full).join(placed, "item").select(*columns))
