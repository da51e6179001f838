"""Exact top-k search by inner product with sorted lists and no random access.

Method
    Candidates and queries are dealt to groups by hash, and every group of queries meets every group of candidates in one task.
    There the candidates are cut into blocks. A block is one list per dimension, sorted by value, which is read in portions
    from the end where ``query[d] * value`` is largest; nothing else of a candidate is ever looked up. What has been read of a
    candidate adds up to a partial score. With each unread entry put at the least that its list holds this is a lower bound,
    with each put at the list's cursor an upper bound. Reading for a query stops when few candidates outside its best ``k``
    can still qualify: the others have upper bounds below the k-th largest lower bound, which is carried from block to block
    (rows of one id count once there, with their largest bound). The lists are then read on to their ends for those that are
    left, which resolves their scores exactly.

    Portions are read for many queries at once, as matrix products in whole numbers that the number type holds exactly. A task
    returns at most ``k`` rows per query; these are merged by a window over (query), which Spark limits before the shuffle.

Defined results
    Vectors that are null or hold null, NaN or infinite components take no part, neither as queries nor as candidates, nor do
    rows with a null id, which no result could name. A query is compared with vectors of its own length only, and never with
    rows of its own id. Repeated rows count once; an id with several vectors is one candidate with its best score, and as a
    query it asks with all of them. Ties go to the smaller id. Fewer than ``k`` candidates are all returned; an empty table
    gives an empty result. Where scores could pass 2^53 wider numbers are used; scores that do not fit a long are an error.
    Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlake.llm.common import Scratch

#: Candidates of one block of sorted lists, and of one group.
BLOCK, GROUP_ROWS = 4096, 8192
#: Queries that a task reads for at once.
QUERY_BLOCK = 256
#: Shares of the lists at which the bounds are looked at.
DEPTHS = (0.25, 0.5, 0.75, 0.875, 0.9375)


class BestLists:
    """The best ``k`` (score, id) of each query so far."""

    def __init__(self, n: int, k: int, kind=np.float64):
        self.score = np.full((n, k), -np.inf, dtype=kind)
        self.id = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge found candidates, given as flat triples."""
        if not len(query):
            return
        k = self.score.shape[1]
        touched = np.unique(query)
        q = np.concatenate([query, np.repeat(touched, k)])
        s = np.concatenate([score, self.score[touched].ravel()])
        i = np.concatenate([ids, self.id[touched].ravel()])
        # an id once, with its best score; empty places are kept
        order = np.lexsort((-s, i, q))
        q, s, i = q[order], s[order], i[order]
        same = np.zeros(len(q), dtype=bool)
        same[1:] = (q[1:] == q[:-1]) & (i[1:] == i[:-1]) & np.isfinite(s[1:])
        q, s, i = q[~same], s[~same], i[~same]
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, touched)
        at = first[:, None] + np.arange(k)[None, :]
        self.score[touched], self.id[touched] = s[at], i[at]

    def bar(self) -> np.ndarray:
        return self.score[:, -1].copy()


class SortedLists:
    """One block of candidates as lists, cut into the portions in which they are read.

    Columns come twice: as read from the largest value down, and from the smallest up.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, depths=DEPTHS):
        self.ids = ids
        n = len(vectors)
        self.by_id = np.argsort(ids, kind="stable")
        self.first_of_id = np.flatnonzero(np.r_[True, np.diff(ids[self.by_id]) != 0])
        order = np.argsort(vectors, axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
        ascending = np.take_along_axis(vectors, order, axis=0)
        places = np.hstack([n - 1 - rank, rank])
        values = np.hstack([vectors, vectors])
        least = np.hstack([ascending[0], ascending[-1]])
        zero = vectors.dtype.type(0)
        #: Entries of each portion, and the cursor and the least value in the place of entries that are still unread.
        self.portions, self.ends = [], []
        done = 0
        for end in sorted({min(n, max(1, int(n * share))) for share in depths} | {n}):
            entries = np.where((places >= done) & (places < end), values, zero)
            cursor = np.hstack([ascending[n - end], ascending[end - 1]])
            unread = places >= end
            self.portions.append((entries, np.where(unread, cursor, zero), np.where(unread, least, zero)))
            self.ends.append(end)
            done = end

    def _kth(self, bounds: np.ndarray, k: int) -> np.ndarray | None:
        """The k-th largest bound over distinct ids; none if the block has fewer ids."""
        n = len(self.first_of_id)
        if n < k:
            return None
        if n < bounds.shape[1]:
            bounds = np.maximum.reduceat(bounds[:, self.by_id], self.first_of_id, axis=1)
        return np.partition(bounds, n - k, axis=1)[:, n - k]

    def search(self, queries: np.ndarray, query_ids: np.ndarray, best: BestLists) -> np.ndarray:
        """Read for all queries until each one's best are known; returns how many entries were read for each query."""
        k = best.score.shape[1]
        dims, n = queries.shape[1], len(self.ids)
        read = np.zeros(len(queries), dtype=np.int64)
        bar, reading = best.bar(), np.arange(len(queries))
        # positive components read from the top, negative ones from the bottom
        split = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
        own = self.ids[None, :] == query_ids[:, None]
        partial = np.zeros((len(queries), len(self.ids)), dtype=queries.dtype)
        for turn, (entries, cursor, least) in enumerate(self.portions):
            if not len(reading):
                break
            read[reading] = dims * self.ends[turn]
            q, mine = split[reading], own[reading]
            partial += q @ entries.T
            upper, lower = partial + q @ cursor.T, partial + q @ least.T
            upper[mine] = lower[mine] = -np.inf
            if (kth := self._kth(lower, k)) is not None:
                # k-th largest lower bound: of this block, or of the blocks before
                bar[reading] = np.maximum(bar[reading], kth)
            left = (upper >= bar[reading][:, None]) & ~mine
            last = turn + 1 == len(self.portions)
            stop = left.sum(axis=1) <= max(8 * k, len(self.ids) // 16) if not last else np.ones(len(reading), dtype=bool)
            row, column = np.nonzero(left[stop])
            score, at = partial[stop][row, column], reading[stop][row]
            # for those that are left the lists are read on to where each one's last entry stands
            read[reading[stop]] += dims * (n - self.ends[turn]) * left[stop].sum(axis=1) // max(n, 1)
            for more, _, _ in self.portions[turn + 1 :]:
                score += np.einsum("ij,ij->i", split[at], more[column])
            best.offer(at, score, self.ids[column])
            reading, partial = reading[~stop], partial[~stop]
        return read


def _vectors(table: pa.Table, dim: int) -> np.ndarray:
    return table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("read", pa.int64()), ("entries", pa.int64())])

    def run(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        if not candidates.num_rows or not asked.num_rows:
            return schema.empty_table()
        dim = candidates.column("dim")[0].as_py()
        x, q = _vectors(candidates, dim), _vectors(asked, dim)
        ids, query_ids = candidates.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
        most = dim * float(np.abs(x).max()) * float(np.abs(q).max())
        if most >= 2.0**63:
            raise OverflowError("inner products do not fit a long")
        kind = np.float64 if most < 2.0**52 else np.longdouble
        best, read = BestLists(len(q), k, kind), np.zeros(len(q), dtype=np.int64)
        for a in range(0, len(x), BLOCK):
            lists = SortedLists(x[a : a + BLOCK].astype(kind), ids[a : a + BLOCK])
            for b in range(0, len(q), QUERY_BLOCK):
                part = BestLists(0, k, kind)
                part.score, part.id = best.score[b : b + QUERY_BLOCK], best.id[b : b + QUERY_BLOCK]
                read[b : b + QUERY_BLOCK] += lists.search(q[b : b + QUERY_BLOCK].astype(kind), query_ids[b : b + QUERY_BLOCK], part)
        row, place = np.nonzero(np.isfinite(best.score))
        none = np.zeros(len(row), dtype=np.int64)
        found = pa.table([query_ids[row], best.id[row, place], best.score[row, place].astype(np.int64), none, none], schema=schema)
        # one more row per query tells what was read for it
        nulls = pa.nulls(len(q), pa.int64())
        return pa.concat_tables([found, pa.table([query_ids, nulls, nulls, read, np.full(len(q), x.size)], schema=schema)])

    return run


def top_k(
    spark: SparkSession,
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    queries_at_once: int = 8192,
) -> DataFrame:
    """``query_id, rank, vec_id, score, read_share`` of the ``k`` best candidates of each query.

    ``read_share`` is the share of all list entries that was read for the query. Components are turned into ``floor(scale * x)``; the score is the whole-number inner product. A task meets about
    ``GROUP_ROWS`` candidates and ``queries_at_once`` queries.
    """
    if k < 1 or queries_at_once < 1:
        raise ValueError("k and queries_at_once must be positive")

    def whole(df: DataFrame) -> DataFrame:
        x = F.col(vector_col).cast("array<double>")
        fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        out = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), fine.alias("fine")).where("vec_id is not null and fine and size(x) > 0")
        # doubles from 2^52 on are whole already, and may not fit a long
        floor = lambda v: F.when(F.abs(v * float(scale)) >= 2.0**52, v * float(scale)).otherwise(F.floor(v * float(scale)).cast("double"))
        return out.select("vec_id", F.size("x").alias("dim"), F.transform("x", floor).alias("vector"))

    candidates, asked = whole(vectors), whole(queries)
    groups = lambda df, rows, name: df.groupBy("dim").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    sizes = groups(candidates, GROUP_ROWS, "gs").join(groups(asked, queries_at_once, "hs"), "dim")  # one row per length of vector
    key = ["dim", "g", "h"]
    left = candidates.distinct().join(sizes, "dim").withColumn("g", F.expr("cast(pmod(xxhash64(vec_id, vector), gs) as int)")).withColumn("h", F.explode(F.expr("sequence(0, hs - 1)")))
    right = asked.distinct().join(sizes, "dim").withColumn("h", F.expr("cast(pmod(xxhash64(vec_id, vector), hs) as int)")).withColumn("g", F.explode(F.expr("sequence(0, gs - 1)")))
    left, right = (df.select(*(F.col(c).alias(c) for c in (*key, "vec_id", "vector"))) for df in (left, right))
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search(k), "query_id long, vec_id long, score long, read long, entries long")
    found = Scratch(spark, "topk").keep(found)
    shares = found.groupBy(F.col("query_id").alias("asked")).agg((F.sum("read") / F.sum("entries")).alias("read_share"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.where("vec_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(shares, F.col("query_id") == F.col("asked")).select("query_id", "rank", "vec_id", "score", "read_share")
