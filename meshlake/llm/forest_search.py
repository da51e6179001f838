"""Approximate nearest neighbours by inner product with a forest of random-projection trees.

Method
    Every level of a tree has one random direction, and every node at that level a threshold, the median of a bounded sample
    of the vectors there. The forest is fitted on that sample; all vectors are then put into one leaf of each tree. A query
    descends all trees with one priority queue. An entry is a node that was passed by, and its priority the sum of the squared
    distances to the thresholds that lie between the query and that node, so the next leaf is the nearest one of any tree. The
    queue is emptied until ``visits`` leaves are found. Their members are compared with the query exactly, and the best ``k`` of
    all leaves remain.

    ``visits`` is not guessed: for queries of the sample the true neighbours within the sample are worked out, and the least
    number of leaves that finds ``recall`` of them is taken. In a sample neighbours are further away than in the whole table,
    so the number errs to the high side. Clustered vectors need few leaves; vectors without structure need many.

Partitioning
    A vector goes to its leaf of every tree, that is to ``trees`` tasks; a query goes to those blocks of leaves only that hold a
    leaf it visits, once to each. A block holds about ``BLOCK_ROWS`` vectors; where the sample is too small for so many leaves, blocks are
    dealt further by hash and a query meets all slices. A block takes its queries in turns of about ``QUERY_ROWS``. Within a task a matrix product per leaf finds who can be among the best,
    and the exact sum decides. A vector that many rows share is indexed for the ``k + 1`` smallest ids only: the others cannot be
    among the ``k`` best of any query.

Defined results
    Vectors that are null, zero or hold null, NaN or infinite components take no part, neither as queries nor as candidates, nor
    do rows with a null id. A query is compared with vectors of its own length only, and never with rows of its own id. Repeated
    rows count once; an id with several vectors is one candidate with its best score, and as a query asks with all of them. Ties
    go to the smaller id. With ``k`` candidates or fewer all that are found are returned; where a forest has a single leaf, as in
    small tables, that is all of them. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlake.llm.common import Scratch
from meshlake.llm.topk_search import BestLists

#: Vectors of a leaf aimed at, and vectors that a leaf has in the sample at least.
LEAF_ROWS, LEAF_SAMPLE = 32, 16
#: Vectors, and queries, that a task holds; members and queries of one product.
BLOCK_ROWS, QUERY_ROWS, SIDE = 65_536, 65_536, 1024
#: Bounds of the sample that the forest is fitted on, and the queries in it that measure recall.
SAMPLE_ROWS, SAMPLE_BYTES, PROBES = 65_536, 64 << 20, 256
#: Found pairs that a task keeps before it merges them into the best.
PENDING = 200_000


@dataclass(frozen=True)
class Forest:
    """``directions[t]`` is (depth, dim); ``thresholds[t][l]`` has one entry per node of level ``l``."""

    directions: list[np.ndarray]
    thresholds: list[list[np.ndarray]]
    visits: int

    @property
    def depth(self) -> int:
        return len(self.thresholds[0])

    def leaves(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``."""
        at, along = np.zeros(len(x), dtype=np.int64), x @ self.directions[tree].T
        for level, cuts in enumerate(self.thresholds[tree]):
            at = 2 * at + (along[:, level] > cuts[at])
        return at

    def visited(self, q: np.ndarray) -> list[tuple[int, int]]:
        """``(tree, leaf)`` of the leaves that a query visits, nearest first, from one queue over all trees."""
        along = [d @ q for d in self.directions]
        queue = [(0.0, t, 0, 0) for t in range(len(along))]
        out, depth = [], self.depth
        while queue and len(out) < self.visits:
            far, tree, level, node = heapq.heappop(queue)
            values, cuts = along[tree], self.thresholds[tree]
            while level < depth:
                margin = values[level] - cuts[level][node]
                near = 2 * node + (margin > 0)
                heapq.heappush(queue, (far + margin * margin, tree, level + 1, int(near ^ 1)))
                level, node = level + 1, int(near)
            out.append((tree, node))
        return out


def _grow(x: np.ndarray, trees: int, depth: int, rng: np.random.RandomState) -> Forest:
    directions, thresholds = [], []
    for _ in range(trees):
        d = rng.standard_normal((depth, x.shape[1]))
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        along, cuts = x @ d.T, []
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            value = along[:, level]
            order = np.lexsort((value, node))
            size = np.bincount(node, minlength=1 << level)
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            ordered = value[order]
            # between the two middle values; an empty node sends everything to the left
            low = ordered[np.minimum(first + np.maximum(size - 1, 0) // 2, len(x) - 1)]
            high = ordered[np.minimum(first + size // 2, len(x) - 1)]
            cuts.append(np.where(size > 0, (low + high) / 2, np.inf))
            node = 2 * node + (value > cuts[-1][node])
        directions.append(d)
        thresholds.append(cuts)
    return Forest(directions, thresholds, trees << depth)


def _priorities(forest: Forest, q: np.ndarray) -> np.ndarray:
    """(query, tree, leaf): the priority at which the queue reaches each leaf."""
    out = []
    for d, cuts in zip(forest.directions, forest.thresholds, strict=True):
        along, far = q @ d.T, np.zeros((len(q), 1))
        for level, cut in enumerate(cuts):
            margin = along[:, level][:, None] - cut[None, :]
            side = np.where(margin > 0, margin, 0.0) ** 2, np.where(margin > 0, 0.0, margin) ** 2
            far = np.stack([far + side[0], far + side[1]], axis=2).reshape(len(q), -1)
        out.append(far)
    return np.stack(out, axis=1)


def _visits(forest: Forest, x: np.ndarray, k: int, recall: float, rng: np.random.RandomState) -> int:
    """Leaves to visit so that ``recall`` of the ``k`` best of the sample are found, on average over its queries."""
    probes = rng.permutation(len(x))[:PROBES]
    leaf = np.stack([forest.leaves(t, x) for t in range(len(forest.directions))])
    ranks = []
    for a in range(0, len(probes), 32):
        mine = probes[a : a + 32]
        score = x[mine] @ x.T
        score[np.arange(len(mine)), mine] = -np.inf
        best = np.argpartition(-score, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
        far = np.nan_to_num(_priorities(forest, x[mine]), nan=np.inf)
        reached = np.stack([np.take_along_axis(far[:, t], leaf[t][best], axis=1) for t in range(len(leaf))]).min(axis=0)
        ordered = np.sort(far.reshape(len(mine), -1), axis=1)
        ranks += [np.searchsorted(o, r, side="right") for o, r in zip(ordered, reached, strict=True)]
    return int(np.quantile(np.concatenate(ranks), recall, method="higher"))


def fit(sample: np.ndarray, rows: int, *, trees: int, k: int, recall: float, seed: int) -> Forest:
    """A forest for a table of ``rows`` vectors of which ``sample`` are some."""
    rng = np.random.RandomState(seed)
    leaves = min(rows // LEAF_ROWS, len(sample) // LEAF_SAMPLE)
    depth = max(0, leaves.bit_length() - 1) if leaves > 1 else 0
    if depth == 0:
        trees = 1
    forest = _grow(sample, trees, depth, rng)
    return forest if depth == 0 else Forest(forest.directions, forest.thresholds, max(1, _visits(forest, sample, k, recall, rng)))


@dataclass(frozen=True)
class Layout:
    """How the leaves of a forest are cut into blocks of tasks: ``leaf >> shift``, each in ``slices`` by hash."""

    forest: Forest
    shift: int
    slices: int


def _layout(forest: Forest, rows: int) -> Layout:
    shift = forest.depth
    while shift > 0 and rows >> (forest.depth - shift) > BLOCK_ROWS:
        shift -= 1
    return Layout(forest, shift, -(-(rows >> (forest.depth - shift)) // BLOCK_ROWS) or 1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _groups(batch: pa.RecordBatch):
    """Rows of a batch by length of vector."""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        rows = pa.array(np.flatnonzero(dims == dim))
        yield int(dim), batch.take(rows)


_PLACED = "dim int, tree int, block int, slice int, vec_id long, leaf int, vector {0}"
_ROUTED = "dim int, tree int, block int, slice int, vec_id long, leaves array<int>, vector {0}"


def _place(layouts: dict[int, Layout], kind: pa.DataType):
    """Candidates in their leaf of each tree."""

    def run(batches):
        for batch in batches:
            for dim, rows in _groups(batch):
                lay, x = layouts[dim], _matrix(rows.column("vector"), dim)
                part = rows.column("part").to_numpy(zero_copy_only=False) % lay.slices
                for tree in range(len(lay.forest.directions)):
                    leaf = lay.forest.leaves(tree, x)
                    n = len(leaf)
                    numbers = [np.full(n, dim), np.full(n, tree), leaf >> lay.shift, part]
                    columns = [pa.array(c.astype(np.int32)) for c in numbers]
                    yield pa.RecordBatch.from_arrays([*columns, rows.column("vec_id"), pa.array(leaf.astype(np.int32)), rows.column("vector").cast(kind)], ["dim", "tree", "block", "slice", "vec_id", "leaf", "vector"])

    return run


def _route(layouts: dict[int, Layout], kind: pa.DataType):
    """Queries at the blocks that hold leaves they visit."""

    def run(batches):
        for batch in batches:
            for dim, rows in _groups(batch):
                lay, x = layouts[dim], _matrix(rows.column("vector"), dim)
                trees, blocks, leaves, source = [], [], [], []
                for i in range(len(x)):
                    at: dict[tuple[int, int], list[int]] = {}
                    for tree, leaf in lay.forest.visited(x[i]):
                        at.setdefault((tree, leaf >> lay.shift), []).append(leaf)
                    for (tree, block), found in at.items():
                        trees.append(tree), blocks.append(block), leaves.append(found), source.append(i)
                take = rows.take(pa.array(source, pa.int64()))
                whole = pa.array(np.full(len(source), dim, np.int32))
                for piece in range(lay.slices):
                    columns = [whole, pa.array(trees, pa.int32()), pa.array(blocks, pa.int32()), pa.array(np.full(len(source), piece, np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, take.column("vec_id"), pa.array(leaves, pa.list_(pa.int32())), take.column("vector").cast(kind)], ["dim", "tree", "block", "slice", "vec_id", "leaves", "vector"])

    return run


def _compare(k: int):
    """Exact scores of the members of visited leaves; the best ``k`` of each query in this block."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(members: pa.Table, asking: pa.Table) -> pa.Table:
        if not members.num_rows or not asking.num_rows:
            return schema.empty_table()
        dim = members.column("dim")[0].as_py()
        leaf = members.column("leaf").to_numpy()
        order = np.argsort(leaf, kind="stable")
        leaf, ids = leaf[order], members.column("vec_id").to_numpy()[order]
        x = _matrix(members.column("vector").combine_chunks(), dim)[order]
        q, query_ids = _matrix(asking.column("vector").combine_chunks(), dim), asking.column("vec_id").to_numpy()
        visits = asking.column("leaves").combine_chunks()
        visited = visits.flatten().to_numpy()
        who = np.repeat(np.arange(len(q)), np.diff(visits.offsets.to_numpy()))
        order = np.argsort(visited, kind="stable")
        visited, who = visited[order], who[order]
        # a matrix product can be off the exact sum by so much
        slack = dim * 2.0**-50 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        best = BestLists(len(q), k)
        bar, pending, held = best.bar(), [], 0

        def merge() -> None:
            nonlocal bar, held
            if pending:
                best.offer(*(np.concatenate(c) for c in zip(*pending, strict=True)))
                pending.clear()
                bar, held = best.bar(), 0

        for name in np.unique(visited):
            a, b = np.searchsorted(leaf, [name, name + 1])
            c, d = np.searchsorted(visited, [name, name + 1])
            for s, first in ((s, first) for s in range(a, b, SIDE) for first in range(c, d, 4 * SIDE)):
                here, mine = slice(s, min(s + SIDE, b)), who[first : min(first + 4 * SIDE, d)]
                near = (q[mine] @ x[here].T >= (bar - slack)[mine][:, None]) & (ids[here][None, :] != query_ids[mine][:, None])
                row, column = np.nonzero(near)
                for p in range(0, len(row), PENDING):
                    r, m = mine[row[p : p + PENDING]], s + column[p : p + PENDING]
                    pending.append((r, np.einsum("ij,ij->i", q[r], x[m]), ids[m]))
                    held += len(r)
                    if held >= PENDING:
                        merge()
        merge()
        row, place = np.nonzero(np.isfinite(best.score))
        return pa.table([query_ids[row], best.id[row, place], best.score[row, place]], schema=schema)

    return run


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct ``vec_id, dim, vector`` of the rows that take part."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vector"), fine.alias("fine"))
    return rows.where("vec_id is not null and fine").select("vec_id", F.size("vector").alias("dim"), "vector").distinct()


def nearest(
    spark: SparkSession,
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 20,
    trees: int = 4,
    recall: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    seed: int = 12,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest candidates found for each query, by inner product.

    ``recall`` is aimed at on the sample (``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` bytes at most); lower values visit fewer leaves.
    """
    if k < 1 or trees < 1 or not 0 < recall <= 1:
        raise ValueError("k and trees must be positive, recall between 0 and 1")
    scratch = Scratch(spark, "forest")
    width = vectors.schema[vector_col].dataType.elementType.simpleString()
    if width != "float":
        width = "double"
        vectors, queries = (df.withColumn(vector_col, F.col(vector_col).cast("array<double>")) for df in (vectors, queries))
    kind = pa.list_(pa.float32() if width == "float" else pa.float64())
    copies = Window.partitionBy("vector").orderBy("vec_id")
    known = _vectors(vectors, id_col, vector_col).withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    known = known.withColumn("part", F.expr("cast(pmod(xxhash64(vec_id, vector), 1048576) as int)"))
    known = scratch.keep(known)  # counted, sampled and placed
    sizes = {r["dim"]: r["n"] for r in known.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row per length of vector
    layouts = {}
    if sizes:
        most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(sizes))))
        share = most / sum(sizes.values())
        drawn = known if share >= 1 else known.where(F.col("part") < int(0.95 * share * 1048576) + 1)
        batches = drawn.select("dim", "vector").limit(most).toArrow()
        dims = batches.column("dim").to_numpy()
        for dim, n in sizes.items():
            x = _matrix(batches.filter(pa.array(dims == dim)).column("vector").combine_chunks(), dim)
            x = x[np.lexsort(x.T)]  # one order, however the sample came in
            layouts[dim] = _layout(fit(x if len(x) else np.zeros((1, dim)), n, trees=trees, k=k, recall=recall, seed=seed), n)
    key = ["dim", "tree", "block", "slice"]
    asked = _vectors(queries, id_col, vector_col).where(F.col("dim").isin(list(sizes)))
    placed = known.mapInArrow(_place(layouts, kind), _PLACED.format(f"array<{width}>"))
    routed = scratch.keep(asked.mapInArrow(_route(layouts, kind), _ROUTED.format(f"array<{width}>")))
    # a block that many queries visit takes them in turns, its members once each; members of blocks that none visits stay behind
    turns = routed.groupBy(*key).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("turns"))
    placed = placed.join(turns, key).withColumn("turn", F.explode(F.expr("sequence(0, turns - 1)"))).drop("turns")
    routed = routed.join(turns, key).withColumn("turn", F.expr("cast(pmod(xxhash64(vec_id, vector), turns) as int)")).drop("turns")
    by = [*key, "turn"]
    found = placed.groupBy(*by).cogroup(routed.groupBy(*by)).applyInArrow(_compare(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
