"""Near-duplicate removal on embeddings: spherical k-means cells, blocked cosine products, one representative per group.

Method
    1. Equal vectors of one label collapse to one *node* with a weight; copies are never compared with each other.
    2. Spherical k-means is fitted on a bounded sample (the ``SAMPLE`` nodes with the smallest hash), with a centroid for
       every ``CELL_ROWS`` nodes, ``LEAST_CELLS`` at least and ``MAX_CELLS`` at most. A cell holds the nodes of one label
       around one centroid. Every node has the nearest centroid as its home cell, and is a guest in each further cell that can be home to a neighbour: for unit
       vectors with ``x . y >= t`` the gap ``x . home - x . cell`` is at most ``sqrt(2 - 2t) * |home - cell|``. With that
       bound no pair is lost, whatever the sample.
    3. Inside a cell, rows (home and guests) meet home members in blocks of at most ``BLOCK`` rows and ``BLOCK_BYTES`` on
       either side; a large cell has many block pairs, so it is spread over many tasks. Products are taken tile by tile; a
       tile returns, per row, a sum of weights and a spanning edge, never the pairs.
    4. Components of the spanning edges give the groups.

    The bound on guests is exact, so what the cells save depends on the vectors. Where those of a label lie in clusters, nearly
    all have one cell, and the work grows with rows times the rows of a cell. Where they have no structure (independent
    directions in many dimensions), a step of ``sqrt(2 - 2t)`` crosses most borders between cells: nodes are guests in most
    cells, and the work is that of all pairs of a label, in blocks. Only giving up links could avoid that.

Defined results
    Null or zero vectors, vectors with a null, NaN or infinite component, and those with a null label link with nothing and
    are kept. Vectors of different length never link. Repeated rows count once; a vec_id with several vectors gets the
    largest count and the smallest component of them. Rows with a null vec_id come back one by one, without links or component,
    and kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.llm.common import Scratch, connected_components

#: Nodes that the centroids are fitted on, at most.
SAMPLE = 32_768
#: Nodes for which there is one centroid, and the least and most centroids. Cells beyond the most hold more nodes.
CELL_ROWS, LEAST_CELLS, MAX_CELLS = 8192, 4, 4096
#: Rows and bytes on each side of a block, and rows on each side of one product.
BLOCK, BLOCK_BYTES, TILE = 16_384, 8 << 20, 2048
#: Vectors that are held against all centroids at once, and bytes of the placements that are handed on at once.
STRIP, PLACED_BYTES = 512, 8 << 20


def valid_vector(column: str) -> F.Column:
    """True where an array of numbers is not null, not all zero, and has only finite components."""
    c = F.col(column).cast("array<double>")
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(c, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / scale
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit_centroids(vectors: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means, begun far apart; a cell that loses all members keeps its centroid."""
    rng = np.random.RandomState(seed)
    picked, far = [rng.randint(len(vectors))], np.full(len(vectors), np.inf)
    while len(picked) < min(k, len(vectors)):
        # the next centroid is drawn in proportion to the squared distance from those drawn before
        far = np.minimum(far, np.maximum(0, 1 - vectors @ vectors[picked[-1]]))
        if (total := far.sum()) <= 0:
            break
        picked.append(int(np.searchsorted(np.cumsum(far), rng.rand() * total, side="right").clip(max=len(vectors) - 1)))
    centroids = vectors[picked]
    for _ in range(rounds):
        nearest = np.concatenate([(vectors[a : a + STRIP] @ centroids.T).argmax(axis=1) for a in range(0, len(vectors), STRIP)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def cells_of(x: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, cell, home)`` of each placement of unit vectors: the home cell and every cell that can be home to a neighbour."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    score = x @ centroids.T
    home = score.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centroids[home] @ centroids.T))
    row, cell = np.nonzero(score.max(axis=1, keepdims=True) - score <= reach * apart + 1e-12)
    return row, cell.astype(np.int32), home[row] == cell


def _assign(shared, threshold: float):
    names = ["label", "dim", "node", "weight", "unit", "cell", "home"]

    def run(batches):
        fitted = shared.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = unit(_dense(part.column("embedding"), int(dim)))
                most = max(1, PLACED_BYTES // (8 * int(dim)))
                for a in range(0, len(x), STRIP):
                    row, cell, home = cells_of(x[a : a + STRIP], fitted[int(dim)], threshold)
                    raw = [v.tobytes() for v in x[a : a + STRIP]]
                    for p in range(0, len(row), most):
                        r, take = row[p : p + most], pa.array(a + row[p : p + most])
                        yield pa.RecordBatch.from_arrays(
                            [*(part.column(c).take(take) for c in ("label", "dim", "node", "weight")), pa.array([raw[i] for i in r], pa.binary()), pa.array(cell[p : p + most]), pa.array(home[p : p + most])],
                            names,
                        )

    return run


def _compare(threshold: float):
    schema = pa.schema([("node", pa.int64()), ("linked", pa.int64()), ("root", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        dim = left.column("dim")[0].as_py()
        a, b = (np.frombuffer(b"".join(t.column("unit").to_pylist()), dtype=np.float64).reshape(-1, dim) for t in (left, right))
        x, y = left.column("node").to_numpy(), right.column("node").to_numpy()
        weight = right.column("weight").to_numpy()
        tiles = [
            _tile(a[r : r + TILE], x[r : r + TILE], b[c : c + TILE], y[c : c + TILE], weight[c : c + TILE], threshold)
            for r in range(0, len(x), TILE)
            for c in range(0, len(y), TILE)
        ]
        return pa.table([np.concatenate(c) for c in zip(*tiles, strict=True)], schema=schema)

    return run


def _tile(a, x, b, y, weight, threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(nodes, linked, root)``: per row the weight of what it links with, and for each end of a link a node it hangs on."""
    close = (a @ b.T >= threshold) & (x[:, None] != y[None, :])
    linked = close @ weight
    i, j = np.nonzero(close)
    nodes, root = x, x.copy()
    if len(i):
        # smallest reachable node within the tile: alternate over both sides until nothing changes
        starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        order = np.lexsort((i, j))
        jj, ii = j[order], i[order]
        jstarts = np.flatnonzero(np.concatenate(([True], jj[1:] != jj[:-1])))
        other = y.copy()
        while True:
            before = root.copy()
            other[jj[jstarts]] = np.minimum(other[jj[jstarts]], np.minimum.reduceat(root[ii], jstarts))
            root[i[starts]] = np.minimum(root[i[starts]], np.minimum.reduceat(other[j], starts))
            if (root == before).all():
                break
        seen = np.unique(jj)
        nodes = np.concatenate([x, y[seen]])
        linked = np.concatenate([linked, np.zeros(len(seen), dtype=np.int64)])
        root = np.concatenate([root, other[seen]])
    keep = (linked > 0) | (root != nodes)
    return nodes[keep], linked[keep].astype(np.int64), root[keep]


def near_duplicates(
    spark: SparkSession,
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept`` (see the module's text for nulls and repeats)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    scratch = Scratch(spark, "embeddings")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    nameless = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where("vec_id is not null").withColumn("ok", valid_vector("embedding") & F.col("label").isNotNull())
    rows = rows.withColumns({"dim": F.size("embedding"), "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), F.reverse("embedding"))})
    key = ["label", "dim", "h1", "h2"]
    ids = rows.where("ok").select("vec_id", *key).distinct()
    nodes = ids.groupBy(*key).agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    one = rows.where("ok").select("vec_id", "embedding", *key).dropDuplicates(["vec_id", *key])
    nodes = scratch.keep(one.join(nodes.withColumnRenamed("node", "vec_id"), ["vec_id", *key]).withColumnRenamed("vec_id", "node"))

    fitted = {}
    for dim, n in nodes.groupBy("dim").count().collect():  # one row per length of vector
        sample = nodes.where(F.col("dim") == dim).select("embedding", F.xxhash64("node").alias("h")).orderBy("h").limit(SAMPLE).toArrow()
        fitted[dim] = fit_centroids(unit(_dense(sample.column("embedding"), dim)), min(MAX_CELLS, max(LEAST_CELLS, n // CELL_ROWS)))
    shared = spark.sparkContext.broadcast(fitted)

    schema = "label string, dim int, node long, weight long, unit binary, cell int, home boolean"
    placed = nodes.select("label", "dim", "node", "weight", "embedding").mapInArrow(_assign(shared, threshold), schema)
    cell = ["label", "dim", "cell"]
    placed = scratch.keep(placed)
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES / 8) / F.col("dim"))))
    sizes = placed.groupBy(*cell).agg(
        F.ceil(F.count("*") / block).cast("int").alias("row_blocks"), F.greatest(F.lit(1), F.ceil(F.sum(F.col("home").cast("int")) / block)).cast("int").alias("home_blocks")
    )
    placed = placed.join(sizes, cell)
    left = placed.withColumn("r", F.expr("pmod(xxhash64(node), row_blocks)").cast("int")).withColumn("h", F.explode(F.expr("sequence(0, home_blocks - 1)")))
    right = placed.where("home").withColumn("h", F.expr("pmod(xxhash64(node, 1), home_blocks)").cast("int")).withColumn("r", F.explode(F.expr("sequence(0, row_blocks - 1)")))
    columns = [*cell, "r", "h", "node", "weight", "unit"]
    by = [*cell, "r", "h"]
    right = right.select(*(F.col(c).alias(c) for c in columns))  # columns of its own, though both sides come from one table
    pairs = left.select(*columns).groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_compare(threshold), "node long, linked long, root long")
    found = scratch.keep(pairs)

    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    counts = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    labels = (
        nodes.select("node", "weight", *key)
        .join(counts, "node", "left")
        .join(components, "node", "left")
        .select(*key, (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    linked = ids.join(labels, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).unionByName(nameless)
