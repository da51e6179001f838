"""Shared plumbing: tables in the shared scratch folder, bounded Arrow batches, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch, and the setting that bounds it.
BATCH_BYTES, BATCH_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session hold at most ``BATCH_BYTES``, unless it sets a bound of its own.

    Rows of whole texts vary from bytes to megabytes, so a bound on rows alone bounds no memory.
    """
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, f"{BATCH_BYTES}b")


def release(spark: SparkSession) -> None:
    """Let go of what finished steps have left: Spark's cleaner removes their shuffle files and broadcasts once the driver has
    collected its garbage, and freed memory of the driver's Python goes back to the system."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2`` .. that is no column of ``df`` in any case."""
    taken, out, k = {c.lower() for c in df.columns}, name, 0
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def same_columns(df: DataFrame) -> list[F.Column]:
    """The columns of ``df`` by name, whatever characters the names hold."""
    return [F.col("`{}`".format(c.replace("`", "``"))) for c in df.columns]


class Scratch:
    """Tables written below the folder that ``spark.checkpoint.dir`` names.

    A written table cuts the lineage and outlives executors. Where the setting is absent, a session on one machine
    (``local[n]``) gets a temporary folder; on a cluster that is an error, since executors do not share such a folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        bound_batches(spark)
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return the stored table."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            if (path := getattr(t, "_scratch_path", None)) is not None:
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Nodes that a task holds while it shortens its own edges.
LOCAL_NODES = 200_000


def _local_stars(most: int):
    """Edges of a partition as stars around the smallest node that they reach within it, portion by portion."""

    def stars(parent, root):
        nodes = [x for x in parent if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent[x]) != x:
                parent[x] = up = parent[up]
                x = up
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                parent.setdefault(u, u), parent.setdefault(v, v)
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                if len(parent) >= most:
                    yield stars(parent, root)
                    parent.clear()
        yield stars(parent, root)

    return run


def _settled(edges: DataFrame) -> bool:
    """Whether every node below another hangs on one node only, which hangs on none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("up")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("up")))).alias("e")).select("e.*")
    state = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.max(F.col("up").isNull()).alias("top"))
    return state.where("low <> high or (low is not null and top)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 50, one_task: int = LOCAL_NODES) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Each partition first turns its own edges into stars, at most ``one_task`` nodes at a time, without a shuffle. Then
    large-star and small-star steps alternate until all stars are whole: each only takes a minimum per node (combined before
    the shuffle) and one equi-join, so a hub with any number of neighbours is never gathered in one task. The path is the
    same for every number of edges. Null or looping edges are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    edges = scratch.keep(edges.mapInArrow(_local_stars(one_task), "u long, v long"))
    for _ in range(max_rounds):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        new = scratch.keep(small)
        scratch.drop(edges)
        edges = new
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
