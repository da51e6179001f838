"""Similarity join of documents on the Jaccard measure of their word n-grams: a grouped prefix join.

Method
    1. Every task counts its shingles in a table of ``ORDER_CELLS`` cells by hash; the tables of all tasks are added up, slice by
       slice. The cell's count stands for the frequency of a shingle (with an even background, above which frequent shingles
       rise), whatever the number of tasks. It only sets the order "rare first, frequent last": any order gives the same
       links, a good one few candidates. The table has a fixed size, so it can be sent to every task.
    2. Each document contributes its prefix under that order (the first ``n - ceil(t n) + 1`` shingles). Documents with the
       same prefix and size form one group, which is emitted once per window of a task. Buckets of a shingle with two
       groups or more are kept; buckets of frequent shingles are dealt out by a salt.
    3. Group pairs are filtered by size and by the position of their first common prefix shingle, expanded to their
       members (one per distinct set of shingles), filtered by an upper bound of the overlap that fixed-size histograms of
       the sets give, and verified on the whole sets.
    4. Stars come first: a pivot per bucket is compared with the bucket's other groups, which is linear in the bucket. What
       is then in one component needs no further comparison; pairs that still lie in different components are verified
       in full, so the components are those of all links.

Defined results
    Null or empty texts, and texts of white space only, have no shingles and stay alone. Repeated rows (equal doc_id) give
    one row; of several texts under one doc_id all take part, under the one id, and the largest set is counted. Rows with a
    null doc_id come back one by one, with their size and no component: they have no id by which a link could name them.
    An empty table gives an empty result. Texts of any length count whole; they are hashed in portions of ``CHUNK_BYTES`` or
    one text, and travel in Arrow batches bounded in bytes. Columns other than the two named ones are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlake.llm.common import Scratch, connected_components, release
from meshlake.llm.wordhash import U64, mix, shingle_sets

#: Cells of the table of frequencies (4 bytes each) and of one slice of it.
ORDER_CELLS, SLICE_CELLS = 1 << 22, 1 << 14
#: Shingles held by a task before it counts them, and prefix rows before it hands them on.
HELD, OUT_ROWS = 1 << 18, 1 << 16
#: Prefix rows after which a task forgets which groups it has emitted.
WINDOW = 1 << 22
#: Cells of a set's histogram, by which an upper bound of the overlap of two sets is known without their members.
CELLS = 256
#: Groups of a frequent shingle that one salt takes.
SALT_ROWS = 4096


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def _count_cells(size: int):
    def run(batches):
        table, held, rows, seen = np.zeros(ORDER_CELLS, np.uint32), [], 0, set()
        for batch in batches:
            for x in shingle_sets(batch.column(0), size):
                key = (len(x), int(x.sum(dtype=U64))) if len(x) else None
                if key is None or key in seen:
                    continue
                seen.add(key)
                held.append((x & U64(ORDER_CELLS - 1)).astype(np.int64))
                rows += len(x)
                if rows >= HELD:
                    np.add.at(table, np.concatenate(held), np.uint32(1))
                    held, rows, seen = [], 0, set()
        if held:
            np.add.at(table, np.concatenate(held), np.uint32(1))
        for k, part in enumerate(table.reshape(-1, SLICE_CELLS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["slice", "counts"])

    return run


def _add_slices(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
            sums[k] = sums[k] + part if k in sums else part
    for k, total in sums.items():
        raw = zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([raw], pa.binary())], ["slice", "counts"])


def frequency_table(texts: DataFrame, size: int) -> np.ndarray:
    """Counts of all shingles by cell of their hash; ``4 * ORDER_CELLS`` bytes reach the driver, whatever the input."""
    slices = ORDER_CELLS // SLICE_CELLS
    schema = "slice int, counts binary"
    # tables of a few tasks are added up before those of all, so no task reads a slice from everywhere
    near = texts.mapInArrow(_count_cells(size), schema).withColumn("few", F.spark_partition_id() % 32)
    first = near.repartition(slices, "slice", "few").select("slice", "counts").mapInArrow(_add_slices, schema)
    total = first.repartition(slices, "slice").mapInArrow(_add_slices, schema).toArrow()
    table = np.zeros(ORDER_CELLS, np.uint32).reshape(-1, SLICE_CELLS)
    for k, raw in zip(total.column("slice").to_pylist(), total.column("counts").to_pylist(), strict=True):
        table[k] = np.frombuffer(zlib.decompress(raw), np.uint32)
    return table.reshape(-1)


def _ordered_prefix(x: np.ndarray, table: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a sorted set, rare shingles first, and each one's count in the table."""
    take = len(x) - (-(-percent * len(x) // 100)) + 1
    count = table[(x & U64(ORDER_CELLS - 1)).astype(np.int64)]
    order = np.argsort(count, kind="stable")[:take]  # equal counts stay in the order of their hashes
    return x[order], count[order]


def _fold(x: np.ndarray, salt: int) -> int:
    """An order-free 64-bit hash of a set."""
    return int(mix(np.array([mix(x ^ U64(salt)).sum(dtype=U64) + U64(len(x))], dtype=U64)).view(np.int64)[0])


def _group_of(x: np.ndarray, prefix: np.ndarray) -> int:
    return _fold(np.append(prefix, U64(len(x))), 0x14057B7EF767814F)


def _members(shared, size: int, percent: int):
    def run(batches):
        table = shared.value
        for batch in batches:
            gid, sid, n = [], [], []
            for x in shingle_sets(batch.column("text"), size):
                n.append(len(x))
                gid.append(_group_of(x, _ordered_prefix(x, table, percent)[0]) if len(x) else None)
                sid.append(_fold(x, 0x5851F42D4C957F2D) if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(gid, pa.int64()), pa.array(sid, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "gid", "sid", "n"]
            )

    return run


def _prefix_rows(shared, size: int, percent: int):
    def run(batches):
        table = shared.value
        hot = SALT_ROWS + 2 * int(table.mean())
        seen, held = set(), 0
        for batch in batches:
            out, rows = [[], [], [], [], []], 0
            for x in shingle_sets(batch.column("text"), size):
                if not len(x):
                    continue
                prefix, count = _ordered_prefix(x, table, percent)
                weight = np.where(count > hot, count, 0)
                gid, k = _group_of(x, prefix), len(prefix)
                if gid in seen:
                    continue
                if held >= WINDOW:
                    seen, held = set(), 0
                seen.add(gid)
                held += k
                for c, v in zip(out, (prefix, np.full(k, gid, np.int64), np.full(k, len(x), np.int64), np.arange(k), weight), strict=True):
                    c.append(v)
                rows += k
                if rows >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([_i64(np.concatenate(c)) for c in out], ["token", "gid", "n", "pos", "often"])
                    out, rows = [[], [], [], [], []], 0
            if rows:
                yield pa.RecordBatch.from_arrays([_i64(np.concatenate(c)) for c in out], ["token", "gid", "n", "pos", "often"])

    return run


def _histograms(size: int):
    def run(batches):
        for batch in batches:
            hist = [np.bincount((x & U64(CELLS - 1)).astype(np.int64), minlength=CELLS) for x in shingle_sets(batch.column("text"), size)]
            n = [int(h.sum()) for h in hist]
            raw = [np.minimum(h, 65535).astype(np.uint16).tobytes() for h in hist]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], ["node", "n", "hist"])

    return run


def _may_link(percent: int):
    """Drop pairs whose histograms already show too small an overlap; a full cell (65535) bounds nothing."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, CELLS) for c in ("hist_a", "hist_b"))
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            both = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            keep = (most * (100 + percent) >= percent * both) | (x == 65535).any(axis=1) | (y == 65535).any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return run


def _verify(size: int, percent: int):
    def run(batches):
        for batch in batches:
            keep, last, before, left = [], None, None, None
            ids, texts = batch.column("a").to_pylist(), batch.column("left_text")
            for k, y in enumerate(shingle_sets(batch.column("right_text"), size)):
                if ids[k] != last or texts[k].as_py() != before:
                    left, last, before = next(iter(shingle_sets(texts.slice(k, 1), size))), ids[k], texts[k].as_py()
                small, large = (left, y) if len(left) <= len(y) else (y, left)
                if not len(small):
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                if 100 * both >= percent * (len(left) + len(y) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return run


def _linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole sets are similar enough; ``texts(node, text)``."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left_text"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right_text"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "left_text", "right_text")
    return both.mapInArrow(_verify(size, percent), "a long, b long")


class _Graph:
    """Links found so far, the components they make and the pairs that need no second look."""

    def __init__(self, links: DataFrame, texts: DataFrame, scratch: Scratch, size: int, percent: int):
        self.texts, self.scratch, self.size, self.percent = texts, scratch, size, percent
        sketched = texts.mapInArrow(_histograms(size), "node long, n long, hist binary")
        self.sketches = scratch.keep(sketched)
        self.links = scratch.keep(links)
        self.components = connected_components(self.links, scratch)
        self.tested: DataFrame | None = None

    def label(self, df: DataFrame, col: str, out: str) -> DataFrame:
        named = self.components.select(F.col("node").alias(col), F.col("component").alias(out))
        return df.join(named, col, "left").withColumn(out, F.coalesce(out, col))

    def add(self, pairs: DataFrame) -> None:
        pairs = self.scratch.keep(pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti"))
        x, y = (self.sketches.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("hist").alias(f"hist_{s}")) for s in "ab")
        likely = self.scratch.keep(pairs.join(x, "a").join(y, "b").mapInArrow(_may_link(self.percent), "a long, b long"))
        found = _linked(likely, self.texts, self.size, self.percent)
        old, self.links = self.links, self.scratch.keep(self.links.unionByName(found).distinct())
        self.scratch.drop(old)
        self.components = connected_components(self.links, self.scratch)
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        release(self.scratch.spark)


def _ordered(pairs: DataFrame) -> DataFrame:
    x, y = pairs.columns
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _star_pairs(graph: _Graph, buckets: DataFrame, turn: int, fits) -> DataFrame:
    """In each bucket that spans several components, the pivot of this turn with every group outside its component.

    The first pivot is the group with the smallest share of rarer shingles before the bucket's own: of a text and its edited
    copies that is the text itself, which the copies resemble more than they do one another. Later pivots are picked by hash.
    """
    named = graph.label(buckets, "rep", "c")
    order = F.col("pos") / F.col("n") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    pivots = (
        named.groupBy("token")
        .agg(F.min(F.struct(order, "rep", "c", "n", "pos")).alias("p"), F.min("c").alias("low"), F.max("c").alias("high"))
        .where("low < high")
        .select("token", F.col("p.rep").alias("pivot"), F.col("p.c").alias("pc"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos"))
    )
    return named.join(pivots, "token").where((F.col("c") != F.col("pc")) & fits).select("rep", "pivot").distinct()


def _open_pairs(graph: _Graph, buckets: DataFrame, nodes: DataFrame, mixed: DataFrame, fits) -> DataFrame:
    """Every pair of members that share a prefix shingle, pass the filters and lie in different components."""
    inside = graph.label(nodes.select("node", "rep").distinct(), "node", "c")
    spread = inside.groupBy("rep").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    named = buckets.join(spread, "rep")
    counts = named.groupBy("token", "lo").agg(F.count("*").alias("k"))
    major = counts.groupBy("token").agg(F.max(F.struct("k", "lo")).alias("m")).select("token", F.col("m.lo").alias("major"))
    named = graph.scratch.keep(named.join(major, "token").withColumn("minor", F.expr("lo <> hi or lo <> major")))
    left = named.where("minor").select("token", *(F.col(c).alias(f"p{c}") for c in ("rep", "n", "pos", "lo", "hi")))
    pairs = (
        left.join(named, "token")
        .where(F.expr("prep <> rep and (not minor or prep < rep) and (lo <> plo or lo <> hi or plo <> phi)") & fits)
        .select(F.least("prep", "rep").alias("a"), F.greatest("prep", "rep").alias("b"))
        .distinct()
        .unionByName(mixed.select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct())
    )
    return _ordered(
        pairs.join(inside.select(F.col("rep").alias("a"), F.col("node").alias("x"), F.col("c").alias("cx")), "a")
        .join(inside.select(F.col("rep").alias("b"), F.col("node").alias("y"), F.col("c").alias("cy")), "b")
        .where("cx <> cy")
        .select("x", "y")
    )


def jaccard_components(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 75,
    stars: int = 1,
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (see the module's text for nulls, ties and repeats).

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of ``size``-word shingles.
    """
    if not 0 < percent <= 100 or not 1 <= size <= 8:
        raise ValueError("percent must be in 1..100 and size in 1..8")
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(frequency_table(docs.select("text"), size))
    everyone = scratch.keep(docs.mapInArrow(_members(shared, size, percent), "doc_id long, gid long, sid long, n long"))
    members, docs = everyone.where("doc_id is not null"), docs.where("doc_id is not null")

    # node: the smallest doc_id with one set of shingles; rep: the smallest node of a group
    sets = members.where("sid is not null").groupBy("gid", "sid", "n").agg(F.min("doc_id").alias("node"))
    groups = sets.groupBy("gid").agg(F.min("node").alias("rep"), F.count("*").alias("k"))
    nodes = scratch.keep(sets.join(groups, "gid").select("node", "sid", "gid", "n", "rep", "k"))
    mixed = nodes.where("k > 1").select("node", "rep").distinct()

    rows = docs.select("text").mapInArrow(_prefix_rows(shared, size, percent), "token long, gid long, n long, pos long, often long")
    w = Window.partitionBy("token", "salt").orderBy("gid")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = (
        rows.withColumn("salt", F.expr(f"pmod(xxhash64(gid), greatest(1, ceil(often / {SALT_ROWS})))"))
        .withColumn("before", F.lag("gid").over(w))
        .withColumn("low", F.first("gid").over(whole))
        .withColumn("high", F.last("gid").over(whole))
        .where("(before is null or before <> gid) and (often > 0 or low <> high)")
        .select("token", "gid", "n", "pos")
    )
    reps = nodes.where("node = rep").select("gid", "rep").distinct()
    buckets = scratch.keep(buckets.join(reps, "gid").select("token", "rep", "n", "pos"))

    wanted = buckets.select(F.col("rep").alias("doc_id")).union(mixed.select("node")).distinct()
    texts = scratch.keep(docs.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text").distinct())

    release(spark)

    # several texts under one doc_id tie their sets together
    several = members.where("sid is not null").groupBy("doc_id").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).where("x <> y")
    same = members.join(several.select("doc_id"), "doc_id").join(nodes.select("sid", "node"), "sid").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    graph = _Graph(same.where("a <> b").distinct(), texts, scratch, size, percent)

    # sizes, and the overlap that is still possible from a common shingle on; at the first common one this bounds the whole
    fits = F.expr(f"100 * least(n, pn) >= {percent} * greatest(n, pn) and least(n - pos, pn - ppos) * {100 + percent} >= {percent} * (n + pn)")
    for turn in range(stars):
        pairs = _star_pairs(graph, buckets, turn, fits)
        graph.add(_ordered(pairs.union(mixed.where("node <> rep").select("node", "rep")) if turn == 0 else pairs))
    graph.add(_open_pairs(graph, buckets, nodes, mixed, fits))

    # one stored row per set that copies or links tie to another document; other documents need no label. Both sides of the
    # join are plain exchanges, so Spark splits a set with any number of copies over tasks
    copied = members.where("sid is not null").groupBy("sid").agg(F.count("*").alias("copies"))
    labels = graph.label(nodes.select("sid", "node").distinct(), "node", "component_id").groupBy("sid").agg(F.min("component_id").alias("component_id"), F.min("node").alias("node"))
    labels = scratch.keep(labels.join(copied, "sid").where("copies > 1 or node <> component_id").select("sid", "component_id"))
    out = members.join(labels, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    return out.unionByName(everyone.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
