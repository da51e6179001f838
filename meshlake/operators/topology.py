"""Iterative operators on the mesh graph: boundary rings, clusters, periodic copies."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.operators.mesh import Mesh, boundary_edges, centroids, elem_neighbours, elem_node, large, periodic_elems


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again, which cuts the lineage of an iteration.

    What is stored may hold a row for every cell, and its files are far smaller than its rows, so it is marked as ``large``.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        # one machine only: executors of a cluster do not share such a folder
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    path = f"{base.rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = large(spark.read.schema(df.schema).parquet(path))
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for t in tables:
        if (path := getattr(t, "_stored_path", None)) is not None:
            spark = t.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def ring_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, ring``: the smallest node that each node reaches along ``edges(n0, n1)``.

    Each round takes the smallest label among the neighbours and then the label of the label (pointer jumping), so long
    rings need a number of rounds that grows with the logarithm of their length.
    """
    both = edges.select(F.col("n0").alias("node"), F.col("n1").alias("other")).unionByName(edges.select(F.col("n1").alias("node"), F.col("n0").alias("other")))
    both = stored(both.distinct())
    labels = table = stored(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("ring")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("other"), F.col("ring").alias("r")), "other").groupBy("node").agg(F.min("r").alias("r"))
        hooked = labels.join(near, "node").select("node", "ring", F.least("ring", "r").alias("new"))
        # a label hands its own smaller label on: hook the label's node, then jump twice
        roots = hooked.groupBy(F.col("ring").alias("node")).agg(F.min("new").alias("root"))
        step = large(hooked).join(roots, "node", "left").select("node", "ring", F.least("new", F.coalesce("root", "new")).alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("up"))
        new = stored(large(step).join(jump, "new", "left").select("node", "ring", F.least("new", F.coalesce("up", "new")).alias("new")))
        discard(table)
        table, labels = new, new.select("node", F.col("new").alias("ring"))
        if new.where("new <> ring").isEmpty():
            discard(both)
            return labels
    raise RuntimeError("ring labels did not settle")


def _code(a: Column, b: Column) -> Column:
    """Two node numbers in one long, ordered as the pair is."""
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], by: str, salts: int = 16) -> DataFrame:
    """``rows`` with the columns of ``few``, which has one row per key; a key that holds most rows is dealt to ``salts`` tasks by ``by``."""
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def _with_fans(ends: DataFrame, elems: DataFrame) -> DataFrame:
    """``ends(at, to)`` with the fan of elements around ``at`` that the end borders on: contours that touch in a node have fans of their own.

    Only nodes with more than one fan are looked at; a fan is told by the smallest node on its rim.
    """
    several = stored(ends.groupBy("at").agg(F.count("*").alias("n")).where("n > 2").select(F.col("at").alias("node")))
    if several.isEmpty():
        return ends.withColumn("fan", F.lit(0).cast("long"))
    corner = lambda k: F.struct(F.col(f"n{k}").alias("node"), F.col(f"n{(k + 1) % 3}").alias("a"), F.col(f"n{(k + 2) % 3}").alias("b"))
    rim = elems.select(F.explode(F.array(*map(corner, range(3)))).alias("c")).select("c.*").join(several, "node", "left_semi")
    fans = ring_labels(rim.select(_code(F.col("node"), F.col("a")).alias("n0"), _code(F.col("node"), F.col("b")).alias("n1")))
    named = ends.withColumn("node", _code(F.col("at"), F.col("to"))).join(fans.withColumnRenamed("ring", "fan"), "node", "left")
    return named.select("at", "to", F.coalesce("fan", F.lit(0).cast("long")).alias("fan"))


def ring_order(edges: DataFrame, elems: DataFrame | None = None, max_rounds: int = 40) -> DataFrame:
    """``ring, loop, seq, node, n``: edges ``(n0, n1)`` chained into closed contours by list ranking.

    Every edge is taken in both directions. Where it arrives it is followed by the other edge of the same fan of ``elems``, or,
    without elements, by its neighbour in the order of the nodes. Pointers along these successors double in reach every
    round, and with them the smallest edge in reach and the number of steps to it, so a contour of any length is ordered by as
    many joins as its length has binary digits; nothing gathers a contour. A contour starts at its smallest node
    (``ring``), goes on to that node's smaller neighbour and has ``n`` edges; its last row, ``seq = n``, closes it. Further contours
    with the same smallest node have ``loop`` 1, 2 .. .
    """
    both = F.array(F.struct(F.col("n0").alias("at"), F.col("n1").alias("to")), F.struct(F.col("n1").alias("at"), F.col("n0").alias("to")))
    listed = stored(edges.select(F.explode(both).alias("e")).select("e.*"))
    ends = _with_fans(listed, elems) if elems is not None else listed.withColumn("fan", F.lit(0).cast("long"))
    w = Window.partitionBy("at").orderBy("fan", "to")
    partner = F.when(F.row_number().over(w) % 2 == 1, F.lead("to").over(w)).otherwise(F.lag("to").over(w))
    darts = ends.withColumn("partner", partner).select(_code(F.col("to"), F.col("at")).alias("dart"), _code(F.col("at"), F.col("partner")).alias("ptr"))
    state = table = stored(darts.select("dart", "ptr", F.col("dart").alias("key"), F.lit(0).cast("long").alias("ahead")))
    discard(listed)
    reach = 1
    for _ in range(max_rounds):
        there = state.select(F.col("dart").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("key").alias("key2"), F.col("ahead").alias("ahead2"))
        lower = F.col("key2") < F.col("key")
        new = stored(state.join(there, "ptr").select(
            "dart", F.col("ptr2").alias("ptr"), F.least("key", "key2").alias("key"), F.when(lower, F.col("ahead2") + reach).otherwise(F.col("ahead")).alias("ahead"), lower.alias("moved")
        ))
        discard(table)
        table, state, reach = new, new.drop("moved"), 2 * reach
        if new.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("contours did not settle")
    # of the two directions the one that starts with the smaller neighbour
    turned = state.select(_code(F.col("dart").bitwiseAND(0xFFFFFFFF), F.shiftright("dart", 32)).alias("dart"), F.col("key").alias("key2"))
    kept = large(state).join(turned, "dart").where("key < key2").select("dart", "key", "ahead")
    first = F.shiftright("key", 32).cast("int")
    heads = kept.groupBy("key").agg(F.count("*").cast("int").alias("n")).withColumn("ring", first)
    heads = stored(heads.withColumn("loop", F.row_number().over(Window.partitionBy("ring").orderBy("key")) - 1))
    rows = spread_join(kept, heads, ["key"], "dart").select("ring", "loop", F.expr("cast((n - ahead) % n as int)").alias("seq"), F.shiftright("dart", 32).cast("int").alias("node"), "n")
    return rows.unionByName(heads.select("ring", "loop", F.col("n").alias("seq"), F.col("ring").alias("node"), "n"))


def boundary_rings(mesh: Mesh) -> DataFrame:
    """``ring, loop, seq, node, n``: boundary edges chained into closed contours, see ``ring_order``."""
    return ring_order(boundary_edges(mesh.elems), mesh.elems)


#: Places of a contour that one task carries a value along.
SLICE = 65_536


def _carried(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows(keys.., seq, value)`` with missing values replaced by the last one before, or else by the last one of the whole key.

    Within slices of ``seq`` that is a window; from slice to slice only their last values are passed on.
    """
    sliced = rows.withColumn("_slice", F.expr(f"seq div {SLICE}"))
    last = sliced.groupBy(*keys, "_slice").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("seq"))).alias("_v"))
    over = Window.partitionBy(*keys).orderBy("_slice")
    before = F.last("_v", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    final = F.last("_v", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    given = last.select(*keys, "_slice", F.coalesce(before, final).alias("_v"))
    here = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "_slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return sliced.withColumn(value, here).join(given, [*keys, "_slice"]).withColumn(value, F.coalesce(value, "_v")).drop("_slice", "_v")


def closed_parts(rings: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ring, loop, part, seq, x, y``: contours as closed polygons within the borders of the map.

    ``rings`` is the result of ``ring_order``. The borders are the whole degrees around all longitudes of ``nodes``. A contour that
    does not jump over them is one polygon, part 0. Where it jumps, the points on both sides move to their border. If eastward and westward
    jumps take turns, the pieces on the western side make up part 1 and those on the eastern side part 2; both
    start behind the northernmost western crossing. If they do not, the contour goes round a pole: it stays
    one polygon, part 0, and every jump is led over the two corners at that pole. The last row of a polygon repeats the first; polygons of less than three
    points are left out. ``seq`` orders a polygon's rows and has gaps.

    Neighbours meet by an equi-join on the place along the contour, and sides are carried along in slices, so a contour is never in one task.
    """
    ring = ["ring", "loop"]
    frame = nodes.agg(F.floor(F.min("lon")).cast("double").alias("west"), F.ceil(F.max("lon")).cast("double").alias("east"))  # one row
    points = rings.where("seq < n").join(nodes.select("node", F.col("lon").alias("x"), F.col("lat").alias("y")), "node").drop("node")
    ahead = points.select(*ring, F.expr("(seq - 1 + n) % n").alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = stored(points.join(ahead, [*ring, "seq"]).withColumn("jump", F.expr("case when x - x2 > 180 then 1 when x2 - x > 180 then -1 end")))
    jumps = pairs.where("jump is not null")
    before = F.lag("jump").over(Window.partitionBy(*ring).orderBy("seq"))
    # the jumps of a contour are those of its edges on the border
    kinds = jumps.withColumn("before", before).groupBy(*ring).agg(
        (~F.coalesce(F.max(F.col("jump") == F.col("before")), F.lit(False)) & (F.min_by("jump", "seq") != F.max_by("jump", "seq"))).alias("cut"),
        F.max_by(F.expr("if(jump = 1, (seq + 1) % n, seq)"), F.expr("if(jump = 1, named_struct('y', y2, 's', (seq + 1) % n), named_struct('y', y, 's', seq))")).alias("start"),
    )
    whole = pairs.join(kinds, ring, "left_anti").select(*ring, F.lit(0).alias("part"), F.col("seq").cast("long").alias("seq"), "x", "y")
    crossing = spread_join(pairs, kinds, ring, "seq")
    came = crossing.where("jump is not null").select(*ring, F.expr("(seq + 1) % n").alias("seq"), F.col("jump").alias("came"))
    marked = crossing.join(came, [*ring, "seq"], "left")
    # a jump from the east leads to the west: what follows lies there
    marked = _carried(marked.withColumn("side", F.col("came")), ring, "side").join(F.broadcast(frame))
    border = F.expr("case when came = 1 or jump = -1 then west when came = -1 or jump = 1 then east end")
    marked = marked.withColumn("edge", F.coalesce(border, F.col("x")))
    cut = marked.where("cut").select(*ring, F.expr("if(side = 1, 1, 2)").alias("part"), F.expr("cast(4 * ((seq - start + n) % n) as long)").alias("seq"), F.col("edge").alias("x"), "y")
    corners = F.expr("""if(jump is null, array(struct(0 as i, edge as x, y as y)), array(struct(0 as i, edge as x, y as y),
        struct(1 as i, edge as x, if(y < 0 and y2 < 0, -90D, 90D) as y), struct(2 as i, if(jump = 1, west, east) as x, if(y < 0 and y2 < 0, -90D, 90D) as y)))""")
    polar = marked.where("not cut").withColumn("p", F.explode(corners)).select(*ring, F.lit(0).alias("part"), F.expr("cast(4 * seq + p.i as long)").alias("seq"), "p.x", "p.y")
    out = stored(whole.unionByName(cut).unionByName(polar))
    ends = out.groupBy(*ring, "part").agg(F.count("*").alias("size"), F.min_by(F.struct("x", "y"), "seq").alias("p"), (F.max("seq") + 1).alias("end")).where("size > 2")
    closing = ends.select(*ring, "part", F.col("end").alias("seq"), "p.x", "p.y")
    return spread_join(out, ends.select(*ring, "part"), [*ring, "part"], "seq").select(*closing.columns).unionByName(closing)


def split_rings(rings: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ring, part, seq, x, y``: contours cut where they cross the periodic boundary; pieces of three points or fewer go.

    A contour that crosses starts behind its first crossing, so that its end and its start are one piece; its closing point is
    left out. Pieces are not closed along the boundary, nor polar contours over the pole.
    """
    w = Window.partitionBy("ring").orderBy("seq")
    whole = Window.partitionBy("ring")
    rows = rings.select("ring", "seq", "node").join(nodes.select("node", F.col("lon").alias("x"), F.col("lat").alias("y")), "node")
    rows = rows.withColumn("jump", F.coalesce((F.abs(F.col("x") - F.lag("x").over(w)) > 180).cast("int"), F.lit(0)))
    rows = rows.withColumn("n", F.max("seq").over(whole)).withColumn("first", F.min(F.when(F.col("jump") == 1, F.col("seq"))).over(whole))
    # a jump to the closing point is one to the first point
    back = F.max(F.when(F.col("seq") == F.col("n"), F.col("jump"))).over(whole)
    rows = rows.withColumn("jump", F.when(F.col("seq") == 0, back).otherwise(F.col("jump"))).where("first is null or seq < n")
    rows = rows.withColumn("seq", F.expr("if(first is null, seq, pmod(seq - first, n))"))
    rows = rows.withColumn("part", (F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.when(F.col("first").isNull(), 0).otherwise(1)).cast("int"))
    size = F.count("*").over(Window.partitionBy("ring", "part"))
    return rows.withColumn("n", size).where("n > 3").select("ring", "part", "seq", "x", "y")


def elem_cluster(elems: DataFrame, seed: int, inside: DataFrame | None = None) -> DataFrame:
    """``elem``: what can be reached from a seed over shared edges, within ``inside(elem)``.

    Labels spread by pointer jumping, so a mesh of any extent takes a logarithmic number of rounds, where a flood fill would
    take as many as the mesh is wide.
    """
    links = elem_neighbours(elems).select(F.col("elem").alias("n0"), F.col("neighbour").alias("n1"))
    if inside is not None:
        for end in ("n0", "n1"):
            links = links.join(inside.select(F.col("elem").alias(end)), end, "left_semi")
    labels = large(ring_labels(links.select("n0", "n1")))
    own = labels.where(F.col("node") == seed).select("ring")  # one row
    found = labels.join(F.broadcast(own), "ring", "left_semi").select(F.col("node").cast("int").alias("elem"))
    return found.unionByName(elems.where(F.col("elem") == seed).select("elem")).distinct()


def periodic_augment(mesh: Mesh) -> tuple[DataFrame, DataFrame]:
    """``(nodes, elems)`` with elements across the periodic boundary doubled: once with their eastern nodes moved 360 degrees
    west, once with their western nodes moved east. New nodes are numbered behind the old ones, in their order."""
    crossing = elem_node(mesh.elems).join(periodic_elems(mesh), "elem", "left_semi").join(mesh.nodes.select("node", "lon"), "node")
    moved = crossing.select("node", "lon").distinct().select("node", F.when(F.col("lon") > 0, F.col("lon") - 360).otherwise(F.col("lon") + 360).alias("lon"))
    top = mesh.nodes.agg((F.max("node") + 1).alias("base"))
    # the boundary's nodes only: a line of the mesh
    fresh = moved.withColumn("i", F.row_number().over(Window.orderBy("node")) - 1).join(F.broadcast(top)).select(F.col("node").alias("old"), "lon", (F.col("base") + F.col("i")).cast("int").alias("node"))
    nodes = mesh.nodes.select("node", "lon", "lat").unionByName(fresh.join(mesh.nodes.select(F.col("node").alias("old"), "lat"), "old").select("node", "lon", "lat"))
    old = mesh.elems.join(periodic_elems(mesh), "elem", "left_anti").select("elem", "n0", "n1", "n2")
    cut = mesh.elems.join(periodic_elems(mesh), "elem", "left_semi").select("elem", "n0", "n1", "n2")

    def side(east: bool) -> DataFrame:
        out = cut
        for k in range(3):
            swap = fresh.where("lon < 0" if east else "lon > 0").select(F.col("old").alias(f"n{k}"), F.col("node").alias("to"))
            out = out.join(swap, f"n{k}", "left").withColumn(f"n{k}", F.coalesce("to", f"n{k}")).drop("to")
        return out.select("elem", "n0", "n1", "n2")

    return nodes, old.unionByName(side(True)).unionByName(side(False))


def basin_from_boxes(mesh: Mesh, inside: DataFrame) -> DataFrame:
    """``node`` of the basin within ``inside(elem)`` that holds its northernmost element: the cluster around that element."""
    north = elem_node(mesh.elems).join(inside, "elem", "left_semi").join(mesh.nodes.select("node", "lat"), "node").agg(F.min_by("elem", F.struct(-F.col("lat"), "elem")).alias("e")).first()["e"]
    if north is None:
        return elem_node(mesh.elems).limit(0).select("node")
    return elem_node(mesh.elems).join(elem_cluster(mesh.elems, north, inside), "elem", "left_semi").select("node").distinct()


def in_outline(points: DataFrame, outline: DataFrame, key: str, strip: float = 0.25) -> DataFrame:
    """``key`` of the ``points(key, x, y)`` within a closed line ``outline(x0, y0, x1, y1)`` of any number of edges, by crossing parity.

    Edges list the strips of latitude that they reach and meet the points of those strips by an equi-join; what is counted is combined
    before the shuffle. Half open in y.
    """
    edges = outline.where("y0 <> y1").withColumn("strip", F.explode(F.sequence(F.floor(F.least("y0", "y1") / strip), F.floor(F.greatest("y0", "y1") / strip))))
    hit = points.select(key, F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("y") / strip).alias("strip")).join(edges, "strip")
    crossed = F.expr("(y0 > py) <> (y1 > py) and px < x0 + (py - y0) * (x1 - x0) / (y1 - y0)")
    return hit.where(crossed).groupBy(key).agg(F.count("*").alias("n")).where("n % 2 = 1").select(key)


def ring_edges(rings: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ring, loop, seq, n0, n1, x0, y0, x1, y1`` of contours from ``ring_order``."""
    place = nodes.select("node", F.col("lon").alias("x0"), F.col("lat").alias("y0"))
    here = rings.join(place, "node").withColumnRenamed("node", "n0")
    there = here.where("seq > 0").select("ring", "loop", (F.col("seq") - 1).alias("seq"), F.col("n0").alias("n1"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    return here.where("seq < n").join(there, ["ring", "loop", "seq"]).select("ring", "loop", "seq", "n0", "n1", "x0", "y0", "x1", "y1")


def basin_in_outline(mesh: Mesh, inside: DataFrame) -> DataFrame:
    """``elem`` of ``inside(elem)`` within the outer contour of the part of the mesh that it makes up.

    The outer contour is the one that holds the northernmost boundary edge by the mean of its ends (ties: the first one by ``n1``, then ``n0``).
    Elements are tested by their plain centroid, so water bodies that the contour encloses belong to the basin.
    """
    part = stored(mesh.elems.join(inside, "elem", "left_semi"))
    sides = stored(ring_edges(ring_order(boundary_edges(part), part), mesh.nodes))
    north = F.struct((F.col("y0") + F.col("y1")) / 2, -F.greatest("n0", "n1"), -F.least("n0", "n1"))
    outer = sides.agg(F.max_by(F.struct("ring", "loop"), north).alias("r")).select("r.ring", "r.loop")  # one row
    outline = sides.join(F.broadcast(outer), ["ring", "loop"], "left_semi")
    return in_outline(centroids(Mesh(mesh.nodes, part, mesh.levels)), outline, "elem")
