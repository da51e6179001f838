"""Mesh tables: geometry, weights and connectivity as joins and aggregates.

Tables (``levels`` counts full levels from 0 at the surface, depths are negative):
``nodes(node, lon, lat, n_iz)``, ``elems(elem, n0, n1, n2, e_iz)``, ``levels(k, zlev)``, ``edges(edge, n0, n1, tri_l, tri_r,
dx_l, dy_l, dx_r, dy_r)`` with a null ``tri_r`` on the boundary. ``*_iz`` is the index of the bottom full level; middle levels
``k <= iz - 1`` and full levels ``k <= iz`` hold values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.functions import expr


def large(df: DataFrame) -> DataFrame:
    """``df`` marked as a table that grows with the mesh or the field: the next join that it meets sorts and merges both sides.

    Exploded, aggregated and stored tables are estimated far below their size, and a join that trusts the estimate broadcasts
    millions of rows through the driver. The mark passes selections, explodes and aggregates and ends at the first join or union;
    ``F.broadcast`` of the other side goes before it.
    """
    return df.hint("merge")


@dataclass(frozen=True)
class Mesh:
    """The three tables of a mesh; ``derived`` holds what ``prepare`` has worked out and stored, by name."""

    nodes: DataFrame
    elems: DataFrame
    levels: DataFrame
    derived: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        for name in ("nodes", "elems"):
            object.__setattr__(self, name, large(getattr(self, name)))
        object.__setattr__(self, "derived", {name: large(df) for name, df in self.derived.items()})


def prepare(mesh: Mesh, path: str) -> Mesh:
    """The mesh with its derived tables written once below ``path``: corners, areas of elements and nodes, edges.

    All operators read these instead of joining the mesh again; each table is sorted by its key within files, so that pruning and merge
    joins find runs of keys. Existing tables of that path are replaced.
    """
    spark, derived = mesh.nodes.sparkSession, {}
    tables = {"nodes": ("node", mesh.nodes), "elems": ("elem", mesh.elems), "levels": ("k", mesh.levels)}
    for name, (key, df) in tables.items():
        df.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/{name}")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    base = Mesh(read("nodes"), read("elems"), read("levels"))
    for name, key, make in (("corners", "elem", corners), ("elem_area", "elem", elem_area), ("node_area", "node", node_area), ("node_area_flat", "node", lambda m: node_area(m, per_level=False)), ("edges", "n0", edge_geometry)):
        make(Mesh(base.nodes, base.elems, base.levels, derived)).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/{name}")
        derived = derived | {name: read(name)}
    return Mesh(base.nodes, base.elems, base.levels, derived)


def corners(mesh: Mesh) -> DataFrame:
    """``elems`` with longitude and latitude of the three nodes (``lon0 .. lat2``): three equi-joins."""
    if "corners" in mesh.derived:
        return mesh.derived["corners"]
    out = mesh.elems
    for k in range(3):
        out = out.join(mesh.nodes.select(F.col("node").alias(f"n{k}"), F.col("lon").alias(f"lon{k}"), F.col("lat").alias(f"lat{k}")), f"n{k}")
    return large(out)


def _cols(stem: str) -> list[Column]:
    return [F.col(f"{stem}{k}") for k in range(3)]


def elem_node(elems: DataFrame) -> DataFrame:
    """``elem, pos, node``: one row per corner."""
    return large(elems).select("elem", F.posexplode(F.array("n0", "n1", "n2")).alias("pos", "node"))


def centroids(mesh: Mesh, cyclic: bool = False) -> DataFrame:
    """``elem, x, y``: mean of the corners; with ``cyclic`` corners 180 degrees or more east of the westernmost shift first."""
    lon, lat = _cols("lon"), _cols("lat")
    if cyclic:
        low = F.least(*lon)
        lon = [F.when(c - low >= 180, c - 360).otherwise(c) for c in lon]
    return corners(mesh).select("elem", ((lon[0] + lon[1] + lon[2]) / 3).alias("x"), ((lat[0] + lat[1] + lat[2]) / 3).alias("y"))


def elem_area(mesh: Mesh) -> DataFrame:
    """``elem, area`` in square metres."""
    if "elem_area" in mesh.derived:
        return mesh.derived["elem_area"]
    return corners(mesh).select("elem", expr.triangle_area(_cols("lon"), _cols("lat")).alias("area"))


def elem_resolution(mesh: Mesh, how: str = "mean") -> DataFrame:
    """``elem, resol``: mean, max or min length of the three edges in metres."""
    if how not in ("mean", "max", "min"):
        raise ValueError("how must be 'mean', 'max' or 'min'")
    return elem_sides(mesh).select("elem", F.col(how).alias("resol"))


def elem_sides(mesh: Mesh) -> DataFrame:
    """``elem, mean, max, min`` of the lengths of the three edges in metres, from one pass over the corners."""
    x, y = _cols("lon"), _cols("lat")
    sides = [expr.side_length(x[a], y[a], x[b], y[b]) for a, b in ((0, 1), (1, 2), (2, 0))]
    return corners(mesh).select("elem", ((sides[0] + sides[1] + sides[2]) / 3).alias("mean"), F.greatest(*sides).alias("max"), F.least(*sides).alias("min"))


def node_area(mesh: Mesh, per_level: bool = True) -> DataFrame:
    """``node[, k], w_A``: a third of the area of the adjacent elements that hold water at level ``k``; 0 where none does.

    That is below the first level under the ice, ``e_ic``, where the mesh has cavities.
    """
    if (known := "node_area" if per_level else "node_area_flat") in mesh.derived:
        return mesh.derived[known]
    parts = elem_node(mesh.elems).join(elem_area(mesh), "elem")
    if not per_level:
        return large(parts.groupBy("node").agg((F.sum("area") / 3).alias("w_A")))
    top = F.coalesce(F.col("e_ic").cast("int"), F.lit(0)) if "e_ic" in mesh.elems.columns else F.lit(0)
    wet = parts.join(mesh.elems.select("elem", "e_iz", top.alias("top")), "elem")
    # an element's levels are a run, so they are expanded in place
    wet = wet.where("e_iz > top").withColumn("k", F.explode(F.sequence(F.col("top"), F.col("e_iz").cast("int") - 1)))
    area = wet.groupBy("node", "k").agg((F.sum("area") / 3).alias("w_A"))
    # one row of tens of level numbers
    numbers = mesh.levels.agg(F.sort_array(F.collect_list("k")).alias("ks"))
    grid = mesh.nodes.select("node").join(F.broadcast(numbers)).select("node", F.explode("ks").alias("k"))
    return large(grid.join(large(area), ["node", "k"], "left").withColumn("w_A", F.coalesce("w_A", F.lit(0.0))))


def node_resolution(mesh: Mesh, how: str = "area") -> DataFrame:
    """``node, resol``: diameter of the circle of the node's area, or the area-weighted mean of the elements' resolution."""
    if how == "area":
        return node_area(mesh, per_level=False).select("node", (2 * F.sqrt(F.col("w_A") / F.pi())).alias("resol"))
    if how != "elements":
        raise ValueError("how must be 'area' or 'elements'")
    parts = elem_node(mesh.elems).join(elem_area(mesh), "elem").join(elem_resolution(mesh), "elem")
    return parts.groupBy("node").agg((F.sum(F.col("area") * F.col("resol")) / F.sum("area")).alias("resol"))


def thickness(levels: DataFrame, full: bool = False) -> DataFrame:
    """``k, w_z``: layer thickness of middle levels, or of full levels (half layers at both ends)."""
    w = Window.orderBy("k")  # one row per model level
    zlev, below, above = F.col("zlev"), F.lead("zlev").over(w), F.lag("zlev").over(w)
    if not full:
        return levels.select("k", (zlev - below).alias("w_z")).where("w_z is not null")
    return levels.select("k", ((F.coalesce(above, zlev) - F.coalesce(below, zlev)) / 2).alias("w_z"))


def mid_levels(levels: DataFrame) -> DataFrame:
    """``k, zmid``: depth of the middle of each layer."""
    w = Window.orderBy("k")
    return levels.select("k", ((F.col("zlev") + F.lead("zlev").over(w)) / 2).alias("zmid")).where("zmid is not null")


def weights(field: DataFrame, mesh: Mesh, horizontal: bool = True, vertical: bool = False, full: bool = False) -> DataFrame:
    """``field(node, k, ..)`` with ``w_A`` and/or ``w_z``; level weights are one row per model level."""
    if horizontal:
        field = field.join(node_area(mesh), ["node", "k"], "left")
    if vertical:
        field = field.join(F.broadcast(thickness(mesh.levels, full)), "k")
    return field


def edge_table(elems: DataFrame) -> DataFrame:
    """``n0, n1, tri_l, tri_r``: distinct edges (``n0 < n1``) with their one or two elements."""
    pairs = large(elems).select("elem", F.explode(F.array(F.struct(F.col("n0").alias("a"), F.col("n1").alias("b")), F.struct(F.col("n1").alias("a"), F.col("n2").alias("b")), F.struct(F.col("n2").alias("a"), F.col("n0").alias("b")))).alias("e"))
    pairs = pairs.select("elem", F.least("e.a", "e.b").alias("n0"), F.greatest("e.a", "e.b").alias("n1"))
    out = pairs.groupBy("n0", "n1").agg(F.min("elem").alias("tri_l"), F.max("elem").alias("high"), F.count("*").alias("n"))
    return out.select("n0", "n1", "tri_l", F.when(F.col("n") > 1, F.col("high")).alias("tri_r"))


def boundary_edges(elems: DataFrame) -> DataFrame:
    """``n0, n1, elem``: edges that one element owns alone."""
    return edge_table(elems).where("tri_r is null").select("n0", "n1", F.col("tri_l").alias("elem"))


def node_elems(elems: DataFrame) -> DataFrame:
    """``node, elems``: sorted array of adjacent elements (about six)."""
    return elem_node(elems).groupBy("node").agg(F.sort_array(F.collect_list("elem")).alias("elems"))


def node_neighbours(elems: DataFrame) -> DataFrame:
    """``node, neighbour``: nodes that share an edge."""
    e = edge_table(elems)
    return large(e.select(F.col("n0").alias("node"), F.col("n1").alias("neighbour")).unionByName(e.select(F.col("n1").alias("node"), F.col("n0").alias("neighbour"))))


def elem_neighbours(elems: DataFrame) -> DataFrame:
    """``elem, neighbour``: elements that share an edge."""
    e = edge_table(elems).where("tri_r is not null")
    return large(e.select(F.col("tri_l").alias("elem"), F.col("tri_r").alias("neighbour")).unionByName(e.select(F.col("tri_r").alias("elem"), F.col("tri_l").alias("neighbour"))))


def periodic_elems(mesh: Mesh, cyclic: float = 360.0) -> DataFrame:
    """``elem`` of elements that reach across the periodic boundary."""
    lon = _cols("lon")
    return corners(mesh).where(F.greatest(*lon) - F.least(*lon) > cyclic * 2 / 3).select("elem")


def edge_geometry(mesh: Mesh) -> DataFrame:
    """``edges`` with cross-edge vectors in metres: from the edge's middle to the centroid of each side; a null right side is 0."""
    if "edges" in mesh.derived:
        return mesh.derived["edges"]
    ends = edge_table(mesh.elems)
    for k in range(2):
        ends = ends.join(mesh.nodes.select(F.col("node").alias(f"n{k}"), F.col("lon").alias(f"x{k}"), F.col("lat").alias(f"y{k}")), f"n{k}")
    mx, my = F.col("x0") + expr.wrap(F.col("x1") - F.col("x0")) / 2, (F.col("y0") + F.col("y1")) / 2
    out = ends.withColumns({"mx": mx, "my": my})
    lon, lat = _cols("lon"), _cols("lat")
    # corners relative to the first one, so that elements across the periodic boundary stay whole
    cx = lon[0] + (expr.wrap(lon[1] - lon[0]) + expr.wrap(lon[2] - lon[0])) / 3
    cent = corners(mesh).select("elem", cx.alias("cx"), ((lat[0] + lat[1] + lat[2]) / 3).alias("cy"))
    for side in "lr":
        named = cent.select(F.col("elem").alias(f"tri_{side}"), F.col("cx").alias(f"cx_{side}"), F.col("cy").alias(f"cy_{side}"))
        out = out.join(named, f"tri_{side}", "left")
        dx = expr.wrap(F.col(f"cx_{side}") - F.col("mx")) * F.cos(F.radians("my")) * expr.DEGREE
        dy = (F.col(f"cy_{side}") - F.col("my")) * expr.DEGREE
        out = out.withColumns({f"dx_{side}": F.coalesce(dx, F.lit(0.0)), f"dy_{side}": F.coalesce(dy, F.lit(0.0))})
    return large(out.select("n0", "n1", "tri_l", "tri_r", "x0", "y0", "x1", "y1", "dx_l", "dy_l", "dx_r", "dy_r"))


def reindex(elems: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep the nodes that are used and number them densely from 0 in their old order: ``(elems, nodes with old_node)``."""
    used = elem_node(elems).select("node").distinct()
    kept = large(nodes).join(used, "node", "left_semi")
    order = [c for c in kept.columns if c != "node"]
    numbered = large(_dense(kept))
    out = elems
    for k in range(3):
        out = out.join(numbered.select(F.col("node").alias(f"n{k}"), F.col("new").alias(f"m{k}")), f"n{k}").drop(f"n{k}").withColumnRenamed(f"m{k}", f"n{k}")
    return out.select(*elems.columns), numbered.select(F.col("new").alias("node"), F.col("node").alias("old_node"), *order)


def _dense(nodes: DataFrame, slice_size: int = 65536) -> DataFrame:
    """Dense numbers in the order of ``node``: ranks inside slices of the number range, plus the counts of lower slices."""
    sliced = nodes.withColumn("slice", F.expr(f"node div {slice_size}"))
    counts = sliced.groupBy("slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("slice", before.alias("before"))  # one row per slice
    rank = F.row_number().over(Window.partitionBy("slice").orderBy("node")) - 1
    return sliced.withColumn("r", rank).join(F.broadcast(counts), "slice").withColumn("new", (F.col("before") + F.col("r")).cast("int")).drop("slice", "r", "before")


def rows_in(a: DataFrame, b: DataFrame, per_column: bool = False) -> DataFrame:
    """Rows of ``b`` that are rows of ``a``, or, per column, whose every value occurs in that column of ``a``."""
    if not per_column:
        return b.join(a.distinct(), b.columns, "left_semi")
    out = b
    for c in b.columns:
        out = out.join(a.select(c).distinct(), c, "left_semi")
    return out.select(*b.columns)


def table_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """``key, diff``: value of ``a`` minus value of ``b`` where both have the key."""
    return a.join(b.select(key, F.col(value).alias("other")), key).select(key, (F.col(value) - F.col("other")).alias("diff"))
