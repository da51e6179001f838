"""Selections in space: boxes, polygons, basins, and edges that cross lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlake.operators.mesh import Mesh, centroids, elem_node, large


def boxes_to_regions(spark: SparkSession, boxes: dict[str, list]) -> DataFrame:
    """``region, part, seq, x, y``: closed rings of named rectangles ``[x0, x1, y0, y1]`` or polygons ``[[x..], [y..]]``."""
    rows = []
    for name, shape in boxes.items():
        if len(shape) == 4:
            x0, x1, y0, y1 = map(float, shape)
            ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        else:
            ring = [(float(x), float(y)) for x, y in zip(*shape, strict=True)]
        if ring[0] != ring[-1]:
            ring.append(ring[0])
        rows += [(name, 0, k, x, y) for k, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "region string, part int, seq int, x double, y double")


def rectangles(boxes: DataFrame) -> DataFrame:
    """``region, part, seq, x, y``: closed rings of a table of rectangles ``(region, x0, x1, y0, y1)`` of any size."""
    corners = (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))
    ring = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners))
    return boxes.select("region", F.lit(0).alias("part"), F.posexplode(ring).alias("seq", "p")).select("region", "part", "seq", "p.x", "p.y")


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive test against ``(x0, x1, y0, y1)``."""
    return x.between(box[0], box[1]) & y.between(box[2], box[3])


def elems_in_box(mesh: Mesh, box, how: str = "mid") -> DataFrame:
    """``elem`` with at least one (``soft``), two (``mid``) or three (``hard``) corners in the box."""
    least = {"soft": 1, "mid": 2, "hard": 3}
    if how not in least:
        raise ValueError(f"how must be one of {sorted(least)}")
    return corners_in_box(mesh, box).where(F.col("n") >= least[how]).select("elem")


def corners_in_box(mesh: Mesh, box) -> DataFrame:
    """``elem, n``: how many corners lie in the box, for elements with one or more."""
    inside = mesh.nodes.where(in_box(F.col("lon"), F.col("lat"), box)).select("node")
    return elem_node(mesh.elems).join(inside, "node").groupBy("elem").agg(F.count("*").alias("n"))


def rings(regions: DataFrame) -> DataFrame:
    """One row per part of a region: its edges as an array and its bounding box."""
    w = Window.partitionBy("region", "part").orderBy("seq")
    edges = regions.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w)}).where("x1 is not null")
    return edges.groupBy("region", "part").agg(
        F.collect_list(F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")).alias("ring"),
        F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("south"), F.max("y").alias("north"),
    )


def in_regions(points: DataFrame, regions: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """``key, region``: which regions each point lies in, by crossing parity, half open in y; parts are united.

    The regions are user input of a few rings; they are broadcast and met through their bounding boxes.
    """
    near = points.select(key, F.col(x).alias("px"), F.col(y).alias("py")).join(F.broadcast(rings(regions)), F.expr("px >= west and px <= east and py >= south and py <= north"))
    odd = F.expr("aggregate(ring, false, (odd, e) -> if((e.y0 > py) <> (e.y1 > py) and px < e.x0 + (py - e.y0) * (e.x1 - e.x0) / (e.y1 - e.y0), not odd, odd))")
    return large(near.where(odd).select(key, "region").distinct())


def in_large_regions(points: DataFrame, regions: DataFrame, key: str, x: str = "x", y: str = "y", strip: float = 0.25) -> DataFrame:
    """The result of ``in_regions`` for regions of any number of vertices: nothing is broadcast or gathered.

    Edges list the strips of latitude that they reach and meet the points of those strips by an equi-join.
    """
    w = Window.partitionBy("region", "part").orderBy("seq")
    edges = regions.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w)}).where("y1 is not null and y1 <> y")
    edges = edges.select("region", "part", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")
    edges = edges.withColumn("strip", F.explode(F.sequence(F.floor(F.least("y0", "y1") / strip), F.floor(F.greatest("y0", "y1") / strip))))
    near = points.select(key, F.col(x).alias("px"), F.col(y).alias("py"), F.floor(F.col(y) / strip).alias("strip")).join(edges, "strip")
    crossed = F.expr("(y0 > py) <> (y1 > py) and px < x0 + (py - y0) * (x1 - x0) / (y1 - y0)")
    return near.where(crossed).groupBy(key, "region", "part").agg(F.count("*").alias("n")).where("n % 2 = 1").select(key, "region").distinct()


def basin(mesh: Mesh, regions: DataFrame, name: str, exclude: str | None = None, on_elems: bool = False) -> DataFrame:
    """``node`` (or ``elem`` with any node) of a named basin, without those of another region."""
    nodes = in_regions(mesh.nodes, regions.where(F.col("region") == name), "node", "lon", "lat").select("node")
    if exclude is not None:
        nodes = nodes.join(in_regions(mesh.nodes, regions.where(F.col("region") == exclude), "node", "lon", "lat"), "node", "left_anti")
    return elem_node(mesh.elems).join(nodes, "node", "left_semi").select("elem").distinct() if on_elems else nodes


#: Basins that overturning is worked out for. Each is the union of regions of these names; an empty list stands for all nodes.
#: The last one takes what lies north of 65 degrees as well. Fixed values.
MOC_BASINS = {"gmoc": [], "amoc": ["amoc"], "pmoc": ["pmoc"], "ipmoc": ["ipmoc"], "imoc": ["imoc"], "aamoc": ["amoc"]}
ARCTIC = (-180.0, 180.0, 65.0, 90.0)


def moc_basin(mesh: Mesh, regions: DataFrame, which: str, exclude: str | None = None, on_elems: bool = True) -> DataFrame:
    """``elem`` (with any node) or ``node`` of a named basin, or of a region of that name, without the nodes of the region ``exclude``.

    For the whole ocean an element goes with any of its nodes in the excluded region; for a basin it stays as long as it has another node there.
    """
    corners = elem_node(mesh.elems)
    out = None if exclude is None else in_regions(mesh.nodes, regions.where(F.col("region") == exclude), "node", "lon", "lat").select("node")
    names = MOC_BASINS.get(which, [which])
    if not names:
        nodes = mesh.nodes.select("node")
        if on_elems:
            whole = mesh.elems.select("elem")
            return whole if out is None else whole.join(corners.join(out, "node", "left_semi").select("elem").distinct(), "elem", "left_anti")
    else:
        nodes = in_regions(mesh.nodes, regions.where(F.col("region").isin(names)), "node", "lon", "lat").select("node")
        if which == "aamoc":
            nodes = nodes.unionByName(mesh.nodes.where(in_box(F.col("lon"), F.col("lat"), ARCTIC)).select("node"))
        nodes = large(nodes.distinct())
    if out is not None:
        nodes = nodes.join(out, "node", "left_anti")
    return corners.join(large(nodes), "node", "left_semi").select("elem").distinct() if on_elems else nodes


def elems_in_regions(mesh: Mesh, regions: DataFrame) -> DataFrame:
    """``elem, region`` by the cyclic-corrected centroid."""
    return in_regions(centroids(mesh, cyclic=True), regions, "elem")


def region_edges(edges: DataFrame, mesh: Mesh, elems: DataFrame, buffer: bool = True) -> DataFrame:
    """Edges with a node of the given ``elems(elem)``, or of elements around them."""
    corners = elem_node(mesh.elems)
    nodes = corners.join(elems, "elem", "left_semi").select("node").distinct()
    if buffer:
        ring = corners.join(nodes, "node", "left_semi").select("elem").distinct()
        nodes = corners.join(ring, "elem", "left_semi").select("node").distinct()
    left = large(edges).join(nodes.withColumnRenamed("node", "n0"), "n0", "left_semi").select(*edges.columns)
    right = large(edges).join(nodes.withColumnRenamed("node", "n1"), "n1", "left_semi").select(*edges.columns)
    return left.unionByName(right).distinct()


def crossing_edges(edges: DataFrame, axis: str, first: float, step: float, last: float | None = None, guard: float | None = None) -> DataFrame:
    """``edges`` once per line ``bin = first + i * step`` that touches them; a node on a line counts for its edges.

    Each edge lists its own lines, so lines and edges meet without a range join. ``guard`` drops edges with an end that far
    from the line (those across the periodic boundary).
    """
    a, b = F.col(f"{axis}0"), F.col(f"{axis}1")
    lo, hi = F.ceil((F.least(a, b) - first) / step), F.floor((F.greatest(a, b) - first) / step)
    lo = F.greatest(lo, F.lit(0).cast("long"))
    if last is not None:
        hi = F.least(hi, F.lit(int((last - first) / step + 1e-9)).cast("long"))
    out = edges.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").withColumn("i", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    out = out.withColumn("bin", F.col("i") * step + first)
    return out if guard is None else out.where((F.abs(a - F.col("bin")) < guard) & (F.abs(b - F.col("bin")) < guard))


def drop_null_triangles(elems: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Elements none of whose nodes has a missing value."""
    bad = elem_node(elems).join(values.where(F.col(value).isNull()).select("node"), "node", "left_semi").select("elem").distinct()
    return large(elems).join(bad, "elem", "left_anti")
