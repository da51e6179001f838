"""Sections through the mesh: cut edges, paths, fluxes and scalars along a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlake.functions import expr
from meshlake.operators.mesh import Mesh, thickness

#: Tolerance of the position on an edge or segment.
EPS = 1.1920929e-07


def transects(spark: SparkSession, lines: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """``name, seg, x0, y0, x1, y1, nx, ny``: one row per segment with its unit normal, oriented.

    A segment whose bearing lies between -180 and -90 degrees is turned round; its normal points to the left of its course.
    """
    rows = [(name, k, *map(float, (xs[k], ys[k], xs[k + 1], ys[k + 1]))) for name, (xs, ys) in sorted(lines.items()) for k in range(len(xs) - 1)]
    raw = spark.createDataFrame(rows, "name string, seg int, a0 double, b0 double, a1 double, b1 double")
    flip = (F.col("a1") < F.col("a0")) & (F.col("b1") <= F.col("b0"))
    ends = raw.select("name", "seg", *(F.when(flip, F.col(p)).otherwise(F.col(q)).alias(r) for p, q, r in (("a1", "a0", "x0"), ("b1", "b0", "y0"), ("a0", "a1", "x1"), ("b0", "b1", "y1"))))
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    return ends.select("*", (-(F.col("y1") - F.col("y0")) / length).alias("nx"), ((F.col("x1") - F.col("x0")) / length).alias("ny"))


def cut_edges(lines: DataFrame, edges: DataFrame, pad: float = 10.0) -> DataFrame:
    """Edges that a segment cuts, in the order of their distance from its start.

    ``name, seg, rank, n0, n1, tri_l, tri_r, .., px, py, lint``: cut point and position on the edge. Segments are tens of rows and
    broadcast; a padded box goes first. Parallel edges are left out, as are edges across the periodic boundary.
    """
    e = edges.where(F.abs(F.col("x1") - F.col("x0")) < 180).withColumnsRenamed({"x0": "ex0", "y0": "ey0", "x1": "ex1", "y1": "ey1"})
    near = F.expr(
        f"least(ex0, ex1) >= least(x0, x1) - {pad} and greatest(ex0, ex1) <= greatest(x0, x1) + {pad} and least(ey0, ey1) >= least(y0, y1) - {pad} and greatest(ey0, ey1) <= greatest(y0, y1) + {pad}"
    )
    w = Window.partitionBy("name", "seg").orderBy("s", "n0", "n1")
    return _cuts(e.join(F.broadcast(lines), near)).withColumn("rank", F.row_number().over(w))


#: Degrees by which cells reach over their borders, so that cuts on a border are met.
MARGIN = 1e-4


def _with_cells(df: DataFrame, low: Column, high: Column, y: Column, size: float) -> DataFrame:
    """Rows once per cell between two longitudes in a band of latitude: ``cx`` round the globe, ``turn`` to undo that."""
    cells = F.sequence(F.floor((low - MARGIN) / size), F.floor((high + MARGIN) / size))
    out = df.withColumn("_c", F.explode(cells)).withColumn("cy", y)
    around = int(round(360 / size))
    return out.withColumn("cx", F.pmod("_c", F.lit(around))).withColumn("turn", F.floor(F.col("_c") / around)).drop("_c")


def cut_edges_by_cells(lines: DataFrame, edges: DataFrame, size: float = 10.0) -> DataFrame:
    """The result of ``cut_edges`` for lines and edges of any number, anywhere on the globe.

    A segment lists the cells of ``size`` degrees that it runs through, an edge those that it reaches, and both meet in
    equal cells; ``size`` divides 360. Longitudes are unwrapped on the way: an edge over the date line is one short edge, and segments may run past
    180 degrees. No box limits the edges, so long edges near the poles are found; ``px`` continues the longitudes of the segment.
    """
    band = lambda a, b: F.sequence(F.floor((F.least(a, b) - MARGIN) / size), F.floor((F.greatest(a, b) + MARGIN) / size))
    # the stretch of a segment within each band of latitude
    seg = lines.withColumn("_j", F.explode(band("y0", "y1")))
    at = lambda y: F.when(F.col("y1") == F.col("y0"), None).otherwise(F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    bottom = F.greatest(F.least("y0", "y1"), F.col("_j") * size - MARGIN)
    top = F.least(F.greatest("y0", "y1"), (F.col("_j") + 1) * size + MARGIN)
    a, b = F.coalesce(at(bottom), F.col("x0")), F.coalesce(at(top), F.col("x1"))
    seg = _with_cells(seg, F.least(a, b), F.greatest(a, b), F.col("_j"), size).drop("_j")
    e = edges.withColumnsRenamed({"x0": "ex0", "y0": "ey0", "x1": "ex1", "y1": "ey1"})
    e = e.withColumn("ex1", F.col("ex0") + expr.wrap(F.col("ex1") - F.col("ex0"))).withColumn("_j", F.explode(band("ey0", "ey1")))
    e = _with_cells(e, F.least("ex0", "ex1"), F.greatest("ex0", "ex1"), F.col("_j"), size).drop("_j").withColumnRenamed("turn", "eturn")
    both = e.join(seg, ["cx", "cy"]).withColumn("shift", (F.col("turn") - F.col("eturn")) * 360.0)
    both = both.withColumns({"ex0": F.col("ex0") + F.col("shift"), "ex1": F.col("ex1") + F.col("shift")}).drop("cx", "cy", "turn", "eturn")
    hit = _cuts(both).dropDuplicates(["name", "seg", "n0", "n1", "shift"]).drop("shift")
    w = Window.partitionBy("name", "seg").orderBy("s", "n0", "n1")
    return hit.withColumn("rank", F.row_number().over(w))


def _cuts(both: DataFrame) -> DataFrame:
    """Pairs of a segment and an edge that cut each other, with the places on both and the point."""
    det = F.expr("(x1 - x0) * (ey1 - ey0) - (y1 - y0) * (ex1 - ex0)")
    s = F.expr("((ex0 - x0) * (ey1 - ey0) - (ey0 - y0) * (ex1 - ex0))") / F.col("det")
    t = F.expr("((ex0 - x0) * (y1 - y0) - (ey0 - y0) * (x1 - x0))") / F.col("det")
    both = both.withColumn("det", det).where("abs(det) > 1e-12").withColumns({"s": s, "lint": t})
    hit = both.where((F.col("s") >= -EPS) & (F.col("s") <= 1 + EPS) & (F.col("lint") >= -EPS) & (F.col("lint") <= 1 + EPS))
    return hit.withColumns({"px": F.expr("ex0 + lint * (ex1 - ex0)"), "py": F.expr("ey0 + lint * (ey1 - ey0)")}).drop("det")


def path_distance(cuts: DataFrame) -> DataFrame:
    """``cuts`` with the running great-circle distance along each line in kilometres."""
    w = Window.partitionBy("name").orderBy("seg", "rank")
    step = F.when(F.lag("px").over(w).isNull(), 0.0).otherwise(F.greatest(F.lit(1.0), expr.sphere_distance(F.lag("px").over(w), F.lag("py").over(w), F.col("px"), F.col("py")) / 1000))
    return cuts.withColumn("step", step).withColumn("dist", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def transport_path(cuts: DataFrame) -> DataFrame:
    """Pieces of the path that the flow is measured on: from an edge's middle to the centroids on its sides.

    ``name, seg, rank, sub, elem, dx, dy``. Up the section comes the side behind the line, down the section the side ahead of
    it. The first edge has no piece behind, the last none ahead; the missing side of a boundary edge is a row without element.
    """
    w = Window.partitionBy("name", "seg")
    ahead = F.expr("dx_l * (x1 - x0) + dy_l * (y1 - y0) >= 0")
    order = F.row_number().over(w.orderBy("rank"))
    last = F.count("*").over(w)
    piece = lambda elem, dx, dy, sub: F.struct(F.lit(sub).alias("sub"), elem.alias("elem"), dx.alias("dx"), dy.alias("dy"))
    pick = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    behind = piece(pick("tri_r", "tri_l"), -pick("dx_r", "dx_l"), -pick("dy_r", "dy_l"), 0)
    front = piece(pick("tri_l", "tri_r"), pick("dx_l", "dx_r"), pick("dy_l", "dy_r"), 1)
    rows = cuts.withColumns({"i": order, "n": last}).withColumn("p", F.explode(F.array(behind, front))).where("(p.sub = 0 and i > 1) or (p.sub = 1 and i < n)")
    return rows.select("name", "seg", "rank", "nx", "ny", "p.*", "n0", "n1")


#: Density and heat capacity of sea water, and what turns a flux of each quantity into PW, kg/s and Sv. Fixed values.
RHO, HEAT_CAPACITY = 1030.0, 3850.0
FLUX_FACTORS = {"heat": RHO * HEAT_CAPACITY * 1e-15, "salt": RHO / 1000, "volume": 1e-6}


def _edge_means(path: DataFrame, field: DataFrame, nodes: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """``n0, n1, keys.., values..``: means over the two nodes of each edge of the path, missing below either bottom.

    ``keys`` are the levels and times of ``field(node, keys.., values..)``; the level is ``k``.
    """
    wet = field.join(nodes.select("node", "n_iz"), "node").where("k < n_iz").drop("n_iz")
    out = path.select("n0", "n1").distinct()
    for end in range(2):
        out = out.join(wet.select(F.col("node").alias(f"n{end}"), *keys, *(F.col(v).alias(f"{v}{end}") for v in values)), [f"n{end}"] if end == 0 else ["n1", *keys])
    return out.select("n0", "n1", *keys, *(((F.col(f"{v}0") + F.col(f"{v}1")) * 0.5).alias(v) for v in values))


def section_flux(
    path: DataFrame, velocity: DataFrame, mesh: Mesh, *, quantity: str = "volume", tracer: DataFrame | None = None, reference: float = 0.0, factor: float | None = None, inverse: bool = False, full: bool = False
) -> DataFrame:
    """``name, seg, rank, sub, [time,] k, flux``: what flows through each piece of the path at each level.

    ``velocity`` is given at elements ``(elem, [time,] k, u, v)``, masked by the bottom of the element, or at nodes
    ``(node, ..)``, which is less exact: the two nodes of the cut edge are averaged. With a ``tracer(node, [time,] k, value)``
    the flux carries the tracer's mean over the cut edge above ``reference``; pieces with a dry node have none. ``heat`` comes
    in PW, ``salt`` in kg/s and ``volume`` in Sv; ``factor`` sets another unit. ``full`` takes layers around full levels.
    """
    if quantity not in FLUX_FACTORS:
        raise ValueError(f"quantity must be one of {sorted(FLUX_FACTORS)}")
    if (quantity == "volume") != (tracer is None):
        raise ValueError("heat and salt need a tracer, volume takes none")
    keys = [c for c in ("time", "k") if c in velocity.columns]
    if "elem" in velocity.columns:
        wet = velocity.join(mesh.elems.select("elem", "e_iz"), "elem").where("k < e_iz").drop("e_iz")
        rows = path.where("elem is not null").join(wet, "elem")
    else:
        rows = path.join(_edge_means(path, velocity, mesh.nodes, ["u", "v"], keys), ["n0", "n1"])
    flux = (-F.col("u") * F.col("dy") + F.col("v") * F.col("dx")) * F.col("w_z")
    if tracer is not None:
        also = [c for c in ("time", "k") if c in tracer.columns]
        value = next(c for c in tracer.columns if c not in ("node", "time", "k"))
        carried = _edge_means(path, tracer.withColumnRenamed(value, "tracer"), mesh.nodes, ["tracer"], also)
        rows = rows.join(carried, ["n0", "n1", *(c for c in also if c in keys)])
        flux = flux * (F.col("tracer") - reference)
    scale = FLUX_FACTORS[quantity] if factor is None else factor
    rows = rows.join(F.broadcast(thickness(mesh.levels, full)), "k")
    return rows.select("name", "seg", "rank", "sub", *keys, (flux * (-scale if inverse else scale)).alias("flux"))


def signed_flux(flux: DataFrame, by: list[str]) -> DataFrame:
    """``by.., net, positive, negative`` of a section's flux."""
    v = F.col("flux")
    return flux.groupBy(*by).agg(F.sum(v).alias("net"), F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)).alias("positive"), F.coalesce(F.sum(F.when(v < 0, v)), F.lit(0.0)).alias("negative"))


def transect_transport(path: DataFrame, velocity: DataFrame, mesh: Mesh, *, factor: float = 1e-6, inverse: bool = False, by: tuple = ("name",), oriented: bool = False) -> DataFrame:
    """Volume transport ``(-u dy + v dx) dz`` through the path per ``by``, times ``factor``; ``inverse`` turns the sign.

    With ``oriented`` flow counts northward and eastward, whatever the course of a segment.
    """
    rows = path.where("elem is not null").join(velocity, "elem").join(F.broadcast(thickness(mesh.levels)), "k")
    flux = (-F.col("u") * F.col("dy") + F.col("v") * F.col("dx")) * F.col("w_z") * (-factor if inverse else factor)
    if oriented:
        flux = flux * flow_sign(F.col("nx"), F.col("ny"))
    return rows.select(*by, flux.alias("transport")).groupBy(*by).agg(F.coalesce(F.sum("transport"), F.lit(0.0)).alias("transport"))


def section_points(cuts: DataFrame) -> DataFrame:
    """The cut points of whole lines: the first one of a later segment stands where the segment before has ended, and goes."""
    return cuts.where("not (seg > 0 and rank = 1)")


def rotate_path(path: DataFrame, centroids: DataFrame, abg: tuple[float, float, float]) -> DataFrame:
    """``path`` with its vectors turned from the rotated grid to geographic directions at ``centroids(elem, lon, lat)``."""
    dx, dy = expr.rotate_vector(abg, F.col("lon"), F.col("lat"), F.col("dx"), F.col("dy"))
    return path.join(centroids, "elem").withColumns({"dx": dx, "dy": dy}).drop("lon", "lat")


def flow_sign(nx: Column, ny: Column) -> Column:
    """-1 where a normal points south, or due west; flow is counted north and east."""
    return F.when((ny < 0) | ((ny == 0) & (nx < 0)), -1.0).otherwise(1.0)


def transect_scalar(cuts: DataFrame, field: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``name, seg, rank, by.., value``: values of the edge's two nodes, linear at the cut point; missing if one is missing."""
    ends = [field.select(F.col("node").alias(f"n{k}"), *by, F.col(value).alias(f"v{k}")) for k in range(2)]
    rows = cuts.select("name", "seg", "rank", "n0", "n1", "lint").join(ends[0], "n0").join(ends[1], ["n1", *by])
    return rows.select("name", "seg", "rank", *by, (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("lint")).alias(value))


def with_land_points(cuts: DataFrame) -> DataFrame:
    """Between two boundary cuts in a row two rows with null cut points mark the land: ``sub`` 0 is the cut, 1 and 2 the marks."""
    w = Window.partitionBy("name", "seg").orderBy("rank")
    bound = F.col("tri_r").isNull()
    gap = bound & F.coalesce(F.lead(bound).over(w), F.lit(False))
    rows = cuts.withColumn("gap", gap).withColumn("sub", F.explode(F.expr("if(gap, array(0, 1, 2), array(0))")))
    return rows.select("name", "seg", "rank", "sub", *(F.when(F.col("sub") == 0, F.col(c)).alias(c) for c in ("px", "py", "lint")))
