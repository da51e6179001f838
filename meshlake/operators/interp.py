"""Vertical and horizontal interpolation as bracket joins and index arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.operators.mesh import Mesh, centroids, large

from meshlake.operators.windows import lerp


def interp_depth(field: DataFrame, levels: DataFrame, value: str, depths: list[float], by: list[str]) -> DataFrame:
    """``by.., z, value`` at the depths (negative numbers), linear between levels ``levels(k, z)``; outside: missing.

    Levels and depths are tens of rows, so the brackets are worked out first and broadcast: each field row meets only the
    depths that it takes part in, and a sum of two weighted rows gives the value without ordering a column.
    """
    w = Window.orderBy(F.desc("z"))
    steps = levels.select("k", "z", F.lead("k").over(w).alias("k1"), F.lead("z").over(w).alias("z1"))
    pairs = steps.withColumn("d", F.explode(F.array(*[F.lit(float(d)) for d in depths])))
    hit = pairs.where("(d <= z and d > z1) or (d = z and z1 is null)")
    share = F.when(F.col("z1").isNull(), 0.0).otherwise((F.col("z") - F.col("d")) / (F.col("z") - F.col("z1")))
    weights = hit.select("d", F.explode(F.array(F.struct("k", (1 - share).alias("share")), F.struct(F.col("k1").alias("k"), share.alias("share")))).alias("p")).select("d", "p.k", "p.share")
    weights = weights.where("k is not null and share > 0")
    joined = field.where(F.col(value).isNotNull()).join(F.broadcast(weights), "k")
    out = joined.groupBy(*by, "d").agg(F.sum(F.col(value) * F.col("share")).alias(value), F.sum("share").alias("whole"))
    return out.where("whole > 1 - 1e-9").select(*by, F.col("d").alias("z"), value)


def grid_to_cells(clim: DataFrame, cells: DataFrame, cell: str, value: str, *, x0: float, y0: float, dx: float, dy: float, nx: int, how: str = "linear") -> DataFrame:
    """``cell, value`` from a regular grid ``clim(ix, iy, value)`` (periodic in x) at ``cells(cell, lon, lat)``.

    ``nearest`` is one equi-join on the rounded index; ``linear`` explodes each cell to its four corners, one equi-join and
    one aggregate. Where a corner is missing the nearest grid point fills in.
    """
    gx, gy = (F.col("lon") - x0) / dx, (F.col("lat") - y0) / dy
    near = cells.select(cell, F.pmod(F.rint(gx).cast("int"), F.lit(nx)).alias("ix"), F.rint(gy).cast("int").alias("iy"))
    nearest = near.join(clim, ["ix", "iy"]).select(cell, value)
    if how == "nearest":
        return nearest
    if how != "linear":
        raise ValueError("how must be 'linear' or 'nearest'")
    bx, by = F.floor(gx).cast("int"), F.floor(gy).cast("int")
    fx, fy = gx - F.floor(gx), gy - F.floor(gy)
    corner = lambda a, b, w: F.struct(F.pmod(bx + a, F.lit(nx)).alias("ix"), (by + b).alias("iy"), w.alias("w"))
    corners = cells.select(cell, F.explode(F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)), corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy))).alias("c"))
    corners = corners.select(cell, "c.*").where("w > 0")
    linear = corners.join(clim, ["ix", "iy"]).where(F.col(value).isNotNull()).groupBy(cell).agg(F.sum(F.col(value) * F.col("w")).alias("v"), F.sum("w").alias("w")).where("w > 1 - 1e-9")
    return large(cells.select(cell)).join(linear, cell, "left").join(large(nearest), cell, "left").select(cell, F.coalesce("v", value).alias(value))


def topography(grid: DataFrame, mesh: Mesh, value: str, **axes) -> DataFrame:
    """``kind, cell, value`` of a regular grid, linear at the nodes (``node``) and at the centroids of the elements (``elem``).

    ``axes`` are those of ``grid_to_cells``; nodes and elements go through its join together.
    """
    at_node = mesh.nodes.select(F.lit("node").alias("kind"), "node", "lon", "lat").withColumnRenamed("node", "cell")
    # a centroid beside the periodic boundary may lie beyond the frame of the grid
    x = F.col("x") - F.floor((F.col("x") + 180) / 360) * 360
    at_elem = centroids(mesh, cyclic=True).select(F.lit("elem").alias("kind"), F.col("elem").alias("cell"), x.alias("lon"), F.col("y").alias("lat"))
    points = large(at_node.unionByName(at_elem)).withColumn("_at", F.struct("kind", "cell"))
    return grid_to_cells(grid, points.select("_at", "lon", "lat"), "_at", value, **axes).select("_at.kind", "_at.cell", value)


def extend_bottom(clim: DataFrame, n: int, by: list[str], value: str) -> DataFrame:
    """The last valid layer repeated ``n`` times below itself: ``by.., k, value``."""
    valid = clim.where(F.col(value).isNotNull())
    last = valid.groupBy(*by).agg(F.max_by(F.struct("k", value), "k").alias("s"))
    more = last.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n)))).select(*by, (F.col("s.k") + F.col("i")).cast("int").alias("k"), F.col(f"s.{value}").alias(value))
    return valid.select(*by, "k", value).unionByName(more)


def wrap_lon(lon: Column) -> Column:
    """Longitude in the frame of the mesh, -180 to 180."""
    return F.when(lon > 180, lon - 360).otherwise(lon)


def periodic_columns(grid: DataFrame, ix: str, nx: int) -> DataFrame:
    """A regular grid with its first and last column repeated outside the other end."""
    return grid.unionByName(grid.where(F.col(ix) == 0).withColumn(ix, F.lit(nx))).unionByName(grid.where(F.col(ix) == nx - 1).withColumn(ix, F.lit(-1)))


def isotherm_depth(column: DataFrame, level: float, by: list[str], temp: str = "temp", z: str = "z") -> DataFrame:
    """``by.., depth`` where a temperature is met: rows ordered by temperature, linear between neighbours.

    0 where nothing is as warm; the depth of the coldest row where all are warmer.
    """
    w = Window.partitionBy(*by).orderBy(temp, z)
    rows = column.where(F.col(temp).isNotNull()).withColumns({"t1": F.lead(temp).over(w), "z1": F.lead(z).over(w)})
    hit = F.when((F.col(temp) <= level) & (F.col("t1") > level), lerp(F.lit(level), F.col(temp), F.col("t1"), F.col(z), F.col("z1"))).when((F.col("t1").isNull()) & (F.col(temp) == level), F.col(z))
    out = rows.groupBy(*by).agg(F.max(hit).alias("hit"), F.max(temp).alias("warm"), F.min_by(z, F.struct(temp, z)).alias("cold"))
    return out.select(*by, F.when(F.col("warm") < level, 0.0).otherwise(F.coalesce("hit", "cold")).alias("depth"))


def triangles_to_grid(corners: DataFrame, values: DataFrame, value: str, *, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Barycentric interpolation to the points ``(x0 + ix dx, y0 + iy dy)``; triangles across the periodic boundary are left out.

    Each triangle lists the grid points of its bounding box, which replaces a spatial join; ``corners`` has ``lon0 .. lat2``.
    """
    x, y = [F.col(f"lon{k}") for k in range(3)], [F.col(f"lat{k}") for k in range(3)]
    t = corners.where(F.greatest(*x) - F.least(*x) < 180)
    for k in range(3):
        t = t.join(values.select(F.col("node").alias(f"n{k}"), F.col(value).alias(f"v{k}")), f"n{k}")
    span = lambda c, c0, d: (F.ceil((F.least(*c) - c0) / d), F.floor((F.greatest(*c) - c0) / d))
    (xl, xh), (yl, yh) = span(x, x0, dx), span(y, y0, dy)
    t = t.withColumns({"xl": xl, "xh": xh, "yl": yl, "yh": yh}).where("xl <= xh and yl <= yh")
    t = t.withColumn("ix", F.explode(F.sequence("xl", "xh"))).withColumn("iy", F.explode(F.sequence("yl", "yh")))
    px, py = F.col("ix") * dx + x0, F.col("iy") * dy + y0
    det = (y[1] - y[2]) * (x[0] - x[2]) + (x[2] - x[1]) * (y[0] - y[2])
    a = ((y[1] - y[2]) * (px - x[2]) + (x[2] - x[1]) * (py - y[2])) / det
    b = ((y[2] - y[0]) * (px - x[2]) + (x[0] - x[2]) * (py - y[2])) / det
    t = t.withColumns({"a": a, "b": b}).withColumn("c", 1 - F.col("a") - F.col("b")).where("a >= -1e-9 and b >= -1e-9 and c >= -1e-9")
    v = F.col("a") * F.col("v0") + F.col("b") * F.col("v1") + F.col("c") * F.col("v2")
    # a point on a shared side belongs to the element with the smallest number
    return t.groupBy("ix", "iy").agg(F.min_by(v, "elem").alias(value)).select((F.col("ix") * dx + x0).alias("lon"), (F.col("iy") * dy + y0).alias("lat"), value)


def bracket(points: DataFrame, curve: DataFrame, by: list[str], at: str, x: str, y: str, outside: float | None = 0.0) -> DataFrame:
    """``points`` with ``y`` of ``curve(by.., x, y)`` at ``at``: consecutive curve rows make half-open intervals, met per ``by``."""
    w = Window.partitionBy(*by).orderBy(x)
    steps = curve.select(*by, F.col(x).alias("_x0"), F.col(y).alias("_y0"), F.lead(x).over(w).alias("_x1"), F.lead(y).over(w).alias("_y1")).where("_x1 > _x0")
    hit = large(points).join(steps, by).where(F.col(at).between(F.col("_x0"), F.col("_x1")))
    value = F.max(lerp(F.col(at), F.col("_x0"), F.col("_x1"), F.col("_y0"), F.col("_y1"))).alias(y)
    found = hit.groupBy(*points.columns).agg(value)
    out = large(points).join(found, points.columns, "left")
    return out if outside is None else out.withColumn(y, F.coalesce(y, F.lit(outside)))


def classes_to_depths(section: DataFrame, density: DataFrame, depths: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by.., z, value`` of a section in density classes at ``depths(by.., z)``, by way of the depth of each class.

    ``section(by.., dens, value)`` and ``density(by.., z, rho)``: a class lies where its density is met, at 0 outside the
    profile and there without effect; values are linear between classes and missing outside them.
    """
    placed = bracket(section.select(*by, "dens", value), density.select(*by, "rho", F.col("z").alias("depth")), by, "dens", "rho", "depth")
    placed = placed.where("depth > 0").groupBy(*by, "depth").agg(F.min(value).alias(value))
    return bracket(depths.select(*by, "z"), placed, by, "z", "depth", value, outside=None)
