"""Overturning, heat transport and stream functions: the composite diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlake.operators.mesh import Mesh, elem_area, elem_node, large, node_area, thickness
from meshlake.operators.reduce import edge_sides, lat_bin_sum
from meshlake.operators.regions import crossing_edges
from meshlake.operators.windows import cumulate

#: Reference density in kg/m3 and heat capacity in J/(kg K). Fixed values.
RHO0, CP = 1030.0, 3850.0
SV, PW = 1e-6, 1e-15


def zmoc(field: DataFrame, mesh: Mesh, cells: DataFrame | None = None, *, value: str = "w", dlat: float = 1.0, by: tuple = ("k",), on_elems: bool = False) -> DataFrame:
    """Overturning in depth space in Sv, ``by.., lat, moc``: vertical transport per latitude bin, summed from north, negated.

    ``field(by.., node, value)``; ``cells`` restricts to a basin (``node``, or ``elem`` with ``on_elems``). On elements the
    values are means of the corners (missing: 0) above the bottom interface, weighted with the element's area.
    """
    by = list(by)
    if on_elems:
        joined = elem_node(mesh.elems).join(field, "node").groupBy("elem", *by).agg((F.coalesce(F.sum(value), F.lit(0.0)) / 3).alias(value))
        place = elem_node(mesh.elems).join(mesh.nodes.select("node", "lat"), "node").groupBy("elem").agg(F.avg("lat").alias("lat"))
        rows = joined.join(mesh.elems.select("elem", "e_iz"), "elem").where("k < e_iz").join(elem_area(mesh).withColumnRenamed("area", "w_A"), "elem").join(large(place), "elem")
        key = "elem"
    else:
        rows = field.join(mesh.nodes.select("node", "lat"), "node").join(node_area(mesh), ["node", "k"])
        key = "node"
    if cells is not None:
        rows = rows.join(large(cells.select(key).distinct()), key, "left_semi")
    sums = lat_bin_sum(rows, F.col(value) * F.col("w_A") * SV, dlat, by, "moc")
    return cumulate(sums, "lat", "moc", by, descending=True, negate=True)


def dmoc_inputs(fluxes: DataFrame, classes: DataFrame, area: DataFrame, mesh: Mesh, terms: list[str], plain: tuple = ()) -> DataFrame:
    """Transformation terms ``(node, nd, terms..)`` on elements, ``elem, nd, terms..``: per node area, averaged, times element area.

    Surface terms are fluxes per class width times 1024; all terms come in one table, so their union of keys is one aggregate.
    Columns named in ``plain`` go the same way as mere means over the corners; with them comes the element's ``area``.
    """
    rows = fluxes.join(F.broadcast(classes.select("nd", "w_dens")), "nd").join(large(area), "node")
    rows = rows.select("node", "nd", *((F.col(t) / F.col("w_A") * (1024 / F.col("w_dens") if t.startswith("srf") else F.lit(1.0))).alias(t) for t in terms), *plain)
    means = elem_node(mesh.elems).join(rows, "node").groupBy("elem", "nd").agg(*(F.avg(t).alias(t) for t in [*terms, *plain]))
    more = [*plain, "area"] if plain else []
    return large(means.join(elem_area(mesh), "elem").select("elem", "nd", *((F.col(t) * F.col("area")).alias(t) for t in terms), *more))


def dmoc(inputs: DataFrame, place: DataFrame, terms: list[str], dlat: float = 1.0) -> DataFrame:
    """Overturning in density space in Sv per ``lat, nd``: sums per bin, from north; ``div`` terms also from dense to light."""
    rows = large(inputs).join(large(place), "elem")
    bins = rows.withColumn("lat", F.rint(F.col("lat") / dlat) * dlat).groupBy("lat", "nd").agg(*((F.coalesce(F.sum(t), F.lit(0.0)) * SV).alias(t) for t in terms))
    for t in terms:
        bins = cumulate(bins, "lat", t, ["nd"], descending=True, negate=True)
        if t.startswith("div"):
            bins = cumulate(bins, "nd", t, ["lat"], descending=True)
    return bins


def density_bins(inputs: DataFrame, place: DataFrame, terms: list[str], means: list[str], dlat: float) -> DataFrame:
    """``lat, nd``: sums of ``terms`` in Sv, and means of ``means`` weighted by ``w_A`` over the elements where the class is there (``h`` is not 0).

    Latitudes are dense from the lowest to the highest bin; sums of empty bins are 0 and their means missing.
    """
    rows = large(inputs).join(large(place), "elem").withColumn("i", F.rint(F.col("lat") / dlat).cast("int"))
    there = F.when(F.col("h") != 0, F.col("w_A"))
    sums = rows.groupBy("i", "nd").agg(*(F.coalesce(F.sum(t) * SV, F.lit(0.0)).alias(t) for t in terms), *(F.try_divide(F.sum(F.col(m) * there), F.sum(there)).alias(m) for m in means))
    ends = sums.agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    grid = sums.select("nd").distinct().join(F.broadcast(ends)).select("nd", F.explode(F.sequence("lo", "hi")).alias("i"))
    out = grid.join(sums, ["nd", "i"], "left")
    return out.select((F.col("i") * dlat).alias("lat"), "nd", *(F.coalesce(t, F.lit(0.0)).alias(t) for t in terms), *means)


def density_overturning(inputs: DataFrame, place: DataFrame, *, dlat: float = 1.0, bolus: bool = True) -> DataFrame:
    """Overturning and transformations in density space in Sv: ``lat, nd, moc, fh, fw, fr, srf, inner, h, z, z_top``.

    ``inputs(elem, nd, fh, fw, fr, div, bolus, h, z, w_A)`` are surface terms of heat, fresh water and restoring and divergences, times the
    element's area, and thickness and depth of the class. Sums run from north, negated; the divergences also from dense to light.
    ``moc`` has the bolus part unless told otherwise, ``srf`` is minus the sum of the surface terms, ``inner`` is ``moc`` plus that sum,
    and ``z_top`` the depth of a class from the thickness of those above.
    """
    terms = ["fh", "fw", "fr", "div", "bolus"]
    bins = density_bins(inputs, place, terms, ["h", "z"], dlat)
    for t in terms:
        bins = cumulate(bins, "lat", t, ["nd"], descending=True, negate=True)
    for t in ("div", "bolus"):
        bins = cumulate(bins, "nd", t, ["lat"], descending=True)
    bins = cumulate(bins.withColumn("z_top", F.col("h")), "nd", "z_top", ["lat"], exclusive=True)
    moc = F.col("div") + F.col("bolus") if bolus else F.col("div")
    surface = F.col("fh") + F.col("fw") + F.col("fr")
    return bins.select("lat", "nd", moc.alias("moc"), "fh", "fw", "fr", (-surface).alias("srf"), (moc + surface).alias("inner"), "h", "z", "z_top")


def diapycnal(inputs: DataFrame, classes: DataFrame, term: str, dens: float) -> DataFrame:
    """``elem, w``: sum of a term from the densest class to the one nearest to ``dens``."""
    chosen = classes.agg(F.min_by("nd", F.struct(F.abs(F.col("dens") - dens), "nd")).alias("first"))
    return inputs.join(F.broadcast(chosen), F.col("nd") >= F.col("first")).groupBy("elem").agg(F.sum(term).alias("w"))


def surface_transformation(inputs: DataFrame, classes: DataFrame, term: str, dens: float) -> DataFrame:
    """``elem, srf``: minus a surface term in the class nearest to ``dens``."""
    chosen = classes.agg(F.min_by("nd", F.struct(F.abs(F.col("dens") - dens), "nd")).alias("nd"))
    return inputs.join(F.broadcast(chosen), "nd").select("elem", (-F.col(term)).alias("srf"))


def heat_from_surface(flux: DataFrame, dlat: float, *, truncate: bool = False, by: tuple = ()) -> DataFrame:
    """Heat transport in PW from surface fluxes ``(by.., lat, w_A, value)``: binned, summed from south, negated.

    ``truncate`` bins toward zero and leaves the last bin out; otherwise bins are rounded half to even.
    """
    by = list(by)
    raw = F.col("lat") / dlat
    i = F.when(raw >= 0, F.floor(raw)).otherwise(F.ceil(raw)) if truncate else F.rint(raw)
    sums = flux.withColumn("lat", i * dlat).groupBy(*by, "lat").agg((F.coalesce(F.sum(F.col("value") * F.col("w_A")), F.lit(0.0)) * PW).alias("heat"))
    if truncate:
        sums = sums.join(F.broadcast(sums.agg(F.max("lat").alias("end"))), F.col("lat") < F.col("end")).drop("end")
    return cumulate(sums, "lat", "heat", by, negate=True)


def _crossed(edges: DataFrame, axis: str, first: float, step: float, last: float | None, guard: float | None, extra: list[str]) -> DataFrame:
    """Sides of crossed edges with signed normals: ``bin, elem, a, b`` so that ``u a + v b`` is the flux through the line.

    Cross-edge vectors turn into normals: the eastward part of the left side and the northward part of the right side change
    sign, all of them where the edge starts at or below the line.
    """
    rows = edge_sides(crossing_edges(edges, axis, first, step, last, guard), ["bin", f"{axis}0", *extra])
    turn = F.when(F.col(f"{axis}0") <= F.col("bin"), -1.0).otherwise(1.0)
    left = F.col("side") == 0
    return rows.select("n0", "n1", "bin", "elem", *extra, (turn * F.when(left, F.col("dy")).otherwise(-F.col("dy"))).alias("a"), (turn * F.when(left, -F.col("dx")).otherwise(F.col("dx"))).alias("b"))


def crossed_heat(velocity: DataFrame, temp: DataFrame, edges: DataFrame, mesh: Mesh, axis: str, *, first: float, step: float, last: float | None = None, guard: float | None = None) -> DataFrame:
    """Heat transport in PW through lines of constant latitude (``y``) or longitude (``x``): ``bin, heat``.

    ``velocity(elem, k, u, v)``, ``temp(node, k, temp)``. Edges are few next to the fields, so they are cut first and the
    fields are gathered at the edges by equi-joins. A missing right side or value adds nothing.
    """
    sides = _crossed(edges, axis, first, step, last, guard, []).where("elem is not null")
    ends = [large(temp).select(F.col("node").alias(f"n{k}"), "k", F.col("temp").alias(f"t{k}")) for k in range(2)]
    rows = sides.join(large(velocity), "elem").join(ends[0], ["n0", "k"]).join(ends[1], ["n1", "k"]).join(F.broadcast(thickness(mesh.levels)), "k")
    flux = (F.col("u") * F.col("a") + F.col("v") * F.col("b")) * (F.col("t0") + F.col("t1")) * 0.5 * F.col("w_z")
    return rows.groupBy("bin").agg((F.coalesce(F.sum(flux), F.lit(0.0)) * (-RHO0 * CP * PW)).alias("heat"))


def barotropic_streamfunction(velocity: DataFrame, edges: DataFrame, mesh: Mesh, *, lon0: float, dlon: float, nlon: int, lat0: float, dlat: float, nlat: int) -> DataFrame:
    """Barotropic stream function in Sv on ``nlon`` lines of longitude and ``nlat`` bins of latitude: ``lon, lat, psi``.

    Bins are closed on the right; empty ones count as 0. Sums run from south to north, negated; the northernmost value of a
    line is taken off; the first and last line repeat their neighbours.
    """
    sides = _crossed(edges, "x", lon0 + dlon / 2, dlon, lon0 + dlon * (nlon - 0.5), 50.0, ["y0", "y1"]).where("elem is not null")
    sides = sides.withColumn("iy", (F.ceil(((F.col("y0") + F.col("y1")) / 2 - lat0) / dlat) - 1).cast("int")).where(F.col("iy").between(0, nlat - 1))
    sides = sides.withColumn("ix", F.rint((F.col("bin") - lon0) / dlon - 0.5).cast("int"))
    rows = sides.join(large(velocity), "elem").join(F.broadcast(thickness(mesh.levels)), "k")
    flux = (F.col("u") * F.col("a") + F.col("v") * F.col("b")) * F.col("w_z")
    sums = rows.groupBy("ix", "iy").agg((F.coalesce(F.sum(flux), F.lit(0.0)) * -SV).alias("psi"))
    spark = velocity.sparkSession
    grid = spark.range(nlon * nlat).select((F.col("id") % nlon).cast("int").alias("ix"), F.expr(f"cast(id div {nlon} as int)").alias("iy"))
    psi = cumulate(grid.join(sums, ["ix", "iy"], "left").withColumn("psi", F.coalesce("psi", F.lit(0.0))), "iy", "psi", ["ix"], negate=True)
    whole = Window.partitionBy("ix").orderBy("iy").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    psi = psi.withColumn("psi", F.col("psi") - F.last("psi").over(whole))
    line = Window.partitionBy("iy").orderBy("ix")
    ends = F.when(F.col("ix") == 0, F.lead("psi").over(line)).when(F.col("ix") == nlon - 1, F.lag("psi").over(line)).otherwise(F.col("psi"))
    return psi.select((F.lit(lon0) + (F.col("ix") + 0.5) * dlon).alias("lon"), (F.lit(lat0) + (F.col("iy") + 0.5) * dlat).alias("lat"), ends.alias("psi"))


def bottom_by_latitude(elems: DataFrame, place: DataFrame, levels: DataFrame, dlat: float = 1.0) -> DataFrame:
    """``lat, botmax, botmean, botmaxi``: deepest and mean bottom depth and the deepest bottom level of the elements of a bin."""
    rows = elems.select("elem", "e_iz").join(large(place.select("elem", "lat")), "elem").join(F.broadcast(levels.select(F.col("k").alias("e_iz"), F.abs("zlev").alias("z"))), "e_iz")
    return rows.groupBy((F.rint(F.col("lat") / dlat) * dlat).alias("lat")).agg(F.max("z").alias("botmax"), F.avg("z").alias("botmean"), F.max("e_iz").alias("botmaxi"))
