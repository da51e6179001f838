"""Filters, reductions and gathers on fields ``(time, cell, k, values ..)``; missing values are NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.functions import expr
from meshlake.operators.mesh import Mesh, elem_area, elem_node, large, mid_levels

STATISTICS = {
    "mean": F.avg, "median": F.median, "std": F.stddev_pop, "var": F.var_pop, "max": F.max, "min": F.min,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
}


def statistic(how: str, value: str) -> Column:
    if how not in STATISTICS:
        raise ValueError(f"how must be one of {sorted(STATISTICS)}")
    return STATISTICS[how](F.col(value)).alias(value)


def reduce_many(field: DataFrame, hows: list[str], value: str, by: list[str]) -> DataFrame:
    """``by.., mean, std ..``: several statistics of one value in one aggregation, each in a column of its name."""
    return field.groupBy(*by).agg(*(statistic(how, value).alias(how) for how in hows))


def select_time(field: DataFrame, months: list[int] | None = None, days: list[int] | None = None, record: int | None = None, *, empty_keeps_all: bool = True) -> DataFrame:
    """Rows of the given months, days of the month, or of the n-th distinct time (from 0), which overrides the others.

    With ``empty_keeps_all`` a list that no row fits is passed over; whether one does is part of the plan, not worked out beforehand.
    """
    if record is not None:
        times = field.select("time").distinct().orderBy("time").limit(record + 1)
        # the n-th time is the last of the first n + 1; a scalar, met by a broadcast of one row
        last = times.agg(F.max("time").alias("time"), F.count("*").alias("n")).where(F.col("n") == record + 1).select("time")
        return field.join(F.broadcast(last), "time", "left_semi")
    for chosen, part in ((months, F.month("time")), (days, F.dayofmonth("time"))):
        if chosen and empty_keeps_all:
            fits = field.agg(F.coalesce(F.max(part.isin(chosen)), F.lit(False)).alias("_fits"))  # one row
            field = field.join(F.broadcast(fits)).where(part.isin(chosen) | ~F.col("_fits")).drop("_fits")
        elif chosen:
            field = field.where(part.isin(chosen))
    return field


def keep_where(field: DataFrame, condition: Column, values: list[str] | None = None) -> DataFrame:
    """Rows that meet a condition, or, with ``values``, all rows with those columns missing where it is not met."""
    if values is None:
        return field.where(condition)
    return field.withColumns({v: F.when(condition, F.col(v)) for v in values})


def extremes(df: DataFrame, by: list[str], **parts: tuple[str, str, Column]) -> DataFrame:
    """``by..`` and one column per part ``name=(how, value, condition)``: the ``max`` or ``min`` of a value among the rows that meet a condition."""
    if bad := [how for how, _, _ in parts.values() if how not in ("max", "min")]:
        raise ValueError(f"how must be 'max' or 'min', not {bad[0]!r}")
    take = {"max": F.max, "min": F.min}
    return df.groupBy(*by).agg(*(take[how](F.when(condition, F.col(value))).alias(name) for name, (how, value, condition) in parts.items()))


def distinct_counts(df: DataFrame, **columns: Column | str) -> DataFrame:
    """One row with the number of distinct values of each named column or expression."""
    return df.agg(*(F.count_distinct(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()))


def level_bracket(levels: DataFrame, depths: list[float], nearest: bool = False) -> DataFrame:
    """``k`` of the levels around each depth (negative numbers), or of the nearest level. ``levels(k, z)``."""
    wanted = F.explode(F.array(*[F.lit(float(d)) for d in depths]))
    pairs = levels.select("k", "z", wanted.alias("d"))  # levels times requested depths: tens of rows
    if nearest:
        return pairs.groupBy("d").agg(F.min_by("k", F.struct(F.abs(F.col("z") - F.col("d")), "k")).alias("k")).select("k").distinct()
    w = Window.orderBy("z")
    lower = levels.select("k", "z", F.lead("k").over(w).alias("k_up"), F.lead("z").over(w).alias("z_up"))
    hit = lower.withColumn("d", wanted).where("d >= z and (d < z_up or (z_up is null and d = z))")
    return hit.select(F.explode(F.array_compact(F.array("k", "k_up"))).alias("k")).distinct()


def select_levels(field: DataFrame, levels: DataFrame, depths: list[float], nearest: bool = False) -> DataFrame:
    """Rows of the levels that bracket the depths; the key table has a few rows, so the filter reaches the scan as a semi-join."""
    return field.join(F.broadcast(level_bracket(levels, depths, nearest)), "k", "left_semi")


def mask_bottom(field: DataFrame, cells: DataFrame, cell: str, iz: str, values: list[str], *, keep_interface: bool = True, drop: bool = False) -> DataFrame:
    """Values below the bottom become NULL (or the rows go): ``k <= iz`` is kept, or ``k < iz`` without the interface."""
    wet = F.col("k") <= F.col(iz) if keep_interface else F.col("k") < F.col(iz)
    joined = field.join(large(cells.select(cell, iz)), cell)
    if drop:
        return joined.where(wet).drop(iz)
    return joined.withColumns({v: F.when(wet, F.col(v)) for v in values}).drop(iz)


def mask_cavity(field: DataFrame, cells: DataFrame, cell: str, ic: str, values: list[str], *, drop: bool = False) -> DataFrame:
    """Values above the first level under the ice, ``k < ic``, become NULL (or the rows go); cells without that level have no cavity."""
    wet = F.col("k") >= F.coalesce(F.col(ic), F.lit(0))
    joined = field.join(large(cells.select(cell, ic)), cell)
    if drop:
        return joined.where(wet).drop(ic)
    return joined.withColumns({v: F.when(wet, F.col(v)) for v in values}).drop(ic)


def clamp(value: Column, low: float, high: float, land: float = 0.0) -> Column:
    """Value limited to a range; missing becomes ``land`` first."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(land))))


def log_valid(value: Column, least: float = 1e-15) -> Column:
    return F.when(F.abs(value) > least, value)


def correct_in_regions(cells: DataFrame, hits: DataFrame, key: str, column: str, value: float, relative: bool = False) -> DataFrame:
    """Within ``hits(key)`` a column becomes ``value``, or grows by ``value`` percent."""
    marked = large(cells).join(hits.select(key).distinct().withColumn("hit", F.lit(True)), key, "left")
    new = F.col(column) + F.col(column) * value / 100 if relative else F.lit(float(value))
    return marked.withColumn(column, F.when(F.col("hit"), new).otherwise(F.col(column))).drop("hit")


#: Group keys of the reductions over time.
PERIODS = {
    "annual": lambda: F.date_trunc("year", "time").cast("timestamp_ntz").alias("time"),
    "monthly": lambda: F.month("time").alias("month"),
    "day_of_month": lambda: F.dayofmonth("time").alias("day"),
    "day_of_year": lambda: F.dayofyear("time").alias("day"),
}


def reduce_time(field: DataFrame, how: str, value: str, by: list[str], period: str | None = None) -> DataFrame:
    """Statistic over all times, per true year, per month of the year, per day of the month or of the year."""
    if period is not None and period not in PERIODS:
        raise ValueError(f"period must be one of {sorted(PERIODS)}")
    return field.groupBy(*by, *([PERIODS[period]()] if period else [])).agg(statistic(how, value))


def weighted_mean(value: str, weight: Column, masked: bool = True) -> Column:
    """Sum of value times weight over sum of weights; weights count where the value is there, or always (``masked`` off)."""
    total = F.sum(F.when(F.col(value).isNotNull(), weight)) if masked else F.sum(weight)
    return (F.sum(F.col(value) * weight) / F.when(total != 0, total)).alias(value)


def weighted_integral(value: str, weight: Column) -> Column:
    return F.coalesce(F.sum(F.col(value) * weight), F.lit(0.0)).alias(value)


def reduce_cells(field: DataFrame, how: str, value: str, by: list[str], weight: Column | None = None, masked: bool = True) -> DataFrame:
    """Reduce over cells or levels: a plain statistic, ``wmean`` or ``wint`` with a weight column."""
    if how == "wmean":
        return field.groupBy(*by).agg(weighted_mean(value, weight, masked))
    return field.groupBy(*by).agg(weighted_integral(value, weight) if how == "wint" else statistic(how, value))


def region_index(field: DataFrame, hits: DataFrame, cell: str, value: str, by: list[str], weight: Column, how: str = "wmean") -> DataFrame:
    """Weighted mean or integral per region and ``by``; cells may lie in several regions. ``hits(cell, region)``."""
    return reduce_cells(large(field).join(hits, cell), how, value, ["region", *by], weight)


def lat_bin(lat: Column, dlat: float) -> Column:
    """Half-even rounding to multiples of ``dlat``."""
    return F.rint(lat / dlat) * dlat


def zonal_mean(field: DataFrame, value: str, dlat: float, by: list[str]) -> DataFrame:
    """Area-weighted mean per latitude bin: ``field`` has ``lat`` and ``w_A``."""
    return field.withColumn("lat", lat_bin(F.col("lat"), dlat)).groupBy(*by, "lat").agg(weighted_mean(value, F.col("w_A")))


def lat_bin_sum(field: DataFrame, value: Column, dlat: float, by: list[str], name: str = "value") -> DataFrame:
    """Sum per ``by`` and latitude bin on the dense axis from the lowest to the highest bin; empty bins are 0."""
    sums = field.withColumn("i", F.rint(F.col("lat") / dlat).cast("int")).groupBy(*by, "i").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(name))
    ends = sums.agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    # the axis is made once per group key of the aggregate, which is small next to the field
    grid = sums.select(*by).distinct().join(F.broadcast(ends)).select(*by, F.explode(F.sequence("lo", "hi")).alias("i"))
    return grid.join(sums, [*by, "i"], "left").select(*by, (F.col("i") * dlat).alias("lat"), F.coalesce(name, F.lit(0.0)).alias(name))


def coarse_grain(field: DataFrame, value: str, dlon: float, dlat: float, by: list[str], degree: float) -> DataFrame:
    """Sum of value times ``w_A`` over the area of each lon/lat box; 0 becomes missing."""
    boxes = field.withColumns({"bx": F.floor(F.col("lon") / dlon), "by": F.floor(F.col("lat") / dlat)})
    area = F.cos(F.radians((F.col("by") + 0.5) * dlat)) * (dlon * dlat * degree * degree)
    out = boxes.groupBy(*by, "bx", "by").agg(F.sum(F.col(value) * F.col("w_A")).alias("s"))
    return out.select(*by, ((F.col("bx") + 0.5) * dlon).alias("lon"), ((F.col("by") + 0.5) * dlat).alias("lat"), F.nullif(F.col("s") / area, F.lit(0.0)).alias(value))


def coarse_grain_closed(field: DataFrame, value: str, dlon: float, dlat: float, by: list[str], degree: float, closed: tuple[bool, bool] = (True, True)) -> DataFrame:
    """``coarse_grain`` with boxes that include both their edges, in longitude and in latitude (``closed``); else only the upper one.

    A point on an edge counts for both boxes, so a point goes to two boxes per axis at most.
    """

    def boxes(c: str, d: float, both: bool) -> Column:
        low = F.floor(F.col(c) / d)
        edge = F.col(c) / d == low
        return F.when(edge & F.lit(both), F.array(low - 1, low)).when(edge, F.array(low - 1)).otherwise(F.array(low))

    out = field.withColumn("bx", F.explode(boxes("lon", dlon, closed[0]))).withColumn("by", F.explode(boxes("lat", dlat, closed[1])))
    area = F.cos(F.radians((F.col("by") + 0.5) * dlat)) * (dlon * dlat * degree * degree)
    out = out.groupBy(*by, "bx", "by").agg(F.sum(F.col(value) * F.col("w_A")).alias("s"))
    return out.select(*by, ((F.col("bx") + 0.5) * dlon).alias("lon"), ((F.col("by") + 0.5) * dlat).alias("lat"), F.nullif(F.col("s") / area, F.lit(0.0)).alias(value))


def region_views(field: DataFrame, hits: DataFrame, key: str, value: str, weight: Column) -> DataFrame:
    """``view, region, time, k, value``: profile, Hovmoeller diagram and time series of regions from one pass over the field.

    Weighted means by grouping sets: ``profile`` has no time, ``series`` no level. Rows without a value carry no weight; a group
    without any has a missing value.
    """
    rows = large(field).join(hits, key).select("region", "time", "k", F.col(value).alias("_v"), F.when(F.col(value).isNotNull(), weight).alias("_w"))
    sets = [[F.col("region"), F.col("k")], [F.col("region"), F.col("time"), F.col("k")], [F.col("region"), F.col("time")]]
    whole = rows.groupingSets(sets, "region", "time", "k").agg(F.grouping("time").alias("_t"), F.grouping("k").alias("_k"), F.try_divide(F.sum(F.col("_v") * F.col("_w")), F.sum("_w")).alias(value))
    view = F.when(F.col("_t") == 1, "profile").when(F.col("_k") == 1, "series").otherwise("hovmoeller")
    return whole.select(view.alias("view"), "region", "time", "k", value)


def signed_totals(df: DataFrame, value: str, by: list[str], over: str = "time") -> DataFrame:
    """Net, positive and negative sum per ``by`` and ``over``, then their means over ``over``."""
    v = F.col(value)
    parts = df.groupBy(*by, over).agg(F.sum(v).alias("net"), F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)).alias("plus"), F.coalesce(F.sum(F.when(v < 0, v)), F.lit(0.0)).alias("minus"))
    return parts.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("net", "plus", "minus")))


def value_range(df: DataFrame, value: str, cover: float, bins: int = 1000, weight: str | None = None) -> DataFrame:
    """``low, high``: centres of the first histogram bins, from either end, whose cumulative share passes ``cover``."""
    w = F.col(weight) if weight else F.lit(1.0)
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    binned = df.where(F.col(value).isNotNull()).join(F.broadcast(ends)).select(
        F.least(F.lit(bins - 1).cast("long"), F.floor((F.col(value) - F.col("lo")) / step)).alias("bin"), w.alias("w"), "lo", step.alias("step"))
    counts = binned.groupBy("bin", "lo", "step").agg(F.sum("w").alias("w"))
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()  # at most `bins` rows from here on
    counts = counts.withColumns({"up": F.sum("w").over(up), "down": F.sum("w").over(down), "all": F.sum("w").over(total)})
    centre = F.col("lo") + (F.col("bin") + 0.5) * F.col("step")
    return counts.agg(F.min(F.when(F.col("up") / F.col("all") >= cover, centre)).alias("low"), F.max(F.when(F.col("down") / F.col("all") >= cover, centre)).alias("high"))


def nodes_to_elems(field: DataFrame, elems: DataFrame, values: list[str], by: list[str], how: str = "sum") -> DataFrame:
    """Mean over the three corners: missing counts as 0 (``sum``) or is left out (``mean``)."""
    if how not in ("sum", "mean"):
        raise ValueError("how must be 'sum' or 'mean'")
    # the groups of a join's task are many times its input, so they are made where each element is in one task
    joined = elem_node(elems).join(large(field), "node").repartition("elem")
    return joined.groupBy("elem", *by).agg(*((F.coalesce(F.sum(v), F.lit(0.0)) / 3 if how == "sum" else F.avg(v)).alias(v) for v in values))


def elems_to_nodes(field: DataFrame, mesh: Mesh, values: list[str], by: list[str]) -> DataFrame:
    """Area-weighted mean over the adjacent elements that have a value."""
    joined = field.join(elem_area(mesh), "elem").join(elem_node(mesh.elems), "elem")
    return joined.groupBy("node", *by).agg(*(weighted_mean(v, F.col("area")) for v in values))


def edge_sides(edges: DataFrame, extra: list[str]) -> DataFrame:
    """``edge`` rows once per side (0 left, 1 right) with ``elem, dx, dy``; a missing right side has a null element."""
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("tri_l").alias("elem"), F.col("dx_l").alias("dx"), F.col("dy_l").alias("dy")),
        F.struct(F.lit(1).alias("side"), F.col("tri_r").alias("elem"), F.col("dx_r").alias("dx"), F.col("dy_r").alias("dy")),
    )
    return edges.select("n0", "n1", *extra, F.explode(sides).alias("s")).select("n0", "n1", *extra, "s.*")


def anomaly(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``a - b`` on equal keys."""
    other = b.select(*keys, *(F.col(v).alias(f"_{v}") for v in values))
    return large(a).join(other, keys).select(*keys, *((F.col(v) - F.col(f"_{v}")).alias(v) for v in values))


def bottom_envelope(nodes: DataFrame, levels: DataFrame, dlat: float, share: float = 0.8) -> DataFrame:
    """``lat, botmax, botnice``: largest value and quantile of the bottom depth per latitude bin, the latter smoothed [1,2,1]/4."""
    depth = nodes.join(F.broadcast(levels.select(F.col("k").alias("n_iz"), "zlev")), "n_iz").withColumn("lat", lat_bin(F.col("lat"), dlat))
    out = depth.groupBy("lat").agg(F.max("zlev").alias("botmax"), F.percentile("zlev", F.lit(share)).alias("q"))
    w = Window.orderBy("lat")  # one row per latitude bin
    smooth = (F.coalesce(F.lag("q").over(w), "q") + 2 * F.col("q") + F.coalesce(F.lead("q").over(w), "q")) / 4
    return out.select("lat", "botmax", smooth.alias("botnice"))


def derive(field: DataFrame, kind: str, inputs: list[str], name: str = "value", keep: str | None = None, abg=None) -> DataFrame:
    """A derived field from input columns side by side.

    ``norm``: length of a vector. ``vec``: a vector turned to geographic axes by the angles ``abg`` at ``lon, lat``, both
    components or only ``keep``. ``sigma<reference in km of water>``: potential density minus 1000. ``product``, ``total``.
    """
    a, b = (F.col(c) for c in inputs)
    if kind == "norm":
        return field.withColumn(name, expr.norm(a, b))
    if kind == "vec":
        turned = dict(zip(inputs, expr.rotate_vector(abg, F.col("lon"), F.col("lat"), a, b), strict=True))
        out = field.withColumns(turned)
        return out if keep is None else out.drop(*(c for c in inputs if c != keep))
    if kind.startswith("sigma"):
        return field.withColumn(name, expr.sigma(a, b, 1000.0 * float(kind[5:] or 0)))
    if kind in ("product", "total"):
        return field.withColumn(name, a * b if kind == "product" else a + b)
    raise ValueError(f"unknown kind {kind!r}")


def volume_weights(field: DataFrame, levels: DataFrame) -> DataFrame:
    """``field`` with the depth of its middle level."""
    return field.join(F.broadcast(mid_levels(levels)), "k")
