"""Ordered operators on aggregated grids: cumulations, smoothing, series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.operators.mesh import large


def cumulate(df: DataFrame, axis: str, value: str, by: list[str], *, descending: bool = False, negate: bool = False, exclusive: bool = False) -> DataFrame:
    """Running sum of ``value`` along ``axis`` within ``by``; ``exclusive`` leaves the row itself out (the first is 0)."""
    order = F.desc(axis) if descending else F.asc(axis)
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    total = F.coalesce(F.sum(value).over(w), F.lit(0.0))
    return df.withColumn(value, -total if negate else total)


def class_depth(df: DataFrame, by: list[str], thickness: str = "h", axis: str = "nd") -> DataFrame:
    """Depth of the top of each class: thickness of the classes above it, the first 0."""
    return cumulate(df.withColumn("z", F.col(thickness)), axis, "z", by, exclusive=True)


def smooth_121(df: DataFrame, axis: str, value: str, by: list[str]) -> DataFrame:
    """[1, 2, 1] / 4 with the end values repeated."""
    w = Window.partitionBy(*by).orderBy(axis)
    v = F.col(value)
    return df.withColumn(value, (F.coalesce(F.lag(value).over(w), v) + 2 * v + F.coalesce(F.lead(value).over(w), v)) / 4)


def smooth_2d(df: DataFrame, iy: str, ix: str, value: str, by: list[str], ny: int = 1, nx: int = 4) -> DataFrame:
    """Mean of the valid values in a box of ``2 ny + 1`` by ``2 nx + 1`` grid points: each value is sent to its neighbours."""
    shifts = [(a, b) for a in range(-ny, ny + 1) for b in range(-nx, nx + 1)]
    sent = df.where(F.col(value).isNotNull()).select(
        *by, value, F.explode(F.array(*[F.struct((F.col(iy) + a).alias(iy), (F.col(ix) + b).alias(ix)) for a, b in shifts])).alias("to"))
    means = sent.groupBy(*by, "to").agg(F.avg(value).alias(value)).select(*by, f"to.{iy}", f"to.{ix}", value)
    return df.select(*by, iy, ix).join(means, [*by, iy, ix], "left")


def smooth_cells(field: DataFrame, neighbours: DataFrame, cell: str, value: str, centre: float = 1.0, rounds: int = 1) -> DataFrame:
    """Jacobi smoothing: the mean of the neighbours and of the cell itself, which counts as ``centre`` times their number.

    Every round uses the values of the round before (the order of cells plays no part).
    """
    for _ in range(rounds):
        around = large(neighbours).join(field.select(F.col(cell).alias("neighbour"), F.col(value).alias("_v")), "neighbour")
        sums = around.groupBy(cell).agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
        own = F.col("_n") * centre
        field = large(field).join(sums, cell, "left").withColumn(value, F.coalesce((F.col("_s") + own * F.col(value)) / (F.col("_n") + own), F.col(value))).drop("_s", "_n")
    return field


def smooth_weighted(field: DataFrame, neighbours: DataFrame, cell: str, value: str, centre: float, rounds: int = 1, weak: list[tuple] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Neighbour smoothing: ``(sum + m v) / (n + m)`` with ``m = c centre (n - 1) - 1`` for a cell with ``n`` neighbours of that sum.

    ``weak`` lists boxes ``(x0, x1, y0, y1, c)`` of less smoothing on ``field(cell, x, y, value)``; of several the last one counts, elsewhere ``c`` is 1. Cells
    whose neighbours have no values keep theirs, as do cells whose weights add up to 0 (a single neighbour). Every round uses the values of the round before. ``keep`` stores a table between
    rounds, so that the plan does not grow with their number.
    """
    c = F.lit(1.0)
    for x0, x1, y0, y1, more in weak or []:
        c = F.when(F.col("x").between(x0, x1) & F.col("y").between(y0, y1), float(more)).otherwise(c)
    field = field.withColumn("_c", c)
    for _ in range(rounds):
        around = large(neighbours).join(field.select(F.col(cell).alias("neighbour"), F.col(value).alias("_n")), "neighbour")
        sums = around.groupBy(cell).agg(F.sum("_n").alias("_s"), F.count("_n").alias("_n")).where("_n > 0")
        more = F.col("_c") * centre * (F.col("_n") - 1) - 1
        new = F.try_divide(F.col("_s") + more * F.col(value), F.col("_n") + more)
        field = large(field).join(sums, cell, "left").withColumn(value, F.coalesce(new, value)).drop("_s", "_n")
        field = keep(field) if keep is not None else field
    return field.drop("_c")


def concat_cycles(df: DataFrame, time: str = "year", cycle: str = "cycle", run: str = "run") -> DataFrame:
    """Spin-up cycles one after the other: cycle ``c`` is shifted by ``c`` times the length of a cycle of the run."""
    ends = df.groupBy(run).agg((F.max(time) - F.min(time) + 1).alias("_n"))
    return df.join(ends, run).withColumn(time, F.col(time) + F.col(cycle) * F.col("_n")).drop("_n")


def baseline_anomaly(df: DataFrame, value: str, first: int, last: int, by: list[str], year: str = "year") -> DataFrame:
    """Value minus its mean over the years ``first .. last`` within ``by`` (add the month to ``by`` for monthly baselines)."""
    means = df.where(F.col(year).between(first, last)).groupBy(*by).agg(F.avg(value).alias("_b"))
    return df.join(means, by, "left").withColumn(value, F.col(value) - F.col("_b")).drop("_b")


def moc_series(moc: DataFrame, cell: str, *, depth: tuple[float, float], lat: float | None = None, band: tuple[float, float] | None = None, by: list[str]) -> DataFrame:
    """Strength per ``by``: maximum (``upper``) or minimum (``lower``) over a depth window, at the nearest latitude or in a band.

    ``moc(by.., lat, z, moc)``.
    """
    if cell not in ("upper", "lower"):
        raise ValueError("cell must be 'upper' or 'lower'")
    agg = F.max if cell == "upper" else F.min
    rows = moc.where(F.col("z").between(*sorted(depth)))
    if band is not None:
        return rows.where(F.col("lat").between(*band)).groupBy(*by).agg(agg("moc").alias("moc"))
    per_lat = rows.groupBy(*by, "lat").agg(agg("moc").alias("moc"))
    return per_lat.groupBy(*by).agg(F.min_by("moc", F.struct(F.abs(F.col("lat") - lat), "lat")).alias("moc"))


def non_increasing(df: DataFrame, axis: str, value: str, by: list[str]) -> DataFrame:
    """Monotone repair: missing values take the last one before, then the running minimum."""
    w = Window.partitionBy(*by).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.min(value).over(w))


def repair_depths(grid: DataFrame, x: str, axis: str, value: str, by: list[str] | None = None, surface: float = -1.0) -> DataFrame:
    """Depths ``value`` of classes ``axis`` at places ``x`` without gaps and nowhere rising from class to class.

    Depths at or above ``surface`` count as gaps. Below the deepest class of a place its depth goes on, above the shallowest
    that one's. Gaps that are left take the nearest known cell by the distance in ``(x, axis)``, first within each place
    by windows, then among the places of the class by the sum of both squares, which together is the exact nearest cell (ties: the smaller ``x``,
    then the smaller ``axis``). Last comes the running minimum. A grid without any depth stays empty. The grid is an aggregate;
    a class holds one entry per place.
    """
    by = by or []
    place = Window.partitionBy(*by, x)
    rows = grid.select(*by, x, axis, F.when(F.col(value) < surface, F.col(value)).alias("_v"))
    low, high = F.min("_v").over(place), F.max("_v").over(place)
    rows = rows.withColumns({"_low": low, "_high": high})
    rows = rows.withColumns({"_last": F.max(F.when(F.col("_v") == F.col("_low"), F.col(axis))).over(place), "_first": F.min(F.when(F.col("_v") == F.col("_high"), F.col(axis))).over(place)})
    rows = rows.select(*by, x, axis, F.when(F.col(axis) > F.col("_last"), F.col("_low")).when(F.col(axis) < F.col("_first"), F.col("_high")).otherwise(F.col("_v")).alias("_v"))
    known = F.when(F.col("_v").isNotNull(), F.struct(F.col(axis).alias("a"), F.col("_v").alias("v")))
    order = place.orderBy(axis)
    up = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(known, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = lambda site: F.when(site.isNotNull(), F.struct(((F.col(axis) - site["a"]) * (F.col(axis) - site["a"])).alias("f"), site["a"].alias("a"), site["v"].alias("v")))
    rows = rows.withColumn("_site", F.least(near(up), near(down)))
    line = rows.where("_site is not null").groupBy(*by, axis).agg(F.collect_list(F.struct(F.col(x).alias("x"), F.col("_site.f").alias("f"), F.col("_site.a").alias("a"), F.col("_site.v").alias("v"))).alias("_line"))
    gaps = rows.where("_v is null").select(*by, x, axis).join(line, [*by, axis])
    best = F.array_min(F.transform("_line", lambda s: F.struct(((F.col(x) - s["x"]) * (F.col(x) - s["x"]) + s["f"]).alias("d"), s["x"].alias("x"), s["a"].alias("a"), s["v"].alias("v"))))
    filled = gaps.select(*by, x, axis, best["v"].alias("_fill"))
    whole = rows.select(*by, x, axis, "_v").join(filled, [*by, x, axis], "left").select(*by, x, axis, F.coalesce("_v", "_fill").alias(value))
    return non_increasing(whole, axis, value, [*by, x])


def series_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, and mean plus and minus one standard deviation, per series."""
    m, s = F.avg(value), F.stddev_pop(value)
    return df.groupBy(*by).agg(m.alias("mean"), (m + s).alias("upper"), (m - s).alias("lower"))


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """All runs under one another, told apart by ``run``."""
    frames = [df.withColumn("run", F.lit(name)) for name, df in sorted(runs.items())]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def lerp(x: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Linear interpolation between two points."""
    return y0 + (y1 - y0) * (x - x0) / (x1 - x0)
