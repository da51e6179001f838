"""Readers and writers: mesh text files, field tables, climatologies, regions, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlake.operators.mesh import Mesh, large

#: Other names under which models write the canonical columns. Fixed values.
ALIASES = {
    "nod2": "node", "nod_n": "node", "ncells": "node", "elem_n": "elem", "nz": "k", "nz1": "k", "nz_1": "k", "lev": "k", "depth": "k", "ndens": "nd", "lon_bnds": None, "lat_bnds": None, "time_bnds": None,
}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, text``: the lines of text files with their numbers from 0 in each file.

    A file is read in splits like any other text. Lines are counted per split, and the counts of the splits before give each split's first
    number; within a split lines come in order. Only one row per split is shuffled and sent to all tasks (a split has megabytes of lines).
    """
    here = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    counts = here.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return here.join(F.broadcast(starts), ["file", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before")).alias("line"), "text")


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    """Numbers of each line of a white-space separated text, with the line's number from 0."""
    lines = numbered_lines(spark, path)
    return lines.select("line", F.split(F.trim(F.regexp_replace("text", r"\r$", "")), r"\s+").alias("c")).where("c[0] <> ''")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``node, lon, lat, flag`` from ``number x y flag`` lines (numbers from 1) below a line that holds the count."""
    rows = _numbers(spark, path).where(F.size("c") > 1)
    c = F.col("c")
    return rows.select((c[0].cast("int") - 1).alias("node"), c[1].cast("double").alias("lon"), c[2].cast("double").alias("lat"), c[3].cast("smallint").alias("flag"))


def read_elems(spark: SparkSession, path: str) -> DataFrame:
    """``elem, n0, n1, n2`` from three node numbers (from 1) per line."""
    rows = _numbers(spark, path).where(F.size("c") > 1)
    c = F.col("c")
    return rows.select((F.col("line") - 1).cast("int").alias("elem"), *((c[k].cast("int") - 1).alias(f"n{k}") for k in range(3)))


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """``k, zlev`` from a count and one depth per line; depths become negative."""
    rows = _numbers(spark, path).where("line > 0")
    return rows.select((F.col("line") - 1).cast("int").alias("k"), (-F.abs(F.col("c")[0].cast("double"))).alias("zlev"))


def read_bottom(spark: SparkSession, path: str, key: str, name: str) -> DataFrame:
    """``key, name``: index of the bottom (or cavity) level from one count per line."""
    return _numbers(spark, path).select(F.col("line").cast("int").alias(key), (F.col("c")[0].cast("int") - 1).cast("smallint").alias(name))


def bottom_depth(cells: DataFrame, levels: DataFrame, level: str, name: str = "depth") -> DataFrame:
    """``cells`` with the depth of the full level that their column ``level`` names; one row per model level is sent to all tasks."""
    return cells.join(F.broadcast(levels.select(F.col("k").alias(level), F.col("zlev").alias(name))), level, "left")


def read_level_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``node, k, cell`` from lines of per-level numbers of a node's cells (from 1; 0 or less: no cell there).

    Models that number the wet cells of all levels in one go give their mesh as such a table; fields then come per ``cell``.
    """
    rows = _numbers(spark, path).where(F.size("c") > 1)
    cells = rows.select(F.col("line").cast("int").alias("node"), F.posexplode("c").alias("k", "cell"))
    return cells.select("node", "k", (F.col("cell").cast("long") - 1).alias("cell")).where("cell >= 0")


def level_counts(level_nodes: DataFrame) -> DataFrame:
    """``node, n_iz``: how many levels of each node have cells."""
    return level_nodes.groupBy("node").agg(F.count("k").cast("int").alias("n_iz"))


def cells_to_nodes(field: DataFrame, level_nodes: DataFrame) -> DataFrame:
    """A field per ``cell`` as one per ``node, k``."""
    return field.join(level_nodes, "cell").drop("cell")


def read_mesh_text(spark: SparkSession, path: str, *, cavity: bool = False, raw: bool = False) -> Mesh:
    """A mesh from the text files ``nod2d.out, elem2d.out, aux3d.out, nlvls.out, elvls.out`` of a folder.

    With ``raw`` nodes and elements also have the bottom level before the model's own corrections, ``n_iz_raw`` and
    ``e_iz_raw``, from ``nlvls_raw.out`` and ``elvls_raw.out``. With ``cavity`` nodes and elements also have their first level under the ice, ``n_ic`` and ``e_ic``, from
    ``cavity_nlvls.out`` and ``cavity_elvls.out``.
    """
    nodes = read_nodes(spark, f"{path}/nod2d.out").join(read_bottom(spark, f"{path}/nlvls.out", "node", "n_iz"), "node")
    elems = read_elems(spark, f"{path}/elem2d.out").join(read_bottom(spark, f"{path}/elvls.out", "elem", "e_iz"), "elem")
    if raw:
        nodes = nodes.join(read_bottom(spark, f"{path}/nlvls_raw.out", "node", "n_iz_raw"), "node")
        elems = elems.join(read_bottom(spark, f"{path}/elvls_raw.out", "elem", "e_iz_raw"), "elem")
    if cavity:
        nodes = nodes.join(read_bottom(spark, f"{path}/cavity_nlvls.out", "node", "n_ic"), "node")
        elems = elems.join(read_bottom(spark, f"{path}/cavity_elvls.out", "elem", "e_ic"), "elem")
    return Mesh(nodes, elems, read_levels(spark, f"{path}/aux3d.out"))


def normalise(df: DataFrame, aliases: dict | None = None, values: list[str] | None = None) -> DataFrame:
    """Canonical column names, and NaN as NULL in the value columns."""
    names = ALIASES | (aliases or {})
    df = df.drop(*(c for c in df.columns if c in names and names[c] is None))
    df = df.withColumnsRenamed({c: names[c] for c in df.columns if names.get(c)})
    floats = values if values is not None else [f.name for f in df.schema if f.dataType.typeName() in ("float", "double")]
    return df.withColumns({v: F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")) for v in floats})


def read_field(spark: SparkSession, root: str, variable: str, years: int | tuple[int, int] | list[int], *, aliases: dict | None = None, schema=None) -> DataFrame:
    """A field from Parquet partitioned by ``variable`` and ``year``: a year, an inclusive pair, or a list; only their folders are read."""
    df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(root).where(F.col("variable") == variable)
    if isinstance(years, tuple):
        df = df.where(F.col("year").between(*years))
    else:
        df = df.where(F.col("year").isin([years] if isinstance(years, int) else years))
    return normalise(df.drop("variable"), aliases)


def unknown_cells(field: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Cells of a field that the mesh does not have; empty for a valid field."""
    return large(field.select(key)).distinct().join(cells.select(key), key, "left_anti")


def merge_variables(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two variables side by side on their keys; what one lacks is missing."""
    return large(a).join(b, keys, "full")


def read_climatology(spark: SparkSession, path: str, aliases: dict | None = None) -> DataFrame:
    """A regular grid table with canonical names; a single time is dropped."""
    df = normalise(spark.read.parquet(path), {"depth": "z", "lev": "z", "longitude": "lon", "latitude": "lat"} | (aliases or {}))
    return df.drop("time")


def read_geojson(spark: SparkSession, path: str, name: str = "name", *, holes: bool = False, lines: bool = False) -> DataFrame:
    """``region, part, seq, x, y`` of the outer rings of a GeoJSON file's polygons; multipolygons have several parts.

    With ``holes`` all rings come, told apart by ``ring`` (0: the outer one). With ``lines`` the file has one feature per line.
    """
    one_feature = f"struct<properties:struct<`{name}`:string>, geometry:struct<type:string, coordinates:string>>"
    if lines:
        feature = spark.read.schema("value string").text(path).select(F.from_json("value", one_feature).alias("f"))
    else:
        feature = spark.read.schema(f"features array<{one_feature}>").json(path, multiLine=True).select(F.explode("features").alias("f"))
    shape = F.col("f.geometry.coordinates")
    one, many = F.from_json(shape, "array<array<array<double>>>"), F.from_json(shape, "array<array<array<array<double>>>>")
    parts = feature.select(F.col(f"f.properties.{name}").alias("region"), F.posexplode(F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(F.array(one))).alias("part", "rings"))
    rings = parts.select("region", "part", F.posexplode("rings").alias("ring", "p")) if holes else parts.select("region", "part", F.lit(0).alias("ring"), F.col("rings")[0].alias("p"))
    out = rings.select("region", "part", "ring", F.posexplode("p").alias("seq", "p")).select("region", "part", "ring", "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    return out if holes else out.drop("ring")


def read_year_table(spark: SparkSession, path: str) -> DataFrame:
    """``year, month, value`` and ``annual`` from lines of a year, twelve months and the annual value."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(c) >= 13).select(c.alias("c"))
    months = F.posexplode(F.slice("c", 2, 12)).alias("m", "value")
    return rows.select(F.col("c")[0].cast("int").alias("year"), F.get("c", F.lit(13)).cast("double").alias("annual"), months).select("year", (F.col("m") + 1).alias("month"), F.col("value").cast("double").alias("value"), "annual")


def write_result(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Results as Parquet, partitioned by run, year and the like; existing partitions of the same keys are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, column: str, decimals: int = 2) -> None:
    df.withColumn(column, F.format_string(f"%.{decimals}f", F.col(column))).write.mode("overwrite").csv(path)


def write_rings(rings: DataFrame, path: str) -> None:
    """Rings ``(ring, seq, x, y)`` of three points or more as GeoJSON lines."""
    grouped = rings.groupBy("ring").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).where(F.size("p") > 2)
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("p", lambda q: F.array(q["x"], q["y"]))).alias("coordinates"))
    grouped.select(F.lit("Feature").alias("type"), F.struct("ring").alias("properties"), shape.alias("geometry")).write.mode("overwrite").json(path)


def nest_rings(rings: DataFrame, strip: float = 0.25) -> DataFrame:
    """``ring, depth, parent, area``: how closed rings ``(ring, seq, x, y)`` lie within one another.

    ``area`` is signed, positive for rings that run counterclockwise. ``depth`` counts the rings around a ring's first point, ``parent`` is the
    innermost of them. Edges and first points meet in strips of latitude, so no ring is gathered and no pair of rings is
    formed that shares no strip. Rings must not cross.
    """
    ahead = rings.select("ring", (F.col("seq") - 1).alias("seq"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    sides = rings.select("ring", "seq", F.col("x").alias("x0"), F.col("y").alias("y0")).join(ahead, ["ring", "seq"])
    areas = sides.groupBy("ring").agg((F.sum(F.expr("x0 * y1 - x1 * y0")) / 2).alias("area"))
    firsts = rings.groupBy("ring").agg(F.min_by(F.struct("x", "y"), "seq").alias("p")).select("ring", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    listed = sides.where("y0 <> y1").withColumn("strip", F.explode(F.sequence(F.floor(F.least("y0", "y1") / strip), F.floor(F.greatest("y0", "y1") / strip))))
    listed = listed.withColumnRenamed("ring", "around")
    hit = firsts.withColumn("strip", F.floor(F.col("py") / strip)).join(listed, "strip").where("ring <> around and (y0 > py) <> (y1 > py) and px < x0 + (py - y0) * (x1 - x0) / (y1 - y0)")
    inside = hit.groupBy("ring", "around").agg(F.count("*").alias("n")).where("n % 2 = 1").select("ring", "around")
    depths = inside.groupBy("ring").agg(F.count("*").cast("int").alias("depth"))
    # of the rings around, the innermost one has the most rings around itself
    outer = inside.join(depths.select(F.col("ring").alias("around"), F.col("depth").alias("d")), "around", "left")
    parents = outer.groupBy("ring").agg(F.max_by("around", F.coalesce("d", F.lit(0))).alias("parent"))
    return areas.join(depths, "ring", "left").join(parents, "ring", "left").select("ring", F.coalesce("depth", F.lit(0)).alias("depth"), "parent", "area")


def rings_to_polygons(rings: DataFrame, strip: float = 0.25) -> DataFrame:
    """``polygon, hole, seq, x, y``: rings at even depth as outer rings (``hole`` 0) of polygons named after them, those within
    them as their holes 1, 2 .. by name; outer rings run counterclockwise and holes clockwise."""
    nest = nest_rings(rings, strip)
    lands = nest.withColumn("outer", F.col("depth") % 2 == 0).withColumn("polygon", F.when(F.col("outer"), F.col("ring")).otherwise(F.col("parent")))
    place = F.row_number().over(Window.partitionBy("polygon").orderBy(F.desc("outer"), "ring")) - 1
    lands = lands.select("ring", "polygon", place.alias("hole"), (F.col("outer") != (F.col("area") > 0)).alias("turn"))
    # the other direction is the same places counted from the end
    return rings.join(lands, "ring").select("polygon", "hole", F.when(F.col("turn"), -F.col("seq")).otherwise(F.col("seq")).alias("seq"), "x", "y")


def write_polygons(polygons: DataFrame, path: str) -> None:
    """The result of ``rings_to_polygons`` as GeoJSON lines, with holes; rings of fewer than four rows (closed triangles) are left out.

    GeoJSON holds a polygon in one value, so a polygon is gathered in the task that writes it.
    """
    ring = polygons.groupBy("polygon", "hole").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).where(F.size("p") > 3)
    shape = ring.groupBy("polygon").agg(F.sort_array(F.collect_list(F.struct("hole", "p"))).alias("r"))
    coordinates = F.transform("r", lambda r: F.transform(r["p"], lambda q: F.array(q["x"], q["y"])))
    shape = shape.select(F.lit("Feature").alias("type"), F.struct(F.col("polygon").cast("string").alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    shape.write.mode("overwrite").json(path)
