"""Queries on sections as wholes, on bottom statistics and on the way from density classes to depths."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlake.functions import expr
from meshlake.operators import interp as I
from meshlake.operators import mesh as G
from meshlake.operators import reduce as R
from meshlake.operators import transect as T
from meshlake.operators import transport as D
from meshlake.plans import fixtures as X
from meshlake.plans.fixtures import with_tables as sql
from meshlake.plans.mesh_queries import _ROT, _ROTATED
from meshlake.plans.registry import query, rn, rounded
from meshlake.plans.transport_queries import _CUTS, _PATH, _cut

_MEAN_PLACE = "mid AS (SELECT elem, avg(lat) AS lat FROM elem_node JOIN nodes USING (node) GROUP BY elem)"


@query("a18_bottom_by_latitude", sql("elem_node levels", "SELECT round_even(lat / 4, 0) * 4 + 0.0 AS lat, max(abs(zlev)) AS botmax, round(avg(abs(zlev)) + 1e-9, 6) + 0.0 AS botmean, max(e_iz) AS botmaxi FROM elems JOIN mid USING (elem) JOIN levels ON k = e_iz GROUP BY 1", _MEAN_PLACE))
def a18(spark, d):
    m = X.mesh(spark, d)
    place = G.elem_node(m.elems).join(m.nodes.select("node", "lat"), "node").groupBy("elem").agg(F.avg("lat").alias("lat"))
    out = D.bottom_by_latitude(m.elems, place, m.levels, 4.0)
    return rounded(out.select((F.col("lat") + 0.0).alias("lat"), "botmax", "botmean", "botmaxi"), "botmean")


@query("t03_section_points", sql("edges", "SELECT name, CAST(seg AS INTEGER) AS seg, CAST(rank AS INTEGER) AS rank, round(px + 1e-9, 6) + 0.0 AS px, round(py + 1e-9, 6) + 0.0 AS py FROM cuts WHERE NOT (seg > 0 AND rank = 1)", _CUTS))
def t03(spark, d):
    return rounded(T.section_points(_cut(spark, d)).select("name", "seg", "rank", "px", "py"), "px", "py")


@query("t03_section_distance", sql("edges", """SELECT name, CAST(seg AS INTEGER) AS seg, CAST(rank AS INTEGER) AS rank, round(sum(step) OVER (PARTITION BY name ORDER BY seg, rank ROWS UNBOUNDED PRECEDING) + 1e-6, 3) + 0.0 AS dist FROM (
  SELECT name, seg, rank, if(lag(px) OVER w IS NULL, 0, greatest(1, acos(least(1, cos(radians(lag(py) OVER w)) * cos(radians(lag(px) OVER w)) * cos(radians(py)) * cos(radians(px))
    + cos(radians(lag(py) OVER w)) * sin(radians(lag(px) OVER w)) * cos(radians(py)) * sin(radians(px)) + sin(radians(lag(py) OVER w)) * sin(radians(py)))) * 6367.5)) AS step FROM (SELECT * FROM cuts WHERE NOT (seg > 0 AND rank = 1)) WINDOW w AS (PARTITION BY name ORDER BY seg, rank))""", _CUTS))
def t03_distance(spark, d):
    return T.path_distance(T.section_points(_cut(spark, d))).select("name", "seg", "rank", (rn("dist", 3) + 0.0).alias("dist"))


@query("t05_oriented_transport", sql("edges field_e thick", """SELECT name, seg, round(coalesce(sum((-u * dy + v * dx) * w_z * 1e-6 * if(ny < 0 OR (ny = 0 AND nx < 0), -1, 1)), 0) + 1e-7, 4) + 0.0 AS transport
  FROM path JOIN (SELECT name, CAST(seg AS INTEGER) AS seg, nx, ny FROM seg) s USING (name, seg) JOIN field_e USING (elem) JOIN thick USING (k) GROUP BY name, seg""", _PATH))
def t05(spark, d):
    m = X.mesh(spark, d)
    out = T.transect_transport(T.transport_path(_cut(spark, d, m)), X.field_e(m.elems), m, by=("name", "seg"), oriented=True)
    return out.select("name", "seg", (rn("transport", 4) + 0.0).alias("transport"))


_TURNED = _ROTATED.replace("field_e e", "(SELECT elem, name || ':' || seg || ':' || rank || ':' || sub AS k, dx * 1e-3 AS u, dy * 1e-3 AS v FROM path WHERE elem IS NOT NULL) e")


@query("t06_rotated_path", sql("edges", """SELECT k AS piece, elem, round(-gx * sin(radians(lon)) + gy * cos(radians(lon)) + 1e-9, 6) + 0.0 AS dx,
  round(-gx * sin(radians(lat)) * cos(radians(lon)) - gy * sin(radians(lat)) * sin(radians(lon)) + gz * cos(radians(lat)) + 1e-9, 6) + 0.0 AS dy FROM gxyz""", f"{_PATH}, {_TURNED}"))
def t06(spark, d):
    m = X.mesh(spark, d)
    lon, lat = [F.col(f"lon{k}") for k in range(3)], [F.col(f"lat{k}") for k in range(3)]
    cx = lon[0] + (expr.wrap(lon[1] - lon[0]) + expr.wrap(lon[2] - lon[0])) / 3
    at = G.corners(m).select("elem", cx.alias("lon"), ((lat[0] + lat[1] + lat[2]) / 3).alias("lat"))
    out = T.rotate_path(T.transport_path(_cut(spark, d, m)), at, _ROT)
    return rounded(out.select(F.concat_ws(":", "name", "seg", "rank", "sub").alias("piece"), "elem", "dx", "dy"), "dx", "dy", scale=1e-3)


@query("f04_section_bottom", sql("edges mean_n", """SELECT name, CAST(seg AS INTEGER) AS seg, CAST(rank AS INTEGER) AS rank, m.k, round(if(m.k <= n.n_iz, temp, NULL) + 1e-9, 6) + 0.0 AS at_interfaces, round(if(m.k < n.n_iz, temp, NULL) + 1e-9, 6) + 0.0 AS at_layers
  FROM cuts c JOIN mean_n m ON m.node = c.n0 JOIN nodes n ON n.node = c.n0""", _CUTS))
def f04(spark, d):
    line = _cut(spark, d).select("name", "seg", "rank", F.col("n0").alias("node")).join(X.mean_n(spark, d).select("node", "k", F.col("temp").alias("at_interfaces"), F.col("temp").alias("at_layers")), "node")
    n = X.nodes(spark, d)
    line = R.mask_bottom(line, n, "node", "n_iz", ["at_interfaces"], keep_interface=True).drop("n_iz")
    line = R.mask_bottom(line, n, "node", "n_iz", ["at_layers"], keep_interface=False)
    return rounded(line.select("name", "seg", "rank", "k", "at_interfaces", "at_layers"), "at_interfaces", "at_layers")


def _step(points: str, curve: str, at: str, x: str, y: str, keys: str, outside: str) -> str:
    return f"""SELECT {keys}, coalesce(max({y}0 + ({y}1 - {y}0) * ({at} - {x}0) / ({x}1 - {x}0)), {outside}) AS {y} FROM {points} p LEFT JOIN (
      SELECT node, {x} AS {x}0, {y} AS {y}0, lead({x}) OVER w AS {x}1, lead({y}) OVER w AS {y}1 FROM {curve} WINDOW w AS (PARTITION BY node ORDER BY {x})) s
      ON s.node = p.node AND {x}1 > {x}0 AND {at} BETWEEN {x}0 AND {x}1 GROUP BY ALL"""


@query("i13_classes_to_depths", sql("mean_n dens", "SELECT node, z, round(value + 1e-7, 4) + 0.0 AS value FROM remapped", f"""profile AS (SELECT node, k * 100.0::DOUBLE AS depth, 29.5::DOUBLE + k * 1.7::DOUBLE + temp / 40 AS rho FROM mean_n),
  classes AS (SELECT p.node, dens, CAST((p.node * 31 + nd * 17) % 201 - 100 AS DOUBLE) AS value FROM (SELECT DISTINCT node FROM mean_n) p, dens),
  placed AS ({_step("classes", "profile", "dens", "rho", "depth", "p.node, dens, value", "0")}),
  wanted AS (SELECT node, 50.0::DOUBLE + 100 * i AS z FROM (SELECT DISTINCT node FROM mean_n), (SELECT unnest(range(0, 6)) AS i)),
  uneven AS (SELECT node, depth, min(value) AS value FROM placed WHERE depth > 0 GROUP BY node, depth),
  remapped AS ({_step("wanted", "uneven", "z", "depth", "value", "p.node, z", "NULL")})"""))
def i13(spark, d):
    t = X.mean_n(spark, d)
    profile = t.select("node", (F.col("k") * 100.0).alias("depth"), (F.lit(29.5) + F.col("k") * 1.7 + F.col("temp") / 40).alias("rho"))
    n = t.select("node").distinct()
    classes = n.crossJoin(F.broadcast(X.dens_levels(spark))).select("node", "dens", ((F.col("node") * 31 + F.col("nd") * 17) % 201 - 100.0).alias("value"))  # eight classes
    depths = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("node", (F.lit(50.0) + F.col("i") * 100).alias("z"))
    out = I.classes_to_depths(classes, profile.withColumnRenamed("depth", "z"), depths, ["node"], "value")
    return out.select("node", "z", (rn("value", 4) + 0.0).alias("value"))
