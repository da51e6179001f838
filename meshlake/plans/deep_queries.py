"""Queries on tracer fluxes through sections, sections anywhere on the globe, repaired class depths, views in one pass and nested contours."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlake.functions import expr
from meshlake.operators import mesh as G
from meshlake.operators import reduce as R
from meshlake.operators import regions as S
from meshlake.operators import topology as Y
from meshlake.operators import transect as T
from meshlake.operators import windows as W
from meshlake.plans import fixtures as X
from meshlake.plans.contour_queries import _PARTS, deep, recursive
from meshlake.plans.field_queries import _HITS, _WEIGHTED, _regional
from meshlake.plans.fixtures import with_tables as sql
from meshlake.plans.registry import query, rn, rounded
from meshlake.plans.transport_queries import _CUTS, _cut
from meshlake.sources import tables as IO

_PIECES = _CUTS + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY name, seg ORDER BY rank) AS i, count(*) OVER (PARTITION BY name, seg) AS n, dx_l * (sx1 - sx0) + dy_l * (sy1 - sy0) >= 0 AS ahead FROM cuts),
  pieces AS (SELECT name, seg, rank, 0 AS sub, n0, n1, if(ahead, tri_r, tri_l) AS elem, -if(ahead, dx_r, dx_l) AS dx, -if(ahead, dy_r, dy_l) AS dy FROM ordered WHERE i > 1
    UNION ALL SELECT name, seg, rank, 1, n0, n1, if(ahead, tri_l, tri_r), if(ahead, dx_l, dx_r), if(ahead, dy_l, dy_r) FROM ordered WHERE i < n),
  wet AS (SELECT m.* FROM mean_n m JOIN nodes USING (node) WHERE k < n_iz)"""


def _tracer_sql(value: str, factor: str, scale: str) -> str:
    return sql("edges field_e thick mean_n", f"""SELECT name, CAST(seg AS INTEGER) AS seg, k, round(sum((-u * dy + v * dx) * w_z * ((a.{value} + b.{value}) * 0.5 - {"2" if value == "temp" else "34.5"}) * {factor}) * {scale} + 1e-8, 5) + 0.0 AS flux
      FROM pieces JOIN (SELECT f.* FROM field_e f JOIN elems USING (elem) WHERE k < e_iz) USING (elem) JOIN thick USING (k) JOIN wet a USING (k) JOIN wet b USING (k) WHERE a.node = pieces.n0 AND b.node = pieces.n1 GROUP BY name, seg, k""", _PIECES)


def _section(spark, d, value: str, quantity: str, reference: float):
    m = X.mesh(spark, d)
    tracer = X.mean_n(spark, d).select("node", "k", value)
    return T.section_flux(T.transport_path(_cut(spark, d, m)), X.field_e(m.elems), m, quantity=quantity, tracer=tracer, reference=reference).groupBy("name", "seg", "k").agg(F.sum("flux").alias("flux"))


@query("d12_heat_section", _tracer_sql("temp", "(1030.0::DOUBLE * 3850) * 1e-15::DOUBLE", "1"))
def d12_heat(spark, d):
    return _section(spark, d, "temp", "heat", 2.0).withColumn("flux", rn("flux", 5) + 0.0)


@query("d12_salt_section", _tracer_sql("salt", "1.03::DOUBLE", "1e-6"))
def d12_salt(spark, d):
    return _section(spark, d, "salt", "salt", 34.5).withColumn("flux", rn(F.col("flux") * 1e-6, 5) + 0.0)


@query("d12_node_velocity", sql("edges thick mean_n", """SELECT name, round(sum(f) + 1e-8, 5) + 0.0 AS net, round(coalesce(sum(f) FILTER (f > 0), 0) + 1e-8, 5) + 0.0 AS positive, round(coalesce(sum(f) FILTER (f < 0), 0) + 1e-8, 5) + 0.0 AS negative FROM (
  SELECT name, (-(a.u + b.u) * 0.5 * dy + (a.v + b.v) * 0.5 * dx) * w_z * 1e-6 AS f FROM pieces JOIN thick ON true JOIN vel a ON a.node = n0 AND a.k = thick.k JOIN vel b ON b.node = n1 AND b.k = thick.k) GROUP BY name""",
  _PIECES + """, vel AS (SELECT node, k, CAST((CAST(node AS BIGINT) * 7919 + k * 104729) % 2001 - 1000 AS DOUBLE) / 1000 AS u, CAST((CAST(node AS BIGINT) * 104729 + k * 7919) % 2001 - 1000 AS DOUBLE) / 1000 AS v FROM nodes JOIN thick ON k < n_iz)"""))
def d12_nodes(spark, d):
    m = X.mesh(spark, d)
    rows = m.nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    n = F.col("node").cast("long")
    vel = rows.select("node", "k", (((n * 7919 + F.col("k") * 104729) % 2001 - 1000) / 1000.0).alias("u"), (((n * 104729 + F.col("k") * 7919) % 2001 - 1000) / 1000.0).alias("v"))
    out = T.signed_flux(T.section_flux(T.transport_path(_cut(spark, d, m)), vel, m), ["name"])
    return out.select("name", *((rn(c, 5) + 0.0).alias(c) for c in ("net", "positive", "negative")))


#: Sections near the poles, over the date line and round a good part of the globe.
FAR_LINES = {"south": ([-120.3, 150.7], [-79.1, -66.3]), "north": ([-43.1, 62.9], [66.2, 71.9]), "pacific": ([150.2, 203.9, 251.1], [-30.4, 12.3, 44.7]), "belt": ([-170.4, 175.3], [-41.3, -38.9])}


def _far_segments() -> str:
    rows = [(name, k, x[k], y[k], x[k + 1], y[k + 1]) for name, (x, y) in sorted(FAR_LINES.items()) for k in range(len(x) - 1)]
    return "far AS (SELECT * FROM (VALUES " + ", ".join("('{}', {}, {})".format(n, k, ", ".join(f"CAST({v!r} AS DOUBLE)" for v in p)) for n, k, *p in rows) + ") AS t(name, seg, sx0, sy0, sx1, sy1))"


@query("t02_sections_by_cells", sql("edges", """SELECT name, CAST(seg AS INTEGER) AS seg, CAST(row_number() OVER (PARTITION BY name, seg ORDER BY s, n0, n1) AS INTEGER) AS rank, n0, n1, round(ex0 + lint * (ex1 - ex0) + 1e-9, 6) + 0.0 AS px, round(y0 + lint * (y1 - y0) + 1e-9, 6) + 0.0 AS py
  FROM st WHERE s BETWEEN -1.1920929e-07 AND 1 + 1.1920929e-07 AND lint BETWEEN -1.1920929e-07 AND 1 + 1.1920929e-07""", _far_segments() + """,
  turned AS (SELECT e.*, x0 + 360 * t AS ex0, x0 + (x1 - x0 - floor((x1 - x0) / 360 + 0.5) * 360) + 360 * t AS ex1 FROM edges e, (SELECT unnest([-2, -1, 0, 1, 2]) AS t)),
  solved AS (SELECT e.*, far.*, (sx1 - sx0) * (y1 - y0) - (sy1 - sy0) * (ex1 - ex0) AS det FROM turned e JOIN far ON least(ex0, ex1) <= greatest(sx0, sx1) + 1 AND greatest(ex0, ex1) >= least(sx0, sx1) - 1),
  st AS (SELECT *, ((ex0 - sx0) * (y1 - y0) - (y0 - sy0) * (ex1 - ex0)) / det AS s, ((ex0 - sx0) * (sy1 - sy0) - (y0 - sy0) * (sx1 - sx0)) / det AS lint FROM solved WHERE abs(det) > 1e-12)"""))
def t02_cells(spark, d):
    out = T.cut_edges_by_cells(T.transects(spark, FAR_LINES), X.edges(X.mesh(spark, d)))
    return rounded(out.select("name", "seg", "rank", "n0", "n1", "px", "py"), "px", "py")


@query("w11_repaired_depths", sql("clim", "SELECT ix, iy, round(min(z) OVER (PARTITION BY iy ORDER BY ix) + 1e-9, 6) + 0.0 AS z FROM whole", """
  raw AS (SELECT ix, iy, iy * 10.0::DOUBLE - 85 AS lat, 30.0::DOUBLE + ix * 0.25::DOUBLE AS dens, if((ix * 7 + iy * 5) % 11 > 4 AND temp > 1 AND iy <> 4, -temp, NULL) AS z FROM clim),
  tails AS (SELECT *, min(z) OVER (PARTITION BY iy) AS low, max(z) OVER (PARTITION BY iy) AS high FROM raw),
  bounds AS (SELECT *, max(if(z = low, ix, NULL)) OVER (PARTITION BY iy) AS last, min(if(z = high, ix, NULL)) OVER (PARTITION BY iy) AS first FROM tails),
  flat AS (SELECT ix, iy, lat, dens, CASE WHEN ix > last THEN low WHEN ix < first THEN high ELSE z END AS z FROM bounds),
  whole AS (SELECT g.ix, g.iy, coalesce(any_value(g.z), arg_min(s.z, ((g.lat - s.lat) * (g.lat - s.lat) + (g.dens - s.dens) * (g.dens - s.dens), s.lat, s.dens))) AS z FROM flat g LEFT JOIN flat s ON s.z IS NOT NULL GROUP BY g.ix, g.iy)"""))
def w11_depths(spark, d):
    clim = X.climatology(spark, d).select("ix", "iy", (F.col("iy") * 10.0 - 85.0).alias("lat"), (F.col("ix") * 0.25 + 30.0).alias("dens"), F.expr("if((ix * 7 + iy * 5) % 11 > 4 and iy <> 4, -temp, null)").alias("z"))
    out = W.repair_depths(clim.drop("ix", "iy"), "lat", "dens", "z")
    # back from coordinates to places on the grid
    out = out.select(F.rint((F.col("dens") - 30.0) / 0.25).cast("int").alias("ix"), F.rint((F.col("lat") + 85.0) / 10.0).cast("int").alias("iy"), "z")
    return rounded(out, "z")


_VIEW = "round(sum(temp * w_A) / nullif(sum(if(temp IS NULL, NULL, w_A)), 0) + 1e-9, 6) + 0.0 AS temp"


@query("a13_region_views", sql("node_area thick field_n", f"""SELECT 'profile' AS view, region, NULL::TIMESTAMP AS time, k, {_VIEW} FROM wf JOIN hits USING (node) GROUP BY region, k
  UNION ALL SELECT 'hovmoeller', region, time, k, {_VIEW} FROM wf JOIN hits USING (node) GROUP BY region, time, k
  UNION ALL SELECT 'series', region, time, -1, {_VIEW} FROM wf JOIN hits USING (node) GROUP BY region, time""", f"{_WEIGHTED}, {_HITS}"))
def a13_views(spark, d):
    f, hits = _regional(spark, d)
    views = R.region_views(f, hits, "node", "temp", F.col("w_A") * 1e-10)
    return rounded(views.withColumn("k", F.coalesce("k", F.lit(-1))), "temp")


@query("a20_closed_boxes", sql("nodes node_area mean_n", """SELECT bx + 7.2 AS lon, by_ + 8.0 AS lat, round(nullif(sum(temp * w_A) / (cos(radians(by_ + 8.0::DOUBLE)) * 14.4 * 16 * pow(6367500 * pi() / 180, 2)), 0) + 1e-9, 6) + 0.0 AS temp
  FROM mean_n JOIN nodes USING (node) JOIN node_area USING (node, k) JOIN (SELECT unnest(range(-13, 13)) * 14.4::DOUBLE AS bx) ON (lon - bx) * (lon - (bx + 14.4)) <= 0 JOIN (SELECT unnest(range(-6, 6)) * 16.0::DOUBLE AS by_) ON (lat - by_) * (lat - (by_ + 16)) <= 0 WHERE k = 0 GROUP BY bx, by_"""))
def a20_closed(spark, d):
    m = X.mesh(spark, d)
    f = X.mean_n(spark, d).where("k = 0").join(m.nodes.select("node", "lon", "lat"), "node").join(G.node_area(m), ["node", "k"])
    return rounded(R.coarse_grain_closed(f, "temp", 14.4, 16.0, [], expr.DEGREE), "temp", "lon", "lat")


_WEAK = [(-30.0, 60.0, -45.0, 40.0, 2.0), (0.0, 20.0, -20.0, 20.0, 4.0)]


@query("w13_weighted_smoothing", sql("edge_table mean_n", "SELECT node, round(v + 1e-9, 6) + 0.0 AS temp FROM r2", """nb AS (SELECT n0 AS node, n1 AS neighbour FROM edge_table UNION ALL SELECT n1, n0 FROM edge_table),
  r0 AS (SELECT node, avg(temp) AS v, any_value(CASE WHEN lon BETWEEN 0 AND 20 AND lat BETWEEN -20 AND 20 THEN 4.0 WHEN lon BETWEEN -30 AND 60 AND lat BETWEEN -45 AND 40 THEN 2.0 ELSE 1.0 END::DOUBLE) AS c FROM mean_n JOIN nodes USING (node) GROUP BY node),
  r1 AS (SELECT a.node, any_value(a.c) AS c, coalesce((sum(b.v) + (any_value(a.c) * 1.5 * (count(b.v) - 1) - 1) * any_value(a.v)) / (count(b.v) + any_value(a.c) * 1.5 * (count(b.v) - 1) - 1), any_value(a.v)) AS v FROM r0 a LEFT JOIN nb USING (node) LEFT JOIN r0 b ON b.node = nb.neighbour GROUP BY a.node),
  r2 AS (SELECT a.node, coalesce((sum(b.v) + (any_value(a.c) * 1.5 * (count(b.v) - 1) - 1) * any_value(a.v)) / (count(b.v) + any_value(a.c) * 1.5 * (count(b.v) - 1) - 1), any_value(a.v)) AS v FROM r1 a LEFT JOIN nb USING (node) LEFT JOIN r1 b ON b.node = nb.neighbour GROUP BY a.node)"""))
def w13_weighted(spark, d):
    m = X.mesh(spark, d)
    sfc = X.mean_n(spark, d).groupBy("node").agg(F.avg("temp").alias("temp")).join(m.nodes.select("node", F.col("lon").alias("x"), F.col("lat").alias("y")), "node")
    return rounded(W.smooth_weighted(sfc, G.node_neighbours(m.elems), "node", "temp", 1.5, 2, _WEAK, Y.stored).select("node", "temp"), "temp")


@query("s14_nested_contours", recursive(sql("elems", """SELECT name, if(depth % 2 = 0, name, parent) AS polygon, CAST(depth AS INTEGER) AS depth, round(area + 1e-9, 6) + 0.0 AS area FROM nested""", _PARTS + """,
  named AS MATERIALIZED (SELECT ring || ':' || loop || ':' || part AS name, row_number() OVER (PARTITION BY ring, loop, part ORDER BY seq) - 1 AS seq, x, y FROM closed),
  lined AS MATERIALIZED (SELECT a.name, a.seq, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM named a JOIN named b ON b.name = a.name AND b.seq = a.seq + 1),
  within AS MATERIALIZED (SELECT p.name, l.name AS around FROM (SELECT * FROM named WHERE seq = 0) p JOIN lined l ON l.name <> p.name AND (y0 > y) <> (y1 > y) AND x < x0 + (y - y0) * (x1 - x0) / (y1 - y0) GROUP BY 1, 2 HAVING count(*) % 2 = 1),
  depths AS (SELECT name, count(*) AS d FROM within GROUP BY name),
  nested AS (SELECT s.name, s.area, coalesce(any_value(m.d), 0) AS depth, arg_max(w.around, coalesce(o.d, 0)) AS parent FROM (SELECT name, sum(x0 * y1 - x1 * y0) / 2 AS area FROM lined GROUP BY name) s
    LEFT JOIN depths m ON m.name = s.name LEFT JOIN within w ON w.name = s.name LEFT JOIN depths o ON o.name = w.around GROUP BY s.name, s.area)""")))
def s14_nested(spark, d):
    m = deep(X.mesh(spark, d))
    parts = Y.closed_parts(Y.boundary_rings(m), m.nodes).withColumn("ring", F.concat_ws(":", "ring", "loop", "part"))
    order = F.row_number().over(S.Window.partitionBy("ring").orderBy("seq")) - 1
    rings = Y.stored(parts.select("ring", order.alias("seq"), "x", "y"))
    nest = IO.nest_rings(rings)
    out = nest.select(F.col("ring").alias("name"), F.expr("if(depth % 2 = 0, ring, parent)").alias("polygon"), "depth", "area")
    return rounded(out, "area")
