"""Queries on overturning, heat transport, stream functions and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlake.operators import interp as I
from meshlake.operators import mesh as G
from meshlake.operators import reduce as R
from meshlake.operators import regions as S
from meshlake.operators import transect as T
from meshlake.operators import transport as D
from meshlake.operators import windows as W
from meshlake.plans import fixtures as X
from meshlake.plans.fixtures import with_tables as sql
from meshlake.plans.mesh_queries import _HITS, REGIONS
from meshlake.plans.registry import query, rn, rounded
from meshlake.streaming import incremental as Q

DLAT = 4.0
_BINS = """bins AS (SELECT {by}, CAST(round_even(lat / 4, 0) AS INTEGER) AS i, coalesce(sum(w * w_A * 1e-6), 0) AS s FROM {src} GROUP BY ALL),
axis AS (SELECT unnest(range((SELECT min(CAST(round_even(lat / 4, 0) AS INTEGER)) FROM {src}), (SELECT max(CAST(round_even(lat / 4, 0) AS INTEGER)) FROM {src}) + 1)) AS i),
grid AS (SELECT {by}, axis.i, coalesce(s, 0) AS s FROM (SELECT DISTINCT {by} FROM bins) g JOIN axis ON true LEFT JOIN bins USING ({by}, i)),
moc AS (SELECT {by}, CAST(i * 4 AS DOUBLE) AS lat, -sum(s) OVER (PARTITION BY {by} ORDER BY i DESC) AS moc FROM grid)"""


def _moc_sql(by: str, source: str, query_text: str, more: str = "", names: str = "nodes node_area mean_n") -> str:
    return sql(names, query_text, (more + ", " if more else "") + f"src AS ({source}), " + _BINS.format(by=by, src="src"))


_GLOBAL = "SELECT k, lat, w, w_A FROM mean_n JOIN nodes USING (node) JOIN node_area USING (node, k)"


@query("d01_zmoc", _moc_sql("k", _GLOBAL, "SELECT k, lat, round(moc + 1e-9, 6) + 0.0 AS moc FROM moc"))
def d01(spark, d):
    return rounded(D.zmoc(X.mean_n(spark, d).select("node", "k", "w"), X.mesh(spark, d), dlat=DLAT), "moc")


@query("d01_zmoc_basin", _moc_sql("k", _GLOBAL + " WHERE node IN (SELECT node FROM hits WHERE region = 'box') AND node NOT IN (SELECT node FROM hits WHERE region = 'bay')", "SELECT k, lat, round(moc + 1e-9, 6) + 0.0 AS moc FROM moc", _HITS))
def d01b(spark, d):
    m = X.mesh(spark, d)
    cells = S.basin(m, S.boxes_to_regions(spark, REGIONS), "box", "bay")
    return rounded(D.zmoc(X.mean_n(spark, d).select("node", "k", "w"), m, cells, dlat=DLAT), "moc")


@query("d02_zmoc_elems", _moc_sql("k", """SELECT k, p.lat, v AS w, area AS w_A FROM (SELECT elem, k, coalesce(sum(w), 0) / 3 AS v FROM elem_node JOIN mean_n USING (node) GROUP BY elem, k)
  JOIN elems USING (elem) JOIN area USING (elem) JOIN (SELECT elem, avg(lat) AS lat FROM elem_node JOIN nodes USING (node) GROUP BY elem) p USING (elem) WHERE k < e_iz""",
  "SELECT k, lat, round(moc + 1e-9, 6) + 0.0 AS moc FROM moc", names="elem_node area mean_n"))
def d02(spark, d):
    return rounded(D.zmoc(X.mean_n(spark, d).select("node", "k", "w"), X.mesh(spark, d), dlat=DLAT, on_elems=True), "moc")


_YEARLY = "SELECT year, k, lat, w, w_A FROM (SELECT CAST(year(time) AS INTEGER) AS year, node, k, avg(w) AS w FROM field_n GROUP BY 1, 2, 3) JOIN nodes USING (node) JOIN node_area USING (node, k)"


def _yearly(spark, d):
    f = X.field_n(spark, d).groupBy(F.year("time").alias("year"), "node", "k").agg(F.avg("w").alias("w"))
    return D.zmoc(f, X.mesh(spark, d), dlat=DLAT, by=("year", "k"))


_TOUCHED = "SELECT * FROM (" + _YEARLY.replace("FROM field_n", "FROM field_n WHERE year(time) IN (SELECT year(l_shipdate) FROM lineitem WHERE l_quantity = 50 AND l_shipdate >= TIMESTAMP '2000-01-01')") + ")"


@query("st03_moc_years", _moc_sql("year, k", _TOUCHED, "SELECT year, k, lat, round(moc + 1e-9, 6) + 0.0 AS moc FROM moc", names="nodes node_area field_n"))
def st03(spark, d):
    """The batch half of the incremental overturning: the years that late, full-quantity lines touch are computed anew."""
    batch = X.table(spark, d, "lineitem").where("l_quantity = 50 and l_shipdate >= timestamp_ntz '2000-01-01'").select(F.col("l_shipdate").alias("time"))
    m = X.mesh(spark, d)

    def moc(rows):
        return D.zmoc(rows.groupBy("year", "node", "k").agg(F.avg("w").alias("w")), m, dlat=DLAT, by=("year", "k"))

    return rounded(Q.recompute_years(batch, X.field_n(spark, d), moc), "moc")


@query("d16_zmoc_series", _moc_sql("year, k", _YEARLY, "SELECT year, k, lat, round(moc + 1e-9, 6) + 0.0 AS moc FROM moc", names="nodes node_area field_n"))
def d16(spark, d):
    return rounded(_yearly(spark, d), "moc")


@query("w14_moc_strength", _moc_sql("year, k", _YEARLY, """SELECT year, round(arg_min(m, (abs(lat - 26), lat)) + 1e-9, 6) + 0.0 AS moc FROM (
  SELECT year, lat, max(moc) AS m FROM moc JOIN thick USING (k) WHERE zmid BETWEEN -2500 AND -20 GROUP BY year, lat) GROUP BY year""", names="nodes node_area field_n thick"))
def w14(spark, d):
    moc = _yearly(spark, d).join(F.broadcast(G.mid_levels(X.levels(spark)).select("k", F.col("zmid").alias("z"))), "k")
    return rounded(W.moc_series(moc, "upper", depth=(-2500.0, -20.0), lat=26.0, by=["year"]), "moc")


_INPUTS = """inp AS (SELECT elem, nd, avg(srf / w_A * 1024 / w_dens) * any_value(area) AS srf, avg(div / w_A) * any_value(area) AS div FROM (
  SELECT f.*, w_dens, w_A FROM fluxes f JOIN dens USING (nd) JOIN (SELECT node, sum(area) / 3 AS w_A FROM elem_node JOIN area USING (elem) GROUP BY node) USING (node)
) JOIN elem_node USING (node) JOIN area USING (elem) GROUP BY elem, nd)"""
_PLACE = "place AS (SELECT elem, avg(lat) AS lat FROM elem_node JOIN nodes USING (node) GROUP BY elem)"


def _inputs(spark, d):
    m = X.mesh(spark, d)
    return D.dmoc_inputs(X.dens_fluxes(m.nodes), X.dens_levels(spark), G.node_area(m, per_level=False), m, ["srf", "div"]), m


@query("d03_dmoc_inputs", sql("fluxes elem_node area", "SELECT elem, nd, round(srf + 1e-7, 4) + 0.0 AS srf, round(div + 1e-7, 4) + 0.0 AS div FROM inp", _INPUTS))
def d03(spark, d):
    return _inputs(spark, d)[0].select("elem", "nd", *((rn(c, 4) + 0.0).alias(c) for c in ("srf", "div")))


@query("d04_dmoc", sql("fluxes elem_node area", """SELECT lat + 0.0 AS lat, nd, round(srf + 1e-12, 9) + 0.0 AS srf, round(sum(div) OVER (PARTITION BY lat ORDER BY nd DESC) + 1e-12, 9) + 0.0 AS div FROM (
  SELECT lat, nd, -sum(srf) OVER w AS srf, -sum(div) OVER w AS div FROM (SELECT round_even(lat / 4, 0) * 4 AS lat, nd, sum(srf) * 1e-6 AS srf, sum(div) * 1e-6 AS div FROM inp JOIN place USING (elem) GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY nd ORDER BY lat DESC))""", f"{_INPUTS}, {_PLACE}"))
def d04(spark, d):
    inputs, m = _inputs(spark, d)
    place = G.elem_node(m.elems).join(m.nodes.select("node", "lat"), "node").groupBy("elem").agg(F.avg("lat").alias("lat"))
    return D.dmoc(inputs, place, ["srf", "div"], DLAT).select((F.col("lat") + 0.0).alias("lat"), "nd", *((rn(F.col(c), 9) + 0.0).alias(c) for c in ("srf", "div")))


@query("d05_diapycnal", sql("fluxes elem_node area", "SELECT elem, round(sum(div) + 1e-7, 4) + 0.0 AS w FROM inp WHERE nd >= 4 GROUP BY elem", _INPUTS))
def d05(spark, d):
    out = D.diapycnal(_inputs(spark, d)[0], X.dens_levels(spark), "div", 36.6)
    return out.select("elem", (rn("w", 4) + 0.0).alias("w"))


@query("d06_surface_transformation", sql("fluxes elem_node area", "SELECT elem, round(-srf + 1e-7, 4) + 0.0 AS srf FROM inp WHERE nd = 4", _INPUTS))
def d06(spark, d):
    out = D.surface_transformation(_inputs(spark, d)[0], X.dens_levels(spark), "srf", 36.6)
    return out.select("elem", (rn("srf", 4) + 0.0).alias("srf"))


@query("w05_class_depth", sql("fluxes", "SELECT node, nd, coalesce(sum(h) OVER (PARTITION BY node ORDER BY nd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.0 AS z FROM fluxes"))
def w05(spark, d):
    return W.class_depth(X.dens_fluxes(X.nodes(spark, d)), ["node"]).select("node", "nd", "z")


_SURFACE = "SELECT lat, (temp - 14) * 40 AS value, w_A FROM mean_n JOIN nodes USING (node) JOIN node_area USING (node, k) WHERE k = 0"


def _surface(spark, d):
    m = X.mesh(spark, d)
    return X.mean_n(spark, d).where("k = 0").join(m.nodes.select("node", "lat"), "node").join(G.node_area(m), ["node", "k"]).withColumn("value", (F.col("temp") - 14) * 40)


@query("d07_global_heat", sql("nodes node_area mean_n", f"""SELECT lat + 0.0 AS lat, round(-sum(s) OVER (ORDER BY lat) + 1e-9, 6) + 0.0 AS heat FROM (SELECT *, max(lat) OVER () AS e FROM (
  SELECT trunc(lat / 4) * 4 AS lat, sum(value * w_A) * 1e-15 AS s FROM ({_SURFACE}) GROUP BY 1)) WHERE lat < e"""))
def d07(spark, d):
    return rounded(D.heat_from_surface(_surface(spark, d), DLAT, truncate=True).withColumn("lat", F.col("lat") + 0.0), "heat")


@query("d08_regional_heat", sql("nodes node_area mean_n", f"""SELECT region, lat + 0.0 AS lat, round(-sum(s) OVER (PARTITION BY region ORDER BY lat) + 1e-9, 6) + 0.0 AS heat FROM (
  SELECT region, round_even(lat / 4, 0) * 4 AS lat, sum(value * w_A) * 1e-15 AS s FROM ({_SURFACE.replace('SELECT lat', 'SELECT node, lat')}) JOIN hits USING (node) GROUP BY 1, 2)""", _HITS))
def d08(spark, d):
    hits = S.in_regions(X.nodes(spark, d), S.boxes_to_regions(spark, REGIONS), "node", "lon", "lat")
    return rounded(D.heat_from_surface(_surface(spark, d).join(hits, "node"), DLAT, by=("region",)).withColumn("lat", F.col("lat") + 0.0), "heat")


def _cross(axis: str, lines: str, guard: str = "") -> str:
    return f"""cross_ AS (SELECT n0, n1, l.b AS bin, unnest([0, 1]) AS side, tri_l, tri_r, dx_l, dy_l, dx_r, dy_r, x0, y0, x1, y1 FROM edges JOIN ({lines}) l ON ({axis}0 - l.b) * ({axis}1 - l.b) <= 0 {guard}),
  sided AS (SELECT n0, n1, bin, if(side = 0, tri_l, tri_r) AS elem, y0, y1, if({axis}0 <= bin, -1, 1) * if(side = 0, dy_l, -dy_r) AS a, if({axis}0 <= bin, -1, 1) * if(side = 0, -dx_l, dx_r) AS b FROM cross_)"""


_HEAT = """SELECT bin + 0.0 AS bin, round(coalesce(sum((u * a + v * b) * (t.temp + s.temp) * 0.5 * w_z), 0) * (-1030.0 * 3850.0 * 1e-15) + 1e-9, 6) + 0.0 AS heat
  FROM sided JOIN field_e USING (elem) JOIN mean_n t ON t.node = n0 AND t.k = field_e.k JOIN mean_n s ON s.node = n1 AND s.k = field_e.k JOIN thick ON thick.k = field_e.k GROUP BY bin"""


@query("d09_meridional_heat", sql("edges field_e mean_n thick", _HEAT, _cross("y", "SELECT -78 + unnest(range(0, 40)) * CAST(4 AS DOUBLE) AS b")))
def d09(spark, d):
    m = X.mesh(spark, d)
    return rounded(D.crossed_heat(X.field_e(m.elems), X.mean_n(spark, d), X.edges(m), m, "y", first=-78.0, step=4.0, last=78.0), "heat")


@query("d10_zonal_heat", sql("edges field_e mean_n thick", _HEAT, _cross("x", "SELECT -175 + unnest(range(0, 36)) * CAST(10 AS DOUBLE) AS b", "AND abs(x0 - l.b) < 50 AND abs(x1 - l.b) < 50")))
def d10(spark, d):
    m = X.mesh(spark, d)
    return rounded(D.crossed_heat(X.field_e(m.elems), X.mean_n(spark, d), X.edges(m), m, "x", first=-175.0, step=10.0, last=175.0, guard=50.0), "heat")


@query("d11_streamfunction", sql("edges field_e thick", """SELECT -180 + (ix + 0.5) * 10 AS lon, -90 + (iy + 0.5) * 10 AS lat,
  round(CASE WHEN ix = 0 THEN lead(psi) OVER l WHEN ix = 35 THEN lag(psi) OVER l ELSE psi END + 1e-7, 4) + 0.0 AS psi FROM (
    SELECT ix, iy, c - last_value(c) OVER (PARTITION BY ix ORDER BY iy ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS psi FROM (
      SELECT ix, iy, -sum(coalesce(s, 0)) OVER (PARTITION BY ix ORDER BY iy) AS c FROM (SELECT unnest(range(0, 36)) AS ix) JOIN (SELECT unnest(range(0, 18)) AS iy) ON true LEFT JOIN sums USING (ix, iy))) WINDOW l AS (PARTITION BY iy ORDER BY ix)""",
  _cross("x", "SELECT -175 + unnest(range(0, 36)) * CAST(10 AS DOUBLE) AS b", "AND abs(x0 - l.b) < 50 AND abs(x1 - l.b) < 50")
  + """, sums AS (SELECT CAST(round_even((bin + 180) / 10 - 0.5, 0) AS INTEGER) AS ix, CAST(ceil(((y0 + y1) / 2 + 90) / 10) - 1 AS INTEGER) AS iy, sum((u * a + v * b) * w_z) * -1e-6 AS s
    FROM sided JOIN field_e USING (elem) JOIN thick USING (k) GROUP BY 1, 2)"""))
def d11(spark, d):
    m = X.mesh(spark, d)
    out = D.barotropic_streamfunction(X.field_e(m.elems), X.edges(m), m, lon0=-180.0, dlon=10.0, nlon=36, lat0=-90.0, dlat=10.0, nlat=18)
    return out.select("lon", "lat", (rn("psi", 4) + 0.0).alias("psi"))


#: Sections of the test queries.
LINES = {"atlantic": ([-60.05, 5.03], [20.07, 35.11]), "kink": ([100.0, 120.4, 150.3], [-50.3, -10.2, 30.9])}


def _segments() -> str:
    rows = []
    for name, (x, y) in sorted(LINES.items()):
        for k in range(len(x) - 1):
            a, b = (x[k], y[k]), (x[k + 1], y[k + 1])
            if b[0] < a[0] and b[1] <= a[1]:
                a, b = b, a
            n = ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5
            rows.append("('{}', {}, {}, {}, {}, {}, {!r}, {!r})".format(name, k, *(f"CAST({v!r} AS DOUBLE)" for v in (*a, *b)), -(b[1] - a[1]) / n, (b[0] - a[0]) / n))
    return "seg AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(name, seg, sx0, sy0, sx1, sy1, nx, ny))"


_CUTS = _segments() + """, solved AS (SELECT e.*, seg.*, (sx1 - sx0) * (y1 - y0) - (sy1 - sy0) * (x1 - x0) AS det FROM edges e JOIN seg ON abs(x1 - x0) < 180
    AND least(x0, x1) >= least(sx0, sx1) - 10 AND greatest(x0, x1) <= greatest(sx0, sx1) + 10 AND least(y0, y1) >= least(sy0, sy1) - 10 AND greatest(y0, y1) <= greatest(sy0, sy1) + 10),
  st AS (SELECT *, ((x0 - sx0) * (y1 - y0) - (y0 - sy0) * (x1 - x0)) / det AS s, ((x0 - sx0) * (sy1 - sy0) - (y0 - sy0) * (sx1 - sx0)) / det AS lint FROM solved WHERE abs(det) > 1e-12),
  cuts AS (SELECT *, x0 + lint * (x1 - x0) AS px, y0 + lint * (y1 - y0) AS py, row_number() OVER (PARTITION BY name, seg ORDER BY s, n0, n1) AS rank FROM st
    WHERE s BETWEEN -1.1920929e-07 AND 1 + 1.1920929e-07 AND lint BETWEEN -1.1920929e-07 AND 1 + 1.1920929e-07)"""


def _cut(spark, d, m=None):
    return T.cut_edges(T.transects(spark, LINES), X.edges(m or X.mesh(spark, d)))


@query("t02_cut_edges", sql("edges", "SELECT name, CAST(seg AS INTEGER) AS seg, CAST(rank AS INTEGER) AS rank, n0, n1, round(px + 1e-9, 6) + 0.0 AS px, round(py + 1e-9, 6) + 0.0 AS py, round(lint + 1e-9, 6) + 0.0 AS lint FROM cuts", _CUTS))
def t02(spark, d):
    return rounded(_cut(spark, d).select("name", "seg", "rank", "n0", "n1", "px", "py", "lint"), "px", "py", "lint")


@query("v11_path_distance", sql("edges", """SELECT name, CAST(seg AS INTEGER) AS seg, CAST(rank AS INTEGER) AS rank, round(sum(step) OVER (PARTITION BY name ORDER BY seg, rank ROWS UNBOUNDED PRECEDING) + 1e-6, 3) + 0.0 AS dist FROM (
  SELECT name, seg, rank, if(lag(px) OVER w IS NULL, 0, greatest(1, acos(least(1, cos(radians(lag(py) OVER w)) * cos(radians(lag(px) OVER w)) * cos(radians(py)) * cos(radians(px))
    + cos(radians(lag(py) OVER w)) * sin(radians(lag(px) OVER w)) * cos(radians(py)) * sin(radians(px)) + sin(radians(lag(py) OVER w)) * sin(radians(py)))) * 6367.5)) AS step FROM cuts WINDOW w AS (PARTITION BY name ORDER BY seg, rank))""", _CUTS))
def v11(spark, d):
    return T.path_distance(_cut(spark, d)).select("name", "seg", "rank", (rn("dist", 3) + 0.0).alias("dist"))


_PATH = _CUTS + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY name, seg ORDER BY rank) AS i, count(*) OVER (PARTITION BY name, seg) AS n, dx_l * (sx1 - sx0) + dy_l * (sy1 - sy0) >= 0 AS ahead FROM cuts),
  path AS (SELECT name, seg, rank, 0 AS sub, if(ahead, tri_r, tri_l) AS elem, -if(ahead, dx_r, dx_l) AS dx, -if(ahead, dy_r, dy_l) AS dy FROM ordered WHERE i > 1
    UNION ALL SELECT name, seg, rank, 1, if(ahead, tri_l, tri_r), if(ahead, dx_l, dx_r), if(ahead, dy_l, dy_r) FROM ordered WHERE i < n)"""


@query("t04_transport_path", sql("edges", "SELECT name, CAST(seg AS INTEGER) AS seg, CAST(rank AS INTEGER) AS rank, CAST(sub AS INTEGER) AS sub, coalesce(elem, -1) AS elem, round(dx * 1e-3 + 1e-9, 6) + 0.0 AS dx, round(dy * 1e-3 + 1e-9, 6) + 0.0 AS dy FROM path", _PATH))
def t04(spark, d):
    out = T.transport_path(_cut(spark, d)).select("name", "seg", "rank", "sub", F.coalesce("elem", F.lit(-1)).alias("elem"), "dx", "dy")
    return rounded(out, "dx", "dy", scale=1e-3)


@query("d12_transect_transport", sql("edges field_e thick", "SELECT name, round(coalesce(sum((-u * dy + v * dx) * w_z * 1e-6), 0) + 1e-7, 4) + 0.0 AS transport FROM path JOIN field_e USING (elem) JOIN thick USING (k) GROUP BY name", _PATH))
def d12(spark, d):
    m = X.mesh(spark, d)
    return T.transect_transport(T.transport_path(_cut(spark, d, m)), X.field_e(m.elems), m).select("name", (rn("transport", 4) + 0.0).alias("transport"))


@query("d13_transect_scalar", sql("edges mean_n", "SELECT name, CAST(seg AS INTEGER) AS seg, CAST(rank AS INTEGER) AS rank, a.k, round(a.temp + (b.temp - a.temp) * lint + 1e-9, 6) + 0.0 AS temp FROM cuts JOIN mean_n a ON a.node = n0 JOIN mean_n b ON b.node = n1 AND b.k = a.k", _CUTS))
def d13(spark, d):
    return rounded(T.transect_scalar(_cut(spark, d), X.mean_n(spark, d), "temp", ["k"]), "temp")


@query("w10_land_points", sql("edges", """SELECT name, CAST(seg AS INTEGER) AS seg, CAST(rank AS INTEGER) AS rank, CAST(sub AS INTEGER) AS sub, round(if(sub = 0, px, NULL) + 1e-9, 6) + 0.0 AS px FROM (
  SELECT *, unnest(if(tri_r IS NULL AND coalesce(lead(tri_r IS NULL) OVER (PARTITION BY name, seg ORDER BY rank), false), [0, 1, 2], [0])) AS sub FROM cuts)""", _CUTS))
def w10(spark, d):
    return rounded(T.with_land_points(_cut(spark, d)).select("name", "seg", "rank", "sub", "px"), "px")


@query("d15_horizontal_slice", sql("nodes field_n", """SELECT node, round(a - (SELECT avg(a) FROM sl) + 1e-9, 6) + 0.0 AS temp FROM sl""",
  """wet AS (SELECT node, k, avg(if(k < n_iz, temp, NULL)) AS temp FROM field_n JOIN nodes USING (node) WHERE month(time) IN (6, 7, 8) GROUP BY node, k),
  sl AS (SELECT a.node, a.temp * (2250.0::DOUBLE - 2000) / 1250 + b.temp * (2000 - 1000.0::DOUBLE) / 1250 AS a FROM wet a JOIN wet b ON a.node = b.node AND a.k = 4 AND b.k = 5 WHERE a.temp IS NOT NULL AND b.temp IS NOT NULL)"""))
def d15(spark, d):
    f = R.mask_bottom(R.select_time(X.field_n(spark, d), months=[6, 7, 8]), X.nodes(spark, d), "node", "n_iz", ["temp"], keep_interface=False)
    f = R.reduce_time(f, "mean", "temp", ["node", "k"])
    mid = G.mid_levels(X.levels(spark)).select("k", F.col("zmid").alias("z"))
    cut = I.interp_depth(R.select_levels(f, mid, [-2000.0]), mid, "temp", [-2000.0], ["node"])
    mean = cut.agg(F.avg("temp").alias("m"))
    return rounded(cut.join(F.broadcast(mean)).select("node", (F.col("temp") - F.col("m")).alias("temp")), "temp")


@query("i12_density_to_depth", sql("nodes", """SELECT p.node, p.z, round(coalesce(max(y0 + (y1 - y0) * (r - r0) / (r1 - r0)), 0) + 1e-9, 6) + 0.0 AS m FROM pts p LEFT JOIN (
  SELECT node, r AS r0, m AS y0, lead(r) OVER w AS r1, lead(m) OVER w AS y1 FROM curve WINDOW w AS (PARTITION BY node ORDER BY r)) s ON s.node = p.node AND r1 > r0 AND p.r BETWEEN r0 AND r1 GROUP BY p.node, p.z""",
  """curve AS (SELECT node, 30 + n * 1.5::DOUBLE AS r, CAST((node * 7 + n * 5) % 23 AS DOUBLE) AS m FROM nodes, (SELECT unnest(range(0, 6)) AS n)),
  pts AS (SELECT node, z, 29 + z * 0.9::DOUBLE + node % 3 AS r FROM nodes, (SELECT unnest(range(0, 8)) AS z))"""))
def i12(spark, d):
    n = X.nodes(spark, d).select("node")
    curve = n.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("node", (F.lit(30.0) + F.col("n") * 1.5).alias("r"), ((F.col("node") * 7 + F.col("n") * 5) % 23).cast("double").alias("m"))
    pts = n.withColumn("z", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))).withColumn("p", F.lit(29.0) + F.col("z") * 0.9 + F.col("node") % 3)
    return rounded(I.bracket(pts, curve, ["node"], "p", "r", "m").select("node", "z", "m"), "m")
