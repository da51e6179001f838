"""Queries on mesh geometry, connectivity, sources and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlake.functions import expr
from meshlake.operators import mesh as G
from meshlake.operators import reduce as R
from meshlake.operators import regions as S
from meshlake.operators import windows as W
from meshlake.plans import fixtures as X
from meshlake.plans.fixtures import with_tables as sql
from meshlake.plans.registry import query, r6, rn, rounded


@query("g01_centroids", sql("corners", "SELECT elem, round((lon0 + lon1 + lon2) / 3 + 1e-9, 6) + 0.0 AS x, round((lat0 + lat1 + lat2) / 3 + 1e-9, 6) + 0.0 AS y FROM corners"))
def g01(spark, d):
    return rounded(G.centroids(X.mesh(spark, d)), "x", "y")


@query("g02_cyclic_centroids", sql("corners", """SELECT elem, round((if(lon0 - m >= 180, lon0 - 360, lon0) + if(lon1 - m >= 180, lon1 - 360, lon1) + if(lon2 - m >= 180, lon2 - 360, lon2)) / 3 + 1e-9, 6) + 0.0 AS x,
  round((lat0 + lat1 + lat2) / 3 + 1e-9, 6) + 0.0 AS y FROM (SELECT *, least(lon0, lon1, lon2) AS m FROM corners)"""))
def g02(spark, d):
    return rounded(G.centroids(X.mesh(spark, d), cyclic=True), "x", "y")


@query("g03_elem_area", sql("area", "SELECT elem, round(area * 1e-6 + 1e-6, 3) + 0.0 AS area_km2 FROM area"))
def g03(spark, d):
    return G.elem_area(X.mesh(spark, d)).select("elem", (rn(F.col("area") * 1e-6, 3) + 0.0).alias("area_km2"))


_SIDES = """sides AS (SELECT elem, unnest([
  sqrt(pow((lon1 - lon0 - floor((lon1 - lon0) / 360 + 0.5) * 360) * cos(radians((lat0 + lat1) / 2)), 2) + pow(lat1 - lat0, 2)),
  sqrt(pow((lon2 - lon1 - floor((lon2 - lon1) / 360 + 0.5) * 360) * cos(radians((lat1 + lat2) / 2)), 2) + pow(lat2 - lat1, 2)),
  sqrt(pow((lon0 - lon2 - floor((lon0 - lon2) / 360 + 0.5) * 360) * cos(radians((lat2 + lat0) / 2)), 2) + pow(lat0 - lat2, 2))]) * 6367.5 * pi() / 180 AS s FROM corners)"""


@query("g04_elem_resolution", sql("corners", "SELECT elem, round(avg(s) + 1e-9, 6) + 0.0 AS mean, round(max(s) + 1e-9, 6) + 0.0 AS max, round(min(s) + 1e-9, 6) + 0.0 AS min FROM sides GROUP BY elem", _SIDES))
def g04(spark, d):
    return rounded(G.elem_sides(X.mesh(spark, d)), "mean", "max", "min", scale=1e-3)


@query("g05_node_area", sql("node_area", "SELECT node, k, round(w_A * 1e-6 + 1e-6, 3) + 0.0 AS area_km2 FROM node_area"))
def g05(spark, d):
    return G.node_area(X.mesh(spark, d)).select("node", "k", (rn(F.col("w_A") * 1e-6, 3) + 0.0).alias("area_km2"))


@query("g06_node_area_flat", sql("area elem_node", "SELECT node, round(sum(area) / 3 * 1e-6 + 1e-6, 3) + 0.0 AS area_km2 FROM elem_node JOIN area USING (elem) GROUP BY node"))
def g06(spark, d):
    return G.node_area(X.mesh(spark, d), per_level=False).select("node", (rn(F.col("w_A") * 1e-6, 3) + 0.0).alias("area_km2"))


@query("g07_node_resolution", sql("area elem_node", "SELECT node, round(2 * sqrt(sum(area) / 3 / pi()) * 1e-3 + 1e-9, 6) + 0.0 AS resol_km, round(sum(area * s) / sum(area) + 1e-9, 6) + 0.0 AS mean_km FROM elem_node JOIN area USING (elem) JOIN (SELECT elem, avg(s) AS s FROM sides GROUP BY elem) USING (elem) GROUP BY node", _SIDES))
def g07(spark, d):
    m = X.mesh(spark, d)
    a = G.node_resolution(m).select("node", r6(F.col("resol") * 1e-3).alias("resol_km"))
    return a.join(G.node_resolution(m, "elements").select("node", r6(F.col("resol") * 1e-3).alias("mean_km")), "node")


@query("g08_weights", sql("node_area thick field_n", "SELECT time, node, k, round(temp + 1e-9, 6) + 0.0 AS temp, round(w_A * 1e-6 + 1e-6, 3) + 0.0 AS area_km2, w_z FROM field_n LEFT JOIN node_area USING (node, k) JOIN thick USING (k)"))
def g08(spark, d):
    out = G.weights(X.field_n(spark, d), X.mesh(spark, d), vertical=True)
    return out.select("time", "node", "k", r6("temp").alias("temp"), (rn(F.col("w_A") * 1e-6, 3) + 0.0).alias("area_km2"), "w_z")


@query("g09_edge_table", sql("edge_table", "SELECT n0, n1, tri_l, coalesce(tri_r, -1) AS tri_r FROM edge_table"))
def g09(spark, d):
    return G.edge_table(X.mesh(spark, d).elems).withColumn("tri_r", F.coalesce("tri_r", F.lit(-1)))


@query("g10_boundary_edges", sql("edge_table", "SELECT n0, n1, tri_l AS elem FROM edge_table WHERE tri_r IS NULL"))
def g10(spark, d):
    return G.boundary_edges(X.mesh(spark, d).elems)


@query("g11_node_elems", sql("elem_node", "SELECT node, array_to_string(list(elem ORDER BY elem), ',') AS elems FROM elem_node GROUP BY node"))
def g11(spark, d):
    return G.node_elems(X.mesh(spark, d).elems).select("node", F.array_join("elems", ",").alias("elems"))


@query("g12_node_neighbours", sql("edge_table", "SELECT n0 AS node, n1 AS neighbour FROM edge_table UNION ALL SELECT n1, n0 FROM edge_table"))
def g12(spark, d):
    return G.node_neighbours(X.mesh(spark, d).elems)


@query("g13_elem_neighbours", sql("edge_table", "SELECT tri_l AS elem, tri_r AS neighbour FROM edge_table WHERE tri_r IS NOT NULL UNION ALL SELECT tri_r, tri_l FROM edge_table WHERE tri_r IS NOT NULL"))
def g13(spark, d):
    return G.elem_neighbours(X.mesh(spark, d).elems)


@query("g17_reindex", sql("elems elem_node", """SELECT e.elem, a.new AS n0, b.new AS n1, c.new AS n2 FROM part_elems e JOIN renum a ON a.node = n0 JOIN renum b ON b.node = n1 JOIN renum c ON c.node = n2""",
  """part_elems AS (SELECT * FROM elems WHERE e_iz >= 3), used AS (SELECT DISTINCT unnest([n0, n1, n2]) AS node FROM part_elems), renum AS (SELECT node, CAST(row_number() OVER (ORDER BY node) - 1 AS INTEGER) AS new FROM used)"""))
def g17(spark, d):
    m = X.mesh(spark, d)
    # the sub-mesh of deep elements
    return G.reindex(m.elems.where("e_iz >= 3").drop("e_iz"), m.nodes)[0]


@query("g20_rows_in", "SELECT p_partkey % 40 AS a, p_size % 7 AS b FROM part WHERE (p_partkey % 40) IN (SELECT p_size FROM part WHERE p_size > 30) AND (p_size % 7) IN (SELECT p_size % 5 FROM part WHERE p_size > 30)")
def g20(spark, d):
    part = X.table(spark, d, "part")
    return G.rows_in(part.where("p_size > 30").select(F.col("p_size").alias("a"), F.expr("p_size % 5").alias("b")), part.select(F.expr("p_partkey % 40").alias("a"), F.expr("p_size % 7").alias("b")), per_column=True)


@query("g21_table_diff", sql("nodes levels", "SELECT node, a.zlev - b.zlev AS diff FROM nodes JOIN levels a ON a.k = n_iz JOIN levels b ON b.k = greatest(n_iz - 1, 2)"))
def g21(spark, d):
    m = X.mesh(spark, d)
    depth = lambda k: m.nodes.withColumn("k", k).join(F.broadcast(m.levels), "k").select("node", F.col("zlev").alias("z"))
    return G.table_diff(depth(F.col("n_iz")), depth(F.greatest(F.col("n_iz") - 1, F.lit(2))), "node", "z")


@query("f14_periodic_elems", sql("corners", "SELECT elem FROM corners WHERE greatest(lon0, lon1, lon2) - least(lon0, lon1, lon2) > 240"))
def f14(spark, d):
    return G.periodic_elems(X.mesh(spark, d))


@query("s10_edges", sql("edges", "SELECT n0, n1, tri_l, coalesce(tri_r, -1) AS tri_r, round(dx_l * 1e-3 + 1e-9, 6) + 0.0 AS dx_l, round(dy_l * 1e-3 + 1e-9, 6) + 0.0 AS dy_l, round(dx_r * 1e-3 + 1e-9, 6) + 0.0 AS dx_r, round(dy_r * 1e-3 + 1e-9, 6) + 0.0 AS dy_r FROM edges"))
def s10(spark, d):
    return rounded(X.edges(X.mesh(spark, d)), "dx_l", "dy_l", "dx_r", "dy_r", scale=1e-3).withColumn("tri_r", F.coalesce("tri_r", F.lit(-1))).drop("x0", "y0", "x1", "y1")


_ROT = (50.0, 15.0, -90.0)


def _matrix(transpose=False):
    m = expr.euler(_ROT)
    return [list(r) for r in zip(*m, strict=True)] if transpose else m


def _turn(m, x, y, z):
    return [f"({x}) * {a!r}::DOUBLE + ({y}) * {b!r}::DOUBLE + ({z}) * {c!r}::DOUBLE" for a, b, c in m]


_CART = ("cos(radians(lat)) * cos(radians(lon))", "cos(radians(lat)) * sin(radians(lon))", "sin(radians(lat))")
_RC = _turn(_matrix(), *_CART)


@query("v02_cart3d", sql("nodes", f"SELECT node, round({_CART[0]} + 1e-9, 6) + 0.0 AS x, round({_CART[1]} + 1e-9, 6) + 0.0 AS y, round({_CART[2]} + 1e-9, 6) + 0.0 AS z FROM nodes"))
def v02(spark, d):
    x, y, z = expr.cart3d(F.col("lon"), F.col("lat"))
    return X.nodes(spark, d).select("node", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"))


@query("v03_rotate_grid", sql("nodes", f"SELECT node, round(degrees(atan2({_RC[1]}, {_RC[0]})) + 1e-9, 6) + 0.0 AS rlon, round(degrees(asin(greatest(-1, least(1, {_RC[2]})))) + 1e-9, 6) + 0.0 AS rlat FROM nodes"))
def v03(spark, d):
    a, b = expr.geo_to_rot(_ROT, F.col("lon"), F.col("lat"))
    return X.nodes(spark, d).select("node", r6(a).alias("rlon"), r6(b).alias("rlat"))


@query("v03_rotate_back", sql("nodes", "SELECT node, round(lon + 200.1 - floor((lon + 200.1) / 360) * 360 + 1e-9, 6) + 0.0 AS lon, round(lat + 1e-9, 6) + 0.0 AS lat FROM nodes"))
def v03b(spark, d):
    a, b = expr.rot_to_geo(_ROT, *expr.geo_to_rot(_ROT, F.col("lon"), F.col("lat")))
    # longitudes are equal modulo 360; no node lies where they are cut here
    return X.nodes(spark, d).select("node", r6(F.pmod(a + 200.1, F.lit(360.0))).alias("lon"), r6(b).alias("lat"))


@query("v04_refocus", sql("nodes", "SELECT node, round(if(l > 90.0, l, l + 360) + 1e-9, 6) + 0.0 AS lon FROM (SELECT node, lon AS l FROM nodes)").replace("if(l > 90.0, l, l + 360)", "degrees(atan2(sin(radians(l - 30)), cos(radians(l - 30)))) + 30"))
def v04(spark, d):
    return X.nodes(spark, d).select("node", r6(expr.refocus(F.col("lon"), F.col("lat"), 30.0)).alias("lon"))


_CENT = "SELECT e.*, c.cx AS lon, c.cy AS lat FROM field_e e JOIN cent c USING (elem)"
_ROTATED = f"""rotv AS (SELECT elem, k, u, v, lon, lat, atan2({_RC[1]}, {_RC[0]}) AS rl, asin(greatest(-1, least(1, {_RC[2]}))) AS rb FROM ({_CENT})),
xyz AS (SELECT *, -v * sin(rb) * cos(rl) - u * sin(rl) AS px, -v * sin(rb) * sin(rl) + u * cos(rl) AS py, v * cos(rb) AS pz FROM rotv),
gxyz AS (SELECT *, {_turn(_matrix(True), 'px', 'py', 'pz')[0]} AS gx, {_turn(_matrix(True), 'px', 'py', 'pz')[1]} AS gy, {_turn(_matrix(True), 'px', 'py', 'pz')[2]} AS gz FROM xyz)"""


@query("v05_rotate_vector", sql("field_e edges", """SELECT elem, k, round(-gx * sin(radians(lon)) + gy * cos(radians(lon)) + 1e-9, 6) + 0.0 AS u,
  round(-gx * sin(radians(lat)) * cos(radians(lon)) - gy * sin(radians(lat)) * sin(radians(lon)) + gz * cos(radians(lat)) + 1e-9, 6) + 0.0 AS v FROM gxyz""", _ROTATED))
def v05(spark, d):
    m = X.mesh(spark, d)
    lon, lat = [F.col(f"lon{k}") for k in range(3)], [F.col(f"lat{k}") for k in range(3)]
    cx = lon[0] + (expr.wrap(lon[1] - lon[0]) + expr.wrap(lon[2] - lon[0])) / 3
    at = G.corners(m).select("elem", cx.alias("lon"), ((lat[0] + lat[1] + lat[2]) / 3).alias("lat"))
    u, v = expr.rotate_vector(_ROT, F.col("lon"), F.col("lat"), F.col("u"), F.col("v"))
    return X.field_e(m.elems).join(at, "elem").select("elem", "k", r6(u).alias("u"), r6(v).alias("v"))


@query("v06_vector_norm", sql("field_e", "SELECT elem, k, round(sqrt(u * u + v * v) + 1e-9, 6) + 0.0 AS norm FROM field_e"))
def v06(spark, d):
    return X.field_e(X.mesh(spark, d).elems).select("elem", "k", r6(expr.norm(F.col("u"), F.col("v"))).alias("norm"))


def _poly(c, t):
    return "(" + " + ".join(f"{x!r}::DOUBLE" + (f" * pow({t}, {k})" if k else "") for k, x in enumerate(c)) + ")"


def _dens_sql(s, t, p):
    e, q, root = expr.EOS80, p / 10.0, f"({s} * sqrt({s}))"
    rho = f"({_poly(e['water'], t)} + {s} * {_poly(e['salt1'], t)} + {root} * {_poly(e['salt15'], t)} + {s} * {s} * {e['salt2']!r}::DOUBLE)"
    bulk = f"({_poly(e['bulk_water'], t)} + {s} * {_poly(e['bulk_salt1'], t)} + {root} * {_poly(e['bulk_salt15'], t)})"
    a = f"({_poly(e['a_water'], t)} + {s} * {_poly(e['a_salt1'], t)} + {root} * {e['a_salt15']!r}::DOUBLE)"
    b = f"({_poly(e['b_water'], t)} + {s} * {_poly(e['b_salt1'], t)})"
    return f"({rho} / (1 - {q!r}::DOUBLE / ({bulk} + {q!r}::DOUBLE * {a} + {q * q!r}::DOUBLE * {b})))" if p else rho


@query("v07_potential_density", sql("field_n", f"SELECT time, node, k, round({_dens_sql('salt', 'temp', 0.0)} - 1000 + 1e-9, 6) + 0.0 AS sigma0, round({_dens_sql('salt', 'temp', 2000.0)} - 1000 + 1e-9, 6) + 0.0 AS sigma2 FROM field_n"))
def v07(spark, d):
    t, s = F.col("temp"), F.col("salt")
    return X.field_n(spark, d).select("time", "node", "k", r6(expr.sigma(t, s)).alias("sigma0"), r6(expr.sigma(t, s, 2000.0)).alias("sigma2"))


@query("v09_product", sql("field_n", "SELECT a.time, a.node, a.k, round(a.temp * b.salt + 1e-9, 6) + 0.0 AS product, round(a.temp + b.salt + 1e-9, 6) + 0.0 AS total FROM field_n a JOIN field_n b USING (time, node, k)"))
def v09(spark, d):
    f = X.field_n(spark, d)
    product = R.derive(f, "product", ["temp", "salt"]).withColumnRenamed("value", "product")
    both = R.derive(product, "total", ["temp", "salt"])
    return both.select("time", "node", "k", r6("product").alias("product"), r6("value").alias("total"))


@query("v10_decimal_year", "SELECT o_orderkey, round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / if(year(o_orderdate) % 4 = 0, 366.0::DOUBLE, 365.0::DOUBLE) + 1e-9, 6) + 0.0 AS y FROM orders")
def v10(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", r6(expr.decimal_year(F.col("o_orderdate"))).alias("y"))


_BOX = (-30.0, 60.0, -45.0, 40.0)


@query("f06_box_nodes", sql("nodes", "SELECT node FROM nodes WHERE lon BETWEEN -30 AND 60 AND lat BETWEEN -45 AND 40"))
def f06(spark, d):
    return X.nodes(spark, d).where(S.in_box(F.col("lon"), F.col("lat"), _BOX)).select("node")


@query("f07_box_elems", sql("elem_node", "SELECT elem, if(n = 3, 'hard', if(n = 2, 'mid', 'soft')) AS how FROM (SELECT elem, count(*) AS n FROM elem_node JOIN nodes USING (node) WHERE lon BETWEEN -30 AND 60 AND lat BETWEEN -45 AND 40 GROUP BY elem)"))
def f07(spark, d):
    n = F.col("n")
    return S.corners_in_box(X.mesh(spark, d), _BOX).select("elem", F.when(n == 3, "hard").when(n == 2, "mid").otherwise("soft").alias("how"))


#: Regions of the test queries: a rectangle, a concave polygon and one inside the other.
REGIONS = {"box": [-100.1, -20.1, -30.1, 50.3], "arrow": [[0.3, 120.3, 60.3, 120.3], [-60.2, 0.1, 5.1, 60.2]], "bay": [-60.2, -40.2, 0.1, 20.2]}


def _inside_sql(ring):
    terms = [f"if(({y0!r} > lat) <> ({y1!r} > lat) AND lon < {x0!r} + (lat - {y0!r}) * ({x1!r} - {x0!r}) / ({(y1 - y0) or 1.0!r}), 1, 0)" for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False)]
    return "(" + " + ".join(terms) + ") % 2 = 1"


def _ring(shape):
    pts = [(shape[0], shape[2]), (shape[1], shape[2]), (shape[1], shape[3]), (shape[0], shape[3])] if len(shape) == 4 else list(zip(*shape, strict=True))
    return [*pts, pts[0]]


_HITS = "hits AS (" + " UNION ALL ".join(f"SELECT node, '{name}' AS region FROM nodes WHERE {_inside_sql(_ring(shape))}" for name, shape in REGIONS.items()) + ")"


@query("f08_region_nodes", sql("nodes", "SELECT node, region FROM hits", _HITS))
def f08(spark, d):
    return S.in_regions(X.nodes(spark, d), S.boxes_to_regions(spark, REGIONS), "node", "lon", "lat")


@query("f10_basin_elems", sql("elem_node", "SELECT DISTINCT elem FROM elem_node WHERE node IN (SELECT node FROM hits WHERE region = 'box') AND node NOT IN (SELECT node FROM hits WHERE region = 'bay')", _HITS))
def f10(spark, d):
    return S.basin(X.mesh(spark, d), S.boxes_to_regions(spark, REGIONS), "box", "bay", on_elems=True)


@query("f12_region_edges", sql("edge_table elem_node", """SELECT n0, n1 FROM edge_table WHERE n0 IN (SELECT node FROM ring2) OR n1 IN (SELECT node FROM ring2)""",
  """seed AS (SELECT elem FROM elem_node WHERE node IN (SELECT node FROM nodes WHERE lon BETWEEN -30 AND 60 AND lat BETWEEN -45 AND 40) GROUP BY elem HAVING count(*) = 3),
  ring1 AS (SELECT DISTINCT node FROM elem_node WHERE elem IN (SELECT elem FROM seed)), ring2 AS (SELECT DISTINCT node FROM elem_node WHERE elem IN (SELECT elem FROM elem_node WHERE node IN (SELECT node FROM ring1)))"""))
def f12(spark, d):
    m = X.mesh(spark, d)
    return S.region_edges(G.edge_table(m.elems), m, S.elems_in_box(m, _BOX, "hard")).select("n0", "n1")


@query("f13_crossing_edges", sql("edges", "SELECT n0, n1, l.b + 0.0 AS bin FROM edges JOIN (SELECT unnest(range(0, 40)) * CAST(4 AS DOUBLE) - 78 AS b) l ON (y0 - l.b) * (y1 - l.b) <= 0"))
def f13(spark, d):
    return S.crossing_edges(X.edges(X.mesh(spark, d)), "y", -78.0, 4.0, 78.0).select("n0", "n1", "bin")


@query("f15_drop_null_triangles", sql("elems elem_node field_n", "SELECT elem FROM elems WHERE elem NOT IN (SELECT elem FROM elem_node WHERE node IN (SELECT node FROM field_n GROUP BY node HAVING sum(if(temp > 27, 1, 0)) > 1))"))
def f15(spark, d):
    warm = X.field_n(spark, d).groupBy("node").agg(F.sum((F.col("temp") > 27).cast("int")).alias("n"))
    values = warm.select("node", F.when(F.col("n") <= 1, 1.0).alias("v"))
    return S.drop_null_triangles(X.mesh(spark, d).elems, values, "v").select("elem")


@query("f20_regional_correction", sql("nodes", "SELECT node, round(if(node IN (SELECT node FROM hits WHERE region = 'arrow'), lat + lat * 10 / 100, lat) + 1e-9, 6) + 0.0 AS lat FROM nodes", _HITS))
def f20(spark, d):
    n = X.nodes(spark, d)
    hits = S.in_regions(n, S.boxes_to_regions(spark, {"arrow": REGIONS["arrow"]}), "node", "lon", "lat")
    return rounded(R.correct_in_regions(n, hits, "node", "lat", 10.0, relative=True).select("node", "lat"), "lat")


@query("s12_boxes_to_regions", "SELECT p_partkey AS region, seq, CAST(if(seq IN (1, 2), 10, 0) + p_partkey AS DOUBLE) AS x, CAST(if(seq IN (2, 3), 5, 0) AS DOUBLE) AS y FROM part, (SELECT unnest(range(0, 5)) AS seq)")
def s12(spark, d):
    x = F.col("p_partkey").cast("double")
    boxes = X.table(spark, d, "part").select(F.col("p_partkey").alias("region"), x.alias("x0"), (x + 10).alias("x1"), F.lit(0.0).alias("y0"), F.lit(5.0).alias("y1"))
    return S.rectangles(boxes).select("region", F.col("seq").cast("long").alias("seq"), "x", "y")


@query("w13_smooth_cells", sql("edge_table mean_n", """SELECT n.node, round((s + c * v) / (c + c) + 1e-9, 6) + 0.0 AS temp FROM sfc n JOIN (
  SELECT node, sum(v2) AS s, CAST(count(*) AS DOUBLE) AS c FROM (SELECT n.node, m.v AS v2 FROM nb n JOIN sfc m ON m.node = n.neighbour) GROUP BY node) USING (node)""",
  "sfc AS (SELECT node, avg(temp) AS v FROM mean_n GROUP BY node), nb AS (SELECT n0 AS node, n1 AS neighbour FROM edge_table UNION ALL SELECT n1, n0 FROM edge_table)"))
def w13(spark, d):
    sfc = X.mean_n(spark, d).groupBy("node").agg(F.avg("temp").alias("temp"))
    return rounded(W.smooth_cells(sfc, G.node_neighbours(X.mesh(spark, d).elems), "node", "temp"), "temp")
