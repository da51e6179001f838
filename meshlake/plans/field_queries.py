"""Queries on fields: filters, reductions, interpolation and ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlake.functions import expr
from meshlake.operators import interp as I
from meshlake.operators import mesh as G
from meshlake.operators import reduce as R
from meshlake.operators import regions as S
from meshlake.operators import windows as W
from meshlake.plans import fixtures as X
from meshlake.plans.fixtures import with_tables as sql
from meshlake.plans.mesh_queries import _HITS, REGIONS
from meshlake.plans.registry import query, r6, rn, rounded


def _mid(spark):
    return G.mid_levels(X.levels(spark)).select("k", F.col("zmid").alias("z"))


@query("f01_select_months", sql("field_n", "SELECT time, node, k, round(temp + 1e-9, 6) + 0.0 AS temp FROM field_n WHERE month(time) IN (1, 7)"))
def f01(spark, d):
    return R.select_time(X.field_n(spark, d), months=[1, 7]).select("time", "node", "k", r6("temp").alias("temp"))


@query("f01_select_record", sql("field_n", "SELECT time, node, k, round(temp + 1e-9, 6) + 0.0 AS temp FROM field_n WHERE time = (SELECT max(time) FROM (SELECT DISTINCT time FROM field_n ORDER BY time LIMIT 6))"))
def f01r(spark, d):
    return R.select_time(X.field_n(spark, d), record=5).select("time", "node", "k", r6("temp").alias("temp"))


@query("f02_select_levels", sql("field_n", "SELECT time, node, k, round(temp + 1e-9, 6) + 0.0 AS temp FROM field_n WHERE k IN (2, 3, 5)"))
def f02(spark, d):
    f = X.field_n(spark, d)
    near = R.level_bracket(_mid(spark), [-2100.0], nearest=True)
    keys = R.level_bracket(_mid(spark), [-100.0]).unionByName(near).distinct()
    return f.join(F.broadcast(keys), "k", "left_semi").select("time", "node", "k", r6("temp").alias("temp"))


@query("f03_mask_bottom", sql("nodes field_n", "SELECT time, node, k, round(if(k <= n_iz - 1, temp, NULL) + 1e-9, 6) + 0.0 AS temp FROM field_n JOIN nodes USING (node)"))
def f03(spark, d):
    f = R.mask_bottom(X.field_n(spark, d), X.nodes(spark, d), "node", "n_iz", ["temp"], keep_interface=False)
    return f.select("time", "node", "k", r6("temp").alias("temp"))


@query("f05_drop_below_bottom", sql("nodes field_n", "SELECT count(*) AS n, round(sum(temp) + 1e-6, 3) + 0.0 AS total FROM field_n JOIN nodes USING (node) WHERE k <= n_iz"))
def f05(spark, d):
    f = R.mask_bottom(X.field_n(spark, d), X.nodes(spark, d), "node", "n_iz", ["temp"], drop=True)
    return f.agg(F.count("*").alias("n"), (rn(F.sum("temp"), 3) + 0.0).alias("total"))


@query("f17_clamp_log", "SELECT l_orderkey, l_linenumber, round(greatest(-6.0::DOUBLE, least(6.0::DOUBLE, l_quantity::DOUBLE / 5 - 5)) + 1e-9, 6) + 0.0 AS clamped, round(log10(if(abs(l_discount::DOUBLE) > 1e-15, abs(l_discount::DOUBLE), NULL)) + 1e-9, 6) + 0.0 AS logged FROM lineitem")
def f17(spark, d):
    q, x = F.col("l_quantity").cast("double") / 5 - 5, F.col("l_discount").cast("double")
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(R.clamp(q, -6.0, 6.0)).alias("clamped"), r6(F.log10(F.abs(R.log_valid(x)))).alias("logged"))


def _time_stats(how, fn):
    text = sql("field_n", f"SELECT node, k, round({fn}(temp) + 1e-9, 6) + 0.0 AS temp FROM field_n GROUP BY node, k")

    @query(f"a01_time_{how}", text)
    def run(spark, d):
        return rounded(R.reduce_time(X.field_n(spark, d), how, "temp", ["node", "k"]), "temp")


for _how, _fn in (("mean", "avg"), ("median", "median"), ("std", "stddev_pop"), ("var", "var_pop"), ("max", "max"), ("min", "min"), ("sum", "sum")):
    _time_stats(_how, _fn)


@query("a02_annual_mean", sql("field_n", "SELECT node, k, CAST(date_trunc('year', time) AS TIMESTAMP) AS time, round(avg(temp) + 1e-9, 6) + 0.0 AS temp FROM field_n GROUP BY 1, 2, 3"))
def a02(spark, d):
    return rounded(R.reduce_time(X.field_n(spark, d), "mean", "temp", ["node", "k"], "annual"), "temp")


@query("a03_monthly_climatology", sql("field_n", "SELECT node, k, CAST(month(time) AS INTEGER) AS month, round(avg(temp) + 1e-9, 6) + 0.0 AS temp FROM field_n GROUP BY 1, 2, 3"))
def a03(spark, d):
    return rounded(R.reduce_time(X.field_n(spark, d), "mean", "temp", ["node", "k"], "monthly"), "temp")


_DAILY = "SELECT CAST({f}(l_shipdate) AS INTEGER) AS day, round(avg(l_quantity::DOUBLE) + 1e-9, 6) + 0.0 AS v FROM lineitem GROUP BY 1"


@query("a04_day_of_year", _DAILY.format(f="dayofyear"))
def a04(spark, d):
    f = X.table(spark, d, "lineitem").select(F.col("l_shipdate").alias("time"), F.col("l_quantity").cast("double").alias("v"))
    return rounded(R.reduce_time(f, "mean", "v", [], "day_of_year"), "v")


@query("a04_day_of_month", _DAILY.format(f="dayofmonth"))
def a04m(spark, d):
    f = X.table(spark, d, "lineitem").select(F.col("l_shipdate").alias("time"), F.col("l_quantity").cast("double").alias("v"))
    return rounded(R.reduce_time(f, "mean", "v", [], "day_of_month"), "v")


def _weighted(spark, d):
    m = X.mesh(spark, d)
    f = R.mask_bottom(X.field_n(spark, d), m.nodes, "node", "n_iz", ["temp"], keep_interface=False)
    return G.weights(f, m, vertical=True), m


_WEIGHTED = """wf AS (SELECT time, node, k, if(k < n_iz, temp, NULL) AS temp, w_A * 1e-10::DOUBLE AS w_A, w_z, lon, lat FROM field_n JOIN nodes USING (node) LEFT JOIN node_area USING (node, k) JOIN thick USING (k))"""


@query("a05_horizontal_stats", sql("field_n", "SELECT time, k, round(avg(temp) + 1e-9, 6) + 0.0 AS mean, round(stddev_pop(temp) + 1e-9, 6) + 0.0 AS std, round(max(temp) + 1e-9, 6) + 0.0 AS max, round(min(temp) + 1e-9, 6) + 0.0 AS min FROM field_n GROUP BY time, k"))
def a05(spark, d):
    return rounded(R.reduce_many(X.field_n(spark, d), ["mean", "std", "max", "min"], "temp", ["time", "k"]), "mean", "std", "max", "min")


@query("a05_horizontal_spread", sql("field_n", "SELECT time, k, round(median(temp) + 1e-9, 6) + 0.0 AS median, round(var_pop(temp) + 1e-9, 6) + 0.0 AS var, round(sum(temp) + 1e-7, 4) + 0.0 AS sum FROM field_n GROUP BY time, k"))
def a05_spread(spark, d):
    out = R.reduce_many(X.field_n(spark, d), ["median", "var", "sum"], "temp", ["time", "k"])
    return rounded(out, "median", "var").withColumn("sum", rn("sum", 4) + 0.0)


@query("a08_depth_spread", sql("field_n", "SELECT time, node, round(median(temp) + 1e-9, 6) + 0.0 AS median, round(var_pop(temp) + 1e-9, 6) + 0.0 AS var, round(sum(temp) + 1e-7, 4) + 0.0 AS sum FROM field_n GROUP BY time, node"))
def a08_spread(spark, d):
    out = R.reduce_many(X.field_n(spark, d), ["median", "var", "sum"], "temp", ["time", "node"])
    return rounded(out, "median", "var").withColumn("sum", rn("sum", 4) + 0.0)


@query("a06_horizontal_integral", sql("node_area thick field_n", "SELECT time, k, round(coalesce(sum(temp * w_A), 0) + 1e-6, 3) + 0.0 AS temp FROM wf GROUP BY time, k", _WEIGHTED))
def a06(spark, d):
    f, _ = _weighted(spark, d)
    out = R.reduce_cells(f, "wint", "temp", ["time", "k"], F.col("w_A") * 1e-10)
    return out.select("time", "k", (rn("temp", 3) + 0.0).alias("temp"))


_MEAN = "sum(temp * {w}) / nullif(sum(if(temp IS NOT NULL, {w}, NULL)), 0)"
_WMEAN = f"round({_MEAN} + 1e-9, 6) + 0.0 AS temp"


@query("a07_hmean_weighted", sql("node_area thick field_n", f"SELECT time, k, {_WMEAN.format(w='w_A')} FROM wf GROUP BY time, k", _WEIGHTED))
def a07(spark, d):
    f, _ = _weighted(spark, d)
    return rounded(R.reduce_cells(f, "wmean", "temp", ["time", "k"], F.col("w_A") * 1e-10), "temp")


@query("a09_depth_integral", sql("node_area thick field_n", "SELECT time, node, round(coalesce(sum(temp * w_z), 0) + 1e-7, 4) + 0.0 AS temp FROM wf GROUP BY time, node", _WEIGHTED))
def a09(spark, d):
    f, _ = _weighted(spark, d)
    return R.reduce_cells(f, "wint", "temp", ["time", "node"], F.col("w_z")).select("time", "node", (rn("temp", 4) + 0.0).alias("temp"))


@query("a10_depth_mean_unmasked", sql("node_area thick field_n", "SELECT time, node, round(sum(temp * w_A * w_z) / nullif(sum(w_A * w_z), 0) + 1e-9, 6) + 0.0 AS temp FROM wf GROUP BY time, node", _WEIGHTED))
def a10(spark, d):
    f, _ = _weighted(spark, d)
    return rounded(R.reduce_cells(f, "wmean", "temp", ["time", "node"], F.col("w_A") * 1e-10 * F.col("w_z"), masked=False), "temp")


def _regional(spark, d):
    f, m = _weighted(spark, d)
    return f, S.in_regions(m.nodes, S.boxes_to_regions(spark, REGIONS), "node", "lon", "lat")


@query("a11_region_series", sql("node_area thick field_n", f"SELECT region, time, {_WMEAN.format(w='w_A * w_z')} FROM wf JOIN hits USING (node) GROUP BY region, time", f"{_WEIGHTED}, {_HITS}"))
def a11(spark, d):
    f, hits = _regional(spark, d)
    return rounded(R.region_index(f, hits, "node", "temp", ["time"], F.col("w_A") * 1e-10 * F.col("w_z")), "temp")


@query("a12_volume_integral", sql("node_area thick field_n", "SELECT region, round(coalesce(sum(temp * w_A * w_z), 0) + 1e-4, 1) + 0.0 AS temp FROM wf JOIN hits USING (node) GROUP BY region", f"{_WEIGHTED}, {_HITS}"))
def a12(spark, d):
    f, hits = _regional(spark, d)
    out = R.region_index(f, hits, "node", "temp", [], F.col("w_A") * 1e-10 * F.col("w_z"), "wint")
    return out.select("region", (rn("temp", 1) + 0.0).alias("temp"))


@query("a13_profile", sql("node_area thick field_n", f"SELECT region, k, {_WMEAN.format(w='w_A')} FROM wf JOIN hits USING (node) GROUP BY region, k", f"{_WEIGHTED}, {_HITS}"))
def a13(spark, d):
    f, hits = _regional(spark, d)
    return rounded(R.region_index(f, hits, "node", "temp", ["k"], F.col("w_A") * 1e-10), "temp")


@query("a13_hovmoeller", sql("node_area thick field_n", f"SELECT region, time, k, {_WMEAN.format(w='w_A')} FROM wf JOIN hits USING (node) GROUP BY region, time, k", f"{_WEIGHTED}, {_HITS}"))
def a13h(spark, d):
    f, hits = _regional(spark, d)
    return rounded(R.region_index(f, hits, "node", "temp", ["time", "k"], F.col("w_A") * 1e-10), "temp")


@query("a14_zonal_mean", sql("node_area thick field_n", f"SELECT k, round_even(lat / 4, 0) * 4 + 0.0 AS lat, {_WMEAN.format(w='w_A')} FROM wf GROUP BY 1, 2", _WEIGHTED))
def a14(spark, d):
    f, m = _weighted(spark, d)
    out = R.zonal_mean(f.withColumn("w_A", F.col("w_A") * 1e-10).join(m.nodes.select("node", "lat"), "node"), "temp", 4.0, ["k"])
    return rounded(out.withColumn("lat", F.col("lat") + 0.0), "temp")


@query("a16_bottom_envelope", sql("nodes levels", """SELECT lat + 0.0 AS lat, botmax, round((coalesce(lag(q) OVER w, q) + 2 * q + coalesce(lead(q) OVER w, q)) / 4 + 1e-9, 6) + 0.0 AS botnice
  FROM (SELECT round_even(lat / 10, 0) * 10 AS lat, max(zlev) AS botmax, quantile_cont(zlev, 0.8) AS q FROM nodes JOIN levels ON k = n_iz GROUP BY 1) WINDOW w AS (ORDER BY lat)"""))
def a16(spark, d):
    out = R.bottom_envelope(X.nodes(spark, d), X.levels(spark), 10.0)
    return rounded(out.withColumn("lat", F.col("lat") + 0.0), "botnice")


@query("a20_coarse_grain", sql("nodes node_area mean_n", """SELECT (bx + 0.5) * 20 AS lon, (by_ + 0.5) * 20 AS lat, round(nullif(s / (cos(radians((by_ + 0.5) * 20)) * 400 * pow(6367500 * pi() / 180, 2)), 0) + 1e-9, 6) + 0.0 AS temp FROM (
  SELECT floor(lon / 20) AS bx, floor(lat / 20) AS by_, sum(temp * w_A) AS s FROM mean_n JOIN nodes USING (node) JOIN node_area USING (node, k) WHERE k = 0 GROUP BY 1, 2)"""))
def a20(spark, d):
    m = X.mesh(spark, d)
    f = X.mean_n(spark, d).where("k = 0").join(m.nodes.select("node", "lon", "lat"), "node").join(G.node_area(m), ["node", "k"])
    return rounded(R.coarse_grain(f, "temp", 20.0, 20.0, [], expr.DEGREE), "temp")


@query("a21_signed_totals", sql("field_n", """SELECT node, round(avg(net) + 1e-8, 5) + 0.0 AS net, round(avg(plus) + 1e-8, 5) + 0.0 AS plus, round(avg(minus) + 1e-8, 5) + 0.0 AS minus FROM (
  SELECT node, time, sum(w * 1e9) AS net, coalesce(sum(if(w > 0, w * 1e9, NULL)), 0) AS plus, coalesce(sum(if(w < 0, w * 1e9, NULL)), 0) AS minus FROM field_n GROUP BY node, time) GROUP BY node"""))
def a21(spark, d):
    f = X.field_n(spark, d).withColumn("w", F.col("w") * 1e9)
    return R.signed_totals(f, "w", ["node"]).select("node", *((rn(c, 5) + 0.0).alias(c) for c in ("net", "plus", "minus")))


@query("a22_value_range", """WITH e AS (SELECT min(l_extendedprice::DOUBLE) AS lo, max(l_extendedprice::DOUBLE) AS hi FROM lineitem),
 b AS (SELECT least(999, floor((l_extendedprice::DOUBLE - lo) / ((hi - lo) / 1000))) AS bin, count(*)::DOUBLE AS w, any_value(lo) AS lo, any_value((hi - lo) / 1000) AS step FROM lineitem, e GROUP BY 1),
 c AS (SELECT *, sum(w) OVER (ORDER BY bin) AS up, sum(w) OVER (ORDER BY bin DESC) AS down, sum(w) OVER () AS total FROM b)
 SELECT round(min(if(up / total >= 0.02, lo + (bin + 0.5) * step, NULL)) + 1e-9, 6) + 0.0 AS low, round(max(if(down / total >= 0.02, lo + (bin + 0.5) * step, NULL)) + 1e-9, 6) + 0.0 AS high FROM c""")
def a22(spark, d):
    f = X.table(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("v"))
    return rounded(R.value_range(f, "v", 0.02), "low", "high")


@query("a24_series_stats", sql("field_n", "SELECT k, round(avg(temp) + 1e-9, 6) + 0.0 AS mean, round(avg(temp) + stddev_pop(temp) + 1e-9, 6) + 0.0 AS upper, round(avg(temp) - stddev_pop(temp) + 1e-9, 6) + 0.0 AS lower FROM field_n GROUP BY k"))
def a24(spark, d):
    return rounded(W.series_stats(X.field_n(spark, d), "temp", ["k"]), "mean", "upper", "lower")


@query("j01_nodes_to_elems", sql("elem_node field_n", "SELECT elem, time, k, round(coalesce(sum(temp), 0) / 3 + 1e-9, 6) + 0.0 AS temp FROM elem_node JOIN field_n USING (node) GROUP BY elem, time, k"))
def j01(spark, d):
    return rounded(R.nodes_to_elems(X.field_n(spark, d).select("time", "node", "k", "temp"), X.mesh(spark, d).elems, ["temp"], ["time", "k"]), "temp")


@query("j02_elems_to_nodes", sql("elem_node area field_e", "SELECT node, k, round(sum(u * area) / sum(area) + 1e-9, 6) + 0.0 AS u, round(sum(v * area) / sum(area) + 1e-9, 6) + 0.0 AS v FROM field_e JOIN area USING (elem) JOIN elem_node USING (elem) GROUP BY node, k"))
def j02(spark, d):
    m = X.mesh(spark, d)
    return rounded(R.elems_to_nodes(X.field_e(m.elems), m, ["u", "v"], ["k"]), "u", "v")


@query("j05_anomaly", sql("field_n mean_n", "SELECT f.time, node, k, round(f.temp - m.temp + 1e-9, 6) + 0.0 AS temp FROM field_n f JOIN mean_n m USING (node, k)"))
def j05(spark, d):
    f = X.field_n(spark, d).select("time", "node", "k", "temp")
    both = f.select("time", "node", "k").join(X.mean_n(spark, d).select("node", "k", "temp"), ["node", "k"])
    return rounded(R.anomaly(f, both, ["time", "node", "k"], ["temp"]), "temp")


@query("s07_merge_variables", sql("field_n", "SELECT time, node, k, round(a.temp + 1e-9, 6) + 0.0 AS temp, round(b.salt + 1e-9, 6) + 0.0 AS salt FROM (SELECT * FROM field_n WHERE temp > 15) a FULL JOIN (SELECT * FROM field_n WHERE salt > 34) b USING (time, node, k)"))
def s07(spark, d):
    from meshlake.sources.tables import merge_variables

    f = X.field_n(spark, d)
    out = merge_variables(f.where("temp > 15").select("time", "node", "k", "temp"), f.where("salt > 34").select("time", "node", "k", "salt"), ["time", "node", "k"])
    return rounded(out, "temp", "salt")


_DEPTHS = (-65.0, -300.0, -2000.0)


@query("i01_interp_depth", sql("mean_n", """SELECT node, CAST(z AS DOUBLE) AS z, round(temp + 1e-9, 6) + 0.0 AS temp FROM (
  SELECT a.node, -65 AS z, a.temp AS temp FROM mean_n a WHERE a.k = 2
  UNION ALL SELECT a.node, -300, a.temp FROM mean_n a WHERE a.k = 3
  UNION ALL SELECT a.node, -2000, a.temp * (2250.0::DOUBLE - 2000) / 1250 + b.temp * (2000 - 1000.0::DOUBLE) / 1250 FROM mean_n a JOIN mean_n b ON a.node = b.node AND a.k = 4 AND b.k = 5)"""))
def i01(spark, d):
    return rounded(I.interp_depth(X.mean_n(spark, d), _mid(spark), "temp", list(_DEPTHS), ["node"]), "temp")


_GRID = {"x0": -180.0, "y0": -85.0, "dx": 10.0, "dy": 10.0, "nx": 36}


@query("i03_nearest_grid", sql("nodes clim", "SELECT node, round(temp + 1e-9, 6) + 0.0 AS temp FROM nodes JOIN clim ON ix = CAST(round_even((lon + 180) / 10, 0) AS INTEGER) % 36 AND iy = CAST(round_even((lat + 85) / 10, 0) AS INTEGER)"))
def i03(spark, d):
    return rounded(I.grid_to_cells(X.climatology(spark, d), X.nodes(spark, d).select("node", "lon", "lat"), "node", "temp", how="nearest", **_GRID), "temp")


@query("i02_linear_grid", sql("nodes clim", """SELECT n.node, round(coalesce(v, c.temp) + 1e-9, 6) + 0.0 AS temp FROM nodes n LEFT JOIN (
  SELECT node, if(sum(w) > 1 - 1e-9, sum(temp * w), NULL) AS v FROM (
    SELECT node, (floor(gx)::INTEGER + a) % 36 AS ix, floor(gy)::INTEGER + b AS iy, if(a = 1, gx - floor(gx), 1 - gx + floor(gx)) * if(b = 1, gy - floor(gy), 1 - gy + floor(gy)) AS w
    FROM (SELECT node, (lon + 180) / 10 AS gx, (lat + 85) / 10 AS gy FROM nodes), (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)) JOIN clim USING (ix, iy) WHERE w > 0 GROUP BY node) l ON l.node = n.node
  LEFT JOIN clim c ON c.ix = CAST(round_even((lon + 180) / 10, 0) AS INTEGER) % 36 AND c.iy = CAST(round_even((lat + 85) / 10, 0) AS INTEGER)"""))
def i02(spark, d):
    return rounded(I.grid_to_cells(X.climatology(spark, d), X.nodes(spark, d).select("node", "lon", "lat"), "node", "temp", **_GRID), "temp")


_POINTS = """pts AS (SELECT 'node' AS kind, node AS cell, lon, lat FROM nodes UNION ALL
  SELECT 'elem', elem, x - floor((x + 180) / 360) * 360, y FROM (
    SELECT elem, (if(lon0 - m >= 180, lon0 - 360, lon0) + if(lon1 - m >= 180, lon1 - 360, lon1) + if(lon2 - m >= 180, lon2 - 360, lon2)) / 3 AS x, (lat0 + lat1 + lat2) / 3 AS y
    FROM (SELECT *, least(lon0, lon1, lon2) AS m FROM corners)))"""


@query("i07_topography", sql("corners clim", """SELECT n.kind, n.cell, round(coalesce(v, c.temp) + 1e-9, 6) + 0.0 AS depth FROM pts n LEFT JOIN (
  SELECT kind, cell, if(sum(w) > 1 - 1e-9, sum(temp * w), NULL) AS v FROM (
    SELECT kind, cell, (floor(gx)::INTEGER + a) % 36 AS ix, floor(gy)::INTEGER + b AS iy, if(a = 1, gx - floor(gx), 1 - gx + floor(gx)) * if(b = 1, gy - floor(gy), 1 - gy + floor(gy)) AS w
    FROM (SELECT kind, cell, (lon + 180) / 10 AS gx, (lat + 85) / 10 AS gy FROM pts), (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)) JOIN clim USING (ix, iy) WHERE w > 0 GROUP BY kind, cell) l ON l.kind = n.kind AND l.cell = n.cell
  LEFT JOIN clim c ON c.ix = CAST(round_even((lon + 180) / 10, 0) AS INTEGER) % 36 AND c.iy = CAST(round_even((lat + 85) / 10, 0) AS INTEGER)""", _POINTS))
def i07(spark, d):
    return rounded(I.topography(X.climatology(spark, d), X.mesh(spark, d), "temp", **_GRID).withColumnRenamed("temp", "depth"), "depth")


@query("i04_extend_bottom", sql("mean_n", "SELECT node, CAST(k AS INTEGER) AS k, round(temp + 1e-9, 6) + 0.0 AS temp FROM (SELECT node, k, temp FROM mean_n UNION ALL SELECT node, m + i, t FROM (SELECT node, max(k) AS m, arg_max(temp, k) AS t FROM mean_n GROUP BY node), (SELECT unnest([1, 2, 3]) AS i))"))
def i04(spark, d):
    return rounded(I.extend_bottom(X.mean_n(spark, d).select("node", "k", "temp"), 3, ["node"], "temp"), "temp")


@query("i06_periodic_columns", sql("clim", "SELECT ix, iy, round(temp + 1e-9, 6) + 0.0 AS temp FROM (SELECT * FROM clim UNION ALL SELECT 36, iy, temp FROM clim WHERE ix = 0 UNION ALL SELECT -1, iy, temp FROM clim WHERE ix = 35)"))
def i06(spark, d):
    return rounded(I.periodic_columns(X.climatology(spark, d), "ix", 36), "temp")


@query("i08_isotherm_depth", sql("mean_n thick", """SELECT node, round(if(max(temp) < 15, 0, coalesce(max(hit), arg_min(zmid, (temp, zmid)))) + 1e-9, 6) + 0.0 AS depth FROM (
  SELECT node, temp, zmid, if(temp <= 15 AND t1 > 15, zmid + (z1 - zmid) * (15 - temp) / (t1 - temp), if(t1 IS NULL AND temp = 15, zmid, NULL)) AS hit FROM (
    SELECT node, temp, zmid, lead(temp) OVER w AS t1, lead(zmid) OVER w AS z1 FROM mean_n JOIN thick USING (k) WINDOW w AS (PARTITION BY node ORDER BY temp, zmid))) GROUP BY node"""))
def i08(spark, d):
    f = X.mean_n(spark, d).join(F.broadcast(_mid(spark)), "k")
    return rounded(I.isotherm_depth(f, 15.0, ["node"]), "depth")


@query("i09_triangles_to_grid", sql("corners mean_n", """SELECT CAST(-175 + ix * 13 AS DOUBLE) AS lon, CAST(-75 + iy * 11 AS DOUBLE) AS lat, round(arg_min(a * v0 + b * v1 + (1 - a - b) * v2, elem) + 1e-9, 6) + 0.0 AS v FROM (
  SELECT *, ((lat1 - lat2) * (px - lon2) + (lon2 - lon1) * (py - lat2)) / det AS a, ((lat2 - lat0) * (px - lon2) + (lon0 - lon2) * (py - lat2)) / det AS b FROM (
    SELECT c.*, x.v AS v0, y.v AS v1, z.v AS v2, ix, iy, -175 + ix * 13 AS px, -75 + iy * 11 AS py, (lat1 - lat2) * (lon0 - lon2) + (lon2 - lon1) * (lat0 - lat2) AS det
    FROM corners c JOIN top x ON x.node = n0 JOIN top y ON y.node = n1 JOIN top z ON z.node = n2
    JOIN (SELECT unnest(range(0, 28)) AS ix) i ON -175 + ix * 13 BETWEEN least(lon0, lon1, lon2) AND greatest(lon0, lon1, lon2)
    JOIN (SELECT unnest(range(0, 16)) AS iy) j ON -75 + iy * 11 BETWEEN least(lat0, lat1, lat2) AND greatest(lat0, lat1, lat2)
    WHERE greatest(lon0, lon1, lon2) - least(lon0, lon1, lon2) < 180)) WHERE a >= -1e-9 AND b >= -1e-9 AND 1 - a - b >= -1e-9 GROUP BY 1, 2""", "top AS (SELECT node, avg(temp) AS v FROM mean_n GROUP BY node)"))
def i09(spark, d):
    m = X.mesh(spark, d)
    top = X.mean_n(spark, d).groupBy("node").agg(F.avg("temp").alias("v"))
    return rounded(I.triangles_to_grid(G.corners(m), top, "v", x0=-175.0, y0=-75.0, dx=13.0, dy=11.0), "v")


@query("w08_smooth_2d", sql("clim", "SELECT c.ix, c.iy, round(avg(n.temp) + 1e-9, 6) + 0.0 AS temp FROM clim c JOIN clim n ON n.iy BETWEEN c.iy - 1 AND c.iy + 1 AND n.ix BETWEEN c.ix - 4 AND c.ix + 4 GROUP BY c.ix, c.iy"))
def w08(spark, d):
    return rounded(W.smooth_2d(X.climatology(spark, d), "iy", "ix", "temp", []), "temp")


@query("w12_concat_cycles", sql("field_n", "SELECT cycle, CAST(y + cycle * n AS INTEGER) AS year, round(t + 1e-9, 6) + 0.0 AS temp FROM (SELECT year(time) AS y, avg(temp) AS t FROM field_n GROUP BY 1), (SELECT max(year(time)) - min(year(time)) + 1 AS n FROM field_n), (SELECT unnest([0, 1, 2]) AS cycle)"))
def w12(spark, d):
    f = X.field_n(spark, d).groupBy(F.year("time").alias("year")).agg(F.avg("temp").alias("temp"))
    f = f.withColumn("run", F.lit("a")).withColumn("cycle", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return rounded(W.concat_cycles(f).select("cycle", F.col("year").cast("int").alias("year"), "temp"), "temp")


@query("w15_monthly_anomaly", sql("field_n", """SELECT y AS year, m AS month, round(t - avg(if(y BETWEEN 1995 AND 1998, t, NULL)) OVER (PARTITION BY m) + 1e-9, 6) + 0.0 AS temp
  FROM (SELECT CAST(year(time) AS INTEGER) AS y, CAST(month(time) AS INTEGER) AS m, avg(temp) AS t FROM field_n GROUP BY 1, 2)"""))
def w15(spark, d):
    f = X.field_n(spark, d).groupBy(F.year("time").alias("year"), F.month("time").alias("month")).agg(F.avg("temp").alias("temp"))
    return rounded(W.baseline_anomaly(f, "temp", 1995, 1998, ["month"]), "temp").select("year", "month", "temp")


@query("w11_non_increasing", sql("field_n", "SELECT node, k, round(min(t) OVER (PARTITION BY node ORDER BY k) + 1e-9, 6) + 0.0 AS temp FROM (SELECT node, k, avg(temp) AS t FROM field_n GROUP BY node, k)"))
def w11(spark, d):
    return rounded(W.non_increasing(X.mean_n(spark, d).select("node", "k", "temp"), "k", "temp", ["node"]), "temp")
