"""Queries on sources, set operations and the smaller reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlake.functions import expr
from meshlake.operators import interp as I
from meshlake.operators import mesh as G
from meshlake.operators import reduce as R
from meshlake.operators import regions as S
from meshlake.operators import transect as T
from meshlake.operators import windows as W
from meshlake.plans import fixtures as X
from meshlake.plans.field_queries import _MEAN, _WEIGHTED, _weighted
from meshlake.plans.fixtures import with_tables as sql
from meshlake.plans.mesh_queries import _HITS, REGIONS
from meshlake.plans.registry import query, r6, rn, rounded
from meshlake.plans.transport_queries import _CUTS, _cut
from meshlake.sources import tables


@query("s05_normalise_field", "SELECT CAST(l_partkey AS INTEGER) AS node, CAST(l_linenumber AS INTEGER) AS k, if(l_discount::DOUBLE = 0, NULL, l_discount::DOUBLE) + 0.0 AS value FROM lineitem")
def s05(spark, d):
    raw = X.table(spark, d, "lineitem").select(F.col("l_partkey").cast("int").alias("nod2"), F.col("l_linenumber").cast("int").alias("nz1"), F.col("l_discount").cast("double").alias("value"), F.lit(1).alias("lon_bnds"))
    return tables.normalise(raw.withColumn("value", F.when(F.col("value") == 0, float("nan")).otherwise(F.col("value"))))


@query("s05_unknown_cells", "SELECT DISTINCT CAST(l_suppkey + 150 AS INTEGER) AS node FROM lineitem WHERE l_suppkey + 150 NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def s05u(spark, d):
    f = X.table(spark, d, "lineitem").select((F.col("l_suppkey") + 150).cast("int").alias("node"))
    return tables.unknown_cells(f, X.table(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").cast("int").alias("node")), "node")


@query("s08_mesh_quantity", sql("nodes levels elem_node area", "SELECT node, abs(zlev) AS topography, round(a * 1e-6 + 1e-6, 3) + 0.0 AS narea FROM nodes JOIN levels ON k = n_iz JOIN (SELECT node, sum(area) / 3 AS a FROM elem_node JOIN area USING (elem) GROUP BY node) USING (node)"))
def s08(spark, d):
    m = X.mesh(spark, d)
    depth = m.nodes.join(F.broadcast(m.levels.withColumnRenamed("k", "n_iz")), "n_iz").select("node", F.abs("zlev").alias("topography"))
    return depth.join(G.node_area(m, per_level=False), "node").select("node", "topography", (rn(F.col("w_A") * 1e-6, 3) + 0.0).alias("narea"))


@query("s09_climatology", "SELECT CAST(c_custkey AS BIGINT) AS lon, CAST(c_nationkey AS BIGINT) AS lat, CAST(c_acctbal AS DOUBLE) AS temp FROM customer")
def s09(spark, d):
    out = tables.read_climatology(spark, f"{d}/customer.parquet", {"c_custkey": "lon", "c_nationkey": "lat", "c_acctbal": "temp"})
    return out.select(F.col("lon").cast("long").alias("lon"), F.col("lat").cast("long").alias("lat"), F.col("temp").cast("double").alias("temp"))


@query("f18_derive", sql("field_n field_e", "SELECT elem AS cell, k, round(sqrt(u * u + v * v) + 1e-9, 6) + 0.0 AS value, 'norm' AS kind FROM field_e UNION ALL SELECT node, k, round(avg(temp * salt) + 1e-9, 6) + 0.0, 'product' FROM field_n GROUP BY node, k"))
def f18(spark, d):
    length = R.derive(X.field_e(X.mesh(spark, d).elems), "norm", ["u", "v"]).select(F.col("elem").alias("cell"), "k", "value", F.lit("norm").alias("kind"))
    product = R.derive(X.field_n(spark, d), "product", ["temp", "salt"]).groupBy("node", "k").agg(F.avg("value").alias("value"))
    return rounded(length.unionByName(product.select(F.col("node").alias("cell"), "k", "value", F.lit("product").alias("kind"))), "value")


@query("a08_depth_stats", sql("field_n", "SELECT time, node, round(max(temp) + 1e-9, 6) + 0.0 AS max, round(min(temp) + 1e-9, 6) + 0.0 AS min, round(avg(temp) + 1e-9, 6) + 0.0 AS mean FROM field_n GROUP BY time, node"))
def a08(spark, d):
    stats = [R.statistic(how, "temp").alias(how) for how in ("max", "min", "mean")]
    return rounded(X.field_n(spark, d).groupBy("time", "node").agg(*stats), "max", "min", "mean")


@query("a23_extremes", sql("nodes field_n", "SELECT k, round(max(if(lat > 20, temp, NULL)) + 1e-9, 6) + 0.0 AS north, round(min(if(lat < -20, temp, NULL)) + 1e-9, 6) + 0.0 AS south FROM field_n JOIN nodes USING (node) GROUP BY k"))
def a23(spark, d):
    f = X.field_n(spark, d).join(X.nodes(spark, d).select("node", "lat"), "node")
    return rounded(R.extremes(f, ["k"], north=("max", "temp", F.col("lat") > 20), south=("min", "temp", F.col("lat") < -20)), "north", "south")


@query("a25_distinct", sql("field_n", "SELECT count(DISTINCT time) AS times, count(DISTINCT node) AS nodes, count(DISTINCT month(time)) AS months FROM field_n"))
def a25(spark, d):
    return R.distinct_counts(X.field_n(spark, d), times="time", nodes="node", months=F.month("time"))


@query("w01_cumulate_north_south", sql("nodes mean_n", "SELECT k, lat + 0.0 AS lat, round(-sum(s) OVER (PARTITION BY k ORDER BY lat DESC) + 1e-9, 6) + 0.0 AS temp FROM (SELECT k, round_even(lat / 4, 0) * 4 AS lat, sum(temp) AS s FROM mean_n JOIN nodes USING (node) GROUP BY 1, 2)"))
def w01(spark, d):
    bins = X.mean_n(spark, d).join(X.nodes(spark, d).select("node", "lat"), "node").withColumn("lat", R.lat_bin(F.col("lat"), 4.0)).groupBy("k", "lat").agg(F.sum("temp").alias("temp"))
    return rounded(W.cumulate(bins, "lat", "temp", ["k"], descending=True, negate=True).withColumn("lat", F.col("lat") + 0.0), "temp")


@query("w07_smooth_121", sql("nodes mean_n", "SELECT k, lat + 0.0 AS lat, round((coalesce(lag(t) OVER w, t) + 2 * t + coalesce(lead(t) OVER w, t)) / 4 + 1e-9, 6) + 0.0 AS temp FROM (SELECT k, round_even(lat / 4, 0) * 4 AS lat, avg(temp) AS t FROM mean_n JOIN nodes USING (node) GROUP BY 1, 2) WINDOW w AS (PARTITION BY k ORDER BY lat)"))
def w07(spark, d):
    bins = X.mean_n(spark, d).join(X.nodes(spark, d).select("node", "lat"), "node").withColumn("lat", R.lat_bin(F.col("lat"), 4.0)).groupBy("k", "lat").agg(F.avg("temp").alias("temp"))
    return rounded(W.smooth_121(bins, "lat", "temp", ["k"]).withColumn("lat", F.col("lat") + 0.0), "temp")


@query("i05_wrap_lon", sql("nodes", "SELECT node, round(if(lon + 180 > 180, lon - 180, lon + 180) + 1e-9, 6) + 0.0 AS lon FROM nodes"))
def i05(spark, d):
    return X.nodes(spark, d).select("node", r6(I.wrap_lon(F.col("lon") + 180)).alias("lon"))


@query("i11_elem_scalar_at_cuts", sql("edges field_e area elem_node", """SELECT name, CAST(seg AS INTEGER) AS seg, CAST(rank AS INTEGER) AS rank, a.k, round(a.u + (b.u - a.u) * lint + 1e-9, 6) + 0.0 AS u FROM cuts JOIN nu a ON a.node = n0 JOIN nu b ON b.node = n1 AND b.k = a.k""",
  _CUTS + ", nu AS (SELECT node, k, sum(u * area) / sum(area) AS u FROM field_e JOIN area USING (elem) JOIN elem_node USING (elem) GROUP BY node, k)"))
def i11(spark, d):
    m = X.mesh(spark, d)
    return rounded(T.transect_scalar(_cut(spark, d, m), R.elems_to_nodes(X.field_e(m.elems), m, ["u"], ["k"]), "u", ["k"]), "u")


@query("l01_nearest_level", sql("mean_n thick", "SELECT node, CAST(arg_min(k, (abs(zmid + 300), k)) AS INTEGER) AS k FROM mean_n JOIN thick USING (k) GROUP BY node"))
def l01(spark, d):
    f = R.volume_weights(X.mean_n(spark, d), X.levels(spark))
    return f.groupBy("node").agg(F.min_by("k", F.struct(F.abs(F.col("zmid") + 300), "k")).alias("k"))


_SETS = "SELECT 'union' AS op, count(DISTINCT node) AS n FROM hits UNION ALL SELECT 'both', count(*) FROM (SELECT node FROM hits WHERE region = 'box' INTERSECT SELECT node FROM hits WHERE region = 'bay') UNION ALL SELECT 'less', count(*) FROM (SELECT node FROM hits WHERE region = 'box' EXCEPT SELECT node FROM hits WHERE region = 'bay')"


@query("u01_region_sets", sql("nodes", _SETS, _HITS))
def u01(spark, d):
    hits = S.in_regions(X.nodes(spark, d), S.boxes_to_regions(spark, REGIONS), "node", "lon", "lat")
    box, bay = (hits.where(F.col("region") == r).select("node") for r in ("box", "bay"))
    out = [hits.select("node").distinct().agg(F.lit("union").alias("op"), F.count("*").alias("n")), box.intersect(bay).agg(F.lit("both").alias("op"), F.count("*").alias("n")), box.subtract(bay).agg(F.lit("less").alias("op"), F.count("*").alias("n"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("u03_union_runs", sql("field_n", "SELECT run, k, round(avg(temp) + 1e-9, 6) + 0.0 AS temp FROM (SELECT 'a' AS run, k, temp FROM field_n WHERE year(time) < 1998 UNION ALL SELECT 'b', k, temp FROM field_n WHERE year(time) >= 1998) GROUP BY run, k"))
def u03(spark, d):
    f = X.field_n(spark, d)
    return rounded(W.union_runs({"a": f.where("year(time) < 1998"), "b": f.where("year(time) >= 1998")}).groupBy("run", "k").agg(F.avg("temp").alias("temp")), "temp")


@query("d14_section_anomaly", sql("node_area thick field_n", f"""SELECT k, lat, round(a.temp - b.temp + 1e-9, 6) + 0.0 AS temp FROM
  (SELECT k, round_even(lat / 4, 0) * 4 + 0.0 AS lat, {_MEAN.format(w='w_A')} AS temp FROM wf WHERE year(time) >= 1998 GROUP BY 1, 2) a JOIN
  (SELECT k, round_even(lat / 4, 0) * 4 + 0.0 AS lat, {_MEAN.format(w='w_A')} AS temp FROM wf WHERE year(time) < 1998 GROUP BY 1, 2) b USING (k, lat)""", _WEIGHTED))
def d14(spark, d):
    f, m = _weighted(spark, d)
    f = f.withColumn("w_A", F.col("w_A") * 1e-10).join(m.nodes.select("node", "lat"), "node")
    late, early = (R.zonal_mean(f.where(c), "temp", 4.0, ["k"]) for c in ("year(time) >= 1998", "year(time) < 1998"))
    return rounded(R.anomaly(late, early, ["k", "lat"], ["temp"]).withColumn("lat", F.col("lat") + 0.0), "temp")


def _gradient(s: str, t: str, p: str) -> str:
    ds = f"({s} - 35.0)"
    return (
        f"(3.5803e-5::DOUBLE + {t} * (8.5258e-6::DOUBLE + {t} * (-6.8360e-8::DOUBLE + {t} * 6.6228e-10::DOUBLE)) + {ds} * (1.8932e-6::DOUBLE - 4.2393e-8::DOUBLE * {t})"
        f" + {p} * (1.8741e-8::DOUBLE + {t} * (-6.7795e-10::DOUBLE + {t} * (8.7330e-12::DOUBLE - 5.4481e-14::DOUBLE * {t})) + {ds} * (-1.1351e-10::DOUBLE + 2.7759e-12::DOUBLE * {t}))"
        f" + {p} * {p} * (-4.6206e-13::DOUBLE + {t} * (1.8676e-14::DOUBLE - 2.1687e-16::DOUBLE * {t})))"
    )


@query("v08_potential_temperature", sql("mean_n thick", "SELECT node, k, round(t3 + (d4 - 2 * q3) / 6 + 1e-9, 6) + 0.0 AS ptemp FROM (SELECT *, -p * " + _gradient("salt", "t3", "0.0::DOUBLE") + " AS d4 FROM s3)",
  f"""s0 AS (SELECT node, k, salt, temp, -zmid AS p FROM mean_n JOIN thick USING (k)),
  s1 AS (SELECT *, temp + d1 / 2 AS t1, d1 AS q1 FROM (SELECT *, -p * {_gradient('salt', 'temp', 'p')} AS d1 FROM s0)),
  s2 AS (SELECT *, t1 + 0.29289322::DOUBLE * (d2 - q1) AS t2, 0.58578644::DOUBLE * d2 + 0.121320344::DOUBLE * q1 AS q2 FROM (SELECT *, -p * {_gradient('salt', 't1', '(p / 2)')} AS d2 FROM s1)),
  s3 AS (SELECT *, t2 + 1.707106781::DOUBLE * (d3 - q2) AS t3, 3.414213562::DOUBLE * d3 - 4.121320344::DOUBLE * q2 AS q3 FROM (SELECT *, -p * {_gradient('salt', 't2', '(p / 2)')} AS d3 FROM s2))"""))
def v08(spark, d):
    f = R.volume_weights(X.mean_n(spark, d), X.levels(spark))
    return f.select("node", "k", r6(expr.ptemp(F.col("salt"), F.col("temp"), -F.col("zmid"))).alias("ptemp"))
