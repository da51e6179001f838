"""Queries on iterative mesh operators and their batch counterparts of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlake.operators import mesh as G
from meshlake.operators import regions as S
from meshlake.operators import topology as Y
from meshlake.plans import fixtures as X
from meshlake.plans.contour_queries import contour_sql, recursive
from meshlake.plans.fixtures import with_tables as sql
from meshlake.plans.mesh_queries import REGIONS, _inside_sql, _ring
from meshlake.plans.registry import query, rounded
from meshlake.streaming import incremental as Q


@query("g14_ring_sizes", sql("edge_table", """SELECT min(n0) AS ring, count(*) AS n FROM edge_table WHERE tri_r IS NULL GROUP BY n0 // 50"""))
def g14(spark, d):
    return Y.boundary_rings(X.mesh(spark, d)).where("seq > 0").groupBy("ring").agg(F.count("*").alias("n"))


_SPLIT = contour_sql("elems") + """,
  points AS (SELECT c.ring, c.seq, c.n, lon AS x, lat AS y, coalesce(CAST(abs(lon - lag(lon) OVER (PARTITION BY ring ORDER BY seq)) > 180 AS INTEGER), 0) AS jump FROM contour c JOIN nodes USING (node)),
  jumps AS (SELECT *, min(if(jump = 1, seq, NULL)) OVER (PARTITION BY ring) AS first, max(if(seq = n, jump, 0)) OVER (PARTITION BY ring) AS back FROM points),
  turned AS (SELECT ring, first, if(first IS NULL, seq, (seq - first + n) % n) AS seq, if(seq = 0, back, jump) AS jump, x, y FROM jumps WHERE first IS NULL OR seq < n),
  pieces AS (SELECT ring, seq, x, y, sum(jump) OVER (PARTITION BY ring ORDER BY seq ROWS UNBOUNDED PRECEDING) - if(first IS NULL, 0, 1) AS part FROM turned),
  sized AS (SELECT *, count(*) OVER (PARTITION BY ring, part) AS size FROM pieces)"""


@query("g15_split_rings", recursive(sql("elems", "SELECT ring, CAST(part AS INTEGER) AS part, CAST(seq AS INTEGER) AS seq, round(x + 1e-9, 6) + 0.0 AS x, round(y + 1e-9, 6) + 0.0 AS y FROM sized WHERE size > 3", _SPLIT)))
def g15(spark, d):
    m = X.mesh(spark, d)
    return rounded(Y.split_rings(Y.boundary_rings(m), m.nodes), "x", "y")


@query("g16_periodic_nodes", sql("corners elem_node", """SELECT round(lon + 1e-9, 6) + 0.0 AS lon, round(lat + 1e-9, 6) + 0.0 AS lat FROM nodes UNION ALL
  SELECT round(if(lon > 0, lon - 360, lon + 360) + 1e-9, 6) + 0.0, round(lat + 1e-9, 6) + 0.0 FROM nodes WHERE node IN (SELECT node FROM elem_node WHERE elem IN (SELECT elem FROM corners WHERE greatest(lon0, lon1, lon2) - least(lon0, lon1, lon2) > 240))"""))
def g16(spark, d):
    return rounded(Y.periodic_augment(X.mesh(spark, d))[0].select("lon", "lat"), "lon", "lat")


_NBRS = """nbrs AS (SELECT tri_l AS a, tri_r AS b FROM edge_table WHERE tri_r IS NOT NULL UNION ALL SELECT tri_r, tri_l FROM edge_table WHERE tri_r IS NOT NULL)"""
_FILL = """inside AS (SELECT elem FROM (SELECT elem, count(*) AS n FROM elem_node JOIN nodes USING (node) WHERE lon BETWEEN -100 AND 90 AND lat BETWEEN -85 AND 85 GROUP BY elem) WHERE n = 3),
""" + _NBRS



@query("g18_elem_cluster", sql("elem_node edge_table", "SELECT elem FROM reach", _FILL + """, reach AS (
  SELECT min(elem) AS elem FROM inside UNION SELECT b FROM reach JOIN nbrs ON a = reach.elem WHERE b IN (SELECT elem FROM inside))""").replace("WITH ", "WITH RECURSIVE ", 1))
def g18(spark, d):
    m = X.mesh(spark, d)
    inside = Y.stored(S.elems_in_box(m, (-100.0, 90.0, -85.0, 85.0), "hard"))
    return Y.elem_cluster(m.elems, inside.agg(F.min("elem")).first()[0], inside)


@query("st01_region_sums", """SELECT event_type AS region, CAST(year(ts) AS INTEGER) AS year, round(sum(value * 2) / sum(2.0::DOUBLE) + 1e-9, 6) + 0.0 AS temp FROM events GROUP BY 1, 2""")
def st01(spark, d):
    events = X.table(spark, d, "events").select(F.col("ts").alias("time"), F.col("user_id").alias("node"), "event_type", F.col("value").cast("double").alias("temp"))
    cells = events.select("node").distinct().withColumn("w_A", F.lit(2.0))
    sums = Q.region_sums(events.withColumnRenamed("event_type", "region"), cells)
    return rounded(sums.select("region", "year", (F.col("total") / F.col("weight")).alias("temp")), "temp")


@query("st02_monthly_means", """SELECT user_id AS station, event_type AS variable, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, round(avg(value) + 1e-9, 6) + 0.0 AS mean FROM events GROUP BY 1, 2, 3""")
def st02(spark, d):
    events = X.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("station"), F.col("event_type").alias("variable"), F.col("value").cast("double").alias("value"))
    return rounded(Q.monthly_means(Q.daily_sums(events)).withColumn("month", F.col("month").cast("timestamp_ntz")), "mean")


_BASIN = f"""inside AS (SELECT elem FROM (
  SELECT elem, (if(lon0 - m >= 180, lon0 - 360, lon0) + if(lon1 - m >= 180, lon1 - 360, lon1) + if(lon2 - m >= 180, lon2 - 360, lon2)) / 3 AS lon, (lat0 + lat1 + lat2) / 3 AS lat
  FROM (SELECT *, least(lon0, lon1, lon2) AS m FROM corners)) WHERE {_inside_sql(_ring(REGIONS["box"]))}), """ + _NBRS + """, reach AS (
  SELECT arg_min(elem, (-lat, elem)) AS elem FROM elem_node JOIN nodes USING (node) WHERE elem IN (SELECT elem FROM inside) UNION SELECT b FROM reach JOIN nbrs ON a = reach.elem WHERE b IN (SELECT elem FROM inside))"""


@query("g19_basin_from_boxes", sql("corners elem_node edge_table", "SELECT DISTINCT node FROM elem_node WHERE elem IN (SELECT elem FROM reach)", _BASIN).replace("WITH ", "WITH RECURSIVE ", 1))
def g19(spark, d):
    m = X.mesh(spark, d)
    return Y.basin_from_boxes(m, S.elems_in_regions(m, S.boxes_to_regions(spark, {"box": REGIONS["box"]})).select("elem"))


@query("g12_neighbour_counts", sql("edge_table", "SELECT n, count(*) AS nodes FROM (SELECT node, count(*) AS n FROM (SELECT n0 AS node FROM edge_table UNION ALL SELECT n1 FROM edge_table) GROUP BY node) GROUP BY n"))
def g12n(spark, d):
    per = G.node_neighbours(X.mesh(spark, d).elems).groupBy("node").agg(F.count("*").alias("n"))
    return per.groupBy("n").agg(F.count("*").alias("nodes"))
