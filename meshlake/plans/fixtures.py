"""Mesh and field tables derived from the general-purpose test tables, in Spark and as SQL text.

A periodic lattice with 50 nodes around: node numbers are part keys, so the mesh grows with the tables. See FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.operators.mesh import Mesh, edge_geometry, large

#: Depths of the full levels in metres.
ZLEV = (0.0, -10.0, -30.0, -100.0, -500.0, -1500.0, -3000.0, -5500.0)
#: Density classes.
DENS = (30.0, 33.0, 35.0, 36.0, 36.5, 37.0, 37.5, 40.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, z) for k, z in enumerate(ZLEV)], "k int, zlev double")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    # the row count comes from the files' footers and sets the spacing of the rows
    n = part.count()
    return large(part).select(
        F.col("p_partkey").cast("int").alias("node"),
        (F.lit(-180.0 + 3.6) + F.lit(7.2) * (F.col("p_partkey") % 50)).alias("lon"),
        (F.lit(-80.0) + F.lit(160.0) * F.floor(F.col("p_partkey") / 50) / (n / 50.0)).alias("lat"),
        (F.lit(2) + F.col("p_size") % 6).cast("int").alias("n_iz"),
    )


def elems(node: DataFrame) -> DataFrame:
    east = F.expr("node div 50 * 50 + (node % 50 + 1) % 50")
    base = node.select("node", F.col("n_iz").alias("z00"), east.alias("e"), (F.col("node") + 50).alias("n"), (east + 50).alias("ne"))
    iz = lambda key, name: node.select(F.col("node").alias(key), F.col("n_iz").alias(name))
    square = base.join(iz("e", "ze"), "e").join(iz("n", "zn"), "n").join(iz("ne", "zne"), "ne")
    both = F.array(
        F.struct((F.col("node") * 2).alias("elem"), F.col("node").alias("n0"), F.col("e").alias("n1"), F.col("ne").alias("n2"), F.least("z00", "ze", "zne").alias("e_iz")),
        F.struct((F.col("node") * 2 + 1).alias("elem"), F.col("node").alias("n0"), F.col("ne").alias("n1"), F.col("n").alias("n2"), F.least("z00", "zne", "zn").alias("e_iz")),
    )
    return large(square).select(F.explode(both).alias("x")).select(*(F.col(f"x.{c}").cast("int").alias(c) for c in ("elem", "n0", "n1", "n2", "e_iz")))


def mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    node = nodes(spark, sf_dir)
    return Mesh(node, elems(node), levels(spark))


def steady_avg(c: Column) -> Column:
    """The mean of doubles by an exact sum of decimals: thresholds and orders do not depend on the order of summing."""
    return F.sum(c.cast("decimal(38, 18)")).cast("double") / F.count(c)


def field_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``time, node, k, temp, salt, w`` per month."""
    return (
        large(table(spark, sf_dir, "lineitem"))
        .groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("time"), F.col("l_partkey").cast("int").alias("node"), (F.col("l_linenumber") - 1).cast("int").alias("k"))
        .agg(
            F.avg(F.lit(2.0) + F.lit(0.5) * F.col("l_quantity").cast("double")).alias("temp"),
            steady_avg(F.lit(33.0) + F.lit(20.0) * F.col("l_discount").cast("double")).alias("salt"),
            F.avg((F.col("l_extendedprice").cast("double") - 50000.0) * 1e-9).alias("w"),
        )
    )


def mean_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, k, temp, salt, w`` over all times."""
    return field_n(spark, sf_dir).groupBy("node", "k").agg(steady_avg(F.col("temp")).alias("temp"), F.avg("salt").alias("salt"), F.avg("w").alias("w"))


def field_e(elem: DataFrame) -> DataFrame:
    """``elem, k, u, v`` above each element's bottom."""
    e = F.col("elem").cast("long")
    rows = elem.select("elem", "e_iz", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k")).where("k < e_iz")
    return rows.select("elem", "k", (((e * 7919 + F.col("k") * 104729) % 2001 - 1000) / 1000.0).alias("u"), (((e * 104729 + F.col("k") * 7919) % 2001 - 1000) / 1000.0).alias("v"))


def edges(m: Mesh) -> DataFrame:
    return edge_geometry(m)


def dens_levels(spark: SparkSession) -> DataFrame:
    n = len(DENS)
    width = [(DENS[min(k + 1, n - 1)] - DENS[max(k - 1, 0)]) / 2 for k in range(n)]
    return spark.createDataFrame([(k, d, w) for k, (d, w) in enumerate(zip(DENS, width, strict=True))], "nd int, dens double, w_dens double")


def dens_fluxes(node: DataFrame) -> DataFrame:
    """``node, nd, srf, div, h``."""
    x = node.select("node", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("nd"))
    return x.select(
        "node", "nd",
        ((F.col("node") * 13 + F.col("nd") * 7) % 101 - 50.0).alias("srf"),
        ((F.col("node") * 31 + F.col("nd") * 17) % 201 - 100.0).alias("div"),
        ((F.col("node") * 3 + F.col("nd") * 5) % 50 + 0.0).alias("h"),
    )


def climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ix, iy, temp`` on a 10 degree grid; gaps where no customer falls."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").groupBy((key % 36).cast("int").alias("ix"), (F.floor(key / 36) % 18).cast("int").alias("iy")).agg(F.avg(F.col("c_acctbal").cast("double")).alias("temp"))


#: The same tables in SQL; each query of this package picks the common table expressions that it names.
SQL = {
    "levels": "levels AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, CAST({z} AS DOUBLE))" for k, z in enumerate(ZLEV)) + ") AS t(k, zlev))",
    "nodes": """nodes AS (
  SELECT CAST(p_partkey AS INTEGER) AS node, CAST(-180 + 3.6 AS DOUBLE) + CAST(7.2 AS DOUBLE) * (p_partkey % 50) AS lon,
    CAST(-80 AS DOUBLE) + CAST(160 AS DOUBLE) * CAST(p_partkey // 50 AS DOUBLE) / ((SELECT count(*) FROM part) / CAST(50 AS DOUBLE)) AS lat,
    CAST(2 + p_size % 6 AS INTEGER) AS n_iz FROM part)""",
    "elems": """squares AS (
  SELECT a.node, e.node AS e, n.node AS n, ne.node AS ne, a.n_iz AS z00, e.n_iz AS ze, n.n_iz AS zn, ne.n_iz AS zne FROM nodes a
  JOIN nodes e ON e.node = a.node // 50 * 50 + (a.node % 50 + 1) % 50 JOIN nodes n ON n.node = a.node + 50 JOIN nodes ne ON ne.node = e.node + 50
), elems AS (
  SELECT CAST(node * 2 AS INTEGER) AS elem, node AS n0, e AS n1, ne AS n2, least(z00, ze, zne) AS e_iz FROM squares
  UNION ALL SELECT CAST(node * 2 + 1 AS INTEGER), node, ne, n, least(z00, zne, zn) FROM squares)""",
    "elem_node": "elem_node AS (SELECT elem, 0 AS pos, n0 AS node FROM elems UNION ALL SELECT elem, 1, n1 FROM elems UNION ALL SELECT elem, 2, n2 FROM elems)",
    "corners": """corners AS (
  SELECT e.*, a.lon AS lon0, a.lat AS lat0, b.lon AS lon1, b.lat AS lat1, c.lon AS lon2, c.lat AS lat2 FROM elems e
  JOIN nodes a ON a.node = n0 JOIN nodes b ON b.node = n1 JOIN nodes c ON c.node = n2)""",
    "area": """area AS (
  SELECT elem, abs(ax * by_ - bx * ay) * (0.5 * (6367500 * pi() / 180) * (6367500 * pi() / 180)) AS area FROM (
    SELECT elem, (lon1 - lon0 - floor((lon1 - lon0) / 360 + 0.5) * 360) * c AS ax, (lon2 - lon0 - floor((lon2 - lon0) / 360 + 0.5) * 360) * c AS bx, lat1 - lat0 AS ay, lat2 - lat0 AS by_
    FROM (SELECT *, cos(radians((lat0 + lat1 + lat2) / 3)) AS c FROM corners)))""",
    "node_area": """node_area AS (
  SELECT n.node, l.k, coalesce(s.w, 0) AS w_A FROM nodes n JOIN levels l ON true LEFT JOIN (
    SELECT node, k, sum(area) / 3 AS w FROM elem_node JOIN area USING (elem) JOIN elems USING (elem) JOIN levels ON k < e_iz GROUP BY node, k
  ) s ON s.node = n.node AND s.k = l.k)""",
    "thick": "thick AS (SELECT k, zlev - zn AS w_z, (zlev + zn) / 2 AS zmid FROM (SELECT k, zlev, lead(zlev) OVER (ORDER BY k) AS zn FROM levels) WHERE zn IS NOT NULL)",
    "field_n": """field_n AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS time, CAST(l_partkey AS INTEGER) AS node, CAST(l_linenumber - 1 AS INTEGER) AS k,
    avg(CAST(2 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(l_quantity AS DOUBLE)) AS temp, avg(CAST(33 AS DOUBLE) + CAST(20 AS DOUBLE) * CAST(l_discount AS DOUBLE)) AS salt,
    avg((CAST(l_extendedprice AS DOUBLE) - 50000) * CAST(1e-9 AS DOUBLE)) AS w FROM lineitem GROUP BY 1, 2, 3)""",
    "mean_n": "mean_n AS (SELECT node, k, avg(temp) AS temp, avg(salt) AS salt, avg(w) AS w FROM field_n GROUP BY node, k)",
    "field_e": """field_e AS (
  SELECT elem, k, CAST((CAST(elem AS BIGINT) * 7919 + k * 104729) % 2001 - 1000 AS DOUBLE) / 1000 AS u, CAST((CAST(elem AS BIGINT) * 104729 + k * 7919) % 2001 - 1000 AS DOUBLE) / 1000 AS v
  FROM elems JOIN levels ON k < e_iz WHERE k < 7)""",
    "edge_table": """pairs AS (
  SELECT elem, least(n0, n1) AS a, greatest(n0, n1) AS b FROM elems UNION ALL SELECT elem, least(n1, n2), greatest(n1, n2) FROM elems UNION ALL SELECT elem, least(n2, n0), greatest(n2, n0) FROM elems
), edge_table AS (SELECT a AS n0, b AS n1, min(elem) AS tri_l, if(count(*) > 1, max(elem), NULL) AS tri_r FROM pairs GROUP BY a, b)""",
    "edges": """cent AS (
  SELECT elem, lon0 + ((lon1 - lon0 - floor((lon1 - lon0) / 360 + 0.5) * 360) + (lon2 - lon0 - floor((lon2 - lon0) / 360 + 0.5) * 360)) / 3 AS cx, (lat0 + lat1 + lat2) / 3 AS cy FROM corners
), mids AS (
  SELECT t.*, a.lon AS x0, a.lat AS y0, b.lon AS x1, b.lat AS y1, a.lon + (b.lon - a.lon - floor((b.lon - a.lon) / 360 + 0.5) * 360) / 2 AS mx, (a.lat + b.lat) / 2 AS my
  FROM edge_table t JOIN nodes a ON a.node = n0 JOIN nodes b ON b.node = n1
), edges AS (
  SELECT m.n0, m.n1, tri_l, tri_r, x0, y0, x1, y1, (l.cx - mx - floor((l.cx - mx) / 360 + 0.5) * 360) * cos(radians(my)) * f AS dx_l, (l.cy - my) * f AS dy_l,
    coalesce((r.cx - mx - floor((r.cx - mx) / 360 + 0.5) * 360) * cos(radians(my)) * f, 0) AS dx_r, coalesce((r.cy - my) * f, 0) AS dy_r
  FROM (SELECT *, 6367500 * pi() / 180 AS f FROM mids) m JOIN cent l ON l.elem = tri_l LEFT JOIN cent r ON r.elem = tri_r)""",
    "dens": "dens AS (SELECT nd, dens, (coalesce(lead(dens) OVER (ORDER BY nd), dens) - coalesce(lag(dens) OVER (ORDER BY nd), dens)) / 2 AS w_dens FROM (VALUES "
    + ", ".join(f"({k}, CAST({d} AS DOUBLE))" for k, d in enumerate(DENS)) + ") AS t(nd, dens))",
    "fluxes": """fluxes AS (
  SELECT node, nd, CAST((node * 13 + nd * 7) % 101 - 50 AS DOUBLE) AS srf, CAST((node * 31 + nd * 17) % 201 - 100 AS DOUBLE) AS div, CAST((node * 3 + nd * 5) % 50 AS DOUBLE) AS h FROM nodes, dens)""",
    "clim": "clim AS (SELECT CAST(c_custkey % 36 AS INTEGER) AS ix, CAST(c_custkey // 36 % 18 AS INTEGER) AS iy, avg(CAST(c_acctbal AS DOUBLE)) AS temp FROM customer GROUP BY 1, 2)",
}
#: What each expression is built on.
NEEDS = {
    "elems": ["nodes"], "elem_node": ["elems"], "corners": ["elems"], "area": ["corners"], "node_area": ["levels", "elem_node", "area"], "thick": ["levels"],
    "mean_n": ["field_n"], "field_e": ["elems", "levels"], "edge_table": ["elems"], "edges": ["corners", "edge_table"], "fluxes": ["nodes", "dens"],
}


def with_tables(names: str, query: str, more: str = "") -> str:
    """``WITH`` the named tables (and all that they need) the query."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join([SQL[n] for n in order] + ([more] if more else [])) + "\n" + query
