"""Queries on named basins, cavities, kept domains and the whole overturning in density space."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlake.operators import mesh as G
from meshlake.operators import reduce as R
from meshlake.operators import regions as S
from meshlake.operators import transport as D
from meshlake.plans import fixtures as X
from meshlake.plans.fixtures import with_tables as sql
from meshlake.plans.mesh_queries import _HITS, REGIONS, _inside_sql, _ring
from meshlake.plans.registry import query, r6, rn, rounded
from meshlake.plans.transport_queries import _PLACE

#: Stand-ins for the outlines of basins; users bring their own.
BASINS = {"amoc": [-80.1, 20.3, -34.2, 64.7], "pmoc": [[120.3, 179.3, 179.3, 140.2], [-34.1, -34.1, 60.3, 60.3]], "ipmoc": [40.2, 179.3, -34.1, 60.3], "imoc": [40.2, 119.7, -34.1, 25.4], "inland": [-20.4, 30.1, 10.2, 46.3]}


def _basin_sql() -> str:
    inside = {name: _inside_sql(_ring(shape)) for name, shape in BASINS.items()}
    north = "lon BETWEEN -180 AND 180 AND lat BETWEEN 65 AND 90"
    chosen = {"gmoc": "true", "amoc": inside["amoc"], "aamoc": f"(({inside['amoc']}) OR ({north}))", "pmoc": inside["pmoc"], "ipmoc": inside["ipmoc"], "imoc": inside["imoc"]}
    parts = [f"SELECT DISTINCT '{name}' AS basin, elem FROM elem_node JOIN nodes USING (node) WHERE ({rule}) AND NOT ({inside['inland']})" for name, rule in chosen.items() if name != "gmoc"]
    whole = f"SELECT 'gmoc' AS basin, elem FROM elems WHERE elem NOT IN (SELECT elem FROM elem_node JOIN nodes USING (node) WHERE {inside['inland']})"
    return " UNION ALL ".join([whole, *parts])


@query("f10_named_basins", sql("elem_node", _basin_sql()))
def f10_named(spark, d):
    m, regions = X.mesh(spark, d), S.boxes_to_regions(spark, BASINS)
    out = None
    for name in S.MOC_BASINS:
        part = S.moc_basin(m, regions, name, "inland").select(F.lit(name).alias("basin"), "elem")
        out = part if out is None else out.unionByName(part)
    return out


@query("f08_large_regions", sql("nodes", "SELECT node, region FROM hits", _HITS))
def f08_large(spark, d):
    return S.in_large_regions(X.nodes(spark, d), S.boxes_to_regions(spark, REGIONS), "node", "lon", "lat")


#: Ice covers the south of the stand-in mesh, down to different levels.
_ICE = "CAST(if(lat < -50, node % 4, 0) AS INTEGER)"


def cavity_mesh(spark, d) -> G.Mesh:
    m = X.mesh(spark, d)
    n = m.nodes.withColumn("n_ic", F.expr("cast(if(lat < -50, node % 4, 0) as int)"))
    corner = lambda k: n.select(F.col("node").alias(f"n{k}"), F.col("n_ic").alias(f"c{k}"))
    e = m.elems.join(corner(0), "n0").join(corner(1), "n1").join(corner(2), "n2").withColumn("e_ic", F.greatest("c0", "c1", "c2"))
    return G.Mesh(n, e.select(*m.elems.columns, "e_ic"), m.levels)


@query("s04_cavity_area", sql("levels elem_node area", """SELECT n.node, l.k, round(coalesce(s.w, 0) * 1e-6 + 1e-6, 3) + 0.0 AS area_km2 FROM nodes n JOIN levels l ON true LEFT JOIN (
    SELECT node, k, sum(area) / 3 AS w FROM elem_node JOIN area USING (elem) JOIN capped USING (elem) JOIN levels ON k < e_iz AND k >= e_ic GROUP BY node, k) s ON s.node = n.node AND s.k = l.k""",
  f"capped AS (SELECT elem, any_value(e_iz) AS e_iz, max({_ICE}) AS e_ic FROM elem_node JOIN elems USING (elem) JOIN nodes USING (node) GROUP BY elem)"))
def s04_area(spark, d):
    return G.node_area(cavity_mesh(spark, d)).select("node", "k", (rn(F.col("w_A") * 1e-6, 3) + 0.0).alias("area_km2"))


@query("s04_cavity_mask", sql("nodes mean_n", f"SELECT node, k, round(if(k >= {_ICE} AND k < n_iz, temp, NULL) + 1e-9, 6) + 0.0 AS temp FROM mean_n JOIN nodes USING (node)"))
def s04_mask(spark, d):
    m = cavity_mesh(spark, d)
    f = R.mask_cavity(X.mean_n(spark, d).select("node", "k", "temp"), m.nodes, "node", "n_ic", ["temp"])
    return rounded(R.mask_bottom(f, m.nodes, "node", "n_iz", ["temp"], keep_interface=False).select("node", "k", "temp"), "temp")


@query("f16_keep_where", sql("nodes field_n", "SELECT k, round(sum(if(w > 0, w, NULL)) * 1e6 + 1e-9, 6) + 0.0 AS up, count(w) AS n FROM field_n JOIN nodes USING (node) WHERE lat BETWEEN -40 AND 40 GROUP BY k"))
def f16(spark, d):
    f = X.field_n(spark, d).join(X.nodes(spark, d).select("node", "lat"), "node")
    f = R.keep_where(f, F.col("lat").between(-40.0, 40.0)).withColumn("n", F.col("w"))
    out = R.keep_where(f, F.col("w") > 0, ["w"]).groupBy("k").agg(F.sum("w").alias("up"), F.count("n").alias("n"))
    return out.select("k", r6(F.col("up") * 1e6).alias("up"), "n")


#: Integer stand-ins for the terms of the density budget, by node and class: factors, modulus and offset.
TERMS = {"srf_fh": (13, 7, 101, -50), "srf_fw": (17, 3, 61, -30), "srf_fr": (5, 11, 31, -15), "div": (31, 17, 201, -100), "bolus": (19, 23, 91, -45), "h": (3, 5, 9, -2), "z": (7, 29, 400, -400)}


def _term_sql(a: int, b: int, mod: int, shift: int) -> str:
    return f"CAST((node * {a} + nd * {b}) % {mod} + {shift} AS DOUBLE)"


def _means_sql(columns: list[str], to: str) -> str:
    parts = {"srf_fh": "fh", "srf_fw": "fw", "srf_fr": "fr"}
    return ", ".join(f"{to.format(c)} AS {parts.get(c, c)}" for c in columns)


_FLUXES = ["srf_fh", "srf_fw", "srf_fr", "div", "bolus"]


@query("d04_density_overturning", sql("nodes dens elem_node area", """SELECT lat + 0.0 AS lat, nd, """ + ", ".join(f"round({e} + 1e-12, 9) + 0.0 AS {n}" for n, e in {"moc": "div + bolus", "fh": "fh", "fw": "fw", "fr": "fr", "srf": "-(fh + fw + fr)", "inner": "div + bolus + (fh + fw + fr)"}.items())
  + """, round(h + 1e-9, 6) + 0.0 AS h, round(z + 1e-9, 6) + 0.0 AS z, round(coalesce(sum(h) OVER (PARTITION BY lat ORDER BY nd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1e-9, 6) + 0.0 AS z_top FROM deep""", f"""
  terms AS (SELECT node, nd, {", ".join(f"{_term_sql(*v)} AS {k}" for k, v in TERMS.items())} FROM nodes, dens),
  flat AS (SELECT node, sum(area) / 3 AS w_A FROM elem_node JOIN area USING (elem) GROUP BY node),
  inp AS (SELECT elem, nd, any_value(area) AS w_A, {", ".join(f"avg({c} / w_A{' * 1024 / w_dens' if c.startswith('srf') else ''}) * any_value(area) AS {c.removeprefix('srf_')}" for c in _FLUXES)}, greatest(avg(h), 0) AS h, avg(z) AS z
    FROM terms JOIN dens USING (nd) JOIN flat USING (node) JOIN elem_node USING (node) JOIN area USING (elem) GROUP BY elem, nd),
  {_PLACE},
  binned AS (SELECT CAST(round_even(lat / 4, 0) AS INTEGER) AS i, nd, {", ".join(f"sum({c}) * 1e-6 AS {c}" for c in ("fh", "fw", "fr", "div", "bolus"))}, sum(if(h <> 0, h * w_A, NULL)) / sum(if(h <> 0, w_A, NULL)) AS h, sum(if(h <> 0, z * w_A, NULL)) / sum(if(h <> 0, w_A, NULL)) AS z FROM inp JOIN place USING (elem) GROUP BY 1, 2),
  grid AS (SELECT nd, unnest(range((SELECT min(i) FROM binned), (SELECT max(i) FROM binned) + 1)) AS i FROM (SELECT DISTINCT nd FROM binned)),
  north AS (SELECT g.i * 4.0::DOUBLE AS lat, g.nd, h, z, {", ".join(f"-sum(coalesce({c}, 0)) OVER w AS {c}" for c in ("fh", "fw", "fr", "div", "bolus"))} FROM grid g LEFT JOIN binned b ON b.i = g.i AND b.nd = g.nd WINDOW w AS (PARTITION BY g.nd ORDER BY g.i DESC)),
  deep AS (SELECT lat, nd, fh, fw, fr, h, z, sum(div) OVER v AS div, sum(bolus) OVER v AS bolus FROM north WINDOW v AS (PARTITION BY lat ORDER BY nd DESC))"""))
def d04_full(spark, d):
    m = X.mesh(spark, d)
    rows = m.nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("nd"))
    value = lambda a, b, mod, shift: (F.col("node") * a + F.col("nd") * b) % mod + float(shift)
    rows = rows.select("node", "nd", *(value(*v).alias(k) for k, v in TERMS.items()))
    inputs = D.dmoc_inputs(rows, X.dens_levels(spark), G.node_area(m, per_level=False), m, _FLUXES, ("h", "z"))
    inputs = inputs.withColumnsRenamed({c: c.removeprefix("srf_") for c in _FLUXES} | {"area": "w_A"}).withColumn("h", F.greatest("h", F.lit(0.0)))
    place = G.elem_node(m.elems).join(m.nodes.select("node", "lat"), "node").groupBy("elem").agg(F.avg("lat").alias("lat"))
    out = D.density_overturning(inputs, place, dlat=4.0)
    names = ["moc", "fh", "fw", "fr", "srf", "inner"]
    return out.select((F.col("lat") + 0.0).alias("lat"), "nd", *((rn(c, 9) + 0.0).alias(c) for c in names), *(r6(c).alias(c) for c in ("h", "z", "z_top")))
