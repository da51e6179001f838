"""Queries on the contours of the part of the mesh that is deeper than a level: order, closed polygons, outer outline."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlake.operators import mesh as G
from meshlake.operators import regions as S
from meshlake.operators import topology as Y
from meshlake.plans import fixtures as X
from meshlake.plans.fixtures import with_tables as sql
from meshlake.plans.registry import query, rounded

#: Elements with this many layers or more make up the part; its contours have islands, lakes and places where they touch.
LAYERS = 3


def deep(mesh: G.Mesh) -> G.Mesh:
    return G.Mesh(mesh.nodes, mesh.elems.where(F.col("e_iz") >= LAYERS), mesh.levels)


def contour_sql(elems: str) -> str:
    """Tables ``contour(ring, loop, seq, node, n)`` of the elements in the named table: edges are walked one by one from every start."""
    return f"""sides AS MATERIALIZED (SELECT least(a, b) AS n0, greatest(a, b) AS n1 FROM (SELECT n0 AS a, n1 AS b FROM {elems} UNION ALL SELECT n1, n2 FROM {elems} UNION ALL SELECT n2, n0 FROM {elems}) GROUP BY 1, 2 HAVING count(*) = 1),
  ends AS MATERIALIZED (SELECT n0 AS corner, n1 AS nxt FROM sides UNION ALL SELECT n1, n0 FROM sides),
  rim AS MATERIALIZED (SELECT corner, unnest([a, b]) AS v, unnest([b, a]) AS w FROM (SELECT n0 AS corner, n1 AS a, n2 AS b FROM {elems} UNION ALL SELECT n1, n2, n0 FROM {elems} UNION ALL SELECT n2, n0, n1 FROM {elems})),
  fan AS (SELECT corner, nxt, nxt AS v FROM ends UNION SELECT f.corner, f.nxt, rim.w FROM fan f JOIN rim ON rim.corner = f.corner AND rim.v = f.v),
  fans AS MATERIALIZED (SELECT corner, nxt, min(v) AS fan FROM fan GROUP BY corner, nxt),
  paired AS MATERIALIZED (SELECT corner, nxt, row_number() OVER (PARTITION BY corner ORDER BY fan, nxt) - 1 AS i FROM fans),
  succ AS MATERIALIZED (SELECT p.corner, p.nxt AS came, q.nxt AS goes FROM paired p JOIN paired q ON p.corner = q.corner AND p.i // 2 = q.i // 2 AND p.nxt <> q.nxt),
  walk AS (SELECT corner AS s0, nxt AS s1, corner AS a, nxt AS b, 0 AS seq FROM ends UNION ALL
    SELECT s0, s1, w.b, s.goes, seq + 1 FROM walk w JOIN succ s ON s.corner = w.b AND s.came = w.a WHERE NOT (w.b = s0 AND s.goes = s1)),
  walks AS MATERIALIZED (SELECT * FROM walk),
  least_of AS MATERIALIZED (SELECT s0, s1, min((a, b)) AS least, count(*) AS n FROM walks GROUP BY s0, s1),
  heads AS MATERIALIZED (SELECT h.s0, h.s1, h.n, row_number() OVER (PARTITION BY h.s0 ORDER BY h.s1) - 1 AS loop FROM least_of h JOIN least_of t ON t.s0 = h.s1 AND t.s1 = h.s0 WHERE h.least = (h.s0, h.s1) AND h.least < t.least),
  contour AS MATERIALIZED (SELECT s0 AS ring, CAST(loop AS INTEGER) AS loop, CAST(seq AS INTEGER) AS seq, a AS node, CAST(n AS INTEGER) AS n FROM walks JOIN heads USING (s0, s1)
    UNION ALL SELECT s0, CAST(loop AS INTEGER), CAST(n AS INTEGER), s0, CAST(n AS INTEGER) FROM heads)"""


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


_DEEP = f"deep AS MATERIALIZED (SELECT * FROM elems WHERE e_iz >= {LAYERS}), " + contour_sql("deep")


@query("g14_contour_order", recursive(sql("elems", "SELECT ring, loop, seq, node, n FROM contour", _DEEP)))
def g14_order(spark, d):
    return Y.boundary_rings(deep(X.mesh(spark, d)))


_PARTS = _DEEP + """,
  frame AS (SELECT floor(min(lon)) AS west, ceil(max(lon)) AS east FROM nodes),
  pts AS (SELECT ring, loop, seq, n, lon AS x, lat AS y FROM contour JOIN nodes USING (node) WHERE seq < n),
  pairs AS (SELECT p.*, q.x AS x2, q.y AS y2, CASE WHEN p.x - q.x > 180 THEN 1 WHEN q.x - p.x > 180 THEN -1 END AS jump FROM pts p JOIN pts q ON q.ring = p.ring AND q.loop = p.loop AND q.seq = (p.seq + 1) % p.n),
  turns AS (SELECT *, coalesce(lag(jump) OVER (PARTITION BY ring, loop ORDER BY seq), last(jump) OVER (PARTITION BY ring, loop ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before FROM pairs WHERE jump IS NOT NULL),
  kinds AS (SELECT ring, loop, bool_and(jump <> before) AS cut, arg_max(if(jump = 1, (seq + 1) % n, seq), if(jump = 1, (y2, (seq + 1) % n), (y, seq))) AS start FROM turns GROUP BY ring, loop),
  marked AS (SELECT p.*, cut, start, (SELECT west FROM frame) AS west, (SELECT east FROM frame) AS east, c.jump AS came FROM pairs p JOIN kinds USING (ring, loop) LEFT JOIN pairs c ON c.ring = p.ring AND c.loop = p.loop AND (c.seq + 1) % c.n = p.seq),
  sided AS (SELECT *, CASE WHEN came = 1 OR jump = -1 THEN west WHEN came = -1 OR jump = 1 THEN east ELSE x END AS edge, coalesce(last_value(came IGNORE NULLS) OVER (PARTITION BY ring, loop ORDER BY seq ROWS UNBOUNDED PRECEDING),
    last_value(came IGNORE NULLS) OVER (PARTITION BY ring, loop ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS side FROM marked),
  pole AS (SELECT *, unnest(if(jump IS NULL, [0], [0, 1, 2])) AS i FROM sided WHERE NOT cut),
  parts AS (SELECT ring, loop, 0 AS part, seq, x, y FROM pairs WHERE (ring, loop) NOT IN (SELECT (ring, loop) FROM kinds)
    UNION ALL SELECT ring, loop, if(side = 1, 1, 2), 4 * ((seq - start + n) % n), edge, y FROM sided WHERE cut
    UNION ALL SELECT ring, loop, 0, 4 * seq + i, if(i = 2, if(jump = 1, west, east), edge), if(i = 0, y, if(y < 0 AND y2 < 0, -90, 90)) FROM pole),
  polys AS (SELECT ring, loop, part, max(seq) + 1 AS top, arg_min(x, seq) AS fx, arg_min(y, seq) AS fy FROM parts GROUP BY ring, loop, part HAVING count(*) > 2),
  closed AS (SELECT ring, loop, part, seq, x, y FROM parts SEMI JOIN polys USING (ring, loop, part) UNION ALL SELECT ring, loop, part, top, fx, fy FROM polys)"""


@query("g15_closed_parts", recursive(sql("elems", "SELECT ring, loop, CAST(part AS INTEGER) AS part, CAST(seq AS BIGINT) AS seq, round(x + 1e-9, 6) + 0.0 AS x, round(y + 1e-9, 6) + 0.0 AS y FROM closed", _PARTS)))
def g15_closed(spark, d):
    m = deep(X.mesh(spark, d))
    return rounded(Y.closed_parts(Y.boundary_rings(m), m.nodes), "x", "y")


#: The box within which the basin is sought.
BASIN = (-150.0, 130.0, -75.0, 72.0)


@query("g19_basin_in_outline", recursive(sql("corners", """SELECT elem FROM boxed JOIN outline ON (y0 > y) <> (y1 > y) AND x < x0 + (y - y0) * (x1 - x0) / (y1 - y0) GROUP BY elem HAVING count(*) % 2 = 1""", f"""
  boxed AS MATERIALIZED (SELECT elem, n0, n1, n2, (lon0 + lon1 + lon2) / 3 AS x, (lat0 + lat1 + lat2) / 3 AS y FROM corners WHERE e_iz >= {LAYERS} AND (lon0 + lon1 + lon2) / 3 BETWEEN {BASIN[0]} AND {BASIN[1]} AND (lat0 + lat1 + lat2) / 3 BETWEEN {BASIN[2]} AND {BASIN[3]}),
  {contour_sql("boxed")},
  lined AS (SELECT c.ring, c.loop, c.node AS n0, t.node AS n1, a.lon AS x0, a.lat AS y0, b.lon AS x1, b.lat AS y1 FROM contour c JOIN contour t ON t.ring = c.ring AND t.loop = c.loop AND t.seq = c.seq + 1 JOIN nodes a ON a.node = c.node JOIN nodes b ON b.node = t.node),
  outline AS MATERIALIZED (SELECT * FROM lined WHERE (ring, loop) = (SELECT arg_max((ring, loop), ((y0 + y1) / 2, -greatest(n0, n1), -least(n0, n1))) FROM lined))""")))
def g19_outline(spark, d):
    m = X.mesh(spark, d)
    inside = G.centroids(m).where(S.in_box(F.col("x"), F.col("y"), BASIN)).join(m.elems.where(F.col("e_iz") >= LAYERS), "elem", "left_semi").select("elem")
    return Y.basin_in_outline(m, inside)
