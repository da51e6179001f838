"""Hand-made meshes and invariants."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from meshlake.functions import expr
from meshlake.operators import interp, mesh, reduce, regions, topology, transect, transport, windows
from meshlake.operators.mesh import Mesh
from meshlake.sources import tables
from meshlake.streaming import incremental


def make(spark, nodes, elems, levels=(0.0, -10.0, -30.0)):
    return Mesh(
        spark.createDataFrame([(k, float(x), float(y), len(levels) - 1) for k, (x, y) in enumerate(nodes)], "node int, lon double, lat double, n_iz int"),
        spark.createDataFrame([(k, *e, len(levels) - 1) for k, e in enumerate(elems)], "elem int, n0 int, n1 int, n2 int, e_iz int"),
        spark.createDataFrame(list(enumerate(levels)), "k int, zlev double"),
    )


@pytest.fixture(scope="module")
def two(spark):
    return make(spark, [(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 1, 2), (0, 2, 3)])


def test_two_triangles(two):
    edges = mesh.edge_table(two.elems).collect()
    assert len(edges) == 5 and sum(e.tri_r is not None for e in edges) == 1
    assert mesh.boundary_edges(two.elems).count() == 4
    total = mesh.elem_area(two).agg(F.sum("area")).first()[0]
    assert mesh.node_area(two, per_level=False).agg(F.sum("w_A")).first()[0] == pytest.approx(total)
    surface = mesh.node_area(two).where("k = 0").agg(F.sum("w_A")).first()[0]
    assert surface == pytest.approx(total)
    assert {r.elem: r.neighbour for r in mesh.elem_neighbours(two.elems).collect()} == {0: 1, 1: 0}


def test_periodic_triangle(spark):
    m = make(spark, [(179, 0), (-179, 0), (-178, 1)], [(0, 1, 2)])
    assert [r.elem for r in mesh.periodic_elems(m).collect()] == [0]
    narrow = make(spark, [(0, 0), (2, 0), (3, 1)], [(0, 1, 2)])
    assert mesh.elem_area(m).first().area == pytest.approx(mesh.elem_area(narrow).first().area)
    nodes, elems = topology.periodic_augment(m)
    assert nodes.count() == 6 and elems.count() == 2


def test_hole_has_two_rings(spark):
    points = [(x, y) for y in range(4) for x in range(4)]
    squares = [(x, y) for y in range(3) for x in range(3) if (x, y) != (1, 1)]
    at = lambda x, y: 4 * y + x
    elems = [t for x, y in squares for t in ((at(x, y), at(x + 1, y), at(x + 1, y + 1)), (at(x, y), at(x + 1, y + 1), at(x, y + 1)))]
    m = make(spark, points, elems)
    rings = {}
    for r in topology.boundary_rings(m).orderBy("ring", "seq").collect():
        rings.setdefault(r.ring, []).append(r.node)
    assert sorted(len(v) - 1 for v in rings.values()) == [4, 12]
    known = {tuple(sorted(e)) for e in ((r.n0, r.n1) for r in mesh.boundary_edges(m.elems).collect())}
    for walk in rings.values():
        assert walk[0] == walk[-1] and all(tuple(sorted(p)) in known for p in zip(walk, walk[1:], strict=False))
    assert topology.elem_cluster(m.elems, 0).count() == len(elems)


def test_rotation_keeps_length_and_turns_back(spark):
    df = spark.createDataFrame([(10.0, 20.0, 1.0, 2.0), (-130.0, 65.0, -0.5, 0.25), (0.0, -40.0, 0.0, 1.0)], "lon double, lat double, u double, v double")
    abg = (50.0, 15.0, -90.0)
    u, v = expr.rotate_vector(abg, F.col("lon"), F.col("lat"), F.col("u"), F.col("v"))
    lon, lat = expr.rot_to_geo(abg, *expr.geo_to_rot(abg, F.col("lon"), F.col("lat")))
    for r in df.select("*", u.alias("ru"), v.alias("rv"), lon.alias("x"), lat.alias("y")).collect():
        assert math.hypot(r.ru, r.rv) == pytest.approx(math.hypot(r.u, r.v))
        assert (r.x, r.y) == (pytest.approx(r.lon), pytest.approx(r.lat))


@pytest.mark.parametrize(("s", "t", "p", "rho"), [(0.0, 5.0, 0.0, 999.96675), (35.0, 5.0, 0.0, 1027.67547), (35.0, 25.0, 10000.0, 1062.53817), (0.0, 25.0, 10000.0, 1037.90204)])
def test_published_densities(s, t, p, rho):
    assert expr.sea_density(s, t, p, sqrt=math.sqrt) == pytest.approx(rho, abs=1e-4)


def test_published_potential_temperature(spark):
    row = spark.range(1).select(expr.ptemp(F.lit(40.0), F.lit(40.0), F.lit(10000.0)).alias("t")).first()
    assert row.t == pytest.approx(36.89073, abs=1e-4)


def test_constant_field_has_constant_means(spark, two):
    field = two.nodes.select("node", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), F.lit(1.0).alias("v"))
    weighted = mesh.weights(field, two, vertical=True)
    assert reduce.reduce_cells(weighted, "wmean", "v", ["k"], F.col("w_A")).agg(F.min("v"), F.max("v")).first() == (1.0, 1.0)
    assert reduce.reduce_cells(weighted, "wmean", "v", ["node"], F.col("w_z")).agg(F.min("v"), F.max("v")).first() == (1.0, 1.0)
    with pytest.raises(ValueError):
        reduce.reduce_cells(weighted, "nonsense", "v", ["k"])


def test_missing_values(spark):
    f = spark.createDataFrame([(0, 1.0, 2.0), (0, None, 3.0), (1, None, 1.0)], "k int, v double, w double")
    means = {r.k: r.v for r in reduce.reduce_cells(f, "wmean", "v", ["k"], F.col("w")).collect()}
    assert means == {0: 1.0, 1: None}
    unmasked = {r.k: r.v for r in reduce.reduce_cells(f, "wmean", "v", ["k"], F.col("w"), masked=False).collect()}
    assert unmasked[0] == pytest.approx(2 / 5)
    assert {r.k: r.v for r in reduce.reduce_cells(f, "sum", "v", ["k"]).collect()} == {0: 1.0, 1: 0.0}


def test_points_in_polygons(spark):
    shapes = {"convex": [0, 4, 0, 4], "concave": [[10, 14, 12, 14, 10], [0, 0, 2, 4, 4]]}
    r = regions.boxes_to_regions(spark, shapes)
    pts = spark.createDataFrame([(0, 1.0, 1.0), (1, 5.0, 1.0), (2, 11.0, 2.0), (3, 13.9, 2.0), (4, 13.0, 0.5)], "id int, x double, y double")
    assert sorted((p.id, p.region) for p in regions.in_regions(pts, r, "id").collect()) == [(0, "convex"), (2, "concave"), (4, "concave")]


def test_interpolation_returns_levels(spark):
    levels = spark.createDataFrame([(0, -5.0), (1, -20.0), (2, -65.0)], "k int, z double")
    field = spark.createDataFrame([(0, k, v) for k, v in enumerate((10.0, 8.0, 2.0))] + [(1, 0, 10.0), (1, 1, None)], "node int, k int, t double")
    out = {(r.node, r.z): r.t for r in interp.interp_depth(field, levels, "t", [-20.0, -42.5, -65.0, -70.0, -12.5], ["node"]).collect()}
    assert out == {(0, -20.0): 8.0, (0, -42.5): 5.0, (0, -65.0): 2.0, (0, -12.5): 9.0}


def test_isotherm(spark):
    f = spark.createDataFrame([(0, 20.0, -5.0), (0, 10.0, -20.0), (1, 3.0, -5.0), (2, 30.0, -5.0), (2, 25.0, -50.0)], "node int, temp double, z double")
    assert {r.node: r.depth for r in interp.isotherm_depth(f, 15.0, ["node"]).collect()} == {0: -12.5, 1: 0.0, 2: -50.0}


def test_stream_line_crossing_sides(spark, two):
    edges = mesh.edge_geometry(two)
    hit = regions.crossing_edges(edges, "y", 0.5, 1.0)
    assert hit.count() == 3 and hit.select("bin").distinct().collect()[0].bin == 0.5
    assert regions.crossing_edges(edges, "y", 5.0, 1.0).count() == 0


def test_uniform_flow_through_a_section(spark):
    points = [(x, y) for y in range(5) for x in range(5)]
    at = lambda x, y: 5 * y + x
    elems = [t for y in range(4) for x in range(4) for t in ((at(x, y), at(x + 1, y), at(x + 1, y + 1)), (at(x, y), at(x + 1, y + 1), at(x, y + 1)))]
    m = make(spark, points, elems)
    line = transect.transects(spark, {"s": ([0.6, 3.4], [1.55, 1.55])})
    path = transect.transport_path(transect.cut_edges(line, mesh.edge_geometry(m)))
    flow = m.elems.select("elem", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), F.lit(0.0).alias("u"), F.lit(1.0).alias("v"))
    total = transect.transect_transport(path, flow, m).first().transport
    back = transect.transect_transport(path, flow, m, inverse=True).first().transport
    assert total > 0 and back == pytest.approx(-total)
    # from the first cut edge's middle to the last one's, 30 m deep
    assert total == pytest.approx(2.5 * expr.DEGREE * 30 * 1e-6, rel=0.35)


def test_overturning_northmost_bin(spark, two):
    field = two.nodes.select("node", F.lit(0).alias("k"), F.lit(1e-6).alias("w"))
    moc = {r.lat: r.moc for r in transport.zmoc(field, two, dlat=1.0).collect()}
    total = mesh.node_area(two).where("k = 0").agg(F.sum("w_A")).first()[0] * 1e-12
    assert moc[0.0] == pytest.approx(-total) and -total < moc[1.0] < 0


def test_smoothing_keeps_constants(spark, two):
    f = two.nodes.select("node", F.lit(3.0).alias("v"))
    out = windows.smooth_cells(f, mesh.node_neighbours(two.elems), "node", "v", rounds=3)
    assert out.agg(F.min("v"), F.max("v")).first() == (3.0, 3.0)


def test_mesh_text_files(spark, tmp_path):
    (tmp_path / "nod2d.out").write_text("3\n1 0.0 0.0 0\n 2 1.0 0.0 0\n3 0.0 1.0 1\n")
    (tmp_path / "elem2d.out").write_text("1\n1 2 3\n")
    (tmp_path / "aux3d.out").write_text("3\n0\n10\n-30\n")
    (tmp_path / "nlvls.out").write_text("3\n2\n3\n")
    (tmp_path / "elvls.out").write_text("2\n")
    m = tables.read_mesh_text(spark, str(tmp_path))
    assert [tuple(r) for r in m.nodes.select("node", "lon", "lat", "n_iz").orderBy("node").collect()] == [(0, 0.0, 0.0, 2), (1, 1.0, 0.0, 1), (2, 0.0, 1.0, 2)]
    assert tuple(m.elems.select("n0", "n1", "n2", "e_iz").first()) == (0, 1, 2, 1)
    assert [r.zlev for r in m.levels.orderBy("k").collect()] == [0.0, -10.0, -30.0]
    (tmp_path / "cavity_nlvls.out").write_text("1\n2\n1\n")
    (tmp_path / "cavity_elvls.out").write_text("2\n")
    m = tables.read_mesh_text(spark, str(tmp_path), cavity=True)
    assert [r.n_ic for r in m.nodes.orderBy("node").collect()] == [0, 1, 0] and m.elems.first().e_ic == 1


def test_fields_by_partition_and_geojson(spark, tmp_path):
    rows = [(k, float("nan") if k == 1 else float(k), "temp", 2000 + k) for k in range(4)]
    spark.createDataFrame(rows, "nod2 int, temp double, variable string, year int").write.partitionBy("variable", "year").parquet(str(tmp_path / "f"))
    df = tables.read_field(spark, str(tmp_path / "f"), "temp", (2000, 2002))
    assert sorted((r.node, r.temp) for r in df.collect() if r.temp is not None) == [(0, 0.0), (2, 2.0)] and df.count() == 3
    assert "PartitionFilters: [" in df._jdf.queryExecution().executedPlan().toString()
    shape = {"features": [{"properties": {"name": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
                          {"properties": {"name": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}]}
    (tmp_path / "r.json").write_text(json.dumps(shape))
    got = tables.read_geojson(spark, str(tmp_path / "r.json"))
    assert sorted({(r.region, r.part) for r in got.collect()}) == [("a", 0), ("b", 0), ("b", 1)] and got.count() == 12


def test_streams_equal_batch(spark, tmp_path):
    rows = [(f"2001-0{1 + k % 3}-1{k % 5} 00:00:00", k % 4, float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "time string, node int, temp double").withColumn("time", F.col("time").cast("timestamp"))
    source = str(tmp_path / "in")
    df.repartition(4).write.parquet(source)
    cells = spark.createDataFrame([(k, "r", 1.0 + k) for k in range(4)], "node int, region string, w_A double")
    stream = incremental.stream_fields(spark, source, df.schema, 1)
    q = incremental.stream_region_index(stream, cells, "idx", str(tmp_path / "c1"))
    q.processAllAvailable()
    q.stop()
    sums = incremental.region_sums(df, cells).first()
    assert spark.table("idx").first().temp == pytest.approx(sums.total / sums.weight)
    diagnose = lambda f: f.groupBy("year").agg(F.avg("temp").alias("temp"))
    incremental.stream_recompute(incremental.stream_fields(spark, source, df.schema, 1), source, str(tmp_path / "out"), str(tmp_path / "c2"), diagnose).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().temp == pytest.approx(df.agg(F.avg("temp")).first()[0])


def test_recompute_replaces_touched_years_only(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda years: spark.createDataFrame([(f"{y}-06-01 00:00:00", float(y), y) for y in years], "time string, temp double, year int").withColumn("time", F.col("time").cast("timestamp")).coalesce(1)
    rows([2000, 2001, 2002]).write.partitionBy("year").parquet(source)
    seen = []

    def diagnose(f):
        seen.append(f._jdf.queryExecution().optimizedPlan().toString())
        return f.groupBy("year").agg(F.sum("temp").alias("temp"))

    go = lambda: incremental.stream_recompute(incremental.stream_fields(spark, source, "time timestamp, temp double, year int"), source, target, str(tmp_path / "c"), diagnose).awaitTermination()
    go()
    rows([2001]).write.mode("append").partitionBy("year").parquet(source)
    go()
    assert {r.year: r.temp for r in spark.read.parquet(target).collect()} == {2000: 2000.0, 2001: 4002.0, 2002: 2002.0}
    assert "year" in seen[-1] and "2001" in seen[-1] and "2002" not in seen[-1]


def test_years_of_a_batch(spark):
    rows = [(f"{y}-01-01 00:00:00", float(y)) for y in (2000, 2000, 2001, 2002)]
    field = spark.createDataFrame([*rows, (None, 7.0)], "time string, temp double").withColumn("time", F.col("time").cast("timestamp"))
    count = lambda f: f.groupBy("year").agg(F.count("*").alias("n"))
    got = incremental.recompute_years(field.where("temp in (2000, 2002) or time is null"), field, count).collect()
    assert {r.year: r.n for r in got} == {2000: 2, 2002: 1}
    assert incremental.recompute_years(field.limit(0), field, count).count() == 0


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, station int, variable string, value double"
    source = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, "ts string, station int, variable string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    put([("2020-01-01 01:00:00", 1, "t", 1.0), ("2020-03-15 00:00:00", 1, "t", 5.0)])
    stream = incremental.daily_sums(incremental.stream_fields(spark, source, spark.createDataFrame([], schema).schema, 1))
    q = stream.writeStream.outputMode("append").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    put([("2020-01-01 05:00:00", 1, "t", 100.0)])
    q.processAllAvailable()
    put([("2020-06-01 00:00:00", 1, "t", 7.0)])
    q.processAllAvailable()
    q.stop()
    got = {str(r.day)[:10]: r.total for r in spark.table("daily").collect()}
    assert got.get("2020-01-01") == 1.0


def test_touching_contours_use_each_edge_once(spark):
    edges = [(1, 2), (2, 3), (1, 3), (1, 4), (4, 5), (1, 5), (5, 6), (6, 7), (5, 7)]
    pdf = topology.ring_order(spark.createDataFrame(edges, "n0 int, n1 int")).toPandas()
    used = []
    for _, g in pdf.groupby(["ring", "loop"]):
        walk = g.sort_values("seq").node.tolist()
        assert walk[0] == walk[-1]
        used += [tuple(sorted(e)) for e in zip(walk, walk[1:], strict=False)]
    assert sorted(used) == sorted(edges) and pdf.ring.nunique() >= 2


def test_split_rings_start_at_the_crossing(spark):
    # the western side holds the first and the last two points
    lon = [-179, -178, 179, 178, 177, 176, 179, -179, -178]
    nodes = spark.createDataFrame([(k, float(x), float(k)) for k, x in enumerate(lon)], "node int, lon double, lat double")
    rings = spark.createDataFrame([(0, k, k % 9) for k in range(10)], "ring int, seq int, node int")
    parts = {}
    for r in topology.split_rings(rings, nodes).orderBy("ring", "part", "seq").collect():
        parts.setdefault(r.part, []).append(int(r.y))
    assert parts == {0: [2, 3, 4, 5, 6], 1: [7, 8, 0, 1]}
    # a crossing between the last point and the first
    rings = spark.createDataFrame([(0, k, (k + 2) % 9) for k in range(10)], "ring int, seq int, node int")
    assert sorted(r.part for r in topology.split_rings(rings, nodes).collect()) == [0] * 4 + [1] * 5


@pytest.mark.parametrize("name", ["d04_density_overturning", "i12_density_to_depth", "j01_nodes_to_elems", "j02_elems_to_nodes", "g18_elem_cluster", "g19_basin_from_boxes"])
def test_no_mesh_table_is_broadcast(spark, sf, name):
    """Only levels, classes and single rows go through the driver; sizes of exploded and stored tables are estimated too low for that."""
    from meshlake.plans import catalog

    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan()
    joins = [line for line in plan.toString().splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in joins if any(f"[{key}#" in line for key in ("node", "elem", "n0", "n1", "n2", "e", "n", "ne"))]


def test_means_do_not_depend_on_the_order_of_summing(spark):
    from functools import reduce as fold
    from itertools import permutations
    from operator import add

    from meshlake.plans.fixtures import steady_avg

    sets = [(33.0, 34.2, 34.8), (33.2, 34.2, 34.6), (33.4, 33.8, 34.8), (33.6, 33.8, 34.6), (33.2, 33.4, 33.6, 35.8), (33.2, 33.8, 34.2, 34.8)]
    orders = [(k, n, order) for k, values in enumerate(sets) for n, order in enumerate(permutations(values))]
    rows = spark.createDataFrame([(k, n, v) for k, n, order in orders for v in order], "k int, n int, v double").coalesce(1)
    assert {r.m for r in rows.groupBy("k", "n").agg(steady_avg(F.col("v")).alias("m")).collect()} == {34.0}
    assert {fold(add, order) / len(order) for _, _, order in orders} != {34.0}
