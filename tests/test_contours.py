"""Contours by list ranking, closed parts, outlines, sections by cells, fluxes, repaired depths, text meshes, rings with holes, updates."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from meshlake.operators import mesh, reduce, topology, transect, windows
from meshlake.operators.mesh import Mesh
from meshlake.sources import tables
from meshlake.streaming import incremental


def rings_of(frame):
    out = {}
    for r in frame.orderBy("ring", "loop", "seq").collect():
        out.setdefault((r.ring, r.loop), []).append(r.node)
    return out


def test_long_ring_is_ranked_without_a_group(spark):
    n = 100_000
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(order[k], order[(k + 1) % n]) for k in range(n)], "n0 int, n1 int").repartition(8)
    got = topology.ring_order(edges)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "FlatMapGroups" not in plan
    walk = [r.node for r in got.orderBy("seq").collect()]
    place = {x: k for k, x in enumerate(order)}
    start = place[0]
    step = 1 if order[(start + 1) % n] < order[start - 1] else -1
    assert walk == [order[(start + step * k) % n] for k in range(n)] + [0]
    parts = got.select(F.spark_partition_id().alias("p")).groupBy("p").count()
    assert parts.count() > 1 and parts.agg(F.max("count")).first()[0] < n


def test_contours_that_touch_keep_to_their_own_side(spark):
    # two squares of two triangles meet in node 3; each has its own contour
    elems = spark.createDataFrame([(0, 0, 1, 3), (1, 0, 3, 2), (2, 3, 4, 6), (3, 3, 6, 5)], "elem int, n0 int, n1 int, n2 int")
    rings = rings_of(topology.ring_order(mesh.boundary_edges(elems), elems))
    assert rings == {(0, 0): [0, 1, 3, 2, 0], (3, 0): [3, 4, 6, 5, 3]}
    # a fan around node 0 with two gaps: the contours share their smallest node
    elems = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 3, 4)], "elem int, n0 int, n1 int, n2 int")
    assert rings_of(topology.ring_order(mesh.boundary_edges(elems), elems)) == {(0, 0): [0, 1, 2, 0], (0, 1): [0, 3, 4, 0]}


def test_no_edges_no_contours(spark):
    assert topology.ring_order(spark.createDataFrame([], "n0 int, n1 int")).count() == 0


def closed(spark, lon_lat):
    n = len(lon_lat)
    nodes = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(lon_lat)] + [(900, -179.5, 0.0), (901, 179.5, 0.0)], "node int, lon double, lat double")
    rings = spark.createDataFrame([(0, 0, k, k % n, n) for k in range(n + 1)], "ring int, loop int, seq int, node int, n int")
    out = {}
    for r in topology.closed_parts(rings, nodes).orderBy("part", "seq").collect():
        out.setdefault(r.part, []).append((r.x, r.y))
    return out


def test_closed_parts(spark, monkeypatch):
    monkeypatch.setattr(topology, "SLICE", 3)  # sides are carried over slices
    # an island over the date line: three points on either side
    island = [(178, 0), (179, 5), (-179, 6), (-177, 0), (-179, -6), (179, -5)]
    assert closed(spark, island) == {
        1: [(-180.0, 6.0), (-177.0, 0.0), (-180.0, -6.0), (-180.0, 6.0)],
        2: [(180.0, -5.0), (178.0, 0.0), (180.0, 5.0), (180.0, -5.0)],
    }
    assert closed(spark, island[3:] + island[:3]) == closed(spark, island)
    # a contour round the south pole, eastward
    polar = [(-170, -70), (-60, -72), (60, -71), (170, -69)]
    assert closed(spark, polar) == {0: [(-180.0, -70.0), (-60.0, -72.0), (60.0, -71.0), (180.0, -69.0), (180.0, -90.0), (-180.0, -90.0), (-180.0, -70.0)]}
    # no jump: as it is; two points: nothing
    assert closed(spark, [(0, 0), (1, 0), (1, 1)]) == {0: [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]}
    assert closed(spark, [(0, 0), (1, 0)]) == {}


def test_basin_holds_the_waters_within_its_outline(spark):
    # a ring of squares around a gap with one square of its own, and a separate square to the south
    side, node = 7, lambda i, j: j * 8 + i
    nodes = [(k, (k % 8) * 1.0, (k // 8) * 1.0, 1) for k in range(64)] + [(64 + k, 20.0 + k % 2, -9.0 + k // 2, 1) for k in range(4)]
    cells = [(i, j) for i in range(side) for j in range(side) if not (1 <= i <= 5 and 1 <= j <= 5) or (i, j) == (3, 3)]
    squares = [(node(i, j), node(i + 1, j), node(i + 1, j + 1), node(i, j + 1)) for i, j in cells] + [(64, 65, 67, 66)]
    elems = [t for a, b, c, e in squares for t in ((a, b, c), (a, c, e))]
    m = Mesh(
        spark.createDataFrame(nodes, "node int, lon double, lat double, n_iz int"),
        spark.createDataFrame([(k, *t, 1) for k, t in enumerate(elems)], "elem int, n0 int, n1 int, n2 int, e_iz int"),
        spark.createDataFrame([(0, 0.0), (1, -10.0)], "k int, zlev double"),
    )
    got = {r.elem for r in topology.basin_in_outline(m, m.elems.select("elem")).collect()}
    assert got == set(range(2 * len(cells)))
    assert {r.elem for r in topology.basin_in_outline(m, m.elems.where("elem < 0").select("elem")).collect()} == set()


@pytest.fixture(scope="module")
def strip(spark):
    """Two squares side by side, cut by a line from south to north."""
    return Mesh(
        spark.createDataFrame([(k, float(k % 3), float(k // 3), 2 if k != 5 else 1) for k in range(6)], "node int, lon double, lat double, n_iz int"),
        spark.createDataFrame([(0, 0, 1, 4, 2), (1, 0, 4, 3, 2), (2, 1, 2, 5, 1), (3, 1, 5, 4, 1)], "elem int, n0 int, n1 int, n2 int, e_iz int"),
        spark.createDataFrame([(0, 0.0), (1, -10.0), (2, -30.0)], "k int, zlev double"),
    )


def test_section_flux(spark, strip):
    edges = mesh.edge_geometry(strip)
    path = transect.transport_path(transect.cut_edges(transect.transects(spark, {"a": ([-0.5, 2.5], [0.4, 0.7])}), edges))
    u = spark.createDataFrame([(e, k, 1.0, 0.5) for e in range(4) for k in range(3)], "elem int, k int, u double, v double")
    volume = transect.section_flux(path, u, strip)
    # below the bottom of the two eastern elements nothing flows
    dry = {2, 3}
    elem = {(r["rank"], r["sub"]): r.elem for r in path.collect()}
    assert {(r["rank"], r["sub"], r.k) for r in volume.collect()} == {(*p, k) for p, e in elem.items() if e is not None for k in ([0] if e in dry else [0, 1])}
    warm = spark.createDataFrame([(n, k, 10.0 + n) for n in range(6) for k in range(2)], "node int, k int, temp double")
    heat = {(r["rank"], r["sub"], r.k): r.flux for r in transect.section_flux(path, u, strip, quantity="heat", tracer=warm, reference=2.0).collect()}
    ends = {(r["rank"], r["sub"]): (r.n0, r.n1) for r in path.collect()}
    for r in volume.collect():
        a, b = ends[r["rank"], r["sub"]]
        key = (r["rank"], r["sub"], r.k)
        if 5 in (a, b) and r.k > 0:
            assert key not in heat  # node 5 is dry there
        else:
            assert heat[key] == pytest.approx(r.flux / 1e-6 * (10 + (a + b) / 2 - 2.0) * 1030 * 3850 * 1e-15)
    nodes = spark.createDataFrame([(n, k, 1.0, 0.5) for n in range(6) for k in range(2)], "node int, k int, u double, v double")
    at_nodes = transect.signed_flux(transect.section_flux(path, nodes, strip).where("k = 0"), ["name"]).first()
    assert at_nodes.net == pytest.approx(volume_at_surface(path, strip))
    assert at_nodes.net == pytest.approx(at_nodes.positive + at_nodes.negative)
    with pytest.raises(ValueError):
        transect.section_flux(path, u, strip, quantity="heat")


def volume_at_surface(path, m):
    """A uniform flow needs no elements: also pieces beside land count at nodes."""
    return sum((-1.0 * r.dy + 0.5 * r.dx) * 10.0 * 1e-6 for r in path.collect())


def test_sections_by_cells_equal_the_plain_ones(spark):
    rng = random.Random(7)
    edges = spark.createDataFrame(
        [(2 * k, 2 * k + 1, k, None, x, y, x + rng.uniform(-3, 3), y + rng.uniform(-3, 3)) for k in range(600) for x, y in [(rng.uniform(-170, 170), rng.uniform(-80, 80))]],
        "n0 int, n1 int, tri_l int, tri_r int, x0 double, y0 double, x1 double, y1 double",
    )
    lines = transect.transects(spark, {"a": ([-160.0, -20.0, 150.0], [-70.0, 60.0, -50.0]), "flat": ([-100.0, 90.0], [10.0, 10.0]), "steep": ([30.0, 30.0], [-80.0, 80.0])})
    rows = lambda df: sorted((r.name, r.seg, r["rank"], r.n0, round(r.px, 9), round(r.py, 9), round(r.lint, 9)) for r in df.select("name", "seg", "rank", "n0", "px", "py", "lint").collect())
    want = rows(transect.cut_edges(lines, edges))
    for size in (10.0, 2.0, 45.0):
        assert rows(transect.cut_edges_by_cells(lines, edges, size)) == want


def test_date_line_edges_are_cut(spark):
    edges = spark.createDataFrame([(0, 1, 0, None, 179.0, 0.0, -179.0, 2.0)], "n0 int, n1 int, tri_l int, tri_r int, x0 double, y0 double, x1 double, y1 double")
    for x in ([170.0, 190.0], [-190.0, -170.0]):
        hit = transect.cut_edges_by_cells(transect.transects(spark, {"a": (x, [1.0, 1.0])}), edges).collect()
        assert len(hit) == 1 and abs(abs(hit[0].px) - 180) < 1e-9 and hit[0].py == pytest.approx(1.0)


def brute_depths(grid, xs, axes):
    g = {(x, a): v if v is not None and v < -1 else None for (x, a), v in grid.items()}
    for x in xs:
        col = [(a, g[x, a]) for a in axes if g[x, a] is not None]
        if col:
            low, high = min(v for _, v in col), max(v for _, v in col)
            last, first = max(a for a, v in col if v == low), min(a for a, v in col if v == high)
            for a in axes:
                g[x, a] = low if a > last else high if a < first else g[x, a]
    sites = [(x, a, v) for (x, a), v in g.items() if v is not None]
    full = {(x, a): v if v is not None else min(((x - p) ** 2 + (a - q) ** 2, p, q, w) for p, q, w in sites)[3] for (x, a), v in g.items()}
    out = {}
    for x in xs:
        best = math.inf
        for a in axes:
            best = out[x, a] = min(best, full[x, a])
    return out


def test_repaired_depths(spark):
    rng = random.Random(2)
    for _ in range(4):
        xs, axes = [float(3 * k) for k in range(6)], sorted({30 + 0.5 * k * (1 + k % 3) for k in range(9)})
        grid = {(x, a): rng.choice([None, None, -0.5, -float(rng.randint(2, 3000))]) for x in xs for a in axes}
        for a in axes:
            grid[xs[2], a] = None  # a place without any depth
        df = spark.createDataFrame([(x, a, v) for (x, a), v in grid.items()], "lat double, dens double, z double")
        assert {(r.lat, r.dens): r.z for r in windows.repair_depths(df, "lat", "dens", "z").collect()} == brute_depths(grid, xs, axes)
    empty = spark.createDataFrame([(0.0, 1.0, None)], "lat double, dens double, z double")
    assert [r.z for r in windows.repair_depths(empty, "lat", "dens", "z").collect()] == [None]


def test_weighted_smoothing(spark):
    around = {0: [1, 2, 3], 1: [0, 2], 2: [0, 1], 3: [0], 4: []}
    value = {0: 4.0, 1: 8.0, 2: 1.0, 3: 5.0, 4: 9.0}
    field = spark.createDataFrame([(k, float(k), 0.0, v) for k, v in value.items()], "node int, x double, y double, t double")
    nb = spark.createDataFrame([(a, b) for a, bs in around.items() for b in bs], "node int, neighbour int")
    got = {r.node: r.t for r in windows.smooth_weighted(field, nb, "node", "t", 3.0, 2, [(0.0, 0.5, -1.0, 1.0, 2.0)], topology.stored).collect()}
    for _ in range(2):
        new = {}
        for k, bs in around.items():
            more = (2.0 if k == 0 else 1.0) * 3.0 * (len(bs) - 1) - 1
            new[k] = (sum(value[b] for b in bs) + more * value[k]) / (len(bs) + more) if bs and len(bs) + more else value[k]
        value = new
    assert got == pytest.approx(value)


def test_points_on_edges_of_boxes_count_on_both_sides(spark):
    df = spark.createDataFrame([(0.0, 5.0, 1.0, 2.0), (5.0, 5.0, 10.0, 2.0), (10.0, 10.0, 100.0, 2.0)], "lon double, lat double, v double, w_A double")
    got = {(r.lon, r.lat): r.v for r in reduce.coarse_grain_closed(df, "v", 10.0, 10.0, [], 1.0).collect()}
    area = {lat: math.cos(math.radians(lat)) * 100 for lat in (5.0, 15.0)}
    want = {(-5.0, 5.0): 2.0, (5.0, 5.0): 2.0 + 20.0 + 200.0, (15.0, 5.0): 200.0, (5.0, 15.0): 200.0, (15.0, 15.0): 200.0}
    assert got == pytest.approx({k: v / area[k[1]] for k, v in want.items()})


def test_views_in_one_pass(spark):
    field = spark.createDataFrame([(t, n, k, None if (t + n + k) % 5 == 0 else float(t * 7 + n * 3 + k), 1.0 + n) for t in range(3) for n in range(4) for k in range(2)], "time int, node int, k int, v double, w double")
    hits = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "b")], "node int, region string")
    views = reduce.region_views(field, hits, "node", "v", F.col("w"))
    plan = views._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2  # the field and the hits, once each
    for view, by in (("profile", ["k"]), ("series", ["time"]), ("hovmoeller", ["time", "k"])):
        alone = {(r.region, *(r[c] for c in by)): r.v for r in reduce.region_index(field, hits, "node", "v", by, F.col("w")).collect()}
        assert {(r.region, *(r[c] for c in by)): r.v for r in views.where(F.col("view") == view).collect()} == pytest.approx(alone)


def test_text_meshes_are_read_in_splits(spark, tmp_path):
    n = 3000
    (tmp_path / "elem2d.out").write_text(f"{n}\n" + "".join(f" {k + 1} {k + 2}  {k + 3}\r\n" for k in range(n)))
    (tmp_path / "level_nodes.out").write_text("".join(f"{3 * k + 1} {3 * k + 2} {0 if k % 2 else 3 * k + 3}\n" for k in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = tables.numbered_lines(spark, str(tmp_path / "elem2d.out"))
        assert lines.select(F.spark_partition_id().alias("p")).distinct().count() > 5
        assert [(r.line, r.text.split()[0]) for r in lines.orderBy("line").collect()] == [(0, str(n))] + [(k + 1, str(k + 1)) for k in range(n)]
        assert [tuple(r) for r in tables.read_elems(spark, str(tmp_path / "elem2d.out")).orderBy("elem").collect()] == [(k, k, k + 1, k + 2) for k in range(n)]
        cells = tables.read_level_nodes(spark, str(tmp_path / "level_nodes.out"))
        assert cells.count() == 3 * n - n // 2 and {r.n_iz for r in tables.level_counts(cells).collect()} == {2, 3}
        field = spark.createDataFrame([(4, 7.0)], "cell long, v double")
        assert [tuple(r) for r in tables.cells_to_nodes(field, cells).select("node", "k", "v").collect()] == [(1, 1, 7.0)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_raw_levels_and_bottom_depth(spark, tmp_path):
    for name, text in {
        "nod2d.out": "3\n1 0 0 0\n2 1 0 0\n3 0 1 0\n", "elem2d.out": "1\n1 2 3\n", "aux3d.out": "3\n0\n10\n30\n", "nlvls.out": "3\n2\n3\n", "elvls.out": "3\n", "nlvls_raw.out": "2\n2\n3\n", "elvls_raw.out": "2\n"
    }.items():
        (tmp_path / name).write_text(text)
    m = tables.read_mesh_text(spark, str(tmp_path), raw=True)
    assert [(r.node, r.n_iz, r.n_iz_raw) for r in m.nodes.orderBy("node").collect()] == [(0, 2, 1), (1, 1, 1), (2, 2, 2)]
    assert (m.elems.first().e_iz, m.elems.first().e_iz_raw) == (2, 1)
    assert {r.node: r.depth for r in tables.bottom_depth(m.nodes, m.levels, "n_iz").collect()} == {0: -30.0, 1: -10.0, 2: -30.0}


def square(name, x, y, size, clockwise=False):
    ring = [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]
    return [(name, k, float(a), float(b)) for k, (a, b) in enumerate(ring[::-1] if clockwise else ring)]


def test_rings_with_holes_come_back(spark, tmp_path):
    rows = square("land", 0, 0, 10, True) + square("lake", 1, 1, 4) + square("isle", 2, 2, 1) + square("pond", 6, 6, 2, True) + square("far", 20, 0, 3)
    rings = spark.createDataFrame(rows, "ring string, seq int, x double, y double")
    assert {r.ring: (r.depth, r.parent, r.area) for r in tables.nest_rings(rings).collect()} == {
        "land": (0, None, -100.0), "lake": (1, "land", 16.0), "isle": (2, "lake", 1.0), "pond": (1, "land", -4.0), "far": (0, None, 9.0)
    }
    polygons = tables.rings_to_polygons(rings)
    tables.write_polygons(polygons, str(tmp_path / "out"))
    back = tables.read_geojson(spark, str(tmp_path / "out"), holes=True, lines=True)
    got = {}
    for r in back.orderBy("region", "ring", "seq").collect():
        got.setdefault((r.region, r.ring), []).append((r.x, r.y))
    assert set(got) == {("land", 0), ("land", 1), ("land", 2), ("isle", 0), ("far", 0)}
    area = lambda p: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:], strict=False)) / 2
    assert {k: area(p) for k, p in got.items()} == {("land", 0): 100.0, ("land", 1): -16.0, ("land", 2): -4.0, ("isle", 0): 1.0, ("far", 0): 9.0}
    assert json.loads(next((tmp_path / "out").glob("part-*.json")).read_text().splitlines()[0])["geometry"]["type"] == "Polygon"


def test_updates_survive_restart_and_replay(spark, tmp_path):
    source, target, schema = str(tmp_path / "in"), str(tmp_path / "out"), "region string, year int, total double, weight double"
    cells = spark.createDataFrame([(k, "ab"[k % 2], 1.0 + k) for k in range(4)], "node int, region string, w_A double")
    fields = "time timestamp, node int, temp double"

    def put(rows):
        spark.createDataFrame(rows, "time string, node int, temp double").withColumn("time", F.col("time").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = incremental.stream_fields(spark, source, spark.createDataFrame([], fields).schema, 1)
        incremental.stream_region_updates(stream, cells, target, str(tmp_path / "c")).awaitTermination()
        return state()

    def state():
        return {(r.region, r.year): (r.total, r.weight) for r in incremental.latest(spark, target, ["region", "year"], schema).collect()}

    def batch():
        sums = incremental.region_sums(spark.read.schema(fields).parquet(source), cells)
        return {(r.region, r.year): (r.total, r.weight) for r in sums.collect()}

    put([("2001-01-01", 0, 1.0), ("2001-01-01", 1, 2.0)])
    put([("2002-01-01", 0, 3.0)])
    assert run() == batch()
    put([("2001-05-01", 2, 5.0), ("2002-05-01", 3, None)])
    assert run() == batch()  # started anew from the checkpoint
    written = sorted(p.name for p in (tmp_path / "out").glob("batch=*"))
    assert len(written) >= 3
    # the last batch once more, as after a failure between writing and committing
    last = max(int(n.split("=")[1]) for n in written)
    again = spark.createDataFrame(spark.read.schema(schema).parquet(f"{target}/batch={last}").collect(), schema)
    incremental.write_updates(again, last, target)
    assert state() == batch()
    incremental.compact(spark, target, ["region", "year"], schema, last)
    assert len(list((tmp_path / "out").glob("batch=*"))) == 2 and state() == batch()
    put([("2003-01-01", 1, 4.0)])
    assert run() == batch()


def test_results_and_year_tables(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 2001, 1.234), ("r1", 2002, 2.0), ("r2", 2001, 3.5)], "run string, year int, v double")
    tables.write_result(rows, str(tmp_path / "res"), ("run", "year"))
    tables.write_result(spark.createDataFrame([("r1", 2001, 9.0)], rows.schema), str(tmp_path / "res"), ("run", "year"))
    assert sorted((r.run, r.year, r.v) for r in spark.read.parquet(str(tmp_path / "res")).collect()) == [("r1", 2001, 9.0), ("r1", 2002, 2.0), ("r2", 2001, 3.5)]
    tables.write_csv(rows.where("run = 'r1'"), str(tmp_path / "csv"), "v", 1)
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "csv")).collect()) == [("r1", "2001", "1.2"), ("r1", "2002", "2.0")]
    (tmp_path / "y.txt").write_text("# a comment\n2001 " + " ".join(str(float(k)) for k in range(1, 13)) + " 6.5\n2002 " + " ".join("1" for _ in range(12)) + "\n")
    got = {(r.year, r.month): (r.value, r.annual) for r in tables.read_year_table(spark, str(tmp_path / "y.txt")).collect()}
    assert len(got) == 24 and got[2001, 12] == (12.0, 6.5) and got[2002, 1] == (1.0, None)


def test_prepared_meshes_are_read_not_joined(spark, strip, tmp_path):
    from meshlake.operators import transport

    ready = mesh.prepare(strip, str(tmp_path / "mesh"))
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)
    for make in (mesh.corners, mesh.elem_area, mesh.node_area, lambda m: mesh.node_area(m, per_level=False), mesh.edge_geometry, mesh.node_resolution, mesh.centroids):
        assert rows(make(ready)) == rows(make(strip))
    field = spark.createDataFrame([(n, k, 0.1 * n - 0.2 * k) for n in range(6) for k in range(2)], "node int, k int, w double")
    moc = transport.zmoc(field, ready, dlat=1.0)
    assert rows(moc) == rows(transport.zmoc(field, strip, dlat=1.0))
    plan = moc._jdf.queryExecution().optimizedPlan().toString()
    assert "lon0" not in plan and "sum(area" not in plan


def test_large_regions_equal_the_plain_ones(spark):
    from meshlake.operators import regions

    rng = random.Random(4)
    shapes = {"star": [[math.cos(k * 0.4) * (1 + k % 2) * 9 for k in range(15)], [math.sin(k * 0.4) * (1 + k % 2) * 9 for k in range(15)]], "box": [-3.0, 4.0, -2.5, 7.25]}
    parts = regions.boxes_to_regions(spark, shapes)
    second = regions.boxes_to_regions(spark, {"star": [12.0, 15.0, 3.0, 5.0]}).withColumn("part", F.lit(1))
    parts = parts.unionByName(second)
    points = spark.createDataFrame([(k, rng.uniform(-20, 20), rng.uniform(-20, 20)) for k in range(500)] + [(900, 13.0, 4.0), (901, 4.0, 0.0), (902, -3.0, 0.0)], "id int, x double, y double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(regions.in_large_regions(points, parts, "id")) == rows(regions.in_regions(points, parts, "id"))
