"""Operators on vectors and chats against brute force, and the pipeline."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

queries = pytest.importorskip("meshlake.llm.queries")
from meshlake.llm import chat_tools, embedding_dedup, topk_search  # noqa: E402

NAN = float("nan")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def cluster_rows(n=260, dim=12, seed=3):
    rng = np.random.RandomState(seed)
    centres = rng.randn(9, dim)
    x = (centres[rng.randint(0, 9, n)] + rng.randn(n, dim) * rng.choice([0.02, 0.2, 1.0], n)[:, None]).astype(np.float32)
    x[40:60] = x[40]
    rows = [(k, [float(v) for v in x[k]], int(k % 2)) for k in range(n)]
    odd = [(900, None, 0), (901, [0.0] * dim, 0), (902, [NAN] + [1.0] * (dim - 1), 0), (903, [float("inf")] * dim, 1), (904, [1.0, None] + [0.0] * (dim - 2), 1), (905, rows[40][1], None), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (0, rows[0][1], 0)]
    return rows + odd


def brute_links(rows, threshold):
    good = {r[0]: r for r in rows if r[1] is not None and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])}
    parent = {r[0]: r[0] for r in rows}
    links = dict.fromkeys(parent, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(good)
    for a in ids:
        for b in ids:
            if a < b and good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]):
                x, y = np.array(good[a][1], float), np.array(good[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    p, q = root(a), root(b)
                    parent[max(p, q)] = min(p, q)
    return {i: (links[i], root(i), i == root(i)) for i in parent}


def test_near_duplicates(spark, monkeypatch):
    rows = cluster_rows()
    want = brute_links(rows, 0.98)
    for cell, block, tile in ((8192, 16384, 2048), (20, 16, 2048), (100, 16384, 7)):
        monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell)
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        monkeypatch.setattr(embedding_dedup, "TILE", tile)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark, vectors(spark, rows)).collect()}
        assert got == want
    assert embedding_dedup.near_duplicates(spark, vectors(spark, [])).count() == 0
    got = embedding_dedup.near_duplicates(spark, vectors(spark, [(None, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (1, [1.0, 0.0], 0)])).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, 1, True), (None, 0, None, True), (None, 0, None, True)]


def test_clustered_vectors_stay_in_their_cells(spark):
    # tight clusters: with default settings nearly every vector has one cell, and links equal brute force
    rng = np.random.RandomState(5)
    x = rng.randn(4, 32)
    x = (x / np.linalg.norm(x, axis=1)[:, None])[rng.randint(0, 4, 900)] + 0.03 * rng.randn(900, 32)
    rows = [(k, [float(v) for v in x[k]], k % 2) for k in range(900)]
    unit = embedding_dedup.unit(x)
    centroids = embedding_dedup.fit_centroids(unit, embedding_dedup.LEAST_CELLS)
    placed = embedding_dedup.cells_of(unit, centroids, 0.98)
    assert len(placed[0]) < 1.1 * len(x)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark, frame).collect()}
    assert got == brute_links(rows, 0.98)


def test_top_k(spark, monkeypatch):
    rows = cluster_rows(dim=16)
    frame = vectors(spark, rows)
    monkeypatch.setattr(topk_search, "BLOCK", 50)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search.top_k(spark, frame, frame.where("vec_id % 10 = 0"), k=5, queries_at_once=7).collect()}
    good = [(i, np.floor(256 * np.array(e, dtype=np.float64))) for i, e, _ in rows if e is not None and all(v is not None and np.isfinite(v) for v in e)]
    want = {}
    for i, x in {i: x for i, x in good if i % 10 == 0}.items():
        best = {}
        for j, y in good:
            if i != j and len(x) == len(y):
                best[j] = max(best.get(j, -np.inf), x @ y)
        for r, (s, j) in enumerate(sorted((-s, j) for j, s in best.items())[:5]):
            want[i, r + 1] = (j, int(-s))
    assert got == want
    assert topk_search.top_k(spark, frame.limit(0), frame.limit(0)).count() == 0


def test_top_k_counts_an_id_once(spark):
    # one id many times among the best, with equal and with different scores
    scores = [(1, 10), (1, 10), (1, 10), (1, 9), (1, 8), (1, 8), (2, 9), (3, 8), (4, 7), (5, 6)] + [(10 + k, 1) for k in range(40)]
    frame = vectors(spark, [(0, [1.0, 0.0], 0)] + [(i, [float(s), 0.0], 0) for i, s in scores]).coalesce(1)
    got = [(r.rank, r.vec_id, r.score) for r in topk_search.top_k(spark, frame, frame.where("vec_id = 0"), k=5, scale=1).orderBy("rank").collect()]
    assert got == [(1, 1, 10), (2, 2, 9), (3, 3, 8), (4, 4, 7), (5, 5, 6)]


@pytest.mark.parametrize("depths", [topk_search.DEPTHS, ()])
def test_best_lists_hold_distinct_ids(depths):
    rng = np.random.RandomState(2)
    ids = rng.randint(0, 40, 600)
    x = np.floor(256 * rng.randn(600, 8) / 6)
    x[:300] = x[rng.randint(0, 9, 300)]
    best, q = topk_search.BestLists(20, 5), x[::30]
    for a in range(0, 600, 200):
        topk_search.SortedLists(x[a : a + 200], ids[a : a + 200], depths).search(q, np.full(20, -1), best)
    score = np.stack([(q @ x.T)[:, ids == i].max(axis=1) for i in range(40)], axis=1)
    order = np.lexsort((np.broadcast_to(np.arange(40), score.shape), -score), axis=1)[:, :5]
    assert (best.id == order).all() and (best.score == np.take_along_axis(score, order, axis=1)).all()


def test_reading_stops_early():
    rng = np.random.RandomState(0)
    x = np.floor(256 * rng.randn(3000, 32) / 6)
    lists = topk_search.SortedLists(x, np.arange(3000))
    best = topk_search.BestLists(40, 5)
    q = x[:40]
    lists.search(q, np.arange(40), best)
    score = q @ x.T
    score[np.arange(40), np.arange(40)] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(3000), score.shape), -score), axis=1)[:, :5]
    assert (best.id == order).all()


def test_top_k_with_large_components(spark):
    rng = np.random.RandomState(4)
    rows = [(i % 60, [float(v) for v in rng.randint(-(2**29), 2**29, 6)], 0) for i in range(90)] + [(3, [1.5, -0.5, 0.0, 0.0, 0.0, 0.0], 0)] * 4
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search.top_k(spark, frame, frame.where("vec_id = 3"), k=70, scale=1).collect()}
    best = {}
    for i, x, _ in rows:
        for j, y, _ in rows:
            if i == 3 and j != 3:
                s = sum(int(np.floor(a)) * int(np.floor(b)) for a, b in zip(x, y, strict=True))
                best[j] = max(best.get(j, s), s)
    assert got == {(3, r + 1): (j, -s) for r, (s, j) in enumerate(sorted((-s, j) for j, s in best.items()))}


CALLS = [
    ("c", 5, "a", "add", '{"y": 2, "x": 1}', []), ("c", 1, "b", "add", '{"x": "1", "y": 2}', ["a"]), ("c", 2, "d", "add", '{"x": 1}', []), ("c", 3, "e", "add", "nonsense", []),
    ("c", 4, "f", "other", "{}", []), ("c", 6, "g", "add", '{"x":1,"y":2,"z":3}', []), ("x", 1, "p", "add", '{"x":1,"y":2}', ["q"]), ("x", 2, "q", "add", '{"x":1,"y":2}', ["p"]),
    ("c", 5, "a", "add", '{"y": 2, "x": 1}', []), (None, 1, "a", "add", "{}", []),
]
RESULTS = [("c", 2, "a", "3"), ("c", 9, "b", None), ("c", 9, "lost", 'say "é"\n'), ("x", 3, "p", "1"), ("x", 4, "q", "1"), ("c", 2, "a", "3")]
TOOLS = {"add": {"x": ("integer", True), "y": ("number", True)}}


def linked(spark, calls=CALLS, results=RESULTS, rounds=12):
    c = spark.createDataFrame(calls, "conv_id string, turn int, call_id string, name string, arguments string, after array<string>")
    r = spark.createDataFrame(results, "conv_id string, turn int, call_id string, content string")
    return chat_tools.link(c, r, TOOLS, max_rounds=rounds).collect()


def test_tool_calls(spark):
    rows = {(r.conv_id, r.kind, r.call_id): r for r in linked(spark)}
    assert len(rows) == 13
    at = lambda *k: rows[k].position
    assert at("c", "call", "a") < at("c", "result", "a") < at("c", "call", "b") < at("c", "result", "b")
    errors = {k: rows["c", "call", k].errors for k in "abdefg"}
    assert errors == {"a": [], "b": ["wrong type x"], "d": ["missing y"], "e": ["no object"], "f": ["unknown tool"], "g": ["unexpected z"]}
    assert rows["c", "call", "a"].json == '{"arguments":{"x":1,"y":2},"call_id":"a","name":"add","type":"call"}'
    assert json.loads(rows["c", "result", "lost"].json)["content"] == 'say "é"\n'
    assert json.loads(rows["c", "result", "b"].json)["content"] is None
    assert (rows["c", "call", "d"].status, rows["c", "result", "lost"].status, rows["x", "call", "p"].status) == ("unanswered", "orphan", "cyclic")
    assert linked(spark, [], []) == []


def test_long_chains_are_not_cycles(spark):
    # 45 calls logged in reverse (90 steps), beside cycles of two and three calls and what depends on them
    n, arguments = 45, '{"x":1,"y":2}'
    calls = [("long", 2 * (n - k), f"k{k:02}", "add", arguments, [f"k{k - 1:02}"] if k else []) for k in range(n)]
    results = [("long", 2 * (n - k) + 1, f"k{k:02}", "1") for k in range(n)]
    loops = {"p": "q", "q": "p", "u": "v", "v": "w", "w": "u", "late": "p"}
    calls += [("loop", 100 if i == "late" else 1, i, "add", arguments, [j, "free", "nowhere", None]) for i, j in loops.items()]
    calls += [("loop", 9, "free", "add", arguments, None), ("loop", 1, "behind", "add", arguments, ["free"])]
    results += [("loop", 10, i, "1") for i in [*loops, "free"]]
    rows = {(r.conv_id, r.kind, r.call_id): r for r in linked(spark, calls, results)}
    placed = [rows["long", kind, f"k{k:02}"] for k in range(n) for kind in ("call", "result")]
    assert {r.status for r in placed} == {"linked"}
    want = [2 * n * chat_tools.SPREAD]
    want += [max(want[0] + chat_tools.SPREAD, want[0] + 1)]
    for _ in range(2 * n - 2):
        want.append(want[-1] + 1)
    assert [r.position for r in placed] == want
    for i in loops:
        assert {rows["loop", kind, i].status for kind in ("call", "result")} == {"cyclic"}
        assert rows["loop", "call", i].position == rows["loop", "call", i].turn * chat_tools.SPREAD
    assert (rows["loop", "call", "free"].status, rows["loop", "call", "behind"].status) == ("linked", "unanswered")
    assert rows["loop", "call", "behind"].position == rows["loop", "result", "free"].position + 1


def test_positions_equal_longest_paths(spark):
    from meshlake.llm.common import Scratch

    rng = np.random.RandomState(8)
    nodes, edges, want = [], set(), {}
    for conv in range(12):
        at = rng.randint(0, 30, 14)
        mine = {(int(a), int(b)) for a, b in rng.randint(0, 14, (rng.randint(5, 22), 2)) if conv % 3 == 0 or a < b}
        nodes += [(conv, f"n{k}", int(at[k])) for k in range(14)]
        edges |= {(conv, f"n{a}", f"n{b}") for a, b in mine}
        value, opened = {k: int(at[k]) for k in range(14)}, set(range(14))
        while free := {k for k in opened if not any(b == k and a in opened for a, b in mine)}:
            for k in free:
                value[k] = max([value[k], *(value[a] + 1 for a, b in mine if b == k)])
            opened -= free
        want |= {(conv, f"n{k}"): (int(at[k]) if k in opened else value[k], k in opened) for k in range(14)}
    placed = chat_tools._positions(spark.createDataFrame(nodes, "conv_id long, node string, position long"), spark.createDataFrame(sorted(edges), "conv_id long, earlier string, node string"), Scratch(spark, "test"))
    assert {(r.conv_id, r.node): (r.position, r.cyclic) for r in placed.collect()} == want
    assert {c for _, c in want.values()} == {True, False}


def test_queries_cover_every_row(spark, sf):
    chats = spark.read.parquet(f"{sf}/conversations.parquet").where("role <> 'system'").select("conv_id", "turn").distinct().count()
    assert queries.op6_tool_calls(spark, sf).count() == chats
    vecs = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").distinct().count()
    assert queries.op8_embedding_dedup(spark, sf).count() == vecs


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    from meshlake.llm.common import Scratch

    scratch, docs = Scratch(spark, "test"), spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, sf))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "jaccard_join":
            from meshlake.llm.jaccard_join import jaccard_components

            assert jaccard_components(spark, docs).where("doc_id <> component_id").count() == 0
        if name == "pii":
            assert docs.where(F.col("text").rlike(r"@mail\d\.example")).count() == 0
    assert counts[0] > counts[1] > counts[2] == counts[3] and docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


def test_near_copies_go_by_their_own_text(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = lambda seed: " ".join(f"w{k}" for k in np.random.RandomState(seed).randint(0, 9999, 40))
    rows = [(7, text(0)), (7, text(1)), (7, text(2)), (9, text(0)), (3, text(2)), (5, text(3)), (5, text(3)), (None, text(3)), (None, text(3))]
    kept = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    want = [(7, text(0)), (7, text(1)), (3, text(2)), (5, text(3)), (None, text(3)), (None, text(3))]
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in want)
