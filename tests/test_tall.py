"""Iterations on tall matrices against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from spindle.graph import Graph
from spindle.operators import embedding, fixpoints, sparsify, tall


def random_graph(spark, n, p, seed, weights=True):
    rng = np.random.default_rng(seed)
    w = np.triu(rng.random((n, n)) < p, 1) * (rng.integers(1, 9, (n, n)) if weights else 1.0)
    w = (w + w.T).astype(float)
    rows = [(int(i) * 3 + 5, int(j) * 3 + 5, float(w[i, j])) for i, j in zip(*np.nonzero(w))]
    return Graph.from_edges(spark.createDataFrame(rows, "src long, dst long, weight double").repartition(3), spark.createDataFrame([(i * 3 + 5,) for i in range(n)], "id long")), w


def dense(df, n):
    rows = {r.id: r.v for r in df.collect()}
    return np.array([rows.get(i * 3 + 5, [0.0] * len(next(iter(rows.values())))) for i in range(n)])


@pytest.mark.parametrize("small", [0, 1 << 30])
def test_products_and_sums(spark, small):
    graph, w = random_graph(spark, 40, 0.2, 1)
    hub = spark.createDataFrame([(i * 3 + 5, 5, 1.0) for i in range(40)], "src long, dst long, weight double")
    w[:, 0] += 1
    y = tall.normal(graph.ids, 5, 3)
    a = tall.Sparse.of(graph.edges.unionAll(hub), small=small)
    if not small:
        a = tall.Sparse(a.rows, spark.createDataFrame([(5,)], "dst long"))
    dy = dense(y, 40)
    assert np.allclose(dense(a.times(y), 40), w @ dy)
    assert np.allclose(tall.total(y, lambda v: v.T @ v, (5, 5), "v"), dy.T @ dy)
    assert np.array_equal(dy, dense(tall.normal(graph.ids.repartition(7), 5, 3), 40)) and abs(dy.mean()) < 0.3
    assert a.times(y.limit(0)).count() == 0 and not tall.total(y.limit(0), lambda v: v.T @ v, (5, 5), "v").any()


def test_singular_vectors_equal_numpy(spark):
    graph, w = random_graph(spark, 30, 0.3, 2)
    u, values = tall.singular_vectors(tall.Sparse.of(graph.edges), graph.ids, 4, tolerance=1e-10)
    want = np.linalg.svd(w)[1][:4]
    assert np.abs(values - want).max() < 1e-6 * want[0]
    v = dense(u, 30)
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-8) and np.allclose(w @ (w @ v), v * values**2, atol=1e-4 * want[0] ** 2)
    assert (v[np.abs(v).argmax(axis=0), np.arange(4)] > 0).all()


def test_singular_vectors_of_little(spark):
    lone = Graph.from_edges(spark.createDataFrame([(1, 2, 3.0), (2, 1, 3.0)], "src long, dst long, weight double"), spark.createDataFrame([(i,) for i in (1, 2, 9)], "id long"))
    u, values = tall.singular_vectors(tall.Sparse.of(lone.edges), lone.ids, 4)
    got = {r.id: r.v for r in u.collect()}
    assert np.allclose(values, [3, 3, 0, 0]) and got[9] == [0.0] * 4 and len(got[1]) == 4
    none, values = tall.singular_vectors(tall.Sparse.of(lone.edges.limit(0)), lone.ids, 2)
    assert {tuple(r.v) for r in none.collect()} == {(0.0, 0.0)} and not values.any()


def test_resistances_come_near_the_pseudoinverse(spark):
    graph, w = random_graph(spark, 12, 0.9, 3, weights=False)
    exact = {(r.src, r.dst): r for r in sparsify.resistances(graph.edges).collect()}
    near = {(r.src, r.dst): r for r in sparsify.resistances(graph.edges, epsilon=0.5, exact_up_to=0, tolerance=1e-2).collect()}
    assert set(exact) == set(near) == {(int(i) * 3 + 5, int(j) * 3 + 5) for i, j in zip(*np.nonzero(w))}
    assert all(abs(near[e].resistance / exact[e].resistance - 1) < 0.5 and near[e].weight == exact[e].weight for e in exact)
    foster = sum(r.weight * r.resistance for (a, b), r in near.items() if a < b)
    assert abs(foster - 11) < 0.05 * 11


def test_blocks_send_a_row_once_to_each_block(spark):
    rng = np.random.default_rng(8)
    n, size = 11, 4
    w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.9), 1)
    w = w + w.T
    edges = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "src long, dst long, weight double")
    a = tall.Blocks.of(edges, n, size)
    assert a.columns.count() <= 3 * n < edges.count()
    x = rng.standard_normal((n, 64))
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], tall.TALL)
    got = np.array([r.v for r in a.times(rows).orderBy("id").collect()])
    assert np.allclose(got, w @ x, atol=1e-12)
    apart = {(r.src, r.dst): (r.weight, r.r) for r in a.apart(rows).collect()}
    assert set(apart) == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(w)))}
    assert all(np.isclose(r, ((x[i] - x[j]) ** 2).sum()) and weight == w[i, j] for (i, j), (weight, r) in apart.items())
    ends = spark.createDataFrame([(9, 2.0, [5]), (9, -1.0, [-1]), (0, 1.0, [0])], "id long, weight double, bits array<long>")
    sums = {r.id: r.v for r in a.signed(ends, 1, "float").collect()}
    assert sums[9][:4] == [1.0, -3.0, 1.0, -3.0] and set(sums[0]) == {-1.0} and set(sums[8]) == {0.0} and 4 not in sums


def test_resistances_join_no_wide_row_to_each_edge(spark, monkeypatch):
    graph, _ = random_graph(spark, 8, 0.9, 3, weights=False)
    monkeypatch.setattr(tall.Sparse, "times", lambda *_: pytest.fail("a row was joined to each edge"))
    assert sparsify.resistances(graph.edges, epsilon=0.7, exact_up_to=0, tolerance=0.1).count() == graph.edges.count()


def test_components_that_fit_a_task_are_solved_there(spark, monkeypatch):
    """Components of their own, very small ones together, and the rest by blocks; all near the pseudoinverse."""
    rng = np.random.default_rng(9)
    pairs = [(100 * c + int(i), 100 * c + int(j)) for c, n in enumerate((14, 12, 3, 2, 2)) for i, j in zip(*np.nonzero(np.triu(rng.random((n, n)) < 0.9, 1)))]
    pairs = sorted({*pairs, (200, 201), (201, 202), (300, 301), (400, 401)})
    weight = rng.uniform(0.5, 2, len(pairs)).tolist()
    half = spark.createDataFrame([(a, b, w) for (a, b), w in zip(pairs, weight)], "src long, dst long, weight double")
    exact = {(r.src, r.dst): r.resistance for r in sparsify.resistances(half).collect()}
    assert len(exact) == 2 * len(pairs)
    by_blocks = []
    blocks = sparsify._by_blocks
    monkeypatch.setattr(sparsify, "_by_blocks", lambda half, *o: by_blocks.append(half.count()) or blocks(half, *o))
    for nodes, edges, far, graph in ((1000, 2_000_000, [], Graph.mirrored(half)), (12, 4096, [sum(b < 100 for _, b in pairs)], half)):
        by_blocks.clear()
        monkeypatch.setattr(sparsify, "PART_NODES", nodes)
        monkeypatch.setattr(sparsify, "PART_EDGES", edges)
        got = {(r.src, r.dst): r.resistance for r in sparsify.resistances(graph, epsilon=0.5, exact_up_to=0, tolerance=1e-2).collect()}
        assert set(got) == set(exact) and all(abs(got[e] / exact[e] - 1) < 0.5 for e in exact)
        assert by_blocks == far


def test_conjugate_gradients_solve(spark):
    graph, w = random_graph(spark, 8, 0.9, 4)
    lap, degree = tall.laplacian(graph.edges)
    rng = np.random.default_rng(5)
    b = rng.standard_normal((8, 3))
    b -= b.mean(axis=0)
    rows = spark.createDataFrame([(i * 3 + 5, b[i].tolist()) for i in range(8)], tall.TALL)
    x = dense(tall.solved(lap, degree, rows, 3, 1e-6), 8)
    assert np.allclose((np.diag(w.sum(axis=0)) - w) @ x, b, atol=1e-4)


@pytest.mark.parametrize("maximise", [False, True])
def test_bottlenecks_equal_minimax_paths(spark, maximise):
    """Ties included; two components."""
    graph, w = random_graph(spark, 26, 0.12, 6)
    cost = np.where(w > 0, -w if maximise else w, np.inf)
    path = cost.copy()
    for k in range(26):
        path = np.minimum(path, np.maximum(path[:, k : k + 1], path[k : k + 1]))
    got = {(r.src, r.dst): (r.cost, r.bottleneck) for r in fixpoints.bottlenecks(graph, maximise).collect()}
    assert got == {(int(i) * 3 + 5, int(j) * 3 + 5): (cost[i, j], path[i, j]) for i, j in zip(*np.nonzero(np.triu(w)))}
    best = cost.min(axis=1)
    d = best - best.min()
    kept = {(r.src, r.dst): r.weight for r in sparsify.relaxed_tree(graph.edges, 0.5, maximise).collect()}
    assert kept == {(int(i) * 3 + 5, int(j) * 3 + 5): w[i, j] for i, j in zip(*np.nonzero(w)) if cost[i, j] <= path[i, j] + 0.5 * (d[i] + d[j]) + 1e-12}
    assert 0 < len(kept) < (w > 0).sum() and sparsify.relaxed_tree(graph.edges.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["adjacency", "normalized_laplacian"])
def test_svd_embedding_equals_the_patch_kernel(spark, kind):
    graph, w = random_graph(spark, 18, 0.5, 7)
    got = {r.node_id: r.coord for r in embedding.full_graph(graph, 2, matrix=kind, tolerance=1e-9, rounds=60).collect()}
    want, _ = embedding.svd(w, None, 2, 0, matrix=kind)
    assert np.allclose(np.array([got[i * 3 + 5] for i in range(18)]), want, atol=1e-3)


@pytest.mark.parametrize("kind", ["adjacency", "normalized_laplacian"])
def test_large_patches_equal_the_patch_kernel(spark, kind, monkeypatch):
    """Two overlapping patches beyond the dense size, over the limit of a task, and a small one."""
    graph, w = random_graph(spark, 24, 0.5, 8)
    monkeypatch.setattr(embedding, "DENSE_PATCH", 10)
    monkeypatch.setattr(embedding, "MAX_PATCH", 10)
    held = {3: range(14), -2: range(9, 24), 7: range(6)}
    members = spark.createDataFrame([(p, i * 3 + 5) for p, nodes in held.items() for i in nodes], "patch_id int, node_id long")
    got = {(r.patch_id, r.node_id): r.coord for r in embedding.embed_patches(graph, members, 2, matrix=kind).collect()}
    assert len(got) == members.count()
    for p, nodes in held.items():
        want, _ = embedding.svd(w[np.ix_(list(nodes), list(nodes))], None, 2, 0, matrix=kind)
        assert np.allclose(np.array([got[p, i * 3 + 5] for i in nodes]), want, atol=1e-2)


def test_singular_vectors_take_few_products(spark, monkeypatch):
    """A path's leading values lie close together; subspace iteration was 7e-5 off after 60 products."""
    n = 400
    rows = [(i * 3 + 5, j * 3 + 5, 1.0) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n] + [(i * 3 + 5, i * 3 + 5, 1.0 + i / n) for i in range(n)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    asked, times = [], tall.Sparse.times
    monkeypatch.setattr(tall.Sparse, "times", lambda a, y: (asked.append(1), times(a, y))[1])
    _, values = tall.singular_vectors(tall.Sparse.of(edges), Graph.from_edges(edges).ids, 3)
    w = np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1) + np.diag(1.0 + np.arange(n) / n)
    assert np.abs(values - np.linalg.svd(w)[1][:3]).max() < 1e-5 and len(asked) < 60
