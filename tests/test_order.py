"""The order of a search, against a queue."""

import random
from collections import deque

import pytest

from spindle.graph import Graph
from spindle.operators.fixpoints import _labels_of_spokes, _unseen, bfs, bfs_order, component_labels, first_reachers
from spindle.operators.joins import Spokes


def queue_order(nodes, edges, start, restart=True):
    near = {n: sorted({d for s, d in edges if s == n and d != n}) for n in nodes}
    seen, out = set(), []
    for root in [start, *sorted(nodes)]:
        if root in seen or root not in near:
            continue
        queue = deque([(root, root, 0, None)])
        seen.add(root)
        while queue:
            node, top, level, parent = queue.popleft()
            out.append((node, len(out), top, level, parent))
            for d in near[node]:
                if d not in seen:
                    seen.add(d)
                    queue.append((d, top, level + 1, node))
        if not restart:
            break
    return out


def graph(spark, nodes, edges):
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "id long"))


@pytest.mark.parametrize("directed, start, seed", [(False, 0, 1), (False, 13, 2), (True, 0, 3), (True, 17, 4), (True, 99, 5)])
def test_bfs_order_is_that_of_a_queue(spark, directed, start, seed):
    draw = random.Random(seed)
    nodes = list(range(0, 60, 1))
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(55)]
    edges += edges[:5] + [(3, 3)]
    if not directed:
        edges += [(d, s) for s, d in edges]
    got = sorted(map(tuple, bfs_order(graph(spark, nodes, edges), start).collect()), key=lambda r: r[1])
    assert got == queue_order(nodes, edges, start)


def test_without_restart_only_what_start_reaches(spark):
    edges = [(5, 2), (5, 9), (9, 1), (2, 4), (0, 5), (7, 8)]
    got = sorted(map(tuple, bfs_order(graph(spark, range(10), edges), 5, restart=False).collect()), key=lambda r: r[1])
    assert got == queue_order(list(range(10)), edges, 5, restart=False)
    assert [r[0] for r in got] == [5, 2, 9, 4, 1]


def test_orders_of_graphs_without_edges_or_nodes(spark):
    assert [r[:2] for r in sorted(map(tuple, bfs_order(graph(spark, [4, 2, 8], []), 4).collect()), key=lambda r: r[1])] == [(4, 0), (2, 1), (8, 2)]
    assert bfs_order(graph(spark, [], []), 0).count() == 0


def test_the_first_node_that_reaches_each(spark):
    edges = [(9, 0), (0, 1), (5, 1), (5, 6), (6, 5), (7, 7)]
    got = dict(map(tuple, first_reachers(graph(spark, [0, 1, 5, 6, 7, 9], edges)).collect()))
    assert got == {0: 0, 1: 0, 5: 5, 6: 5, 7: 7, 9: 9}
    got = dict(map(tuple, first_reachers(graph(spark, [0, 1, 5, 6, 7, 9], edges), 9).collect()))
    assert got == {0: 9, 1: 9, 5: 5, 6: 5, 7: 7, 9: 9}


def mirrored(spark, nodes, pairs):
    half = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "src long, dst long, weight double")
    return Graph.mirrored(half, spark.createDataFrame([(n,) for n in nodes], "id long"))


def test_mirrored_graphs_are_searched_like_others(spark):
    draw = random.Random(1)
    pairs = {tuple(sorted(draw.sample(range(40), 2))) for _ in range(40)}
    both = pairs | {(b, a) for a, b in pairs}
    g, order = mirrored(spark, range(40), pairs), queue_order(range(40), both, 5)
    assert sorted(map(tuple, bfs_order(g, 5).collect()), key=lambda r: r[1]) == order
    level = {row[0]: row[3] for row in order}
    least = {n: min((s for s, d in both if d == n and level[s] == level[n] - 1), default=None) for n in level}
    root = {row[0]: row[2] for row in order}
    assert sorted(map(tuple, bfs(g, 5).collect())) == [(n, root[n], level[n], least[n]) for n in range(40)]


def test_spokes_move_only_the_other_side(spark):
    star = [(0, k) for k in range(1, 3000)] + [(k, 0) for k in range(1, 3000)] + [(1, 2), (2, 1)]
    edges = spark.createDataFrame(star, "src long, dst long")
    rows = spark.createDataFrame([(0, 7), (1, 8)], "src long, at long")
    for near in (Spokes.of(edges, len(star)), Spokes.of(edges, len(star), small=0), Spokes.of(edges, len(star), small=0, seen=2500)):
        assert sorted(map(tuple, near.join(rows).select("src", "dst", "at").collect())) == sorted([(0, k, 7) for k in range(1, 3000)] + [(1, 0, 8), (1, 2, 8)])
        plan = near.light.join(rows.hint("shuffle_hash"), "src")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert near.hubs.collect() == [(0,)]


def test_few_edges_leave_no_component_apart(spark):
    """Triangles of large ids in a chain: least and drawn neighbours alone don't join them."""
    pairs = {(3 * t + i, 3 * t + j) for t in range(20) for i, j in ((0, 1), (0, 2), (1, 2))} | {(3 * t + 2, 3 * t + 5) for t in range(19)}
    g = mirrored(spark, range(61), pairs)
    near = Spokes.of(g.edges, 2 * len(pairs))
    assert sorted(map(tuple, _labels_of_spokes(g, near).collect())) == [(k, 0) for k in range(60)] + [(60, 60)]


def test_a_level_does_not_move_the_edges(spark):
    """The sum over what a front says keeps the buckets: seen ids are no join that slips below it."""
    pairs = {(a, b) for a in range(30) for b in range(a + 1, 30)}
    near = Spokes.of(mirrored(spark, range(30), pairs).edges, 2 * len(pairs))
    front = spark.createDataFrame([(0, 0)], "src long, at long")
    found = _unseen(near.join(front).select("dst", "at"), spark.createDataFrame([(0,), (1,)], "id long"), "before")
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(2, 30)]
    assert "Bucketed: true" in found._jdf.queryExecution().executedPlan().toString()
