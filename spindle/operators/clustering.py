"""Partitioning a graph into clusters.

FENNEL and spread are sequential by definition: each node's choice depends on all earlier ones.
``mode="bulk"``, the default, moves all nodes at once in rounds of joins, which scales with the
graph, keeps FENNEL's load limit in every round, and gives other, similar clusters.
``mode="exact"`` repeats the sequential result in one task over the edges in compressed form
(for graphs of up to ``EXACT_EDGES`` edges).  Louvain and the multilevel partitioner
work in rounds of joins and quotient graphs; what is left of Louvain's levels on a quotient
graph of up to ``LOCAL_EDGES`` edges is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import written
from .joins import join_dealt, ranked

EXACT_EDGES = 20_000_000
#: A level's edges that are few enough for one task of Louvain: rounds of joins on so few rows only wait for their jobs.
LOCAL_EDGES = 200_000


def _csr(src, dst, n):
    order = np.argsort(src, kind="stable")
    return np.searchsorted(src[order], np.arange(n + 1)), dst[order]


def fennel_kernel(src: np.ndarray, dst: np.ndarray, n: int, k: int, load_limit: float = 1.1, gamma: float = 1.5, alpha: float | None = None, rounds: int = 1) -> np.ndarray:
    """Node by node, the cluster of most neighbours minus alpha * gamma * size^(gamma - 1), below floor(load_limit * n / k) nodes.

    Ties go to the lowest cluster; where all are full, cluster 0 takes the node.
    """
    start, near = _csr(src, dst, n)
    alpha = len(src) * k ** (gamma - 1) / n**gamma if alpha is None else alpha
    most = int(load_limit * n / k)
    cluster = np.full(n, -1)
    size = np.zeros(k)
    for _ in range(rounds):
        for v in range(n):
            if cluster[v] >= 0:
                size[cluster[v]] -= 1
            seen = cluster[near[start[v] : start[v + 1]]]
            gain = np.bincount(seen[seen >= 0], minlength=k) - alpha * gamma * size ** (gamma - 1)
            gain[size >= most] = -np.inf
            cluster[v] = int(np.argmax(gain)) if np.isfinite(gain).any() else 0
            size[cluster[v]] += 1
    return cluster


def spread_kernel(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """k seeds of largest degree; in turn each cluster takes the free node it holds most of (weight by strength).

    Nodes that no cluster reaches form further clusters, one for each component.
    """
    start, _ = _csr(src, dst, n)
    order = np.argsort(src, kind="stable")
    near, w = dst[order], weight[order]
    strength = np.maximum(np.bincount(src, weights=weight, minlength=n), 1e-300)
    degree = np.diff(start)
    cluster = np.full(n, -1)
    pull: list[dict[int, float]] = []

    def take(c: int, v: int) -> None:
        cluster[v] = c
        for p in pull:
            p.pop(v, None)
        for u, x in zip(near[start[v] : start[v + 1]].tolist(), w[start[v] : start[v + 1]].tolist()):
            if cluster[u] < 0:
                pull[c][u] = pull[c].get(u, 0.0) + x / strength[u]

    for c, v in enumerate(np.lexsort((np.arange(n), -degree))[:k].tolist()):
        pull.append({})
        take(c, v)
    while True:
        moved = False
        for c in range(len(pull)):
            if pull[c]:
                take(c, max(pull[c], key=lambda u: (pull[c][u], -u)))
                moved = True
        if not moved:
            free = np.flatnonzero(cluster < 0)
            if not len(free):
                return cluster
            pull.append({})
            take(len(pull) - 1, int(free[np.argmax(degree[free])]))


def _exact(graph: Graph, f: Callable) -> DataFrame:
    """A kernel on node numbers 0..n-1, in one task."""
    n_edges = graph.edges.count()
    if n_edges > EXACT_EDGES:
        raise ValueError("too many edges for one task; use mode='bulk'")
    n = graph.nodes.count()
    names = ranked(graph.ids, "pos", "id")
    named = graph.edges.join(names.select(F.col("id").alias("src"), F.col("pos").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("pos").alias("b")), "dst")
    rows = named.select(F.lit(0).alias("g"), "a", "b", "weight").where("a <> b")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"], kind="stable")
        cluster = f(pdf.a.to_numpy(), pdf.b.to_numpy(), pdf.weight.to_numpy(), n)
        return pd.DataFrame({"pos": np.arange(n), "cluster": np.asarray(cluster, np.int64)})

    if not n_edges:  # nothing to group: all nodes are alone
        cluster = f(np.zeros(0, int), np.zeros(0, int), np.zeros(0), n)
        found = graph.edges.sparkSession.createDataFrame(pd.DataFrame({"pos": np.arange(n), "cluster": np.asarray(cluster, np.int64)}))
    else:
        found = rows.groupBy("g").applyInPandas(run, "pos long, cluster long")
    return names.join(found, "pos").select("id", "cluster")


@dataclass(frozen=True)
class Exact:
    """A kernel (src, dst, weight, n, k) on node numbers as a method: of a graph, or of all parts of a level at once, one task a part."""

    kernel: Callable

    def __call__(self, graph: Graph, k: int) -> DataFrame:
        return _exact(graph, lambda a, b, w, n: self.kernel(a, b, w, n, k))

    def split(self, rows: DataFrame, k: int, open_: Callable[[int], bool]) -> DataFrame:
        """``rows`` (path, src, dst, weight, open) of parts: nodes, whose dst is null, and their edges. The same of the parts' parts.

        A part that doesn't fall apart is closed, as are parts of a size that ``open_`` refuses; their edges and those between parts are dropped.
        """
        kernel = self.kernel

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            path, columns = key[0].as_py(), [table.column(c).combine_chunks() for c in ("src", "dst", "weight")]
            node = columns[1].is_null().to_numpy(zero_copy_only=False)
            src = columns[0].to_numpy(zero_copy_only=False)
            ids, src = np.sort(src[node]), src[~node]
            dst, weight = (c.filter(pa.array(~node)).to_numpy(zero_copy_only=False) for c in columns[1:])
            a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
            order = np.lexsort((b, a))
            found, part, n = np.unique(np.asarray(kernel(a[order], b[order], weight[order], len(ids), k)), return_inverse=True, return_counts=True)
            names = pa.array([f"{path}/{c:06d}" for c in found.tolist()] if len(found) > 1 else [path])
            going = np.array([len(found) > 1 and open_(int(x)) for x in n])
            inner = (part[a] == part[b]) & going[part[a]]
            of = np.r_[part, part[a[inner]]]
            far = pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(dst[inner], pa.int64())])
            return pa.table([names.take(pa.array(of)), pa.array(np.r_[ids, src[inner]]), far, pa.array(np.r_[np.zeros(len(ids)), weight[inner]]), pa.array(going[of])], ["path", "src", "dst", "weight", "open"])

        return rows.groupBy("path").applyInArrow(run, "path string, src long, dst long, weight double, open boolean")


exact_fennel = Exact(lambda a, b, w, n, k: fennel_kernel(a, b, n, k))
exact_spread = Exact(spread_kernel)


def _admitted(asking: DataFrame, room: DataFrame, parts: int) -> DataFrame:
    """Those of ``asking`` (id, to, gain, size) that fit: largest gain first, ties to the smaller id, up to each cluster's ``room`` (to, room).

    The nodes that ask for a cluster are dealt to ``parts`` tasks by hash, each of which gives away an equal share of the room.
    """
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(parts)).cast("int")
    order = Window.partitionBy("to", "part").orderBy(F.desc("gain"), "id")
    asked = asking.withColumn("part", part).withColumn("upto", F.sum("size").over(order))
    return asked.join(F.broadcast(room), "to").where(F.col("upto") <= F.floor(F.col("room") / parts)).select("id", "to")


def _loads(state: DataFrame, k: int, most: int) -> DataFrame:
    """(cluster, load, room): k numbers, by way of the driver."""
    held = {r["cluster"]: r["n"] for r in state.groupBy("cluster").agg(F.sum("size").alias("n")).collect()}
    return state.sparkSession.createDataFrame([(c, held.get(c, 0), max(0, most - held.get(c, 0))) for c in range(k)], "cluster long, load long, room long")


def fennel(
    graph: Graph, k: int, load_limit: float = 1.1, gamma: float = 1.5, alpha: float | None = None, rounds: int = 1, mode: str = "bulk",
    node_weights: DataFrame | None = None, weighted: bool = False,
) -> DataFrame:
    """(id, cluster): most neighbours minus alpha * gamma * size^(gamma - 1), never over floor(load_limit * n / k) nodes.

    In bulk mode nodes may weigh more than one (``node_weights``: id, size) and, if ``weighted``,
    edges count by their weight.  Nodes start in clusters dealt by hash, in which none is over the limit;
    in each of ``4 + rounds`` rounds half of the nodes ask for the best cluster, and those of
    the largest gain are let in up to the room there is.
    """
    if mode == "exact":
        return _exact(graph, lambda a, b, w, n: fennel_kernel(a, b, n, k, load_limit, gamma, alpha, rounds))
    sizes = join_dealt(graph.ids, node_weights.select("id", "size"), "id", "left").select("id", F.coalesce("size", F.lit(1)).cast("long").alias("size")) if node_weights is not None else graph.ids.withColumn("size", F.lit(1).cast("long"))
    edges = written(graph.edges.where("src <> dst").select("src", "dst", F.col("weight") if weighted else F.lit(1.0).alias("weight")), "fennel-edges")
    sizes = written(sizes, "fennel-sizes")
    n, heaviest = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(1))).first()
    m = edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    alpha = m * k ** (gamma - 1) / max(n, 1) ** gamma if alpha is None else alpha
    most = max(int(load_limit * n / k), -(-n // k) + (heaviest if heaviest > 1 else 0), 1)
    # Dealt in turn by hash order: full clusters differ by the weight of one node at most.
    dealt = ranked(sizes.withColumn("h", F.xxhash64("id")), "at", "h", "id")
    state = written(dealt.select("id", "size", (F.col("at") % k).alias("cluster")), "fennel")
    parts = max(1, -(-n // 1_000_000))
    for step in range(4 + rounds):
        load = _loads(state, k, most)
        near = join_dealt(edges, state.select(F.col("id").alias("dst"), "cluster"), "dst").groupBy(F.col("src").alias("id"), "cluster").agg(F.sum("weight").alias("n"))
        cost = lambda c: alpha * gamma * F.pow(c, F.lit(gamma - 1))
        gain = join_dealt(near.join(F.broadcast(load), "cluster"), state.select("id", "size", F.col("cluster").alias("home")), "id").withColumn("gain", F.col("n") - cost(F.col("load")))
        best = gain.groupBy("id", "size", "home").agg(F.max(F.struct("gain", (-F.col("cluster")).alias("c"))).alias("b"), F.max(F.when(F.col("cluster") == F.col("home"), F.col("gain"))).alias("own"))
        stay = F.coalesce("own", -cost(F.col("load")))
        best = best.join(F.broadcast(load.select(F.col("cluster").alias("home"), "load")), "home").select("id", "size", "home", (-F.col("b.c")).alias("to"), (F.col("b.gain") - stay).alias("gain"))
        turn = F.pmod(F.xxhash64("id", F.lit(step)), F.lit(2)) == 0
        go = _admitted(best.where(turn & (F.col("to") != F.col("home")) & (F.col("gain") > 1e-12)), load.select(F.col("cluster").alias("to"), "room"), parts)
        state = written(join_dealt(state, go, "id", "left").select("id", "size", F.coalesce("to", "cluster").alias("cluster")), "fennel")
    return state.select("id", "cluster")


def spread(graph: Graph, k: int, mode: str = "bulk") -> DataFrame:
    """(id, cluster) grown from the k nodes of largest degree.

    In bulk mode every cluster takes, in each round, all free nodes of which it holds most (weight
    by the node's strength; ties to the lower cluster).  What no cluster reaches forms further
    clusters, one for each component.
    """
    if mode == "exact":
        return _exact(graph, lambda a, b, w, n: spread_kernel(a, b, w, n, k))
    edges = written(graph.edges.where("src <> dst"), "spread-edges")
    degree = graph.ids.join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    seeds = degree.orderBy(F.desc("n"), "id").limit(k)
    taken = written(ranked(seeds, "cluster", F.desc("n"), F.asc("id")).select("id", "cluster"), "spread")
    front = taken
    while front.limit(1).count():
        # Each free node joins the cluster with most weight into it among all taken neighbours so far.
        touched = edges.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(taken.select("id"), "id", "left_anti")
        pull = edges.join(touched.select(F.col("id").alias("dst")), "dst", "left_semi").join(taken.select(F.col("id").alias("src"), "cluster"), "src")
        pull = pull.groupBy(F.col("dst").alias("id"), "cluster").agg(F.sum("weight").alias("w"))
        front = written(pull.groupBy("id").agg(F.max(F.struct("w", (-F.col("cluster")).alias("c"))).alias("b")).select("id", (-F.col("b.c")).alias("cluster")), "spread-front")
        taken = written(taken.unionByName(front), "spread")
    from .fixpoints import component_labels

    rest = graph.ids.join(taken.select("id"), "id", "left_anti")
    if not rest.limit(1).count():
        return taken
    rest = written(rest, "spread-rest")
    inner = edges.join(rest.select(F.col("id").alias("src")), "src", "left_semi")
    labels = component_labels(Graph(inner, rest))
    heads = ranked(labels.where("id = label").select("label"), "n", "label")
    return taken.unionByName(labels.join(heads, "label").select("id", (F.col("n") + k).alias("cluster")))


def balanced(partition: DataFrame, k: int, slack: float = 1.2) -> DataFrame:
    """``partition`` with the smallest ids beyond ``slack * n/k`` of large clusters dealt in turn to those below 0.8 n/k."""
    size = partition.groupBy("cluster").agg(F.count("*").alias("n"))
    counts = {r["cluster"]: r["n"] for r in size.collect()}
    target = sum(counts.values()) / max(k, 1)
    most = int(slack * target)
    low = sorted(c for c in counts if counts[c] < 0.8 * target)
    if not low:
        return partition
    excess = F.col("n") - F.lit(most)
    r = F.row_number().over(Window.partitionBy("cluster").orderBy("id"))
    moved = partition.join(F.broadcast(size), "cluster").withColumn("r", r)
    to = F.element_at(F.array(*[F.lit(c) for c in low]), (F.pmod(F.col("r") - 1, F.lit(len(low))) + 1).cast("int"))
    return moved.select("id", F.when((excess > 0) & (F.col("r") <= excess), to).otherwise(F.col("cluster")).alias("cluster"))


def louvain_kernel(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, resolution: float, levels: int, m2: float) -> np.ndarray:
    """The community of each node 0..n-1: local moves node by node until none gains, then on the quotient graph.

    Edges hold both directions and loops; ``m2`` is the sum of all their weights. Ties go to the node's own community, then to the lowest.
    """
    names = np.arange(n)
    for _ in range(levels):
        order = np.lexsort((dst, src))
        src, dst, weight = src[order], dst[order], weight[order]
        cut = np.searchsorted(src, np.arange(n + 1)).tolist()
        near, w = dst.tolist(), weight.tolist()
        degree = np.bincount(src, weights=weight, minlength=n).tolist()
        total, cluster = degree.copy(), list(range(n))
        any_move, moved = False, True
        while moved:
            moved = False
            for v in range(n):
                pull: dict[int, float] = {}
                for e in range(cut[v], cut[v + 1]):
                    if near[e] != v:
                        c = cluster[near[e]]
                        pull[c] = pull.get(c, 0.0) + w[e]
                home, share = cluster[v], resolution * degree[v] / m2
                total[home] -= degree[v]
                to, most = home, pull.get(home, 0.0) - share * total[home] + 1e-12
                for c, x in pull.items():
                    gain = x - share * total[c]
                    if c != home and (gain > most or (gain == most and to != home and c < to)):
                        to, most = c, gain
                total[to] += degree[v]
                if to != home:
                    cluster[v] = to
                    moved = any_move = True
        if not any_move:
            break
        part, of = np.unique(cluster, return_inverse=True)
        names, n = of[names], len(part)
        pairs, at = np.unique(of[src] * n + of[dst], return_inverse=True)
        src, dst, weight = pairs // n, pairs % n, np.bincount(at, weights=weight)
    return names


def _louvain_left(edges: DataFrame, resolution: float, levels: int, m2: float) -> DataFrame:
    """(id, cluster) of the ends of few ``edges``: all levels that are left, by one task; a community is named by its smallest id."""

    def run(table: pa.Table) -> pa.Table:
        src, dst, weight = (table.column(c).to_numpy() for c in ("src", "dst", "weight"))
        ids, at = np.unique(np.r_[src, dst], return_inverse=True)
        found = louvain_kernel(at[: len(src)], at[len(src) :], weight, len(ids), resolution, levels, m2)
        first = np.full(found.max(initial=-1) + 1, len(ids))
        np.minimum.at(first, found, np.arange(len(ids)))
        return pa.table({"id": ids, "cluster": ids[first[found]]})

    return edges.select(F.lit(0).alias("g"), "src", "dst", F.col("weight").cast("double").alias("weight")).groupBy("g").applyInArrow(run, "id long, cluster long")


def louvain(graph: Graph, resolution: float = 1.0, levels: int = 10, rounds: int = 12) -> DataFrame:
    """Modularity by local moves in rounds of joins, then on the quotient graph, until nothing moves.

    In a round half of the communities may give and the other half take, so no two nodes swap places.
    From a quotient graph of up to ``LOCAL_EDGES`` edges on, the levels that are left are one task's work, node by node.
    """
    level_graph, names = graph, graph.ids.withColumn("cluster", F.col("id"))
    m2 = graph.edges.agg(F.sum("weight")).first()[0] or 1.0
    for level in range(levels):
        edges = written(level_graph.edges, "louvain-e")
        if edges.count() <= LOCAL_EDGES:
            state = written(_louvain_left(edges, resolution, levels - level, m2), "louvain")
            names = written(_renamed(names, state), "louvain-n")
            break
        degree = written(edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("deg")), "louvain-d")
        state = written(join_dealt(level_graph.ids, degree, "id", "left").select("id", F.col("id").alias("cluster"), "deg"), "louvain")
        any_move, idle = False, 0
        for step in range(rounds):
            total = state.groupBy("cluster").agg(F.sum("deg").alias("tot"))
            link = join_dealt(edges.where("src <> dst"), state.select(F.col("id").alias("dst"), "cluster"), "dst").groupBy(F.col("src").alias("id"), "cluster").agg(F.sum("weight").alias("w"))
            own = join_dealt(state.where("deg is not null").select("id", "deg", F.col("cluster").alias("home")), total.select(F.col("cluster").alias("home"), F.col("tot").alias("home_tot")), "home")
            offer = join_dealt(join_dealt(link, own, "id"), total, "cluster")
            without = F.col("tot") - F.when(F.col("cluster") == F.col("home"), F.col("deg")).otherwise(0.0)
            offer = offer.withColumns({"gain": F.col("w") - resolution * F.col("deg") * without / m2, "alone": -resolution * F.col("deg") * (F.col("home_tot") - F.col("deg")) / m2})
            best = offer.groupBy("id").agg(
                F.max(F.struct("gain", (-F.col("cluster")).alias("c"))).alias("b"), F.max(F.when(F.col("cluster") == F.col("home"), F.col("gain"))).alias("here"),
                F.first("alone").alias("stay"), F.first("home").alias("cluster"),
            )
            side = lambda c: F.pmod(F.xxhash64(c, F.lit(step)), F.lit(2))
            moves = best.withColumn("to", -F.col("b.c")).where((F.col("b.gain") > F.coalesce("here", "stay") + 1e-12) & (F.col("to") != F.col("cluster")) & (side(F.col("cluster")) == 0) & (side(F.col("to")) == 1)).select("id", "to")
            new = written(join_dealt(state, moves, "id", "left").select("id", F.coalesce("to", "cluster").alias("cluster"), "deg", F.col("to").isNotNull().alias("moved")), "louvain")
            moved = new.where("moved").limit(1).count()
            state = new.drop("moved")
            any_move, idle = any_move or bool(moved), 0 if moved else idle + 1
            if idle >= 4:
                break
        if not any_move:
            break
        names = written(_renamed(names, state), "louvain-n")
        level_graph = Graph.from_edges(level_graph.quotient(state).select("src", "dst", "weight"))
    dense = ranked(names.select("cluster").distinct(), "n", "cluster")
    return join_dealt(names, dense, "cluster").select("id", F.col("n").alias("cluster"))


def _renamed(names: DataFrame, state: DataFrame) -> DataFrame:
    """``names`` (id, cluster) after the clusters' moves in ``state``; clusters without edges aren't in it and stay."""
    return join_dealt(names, state.select(F.col("id").alias("cluster"), F.col("cluster").alias("next")), "cluster", "left").select("id", F.coalesce("next", "cluster").alias("cluster"))


def louvain_resolutions(graph: Graph, resolutions: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0)) -> DataFrame:
    """(resolution, id, cluster)."""
    out = None
    for r in resolutions:
        one = louvain(graph, r).withColumn("resolution", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return out


def multilevel(graph: Graph, k: int, coarsest: int = 4000, load_limit: float = 1.1, node_weights: DataFrame | None = None, refine: int = 2) -> DataFrame:
    """Balanced k-way cut by node and edge weights: heavy-edge matching down to ``coarsest`` nodes, weighted FENNEL there, then a refinement on every level.

    A coarse node weighs what its nodes weigh (``node_weights``: id, size; 1 each without).  No matched
    pair weighs over half a cluster.  ``refine`` rounds on each level move nodes to the cluster with
    more of their edges' weight, up to the load limit.
    """
    base = Graph(graph.undirected().edges.where("src <> dst"), graph.nodes)
    size = join_dealt(base.ids, node_weights.select("id", "size"), "id", "left").select("id", F.coalesce("size", F.lit(1)).cast("long").alias("size")) if node_weights is not None else base.ids.withColumn("size", F.lit(1).cast("long"))
    g, size = Graph(written(base.edges, "level-edges"), base.nodes), written(size, "level-sizes")
    total = size.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    levels, n = [], g.nodes.count()
    while n > max(coarsest, 4 * k):
        fit = join_dealt(join_dealt(g.edges, size.select(F.col("id").alias("src"), F.col("size").alias("a")), "src"), size.select(F.col("id").alias("dst"), F.col("size").alias("b")), "dst").where(F.col("a") + F.col("b") <= max(2, total // (2 * k)))
        tie = F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"))  # the same from both ends
        best = written(fit.groupBy("src").agg(F.max_by("dst", F.struct("weight", tie)).alias("dst")), "match")
        pairs = join_dealt(best, best.select(F.col("src").alias("dst"), F.col("dst").alias("back")), "dst").where("src = back").select(F.greatest("src", "dst").alias("id"), F.least("src", "dst").alias("cluster")).distinct()
        step = written(join_dealt(g.ids, pairs, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster")), "match")
        coarse = written(join_dealt(step, size, "id").groupBy(F.col("cluster").alias("id")).agg(F.sum("size").alias("size")), "level-sizes")
        left = coarse.count()
        if left > 0.98 * n:  # hardly anything matches any more
            break
        levels.append((g, size, step))
        g, size, n = Graph(written(g.quotient(step, self_loops=False).select("src", "dst", "weight"), "level-edges"), coarse.select("id")), coarse, left
    part = written(fennel(g, k, load_limit, rounds=4, node_weights=size, weighted=True), "multilevel")
    for finer, sizes, step in reversed(levels):
        part = written(join_dealt(step, part.select(F.col("id").alias("cluster"), F.col("cluster").alias("c")), "cluster").select("id", F.col("c").alias("cluster")), "multilevel")
        part = refined(finer, part, k, load_limit, sizes, refine)
    return part if node_weights is not None else balanced(part, k, load_limit)


def refined(graph: Graph, partition: DataFrame, k: int, load_limit: float, sizes: DataFrame, rounds: int = 2) -> DataFrame:
    """``partition`` after rounds in which nodes go where more of their edges' weight lies, largest gain first, up to the load limit."""
    state = written(join_dealt(partition, sizes, "id").select("id", "size", "cluster"), "refine")
    n = state.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(1, -(-n // 1_000_000))
    for step in range(2 * rounds):
        near = join_dealt(graph.edges, state.select(F.col("id").alias("dst"), "cluster"), "dst").groupBy(F.col("src").alias("id"), "cluster").agg(F.sum("weight").alias("w"))
        near = join_dealt(near, state.select("id", "size", F.col("cluster").alias("home")), "id")
        best = near.groupBy("id", "size", "home").agg(F.max(F.struct("w", (-F.col("cluster")).alias("c"))).alias("b"), F.max(F.when(F.col("cluster") == F.col("home"), F.col("w"))).alias("own"))
        side = lambda c: F.pmod(F.xxhash64(c, F.lit(step)), F.lit(2))
        # Half of the clusters give and the others take, so that neighbours don't swap places.
        moves = best.select("id", "size", "home", (-F.col("b.c")).alias("to"), (F.col("b.w") - F.coalesce("own", F.lit(0.0))).alias("gain")).where((F.col("gain") > 1e-12) & (side(F.col("home")) == 0) & (side(F.col("to")) == 1))
        go = _admitted(moves, _loads(state, k, int(load_limit * n / k)).select(F.col("cluster").alias("to"), "room"), parts)
        state = written(join_dealt(state, go, "id", "left").select("id", "size", F.coalesce("to", "cluster").alias("cluster")), "refine")
    return state.select("id", "cluster")


def _levels(graph: Graph, most: int, split: int, method: Exact, levels: int | None) -> DataFrame:
    """(id, path) of all clusters, split level by level."""
    if graph.edges.count() > EXACT_EDGES:
        raise ValueError("too many edges for one task; use mode='bulk'")
    n, depth, done = graph.nodes.count(), 0, []
    if n <= max(most, split) or levels == 0:
        return graph.ids.withColumn("path", F.lit(""))
    nodes = graph.ids.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("weight"))
    inner = graph.edges.where("src <> dst").select("src", "dst", "weight").join(graph.ids.withColumnRenamed("id", "src"), "src", "left_semi")
    inner = inner.join(graph.ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")
    rows = nodes.unionAll(inner).select(F.lit("").alias("path"), "*")
    while depth == 0 or rows.limit(1).count():
        depth += 1
        more = levels is None or depth < levels
        made = written(method.split(rows, split, lambda size, more=more: more and size > most and size > split), "split")
        done.append(made.where("dst is null and not open").select(F.col("src").alias("id"), "path"))
        rows = made.where("open").drop("open")
    return reduce(DataFrame.unionAll, done)


def hierarchical(graph: Graph, most: int, split: int, method: Callable | None = None, levels: int | None = None) -> DataFrame:
    """(id, cluster): clusters over ``most`` nodes are split again (``levels`` times at most, if given); numbers are dense, in order of their paths.

    With an ``Exact`` method all clusters of a level are split by one job; other methods take a job or more for each cluster.
    """
    method = method or fennel
    if isinstance(method, Exact):
        done = _levels(graph, most, split, method, levels)
        return done.join(ranked(done.select("path").distinct(), "cluster", "path"), "path").select("id", "cluster")
    done, todo = None, [("", graph.ids)]
    while todo:
        path, nodes = todo.pop()
        n = nodes.count()
        if n <= most or n <= split or (levels is not None and path.count("/") >= levels):
            one = nodes.select("id", F.lit(path).alias("path"))
            done = one if done is None else done.unionAll(one)
            continue
        sub = graph.subgraph(nodes, relabel=False)
        part = written(method(sub, split), "split")
        found = sorted(r[0] for r in part.select("cluster").distinct().collect())
        if len(found) < 2:
            done = nodes.select("id", F.lit(path).alias("path")) if done is None else done.unionAll(nodes.select("id", F.lit(path).alias("path")))
            continue
        todo += [(f"{path}/{c:06d}", part.where(F.col("cluster") == c).select("id")) for c in found]
    dense = ranked(done.select("path").distinct(), "cluster", "path")
    return done.join(dense, "path").select("id", "cluster")


def agglomerative(graph: Graph, levels: int = 2, branches: list[int] | None = None, method: Callable | None = None) -> list[DataFrame]:
    """Partitions from fine to coarse; level l has about the product of the first levels' branches as clusters."""
    method = method or fennel
    n = graph.nodes.count()
    branches = branches or [max(2, round(n ** (1 / (levels + 1))))] * levels
    sizes = np.cumprod(branches)[::-1].tolist()
    out, g, names = [], graph, graph.ids.withColumn("cluster", F.col("id"))
    for k in sizes:
        part = written(method(g, int(min(k, max(1, g.nodes.count())))), "agglomerate")
        names = written(names.join(part.select(F.col("id").alias("cluster"), F.col("cluster").alias("c")), "cluster").select("id", F.col("c").alias("cluster")), "agglomerate")
        out.append(names)
        g = Graph(g.quotient(part).select("src", "dst", "weight"), part.select(F.col("cluster").alias("id")).distinct())
    return out


def adaptive(graph: Graph, least: int, most: int, method: Callable | None = None, levels: int = 10) -> DataFrame:
    """Splits until no cluster is over ``most``, then merges those under ``least``."""
    from .patching import merge_small

    return merge_small(graph, written(hierarchical(graph, most, 2, method, levels), "adaptive"), least)


CLUSTERINGS: dict[str, Callable] = {
    "fennel": fennel, "louvain": lambda g, k=None, **o: louvain(g, **o), "metis": multilevel, "spread": spread,
    "hierarchical": lambda g, k, **o: hierarchical(g, max(1, -(-g.nodes.count() // k)), 2, **o),
}


def run_clustering(graph: Graph, k: int, method: str = "fennel", **options) -> DataFrame:
    return CLUSTERINGS[method](graph, k, **options)
