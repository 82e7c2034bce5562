"""Edge selection on patch graphs (src, dst, weight), which have a row for each pair of patches.

All run as joins and grouped sums: resistances from conjugate gradients on the Laplacian, relaxed
trees from bottlenecks on the tree of merges.  Small graphs' resistances come from a pseudoinverse.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import written
from . import tall
from .fixpoints import bottlenecks, component_labels, spanning_forest
from .joins import join_heavy, ranked

#: Most columns of one solve: a row of its tables has five arrays of so many numbers.
SIGNS = 256
#: Nodes and edges of a component that one task solves: some 200 MB of a solve's arrays, and as much of edges.
PART_NODES, PART_EDGES = 32_768, 2_000_000


def conductance_weights(edges: DataFrame) -> DataFrame:
    """weight / min(strength of both ends)."""
    s = edges.groupBy("src").agg(F.sum("weight").alias("s"))
    j = edges.join(s.select("src", F.col("s").alias("a")), "src").join(s.select(F.col("src").alias("dst"), F.col("s").alias("b")), "dst", "left")
    return j.select("src", "dst", (F.col("weight") / F.least("a", F.coalesce("b", "a"))).alias("weight"))


def _driver(edges: DataFrame):
    rows = edges.select("src", "dst", "weight").collect()
    ids = sorted({r[0] for r in rows} | {r[1] for r in rows})
    at = {v: i for i, v in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for s, d, x in rows:
        if s != d:
            w[at[s], at[d]] = w[at[d], at[s]] = max(w[at[s], at[d]], x)
    return ids, w


def _undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge once, without loops; of parallel edges the largest weight stays."""
    return Graph.from_edges(edges.where("src <> dst")).undirected().edges.where("weight > 0")


def _half(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) with src < dst, every pair once, without loops; of parallel edges the largest weight stays."""
    e = Graph.from_edges(edges.where("src <> dst")).edges
    return e.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight")).where("weight > 0")


def resistances(edges: DataFrame | Graph, epsilon: float = 0.3, exact_up_to: int = 1000, tolerance: float = 1e-5, seed: int = 0) -> DataFrame:
    """(src, dst, weight, resistance) of an undirected graph, both directions.

    With up to ``exact_up_to`` nodes by the pseudoinverse of the Laplacian, else by random projections: the
    rows of Q W^(1/2) B L^+ keep all distances within a factor of 1 +- ``epsilon`` with high
    probability, where Q has 4 ln n / (epsilon^2 / 2 - epsilon^3 / 3) rows of random signs.  Up to ``SIGNS`` of
    them are one solve of the Laplacian by conjugate gradients.  Components of up to ``PART_NODES`` nodes and ``PART_EDGES`` edges are
    solved by a task each, the others by rounds of a few joins.  A ``Graph.mirrored`` is taken as it is, without a sum of parallel edges.
    """
    if isinstance(edges, Graph):
        half = edges.half.where("weight > 0") if edges.half is not None else written(_half(edges.edges), "resistance-edges")
    else:
        half = written(_half(edges), "resistance-edges")
    ids = written(Graph.mirrored(half).ids, "resistance-ids")
    n = ids.count()
    if n <= exact_up_to:
        ids, w = _driver(half)
        p = np.linalg.pinv(np.diag(w.sum(axis=0)) - w) if len(ids) else w
        rows = [(ids[i], ids[j], float(w[i, j]), float(p[i, i] + p[j, j] - 2 * p[i, j])) for i, j in zip(*np.nonzero(w))]
        return half.sparkSession.createDataFrame(rows, "src long, dst long, weight double, resistance double")
    needed = math.ceil(4 * math.log(max(n, 2)) / (epsilon**2 / 2 - epsilon**3 / 3))
    blocks = -(-needed // SIGNS)
    words = -(-needed // (64 * blocks))  # an edge's signs are the bits of so many hashes
    kind = "float" if tolerance >= 1e-4 else "double"
    tall.bounded_batches(half.sparkSession)

    labels = component_labels(Graph.mirrored(half, ids))
    degree = half.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    sizes = labels.join(degree, "id", "left").groupBy("label").agg(F.count("*").alias("nodes"), F.sum("n").alias("edges"))
    fits, tiny = (F.col("nodes") <= PART_NODES) & (F.col("edges") <= PART_EDGES), F.col("edges") <= PART_EDGES // 1024
    sizes = written(sizes.select("label", "nodes", "edges", fits.alias("fits"), (fits & tiny).alias("tiny")), "resistance-parts")
    facts = sizes.agg(F.coalesce(F.bool_or("fits"), F.lit(False)), F.coalesce(F.bool_and("fits"), F.lit(True)), F.coalesce(F.sum(F.when(F.col("tiny"), F.col("edges"))), F.lit(0)), F.count_if(F.expr("fits and not tiny"))).first()
    # Very small components share tasks; the others are long tasks, which shouldn't be put together because their edges are few bytes.
    shares = max(1, 16 * facts[2] // PART_EDGES)
    shared, tasks = F.pmod(F.xxhash64("label"), F.lit(shares)), min(2000, 4 * (facts[3] + shares))
    of = join_heavy(labels, sizes.drop("edges"), "label", "nodes", n).select(F.col("id").alias("src"), "fits", "tiny", F.when(F.col("tiny"), shared).otherwise(F.col("label")).alias("part"))
    made = []
    if facts[0]:
        made.append(_by_parts(half.join(of.where("fits"), "src").select("tiny", "part", "src", "dst", "weight").repartition(tasks, "tiny", "part"), blocks, words, tolerance, kind, seed))
    if not facts[1]:
        large = half if not facts[0] else written(half.join(of.where("not fits").select("src"), "src", "left_semi"), "resistance-large")
        made.append(_by_blocks(large, blocks, words, tolerance, kind, seed))
    out = reduce(DataFrame.unionAll, made)
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return out.select(ends.alias("e"), "weight", "resistance").select("e.src", "e.dst", "weight", "resistance")


def _signs(src: np.ndarray, dst: np.ndarray, word: int) -> np.ndarray:
    """64 random bits of each edge: mixed twice as splitmix64 does."""
    x = np.zeros(len(src), np.uint64)
    with np.errstate(over="ignore"):
        for part in (src.astype(np.uint64), dst.astype(np.uint64), np.uint64(word & (2**63 - 1))):
            x = (x ^ part) + np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    return x


def projected_resistances(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, blocks: int, words: int, tolerance: float, kind: str, seed: int) -> np.ndarray:
    """The projected resistance of every edge (each pair once) of a graph that fits a task; as ``tall.solved`` does, in arrays."""
    number, width, step = np.float32 if kind == "float" else np.float64, 64 * words, 1024
    ids, at = np.unique(np.r_[src, dst], return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    row, col, w = np.r_[a, b], np.r_[b, a], np.r_[weight, weight]
    order = np.argsort(row, kind="stable")
    row, col, w = row[order], col[order], w[order].astype(number)
    degree = np.bincount(row, weights=w, minlength=len(ids))[:, None].astype(number)
    edge = np.r_[np.arange(len(a)), np.arange(len(a))][order]
    side = np.where(order < len(a), 1, -1).astype(number)
    cut = np.searchsorted(row, np.arange(len(ids) + 1)).tolist()
    lines = list(zip(range(len(ids)), cut, cut[1:]))

    def times(p):
        y = degree * p
        for i, at, end in lines:
            y[i] -= w[at:end] @ p[col[at:end]]
        return y

    out = np.zeros(len(a))
    for block in range(blocks):
        bits = np.stack([_signs(src, dst, (seed * 1_000_003 + block) * words + i) for i in range(words)], axis=1).view(np.uint8)
        root = np.sqrt(w) * side
        x = np.zeros((len(ids), width), number)
        r = np.empty_like(x)
        for i, at, end in lines:
            r[i] = 2 * (root[at:end] @ np.unpackbits(bits[edge[at:end]], axis=1).astype(number)) - root[at:end].sum()
        p = r / degree
        rz = (r * p).sum(axis=0, dtype=float)
        first = np.maximum(rz, 1e-300)
        for _ in range(1000):
            active = rz > tolerance**2 * first
            if not active.any():
                break
            q = times(p)
            pq = (p * q).sum(axis=0, dtype=float)
            going = active & (pq > 1e-12 * rz)
            alpha = np.where(going, rz / np.where(going, pq, 1.0), 0.0).astype(number)
            x += alpha * p
            r -= alpha * q
            z = r / degree
            after = (r * z).sum(axis=0, dtype=float)
            p *= np.where(going, after / np.maximum(rz, 1e-300), 0.0).astype(number)
            p += z
            rz = np.where(going, after, 0.0)
        else:
            raise ArithmeticError("no solution within 1000 rounds")
        for k in range(0, len(a), 4 * step):
            some = slice(k, k + 4 * step)
            out[some] += ((x[a[some]] - x[b[some]]) ** 2).sum(axis=1, dtype=float)
    return out / (blocks * width)


def _by_parts(half: DataFrame, blocks: int, words: int, tolerance: float, kind: str, seed: int) -> DataFrame:
    """(src, dst, weight, resistance) of ``half`` (tiny, part, src, dst, weight), whose parts are whole components that fit a task."""

    def run(table: pa.Table) -> pa.Table:
        src, dst, weight = (table.column(c).to_numpy() for c in ("src", "dst", "weight"))
        found = projected_resistances(src, dst, weight, blocks, words, tolerance, kind, seed)
        return pa.table({"src": src, "dst": dst, "weight": weight, "resistance": found})

    return half.groupBy("tiny", "part").applyInArrow(run, "src long, dst long, weight double, resistance double")


def _by_blocks(half: DataFrame, blocks: int, words: int, tolerance: float, kind: str, seed: int) -> DataFrame:
    """The same of a ``half`` of any size, by products by blocks of rows: a round is a few joins."""
    names = written(ranked(Graph.mirrored(half).ids, "at", "id").select("id", "at"), "resistance-names")
    n, width = names.count(), 64 * words
    placed = half.join(names.withColumnsRenamed({"id": "src", "at": "a"}), "src").join(names.withColumnsRenamed({"id": "dst", "at": "b"}), "dst")
    half = written(placed, "resistance-half")
    lap, degree = tall.laplacian(_both(half.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")), n)
    found = None
    for block in range(blocks):
        bits = F.array(*[F.xxhash64("src", "dst", F.lit((seed * 1_000_003 + block) * words + i)) for i in range(words)])
        signs = half.select("a", "b", F.sqrt("weight").alias("root"), bits.alias("bits"))
        ends = signs.select(F.col("a").alias("id"), F.col("root").alias("weight"), "bits").unionAll(signs.select("b", -F.col("root"), "bits"))
        z = written(tall.solved(lap, degree, lap.signed(ends, words, kind), width, tolerance, kind=kind), "resistance-z")
        part = written(lap.apart(z).select("src", "dst", (-F.col("weight")).alias("weight"), (F.col("r") / (blocks * width)).alias("r")), "resistance-part")
        found = part if found is None else found.unionAll(part)
    found = found.groupBy("src", "dst").agg(F.first("weight").alias("weight"), F.sum("r").alias("resistance"))
    named = found.join(names.withColumnsRenamed({"id": "s", "at": "src"}), "src").join(names.withColumnsRenamed({"id": "d", "at": "dst"}), "dst")
    return written(named.select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight", "resistance"), "resistances")


def gumbel_top(edges: DataFrame, k: int, weight: str = "weight", seed: int = 0) -> DataFrame:
    """``k`` rows drawn without replacement with probability by weight: the largest log w - log(-log u)."""
    u = (F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 40)).cast("double") + 0.5) / (1 << 40)
    return edges.where(F.col(weight) > 0).orderBy(F.desc(F.log(F.col(weight)) - F.log(-F.log(u))), "src", "dst").limit(max(0, k))


def _both(half: DataFrame) -> DataFrame:
    return half.unionAll(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def sample_edges(edges: DataFrame, n: int, connected: bool = True, by: str = "weight", seed: int = 0) -> DataFrame:
    """About ``n`` directed edges, both directions together, with the maximum spanning forest if ``connected``."""
    half = edges.where("src < dst")
    tree = spanning_forest(Graph.from_edges(half.withColumn("weight", F.col(by))), maximise=True).select("src", "dst") if connected else half.select("src", "dst").limit(0)
    rest = half.join(tree, ["src", "dst"], "left_anti")
    taken = gumbel_top(rest, n // 2 - tree.count(), by, seed).select("src", "dst")
    return _both(half.join(tree.unionAll(taken), ["src", "dst"], "left_semi").select("src", "dst", "weight"))


def mutual_neighbours(edges: DataFrame, k: int, connected: bool = False) -> DataFrame:
    """Edges among the ``k`` heaviest of both their ends (ties to smaller ids), with the maximum spanning forest if ``connected``."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    top = edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("src", "dst", "weight")
    kept = top.join(top.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    if not connected:
        return kept
    tree = spanning_forest(Graph.from_edges(edges), maximise=True)
    return kept.unionByName(_both(tree.select("src", "dst", "weight"))).distinct()


def relaxed_tree(edges: DataFrame, gamma: float = 1.0, maximise: bool = True) -> DataFrame:
    """Relaxed spanning tree: an edge stays if its weight is within gamma (d_i + d_j) of the bottleneck of its path in the spanning tree.

    d is the distance to a node's best neighbour, on the scale of weights (of -weights for a maximum tree).
    """
    found = written(bottlenecks(Graph.from_edges(_undirected(edges)), maximise), "bottlenecks")
    both = found.select("src", "cost").unionAll(found.select("dst", "cost"))
    best = written(both.groupBy(F.col("src").alias("id")).agg(F.min("cost").alias("d"), F.count("*").alias("n")), "best-neighbours")
    row = best.agg(F.min("d"), F.sum("n")).first()
    if row[0] is None:
        return edges.select("src", "dst", "weight").limit(0)
    near = best.select("id", (F.col("d") - row[0]).alias("d"), "n")
    for end, name in (("src", "ds"), ("dst", "dd")):
        found = join_heavy(found, near.withColumnsRenamed({"id": end, "d": name}), end, "n", row[1])
    kept = found.where(F.col("cost") <= F.col("bottleneck") + gamma * (F.col("ds") + F.col("dd")) + 1e-12)
    return _both(kept.select("src", "dst", "weight"))


def sparsify(edges: DataFrame, method: str = "resistance", mean_degree: float = 4.0, gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """Edges of a patch graph thinned to about ``mean_degree``: resistance, sample, neighbors, rmst or none."""
    edges = edges.select("src", "dst", "weight")
    if method == "none":
        return edges
    if method == "rmst":
        return relaxed_tree(edges, gamma)
    if method == "neighbors":
        return mutual_neighbours(edges, max(1, int(mean_degree)), connected=True)
    n_edges, n_nodes = edges.agg(F.count("*"), F.count_distinct("src")).first()
    target = int(mean_degree * n_nodes / 2) * 2
    if target >= n_edges:
        return edges
    if method == "sample":
        return sample_edges(conductance_weights(edges), target, seed=seed)
    if method == "resistance":
        r = resistances(edges).withColumn("score", F.col("weight") * F.col("resistance"))
        return sample_edges(r, target, by="score", seed=seed)
    raise ValueError(f"unknown method {method!r}")


def hierarchical(edges: DataFrame, levels: list[DataFrame], mean_degree: float = 4.0, method: str = "sample", seed: int = 0) -> DataFrame:
    """Edges kept level by level: inside each cluster of the finest partition, then between the clusters of each coarser one."""
    kept, current = None, edges.select("src", "dst", "weight")
    for partition in [*levels, None]:
        g = Graph.from_edges(current)
        if partition is None:
            layer = sparsify(current, method, mean_degree, seed=seed)
        else:
            e = g.clustered(partition)
            layer = sparsify(e.where("cs = cd").select("src", "dst", "weight"), method, mean_degree, seed=seed)
            current = e.where("cs <> cd").select("src", "dst", "weight")
        kept = layer if kept is None else kept.unionByName(layer)
    return kept.distinct()
