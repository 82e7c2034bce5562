"""Message passing over whole graphs: two-layer encoders trained on links, as joins and grouped sums.

Node states are tall matrices (``tall.py``).  A layer is a product with the normalised adjacency (an edge
join and sums by node) and one with a small weight matrix, which goes to the tasks with the function
that applies it.  The link loss joins pairs with the states of their ends; its gradients are summed by
node, pass back through the transposed product, and each weight's gradient is a sum over all nodes of small
matrices.  The driver holds weights, Adam's moments and those sums.

``gae`` and ``vgae`` pass the symmetrically normalised adjacency with loops; ``graphsage`` keeps a node's own
state beside the mean of its neighbours'.  Weights apply to any graph with the same features, so ``encode`` also serves new nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import written
from . import tall
from .joins import ranked

KINDS = {"gae": (False, False), "vgae": (False, True), "graphsage": (True, False)}  # own state kept, variational


@dataclass
class Trained:
    kind: str
    weights: list[np.ndarray]
    history: list[float]


def passing(graph: Graph, kind: str) -> tuple[tall.Sparse, tall.Sparse]:
    """The matrix that passes messages, and its transpose."""
    edges = written(graph.undirected().edges.where("src <> dst"), "messages")
    if kind == "graphsage":
        out = edges.groupBy("src").agg(F.sum("weight").alias("s"))
        mean = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.greatest("s", F.lit(1.0))).alias("weight"))
        a = tall.Sparse.of(mean)
        return a, tall.Sparse.of(a.rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    loops = edges.unionByName(graph.ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight")))
    root = written(loops.groupBy(F.col("src").alias("id")).agg((1 / F.sqrt(F.sum("weight"))).alias("r")), "message-norms")
    both = loops.join(root.withColumnsRenamed({"id": "src", "r": "a"}), "src").join(root.withColumnsRenamed({"id": "dst", "r": "b"}), "dst")
    a = tall.Sparse.of(both.select("src", "dst", (F.col("weight") * F.col("a") * F.col("b")).alias("weight")))
    return a, a


def link_pairs(graph: Graph, times: int = 1, seed: int = 0) -> DataFrame:
    """(i, j, y): edges, and for each of them ``times`` pairs of its start and a node drawn by hash that are none."""
    edges = graph.undirected().edges.where("src < dst").select("src", "dst")
    numbered = ranked(graph.ids, "number", "id")
    n = graph.ids.count()
    drawn = edges.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("number", F.pmod(F.xxhash64("src", "dst", "turn", F.lit(seed)), F.lit(n)))
    other = drawn.join(numbered, "number").where("src <> id").select(F.least("src", "id").alias("src"), F.greatest("src", "id").alias("dst"))
    none = other.join(edges, ["src", "dst"], "left_anti")
    return edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("y")).unionAll(none.select("src", "dst", F.lit(0.0)))


def _stacked(own: DataFrame | None, near: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, v) of all nodes: ``near``'s rows behind ``own``'s, zeros where a node gets no message."""
    zero = F.array(*[F.lit(0.0)] * width)
    left = own if own is not None else ids
    out = left.join(near.withColumnRenamed("v", "w"), "id", "left").withColumn("w", F.coalesce("w", zero))
    return out.select("id", (F.concat("v", "w") if own is not None else F.col("w")).alias("v"))


def _hidden(base: DataFrame, w: np.ndarray) -> DataFrame:
    return tall.each(base, lambda b: np.maximum(b @ w, 0), "v")


def encode(trained: Trained, graph: Graph, features: DataFrame) -> DataFrame:
    """(node_id, coord) of a graph, the one that was trained on or another."""
    own = KINDS[trained.kind][0]
    a, _ = passing(graph, trained.kind)
    x = features.select("id", F.col("x").alias("v"))
    w1, w2 = trained.weights[:2]
    base = written(_stacked(x if own else None, a.times(x), graph.ids, w1.shape[0] // (1 + own)), "message-base")
    h = written(_hidden(base, w1), "message-hidden")
    m = _stacked(h if own else None, a.times(h), graph.ids, w1.shape[1])
    return tall.each(m, lambda v: v @ w2, "v").select(F.col("id").alias("node_id"), F.col("v").alias("coord"))


def train(graph: Graph, features: DataFrame, dim: int, kind: str = "gae", hidden: int = 32, epochs: int = 50, rate: float = 0.01, patience: int = 20, pairs: DataFrame | None = None, seed: int = 0) -> Trained:
    """Weights after up to ``epochs`` steps of Adam on the mean cross entropy of links (``features``: id, x)."""
    own, variational = KINDS[kind]
    a, back = passing(graph, kind)
    ids = graph.ids
    x = features.select("id", F.col("x").alias("v"))
    width = len(x.first()["v"])
    base = written(_stacked(x if own else None, a.times(x), ids, width), "message-base")
    pairs = written(pairs if pairs is not None else link_pairs(graph, seed=seed), "message-pairs")
    n_pairs, n = max(pairs.count(), 1), ids.count()
    rng = np.random.default_rng(seed)
    glorot = lambda r, c: rng.uniform(-1, 1, (r, c)) * np.sqrt(6 / (r + c))
    scale = 1 + own
    weights = [glorot(scale * width, hidden), glorot(scale * hidden, dim)] + ([glorot(scale * hidden, dim)] if variational else [])
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    best, kept, idle, history = np.inf, weights, 0, []
    for epoch in range(1, epochs + 1):
        w1, w2, *w3 = weights
        h = written(_hidden(base, w1), "message-hidden")
        m = written(_stacked(h if own else None, a.times(h), ids, hidden), "message-states")
        if variational:
            noise = tall.normal(ids, dim, seed * 1_000_003 + epoch).withColumnRenamed("v", "e")
            m = written(m.join(noise, "id"), "message-noise")
            z = tall.each(m, lambda v, e: v @ w2 + np.exp(v @ w3[0]) * e, "v", "e")
        else:
            z = tall.each(m, lambda v: v @ w2, "v")
        z = written(z, "message-z")
        ends = pairs.join(z.withColumnsRenamed({"id": "i", "v": "a"}), "i").join(z.withColumnsRenamed({"id": "j", "v": "b"}), "j")

        def links(a_, b_, y):
            s = (a_ * b_).sum(axis=1)
            g = (1 / (1 + np.exp(-s)) - y)[:, None] / n_pairs
            loss = (np.maximum(s, 0) - s * y + np.log1p(np.exp(-np.abs(s))))[:, None] / n_pairs
            return np.hstack([g * b_, loss]), np.hstack([g * a_, 0 * loss])

        # The loss rides along as one more column of the gradient.
        made = tall.each(ends, links, "a", "b", "y", keep=("i", "j"), out=("gi", "gj"))
        parts = made.select(F.explode(F.array(F.struct(F.col("i").alias("src"), F.col("gi").alias("v")), F.struct(F.col("j").alias("src"), F.col("gj").alias("v")))).alias("e"))
        dz = tall.summed(parts.select("e.src", F.lit(1.0).alias("weight"), "e.v")).withColumnRenamed("v", "g")
        both = m.join(dz, "id", "left").withColumn("g", F.coalesce("g", F.array(*[F.lit(0.0)] * (dim + 1))))
        both = written(both, "message-gradients")

        def heads(v, g, e=None):
            """Gradients of what each of the second layer's weights gives, and the loss of the rows."""
            dz_, loss = g[:, :-1], g[:, -1].sum()
            if e is None:
                return [dz_], loss
            mu, logs = v @ w2, v @ w3[0]
            loss += 0.5 / n / n * (mu**2 + np.exp(2 * logs) - 2 * logs).sum()
            return [dz_ + mu / n / n, dz_ * e * np.exp(logs) + (np.exp(2 * logs) - 1) / n / n], loss

        columns = ["v", "g", "e"] if variational else ["v", "g"]
        seconds = weights[1:]

        def second(*c):
            grads, loss = heads(*c)
            return np.concatenate([*[(c[0].T @ d).ravel() for d in grads], [loss]])

        got = tall.total(both, second, (sum(w.size for w in seconds) + 1,), *columns)
        loss = float(got[-1])
        history.append(loss)
        if loss < best - 1e-7:
            best, kept, idle = loss, weights, 0
        else:
            idle += 1
            if idle > patience:
                break
        down = tall.each(both, lambda *c: sum(d @ w.T for d, w in zip(heads(*c)[0], seconds)), *columns)
        if own:
            down = written(down, "message-down")
            passed = back.times(tall.each(down, lambda v: v[:, hidden:], "v"))
            dh = _stacked(tall.each(down, lambda v: v[:, :hidden], "v"), passed, ids, hidden)
            dh = tall.each(dh, lambda v: v[:, :hidden] + v[:, hidden:], "v")
        else:
            dh = back.times(down)
        first = tall.total(base.join(dh.withColumnRenamed("v", "g"), "id"), lambda v, g: v.T @ (g * (v @ w1 > 0)), w1.shape, "v", "g")
        grads, at = [first], 0
        for w in seconds:
            grads.append(got[at : at + w.size].reshape(w.shape))
            at += w.size
        moments = [(0.9 * p + 0.1 * g, 0.999 * q + 0.001 * g**2) for (p, q), g in zip(moments, grads)]
        weights = [w - rate * (p / (1 - 0.9**epoch)) / (np.sqrt(q / (1 - 0.999**epoch)) + 1e-8) for w, (p, q) in zip(weights, moments)]
    return Trained(kind, kept, history)
