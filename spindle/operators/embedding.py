"""Node embeddings of patches.

A model is a function of a dense adjacency, features and a seed, run in numpy inside
``applyInPandas`` on one patch at a time: patches are of bounded size, and all train at once on
the cluster.  Gradients come from a small reverse-mode tape.  ``patched`` embeds all patches
and aligns them into one embedding.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import written

MAX_PATCH = 20_000
#: svd takes the whole dense matrix of patches of up to so many nodes; larger ones are products by joins.
DENSE_PATCH = 2000


# ---------------------------------------------------------------- tape


class Var:
    """A matrix with its gradient."""

    def __init__(self, value, parents=()):
        self.value, self.parents, self.grad = np.asarray(value, float), parents, None

    def backward(self) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack += [(p, False) for p, _ in node.parents]
        for node in order:
            node.grad = np.zeros_like(node.value)
        self.grad = np.ones_like(self.value)
        for node in reversed(order):
            for parent, pull in node.parents:
                parent.grad += pull(node.grad)

    def __add__(self, o: Var) -> Var:
        fit = lambda g, like: g if g.shape == like.shape else g.sum(axis=0, keepdims=True).reshape(like.shape)
        return Var(self.value + o.value, ((self, lambda g: fit(g, self.value)), (o, lambda g: fit(g, o.value))))

    def __mul__(self, c) -> Var:
        if isinstance(c, Var):
            return Var(self.value * c.value, ((self, lambda g: g * c.value), (c, lambda g: g * self.value)))
        return Var(self.value * c, ((self, lambda g: g * c),))

    def __matmul__(self, o: Var) -> Var:
        return Var(self.value @ o.value, ((self, lambda g: g @ o.value.T), (o, lambda g: self.value.T @ g)))

    def under(self, a: np.ndarray) -> Var:
        """A constant matrix times this."""
        return Var(a @ self.value, ((self, lambda g: a.T @ g),))

    def relu(self) -> Var:
        return Var(np.maximum(self.value, 0), ((self, lambda g: g * (self.value > 0)),))

    def exp(self) -> Var:
        e = np.exp(np.clip(self.value, -30, 30))
        return Var(e, ((self, lambda g: g * e),))

    def rows(self, i: np.ndarray) -> Var:
        def pull(g):
            out = np.zeros_like(self.value)
            np.add.at(out, i, g)
            return out

        return Var(self.value[i], ((self, pull),))

    def total(self) -> Var:
        return Var(self.value.sum(), ((self, lambda g: np.full_like(self.value, float(g))),))

    def row_sums(self) -> Var:
        return Var(self.value.sum(axis=1, keepdims=True), ((self, lambda g: np.broadcast_to(g, self.value.shape).copy()),))

    def mean_row(self) -> Var:
        n = max(len(self.value), 1)
        return Var(self.value.mean(axis=0, keepdims=True), ((self, lambda g: np.broadcast_to(g / n, self.value.shape).copy()),))

    def sigmoid(self) -> Var:
        s = 1 / (1 + np.exp(-np.clip(self.value, -30, 30)))
        return Var(s, ((self, lambda g: g * s * (1 - s)),))

    def bce(self, y: np.ndarray) -> Var:
        """Mean cross entropy of logits."""
        x = self.value
        loss = np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x)))
        return Var(loss.mean(), ((self, lambda g: g * (1 / (1 + np.exp(-np.clip(x, -30, 30))) - y) / max(x.size, 1)),))

    def softmax_over(self, mask: np.ndarray) -> Var:
        """Row softmax over the places of ``mask``."""
        x = np.where(mask, self.value, -np.inf)
        e = np.exp(x - np.where(mask.any(axis=1), x.max(axis=1), 0)[:, None])
        s = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-300)
        return Var(s, ((self, lambda g: np.where(mask, s * (g - (g * s).sum(axis=1, keepdims=True)), 0.0)),))

    def transposed(self) -> Var:
        return Var(self.value.T, ((self, lambda g: g.T),))

    def leaky(self, slope: float = 0.2) -> Var:
        return Var(np.where(self.value > 0, self.value, slope * self.value), ((self, lambda g: np.where(self.value > 0, g, slope * g)),))


def adam(params: list[Var], loss_of: Callable[[], Var], epochs: int, rate: float, patience: int) -> list[float]:
    """Loss history; stops after ``patience`` epochs without a better loss and keeps the best state."""
    m = [np.zeros_like(p.value) for p in params]
    v = [np.zeros_like(p.value) for p in params]
    history, best, kept, idle = [], np.inf, [p.value.copy() for p in params], 0
    for t in range(1, epochs + 1):
        loss = loss_of()
        history.append(float(loss.value))
        if loss.value < best - 1e-7:
            best, kept, idle = float(loss.value), [p.value.copy() for p in params], 0
        else:
            idle += 1
            if idle > patience:
                break
        loss.backward()
        for k, p in enumerate(params):
            m[k] = 0.9 * m[k] + 0.1 * p.grad
            v[k] = 0.999 * v[k] + 0.001 * p.grad**2
            p.value = p.value - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    for p, x in zip(params, kept):
        p.value = x
    return history


# ---------------------------------------------------------------- models


def gcn_norm(a: np.ndarray) -> np.ndarray:
    a = a + np.eye(len(a))
    d = 1 / np.sqrt(np.maximum(a.sum(axis=1), 1e-12))
    return a * d[:, None] * d[None]


def _glorot(rng, n, m) -> Var:
    return Var(rng.uniform(-1, 1, (n, m)) * np.sqrt(6 / (n + m)))


def _pairs(a: np.ndarray, rng, times: int = 1):
    """Edges and as many random pairs that are none (where there are any)."""
    i, j = np.nonzero(np.triu(a > 0, 1))
    n = len(a)
    u, w = rng.integers(0, n, times * max(len(i), 1)), rng.integers(0, n, times * max(len(i), 1))
    ok = (a[u, w] == 0) & (u != w)
    return np.r_[i, u[ok]], np.r_[j, w[ok]], np.r_[np.ones(len(i)), np.zeros(int(ok.sum()))][:, None]


def _link_loss(z: Var, a, rng, times: int = 1) -> Var:
    i, j, y = _pairs(a, rng, times)
    return (z.rows(i) * z.rows(j)).row_sums().bce(y)


def svd(a, x, dim, seed, matrix: str = "adjacency", **_):
    n = len(a)
    deg = a.sum(axis=1)
    if matrix == "laplacian":
        m = np.diag(deg) - a
    elif matrix == "normalized_laplacian":
        d = 1 / np.sqrt(np.maximum(deg, 1e-12)) * (deg > 0)
        m = np.eye(n) - a * d[:, None] * d[None]
    else:
        m = a
    u, s, _ = np.linalg.svd(m)
    z = u[:, :dim] * (np.sqrt(s[:dim]) if matrix == "adjacency" else 1.0)
    big = np.abs(z).argmax(axis=0)
    z = z * np.where(z[big, np.arange(z.shape[1])] < 0, -1.0, 1.0)  # one sign, on every run
    return np.pad(z, ((0, 0), (0, dim - z.shape[1]))), []


def gae(a, x, dim, seed, hidden=32, epochs=200, rate=0.01, patience=20, variational=False, **_):
    rng = np.random.default_rng(seed)
    s = gcn_norm(a)
    w1, w2, w3 = _glorot(rng, x.shape[1], hidden), _glorot(rng, hidden, dim), _glorot(rng, hidden, dim)
    base = Var(s @ x)
    n = len(a)

    def encode():
        h = (base @ w1).relu().under(s)
        return h @ w2, h @ w3

    def loss():
        mu, logs = encode()
        if not variational:
            return _link_loss(mu, a, rng)
        z = mu + logs.exp() * rng.standard_normal(mu.value.shape)
        kl = (mu * mu + (logs * 2.0).exp() + logs * -2.0).total() * (0.5 / n / n)
        return _link_loss(z, a, rng) + kl

    history = adam([w1, w2, w3] if variational else [w1, w2], loss, epochs, rate, patience)
    return encode()[0].value, history


def vgae(a, x, dim, seed, **o):
    return gae(a, x, dim, seed, **(o | {"variational": True}))


def graphsage(a, x, dim, seed, hidden=32, epochs=200, rate=0.01, patience=20, **_):
    rng = np.random.default_rng(seed)
    mean = a / np.maximum(a.sum(axis=1, keepdims=True), 1)
    w = [_glorot(rng, x.shape[1], hidden), _glorot(rng, x.shape[1], hidden), _glorot(rng, hidden, dim), _glorot(rng, hidden, dim)]
    x0, near = Var(x), Var(mean @ x)

    def encode():
        h = (x0 @ w[0] + near @ w[1]).relu()
        return h @ w[2] + h.under(mean) @ w[3]

    history = adam(w, lambda: _link_loss(encode(), a, rng), epochs, rate, patience)
    return encode().value, history


def dgi(a, x, dim, seed, epochs=200, rate=0.01, patience=20, **_):
    rng = np.random.default_rng(seed)
    s = gcn_norm(a)
    w, disc = _glorot(rng, x.shape[1], dim), _glorot(rng, dim, dim)
    y = np.r_[np.ones(len(a)), np.zeros(len(a))][:, None]

    def loss():
        real, fake = (Var(s @ x) @ w).leaky(), (Var(s @ x[rng.permutation(len(x))]) @ w).leaky()
        summary = (disc @ real.mean_row().sigmoid().transposed())
        left, right = real @ summary, fake @ summary
        both = Var(np.vstack([left.value, right.value]), ((left, lambda g: g[: len(a)]), (right, lambda g: g[len(a) :])))
        return both.bce(y)

    history = adam([w, disc], loss, epochs, rate, patience)
    return (Var(s @ x) @ w).leaky().value, history


def gin(a, x, dim, seed, hidden=32, epochs=200, rate=0.01, patience=20, **_):
    rng = np.random.default_rng(seed)
    s = a + np.eye(len(a))
    s = s / np.maximum(np.abs(s).sum(axis=1).max(), 1)  # in place of batch normalisation
    w = [_glorot(rng, x.shape[1], hidden), _glorot(rng, hidden, hidden), _glorot(rng, hidden, hidden), _glorot(rng, hidden, dim)]
    base = Var(s @ x)

    def encode():
        h = ((base @ w[0]).relu() @ w[1]).relu().under(s)
        return (h @ w[2]).relu() @ w[3]

    history = adam(w, lambda: _link_loss(encode(), a, rng), epochs, rate, patience)
    return encode().value, history


def gat(a, x, dim, seed, hidden=16, heads=2, epochs=100, rate=0.01, patience=20, **_):
    """Attention heads averaged; features are one-hot degrees (up to 100), five negatives an edge."""
    rng = np.random.default_rng(seed)
    degree = np.minimum((a > 0).sum(axis=1), 100)
    x = np.eye(101)[degree]
    mask = (a > 0) | np.eye(len(a), dtype=bool)
    ones = Var(np.ones((1, len(a))))
    layers = [[(_glorot(rng, n, m), _glorot(rng, m, 1), _glorot(rng, m, 1)) for _ in range(heads)] for n, m in ((101, hidden), (hidden, dim))]

    def layer(h, weights):
        out = None
        for w, left, right in weights:
            z = h @ w
            score = ((z @ left) @ ones + ((z @ right) @ ones).transposed()).leaky()
            one = (score.softmax_over(mask) @ z) * (1 / heads)
            out = one if out is None else out + one
        return out

    def encode():
        return layer(layer(Var(x), layers[0]).relu(), layers[1])

    params = [p for group in layers for ws in group for p in ws]
    history = adam(params, lambda: _link_loss(encode(), a, rng, 5), epochs, rate, patience)
    return encode().value, history


MODELS: dict[str, Callable] = {"svd": svd, "gae": gae, "vgae": vgae, "graphsage": graphsage, "dgi": dgi, "gin": gin, "gat": gat}
ALIASES = {"graph_autoencoder": "gae", "sage": "graphsage", "graph_sage": "graphsage", "deep_graph_infomax": "dgi", "infomax": "dgi", "graph_isomorphism_network": "gin"}


def register_model(name: str, f: Callable) -> None:
    MODELS[name] = f


def model(name: str) -> Callable:
    return MODELS[ALIASES.get(name, name)]


# ---------------------------------------------------------------- patches


def embed_patches(graph: Graph, members: DataFrame, dim: int, method: str = "svd", seed: int = 0, features: DataFrame | None = None, **options) -> DataFrame:
    """(patch_id, node_id, coord): each patch's induced subgraph embedded on its own.

    ``features`` (id, x); without them each node has its own indicator.  A patch is one task's
    work and must stay below ``MAX_PATCH`` nodes.  For svd, patches of over ``DENSE_PATCH`` nodes
    are the blocks of one sparse matrix and may be of any size.
    """
    m = members.select("patch_id", "node_id").distinct()
    if model(method) is svd:
        m = written(m, "patch-members")
        large = sorted(r[0] for r in m.groupBy("patch_id").count().where(F.col("count") > DENSE_PATCH).collect())
        if large:
            wide = F.col("patch_id").isin(large)
            found = _svd_of_blocks(graph, m.where(wide), large, dim, seed, **options)
            return found.unionByName(_embed_in_tasks(graph, m.where(~wide), dim, method, seed, features, **options))
    return _embed_in_tasks(graph, m, dim, method, seed, features, **options)


def _svd_of_blocks(graph: Graph, m: DataFrame, patches: list[int], dim: int, seed: int, matrix: str = "adjacency", **_) -> DataFrame:
    """``embed_patches`` by svd for patches of any size: the blocks of a matrix over (patch, node), all at once."""
    from . import tall
    from .joins import ranked

    number = F.create_map(*[F.lit(x) for pair in enumerate(patches) for x in (pair[1], pair[0])])[F.col("patch_id")].cast("long")
    m = written(ranked(m, "at", "patch_id", "node_id").select("patch_id", "node_id", (F.shiftleft(number, tall.BLOCK_BITS) + F.col("at")).alias("id")), "patch-rows")
    inner = graph.edges.where("src <> dst").join(m.select("patch_id", F.col("node_id").alias("src"), F.col("id").alias("a")), "src").join(m.select("patch_id", F.col("node_id").alias("dst"), F.col("id").alias("b")), ["patch_id", "dst"])
    blocks = Graph.from_edges(inner.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), m.select("id"))
    edges = _svd_matrix(Graph(written(blocks.undirected().edges, "svd-edges"), blocks.nodes), matrix)
    u, values = tall.singular_vectors_of_blocks(tall.Sparse.of(edges), m.select("id"), dim, seed=seed)
    if matrix == "adjacency":
        scale = {block: np.diag(np.sqrt(v)) for block, v in values.items()}
        none = np.zeros((dim, dim))
        u = tall._turned(u, {block: scale.get(block, none) for block in range(len(patches))})
    return m.join(u, "id").select(F.col("patch_id").cast("int").alias("patch_id"), "node_id", F.col("v").alias("coord"))


def _embed_in_tasks(graph: Graph, m: DataFrame, dim: int, method: str, seed: int, features: DataFrame | None = None, **options) -> DataFrame:
    """(patch_id, node_id, coord) of patches (patch_id, node_id), each in one task."""
    inner = graph.edges.join(m.select("patch_id", F.col("node_id").alias("src")), "src").join(m.select("patch_id", F.col("node_id").alias("dst")), ["patch_id", "dst"])
    rows = m.select("patch_id", F.col("node_id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("weight"))
    if features is not None:
        rows = rows.join(features.select(F.col("id").alias("src"), "x"), "src", "left")
    else:
        rows = rows.withColumn("x", F.lit(None).cast("array<double>"))
    both = rows.select("patch_id", "src", "dst", "weight", "x").unionAll(inner.select("patch_id", "src", "dst", "weight", F.lit(None).cast("array<double>")))
    f = model(method)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf.dst.isna()].sort_values("src")
        ids = nodes.src.to_numpy()
        if len(ids) > MAX_PATCH:
            raise ValueError("a patch is too large")
        edges = pdf[pdf.dst.notna()]
        a = np.zeros((len(ids), len(ids)))
        i, j = np.searchsorted(ids, edges.src.to_numpy()), np.searchsorted(ids, edges.dst.to_numpy().astype(np.int64))
        a[i, j] = edges.weight.to_numpy()
        a = np.maximum(a, a.T)
        np.fill_diagonal(a, 0)
        x = np.eye(len(ids)) if nodes.x.isna().any() else np.stack(nodes.x.to_numpy())
        z, _ = f(a, x, dim, seed, **options)
        return pd.DataFrame({"patch_id": int(pdf.patch_id.iloc[0]), "node_id": ids, "coord": list(z)})

    return both.groupBy("patch_id").applyInPandas(run, "patch_id int, node_id long, coord array<double>")


def patched(graph: Graph, members: DataFrame, dim: int, method: str = "svd", aligner: str = "l2g", least: int | None = None, seed: int = 0, **options) -> DataFrame:
    """(node_id, coord): patches embedded, aligned and recombined."""
    from .align import ALIGNERS

    coords = written(embed_patches(graph, members, dim, method, seed, **options), "patch-embedding")
    return ALIGNERS[aligner](coords, least=least or dim + 1)


def _svd_matrix(graph: Graph, matrix: str) -> DataFrame:
    """(src, dst, weight) of the matrix named, of an undirected graph without loops that holds both directions."""
    edges = graph.edges
    if matrix != "adjacency":
        degree = graph.ids.join(edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d"))
        degree = written(degree, "svd-degrees")
        off, own = (-F.col("weight")).alias("weight"), F.col("d")
        if matrix == "normalized_laplacian":
            root = degree.select("id", F.sqrt("d").alias("root"))
            edges = edges.join(root.withColumnsRenamed({"id": "src", "root": "a"}), "src").join(root.withColumnsRenamed({"id": "dst", "root": "b"}), "dst")
            off, own = (-F.col("weight") / F.col("a") / F.col("b")).alias("weight"), F.lit(1.0)
        edges = edges.select("src", "dst", off).unionByName(degree.select(F.col("id").alias("src"), F.col("id").alias("dst"), own.alias("weight")))
    return edges


def svd_embedding(graph: Graph, dim: int, seed: int = 0, matrix: str = "adjacency", tolerance: float = 1e-3, rounds: int = 40) -> DataFrame:
    """(node_id, coord): leading left singular vectors of the whole graph's matrix (adjacency, laplacian or normalized_laplacian).

    Those of the adjacency are scaled by the roots of their singular values.  The graph is taken as
    undirected, without loops.  Edge joins and small Gram matrices only, so the graph may be of any size.
    """
    from . import tall

    edges = _svd_matrix(Graph(written(graph.undirected().edges.where("src <> dst"), "svd-edges"), graph.nodes), matrix)
    u, values = tall.singular_vectors(tall.Sparse.of(edges), graph.ids, dim, tolerance=tolerance, rounds=rounds, seed=seed)
    scale = np.sqrt(values) if matrix == "adjacency" else np.ones(dim)
    return tall.each(u, lambda v: v * scale, "v").select(F.col("id").alias("node_id"), F.col("v").alias("coord"))


def full_graph(graph: Graph, dim: int, method: str = "svd", seed: int = 0, **options) -> DataFrame:
    """(node_id, coord) of the whole graph: svd, gae, vgae and graphsage as joins; dgi, gin and gat hold it in one task.

    ``features`` (id, x); without them gae, vgae and graphsage take 16 normal numbers of each node.
    """
    from . import messages, tall

    if ALIASES.get(method, method) == "svd":
        return svd_embedding(graph, dim, seed, **options)
    if ALIASES.get(method, method) in messages.KINDS:
        features = options.pop("features", None)
        if features is None:
            features = tall.normal(graph.ids, 16, seed).withColumnRenamed("v", "x")
        return messages.encode(messages.train(graph, features, dim, ALIASES.get(method, method), seed=seed, **options), graph, features)
    members = graph.ids.select(F.lit(0).alias("patch_id"), F.col("id").alias("node_id"))
    return embed_patches(graph, members, dim, method, seed, **options).select("node_id", "coord")


def hierarchical(graph: Graph, dim: int, leaf: int, branching: int = 2, method: str = "svd", seed: int = 0, overlap: int | None = None, **options) -> DataFrame:
    """Leaves of at most about ``leaf`` nodes, overlapping along the parts' graph, embedded and moved onto one another in order of overlap."""
    from . import align, clustering, patching

    part = written(clustering.hierarchical(graph, leaf, branching), "tree")
    wide = overlap or 2 * (dim + 1)
    members = written(patching.expand(graph, part, patching.connectivity(graph, part), wide, 2 * wide), "tree-patches")
    coords = written(embed_patches(graph, members, dim, method, seed, **options), "tree-embedding")
    return align.recombined(align.procrustes_sequential(coords, dim + 1))


def embed(graph: Graph, config: dict) -> DataFrame:
    """Dispatch of {"mode": full_graph | patched | hierarchical, "dim": ..., "method": ..., ...}."""
    from . import clustering, patching

    config = dict(config)
    mode, dim = config.pop("mode"), config.pop("dim")
    if mode == "full_graph":
        return full_graph(graph, dim, **config)
    if mode == "hierarchical":
        return hierarchical(graph, dim, **config)
    if mode == "patched":
        k = config.pop("num_patches", 4)
        part = clustering.run_clustering(graph, k, config.pop("clustering", "fennel"))
        members, _ = patching.create_patches(graph, part, config.pop("min_overlap", 2 * (dim + 1)), config.pop("target_overlap", 4 * (dim + 1)))
        return patched(graph, members, dim, **config)
    raise ValueError(f"unknown mode {mode!r}")
