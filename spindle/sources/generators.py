"""Synthetic points, patches and random graphs. Draws come from hashes, so reruns agree."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def uniform(*columns, seed: int = 0):
    return (F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def clusters(spark: SparkSession, n_clusters: int = 5, size: int = 128, dim: int = 2, scale: float = 1.0, std: float = 0.2, seed: int = 0) -> DataFrame:
    """(node_id, cluster, coord): Gaussian clusters around points on a circle (a sphere for dim > 2)."""
    rng = np.random.default_rng(seed)
    if dim == 2:
        angle = 2 * np.pi * np.arange(n_clusters) / n_clusters
        centres = scale * np.c_[np.cos(angle), np.sin(angle)]
    else:
        centres = rng.standard_normal((n_clusters, dim))
        centres *= scale / np.linalg.norm(centres, axis=1, keepdims=True)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    base = spark.range(n_clusters * size).select(F.col("id").alias("node_id"), F.floor(F.col("id") / size).cast("int").alias("cluster"))
    noise = F.array(*[F.sqrt(-2 * F.log(uniform("node_id", seed=seed * 64 + 2 * k))) * F.cos(2 * np.pi * uniform("node_id", seed=seed * 64 + 2 * k + 1)) for k in range(dim)])
    return base.select("node_id", "cluster", F.zip_with(F.element_at(table, F.col("cluster") + 1), noise, lambda c, z: c + std * z).alias("coord"))


def random_orthogonal(dim: int, seed: int = 0) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    q = q * np.sign(np.diag(r))
    if np.linalg.det(q) < 0:
        q[:, 0] = -q[:, 0]
    return q


def transformed(members: DataFrame, dim: int, noise: float = 0.0, shift: float = 10.0, scale: tuple[float, float] = (0.01, 100.0), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, transforms): each patch scaled (log-uniformly), turned and moved; patch 0 stays."""
    from ..operators.align import rotated, scaled, translated

    ids = sorted(r[0] for r in members.select("patch_id").distinct().collect())
    rng = np.random.default_rng(seed)
    rows = []
    for p in ids:
        s, r, t = float(np.exp(rng.uniform(np.log(scale[0]), np.log(scale[1])))), random_orthogonal(dim, seed * 1000 + p), rng.normal(0, shift, dim)
        rows.append((p, 1.0, np.eye(dim).tolist(), [0.0] * dim) if p == ids[0] else (p, s, r.tolist(), t.tolist()))
    t = members.sparkSession.createDataFrame(rows, "patch_id int, scale double, rotation array<array<double>>, shift array<double>")
    if noise:
        z = F.array(*[noise * F.sqrt(-2 * F.log(uniform("patch_id", "node_id", seed=seed + 2 * k + 7))) * F.cos(2 * np.pi * uniform("patch_id", "node_id", seed=seed + 2 * k + 8)) for k in range(dim)])
        members = members.withColumn("coord", F.zip_with("coord", z, lambda a, b: a + b))
    out = translated(rotated(scaled(members, t.select("patch_id", "scale")), t.select("patch_id", "rotation")), t.select("patch_id", "shift"))
    return out, t


# ---- random graphs with overlapping communities; memberships are (node_id, community[, strength])


def memberships(spark: SparkSession, n: int, communities: int, p: float = 0.3, strength: str = "binary", seed: int = 0) -> DataFrame:
    """Each node joins its own community (id modulo the number) and others with probability ``p``."""
    pairs = spark.range(n).select(F.col("id").alias("node_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(communities - 1).cast("long"))).alias("community"))
    kept = pairs.where((F.col("node_id") % communities == F.col("community")) | (uniform("node_id", "community", seed=seed) < p))
    u = uniform("node_id", "community", seed=seed + 1)
    s = {"binary": F.lit(1.0), "uniform": u, "beta": F.sqrt(u), "exponential": F.least(-F.log(u) / 2, F.lit(1.0))}[strength]
    return kept.withColumn("strength", s)


def community_sizes(n: int, communities: int, how: str = "uniform", seed: int = 0) -> list[int]:
    """Sizes that sum to n: uniform, poisson, power_law or bernoulli (each node picks one)."""
    rng = np.random.default_rng(seed)
    if how == "bernoulli":
        return rng.multinomial(n, np.full(communities, 1 / communities)).tolist()
    raw = {"uniform": np.ones(communities), "poisson": rng.poisson(n / communities, communities) + 1.0, "power_law": (np.arange(communities) + 1.0) ** -1.5}[how]
    edges = np.round(np.cumsum(raw) / raw.sum() * n).astype(int)
    return np.diff(np.r_[0, edges]).tolist()


def sized_memberships(spark: SparkSession, sizes: list[int], overlap: float = 0.1, seed: int = 0) -> DataFrame:
    """(node_id, community, strength): planted communities of given sizes; with odds ``overlap`` a node joins the next one too, at half strength."""
    ends = np.cumsum(sizes)
    table = F.array(*[F.lit(int(e)) for e in ends])
    own = F.size(F.filter(table, lambda e: e <= F.col("id")))
    base = spark.range(int(ends[-1])).select(F.col("id").alias("node_id"), own.cast("long").alias("community"))
    more = base.where(uniform("node_id", seed=seed) < overlap).select("node_id", F.pmod(F.col("community") + 1, F.lit(len(sizes))).alias("community"), F.lit(0.5).alias("strength"))
    return base.withColumn("strength", F.lit(1.0)).unionByName(more).dropDuplicates(["node_id", "community"])


def grown_memberships(spark: SparkSession, n: int, communities: int, joins: int = 2, seed: int = 0) -> DataFrame:
    """Grown by preference: a node's j-th choice copies the community of an earlier node (with odds 0.8), else picks any.

    A node copies a node of at most half its number, so chains of copies are resolved in log2(n) rounds of joins.
    """
    from ..session import written

    picks = spark.range(n).select(F.col("id").alias("node_id"), F.explode(F.sequence(F.lit(0), F.lit(joins - 1))).alias("j"))
    free = (F.col("node_id") < communities) | (uniform("node_id", "j", seed=seed) >= 0.8)
    own = F.floor(uniform("node_id", "j", seed=seed + 1) * communities).cast("long")
    earlier = F.floor(uniform("node_id", "j", seed=seed + 2) * (F.col("node_id") + 1) / 2).cast("long")
    state = written(picks.select("node_id", "j", F.when(free, own).alias("community"), F.when(~free, earlier).alias("of")), "grown")
    while state.where("community is null").limit(1).count():
        known = state.select(F.col("node_id").alias("of"), "j", F.col("community").alias("c2"), F.col("of").alias("of2"))
        step = state.where("community is null").join(known, ["of", "j"]).select("node_id", "j", F.col("c2").alias("community"), F.col("of2").alias("of"))
        state = written(state.where("community is not null").unionByName(step), "grown")
    return state.select("node_id", "community").distinct().withColumn("strength", F.lit(1.0))


def roc_probabilities(members: DataFrame, nodes: DataFrame, p_in: float, p_out: float) -> DataFrame:
    """(a, b, p): pairs that share a community have ``p_in``. All other pairs have ``p_out``, which ``drawn`` takes as its background."""
    if not 0 <= p_out <= p_in <= 1:
        raise ValueError("0 <= p_out <= p_in <= 1 is needed")
    return community_pairs(members).select("a", "b").distinct().withColumn("p", F.lit(p_in))


def roc_memberships(spark: SparkSession, n: int, communities: int, double: float = 0.3, seed: int = 0) -> DataFrame:
    """Each node is in one random community, with odds ``double`` in another one too."""
    first = F.floor(uniform("id", seed=seed) * communities).cast("long")
    other = F.pmod(first + 1 + F.floor(uniform("id", seed=seed + 1) * (communities - 1)).cast("long"), F.lit(communities))
    both = F.when(uniform("id", seed=seed + 2) < double, F.array(first, other)).otherwise(F.array(first))
    return spark.range(n).select(F.col("id").alias("node_id"), F.explode(both).alias("community")).withColumn("strength", F.lit(1.0))


def community_embeddings(members: DataFrame, communities: int, dim: int = 2, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(node_id, coord): around its community's place on a circle; a node of several lies at their mean."""
    angle = 2 * np.pi * F.col("community") / communities
    place = F.array(F.cos(angle), F.sin(angle), *[F.lit(0.0)] * (dim - 2))
    each = members.select("node_id", F.posexplode(place).alias("p", "v")).groupBy("node_id", "p").agg(F.avg("v").alias("v"))
    z = F.sqrt(-2 * F.log(uniform("node_id", "p", seed=seed))) * F.cos(2 * np.pi * uniform("node_id", "p", seed=seed + 1))
    out = each.withColumn("v", F.col("v") + noise * z) if noise else each
    return out.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias("coord"))


def standard_suite(spark: SparkSession, seed: int = 0) -> dict[str, Graph]:
    """Three test graphs: agm of 150 nodes and 6 communities, osbm of 120 and 5, roc of 200 and 8."""
    m = {"agm": memberships(spark, 150, 6, seed=seed), "osbm": memberships(spark, 120, 5, seed=seed), "roc": roc_memberships(spark, 200, 8, seed=seed)}
    mixing = spark.range(25).select(F.floor(F.col("id") / 5).alias("c"), (F.col("id") % 5).alias("d")).withColumn("p", F.when(F.col("c") == F.col("d"), 0.4).otherwise(0.05))
    p = {"agm": agm_probabilities(m["agm"], 0.3), "osbm": osbm_probabilities(m["osbm"], mixing), "roc": roc_probabilities(m["roc"], m["roc"], 0.3, 0.02)}
    return {k: drawn(p[k], m[k].select("node_id").distinct(), 0.02 if k != "osbm" else 0.0, seed) for k in m}


#: About so many pairs come to a task.
PAIRS = 250_000


def community_pairs(members: DataFrame) -> DataFrame:
    """Pairs a < b with each community they share: an equi-join on the community.

    The members of a community are few bytes beside its pairs, so tasks are sized by pairs; a pair's rows come to one task by
    ``a`` and ``b``, so that what is summed by both needs no further exchange.
    """
    sizes = members.groupBy("community").agg(F.count("*").cast("double").alias("n"))
    parts = max(1, math.ceil((sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0) / PAIRS))
    rows = members.repartition(parts, "community")
    a, b = rows.select("community", F.col("node_id").alias("a"), F.col("strength").alias("sa")), rows.select("community", F.col("node_id").alias("b"), F.col("strength").alias("sb"))
    return a.join(b.hint("merge"), "community").where("a < b").repartition(parts, "a", "b")


def agm_probabilities(members: DataFrame, intra: float) -> DataFrame:
    """(a, b, p): affiliation graph model, 1 - (1 - intra)^shared."""
    return community_pairs(members).groupBy("a", "b").agg(F.count("*").alias("k")).select("a", "b", (1 - F.pow(F.lit(1 - intra), "k")).alias("p"))


def osbm_probabilities(members: DataFrame, mixing: DataFrame) -> DataFrame:
    """(a, b, p): noisy-or over all pairs of communities of the two nodes; ``mixing`` is (c, d, p), both orders, p < 1."""
    a = members.select(F.col("node_id").alias("a"), F.col("community").alias("c"))
    b = members.select(F.col("node_id").alias("b"), F.col("community").alias("d"))
    j = a.join(F.broadcast(mixing), "c").join(b, "d").where("a < b")
    return j.groupBy("a", "b").agg((1 - F.exp(F.sum(F.log1p(-F.col("p"))))).alias("p"))


def overlap_probabilities(members: DataFrame, how: str = "strength_product", base: float = 0.5) -> DataFrame:
    """(a, b, p) by strengths in shared communities: strength_product, max_strength, threshold or noisy_or."""
    x = F.col("sa") * F.col("sb")
    p = {
        "strength_product": F.least(F.lit(1.0), base * F.sum(x)), "max_strength": base * F.max(F.least("sa", "sb")),
        "threshold": F.when(F.max(F.least("sa", "sb")) > 0.5, base).otherwise(0.0), "noisy_or": 1 - F.exp(F.sum(F.log1p(-F.least(base * x, F.lit(0.999999))))),
    }[how]
    return community_pairs(members).groupBy("a", "b").agg(p.alias("p"))


def drawn(probabilities: DataFrame, nodes: DataFrame, background: float = 0.0, seed: int = 0) -> Graph:
    """A graph with each pair's edge by its probability, and about ``background`` of all pairs besides."""
    e = probabilities.where(uniform("a", "b", seed=seed) < F.col("p")).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if background:
        n = nodes.count()
        m = int(background * n * (n - 1) / 2)
        spark = nodes.sparkSession
        at = lambda k: F.floor(uniform("id", seed=seed + k) * n).cast("long")
        far = spark.range(m).select(at(3).alias("x"), at(4).alias("y")).where("x <> y").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))
        e = e.union(far).distinct()
    both = e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return Graph.from_edges(both, nodes.select(F.col("node_id").alias("id")).distinct() if "node_id" in nodes.columns else nodes)


def negative_edges(graph: Graph, n: int, seed: int = 0) -> DataFrame:
    """n random pairs of nodes that are no edges (fewer where the graph is too dense)."""
    count = graph.nodes.count()
    from .datasets import dense_ids

    ids = dense_ids(graph.ids.select(F.col("id").alias("key")), "key")
    spark = graph.nodes.sparkSession
    at = lambda k: F.floor(uniform("id", seed=seed + k) * count).cast("long")
    pairs = spark.range(2 * n + 16).select(F.col("id").alias("k"), at(1).alias("x"), at(2).alias("y"))
    named = pairs.join(ids.select(F.col("id").alias("x"), F.col("key").alias("src")), "x").join(ids.select(F.col("id").alias("y"), F.col("key").alias("dst")), "y")
    return named.join(graph.edges.select("src", "dst"), ["src", "dst"], "left_anti").orderBy("k").limit(n).select("src", "dst")


def positive_edges(graph: Graph, n: int, seed: int = 0) -> DataFrame:
    """n edges with replacement: each edge comes as often as a Poisson draw says, then n of these at random."""
    m = max(graph.edges.count(), 1)
    mean = 1.5 * n / m + 3 * np.sqrt(n) / m
    u = uniform("src", "dst", seed=seed)
    times, p = F.lit(0), np.exp(-mean)
    total = p
    for k in range(1, 60):
        times = times + (u > total).cast("int")
        p *= mean / k
        total += p
    rows = graph.edges.withColumn("k", F.explode(F.sequence(F.lit(0), times))).where("k > 0")
    return rows.orderBy(F.xxhash64("src", "dst", "k", F.lit(seed))).limit(n).select("src", "dst", "weight")
