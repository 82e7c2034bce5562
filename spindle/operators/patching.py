"""Patches: overlapping sets of nodes, their overlaps, and how they are built from a partition.

Members are a long table (patch_id, node_id[, coord]).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import written
from .fixpoints import component_labels


def overlaps(members: DataFrame) -> DataFrame:
    """(i, j, node_id) for patches that share a node, both directions."""
    m = members.select("patch_id", "node_id").distinct()
    a, b = m.withColumnRenamed("patch_id", "i"), m.withColumnRenamed("patch_id", "j")
    return a.join(b, "node_id").where("i <> j").select("i", "j", "node_id")


def overlap_sizes(members: DataFrame, least: int = 1) -> DataFrame:
    """(i, j, n) of overlaps of at least ``least`` nodes: the patch graph."""
    return overlaps(members).groupBy("i", "j").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def intersections(members: DataFrame, least: int = 1) -> DataFrame:
    """(i, j, node_id, a, b): coordinates of shared nodes in both patches, for i < j with at least ``least`` of them."""
    m = members.select("patch_id", "node_id", "coord")
    a, b = m.select(F.col("patch_id").alias("i"), "node_id", F.col("coord").alias("a")), m.select(F.col("patch_id").alias("j"), "node_id", F.col("coord").alias("b"))
    both = a.join(b, "node_id").where("i < j")
    enough = both.groupBy("i", "j").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return both.join(enough.select("i", "j"), ["i", "j"], "left_semi").select("i", "j", "node_id", "a", "b")


def overlap_statistics(members: DataFrame) -> DataFrame:
    """One row: patches, members, pairs that overlap, mean, smallest and largest overlap."""
    n = members.select("patch_id", "node_id").distinct().agg(F.count_distinct("patch_id").alias("n_patches"), F.count("*").alias("n_members"))
    o = overlap_sizes(members).where("i < j").agg(F.count("*").alias("n_pairs"), F.avg("n").alias("mean_overlap"), F.min("n").alias("min_overlap"), F.max("n").alias("max_overlap"))
    return n.join(o)


def boundary(graph: Graph, partition: DataFrame) -> DataFrame:
    """(id, cluster, other): nodes with an edge into another cluster."""
    return graph.clustered(partition).where("cs <> cd").select(F.col("src").alias("id"), F.col("cs").alias("cluster"), F.col("cd").alias("other")).distinct()


def connectivity(graph: Graph, partition: DataFrame, conductance_weight: bool = True) -> DataFrame:
    """(src, dst, count, weight): the quotient graph without loops, its components chained by edges of count 0.

    The weight is count / min(strength), or the count.
    """
    q = graph.quotient(partition, self_loops=False).select("src", "dst", "count")
    clusters = partition.select(F.col("cluster").alias("id")).distinct()
    label = component_labels(Graph.from_edges(q, clusters, weight="count"))
    from .joins import ranked

    heads = ranked(label.where("id = label").select("id"), "n", "id")
    chain = heads.join(heads.select((F.col("n") - 1).alias("n"), F.col("id").alias("next")), "n").select("id", "next")
    both = chain.select(F.col("id").alias("src"), F.col("next").alias("dst")).unionAll(chain.select(F.col("next").alias("src"), F.col("id").alias("dst")))
    q = q.unionAll(both.select("src", "dst", F.lit(0).cast("long").alias("count")))
    if not conductance_weight:
        return q.withColumn("weight", F.col("count").cast("double"))
    s = q.groupBy("src").agg(F.sum("count").alias("s"))
    least = F.least(F.col("a"), F.col("b"))
    j = q.join(s.select("src", F.col("s").alias("a")), "src").join(s.select(F.col("src").alias("dst"), F.col("s").alias("b")), "dst")
    return j.select("src", "dst", "count", F.when(least > 0, F.col("count") / least).otherwise(0.0).alias("weight"))


def merge_small(graph: Graph, partition: DataFrame, least: int) -> DataFrame:
    """``partition`` without clusters of under ``least`` nodes.

    The smallest goes to the neighbour with most edges by volume (to the second smallest where it
    has none), and numbers are made dense by moving the last.  The quotient graph has a row for
    each pair of clusters, so the loop runs on the driver; nodes are relabelled by one join.
    """
    size = {r["cluster"]: r["n"] for r in partition.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    links: dict[int, dict[int, int]] = {c: {} for c in size}
    volume = dict.fromkeys(size, 0)
    for r in graph.quotient(partition).collect():
        links[r["src"]][r["dst"]] = r["count"]
        volume[r["src"]] += r["count"]
    goes = {c: c for c in size}
    while len(size) > 1:
        small = min(size, key=lambda c: (size[c], c))
        if size[small] >= least:
            break
        near = {c: n / max(volume[c], 1) for c, n in links[small].items() if c != small and c in size}
        into = max(near, key=lambda c: (near[c], -c)) if near else sorted(size, key=lambda c: (size[c], c))[1]
        size[into] += size.pop(small)
        volume[into] += volume.pop(small)
        for c, n in links.pop(small).items():
            c = into if c == small else c
            links[into][c] = links[into].get(c, 0) + n
        for c in links:
            if small in links[c]:
                links[c][into] = links[c].get(into, 0) + links[c].pop(small)
        goes = {c: into if g == small else g for c, g in goes.items()}
    dense = sorted(size)
    moves = {}
    for number in range(len(dense)):
        moves[dense[number]] = dense[number] if dense[number] < len(dense) else None
    free = [n for n in range(len(dense)) if n not in size]
    for c in sorted((c for c, m in moves.items() if m is None), reverse=True):
        moves[c] = free.pop(0)
    table = partition.sparkSession.createDataFrame([(c, moves[g]) for c, g in goes.items()], "cluster long, to long")
    return partition.join(F.broadcast(table), "cluster").select("id", F.col("to").alias("cluster"))


def expand(graph: Graph, partition: DataFrame, pairs: DataFrame, least: int, target: int) -> DataFrame:
    """(patch_id, node_id): each part, and what it takes from its neighbours along the edges of ``pairs`` (src, dst).

    For a pair (i, j) the nodes of part i that touch part j join patch j; their breadth-first
    surroundings inside part i follow until ``target`` nodes joined, nearest levels and smaller
    ids first. Where part i has no edge into j, its smallest id is the seed. Where the search ends
    with fewer than ``least`` nodes (the part falls into pieces), the part's other nodes fill up.
    """
    p = partition.select(F.col("id").alias("node_id"), F.col("cluster"))
    wanted = pairs.select(F.col("src").alias("i"), F.col("dst").alias("j")).where("i <> j").distinct()
    crossing = graph.clustered(partition).where("cs <> cd").select(F.col("cs").alias("i"), F.col("cd").alias("j"), F.col("src").alias("node_id")).distinct()
    seeds = crossing.join(wanted, ["i", "j"], "left_semi")
    heads = p.groupBy(F.col("cluster").alias("i")).agg(F.min("node_id").alias("node_id"))
    bare = wanted.join(seeds.select("i", "j").distinct(), ["i", "j"], "left_anti").join(heads, "i").select("i", "j", "node_id")
    taken = written(seeds.unionByName(bare).withColumn("level", F.lit(0)), "overlap")
    inner = written(graph.clustered(partition).where("cs = cd").select(F.col("cs").alias("i"), "src", "dst").distinct(), "overlap-inner")
    front, level = taken, 0
    while True:
        level += 1
        open_ = taken.groupBy("i", "j").agg(F.count("*").alias("n")).where(F.col("n") < target)
        step = front.join(open_, ["i", "j"], "left_semi").join(inner, (front["i"] == inner["i"]) & (front["node_id"] == inner["src"])).select(front["i"], "j", F.col("dst").alias("node_id")).distinct()
        front = written(step.join(taken.select("i", "j", "node_id"), ["i", "j", "node_id"], "left_anti").withColumn("level", F.lit(level)), "overlap-front")
        if not front.limit(1).count():
            break
        taken = written(taken.unionByName(front), "overlap")
    short = taken.groupBy("i", "j").agg(F.count("*").alias("n")).where(F.col("n") < least).select("i", "j")
    spare = short.join(p.select(F.col("cluster").alias("i"), "node_id"), "i").join(taken.select("i", "j", "node_id"), ["i", "j", "node_id"], "left_anti")
    taken = taken.unionByName(spare.select("i", "j", "node_id", F.lit(level + 1).alias("level")))
    order = Window.partitionBy("i", "j").orderBy("level", "node_id")
    kept = taken.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(target, least)).select(F.col("j").alias("patch_id"), "node_id")
    return p.select(F.col("cluster").alias("patch_id"), "node_id").unionByName(kept).distinct()


def create_patches(graph: Graph, partition: DataFrame, min_overlap: int = 10, target_overlap: int = 20, min_size: int = 0, target_degree: float = 4.0, method: str = "resistance", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, patch graph): merge small parts, join parts, sparsify their graph, grow the overlaps."""
    from .sparsify import sparsify

    parts = written(merge_small(graph, partition, min_size) if min_size > 1 else partition, "parts")
    near = written(connectivity(graph, parts), "patch-graph")
    kept = sparsify(near.withColumn("weight", F.greatest("weight", F.lit(1e-6))), method, target_degree, seed=seed)
    members = expand(graph, parts, kept, math.ceil(min_overlap / 2), max(1, target_overlap // 2))
    return members, overlap_sizes(members)


def create_patches_by_size(graph: Graph, size: int, method: str = "fennel", tolerance: float = 0.2, rounds: int = 3, **options) -> tuple[DataFrame, DataFrame]:
    """Patches of about ``size`` nodes: the number of clusters is corrected up to ``rounds`` times by the mean size reached."""
    from .clustering import run_clustering

    n = graph.nodes.count()
    k = max(1, round(n / size))
    for _ in range(rounds):
        part = written(run_clustering(graph, k, method), "sized")
        members, near = create_patches(graph, part, **options)
        members = written(members, "sized-members")
        reached = members.count() / max(1, members.select("patch_id").distinct().count())
        if abs(reached - size) <= tolerance * size or k == 1:
            break
        k = max(1, round(k * reached / size))
    return members, near


def create_patch_data(graph: Graph, partition: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The older name of ``create_patches``."""
    return create_patches(graph, partition, **options)


def partition_members(partition: DataFrame, coordinates: DataFrame | None = None) -> DataFrame:
    """(patch_id, node_id, coord): a partition as patches; coord is null for nodes that ``coordinates`` (node_id, coord) lacks."""
    members = partition.select(F.col("cluster").alias("patch_id"), F.col("id").alias("node_id"))
    if coordinates is None:
        return members.withColumn("coord", F.lit(None).cast("array<double>"))
    return members.join(coordinates.select("node_id", "coord"), "node_id", "left").select("patch_id", "node_id", "coord")


def coordinates_of(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (patch_id, node_id) with ``found`` and ``coord``: nodes that a patch lacks have none."""
    held = members.select("patch_id", "node_id", "coord").withColumn("found", F.lit(True))
    return wanted.join(held, ["patch_id", "node_id"], "left").select("patch_id", "node_id", F.coalesce("found", F.lit(False)).alias("found"), "coord")


def patch_parameters(n_nodes: int) -> dict:
    """Patch size, overlap and number that suit a graph of that size."""
    size = 100 if n_nodes < 1000 else 500 if n_nodes < 10_000 else 1000 if n_nodes < 100_000 else 5000
    size = min(size, max(1, n_nodes))
    return {"patch_size": size, "num_patches": max(1, n_nodes // size), "min_overlap": max(1, size // 10), "target_overlap": max(1, size // 5)}


def two_patches(graph: Graph, partition: DataFrame, target: int) -> DataFrame:
    """A bipartition whose boundary nodes join both patches, grown breadth-first to ``target`` shared nodes."""
    pairs = partition.sparkSession.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    return expand(graph, partition, pairs, 1, max(1, target // 2))


def voronoi(points: DataFrame, centres: DataFrame, eps: float) -> DataFrame:
    """(patch_id, node_id): each point in its nearest centre's patch and in further ones while their distance stays under eps times the nearest.

    ``centres`` (patch_id, centre) may be many: each point's nearest one, and then those within that range, are searched by
    pivot cells. Centres at the same least distance all count as nearest; points without whole coordinates are in no patch.
    """
    from .nearest import Cells

    cells = Cells(centres.select(F.col("patch_id").alias("id"), F.col("centre").alias("x")))
    at = points.select(F.col("node_id").alias("id"), F.col("coord").alias("x"))
    least = written(cells.nearest(at, 1, itself=True).select("id", F.col("d").alias("m")), "voronoi-nearest")
    near = cells.within(at.join(least, "id").select("id", "x", (F.col("m") * max(eps, 1.0) * (1 + 1e-12)).alias("bound")))
    near = near.join(least, "id").where((F.col("d") == F.col("m")) | (F.col("d") < eps * F.col("m")))
    return near.select(F.col("other").cast(centres.schema["patch_id"].dataType).alias("patch_id"), F.col("id").cast(points.schema["node_id"].dataType).alias("node_id"))


def communities_to_patches(communities: DataFrame, min_size: int = 1, min_overlap: int = 5) -> tuple[DataFrame, DataFrame]:
    """Communities (community, node_id) of at least ``min_size`` as patches, and their graph."""
    big = communities.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    members = communities.join(big.select("community"), "community", "left_semi").select(F.col("community").alias("patch_id"), "node_id")
    return members, overlap_sizes(members, min_overlap)
