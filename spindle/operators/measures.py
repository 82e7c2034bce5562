"""Measures of graphs, partitions, embeddings and classifications. All are relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance
from ..graph import Graph


def cluster_sizes(partition: DataFrame) -> DataFrame:
    """One row: number, largest, smallest, mean and sample deviation of cluster sizes, and largest over mean."""
    n = partition.groupBy("cluster").agg(F.count("*").alias("n"))
    return n.agg(
        F.count("*").alias("n_clusters"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.avg("n").alias("mean_size"),
        F.stddev_samp("n").alias("size_std"), (F.max("n") / F.avg("n")).alias("imbalance"),
    )


def edge_cuts(graph: Graph, partition: DataFrame) -> DataFrame:
    """(cluster, cut, edges, cut_ratio) by source cluster."""
    per = graph.clustered(partition).groupBy(F.col("cs").alias("cluster")).agg(F.count_if(F.col("cs") != F.col("cd")).alias("cut"), F.count("*").alias("edges"))
    return per.withColumn("cut_ratio", F.col("cut") / F.col("edges"))


def compare_partitions(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information (arithmetic mean of entropies)."""
    cells = first.select("id", F.col("cluster").alias("a")).join(second.select("id", F.col("cluster").alias("b")), "id").groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    rows = cells.groupBy("a").agg(F.sum("n").alias("n"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n"))
    total = cells.agg(F.sum("n").alias("t"))
    side = lambda d, p: d.join(F.broadcast(total)).agg(F.sum(pairs(F.col("n"))).alias(f"{p}_pairs"), (-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t")))).alias(f"{p}_h"))
    joint = (
        cells.join(rows.withColumnRenamed("n", "na"), "a").join(cols.withColumnRenamed("n", "nb"), "b").join(F.broadcast(total))
        .agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), F.first("t").alias("t"))
    )
    one = joint.join(side(rows, "a")).join(side(cols, "b").select("b_pairs", "b_h"))
    expected = F.col("a_pairs") * F.col("b_pairs") / pairs(F.col("t"))
    top = (F.col("a_pairs") + F.col("b_pairs")) / 2
    return one.select(
        F.when(top == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / (top - expected)).alias("adjusted_rand"),
        F.when(F.col("a_h") + F.col("b_h") == 0, F.lit(1.0)).otherwise(F.col("mi") / ((F.col("a_h") + F.col("b_h")) / 2)).alias("normalised_mi"),
    )


def validate_partition(partition: DataFrame, n_nodes: int, expected: int | None = None) -> DataFrame:
    """One row of flags: right length, no negative clusters, cluster numbers without gaps, the expected number."""
    return partition.agg(
        (F.count("*") == n_nodes).alias("right_length"),
        (F.coalesce(F.min("cluster"), F.lit(0)) >= 0).alias("no_negatives"),
        (F.count_distinct("cluster") == F.coalesce(F.max("cluster") + 1, F.lit(0))).alias("contiguous"),
        (F.count_distinct("cluster") == F.lit(expected) if expected is not None else F.lit(True)).alias("expected_number"),
    )


def modularity(graph: Graph, partition: DataFrame) -> DataFrame:
    """One row: sum over clusters of in/m2 - (deg/m2)^2, with both directions of edges stored."""
    e = graph.clustered(partition)
    m = graph.edges.agg(F.sum("weight").alias("m2"))
    per = e.groupBy("cs").agg(F.sum("weight").alias("deg"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("inside"))
    return per.join(F.broadcast(m)).agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("deg") / F.col("m2"), F.lit(2))).alias("modularity"))


def patch_sizes(members: DataFrame, n_nodes: int) -> DataFrame:
    """One row of statistics of patch sizes; theoretical size n/k, and how much of the patches is no overlap."""
    n = members.groupBy("patch_id").agg(F.count("*").alias("n"))
    k = F.count("*")
    return n.agg(
        F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"), F.stddev_pop("n").alias("std_size"), F.median("n").alias("median_size"),
        (F.lit(n_nodes) / k).alias("theoretical_size"), (F.lit(n_nodes) / F.sum("n")).alias("efficiency"),
    )


def patch_recovery(truth: DataFrame, members: DataFrame, least: float = 0.5) -> DataFrame:
    """(community, best, recovered): best Jaccard similarity of any patch to each community."""
    both = truth.join(members.select("node_id", "patch_id"), "node_id").groupBy("community", "patch_id").agg(F.count("*").alias("i"))
    a = truth.groupBy("community").agg(F.count("*").alias("a"))
    b = members.groupBy("patch_id").agg(F.count("*").alias("b"))
    best = both.join(b, "patch_id").join(a, "community").groupBy("community").agg(F.max(F.col("i") / (F.col("a") + F.col("b") - F.col("i"))).alias("best"))
    return a.join(best, "community", "left").select("community", F.coalesce("best", F.lit(0.0)).alias("best")).withColumn("recovered", F.col("best") > least)


def community_statistics(graph: Graph, memberships: DataFrame) -> DataFrame:
    """One row for overlapping ``memberships`` (node_id, community): sizes, memberships, overlap, edges inside and between."""
    sets = memberships.groupBy("node_id").agg(F.collect_set("community").alias("of"))
    sizes = memberships.groupBy("community").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_communities"), F.avg("n").alias("mean_size"), F.max("n").alias("largest"))
    nodes = sets.agg(F.avg(F.size("of")).alias("mean_memberships"), F.avg((F.size("of") > 1).cast("double")).alias("overlap_ratio"))
    e = graph.edges.where("src < dst").join(sets.select(F.col("node_id").alias("src"), F.col("of").alias("a")), "src").join(sets.select(F.col("node_id").alias("dst"), F.col("of").alias("b")), "dst")
    inside = e.agg(F.count_if(F.arrays_overlap("a", "b")).alias("intra_edges"), F.count_if(~F.arrays_overlap("a", "b")).alias("inter_edges"))
    return sizes.join(nodes).join(inside)


def class_distribution(labels: DataFrame, label: str = "y") -> DataFrame:
    """(y, n, share, imbalance): imbalance is the largest class over the class."""
    n = labels.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("t"), F.max("n").alias("m"))
    return n.join(F.broadcast(whole)).select(label, "n", (F.col("n") / F.col("t")).alias("share"), (F.col("m") / F.col("n")).alias("imbalance"))


def clustering_coefficients(graph: Graph) -> DataFrame:
    """(id, degree, triangles, coefficient) of every node of an undirected graph, without loops."""
    e = graph.edges.where("src <> dst").select("src", "dst").distinct()
    d = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    # Edges point from smaller to larger degree, which bounds the wedges at a hub.
    rank = d.select("id", F.struct("degree", "id").alias("r"))
    up = e.join(rank.select(F.col("id").alias("src"), F.col("r").alias("rs")), "src").join(rank.select(F.col("id").alias("dst"), F.col("r").alias("rd")), "dst").where("rs < rd").select("src", "dst")
    wedges = up.alias("x").join(up.alias("y"), F.col("x.src") == F.col("y.src")).where("x.dst < y.dst").select(F.col("x.src").alias("a"), F.col("x.dst").alias("b"), F.col("y.dst").alias("c"))
    closed = wedges.join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"], "left_semi")
    t = closed.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    full = graph.ids.join(d, "id", "left").join(t, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))
    k = F.col("degree")
    return full.withColumn("coefficient", F.when(k > 1, 2.0 * F.col("triangles") / (k * (k - 1))).otherwise(F.lit(0.0)))


def graph_summary(graph: Graph) -> DataFrame:
    """One row: nodes, undirected edges, density, mean degree, mean clustering coefficient."""
    c = clustering_coefficients(graph).agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.avg("coefficient").alias("mean_clustering"))
    n, m = F.col("n_nodes"), F.col("n_edges")
    return c.select("n_nodes", "n_edges", "mean_clustering", F.when(n > 1, 2.0 * m / (n * (n - 1))).otherwise(0.0).alias("density"), (2.0 * m / n).alias("mean_degree"))


# ---- embeddings


def local_errors(patches: DataFrame, reference: DataFrame) -> DataFrame:
    """(patch_id, node_id, error): distance of a patch's coordinates to the reference's (node_id, coord)."""
    r = reference.select("node_id", F.col("coord").alias("_r"))
    return patches.join(r, "node_id").select("patch_id", "node_id", distance(F.col("coord"), F.col("_r")).alias("error"))


def transform_error(transforms: DataFrame, column: str = "values") -> DataFrame:
    """One row: mean over elements of the population deviation across patches."""
    per = transforms.select(F.posexplode(column).alias("pos", "v")).groupBy("pos").agg(F.stddev_pop("v").alias("s"))
    return per.agg(F.avg("s").alias("error"))


def embedding_health(vectors: DataFrame, column: str = "coord") -> DataFrame:
    """(pos, mean, std, min, max, collapsed, low_variance) of every dimension."""
    x = vectors.select(F.posexplode(column).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return x.withColumn("collapsed", F.col("std") < 1e-6).withColumn("low_variance", F.col("std") < 0.01)


def pairwise_distances(vectors: DataFrame, id_col: str, column: str) -> DataFrame:
    """One row over all pairs of a sample the caller bounds: number, mean, deviation, smallest and largest distance."""
    a = vectors.select(F.col(id_col).alias("a"), F.col(column).alias("va"))
    b = vectors.select(F.col(id_col).alias("b"), F.col(column).alias("vb"))
    d = a.join(b, F.col("a") < F.col("b")).select(distance(F.col("va"), F.col("vb")).alias("d"))
    return d.agg(F.count("*").alias("n_pairs"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.min("d").alias("min"), F.max("d").alias("max"))


# ---- classification


def stratified_split(labels: DataFrame, test: float = 0.2, label: str = "y", order: Column | None = None) -> DataFrame:
    """``labels`` of y >= 0 with ``part``: in each class the last ``test`` share by ``order`` (a hash of the id) is "test"."""
    order = F.xxhash64("id") if order is None else order
    w = Window.partitionBy(label).orderBy(order, "id")
    n = F.count("*").over(Window.partitionBy(label))
    return labels.where(F.col(label) >= 0).withColumn("part", F.when(F.row_number().over(w) > n - F.round(n * test), "test").otherwise("train"))


def standardised(rows: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation, with 0 deviations taken as 1; statistics of ``fit_on``."""
    stats = (fit_on if fit_on is not None else rows).agg(*[f(c).alias(f"_{p}_{c}") for c in columns for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = rows.join(F.broadcast(stats))
    fix = lambda s: F.when((s == 0) | s.isNull(), F.lit(1.0)).otherwise(s)
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / fix(F.col(f"_s_{c}")) for c in columns}).drop(*stats.columns)


def confusion(rows: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(y, predicted).agg(F.count("*").alias("n"))


def class_report(rows: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """(y, precision, recall, f1, support) of every class seen; empty ratios are 0."""
    c = confusion(rows, y, predicted)
    classes = c.select(F.col(y).alias("k")).union(c.select(F.col(predicted).alias("k"))).distinct()
    t = c.where(F.col(y) == F.col(predicted)).select(F.col(y).alias("k"), F.col("n").alias("tp"))
    p = c.groupBy(F.col(predicted).alias("k")).agg(F.sum("n").alias("np"))
    s = c.groupBy(F.col(y).alias("k")).agg(F.sum("n").alias("support"))
    f = classes.join(t, "k", "left").join(p, "k", "left").join(s, "k", "left").na.fill(0, ["tp", "np", "support"])
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    f = f.withColumn("precision", ratio(F.col("tp"), F.col("np"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return f.select(F.col("k").alias(y), "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), F.col("support").cast("long").alias("support"))


def scores(rows: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy, balanced accuracy, macro, micro and weighted F1."""
    r = class_report(rows, y, predicted)
    acc = rows.agg(F.avg((F.col(y) == F.col(predicted)).cast("double")).alias("accuracy"))
    m = r.agg(
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )
    return acc.join(m).withColumn("f1_micro", F.col("accuracy"))


def minority_classes(rows: DataFrame, y: str = "y", predicted: str = "predicted", share: float = 0.05) -> DataFrame:
    """The report of classes with less than ``share`` of the support."""
    r = class_report(rows, y, predicted)
    return r.join(F.broadcast(r.agg(F.sum("support").alias("_t")))).where(F.col("support") < share * F.col("_t")).drop("_t")


def experiment_summary(results: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean, sample deviation and number of runs, rounded to 4 places."""
    return results.groupBy(*by).agg(*[f for v in values for f in (F.round(F.avg(v), 4).alias(f"{v}_mean"), F.round(F.stddev_samp(v), 4).alias(f"{v}_std"))], F.count("*").alias("runs"))


def best_per_group(results: DataFrame, group: str, what: str, value: str) -> DataFrame:
    return results.groupBy(group).agg(F.max_by(what, F.struct(F.col(value), F.col(what))).alias("best"), F.max(value).alias("value"))


def noise_profile(runs: DataFrame) -> DataFrame:
    """(noise, mean_error, std_error, valid_runs): runs without error are not valid."""
    return runs.groupBy("noise").agg(F.avg("error").alias("mean_error"), F.stddev_pop("error").alias("std_error"), F.count("error").alias("valid_runs"))


def temporal_features(nodes: DataFrame, now: int) -> DataFrame:
    """Activity features of (id, first, last, n, total, largest), times in blocks of which a day has 144."""
    base = nodes.withColumns({
        "duration": F.greatest(F.col("last") - F.col("first"), F.lit(0)) / 144.0, "recency": (F.lit(now) - F.col("last")) / 144.0, "early": F.exp(-F.col("first") / 100000.0),
    }).withColumns({
        "era": F.when(F.col("first") < now * 0.25, 0).when(F.col("first") < now * 0.5, 1).when(F.col("first") < now * 0.75, 2).otherwise(3),
        "intensity": F.least(F.col("n") / (F.col("duration") + 1), F.lit(1000.0)), "volume_intensity": F.least(F.col("total") / (F.col("duration") + 1), F.lit(1000.0)),
    })
    cut = base.agg(*[F.percentile(F.when(F.col(c) > 0, F.col(c)), F.lit(p)).alias(f"_{c}") for c, p in (("intensity", 0.8), ("volume_intensity", 0.6), ("duration", 0.3))])
    flags = {"bursty": F.col("intensity") > F.col("_intensity"), "heavy": F.col("volume_intensity") > F.col("_volume_intensity"), "short_lived": F.col("duration") < F.col("_duration")}
    return base.join(F.broadcast(cut)).withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}).drop("_intensity", "_volume_intensity", "_duration")


def thickened(points: DataFrame, step: float = 1.0) -> DataFrame:
    """Each point with its 12 nearest offsets on a grid: itself, 8 around, 4 two steps away."""
    offsets = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)] + [(2, 0), (-2, 0), (0, 2), (0, -2)]
    grid = F.array(*[F.struct(F.lit(x * step).alias("dx"), F.lit(y * step).alias("dy")) for x, y in offsets])
    return points.withColumn("_o", F.explode(grid)).withColumns({"x": F.col("x") + F.col("_o.dx"), "y": F.col("y") + F.col("_o.dy")}).drop("_o")


def strength_statistics(members: DataFrame) -> DataFrame:
    """(community, n, mean, std, least, largest) of memberships' strengths; std is the population's."""
    x = F.col("strength")
    return members.groupBy("community").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("largest"))


def tree_report(tree: DataFrame) -> DataFrame:
    """One row of a tree (tree_id, parent_id, level, is_leaf, num_nodes): depth, leaves, their mean and largest size, and branches of inner nodes."""
    inner = tree.groupBy("parent_id").agg(F.count("*").alias("n")).where("parent_id is not null").agg(F.avg("n").alias("mean_branches"))
    return tree.agg(
        F.max("level").alias("depth"), F.count_if("is_leaf").alias("leaves"), F.avg(F.when(F.col("is_leaf"), F.col("num_nodes"))).alias("mean_leaf"),
        F.max(F.when(F.col("is_leaf"), F.col("num_nodes"))).alias("largest_leaf"), F.count("*").alias("n_tree"),
    ).join(F.broadcast(inner))
