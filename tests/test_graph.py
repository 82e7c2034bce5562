"""Graph, patch, alignment, clustering and embedding operators against small worked examples and invariants."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.graph import Graph
from spindle.operators import align, clustering, embedding, fixpoints, learning, measures, patching, sparsify
from spindle.sources import datasets, generators
from spindle.streaming import partitioner


@pytest.fixture(scope="module")
def two_triangles(spark):
    """Triangles 0-1-2 and 3-4-5 joined by 2-3, and the isolated node 6."""
    half = [(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0), (3, 4, 4.0), (4, 5, 5.0), (3, 5, 6.0), (2, 3, 7.0)]
    edges = spark.createDataFrame(half + [(d, s, w) for s, d, w in half], "src long, dst long, weight double")
    return Graph.from_edges(edges, spark.range(7).select("id"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_degrees_offsets_and_neighbourhoods(two_triangles, spark):
    g = two_triangles
    assert rows(g.out_degrees().select("id", "degree")) == [(0, 2), (1, 2), (2, 3), (3, 3), (4, 2), (5, 2), (6, 0)]
    assert rows(g.offsets())[-1] == (6, 14, 14)
    assert g.is_undirected().first()[0] and not Graph.from_edges(g.edges.where("src < dst")).is_undirected().first()[0]
    assert rows(g.within_hops(spark.range(1), 2)) == [(0, 0), (1, 1), (2, 1), (3, 2)]
    assert rows(g.subgraph(spark.createDataFrame([(2,), (3,), (6,)], "id long")).edges) == [(0, 1, 7.0), (1, 0, 7.0)]


def test_components_levels_and_trees(two_triangles, spark):
    g = two_triangles
    assert rows(fixpoints.components(g)) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 1)]
    single = Graph.from_edges(spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long"))
    assert rows(fixpoints.components(single)) == [(0, 0), (1, 0)]
    assert rows(fixpoints.bfs(g, 0).select("id", "level", "parent"))[:4] == [(0, 0, None), (1, 1, 0), (2, 1, 0), (3, 2, 2)]
    assert rows(fixpoints.spanning_forest(g)) == [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 7.0), (3, 4, 4.0), (4, 5, 5.0)]
    assert sum(r[2] for r in rows(fixpoints.spanning_forest(g, maximise=True))) == 3 + 2 + 7 + 6 + 5


def test_measures(two_triangles, spark):
    g = two_triangles
    part = spark.createDataFrame([(i, int(i > 2)) for i in range(7)], "id long, cluster long")
    assert rows(g.quotient(part)) == [(0, 0, 6, 12.0), (0, 1, 1, 7.0), (1, 0, 1, 7.0), (1, 1, 6, 30.0)]
    assert rows(g.conductance(part).select("cluster", "cut", "conductance")) == [(0, 1, 1 / 7), (1, 1, 1 / 7)]
    assert [r[3] for r in rows(measures.clustering_coefficients(g))] == [1.0, 1.0, 1 / 3, 1 / 3, 1.0, 1.0, 0.0]
    assert measures.compare_partitions(part, part).first()[:] == pytest.approx((1.0, 1.0))


def test_small_clusters_merge_and_stay_dense(two_triangles, spark):
    part = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 2), (4, 2), (5, 2), (6, 3)], "id long, cluster long")
    out = patching.merge_small(two_triangles, part, 3)
    sizes = sorted(r[0] for r in out.groupBy("cluster").count().select("count").collect())
    assert min(sizes) >= 3 and sum(sizes) == 7
    found = {r.cluster for r in out.collect()}
    assert found == set(range(len(found)))


def test_sparsify(two_triangles):
    e = two_triangles.edges
    total = sparsify.resistances(e).where("src < dst").agg(F.sum(F.col("weight") * F.col("resistance"))).first()[0]
    assert abs(total - 5) < 1e-9
    for method in ("resistance", "sample", "neighbors", "rmst"):
        kept = Graph.from_edges(sparsify.sparsify(e, method, 1.0))
        assert kept.is_undirected().first()[0]
        assert fixpoints.component_labels(kept).select("label").distinct().count() == 1


@pytest.mark.parametrize("aligner", ["l2g", "geo", "sequential"])
def test_alignment_recovers_points(spark, aligner):
    points = generators.clusters(spark, 4, 40, dim=3, seed=2).select("node_id", "coord").cache()
    centres = points.where("node_id % 40 = 0").select(F.col("node_id").cast("int").alias("patch_id"), F.col("coord").alias("centre"))
    members = patching.voronoi(points, centres, 3.0).join(points, "node_id").select("patch_id", "node_id", "coord").cache()
    assert align.connected_patches(members, 4)
    moved, _ = generators.transformed(members, 3, scale=(0.5, 2.0), seed=3)
    found = {
        "l2g": lambda: align.local_to_global(moved, 4)[0],
        "geo": lambda: align.geometric(moved, 4, epochs=50)[0],
        "sequential": lambda: align.recombined(align.procrustes_sequential(moved, 4)),
    }[aligner]()
    assert found.count() == 160 and align.procrustes_disparity(found, points) < 1e-5


def test_alignment_needs_overlap(spark):
    apart = spark.createDataFrame([(0, 0, [0.0]), (1, 1, [1.0])], "patch_id int, node_id long, coord array<double>")
    with pytest.raises(ValueError):
        align.local_to_global(apart)


def test_randomised_eigenvectors():
    a = np.random.default_rng(0).normal(size=(40, 40))
    m = a @ a.T
    for sketch in ("gaussian", "rademacher"):
        assert np.allclose(align.randomised_eig(m, 3, 30, sketch=sketch)[0], np.sort(np.linalg.eigvalsh(m))[::-1][:3])


def test_clusterings_balance(two_triangles):
    g = two_triangles
    for part in (clustering.fennel(g, 2), clustering.multilevel(g, 2), clustering.spread(g, 2), clustering.hierarchical(g, 4, 2)):
        assert part.count() == 7 and part.select("id").distinct().count() == 7
    n = clustering.fennel_kernel(np.repeat(np.arange(100), 3), np.random.default_rng(0).integers(0, 100, 300), 100, 4)
    assert np.bincount(n).max() <= int(1.1 * 100 / 4) + (100 - 4 * int(1.1 * 100 / 4) > 0) * 100
    found = clustering.louvain(g)
    label = {r.id: r.cluster for r in found.collect()}
    assert label[0] == label[1] == label[2] != label[4] == label[5]


def test_hierarchical_splits_a_level_in_one_job(spark):
    """As cluster by cluster, isolated nodes and parallel edges included, in a number of jobs that doesn't follow that of clusters."""
    rng = np.random.default_rng(5)
    pairs = rng.integers(0, 100, (300, 2)).tolist()
    g = Graph.from_edges(spark.createDataFrame(pairs + [[b, a] for a, b in pairs], "src long, dst long"), spark.range(104))
    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    for most, levels in ((14, None), (14, 1)):
        alone = {r.id: r.cluster for r in clustering.hierarchical(g, most, 3, lambda h, k: clustering.fennel(h, k, mode="exact"), levels).collect()}
        group = f"split-{most}-{levels}"
        spark.sparkContext.setJobGroup(group, "")
        at_once = {r.id: r.cluster for r in clustering.hierarchical(g, most, 3, clustering.exact_fennel, levels).collect()}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert at_once == alone and len(alone) == 104
        assert jobs(group) <= 40


@pytest.mark.parametrize("name", [n for n in embedding.MODELS if n != "svd"])
def test_models_learn_and_rerun_alike(name):
    rng = np.random.default_rng(1)
    a = np.triu(rng.random((24, 24)) < 0.3, 1).astype(float)
    a = a + a.T
    f = embedding.model(name)
    z, history = f(a, np.eye(24), 4, 3, epochs=40)
    again, _ = f(a, np.eye(24), 4, 3, epochs=40)
    assert z.shape == (24, 4) and np.isfinite(z).all() and np.allclose(z, again)
    assert min(history) < history[0]


def test_tape_gradients():
    rng = np.random.default_rng(0)
    w = embedding.Var(rng.normal(size=(3, 2)))
    x = rng.normal(size=(4, 3))
    mask = np.ones((4, 4), bool)

    def loss():
        z = embedding.Var(x) @ w
        return ((z @ z.transposed()).leaky().softmax_over(mask) @ z).sigmoid().bce(np.ones((4, 2)))

    out = loss()
    out.backward()
    grad, base = w.grad.copy(), w.value.copy()
    for i in range(3):
        for j in range(2):
            w.value = base.copy()
            w.value[i, j] += 1e-6
            assert abs((loss().value - out.value) / 1e-6 - grad[i, j]) < 1e-4


def test_resampling(spark):
    x = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], int(i < 5)) for i in range(30)], "id long, x array<double>, y int")
    n = lambda m: {r.y: r["count"] for r in learning.resampled(x, m).groupBy("y").count().collect()}
    assert n("ros") == {0: 25, 1: 25} and n("rus") == {0: 5, 1: 5} and n("smote") == {0: 25, 1: 25}
    for m in ("borderline_smote", "adasyn", "tomek", "enn", "smote_tomek", "smote_enn"):
        assert set(n(m)) <= {0, 1}


def test_made_rows_have_ids_of_their_own(spark):
    """Over a thousand copies of a row, and negative ids in the table."""
    rows = spark.createDataFrame([(k, [float(k), 1.0], 0) for k in range(2, 2102)] + [(0, [0.0, 0.0], 1), (-3, [1.0, 0.0], 1)], "id long, x array<double>, y int")
    out = learning.resampled(rows, "smote").cache()
    assert out.count() == 4200 and out.select("id").distinct().count() == 4200 and out.where("id < -3").count() == 2098


def test_kernel_classifier_tells_rings_apart(spark):
    rng = np.random.default_rng(8)
    angle, y = rng.uniform(0, 2 * np.pi, 400), np.arange(400) % 2
    x = (np.stack([np.cos(angle), np.sin(angle)], 1) * (1 + 2 * y[:, None])) + 0.1 * rng.standard_normal((400, 2))
    rows = spark.createDataFrame([(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, y))], "id long, x array<double>, y int")
    train, test = rows.where("id < 200"), rows.where("id >= 200")
    right = {m: learning.classified(train, test, m).where("y = predicted").count() for m in ("rbf", "svm")}
    assert right["rbf"] >= 195 > 150 > right["svm"]
    # Dot products of the features come near the kernel.
    z = {r.id: np.array(r.x) for r in learning.random_features(train, 4096, 0.5)(train.limit(20)).collect()}
    ids = list(z)
    kernel = np.exp(-0.5 * ((x[ids][:, None] - x[ids]) ** 2).sum(-1))
    assert np.abs(np.array([[z[i] @ z[j] for j in ids] for i in ids]) - kernel).max() < 0.1


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    edges = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 30, (120, 2)))]
    schema = "edge_seq long, src long, dst long"
    for k in range(3):
        spark.createDataFrame(edges[40 * k : 40 * k + 40], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = partitioner.partition_stream(stream, str(tmp_path / "state"), 30, 3)
    query.awaitTermination(120)
    got = rows(partitioner.latest(spark, str(tmp_path / "state")))
    state = partitioner.fold({}, np.array([e[1:] for e in edges]), 30, 3)
    assert got == sorted(state.items())


def test_sources(spark, tmp_path):
    day = tmp_path / "as"
    day.mkdir()
    (day / "as19971108.txt").write_text("# a comment\n1\t2\n2\t3\n")
    edges, nodes = datasets.read_snapshots(spark, str(day))
    assert [(str(r.timestamp.date()), r.src, r.dst) for r in edges.orderBy("src").collect()] == [("1997-11-08", 0, 1), ("1997-11-08", 1, 2)]
    assert nodes.count() == 2
    datasets.write_pair(edges, None, str(tmp_path / "pair"))
    back, none = datasets.get_dataset(spark, "pair", path=str(tmp_path / "pair"))
    assert back.count() == 2 and none is None
    with pytest.raises(KeyError):
        datasets.get_dataset(spark, "nothing")
    members = spark.createDataFrame([(0, 5, [1.0]), (1, 5, [2.0])], "patch_id int, node_id long, coord array<double>")
    datasets.write_patches(members, str(tmp_path / "patches"))
    assert datasets.read_patches(spark, str(tmp_path / "patches"), 1).select("coord").first()[0] == [2.0]


def test_entry_runs_without_the_corpus_package(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_heavy_joins_and_ranks(spark):
    """A hub of half of the rows is joined apart with the same result; ranks run over all ranges."""
    from spindle.operators.joins import join_heavy, ranked

    rows = [(0 if i % 2 else i, i) for i in range(6000)]
    left = spark.createDataFrame(rows, "k long, v long")
    right = left.where("k % 3 = 0").groupBy("k").count().withColumnRenamed("count", "n").withColumn("w", F.col("k") * 2)
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right.select("k", "w"), "k", how).collect()), key=repr)
        got = join_heavy(left, right, "k", "n", 6000, how, parts=3, small=0).select("k", "v", "w")
        assert sorted(map(tuple, got.collect()), key=repr) == want
    placed = ranked(left, "pos", F.desc("k"), F.asc("v")).collect()
    assert [r.v for r in sorted(placed, key=lambda r: r.pos)] == [v for _, v in sorted(rows, key=lambda r: (-r[0], r[1]))]
    assert sorted(r.pos for r in placed) == list(range(6000)) and ranked(left.where("k < 0"), "pos", "k").count() == 0


def test_bulk_fennel_keeps_loads_with_weights(spark):
    from spindle.graph import Graph
    from spindle.operators.clustering import fennel, multilevel

    edges = [(a, b) for g in range(4) for a in range(g * 20, g * 20 + 20) for b in range(g * 20, g * 20 + 20) if a != b] + [(i, (i + 20) % 80) for i in range(0, 80, 10)]
    g = Graph.from_edges(spark.createDataFrame(edges + [(b, a) for a, b in edges[-8:]], "src long, dst long"))
    for part in (fennel(g, 4), multilevel(g, 4, coarsest=20)):
        size = [r["n"] for r in part.groupBy("cluster").agg(F.count("*").alias("n")).collect()]
        assert sum(size) == 80 and max(size) <= 24
    heavy = g.ids.withColumn("size", F.when(F.col("id") == 0, 15).otherwise(1))
    load = fennel(g, 4, node_weights=heavy).join(heavy, "id").groupBy("cluster").agg(F.sum("size").alias("n")).collect()
    assert sum(r["n"] for r in load) == 94 and max(r["n"] for r in load) <= 94 // 4 + 1 + 15


def test_conversions_and_sinks(spark, tmp_path):
    from spindle.graph import Graph
    from spindle.sources import datasets as ds
    from spindle.sources import generators as gn
    from spindle.streaming.partitioner import LazyPatch, write_stream_patches

    e = spark.createDataFrame([(1, 0, 1, 2.0), (1, 0, 1, 1.0), (2, 1, 0, 3.0)], "timestamp long, src long, dst long, f double")
    edges, nodes = ds.snapshots(e)
    assert sorted(map(tuple, edges.collect())) == [(1, 0, 1, 1.0), (2, 1, 0, 3.0)] and nodes.count() == 4
    ds.write_points(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], "node_id long, coord array<double>"), str(tmp_path / "p"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "p")).collect()), key=repr) == [("1", "1.0", "2.0"), ("2", "3.0", None)]
    runs = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "method string, accuracy double")
    ds.write_results(runs, ["method"], ["accuracy"], str(tmp_path / "r"))
    assert {(r.method, r.accuracy_mean) for r in spark.read.option("header", True).csv(str(tmp_path / "r/summary")).collect()} == {("a", "2.0"), ("b", "5.0")}
    state = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "id long, cluster long")
    write_stream_patches(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), state, str(tmp_path / "s"))
    patch = LazyPatch(spark, str(tmp_path / "s"), 1)
    assert {r.node_id for r in patch.nodes.collect()} == {1, 2} and patch.graph().edges.count() == 2
    assert [sum(gn.community_sizes(100, 7, how)) for how in ("uniform", "poisson", "power_law", "bernoulli")] == [100] * 4
    grown = gn.grown_memberships(spark, 200, 5)
    assert grown.where("community is null or community < 0 or community >= 5").count() == 0 and grown.select("node_id").distinct().count() == 200
    assert set(gn.standard_suite(spark)) == {"agm", "osbm", "roc"}
    assert ds.transactions(spark)[0].where("btc_amount is null or btc_amount <= 0").count() == 0


def test_the_stream_fold_gets_an_edge_for_each_node_at_most(spark):
    import numpy as np

    from spindle.streaming import partitioner as st

    rng = np.random.default_rng(3)
    ends = rng.integers(0, 30, (400, 2)).tolist()
    batch = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ends)], "edge_seq long, src long, dst long").repartition(4)
    assert st._telling(batch).count() <= 30
    known = {5: 1, 40: 0}
    want = st.fold(dict(known), np.array(ends), 32, 3)
    state = spark.createDataFrame(list(known.items()), "id long, cluster long")
    assert {r.id: r.cluster for r in st.step(state, batch, 32, 3).collect()} == want
    assert {r.id: r.cluster for r in st.step(None, batch, 32, 3).collect()} == st.fold({}, np.array(ends), 32, 3)
    assert {r.id: r.cluster for r in st.step(state, batch.limit(0), 32, 3).collect()} == known


def test_community_pairs_are_dealt_by_their_number(spark, monkeypatch):
    from spindle.sources import generators as gn

    monkeypatch.setattr(gn, "PAIRS", 100)
    members = spark.range(200).select(F.col("id").alias("node_id"), F.floor(F.col("id") / 20).alias("community"), F.lit(1.0).alias("strength"))
    p = gn.agm_probabilities(members.unionAll(members.where("node_id < 20").withColumn("community", F.lit(99))), 0.3)
    assert p.rdd.getNumPartitions() >= 20
    got = {(r.a, r.b): round(r.p, 9) for r in p.collect()}
    assert got == {(a, b): 0.51 if b < 20 else 0.3 for a in range(200) for b in range(a + 1, 200) if a // 20 == b // 20}
    assert gn.agm_probabilities(members.limit(0), 0.3).count() == 0


def test_rounds_of_louvain_and_multilevel_broadcast_no_tables_of_nodes(spark, monkeypatch):
    from spindle import session

    plans = []

    def recorded(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return session.written(df, name)

    half = [(a, b) for a in range(12) for b in range(a) if a % 3 == b % 3 or a == b + 1]
    e = session.written(spark.createDataFrame([(a, b, 1.0) for x, y in half for a, b in ((x, y), (y, x))], "src long, dst long, weight double"), "edges")
    g = Graph.from_edges(e)
    monkeypatch.setattr(clustering, "written", recorded)
    state = session.written(g.ids.select("id", (F.col("id") % 2).alias("cluster")), "state")
    clustering.refined(g, state, 2, 1.1, session.written(g.ids.withColumn("size", F.lit(1).cast("long")), "sizes"), 1)
    clustering.louvain(g, levels=1, rounds=2)
    recorded(g.clustered(state), "clustered")
    assert {name for name, _ in plans} >= {"louvain", "refine", "clustered"}
    for name, plan in plans:
        assert "BroadcastHashJoin" not in plan or name == "refine" and plan.count("BroadcastHashJoin") == 1, (name, plan)  # the room of each cluster


def _modularity(g, cluster):
    e = [tuple(r) for r in g.edges.select("src", "dst", "weight").collect()]
    m2, degree = sum(w for *_, w in e), {}
    for a, _, w in e:
        degree[cluster[a]] = degree.get(cluster[a], 0.0) + w
    return sum(w for a, b, w in e if cluster[a] == cluster[b]) / m2 - sum(d * d for d in degree.values()) / m2**2


@pytest.mark.parametrize("local, rounds, short", [(0, 2, 1.0), (400, 6, 0.05), (200_000, 12, 1e-9)])
def test_louvain_finds_planted_groups_and_keeps_isolated_nodes(spark, monkeypatch, local, rounds, short):
    """By rounds of joins, by a task from the second level on, and by a task at once, whose jobs are few."""
    monkeypatch.setattr(clustering, "LOCAL_EDGES", local)
    rng = np.random.default_rng(3)
    pairs = sorted({(a, b) for a, b in rng.integers(0, 90, (4000, 2)).tolist() if a < b and (a // 15 == b // 15 or rng.random() < 0.02)})
    g = Graph.from_edges(spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long"), spark.range(95))
    spark.sparkContext.setJobGroup(f"louvain-{local}", "")
    found = {r.id: r.cluster for r in clustering.louvain(g, levels=10 if local else 2, rounds=rounds).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(found) == list(range(95)) and len({found[k] for k in range(90, 95)}) == 5
    assert _modularity(g, found) >= _modularity(g, {k: k // 15 for k in range(95)}) - short
    if local == 200_000:
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("louvain-200000")) <= 40


def test_louvain_kernel_never_lowers_modularity():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 60, (2, 150))
    src, dst = np.r_[a, b], np.r_[b, a]
    w = np.tile(rng.random(150), 2)

    def q(c):
        strength = np.bincount(c[src], weights=w)
        return w[c[src] == c[dst]].sum() / w.sum() - (strength**2).sum() / w.sum() ** 2

    values = [q(clustering.louvain_kernel(src, dst, w, 60, 1.0, k, w.sum())) for k in (0, 1, 2, 10)]
    assert values == sorted(values) and values[1] > values[0]
    assert clustering.louvain_kernel(src[:0], src[:0], w[:0], 3, 1.0, 10, 1.0).tolist() == [0, 1, 2]
