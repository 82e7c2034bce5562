"""numpy files by ranges, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.graph import Graph
from spindle.operators.joins import ranked
from spindle.sources import numpy_files as npf
from spindle.sources.datasets import read_embedding


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("row").collect()]


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("dtype", ["<f4", ">f8", "<i2", "<u4"])
def test_two_axes(spark, tmp_path, dtype, order):
    x = np.asarray(np.arange(1000 * 3).reshape(1000, 3) * 7 % 1001, dtype=dtype, order=order)
    np.save(tmp_path / "x.npy", x)
    got = npf.read_npy(spark, str(tmp_path / "x.npy"), part_bytes=2000)
    assert got.rdd.getNumPartitions() > 2
    assert values(got, "row", "value") == [(k, v.tolist()) for k, v in enumerate(x)]
    turned = npf.read_npy(spark, "file:" + str(tmp_path / "x.npy"), axis=1, part_bytes=1)
    assert values(turned, "value") == [(v.tolist(),) for v in x.T]
    some = npf.read_npy(spark, str(tmp_path / "x.npy"), columns={"c": 2, "a": 0}, part_bytes=5000)
    assert some.columns == ["row", "c", "a"] and values(some, "c", "a") == [(r[2], r[0]) for r in x.tolist()]


def test_one_axis_texts_flags_and_nothing(spark, tmp_path):
    for name, x in (("t", np.array(["a", "", "\u00e4\u00df"])), ("b", np.array([True, False])), ("e", np.zeros((0, 4))), ("h", np.array([0.5, -2], "f2")), ("s", np.array([b"xy", b"z"]))):
        np.save(tmp_path / f"{name}.npy", x)
    assert values(npf.read_npy(spark, str(tmp_path / "t.npy")), "value") == [("a",), ("",), ("\u00e4\u00df",)]
    assert values(npf.read_npy(spark, str(tmp_path / "b.npy")), "value") == [(True,), (False,)]
    assert values(npf.read_npy(spark, str(tmp_path / "h.npy")), "value") == [(0.5,), (-2.0,)]
    assert values(npf.read_npy(spark, str(tmp_path / "s.npy")), "value") == [("xy",), ("z",)]
    assert npf.read_npy(spark, str(tmp_path / "e.npy")).count() == 0


def test_three_axes_come_flat_and_what_cannot_be_read_raises(spark, tmp_path):
    np.save(tmp_path / "c.npy", np.arange(24).reshape(2, 3, 4))
    assert values(npf.read_npy(spark, str(tmp_path / "c.npy")), "value") == [(list(range(12)),), (list(range(12, 24)),)]
    np.save(tmp_path / "o.npy", np.array([{}], dtype=object), allow_pickle=True)
    np.save(tmp_path / "z.npy", np.array(3.0))
    for name in "oz":
        with pytest.raises(Exception, match="objects|axis"):
            npf.read_npy(spark, str(tmp_path / f"{name}.npy")).collect()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives(spark, tmp_path, save):
    x, y = np.random.default_rng(0).normal(size=(500, 5)), np.arange(500) % 3
    save(tmp_path / "a.npz", other=np.zeros(2), X=x, targets=y)
    assert npf.members(str(tmp_path / "a.npz")) == ["other", "X", "targets"]
    got = read_embedding(spark, str(tmp_path / "a.npz"))
    assert values(got, "embedding", "label") == [(r.tolist(), int(c)) for r, c in zip(x, y)]
    with pytest.raises(KeyError):
        read_embedding(spark, str(tmp_path / "a.npz"), ("nothing",))


def test_what_is_written_is_what_numpy_reads(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(3000, 4))
    rows = spark.createDataFrame([(k, v.tolist(), k * 3 % 7) for k, v in enumerate(x)], "row long, v array<double>, c long").orderBy(F.hash("row"))
    assert npf.write_npy(rows, str(tmp_path / "v.npy"), "v") == (3000, 4)
    assert np.array_equal(np.load(tmp_path / "v.npy"), x)
    assert npf.write_npy(rows, str(tmp_path / "c.npy"), "c", "int32") == (3000,)
    assert np.load(tmp_path / "c.npy").tolist() == [k * 3 % 7 for k in range(3000)]
    npf.write_npy(rows.withColumn("r", F.col("row")), "file:" + str(tmp_path / "e.npy"), ["r", "c"], "int64")
    assert np.load(tmp_path / "e.npy").tolist() == [list(range(3000)), [k * 3 % 7 for k in range(3000)]]
    assert npf.write_npy(rows.limit(0), str(tmp_path / "n.npy"), "c") == (0,) and np.load(tmp_path / "n.npy").shape == (0,)


def test_gaps_repeats_nulls_and_ragged_vectors_raise(spark, tmp_path):
    for rows in ([(0, [1.0]), (2, [1.0])], [(0, [1.0]), (0, [2.0])], [(0, [1.0]), (1, None)], [(0, [1.0]), (1, [None])], [(0, [1.0]), (1, [1.0, 2.0])], [(None, [1.0])]):
        with pytest.raises(ValueError):
            npf.write_npy(spark.createDataFrame(rows, "row long, v array<double>"), str(tmp_path / "x.npy"), "v")
    with pytest.raises(ValueError, match="mounted"):
        npf.write_npy(spark.createDataFrame([(0, 1.0)], "row long, v double"), "s3://bucket/x.npy", "v")


def test_graph_folder(spark, tmp_path):
    nodes = spark.createDataFrame([(0, [1.0, 2.0], 4), (1, [0.0, 1.0], None), (2, [5.0, 5.0], 1), (3, [0.0, 0.0], 0)], "id long, x array<double>, y int")
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0), (2, 0, 1.0), (0, 2, 1.0)], "src long, dst long, weight double")
    npf.save_graph(Graph.from_edges(edges, nodes), str(tmp_path / "g"))
    assert np.load(tmp_path / "g/edge_index.npy").tolist() == [[0, 0, 1, 2], [1, 2, 0, 0]]
    assert np.load(tmp_path / "g/edge_attr.npy").tolist() == [2.0, 1.0, 2.0, 1.0]
    assert np.load(tmp_path / "g/adj_index.npy").tolist() == [0, 2, 3, 4, 4]
    assert (tmp_path / "g/info.json").read_text() == '{"num_nodes": 4, "undir": true}'
    g = npf.load_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, g.edges.collect())) == sorted(map(tuple, edges.collect()))
    assert [(r.id, r.x, r.y) for r in g.nodes.orderBy("id").collect()] == [(0, [1.0, 2.0], 4), (1, [0.0, 1.0], -1), (2, [5.0, 5.0], 1), (3, [0.0, 0.0], 0)]
    np.save(tmp_path / "edge_index.npy", np.array([[0, 3], [0, 1]]))
    plain = npf.load_graph(spark, str(tmp_path))
    assert plain.nodes.count() == 4 and sorted(map(tuple, plain.edges.collect())) == [(0, 0, 1.0), (3, 1, 1.0)]


def test_files_are_read_side_by_side_without_a_join(spark, tmp_path):
    np.save(tmp_path / "edge_index.npy", np.arange(6000).reshape(2, 3000))
    np.save(tmp_path / "edge_attr.npy", np.arange(3000) / 2)
    g = npf.load_graph(spark, str(tmp_path), part_bytes=5000)
    assert "Join" not in g.edges._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, g.edges.collect())) == [(k, k + 3000, k / 2) for k in range(3000)]
    np.save(tmp_path / "edge_attr.npy", np.arange(2999) / 2)
    with pytest.raises(Exception, match="2999"):
        npf.load_graph(spark, str(tmp_path)).edges.collect()


def test_mirrored_graphs_are_undirected_without_a_sum(spark):
    half = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0)], "src long, dst long, weight double")
    found = Graph.mirrored(half).is_undirected()
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString() and found.first()[0] is True
    assert Graph.mirrored(half.withColumn("weight", F.when(F.col("dst") == 2, 1.0))).is_undirected().first()[0] is False


def test_dense_parts_are_the_subgraph_of_all(spark):
    from spindle.plans.fixtures import copart

    plain, dense = copart(spark, "/root/testdata/sf0.001"), copart(spark, "/root/testdata/sf0.001", dense=True)
    want = plain.subgraph(plain.ids)
    assert sorted(map(tuple, dense.edges.collect())) == sorted(map(tuple, want.edges.collect()))
    assert sorted((r.id, r.orig_id) for r in dense.nodes.collect()) == sorted((r.id, r.orig_id) for r in want.nodes.collect())


def test_ranked_rows_are_written_where_they_lie(spark, tmp_path):
    """In runs that files and batches cut anywhere: the same bytes as sorted rows, without a sort or a count of distinct numbers."""
    rows = ranked(spark.range(0, 30000, 1, 7).select((F.col("id") * 7919 % 30011).alias("v")), "row", "v")
    for path, in_runs in ((tmp_path / "a.npy", False), (tmp_path / "b.npy", True)):
        npf.write_npy(rows, str(path), "v", "int64", in_runs=in_runs)
    assert (tmp_path / "a.npy").read_bytes() == (tmp_path / "b.npy").read_bytes()


def test_undirected_tells_weights_and_counts_apart(spark):
    cases = [([(1, 2, 1.0), (2, 1, 1.0), (3, 3, 2.0)], True), ([(1, 2, 1.0), (2, 1, 2.0)], False), ([(1, 2, 1.0), (1, 2, 1.0), (2, 1, 1.0)], False), ([(1, 2, None), (2, 1, None)], False), ([], True)]
    for edges, want in cases:
        assert Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, weight double")).is_undirected().first()[0] is want
