"""Nearest neighbours by pivot cells and what rests on them, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import learning, nearest
from spindle.operators.nearest import Cells


def table(spark, x, y=None):
    rows = [(k, v.tolist(), 0 if y is None else int(y[k])) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>, y long")


def brute(x, k, y=None):
    out = {}
    for a in range(len(x)):
        d = sorted((float(np.sqrt(((x[a] - x[b]) ** 2).sum())), b) for b in range(len(x)) if b != a and (y is None or y[a] == y[b]))
        out[a] = [b for _, b in d[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append(r.other)
    return out


@pytest.mark.parametrize("pivots, block", [(1, 4096), (9, 10), (40, 1)])
def test_nearest_equal_all_pairs(spark, pivots, block):
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(size=(120, 3)), np.ones((30, 3)), draw.normal(size=(30, 3)) * 0.01 + 5])
    y = np.arange(len(x)) % 3
    y[:2] = 7  # a class of two
    rows = table(spark, x, y)
    assert found(Cells(rows, None, block, pivots).nearest(rows, 4)) == brute(x, 4)
    assert found(Cells(rows, "y", block, pivots).nearest(rows, 4)) == brute(x, 4, y)


def test_few_none_and_faulty_points(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (7, [float("inf"), 0.0])], "id long, x array<double>")
    assert found(Cells(rows).nearest(rows, 3)) == {1: [2], 2: [1]}
    assert Cells(rows.limit(0)).nearest(rows, 3).count() == 0
    assert Cells(rows).nearest(rows.limit(0), 3).count() == 0
    assert found(Cells(rows).nearest(rows, 1, itself=True)) == {1: [1], 2: [2]}


def test_ranges_equal_all_pairs(spark):
    x = np.random.default_rng(3).normal(size=(150, 2))
    q = table(spark, x[:40]).withColumn("bound", F.col("id") * 0.02)
    got = {(r.id, r.other) for r in Cells(table(spark, x), None, 16, 12).within(q).collect()}
    assert got == {(a, b) for a in range(40) for b in range(150) if np.sqrt(((x[a] - x[b]) ** 2).sum()) <= a * 0.02}


def test_pruned_cells_are_not_asked(spark):
    x = np.concatenate([np.random.default_rng(4).normal(size=(50, 2)) * 0.01 + 10 * c for c in range(8)])
    cells = Cells(table(spark, x), None, 4096, 30)
    rows = table(spark, x).withColumns({"part": F.lit(""), "bound": F.lit(0.05)})
    assert cells._asked(rows, False).count() < len(x) * 12


def test_cleaning_equals_all_pairs(spark):
    draw = np.random.default_rng(5)
    x, y = draw.normal(size=(90, 2)), draw.integers(0, 2, 90)
    rows = table(spark, x, y)
    near = brute(x, 1)
    tomek = {a for a in near for b in near[a] if near[b] == [a] and y[a] != y[b]}
    assert {r.id for r in learning.resampled(rows, "tomek").collect()} == set(range(90)) - tomek
    near = brute(x, 3)
    enn = {a for a in near if sum(y[a] == y[b] for b in near[a]) < 1.5}
    assert {r.id for r in learning.resampled(rows, "enn").collect()} == set(range(90)) - enn


@pytest.mark.parametrize("method", ["smote", "borderline_smote", "adasyn"])
def test_made_rows_lie_between_neighbours(spark, method):
    draw = np.random.default_rng(6)
    x, y = draw.normal(size=(80, 2)), (np.arange(80) >= 60).astype(int)
    out = learning.resampled(table(spark, x, y), method).collect()
    near = brute(x, 5, y)
    for r in out:
        if r.id < 0:
            v = np.array(r.x)
            gaps = [np.linalg.norm(v - x[a]) + np.linalg.norm(v - x[b]) - np.linalg.norm(x[a] - x[b]) for a in near if y[a] == r.y for b in near[a]]
            assert min(gaps) < 1e-9
    assert len({r.id for r in out}) == len(out) and (method != "smote" or sum(r.y for r in out) == 60)


def test_a_query_is_sent_once_to_a_block_of_many_cells(spark):
    """Without structure the bounds leave nearly every cell; what is sent follows the blocks that the points fill."""
    x = np.random.default_rng(7).normal(size=(600, 32))
    rows = table(spark, x)
    cells = Cells(rows, None, 200, 24)
    assert 3 <= cells.blocks <= 8
    asked = rows.withColumns({"part": F.lit(""), "bound": F.lit(100.0)})
    assert cells._asked(asked, True).count() == 600 and cells._asked(asked, False).count() == 600 * (cells.blocks - 1)
    assert found(cells.nearest(rows, 5)) == brute(x, 5)


@pytest.mark.parametrize("scale", [1.0, 1e20, 1e-20])
def test_blocks_hold_few_pairs_at_once_and_keep_ties(monkeypatch, scale):
    monkeypatch.setattr(nearest, "PAIRS", 50)
    draw = np.random.default_rng(8)
    x = np.concatenate([draw.normal(size=(3000, 3)), np.ones((40, 3)), draw.normal(size=(40, 3)) * 1e-6 + 9]) * scale
    ids = draw.permutation(len(x))
    q = np.r_[0, 5, np.arange(2990, len(x))]
    for k, itself, bound in ((4, False, np.inf), (1, True, np.inf), (3, False, 0.5 * scale), (None, True, 0.3 * scale)):
        got = [np.concatenate(c) for c in zip(*nearest.Block(ids, x).near(ids[q], x[q], np.full(len(q), bound), k, itself))]
        for a in q:
            d = np.sqrt(((x - x[a]) ** 2).sum(1))
            order = [b for b in np.lexsort((ids, d)) if d[b] <= bound and (itself or b != a)][:k]
            mine = got[0] == ids[a]
            assert dict(zip(got[1][mine].tolist(), got[2][mine].tolist())) == {int(ids[b]): d[b] for b in order}


def test_only_rows_that_grow_ask_for_neighbours(spark, monkeypatch):
    asked = []
    neighbours = learning._neighbours
    monkeypatch.setattr(learning, "_neighbours", lambda rows, asking, *o, **n: asked.append(asking.count()) or neighbours(rows, asking, *o, **n))
    x = np.random.default_rng(9).normal(size=(50, 2))
    assert learning.resampled(table(spark, x, np.arange(50) < 22), "smote").count() == 56
    assert asked == [6]
