"""Synchronisation over tables against the dense systems of the driver."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import align, synchronise, tall
from spindle.session import written


def noisy_patches(spark, n, d, seed, noise=0.05, per=8, extra=2):
    """Patches on a ring with chords, each in coordinates of its own; ``per`` nodes a pair."""
    rng = np.random.default_rng(seed)
    pairs = {(k, (k + 1) % n) for k in range(n)} | {tuple(p) for p in rng.integers(0, n, (extra * n, 2)).tolist() if p[0] != p[1]}
    pairs = sorted({(min(p), max(p)) for p in pairs})
    turn = np.linalg.qr(rng.standard_normal((n, d, d)))[0]
    size, move = rng.uniform(0.5, 2, n), rng.standard_normal((n, d)) * 3
    rows, node = [], 0
    for i, j in pairs:
        for x in rng.standard_normal((per, d)):
            for p in (i, j):
                rows.append((p * 7 + 3, node, (size[p] * (x + noise * rng.standard_normal(d)) @ turn[p] + move[p]).tolist()))
            node += 1
    return spark.createDataFrame(rows, "patch_id int, node_id long, coord array<double>").repartition(5)


def test_moments_equal_numpy(spark):
    members = noisy_patches(spark, 5, 3, 1).withColumn("coord", F.transform("coord", lambda v: v + 1e6))
    rows = members.collect()
    at = {}
    for r in rows:
        at.setdefault(r.patch_id, {})[r.node_id] = np.array(r.coord)
    found = {(r.i, r.j): r for r in align.overlap_moments(members, 2).collect()}
    pairs = {(i, j) for i in at for j in at if i < j and len(at[i].keys() & at[j].keys()) >= 2}
    assert found.keys() == pairs
    for (i, j), r in found.items():
        both = sorted(at[i].keys() & at[j].keys())
        x, y = np.array([at[i][k] for k in both]), np.array([at[j][k] for k in both])
        assert r.n == len(both) and np.allclose(r.mean_i, x.mean(0)) and np.allclose(r.mean_j, y.mean(0))
        x, y = x - x.mean(0), y - y.mean(0)
        assert np.allclose(r.cov, (x.T @ y).ravel(), atol=1e-7) and np.allclose([r.var_i, r.var_j], [(x**2).sum(), (y**2).sum()], rtol=1e-7)
    assert align.overlap_moments(members.limit(0)).count() == 0


def test_moments_merge():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((9, 3)), rng.standard_normal((9, 3))
    for cut in (1, 4, 8):
        whole, parts = align._moments_of(x, y), align._moments_merged(align._moments_of(x[:cut], y[:cut]), align._moments_of(x[cut:], y[cut:]))
        assert all(np.allclose(a, b) for a, b in zip(whole, parts))


@pytest.mark.parametrize("n, d, noise, extra", [(2, 2, 0.05, 2), (14, 3, 0.05, 2), (9, 5, 0.0, 0)])
def test_same_transforms_as_the_driver(spark, n, d, noise, extra):
    """Without noise all blocks are alike, so that the basis soon holds all there is."""
    members = written(noisy_patches(spark, n, d, n, noise, extra=extra), "members")
    moments = written(align.overlap_moments(members, 2), "moments")
    m = align.Moments.of(members, 2, moments)
    s, r = align.synchronised_scales(m), align.synchronised_rotations(m, "standard")
    maps = {row.id: row for row in synchronise.synchronised(members, moments).table.collect()}
    turn = np.array([np.reshape(maps[p].turn, (d, d)) for p in m.patches])
    assert np.abs(np.array([1 / maps[p].scale for p in m.patches]) - s).max() < 1e-8
    # Rotations are up to a common one, which the products of pairs don't show.
    ours, theirs = turn[:, None] @ turn[None].transpose(0, 1, 3, 2), r.transpose(0, 2, 1)[:, None] @ r[None]
    assert np.abs(ours - theirs).max() < 1e-8 and np.abs(turn[0] - np.eye(d)).max() < 1e-12
    # Shifts in the driver's way, after the same scales and rotations.
    table = spark.createDataFrame([(p, maps[p].scale, np.reshape(maps[p].turn, (d, d)).T.tolist()) for p in m.patches], "patch_id int, scale double, rotation array<array<double>>")
    moved = written(align.rotated(align.scaled(members, table.select("patch_id", "scale")), table.select("patch_id", "rotation")), "moved")
    want = align.synchronised_shifts(moved, m.patches, 2)
    assert np.abs(np.array([maps[p].shift for p in m.patches]) - want).max() < 1e-8


def test_aligners_agree_on_pairs_of_nodes(spark):
    members = noisy_patches(spark, 4, 2, 5)
    one, two = ({r.node_id: np.array(r.coord) for r in align.local_to_global(members, 2, solver=s)[0].collect()} for s in ("driver", "tables"))
    ids = sorted(one)
    apart = [np.linalg.norm(np.array([x[k] for k in ids])[:, None] - np.array([x[k] for k in ids]), axis=2) for x in (one, two)]
    assert np.abs(apart[0] - apart[1]).max() < 1e-7


def test_leading_vectors_restart(spark):
    """A path's values crowd at the top, so that the basis fills up more than once."""
    n = 45
    w = np.diag(np.ones(n - 1), 1) + np.diag(np.linspace(0, 0.4, n)) / 2
    w = w + w.T
    rows = [(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))]
    a, ids = tall.Sparse.of(spark.createDataFrame(rows, "src long, dst long, weight double")), spark.range(n)
    v, values = synchronise.leading_vectors(a, tall.normal(ids, 1, 3), 1, 1, symmetric=False, tolerance=1e-7)
    want, vectors = np.linalg.eigh(w)
    got = np.array([r.v[0] for r in v.orderBy("id").collect()])
    assert abs(values[0] - want[-1]) < 1e-8 and abs(abs(got @ vectors[:, -1]) - 1) < 1e-8


def test_edges_of_the_input(spark):
    schema = "patch_id int, node_id long, coord array<double>"
    apart = spark.createDataFrame([(0, 0, [0.0]), (1, 1, [1.0])], schema)
    with pytest.raises(ValueError, match="no overlaps"):
        align.local_to_global(apart, solver="tables")
    four = spark.createDataFrame([(p, 10 * (p // 2) + k, [float(k * k), 1.0 - k]) for p in range(4) for k in range(3)], schema)
    with pytest.raises(ValueError, match="not connected"):
        align.local_to_global(four, solver="tables")
    with pytest.raises(ValueError, match="no patches"):
        align.local_to_global(four.limit(0), solver="tables")
    alone = four.where("patch_id = 0")
    found, _ = align.local_to_global(alone, solver="tables")
    assert sorted((r.node_id, r.coord) for r in found.collect()) == sorted((r.node_id, r.coord) for r in alone.collect())
