"""Synchronisation of very many patches: what ``align`` solves on the driver, as iterations over tables.

A pair of patches is a row of its moments, a vector over patches a table (id, v).  Scales and
rotations are leading eigenvectors, found by a block Krylov method with thick restarts; shifts solve
the patch graph's Laplacian by conjugate gradients.  The driver sees small matrices of the Krylov
basis's width and sums; no matrix over all patches is ever made.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import written
from .fixpoints import component_labels
from .joins import join_heavy
from .tall import Sparse, bounded_batches, each, laplacian, normal, solved, total


def few(members: DataFrame, moments: DataFrame, rows: int = 3000, numbers: int = 1 << 22) -> bool:
    """Whether dense systems over the patches have at most so many rows, and the moments at most so many numbers."""
    first = moments.select(F.size("mean_i")).first()
    d = first[0] if first else 1
    return members.select("patch_id").distinct().count() * d <= rows and moments.count() * d * d <= numbers


def leading_vectors(a: Sparse, start: DataFrame, d: int, width: int, symmetric: bool = True, steps: int = 400, tolerance: float = 1e-10) -> tuple[DataFrame, np.ndarray]:
    """((id, v), values): vectors of the ``width`` eigenvalues of largest real part, d rows an id, orthonormal.

    ``start`` (id, v) holds d x width numbers an id.  Each step multiplies the newest block by joins
    and makes it orthogonal to the basis, again where rounding counts, by sums over all rows.  A full basis is cut down to its
    best Ritz vectors and goes on from there.  Ends when the residual is below ``tolerance`` times the
    largest value; tells if ``steps`` weren't enough.
    """
    most, keep = max(24, 10 * width), max(8, 2 * width)
    bounded_batches(start.sparkSession)
    gram = total(start, lambda v: _gram(v, d), (width, width), "v")
    square, turn = np.linalg.eigh(gram)
    good = square > square.max(initial=0.0) * 1e-20
    basis = turn[:, good] / np.sqrt(square[good])
    state, m = each(start, lambda v, c=basis: _times(v, c, d), "v"), basis.shape[1]
    block, h = m, np.zeros((m, 0))
    for _ in range(steps):
        newest = each(state, lambda v, k=block: np.ascontiguousarray(v.reshape(len(v), d, -1)[:, :, -k:]).reshape(len(v), -1), "v")
        y = a.times(newest).withColumnRenamed("v", "y")
        zero = F.array_repeat(F.lit(0.0), d * block)
        step = written(state.join(y, "id", "left").select("id", "v", F.coalesce("y", zero).alias("y")), "krylov")
        # Each pass takes the basis's part from what the last one left, and brings it to norm one.
        fresh, along, coupling, scale = (lambda v, y: y), np.zeros((m, block)), np.eye(block), 0.0
        for turn in range(4):
            g = total(step, lambda v, y, f=fresh: _gram(_beside(v, f(v, y), d), d), (m + block, m + block), "v", "y")
            part, whole = g[:m, m:], g[m:, m:]
            scale = scale or np.sqrt(max(np.trace(whole), 1e-300))
            left, axes = np.linalg.eigh(whole - part.T @ part)
            # Sums of squares tell sizes down to 1e-8 of the largest; what is smaller shows in the next pass.
            size = np.sqrt(np.maximum(left, max(left.max(), np.trace(whole) * 1e-16, 1e-280) * 1e-16))
            along = along + part @ coupling
            coupling = (size[:, None] * axes.T) @ coupling
            fresh = lambda v, y, f=fresh, c=part, t=axes / size: _left(v, f(v, y), c, t, d)
            if size[0] > 0.1 * size[-1] and np.abs(part).max() < 10 * size[-1]:
                break
        # Directions of which next to nothing leads out of the basis are rounding.
        good = np.linalg.norm(coupling, axis=1) > 1e-9 * scale
        coupling, fresh, grown = coupling[good], (lambda v, y, f=fresh, g=good: _flat(f(v, y), d)[:, g].reshape(len(v), -1)), int(good.sum())
        # Columns of the newest block in the basis, and what leads out of it.
        h = np.pad(h, ((0, grown), (0, block)))
        h[:m, m - block : m] = along
        h[m:, m - block : m] = coupling
        values, ritz = _ritz(h[:m], width, symmetric)
        residual = np.linalg.norm(h[m:] @ ritz) if grown else 0.0
        if residual <= tolerance * max(np.abs(values).max(initial=0.0), 1e-300):
            return each(step, lambda v, c=ritz: _times(v, c, d), "v"), values
        state = each(step, lambda v, y, f=fresh: _beside(v, f(v, y), d), "v", "y")
        if turn:  # much was taken off, so that the last digits depend on the batch: the block is multiplied as it is kept
            state = written(state, "krylov")
        block = grown
        if m + block > most:
            _, kept = _ritz(h[:m], min(keep, m), symmetric)
            k = kept.shape[1]
            state = each(state, lambda v, c=kept, n=m: _beside(_times(np.ascontiguousarray(v.reshape(len(v), d, -1)[:, :, :n]).reshape(len(v), -1), c, d), np.ascontiguousarray(v.reshape(len(v), d, -1)[:, :, n:]), d), "v")
            h = np.vstack([kept.T @ h[:m] @ kept, h[m:] @ kept])
            m = k
        m += block
    warnings.warn(f"the leading vectors' residual is {residual:.1e} after {steps} steps", stacklevel=2)
    return each(step, lambda v, c=ritz: _times(v, c, d), "v"), values


def _flat(v: np.ndarray, d: int) -> np.ndarray:
    return v.reshape(len(v) * d, -1)


def _gram(v: np.ndarray, d: int) -> np.ndarray:
    x = _flat(v, d)
    return x.T @ x


def _times(v: np.ndarray, c: np.ndarray, d: int) -> np.ndarray:
    return (_flat(v, d) @ c).reshape(len(v), -1)


def _left(v: np.ndarray, y: np.ndarray, c: np.ndarray, t: np.ndarray, d: int) -> np.ndarray:
    """(y - v c) t"""
    return ((_flat(y, d) - _flat(v, d) @ c) @ t).reshape(len(v), -1)


def _beside(v: np.ndarray, y: np.ndarray, d: int) -> np.ndarray:
    n = len(v)
    return np.concatenate([v.reshape(n, d, -1), y.reshape(n, d, -1)], axis=2).reshape(n, -1)


def _ritz(h: np.ndarray, k: int, symmetric: bool) -> tuple[np.ndarray, np.ndarray]:
    """The k leading values of the basis's small matrix, and an orthonormal basis of their vectors (pairs of complex ones stay together)."""
    if symmetric:
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        return values[::-1][:k], vectors[:, ::-1][:, :k]
    values, vectors = np.linalg.eig(h)
    order = np.lexsort((-values.imag, -values.real))
    values, vectors = values[order], vectors[:, order]
    if k < len(values) and values[k - 1].imag > 0:
        k += 1
    parts = [x.imag if value.imag < 0 else x.real for value, x in zip(values[:k], vectors[:, :k].T)]
    return values[:k].real, np.linalg.qr(np.stack(parts, axis=1))[0]


# ---------------------------------------------------------------- the three systems


def strengths(moments: DataFrame) -> DataFrame:
    """(id, w, pairs): shared nodes and pairs of each patch that overlaps with another."""
    ends = moments.select(F.explode(F.array(F.col("i").cast("long"), F.col("j").cast("long"))).alias("id"), "n")
    return written(ends.groupBy("id").agg(F.sum("n").cast("double").alias("w"), F.count("*").alias("pairs")), "strengths")


def _of_both(pairs: DataFrame, table: DataFrame, count: int, *columns: str) -> DataFrame:
    """``columns`` of ``table`` (id, pairs, ...) beside both ends of (i, j), as column_i and column_j."""
    for end in "ij":
        side = table.select(F.col("id").alias(end), "pairs", *[F.col(c).alias(f"{c}_{end}") for c in columns])
        pairs = join_heavy(pairs, side, end, "pairs", count)
    return pairs


def _both_ways(one: DataFrame, there: str, back: str) -> DataFrame:
    return one.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col(there).alias("weight")).unionAll(one.select(F.col("j").alias("src"), F.col("i").alias("dst"), F.col(back).alias("weight")))


def scales(moments: DataFrame, strength: DataFrame, most: float = 1e8) -> DataFrame:
    """(id, v): each patch's scale, of mean 1: the leading vector of the relative scales, weighted by shared nodes."""
    pairs = moments.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "n", F.sqrt("var_i").alias("a"), F.sqrt("var_j").alias("b"))
    s = F.least(F.greatest(F.col("a") / F.greatest("b", F.lit(1e-300)), F.lit(1 / most)), F.lit(most))
    both = _of_both(pairs.withColumn("s", s), strength, pairs.count(), "w")
    ways = both.withColumns({"there": F.col("n") * F.col("s") / F.col("w_i"), "back": F.col("n") / F.col("s") / F.col("w_j")})
    start = strength.select("id", F.array(F.lit(1.0)).alias("v"))
    v = written(leading_vectors(Sparse.of(_both_ways(ways, "there", "back")), start, 1, 1, symmetric=False)[0], "scales")
    mean = v.agg(F.avg(F.col("v")[0])).first()[0]
    return v.select("id", F.array(F.least(F.greatest(F.col("v")[0] / F.lit(mean), F.lit(1 / most)), F.lit(most))).alias("v"))


def _nearest(blocks: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(blocks)
    return u @ vt


def rotations(moments: DataFrame, strength: DataFrame, d: int, seed: int = 0) -> DataFrame:
    """(id, v): d x d numbers a patch, by which its coordinates are multiplied on the right; the smallest id's are the identity's."""
    pairs = moments.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "n", "cov")
    both = _of_both(pairs, strength, pairs.count(), "w").withColumn("share", F.col("n") / F.sqrt(F.col("w_i") * F.col("w_j")))

    def blocks(cov, share):
        r = _nearest(cov.reshape(-1, d, d)) * share[:, None, None]
        return r.reshape(len(r), -1), np.transpose(r, (0, 2, 1)).reshape(len(r), -1)

    ways = written(each(both, blocks, "cov", "share", keep=("i", "j"), out=("there", "back")), "relative-rotations")
    v = leading_vectors(Sparse.of(_both_ways(ways, "there", "back")), normal(strength, d * d, seed), d, d)[0]
    turned = written(each(v, lambda v: _nearest(v.reshape(-1, d, d)).reshape(len(v), -1), "v"), "rotations")
    base = np.array(turned.orderBy("id").select("v").first()[0]).reshape(d, d).T
    return each(turned, lambda v: _nearest(v.reshape(-1, d, d) @ base).reshape(len(v), -1), "v")


def shifts(moments: DataFrame, transforms: DataFrame, d: int) -> DataFrame:
    """(id, v): shifts, of mean 0, that fit the differences of the overlaps' means best once ``transforms`` (id, pairs, scale, turn) are applied."""
    pairs = moments.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "mean_i", "mean_j")
    both = _of_both(pairs, transforms, pairs.count(), "scale", "turn")

    def difference(a, b, s, t, p, q):
        moved = lambda x, k, r: np.einsum("na,nab->nb", x, r.reshape(-1, d, d)) * k[:, None]
        gap = moved(a, s, p) - moved(b, t, q)
        return -gap, gap

    gaps = written(each(both, difference, "mean_i", "mean_j", "scale_i", "scale_j", "turn_i", "turn_j", keep=("i", "j"), out=("there", "back")), "mean-differences")
    rows = gaps.select(F.col("i").alias("id"), F.col("there").alias("v")).unionAll(gaps.select(F.col("j").alias("id"), F.col("back").alias("v")))
    sides = rows.select("id", F.posexplode("v").alias("p", "x")).groupBy("id", "p").agg(F.sum("x").alias("x"))
    right = written(sides.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda z: z["x"]).alias("v")), "mean-differences")
    edges = _both_ways(gaps.withColumn("one", F.lit(1.0)), "one", "one")
    matrix, degree = laplacian(edges)
    found = written(solved(matrix, degree, right, d, tolerance=1e-12), "shifts")
    middle = total(found, lambda v: v.sum(axis=0), (d,), "v") / max(found.count(), 1)
    return each(found, lambda v: v - middle, "v")


@dataclass
class Synchronised:
    """Each patch's map, coord -> scale * coord @ turn + shift, as the table (id, members, pairs, scale, turn, shift)."""

    table: DataFrame
    d: int

    def apply(self, members: DataFrame) -> DataFrame:
        """``members`` in common coordinates, by one join; a patch with a large share of the rows stays where it is."""
        d = self.d
        column = lambda c: F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda r: F.element_at("turn", r * d + c + 1))
        # Columns of the turn as rows, once for each patch.
        flipped = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), column)
        side = self.table.select(F.col("id").cast(members.schema["patch_id"].dataType).alias("patch_id"), "members", "scale", flipped.alias("rows"), "shift")
        side = written(side, "maps")
        count = self.table.agg(F.sum("members")).first()[0] or 0
        both = join_heavy(members, side, "patch_id", "members", count)
        dot = lambda row: F.aggregate(F.zip_with("coord", row, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        moved = F.zip_with(F.transform("rows", lambda row: dot(row) * F.col("scale")), F.col("shift"), lambda a, b: a + b)
        return both.select("patch_id", "node_id", moved.alias("coord"))


def synchronised(members: DataFrame, moments: DataFrame, scale: bool = True, seed: int = 0) -> Synchronised:
    """The maps of all patches from the written ``moments`` of their overlaps.

    Patches must be connected by overlaps (ValueError otherwise); a single patch keeps its coordinates.
    """
    counts = written(members.groupBy(F.col("patch_id").cast("long").alias("id")).agg(F.count("*").alias("members"), F.first(F.size("coord")).alias("d")), "patch-sizes")
    n = counts.count()
    if not n:
        raise ValueError("no patches")
    d = counts.first()["d"]
    if n == 1:
        eye, zero = F.array(*[F.lit(x) for x in np.eye(d).ravel().tolist()]), F.array(*[F.lit(0.0)] * d)
        return Synchronised(counts.select("id", "members", F.lit(0).alias("pairs"), F.lit(1.0).alias("scale"), eye.alias("turn"), zero.alias("shift")), d)
    strength = strengths(moments)
    if not strength.count():
        raise ValueError("no overlaps")
    graph = Graph.from_edges(moments.select(F.col("i").cast("long").alias("src"), F.col("j").cast("long").alias("dst")), counts.select("id"))
    if component_labels(graph).select("label").distinct().count() > 1:
        raise ValueError("the patch graph is not connected")
    maps = counts.join(strength, "id").select("id", "members", "pairs")
    if scale:
        maps = maps.join(scales(moments, strength), "id").select("id", "members", "pairs", (1 / F.col("v")[0]).alias("scale"))
    else:
        maps = maps.withColumn("scale", F.lit(1.0))
    maps = written(maps.join(rotations(moments, strength, d, seed).withColumnRenamed("v", "turn"), "id"), "maps")
    return Synchronised(written(maps.join(shifts(moments, maps, d).withColumnRenamed("v", "shift"), "id"), "maps"), d)
