"""Alignment of overlapping patches: synchronisation of scale, rotation and translation.

What depends on the data is aggregated in Spark (moments of the overlaps: counts, means,
covariances, d*d numbers for each pair of patches).  Systems over few patches are solved in numpy on
the driver, those over many as tables (``synchronise``).  Patches are members (patch_id, node_id, coord).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distance
from ..graph import Graph
from .fixpoints import component_labels
from .patching import intersections, overlap_sizes
from .tall import arrays, bounded_batches, matrix


def patch_degrees(members: DataFrame, least: int = 1) -> DataFrame:
    """(patch_id, degree): number of patches that share at least ``least`` nodes."""
    d = overlap_sizes(members, least).groupBy(F.col("i").alias("patch_id")).agg(F.count("*").alias("degree"))
    return members.select("patch_id").distinct().join(d, "patch_id", "left").select("patch_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def pair_weights(members: DataFrame, least: int = 1) -> DataFrame:
    """(i, j, weight): overlap by the least overlap asked for."""
    return overlap_sizes(members, least).select("i", "j", (F.col("n") / F.lit(least)).alias("weight"))


def overlap_moments(members: DataFrame, least: int = 1) -> DataFrame:
    """(i, j, n, mean_i, mean_j, var_i, var_j, cov) for i < j; var are sums of squares and cov the d x d sums, all centred.

    Shared nodes are dealt by pair (a pair of very many nodes over several tasks), and each task keeps
    the moments of one pair at a time; what several tasks hold of a pair is merged afterwards.
    """
    x = intersections(members, 1).select("i", "j", F.col("a").alias("mean_i"), F.col("b").alias("mean_j"))
    bounded_batches(members.sparkSession)
    keys = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c in "ij")
    made = x.hint("rebalance", F.col("i"), F.col("j")).sortWithinPartitions("i", "j").mapInArrow(_pair_moments, f"{keys}, {_MOMENTS}")
    merged = made.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_pair_moments, made.schema)
    return merged.where(F.col("n") >= least)


_MOMENTS = "n long, mean_i array<double>, mean_j array<double>, var_i double, var_j double, cov array<double>"


def _moments_of(x: np.ndarray, y: np.ndarray) -> tuple:
    a, b = x.mean(axis=0), y.mean(axis=0)
    x, y = x - a, y - b
    return len(x), a, b, (x**2).sum(), (y**2).sum(), x.T @ y


def _moments_merged(s: tuple, t: tuple) -> tuple:
    n = s[0] + t[0]
    da, db, share = t[1] - s[1], t[2] - s[2], s[0] * t[0] / n
    return n, s[1] + da * t[0] / n, s[2] + db * t[0] / n, s[3] + t[3] + share * (da @ da), s[4] + t[4] + share * (db @ db), s[5] + t[5] + share * np.outer(da, db)


def _pair_moments(batches):
    """The moments of each run of equal (i, j), of rows of coordinates or of moments; a run may go on in the next batch."""
    held, done = None, []

    def told(types):
        i, j, found = zip(*done)
        n, a, b, va, vb, cov = zip(*found)
        done.clear()
        columns = [pa.array(i, types[0]), pa.array(j, types[1]), pa.array(n, pa.int64()), arrays(np.stack(a)), arrays(np.stack(b)), pa.array(va, pa.float64()), pa.array(vb, pa.float64()), arrays(np.stack(cov).reshape(len(n), -1))]
        return pa.RecordBatch.from_arrays(columns, ["i", "j", "n", "mean_i", "mean_j", "var_i", "var_j", "cov"])

    for batch in batches:
        if not batch.num_rows:
            continue
        types = [batch.schema.field(c).type for c in "ij"]
        i, j = (batch.column(c).to_numpy(zero_copy_only=False) for c in "ij")
        a, b = matrix(batch.column("mean_i")), matrix(batch.column("mean_j"))
        rest = [matrix(batch.column(c)) for c in ("n", "var_i", "var_j", "cov")] if "n" in batch.schema.names else None
        starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        for s, e in zip(starts, np.r_[starts[1:], len(i)]):
            if rest is None:
                parts = [_moments_of(a[s:e], b[s:e])]
            else:
                parts = [(int(rest[0][k]), a[k], b[k], rest[1][k], rest[2][k], rest[3][k].reshape(a.shape[1], -1)) for k in range(s, e)]
            for part in parts:
                if held is not None and held[0] == i[s] and held[1] == j[s]:
                    held = (i[s], j[s], _moments_merged(held[2], part))
                    continue
                if held is not None:
                    done.append(held)
                held = (i[s], j[s], part)
            if done and len(done) * done[0][2][5].size > 1 << 20:
                yield told(types)
    if held is not None:
        done.append(held)
        yield told(types)


def relative_scales(members: DataFrame, least: int = 1) -> DataFrame:
    """(i, j, scale): spread of i by spread of j on their overlap, within 1e-8 and 1e8."""
    m = overlap_moments(members, least)
    r = F.sqrt(F.col("var_i")) / F.sqrt(F.col("var_j"))
    return m.select("i", "j", F.when(F.col("var_j") <= 0, F.lit(1e8)).otherwise(F.least(F.greatest(r, F.lit(1e-8)), F.lit(1e8))).alias("scale"))


def mean_differences(members: DataFrame, least: int = 1) -> DataFrame:
    """(i, j, n, difference): mean over the overlap of i's coordinates minus j's."""
    x = intersections(members, least).select("i", "j", F.posexplode(F.arrays_zip("a", "b")).alias("p", "z"))
    per = x.groupBy("i", "j", "p").agg(F.count("*").alias("n"), F.avg(F.col("z.a") - F.col("z.b")).alias("v"))
    return per.groupBy("i", "j").agg(F.first("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("p", "v"))), lambda z: z["v"]).alias("difference"))


# ---- applying transforms and recombining


def scaled(members: DataFrame, scales: DataFrame) -> DataFrame:
    """Coordinates times the factor of (patch_id, scale)."""
    return members.join(F.broadcast(scales), "patch_id").select("patch_id", "node_id", F.transform("coord", lambda x: x * F.col("scale")).alias("coord"))


def rotated(members: DataFrame, rotations: DataFrame) -> DataFrame:
    """coord @ rotation.T for (patch_id, rotation), rotations as arrays of rows."""
    turned = F.transform("rotation", lambda row: F.aggregate(F.zip_with(F.col("coord"), row, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return members.join(F.broadcast(rotations), "patch_id").select("patch_id", "node_id", turned.alias("coord"))


def translated(members: DataFrame, shifts: DataFrame) -> DataFrame:
    return members.join(F.broadcast(shifts), "patch_id").select("patch_id", "node_id", F.zip_with("coord", "shift", lambda a, b: a + b).alias("coord"))


def centred(members: DataFrame) -> DataFrame:
    """Each patch minus its mean."""
    m = members.select("patch_id", F.posexplode("coord").alias("p", "v")).groupBy("patch_id", "p").agg(F.avg("v").alias("v"))
    m = m.groupBy("patch_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "v"))), lambda z: -z["v"]).alias("shift"))
    return translated(members, m)


def recombined(members: DataFrame, how: str = "mean", nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, coord): mean or exact median over patches; null for ``nodes`` (node_id) in no patch."""
    f = F.avg if how == "mean" else F.median
    x = members.select("node_id", F.posexplode("coord").alias("p", "v")).groupBy("node_id", "p").agg(f("v").alias("v"))
    out = x.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "v"))), lambda z: z["v"]).alias("coord"))
    return out if nodes is None else nodes.select("node_id").join(out, "node_id", "left")


def overlap_report(members: DataFrame, within: float = 1.0) -> DataFrame:
    """(i, j, n, mean_distance, max_distance, preserved) of shared nodes' coordinates, i < j."""
    d = intersections(members).select("i", "j", distance(F.col("a"), F.col("b")).alias("d"))
    return d.groupBy("i", "j").agg(F.count("*").alias("n"), F.avg("d").alias("mean_distance"), F.max("d").alias("max_distance"), F.count_if(F.col("d") < within).alias("preserved"))


# ---- small solves


def nearest_orthogonal(m: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    return u @ vt


def relative_rotation(cov: np.ndarray) -> np.ndarray:
    """R with x_i R close to x_j, from the centred covariance sum x_i' x_j."""
    return nearest_orthogonal(cov)


def randomised_eig(m: np.ndarray, k: int, rounds: int = 8, over: int = 10, sketch: str = "gaussian", seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and vectors of a symmetric matrix by a random range and subspace iteration."""
    rng = np.random.default_rng(seed)
    width = min(len(m), k + over)
    w = rng.choice([-1.0, 0.0, 1.0], (len(m), width), p=[1 / 6, 2 / 3, 1 / 6]) if sketch == "rademacher" else rng.standard_normal((len(m), width))
    q, _ = np.linalg.qr(m @ w)
    for _ in range(rounds):
        q, _ = np.linalg.qr(m @ q)
    values, vectors = np.linalg.eigh(q.T @ m @ q)
    order = np.argsort(-values)[:k]
    return values[order], q @ vectors[:, order]


def top_vectors(m: np.ndarray, k: int, method: str = "adaptive", seed: int = 0) -> np.ndarray:
    """Vectors of the k largest eigenvalues: exact up to 1500 rows, else randomised ("standard" and "randomized" force one)."""
    if method == "standard" or method == "adaptive" and len(m) <= 1500:
        values, vectors = np.linalg.eigh(m)
        return vectors[:, np.argsort(-values)[:k]]
    return randomised_eig(m, k, sketch="rademacher" if method == "sparse_aware" else "gaussian", seed=seed)[1]


@dataclass
class Moments:
    """The moments of all overlaps, on the driver: d*d + 2d + 3 numbers for each pair of patches."""

    patches: list[int]
    pairs: list

    @classmethod
    def of(cls, members: DataFrame, least: int, moments: DataFrame | None = None) -> Moments:
        patches = sorted(r[0] for r in members.select("patch_id").distinct().collect())
        if not patches:
            raise ValueError("no patches")
        at = {p: k for k, p in enumerate(patches)}
        rows = (overlap_moments(members, least) if moments is None else moments).collect()
        if len(patches) > 1 and not rows:
            raise ValueError("no overlaps")
        pairs = [(at[r["i"]], at[r["j"]], r["n"], np.array(r["mean_i"]), np.array(r["mean_j"]), r["var_i"], r["var_j"], np.array(r["cov"]).reshape(len(r["mean_i"]), -1)) for r in rows]
        g = np.zeros(len(patches), int) - 1
        todo = [0]
        while todo:
            k = todo.pop()
            if g[k] < 0:
                g[k] = 0
                todo += [b for a, b, *_ in pairs if a == k] + [a for a, b, *_ in pairs if b == k]
        if (g < 0).any():
            raise ValueError("the patch graph is not connected")
        return cls(patches, pairs)


def synchronised_scales(m: Moments, most: float = 1e8) -> np.ndarray:
    """Scale of each patch up to a common factor (mean 1): the leading vector of the relative scales."""
    n = len(m.patches)
    a = np.zeros((n, n))
    for i, j, k, _, _, vi, vj, _ in m.pairs:
        s = np.clip(np.sqrt(vi) / max(np.sqrt(vj), 1e-300), 1 / most, most)
        a[i, j], a[j, i] = k * s, k / s
    w = np.zeros((n, n))
    for i, j, k, *_ in m.pairs:
        w[i, j] = w[j, i] = k
    a /= np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
    v = np.ones(n)
    for _ in range(10_000):
        new = a @ v + v
        new /= new.mean()
        if np.abs(new - v).max() < 1e-14 * np.abs(new).max():
            break
        v = new
    return np.clip(v, 1 / most, most)


def synchronised_rotations(m: Moments, method: str = "adaptive", seed: int = 0) -> np.ndarray:
    """Rotation of each patch (coord @ rotation.T aligns), up to a common one."""
    n, d = len(m.patches), m.pairs[0][7].shape[0]
    w = np.zeros(n)
    for i, j, k, *_ in m.pairs:
        w[i] += k
        w[j] += k
    big = np.zeros((n * d, n * d))
    for i, j, k, *_, cov in m.pairs:
        r = relative_rotation(cov) * k / np.sqrt(w[i] * w[j])
        big[i * d : (i + 1) * d, j * d : (j + 1) * d] = r
        big[j * d : (j + 1) * d, i * d : (i + 1) * d] = r.T
    v = top_vectors(big + np.eye(n * d), d, method, seed)
    blocks = v.reshape(n, d, d) / np.sqrt(np.maximum(w, 1e-300))[:, None, None]
    return np.stack([nearest_orthogonal(b).T for b in blocks])


def synchronised_shifts(members: DataFrame, patches: list[int], least: int) -> np.ndarray:
    """Shifts that fit the mean differences best, of mean 0."""
    rows = mean_differences(members, least).collect()
    at = {p: k for k, p in enumerate(patches)}
    a = np.zeros((len(rows), len(patches)))
    b = np.zeros((len(rows), len(rows[0]["difference"])))
    for k, r in enumerate(rows):
        a[k, at[r["i"]]], a[k, at[r["j"]]] = -1.0, 1.0
        b[k] = r["difference"]
    return np.linalg.lstsq(a, b, rcond=None)[0]


def local_to_global(members: DataFrame, least: int = 1, scale: bool = True, method: str = "adaptive", how: str = "mean", seed: int = 0, solver: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(embedding, aligned members): scales, then rotations, then shifts, then the mean or median of patches.

    ``solver``: "driver" gathers the moments and solves dense systems, "tables" iterates over tables of
    pairs; "auto" takes the first while patches and moments are few.  Both give the same alignment.
    """
    from ..session import written
    from .synchronise import few, synchronised

    spark = members.sparkSession
    members = written(members.select("patch_id", "node_id", "coord"), "patches")
    moments = written(overlap_moments(members, least), "moments")
    if solver == "tables" or solver == "auto" and not few(members, moments):
        aligned = written(synchronised(members, moments, scale, seed).apply(members), "patches")
        return recombined(aligned, how), aligned
    m = Moments.of(members, least, moments)
    if len(m.patches) > 1:
        s = synchronised_scales(m) if scale else np.ones(len(m.patches))
        r = synchronised_rotations(m, method, seed)
        table = [(p, float(1 / s[k]), r[k].tolist()) for k, p in enumerate(m.patches)]
        t = spark.createDataFrame(table, "patch_id int, scale double, rotation array<array<double>>")
        members = written(rotated(scaled(members, t.select("patch_id", "scale")), t.select("patch_id", "rotation")), "patches")
        shifts = synchronised_shifts(members, m.patches, least)
        members = written(translated(members, spark.createDataFrame([(p, shifts[k].tolist()) for k, p in enumerate(m.patches)], "patch_id int, shift array<double>")), "patches")
    return recombined(members, how), members


def procrustes_sequential(members: DataFrame, least: int = 3) -> DataFrame:
    """Patches turned, scaled and moved onto the first one by one, along a breadth-first tree of the largest overlaps."""
    m = Moments.of(members, least)
    n, d = len(m.patches), m.pairs[0][7].shape[0] if m.pairs else 0
    done = {0: (1.0, np.eye(d), np.zeros(d))}
    pairs = sorted(m.pairs, key=lambda p: (-p[2], p[0], p[1]))
    while len(done) < n:
        for i, j, _, mi, mj, vi, vj, cov in pairs:
            if (i in done) == (j in done):
                continue
            if j in done:  # i moves onto j
                i, j, mi, mj, vi, vj, cov = j, i, mj, mi, vj, vi, cov.T
            s, r, t = done[i]
            u, sv, vt = np.linalg.svd(cov.T)  # x_j to x_i
            turn, factor = u @ vt, sv.sum() / max(vj, 1e-300)
            done[j] = (s * factor, turn @ r, s * ((mi - factor * mj @ turn) @ r) + t)
            break
    rows = [(m.patches[k], float(s), r.T.tolist(), t.tolist()) for k, (s, r, t) in done.items()]
    t = members.sparkSession.createDataFrame(rows, "patch_id int, scale double, rotation array<array<double>>, shift array<double>")
    return translated(rotated(scaled(members, t.select("patch_id", "scale")), t.select("patch_id", "rotation")), t.select("patch_id", "shift"))


def geometric(members: DataFrame, least: int = 1, epochs: int = 1000, rate: float = 0.01, orthogonality: float = 100.0, patience: int = 20) -> tuple[DataFrame, DataFrame, list[float]]:
    """(embedding, aligned members, losses): a linear map for each patch, trained by Adam from the synchronised rotations.

    The loss, sum |x_i W_i - x_j W_j|^2 over centred overlaps plus ``orthogonality`` * |W W' - 1|^2,
    needs the overlaps' Gram matrices only, so epochs cost nothing in Spark.
    """
    x = intersections(members, least)
    spark = members.sparkSession
    m = Moments.of(members, least)
    rows = x.select("i", "j", F.posexplode("a").alias("r", "v"), "node_id", "a", "b")
    gram = {}
    for name, other in (("aa", "a"),):
        g = rows.select("i", "j", "r", "v", F.posexplode(other).alias("c", "w")).groupBy("i", "j", "r", "c").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
        gram[name] = g.collect()
    back = x.select("i", "j", F.posexplode("b").alias("r", "v"), "b").select("i", "j", "r", "v", F.posexplode("b").alias("c", "w")).groupBy("i", "j", "r", "c").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    gram["bb"] = back.collect()
    at = {p: k for k, p in enumerate(m.patches)}
    d = m.pairs[0][7].shape[0]
    full: dict = {}
    for name in ("aa", "bb"):
        for r in gram[name]:
            full.setdefault((at[r["i"]], at[r["j"]], name), np.zeros((d, d)))[r["r"], r["c"]] = r["s"]
    parts = []
    for i, j, n, mi, mj, _, _, cov in m.pairs:
        parts.append((i, j, full[i, j, "aa"] - n * np.outer(mi, mi), full[i, j, "bb"] - n * np.outer(mj, mj), cov))
    s = synchronised_scales(m)
    w = np.transpose(synchronised_rotations(m), (0, 2, 1)).copy()
    size = sum(np.trace(a) / s[i] ** 2 for i, _, a, _, _ in parts) + 1e-300
    m1, m2, losses, best, kept, idle = np.zeros_like(w), np.zeros_like(w), [], np.inf, w.copy(), 0
    for step in range(1, epochs + 1):
        grad, loss = np.zeros_like(w), 0.0
        for i, j, a, b, c in parts:
            a, b, c = a / s[i] ** 2 / size, b / s[j] ** 2 / size, c / (s[i] * s[j]) / size
            loss += np.trace(w[i].T @ a @ w[i]) + np.trace(w[j].T @ b @ w[j]) - 2 * np.trace(w[i].T @ c @ w[j])
            grad[i] += 2 * (a @ w[i] - c @ w[j])
            grad[j] += 2 * (b @ w[j] - c.T @ w[i])
        off = np.einsum("pij,pkj->pik", w, w) - np.eye(d)
        loss += orthogonality * float((off**2).sum())
        grad += 4 * orthogonality * off @ w
        losses.append(float(loss))
        if loss < best * (1 - 1e-5):
            best, kept, idle = loss, w.copy(), 0
        else:
            idle += 1
            if idle >= patience:
                break
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        w = w - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    t = spark.createDataFrame([(p, float(1 / s[k]), kept[k].T.tolist()) for k, p in enumerate(m.patches)], "patch_id int, scale double, rotation array<array<double>>")
    out = rotated(scaled(members, t.select("patch_id", "scale")), t.select("patch_id", "rotation"))
    shifts = synchronised_shifts(out, m.patches, least)
    out = translated(out, spark.createDataFrame([(p, shifts[k].tolist()) for k, p in enumerate(m.patches)], "patch_id int, shift array<double>"))
    return recombined(out), out, losses


def two_patches_aligned(members: DataFrame, least: int = 1, scale: bool = True) -> tuple[DataFrame, DataFrame]:
    """(embedding, aligned members) of exactly two patches: the second is turned, scaled and moved onto the first by the moments of their overlap."""
    m = Moments.of(members, least)
    if len(m.patches) != 2:
        raise ValueError(f"two patches are needed, not {len(m.patches)}")
    ((_, _, _, mi, mj, vi, vj, cov),) = m.pairs
    u, _, vt = np.linalg.svd(cov.T)  # x_j to x_i
    turn = u @ vt
    factor = float(np.sqrt(vi / vj)) if scale and vj > 0 else 1.0
    rows = [(m.patches[0], 1.0, np.eye(len(mi)).tolist(), [0.0] * len(mi)), (m.patches[1], factor, turn.T.tolist(), (mi - factor * mj @ turn).tolist())]
    t = members.sparkSession.createDataFrame(rows, "patch_id int, scale double, rotation array<array<double>>, shift array<double>")
    out = translated(rotated(scaled(members.select("patch_id", "node_id", "coord"), t.select("patch_id", "scale")), t.select("patch_id", "rotation")), t.select("patch_id", "shift"))
    return recombined(out), out


def aligned_iteratively(members: DataFrame, rounds: int = 3, method: str = "l2g", tolerance: float = 1e-9, **options) -> tuple[DataFrame, DataFrame, list[float]]:
    """(embedding, aligned members, mean overlap distances): aligned again from where the last round ended, until that distance no longer falls."""
    from ..session import written

    def distance_of(rows: DataFrame) -> float:
        return float(intersections(rows).select(distance(F.col("a"), F.col("b")).alias("d")).agg(F.avg("d")).first()[0] or 0.0)

    found, best, told = None, members, []
    for _ in range(rounds):
        one = local_to_global(best, **options) if method == "l2g" else geometric(best, **options)[:2]
        aligned = written(one[1], "realigned")
        told.append(distance_of(aligned))
        if found is not None and told[-1] >= told[-2] - tolerance:
            told.pop()
            break
        found, best = one[0], aligned
    return recombined(best), best, told


def matrix_diagnostics(m: np.ndarray) -> dict[str, float]:
    """Condition number, range of eigenvalues, share of zeros and asymmetry of a synchronisation matrix."""
    values = np.linalg.eigvalsh((m + m.T) / 2)
    size = np.abs(values)
    return {
        "condition": float(size.max() / size.min()) if size.min() > 0 else float("inf"), "least": float(values[0]), "largest": float(values[-1]),
        "zeros": float((m == 0).mean()), "asymmetry": float(np.abs(m - m.T).max()),
    }


ALIGNERS = {"l2g": lambda m, **o: local_to_global(m, **o)[0], "geo": lambda m, **o: geometric(m, **o)[0]}


def register_aligner(name: str, f) -> None:
    ALIGNERS[name] = f


# ---- errors


def procrustes_disparity(a: DataFrame, b: DataFrame) -> float:
    """1 - (sum of singular values)^2 of the centred, unit-norm configurations (node_id, coord), from d x d moments."""
    both = a.select(F.lit(0).alias("patch_id"), "node_id", "coord").unionAll(b.select(F.lit(1).alias("patch_id"), "node_id", "coord"))
    (r,) = overlap_moments(both).collect()
    cov = np.array(r["cov"]).reshape(len(r["mean_i"]), -1)
    return float(1 - (np.linalg.svd(cov, compute_uv=False).sum() ** 2) / (r["var_i"] * r["var_j"]))


def orthogonal_error(first: np.ndarray, second: np.ndarray) -> float:
    """2 (d - sum of singular values of the mean of R1' R2)."""
    mean = np.mean([x.T @ y for x, y in zip(first, second)], axis=0)
    return float(2 * (mean.shape[0] - np.linalg.svd(mean, compute_uv=False).sum()))


def orthogonality(w: np.ndarray) -> dict[str, float]:
    return {"off": float(np.linalg.norm(w @ w.T - np.eye(len(w)))), "det": float(np.linalg.det(w)), "cond": float(np.linalg.cond(w))}


def connected_patches(members: DataFrame, least: int = 1) -> bool:
    g = Graph.from_edges(overlap_sizes(members, least).select(F.col("i").alias("src"), F.col("j").alias("dst")), members.select(F.col("patch_id").cast("long").alias("id")).distinct())
    return component_labels(g).select("label").distinct().count() <= 1
