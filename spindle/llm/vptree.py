"""Nearest neighbours by vantage-point trees, one for each shard of vectors.

A tree node takes one of its vectors as vantage point and parts the others at the median of
their distances to it.  A query with best distances so far of at most r visits the side that it
falls in, and the other side unless the triangle inequality proves that nothing nearer is
there; the bound is relaxed by ``factor``: a side is left out if ``factor`` times the least
possible distance exceeds r.  Factor 1 gives exact results, larger ones fewer visits.

Vectors are dealt to cells by their nearest pivot (at most ``PIVOTS`` of them, drawn by hash), and
a cell to shards of about ``shard_rows`` vectors.  A query first asks the shards of its own cell.
The distance of the k-th found bounds the second round: it asks the cells that may hold something
nearer, by the same inequality on the cells' radii and on the distances to both pivots, relaxed
by the same factor.  Trees and groups of at most ``block_rows`` queries meet in tasks of their
own, so that no task grows with the table.  Distances are computed in double precision from the
vectors as they are, as the root of the sum of squared differences.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part,
neither do rows without id; repeated ids are so many candidates (the query's own id none), and
such a query asks with the smallest of its vectors; ties go to the smaller id; equal vectors are
kept in leaves of any size; vectors of another length than the query's are no candidates of it;
an empty table gives an empty result; with fewer than k candidates all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, staged

LEAF = 128
PIVOTS = 1024
#: A hair's breadth keeps rounding from cutting a tie off.
HAIR = 1 + 1e-9


class VPTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.v, self.leaf = ids, vectors, leaf
        self.nodes: list[tuple] = []  # (vantage, radius, inside, outside) or (None, rows)
        self.root = self._build(np.arange(len(ids))) if len(ids) else -1
        self.compared = 0  # vectors whose distance to a query was taken

    def _build(self, rows: np.ndarray) -> int:
        """Iterative, so that depth is no limit."""
        self.nodes.append(())
        stack = [(0, rows)]
        while stack:
            at, rows = stack.pop()
            if len(rows) <= self.leaf:
                self.nodes[at] = (None, rows)
                continue
            vantage, others = rows[0], rows[1:]
            d = np.sqrt(((self.v[others] - self.v[vantage]) ** 2).sum(axis=1))
            radius = np.partition(d, len(d) // 2)[len(d) // 2]
            inside = d <= radius
            if inside.all():
                inside = d < radius
            if not inside.any():  # all alike
                self.nodes[at] = (None, rows)
                continue
            self.nodes += [(), ()]
            a, b = len(self.nodes) - 2, len(self.nodes) - 1
            near, far = d[inside], d[~inside]
            self.nodes[at] = (vantage, near.max(), far.min(), a, b)
            stack += [(a, others[inside]), (b, others[~inside])]
        return 0

    def nearest(self, query_id: int, q: np.ndarray, k: int, factor: float = 1.0, within: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest within a distance, nearest first, ties to smaller ids."""
        best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
        if self.root < 0:
            return best_i, best_d
        worst = within
        stack = [(0.0, 0)]
        single: list[int] = []

        def offer(rows: np.ndarray) -> None:
            nonlocal best_d, best_i, worst
            self.compared += len(rows)
            d = np.sqrt(((self.v[rows] - q) ** 2).sum(axis=1))
            keep = (d <= worst) & (self.ids[rows] != query_id)
            if keep.any():
                best_d, best_i = np.concatenate([best_d, d[keep]]), np.concatenate([best_i, self.ids[rows][keep]])
                if len(best_d) > k:
                    order = np.lexsort((best_i, best_d))[:k]
                    best_d, best_i = best_d[order], best_i[order]
                if len(best_d) == k:
                    worst = min(worst, best_d.max())

        while stack:
            bound, at = stack.pop()
            if factor * bound > worst * HAIR:
                continue
            node = self.nodes[at]
            if node[0] is None:
                offer(np.r_[node[1], single].astype(np.int64))
                single = []
                continue
            vantage, near, far, a, b = node
            single.append(vantage)
            d = float(np.sqrt(((self.v[vantage] - q) ** 2).sum()))
            inside, outside = (max(bound, d - near), a), (max(bound, far - d), b)
            stack += [outside, inside] if d <= near else [inside, outside]
        if single:
            offer(np.array(single, np.int64))
        order = np.lexsort((best_i, best_d))
        return best_i[order], best_d[order]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(v), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((v - p) ** 2).sum(axis=1))
    return out


def _vectors(batch, column: str = "_v") -> np.ndarray:
    data = batch.column(column)
    data = data.combine_chunks() if isinstance(data, pa.ChunkedArray) else data
    return data.flatten().to_numpy(zero_copy_only=False).reshape(len(data), -1)


def _to_cells(pivots):
    """Every vector's nearest pivot and the distance to it."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d = _distances(_vectors(batch), pivots.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "distance"])

    return run


def _further(pivots, cells: np.ndarray, radius: np.ndarray, factor: float):
    """A row for each query and each cell beside its own that may hold something within its bound."""
    schema = pa.schema([("_id", pa.int64()), ("_v", pa.list_(pa.float64())), ("within", pa.float64()), ("cell", pa.int32())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distances(_vectors(batch), pivots.value)[:, cells]
            own = batch.column("cell").to_numpy()
            to_own = d[np.arange(len(own)), np.searchsorted(cells, own)]
            # Nothing in a cell is nearer than its rim, nor than halfway between the two pivots.
            least = np.maximum(d - radius, (d - to_own[:, None]) / 2 - 1e-9 * d)
            row, at = np.nonzero((factor * least <= batch.column("within").to_numpy()[:, None] * HAIR) & (cells != own[:, None]))
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(row), batch.column("_v").take(row), batch.column("within").take(row), pa.array(cells[at].astype(np.int32))], schema=schema)

    return run


def _search(k: int, factor: float):
    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        if not shard.num_rows or not asked.num_rows:
            return _FOUND.empty_table()
        order = np.argsort(shard.column("_id").to_numpy(), kind="stable")
        tree = VPTree(shard.column("_id").to_numpy()[order], np.ascontiguousarray(_vectors(shard)[order]))
        out: list[list] = [[], [], []]
        for query_id, q, within in zip(asked.column("_id").to_pylist(), _vectors(asked), asked.column("within").to_pylist()):
            found, d = tree.nearest(query_id, q, k, factor, within)
            out[0].append(np.full(len(found), query_id, np.int64))
            out[1].append(found)
            out[2].append(d)
        return pa.table([np.concatenate(c) for c in out], schema=_FOUND)

    return run


def _ask(asked: DataFrame, held: DataFrame, sizes: DataFrame, k: int, factor: float, block_rows: int) -> DataFrame:
    """Answers of all shards of a cell to ``asked`` (_id, _v, within, cell); ``sizes`` (cell, shards) is one row for each pivot at most."""
    blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    both = sizes.join(blocks, "cell")
    own = lambda c, n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int").alias(c)
    left = held.join(F.broadcast(both), "cell").select("_id", "_v", "cell", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = asked.join(F.broadcast(both), "cell").select("_id", "_v", "within", "cell", own("block", "blocks", "_id"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    keys = ["cell", "shard", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k, factor), "query_id long, vec_id long, score double")


def _of_length(rows: DataFrame, n: int, k: int, factor: float, shard_rows: int, block_rows: int) -> DataFrame:
    """(query_id, vec_id, score) for rows (_id, _v, _ask), all of one length."""
    spark = rows.sparkSession
    wanted = max(1, min(PIVOTS, -(-n // shard_rows)))
    drawn = rows.select("_id", "_v", F.xxhash64("_id", "_v").alias("_h")).orderBy("_h", "_id").limit(wanted).collect()
    pivots = spark.sparkContext.broadcast(np.unique(np.array([r["_v"] for r in drawn]), axis=0))
    placed = staged(rows.mapInArrow(_to_cells(pivots), "_id long, _v array<double>, _ask boolean, cell int, distance double"), "vp-cells")
    cells = sorted(tuple(r) for r in placed.groupBy("cell").agg(F.max("distance"), F.count("*")).collect())  # one row for each pivot at most
    radius = np.array([c[1] for c in cells]) * HAIR
    sizes = spark.createDataFrame([(c[0], -(-c[2] // shard_rows)) for c in cells], "cell int, shards int")
    held = placed.join(F.broadcast(sizes), "cell").select("_id", "_v", "cell", F.pmod(F.xxhash64("_id", "_v"), F.col("shards")).cast("int").alias("shard"))
    asked = staged(placed.where("_ask").groupBy("_id").agg(F.min(F.struct("_v", "cell")).alias("q")).select("_id", "q._v", "q.cell"), "vp-queries")
    near = staged(_ask(asked.withColumn("within", F.lit(float("inf"))), held, sizes, k, factor, block_rows), "vp-near")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    bound = near.withColumn("nth", nth).where(F.col("nth") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("within"))
    bounded = asked.join(bound, "_id", "left").select("_id", "_v", F.coalesce("within", F.lit(float("inf"))).alias("within"), "cell")
    index = np.array([c[0] for c in cells], np.int64)
    far = staged(bounded.mapInArrow(_further(pivots, index, radius, factor), "_id long, _v array<double>, within double, cell int"), "vp-further")
    return near.unionAll(_ask(far, held, sizes, k, factor, block_rows))


def nearest_neighbours(
    vectors: DataFrame,
    queries,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    factor: float = 1.0,
    shard_rows: int = 16_384,
    block_rows: int = 1024,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows of the rows for which ``queries`` is true."""
    spark = vectors.sparkSession
    bounded_batches(spark, 10_000)
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v"), F.coalesce(queries, F.lit(False)).alias("_ask"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0))
    rows = staged(rows.where(F.forall("_v", fine) & F.exists("_v", lambda x: x != 0)), "vp-vectors")
    lengths = rows.groupBy(F.size("_v").alias("w")).agg(F.count("*").alias("n"), F.count_if("_ask").alias("asked")).where("asked > 0").orderBy("w").collect()
    found = [_of_length(rows.where(F.size("_v") == r.w), r.n, k, factor, shard_rows, block_rows) for r in lengths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return out.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
