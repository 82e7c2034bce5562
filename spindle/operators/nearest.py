"""Exact nearest neighbours and range searches by pivot cells.

Points go to the cell of their nearest pivot; near cells share a block as long as it fits a task, and a larger cell's rows are dealt
to several.  A query asks its own block first, then with the distance found every other block with a cell that can hold something
nearer: by the triangle inequality one with d(query, pivot) - radius <= bound and (d(query, pivot) - d(query, own pivot)) / 2 <= bound.
So a query is sent once to each block it asks, of which there are as many as the points fill, however many cells the bounds leave.
In a task a block's points come first and stay, the queries stream past them, so that a block of very many queries takes no memory;
where blocks are few, the queries of each are dealt to several tasks, each of which holds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Rows and numbers of a block, and pivots at most.
BLOCK_ROWS, BLOCK_NUMBERS, MOST_PIVOTS = 65_536, 4_194_304, 1024
#: Tasks of a search, if a point's blocks are fewer; and the points that are worth a task.
TASKS, TASK_ROWS = 24, 1024
#: Pairs of rows whose differences are held at once.
PAIRS = 131_072


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances from products, right within ``_slack``."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T, 0))


def _slack(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """What rounding may add up to in three distances of each row of ``x`` to ``pivots``."""
    return 8e-8 * (x.shape[1] + 8) ** 0.5 * (np.sqrt((x**2).sum(1)) + np.sqrt((pivots**2).sum(1).max(initial=0)))


def _shared(pivots: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """The cells of each block: halved by rows along the line between two far pivots until no more than ``most`` rows or one cell are left."""
    todo, done = [np.arange(len(rows))], []
    while todo:
        cells = todo.pop()
        if len(cells) == 1 or rows[cells].sum() <= most:
            done.append(cells)
            continue
        x = pivots[cells]
        one = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
        other = x[((x - one) ** 2).sum(1).argmax()]
        cells = cells[np.argsort(x @ (other - one), kind="stable")]
        upto = rows[cells].cumsum()
        cut = 1 + min(int(np.searchsorted(upto, upto[-1] / 2)), len(cells) - 2)
        todo += [cells[cut:], cells[:cut]]
    return done


@dataclass
class Part:
    """The cells of a part's points, block by block: their pivots and radii, where the blocks' cells start, and how many blocks their rows fill."""

    cells: np.ndarray
    radius: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    blocks: np.ndarray

    @classmethod
    def of(cls, cells: np.ndarray, rows: np.ndarray, radius: np.ndarray, pivots: np.ndarray, most: int, number: int) -> Part:
        shared = _shared(pivots[cells], rows, most)
        order, blocks = np.concatenate(shared), np.array([-(-int(rows[c].sum()) // most) for c in shared])
        return cls(cells[order], radius[order], np.r_[0, np.cumsum([len(c) for c in shared])[:-1]], number + np.r_[0, np.cumsum(blocks)[:-1]], blocks)

    def asked(self, d: np.ndarray, bound: np.ndarray | None, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of the blocks asked by queries at distances ``d`` of all pivots: their own without ``bound``, else the others that it reaches."""
        here = d[:, self.cells]
        own = np.searchsorted(self.starts, here.argmin(1), "right") - 1
        if bound is None:
            rows, shared = np.arange(len(d)), own
        else:
            reach = (bound + slack)[:, None]
            hit = (here - self.radius <= reach) & ((here - d.min(1)[:, None]) / 2 <= reach)
            hit = np.logical_or.reduceat(hit, self.starts, axis=1)
            hit[np.arange(len(d)), own] = False
            rows, shared = np.nonzero(hit)
        times = self.blocks[shared]
        within = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
        return np.repeat(rows, times), np.repeat(self.first[shared], times) + within


def _clean(rows: DataFrame, part: str | None) -> DataFrame:
    """(id, x, part) of rows that take part: not null, without null or non-finite components."""
    x = F.transform("x", lambda v: v.cast("double"))
    wrong = F.col("x").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return rows.where(~wrong & (F.size("x") > 0)).select(F.col("id").cast("long").alias("id"), x.alias("x"), (F.col(part).cast("string") if part else F.lit("")).alias("part"))


class Cells:
    """The points of an index: (id, x, part) with their block, and the cells' radii.

    ``part`` names a column of few values; a query then only meets points with its own. Pivots are points drawn by hash,
    as many as the square root of their number and ``MOST_PIVOTS`` at most.  The driver holds pivots and a row for each (cell, part).
    """

    def __init__(self, points: DataFrame, part: str | None = None, block_rows: int = BLOCK_ROWS, pivots: int | None = None):
        points = _clean(points, part)
        n = points.count()
        self.pivots = np.array([r.x for r in points.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(pivots or int(min(MOST_PIVOTS, max(1, n**0.5)))).collect()])
        self.part, self.table, self.parts, self.blocks = part, None, {}, 0
        if n == 0:
            return
        block_rows = max(1, min(block_rows, BLOCK_NUMBERS // self.pivots.shape[1]))
        table = written(self._with_cells(points), "cells")
        stats = table.groupBy("part", "cell").agg(F.count("*").alias("n"), F.max("own").alias("radius")).orderBy("part", "cell").collect()
        grouped: dict[str, list] = {}
        for r in stats:
            grouped.setdefault(r.part, []).append((r.cell, r.n, r.radius))
        rows = []
        for name, cells in grouped.items():
            cell, count, radius = (np.array(c) for c in zip(*cells))
            p = self.parts[name] = Part.of(cell, count, radius, self.pivots, block_rows, self.blocks)
            self.blocks += int(p.blocks.sum())
            shared = np.searchsorted(p.starts, np.arange(len(p.cells)), "right") - 1
            rows += [(name, int(c), int(p.first[k]), int(p.blocks[k])) for c, k in zip(p.cells, shared)]
        at = table.sparkSession.createDataFrame(rows, "part string, cell int, first long, blocks long")
        self.table = table.join(F.broadcast(at), ["part", "cell"]).select("id", "x", "part", (F.col("first") + F.pmod(F.xxhash64("id", "x"), "blocks")).cast("int").alias("block"))
        self.shares = max(1, min(-(-TASKS // self.blocks), n // (TASK_ROWS * self.blocks)))

    def _with_cells(self, rows: DataFrame) -> DataFrame:
        pivots = self.pivots

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                d = _to_pivots(_matrix(b.column("x")), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype("i4")), pa.array(d[np.arange(len(d)), cell])], [*b.schema.names, "cell", "own"])

        kind = rows.schema.simpleString()[7:-1].replace(":", " ")
        return rows.mapInArrow(put, f"{kind}, cell int, own double")

    def _asked(self, queries: DataFrame, first: bool) -> DataFrame:
        """A row of (id, x, part, bound) for every block that it asks: its own at first, all others that the bound reaches else."""
        pivots, parts = self.pivots, self.parts

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    x, bound = _matrix(b.column("x")), b.column("bound").to_numpy(zero_copy_only=False)
                    d, slack, part = _to_pivots(x, pivots), _slack(x, pivots), np.array(b.column("part").to_pylist(), object)
                    for p in set(part.tolist()) & parts.keys():
                        mine = np.flatnonzero(part == p)
                        rows, blocks = parts[p].asked(d[mine], None if first else bound[mine], slack[mine])
                        for k in range(0, len(rows), 4096):
                            taken = b.take(pa.array(mine[rows[k : k + 4096]]))
                            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(blocks[k : k + 4096].astype("i4"))], [*taken.schema.names, "block"])

        return queries.select("id", "x", "part", "bound").mapInArrow(put, "id long, x array<double>, part string, bound double, block int")

    def _met(self, asked: DataFrame, k: int | None, itself: bool) -> DataFrame:
        """(id, other, d) of what the asked blocks hold within the bound, the ``k`` nearest of each block."""
        shares = self.shares
        key = (F.col("block") * shares + F.col("share")).cast("int").alias("key")
        points = self.table.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        points = points.select(key, F.lit(0).alias("kind"), "id", "x", F.lit(None).cast("double").alias("bound"))
        asked = asked.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(shares))).select(key, F.lit(1).alias("kind"), "id", "x", "bound")
        both = points.unionAll(asked).repartitionById(min(self.blocks * shares, 10_000), F.col("key")).sortWithinPartitions("key", "kind")

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, kept, block = None, [], None
            for b in batches:
                if not b.num_rows:
                    continue
                keys, kinds = b.column("key").to_numpy(), b.column("kind").to_numpy()
                cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1
                for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                    if keys[start] != key:
                        key, kept, block = keys[start], [], None
                    run = b.slice(start, end - start)
                    if kinds[start] == 0:
                        kept.append((run.column("id").to_numpy(), _matrix(run.column("x"))))
                        continue
                    if block is None:
                        if not kept:
                            continue
                        block = Block(np.concatenate([a for a, _ in kept]), np.concatenate([x for _, x in kept]))
                        kept = [(block.ids, block.x)]
                    for at in range(0, run.num_rows, 256):
                        piece = run.slice(at, 256)
                        for found in block.near(piece.column("id").to_numpy(), _matrix(piece.column("x")), piece.column("bound").to_numpy(zero_copy_only=False), k, itself):
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["id", "other", "d"])

        return both.mapInArrow(put, "id long, other long, d double")

    def nearest(self, queries: DataFrame, k: int, itself: bool = False) -> DataFrame:
        """(id, other, d, rank): the ``k`` nearest points (all, if fewer) of each query (id, x), ties to the smaller id.

        Points with the query's id are left out unless ``itself`` is set. Rows without vector, or with null or
        non-finite components, take no part; ids must be distinct, and all vectors as long as each other.
        """
        q = _clean(queries, self.part)
        if self.table is None:
            return q.select("id", F.col("id").alias("other"), F.lit(0.0).alias("d"), F.lit(1).alias("rank")).limit(0)
        q = written(q, "queries")
        found = written(self._best(self._met(self._asked(q.withColumn("bound", F.lit(float("inf"))), True), k, itself), k), "nearest-own")
        if len(self.parts) == sum(len(p.first) for p in self.parts.values()):  # no block but the own one
            return found.select("id", "other", "d", "rank")
        bounds = found.where(F.col("rank") == k).select("id", F.col("d").alias("bound"))
        q = q.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        more = self._met(self._asked(q, False), k, itself)
        return self._best(found.select("id", "other", "d").unionByName(more), k)

    def within(self, queries: DataFrame) -> DataFrame:
        """(id, other, d): all points up to ``bound`` from each query (id, x, bound), the query's own id included."""
        q = _clean(queries, self.part)
        if self.table is None:
            return q.select("id", F.col("id").alias("other"), F.lit(0.0).alias("d")).limit(0)
        q = written(q.join(queries.select("id", F.col("bound").cast("double").alias("bound")), "id"), "queries")
        return self._met(self._asked(q, True).unionByName(self._asked(q, False)), None, True)

    @staticmethod
    def _best(found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


class Block:
    """Points that stay in a task: products about their centre sift, in single precision where its range allows; differences decide."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.centre = ids, x, x.mean(0)
        y = x - self.centre
        norms = (y**2).sum(1)
        self.top = float(norms.max()) ** 0.5
        self.number = np.float32 if 1e-12 < self.top < 1e15 else np.float64
        self.sift = np.ascontiguousarray(np.concatenate([-2 * y, norms[:, None]], axis=1).astype(self.number).T)

    def near(self, qid: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int | None, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, partners, distances) of what lies within the ``bound`` of each query, the ``k`` nearest of it, ties to the smaller id."""
        y = q - self.centre
        norms = (y**2).sum(1)
        number = np.float64 if norms.max() > 1e30 else self.number
        y = np.concatenate([y, np.ones((len(y), 1))], axis=1).astype(number)
        rough = y @ self.sift.astype(number, copy=False)  # less the query's own square
        slack = 4 * (q.shape[1] + 8) * np.finfo(self.number).eps * (np.sqrt(norms) + self.top) ** 2
        limit = bound * bound * (1 + 1e-9) - norms + slack
        least = None if k is None else k if itself else k + 1
        if least is not None and rough.shape[1] > least:
            open_ = np.flatnonzero(np.isinf(limit))
            if len(open_):
                limit[open_] = _least(rough[open_] if len(open_) < len(q) else rough, least) + 2 * slack[open_]
        limit = np.nextafter(limit.astype(number), number(np.inf))[:, None]
        who, may = np.divmod(np.flatnonzero((rough <= limit).ravel()), rough.shape[1])
        upto = np.searchsorted(who, np.arange(len(q) + 1))
        start = 0
        while start < len(q):
            end = max(start + 1, int(np.searchsorted(upto, upto[start] + PAIRS, "right")) - 1)
            row, whom = who[upto[start] : upto[end]], may[upto[start] : upto[end]]
            start = end
            d = np.sqrt(((self.x[whom] - q[row]) ** 2).sum(1))
            keep = d <= bound[row]
            if not itself:
                keep &= self.ids[whom] != qid[row]
            row, whom, d = row[keep], self.ids[whom[keep]], d[keep]
            if k is not None:
                order = np.lexsort((whom, d, row))
                row, whom, d = row[order], whom[order], d[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, whom, d = row[best], whom[best], d[best]
            if len(row):
                yield qid[row], whom, d


def _least(rough: np.ndarray, k: int) -> np.ndarray:
    """A number that ``k`` numbers of each row don't exceed, mostly the least such: of the minima of many runs."""
    m, n = rough.shape
    runs = max(256, 8 * k)
    if n >= 4 * runs:
        rough = rough[:, : n // runs * runs].reshape(m, runs, -1).min(axis=2)
    return np.partition(rough, k - 1, axis=1)[:, k - 1].astype(float)
