"""Tall matrices as tables (id, v: array of double), one row for each node, and what iterates on them.

A sparse matrix is an edge table; its product with a tall one is a join on the edges' far end, sums
within the batches that come out of it, and a second pass that adds up each node's runs.  Small
matrices, of the width of ``v``, go to the tasks with the function that needs them and come back as
sums over all rows.  Nothing but such sums reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..session import written

TALL = "id long, v array<double>"
#: The same in single precision, for tables and shuffles of iterations that need no more.
SINGLE = "id long, v array<float>"


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long arrays, or a column of numbers as it is."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def arrays(rows: np.ndarray) -> pa.Array:
    n, k = rows.shape
    kind = np.float32 if rows.dtype == np.float32 else np.float64
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(rows, kind).ravel()))


def bounded_batches(spark: SparkSession, size: int = 32 << 20) -> None:
    """Arrow batches of so many bytes: rows may be wide."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def _tall(ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), arrays(rows)], ["id", "v"])


def _within(batches):
    """(src, weight, v): weighted sums of each batch by src."""
    for b in batches:
        if not b.num_rows:
            continue
        ids, inverse = np.unique(matrix(b.column("src")), return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        starts = np.searchsorted(inverse[order], np.arange(len(ids)))
        v = matrix(b.column("v"))
        yield _tall(ids, np.add.reduceat(_weighted(matrix(b.column("weight")), v)[order], starts, axis=0).astype(v.dtype))


def _weighted(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows of ``v`` times a number each, or, as matrices of d rows, times a d x d block each."""
    if w.ndim == 1:
        return v * w[:, None]
    d = math.isqrt(w.shape[1])
    return (w.reshape(-1, d, d) @ v.reshape(len(v), d, -1)).reshape(len(v), -1)


def _runs(batches):
    """Sums of the runs of equal ids, in sorted partitions; a run may go on in the next batch."""
    held, last = None, None
    for b in batches:
        if not b.num_rows:
            continue
        ids, v = matrix(b.column("id")), matrix(b.column("v"))
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        keys, sums = ids[starts], np.add.reduceat(v, starts, axis=0)
        if held is not None:
            if keys[0] == last:
                sums[0] += held
            else:
                keys, sums = np.r_[last, keys], np.vstack([held, sums])
        last, held = keys[-1], sums[-1].copy()
        if len(keys) > 1:
            yield _tall(keys[:-1], sums[:-1])
    if held is not None:
        yield _tall(np.array([last]), held[None])


def summed(parts: DataFrame) -> DataFrame:
    """(id, v): the weighted sums of ``parts`` (src, weight, v) by src."""
    kind = SINGLE if parts.schema["v"].dataType.elementType == FloatType() else TALL
    made = parts.select("src", "weight", "v").mapInArrow(_within, kind)
    return made.repartition("id").sortWithinPartitions("id").mapInArrow(_runs, kind)


@dataclass
class Sparse:
    """A matrix of rows (src, dst, weight); columns of very many entries are joined apart from the rest.

    A weight is a number, or a d x d block as an array; then a row of a tall matrix holds d rows.
    """

    rows: DataFrame
    hot: DataFrame | None

    @classmethod
    def of(cls, edges: DataFrame, parts: int = 500, small: int = 200_000) -> Sparse:
        rows = written(edges.select("src", "dst", "weight"), "sparse")
        total = rows.count()
        if total <= small:
            return cls(rows, None)
        hot = written(rows.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") > max(1000, total // parts)).select("dst"), "sparse-hot")  # parts rows at most
        return cls(rows, hot) if hot.count() else cls(rows, None)

    def times(self, y: DataFrame) -> DataFrame:
        """The product with the tall matrix ``y``; rows of zeros may be missing."""
        right = y.select(F.col("id").alias("dst"), "v")
        if self.hot is None:
            return summed(self.rows.join(right, "dst"))
        hot = F.broadcast(self.hot)
        few = self.rows.join(hot, "dst", "left_semi").join(F.broadcast(right.join(hot, "dst", "left_semi")), "dst")
        return summed(few.unionByName(self.rows.join(hot, "dst", "left_anti").join(right, "dst")))


#: Most rows of a block of ``Blocks``; of few rows a sixteenth, but not under 4096.
BLOCK_ROWS = 32_768


def _added(y: np.ndarray, places: np.ndarray, weights: np.ndarray, rows: Callable[[np.ndarray], np.ndarray], step: int = 16_384) -> None:
    """y[places] += weights * rows, where ``rows`` makes the rows of some of the entries; ``step`` entries are held at once."""
    order = np.argsort(places, kind="stable")
    for k in range(0, len(order), step):
        some = order[k : k + step]
        at = places[some]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        y[at[starts]] += np.add.reduceat(rows(some) * weights[some, None].astype(y.dtype), starts, axis=0)


def _lists(b: pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    """(row, values of each column): the entries of equally long lists side by side."""
    columns = [b.column(c) for c in names]
    count = columns[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(count)), count), *[c.flatten().to_numpy(zero_copy_only=False) for c in columns]


@dataclass
class Blocks:
    """A matrix over the places 0 .. ``n`` - 1 by blocks of ``size`` rows each, for products with wide rows.

    ``columns`` has a row (block, dst, places, weights) for each column with entries in a block.  So a row of a tall matrix is sent once
    to each block that needs it and not once for each entry, and a block's sums are made by one task, which holds ``size`` rows.
    """

    columns: DataFrame
    n: int
    size: int

    @classmethod
    def of(cls, edges: DataFrame, n: int, size: int | None = None) -> Blocks:
        size = size or min(BLOCK_ROWS, max(4096, -(-n // 16)))
        block, place = F.floor(F.col("src") / size).cast("int"), (F.col("src") % size).cast("int")
        entries = edges.select(block.alias("block"), "dst", place.alias("place"), "weight")
        lists = entries.groupBy("block", "dst").agg(F.collect_list(F.struct("place", "weight")).alias("e"))
        return cls(written(lists.select("block", "dst", F.col("e.place").alias("places"), F.col("e.weight").alias("weights")), "blocks"), n, size)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` (block, ...), a partition a block."""
        return rows.repartitionById(max(1, -(-self.n // self.size)), F.col("block"))

    def _summed(self, rows: DataFrame, width: int, kind: str, entries: Callable) -> DataFrame:
        """(id, v): the sums of a block's ``rows``, of whose batches ``entries`` makes (places, weights, function of rows)."""
        n, size, number = self.n, self.size, np.float32 if kind == "float" else np.float64

        def run(batches):
            y, block = None, None
            for b in batches:
                if b.num_rows:
                    if y is None:
                        block = b.column("block")[0].as_py()
                        y = np.zeros((min(size, n - block * size), width), number)
                    _added(y, *entries(b))
            for k in range(0, 0 if y is None else len(y), 4096):
                yield _tall(np.arange(k, min(k + 4096, len(y))) + block * size, y[k : k + 4096])

        return self._dealt(rows).mapInArrow(run, SINGLE if kind == "float" else TALL)

    def times(self, y: DataFrame) -> DataFrame:
        """The product with the tall matrix ``y``; blocks of zeros may be missing."""
        kind = y.schema["v"].dataType.elementType.typeName()
        width = len((y.select("v").first() or [[]])[0])
        number = np.float32 if kind == "float" else np.float64

        def entries(b):
            v = matrix(b.column("v")).astype(number, copy=False)
            row, places, weights = _lists(b, "places", "weights")
            return places, weights, lambda some: v[row[some]]

        return self._summed(self.columns.join(y.select(F.col("id").alias("dst"), "v").hint("merge"), "dst"), width, kind, entries)

    def signed(self, ends: DataFrame, words: int, kind: str) -> DataFrame:
        """(id, v): sums over ``ends`` (id, weight, bits) of the weight times 64 * ``words`` signs, the bits of so many longs."""
        block, place = F.floor(F.col("id") / self.size).cast("int"), (F.col("id") % self.size).cast("int")
        number = np.float32 if kind == "float" else np.float64

        def entries(b):
            bits = matrix(b.column("bits"))
            signs = lambda some: ((bits[some][:, :, None] >> np.arange(64) & 1) * number(2) - number(1)).reshape(len(some), -1).astype(number)
            return matrix(b.column("place")), matrix(b.column("weight")), signs

        return self._summed(ends.select(block.alias("block"), place.alias("place"), "weight", "bits"), 64 * words, kind, entries)

    def apart(self, z: DataFrame) -> DataFrame:
        """(src, dst, weight, r): the squared distance of the rows of ``z`` at both ends of every entry with src < dst."""
        n, size = self.n, self.size
        block = F.floor(F.col("id") / size).cast("int")
        own = z.select(block.alias("block"), F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<double>").alias("weights"))
        far = self.columns.join(z.withColumnRenamed("id", "dst").hint("merge"), "dst").select("block", F.lit(1).alias("kind"), F.col("dst").alias("id"), "v", "places", "weights")

        def run(batches):
            near = None
            for b in batches:
                if not b.num_rows:
                    continue
                first = b.column("block")[0].as_py() * size
                ids, v, kind = matrix(b.column("id")), matrix(b.column("v")), matrix(b.column("kind"))
                if near is None:
                    near = np.zeros((min(size, n - first), v.shape[1]), v.dtype)
                near[ids[kind == 0] - first] = v[kind == 0]
                row, places, weights = _lists(b, "places", "weights")
                kept = places + first < ids[row]
                row, places, weights = row[kept], places[kept], weights[kept]
                for k in range(0, len(row), 16_384):
                    i, j = places[k : k + 16_384], row[k : k + 16_384]
                    r = ((near[i].astype(float) - v[j]) ** 2).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64) + first), pa.array(ids[j]), pa.array(weights[k : k + 16_384]), pa.array(r)], ["src", "dst", "weight", "r"])

        return self._dealt(own.unionByName(far)).sortWithinPartitions("kind").mapInArrow(run, "src long, dst long, weight double, r double")


def each(df: DataFrame, f: Callable, *columns: str, keep: tuple[str, ...] = ("id",), out: tuple[str, ...] = ("v",), kind: str = "double") -> DataFrame:
    """``keep`` and the arrays ``out`` of ``kind`` double or float that ``f`` makes of a batch's ``columns``."""
    schema = ", ".join([*[f"{c} {df.schema[c].dataType.simpleString()}" for c in keep], *[f"{c} array<{kind}>" for c in out]])
    number = np.float32 if kind == "float" else np.float64

    def run(batches):
        for b in batches:
            if b.num_rows:
                made = f(*[matrix(b.column(c)) for c in columns])
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[arrays(np.asarray(x, number)) for x in (made if isinstance(made, tuple) else (made,))]], [*keep, *out])

    return df.mapInArrow(run, schema)


def total(df: DataFrame, f: Callable, shape: tuple[int, ...], *columns: str) -> np.ndarray:
    """The sum over all batches of the small array that ``f`` makes of each."""

    def run(batches):
        made = None
        for b in batches:
            if b.num_rows:
                x = np.asarray(f(*[matrix(b.column(c)) for c in columns]), np.float64)
                made = x if made is None else made + x
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(made.size, dtype=np.int32)), pa.array(made.ravel())], ["at", "value"])

    out = np.zeros(math.prod(shape))
    for r in df.select(*columns).mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out.reshape(shape)


def normal(ids: DataFrame, k: int, seed: int) -> DataFrame:
    """A tall matrix of standard normal numbers, the same for an id on every run."""
    return each(ids.select("id"), lambda i: np.stack([np.random.default_rng((seed, int(x) & (2**63 - 1))).standard_normal(k) for x in i]), "id")


# ---------------------------------------------------------------- singular vectors


#: Products of a cycle at most, after which all blocks are gathered; and their columns, the square of which reaches the driver.
CYCLE, COLUMNS = 8, 512


def _gathered(blocks: list[DataFrame], width: int, single: bool) -> DataFrame:
    """(id, v): the rows of all ``blocks`` (id, v of ``width`` numbers) side by side, zeros where a block has none."""
    n_blocks, number = len(blocks), np.float32 if single else np.float64

    def run(batches):
        ids, at, v = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, width), number)

        def side_by_side(ids, at, v):
            keys, row = np.unique(ids, return_inverse=True)
            out = np.zeros((len(keys), n_blocks, width), number)
            out[row, at] = v
            return _tall(keys, out.reshape(len(keys), -1))

        for b in batches:
            if not b.num_rows:
                continue
            ids, at, v = np.r_[ids, matrix(b.column("id"))], np.r_[at, matrix(b.column("at"))], np.vstack([v, matrix(b.column("v"))])
            whole = np.searchsorted(ids, ids[-1])  # the last id may go on in the next batch
            if whole:
                yield side_by_side(ids[:whole], at[:whole], v[:whole])
                ids, at, v = ids[whole:], at[whole:], v[whole:]
        if len(ids):
            yield side_by_side(ids, at, v)

    rows = [block.select("id", F.lit(k).alias("at"), "v") for k, block in enumerate(blocks)]
    return reduce(DataFrame.unionAll, rows).repartition("id").sortWithinPartitions("id").mapInArrow(run, SINGLE if single else TALL)


def _orthonormal(gram: np.ndarray, least: float = 1e-14) -> np.ndarray:
    """The matrix that makes columns of this Gram matrix orthonormal, zero for directions whose square is under ``least`` of the largest."""
    square, turned = np.linalg.eigh((gram + gram.T) / 2)
    square, turned = square[::-1], turned[:, ::-1]
    kept = square > max(square.max(initial=0), 1e-300) * least
    return turned * np.where(kept, 1 / np.sqrt(np.where(kept, square, 1.0)), 0.0)


def _ritz(gram: np.ndarray, bases: list[np.ndarray], width: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, columns, residuals), largest absolute value first, of the space of all blocks but the last.

    ``gram`` is that of the blocks [Q, Y1, ...] with Y1 = A Q and Yj+1 = A Yj Bj, ``bases`` are the identity and the Bj.
    """
    n = len(bases) * width
    space, image = np.zeros((n + width, n)), np.eye(n + width, n, -width)
    for j, basis in enumerate(bases):
        space[j * width : (j + 1) * width, j * width : (j + 1) * width] = basis
    gram = gram[: n + width, : n + width]
    own = _orthonormal(space.T @ gram @ space, least)
    own = own[:, own.any(axis=0)]
    inner = own.T @ space.T @ gram @ image @ own
    values, turned = np.linalg.eigh((inner + inner.T) / 2)
    first = np.argsort(-np.abs(values), kind="stable")[:width]
    first = first[np.abs(values[first]) > max(np.abs(values).max(initial=0), 1e-300) * 1e-7]
    values, columns = values[first], space @ own @ turned[:, first]
    off = image @ own @ turned[:, first] - columns * values
    apart = np.sqrt(np.maximum((off * (gram @ off)).sum(axis=0), 0))
    few = (0, width - len(first))
    return np.pad(np.abs(values), few), np.pad(columns, ((0, 0), few)), np.pad(apart, few)


def singular_vectors(a: Sparse, ids: DataFrame, k: int, spare: int = 4, rounds: int = 60, tolerance: float = 1e-6, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """((id, v), values): the ``k`` leading left singular vectors and values of a symmetric matrix, by a block Krylov method.

    A cycle takes up to ``CYCLE`` products by joins, Y = A Q, whose small Gram matrix gives the next Q; then all blocks are gathered
    by id, and the best vectors of their common space start the next cycle.  With a ``tolerance`` of 1e-7
    or more blocks are kept and sent in single precision; sums are made in double.  ``spare`` more columns speed it up.  It ends
    when a cycle's last product moves no value of the ``k`` by over ``tolerance`` of the largest one and no A u is farther from its
    multiple of u than the root of ``tolerance`` of it, and tells if ``rounds`` products weren't enough.
    """
    import warnings

    width = min(k + spare, ids.count())
    bounded_batches(ids.sparkSession)
    gram = lambda y, n: total(y, lambda v: (v := v.astype(float)).T @ v, (n, n), "v")
    single = tolerance >= 1e-7
    kind, least = ("float", 1e-9) if single else ("double", 1e-11)  # directions below that hold rounding
    cycle = max(2, min(CYCLE, COLUMNS // width - 1))
    x = written(a.times(normal(ids, width, seed)), "subspace")
    basis, values = _orthonormal(gram(x, width)), np.zeros(width)
    if not basis.any():
        return each(ids, lambda i: np.zeros((len(i), k)), "id"), np.zeros(k)
    for _ in range(max(1, rounds // cycle)):
        q = each(x, lambda v, m=basis: v @ m, "v", kind=kind)
        blocks, bases = [q], [np.eye(width)]
        for step in range(cycle):
            blocks.append(written(a.times(q), "subspace"))
            if step < cycle - 1:
                bases.append(_orthonormal(gram(blocks[-1], width)))
                q = each(blocks[-1], lambda v, m=bases[-1]: v @ m, "v", kind=kind)
        every = written(_gathered(blocks, width, single), "krylov")
        whole = gram(every, width * len(blocks))
        before = _ritz(whole, bases[:-1], width, least)[0]
        values, columns, apart = _ritz(whole, bases, width, least)
        x = written(each(every, lambda v, m=columns: v @ m, "v"), "subspace")
        # Rounding leaves the columns not quite orthonormal; the symmetric root moves them least.
        square, turned = np.linalg.eigh(gram(x, width))
        basis = turned * np.where(square > 0.5, 1 / np.sqrt(np.maximum(square, 0.5)), 0.0) @ turned.T
        if np.abs(values - before)[:k].max() <= tolerance * values[0] and apart[:k].max() <= tolerance**0.5 * values[0]:
            break
    else:
        warnings.warn(f"singular values still move after {rounds} rounds", stacklevel=2)
    few = (0, max(0, k - width))
    values, basis = np.pad(values[:k], few), np.pad(basis[:, :k], ((0, 0), few))
    q = each(x, lambda v: v @ basis, "v")
    # One sign on every run: the largest component is positive, of equal ones that of the smallest id.
    top = q.agg(*[F.max(F.struct(F.abs(F.col("v")[j]), -F.col("id"), F.col("v")[j])).alias(f"t{j}") for j in range(k)]).first()
    signs = np.array([-1.0 if t is not None and t[2] < 0 else 1.0 for t in top])
    return each(ids.join(q, "id", "left").select("id", F.coalesce("v", F.array(*[F.lit(0.0)] * k)).alias("v")), lambda v: v * signs, "v"), values


#: A block's number stands in an id above so many bits.
BLOCK_BITS = 40


def _by_block(ids: np.ndarray):
    """(block, places) of the rows of each block."""
    blocks = ids >> BLOCK_BITS
    for block in np.unique(blocks).tolist():
        yield block, blocks == block


def _grams(y: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Y'Y of each block: width^2 numbers a block reach the driver."""

    def run(batches):
        made: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v"))
                for block, rows in _by_block(matrix(b.column("id"))):
                    made[block] = made.get(block, 0.0) + v[rows].T @ v[rows]
        for block, gram in made.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(gram.size, block)), pa.array(np.arange(gram.size, dtype=np.int32)), pa.array(gram.ravel())], ["block", "at", "value"])

    out: dict[int, np.ndarray] = {}
    for r in y.select("id", "v").mapInArrow(run, "block long, at int, value double").groupBy("block", "at").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r["block"], np.zeros(width * width))[r["at"]] = r["value"]
    return {block: gram.reshape(width, width) for block, gram in out.items()}


def _turned(y: DataFrame, bases: dict[int, np.ndarray]) -> DataFrame:
    """Every row times its block's matrix."""

    def run(ids, v):
        out = np.zeros((len(ids), next(iter(bases.values())).shape[1]))
        for block, rows in _by_block(ids):
            out[rows] = v[rows] @ bases[block]
        return out

    return each(y, run, "id", "v")


def singular_vectors_of_blocks(a: Sparse, ids: DataFrame, k: int, spare: int = 16, rounds: int = 60, tolerance: float = 1e-6, seed: int = 0) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``singular_vectors`` of all diagonal blocks of a symmetric matrix at once: ((id, v), values by block); blocks without entries have none.

    An id holds its block's number above ``BLOCK_BITS`` bits, and no entry lies between blocks.
    """
    import warnings

    width = k + spare
    q, values = normal(ids, width, seed), {}
    for turn in range(rounds):
        y = written(a.times(q), "subspace")
        before, values, bases = values, {}, {}
        for block, gram in _grams(y, width).items():
            square, turned = np.linalg.eigh((gram + gram.T) / 2)
            now, turned = np.sqrt(np.maximum(square[::-1], 0)), turned[:, ::-1]
            kept = now > max(now.max(initial=0), 1e-300) * 1e-7
            bases[block] = turned * np.where(kept, 1 / np.where(kept, now, 1.0), 0.0)
            values[block] = np.where(kept, now, 0.0)[:k]
        if not bases:
            break
        q = _turned(y, bases)
        if turn > 1 and all(np.abs(v - before.get(block, 0.0)).max() <= tolerance * v[0] for block, v in values.items()):
            break
    else:
        warnings.warn(f"singular values still move after {rounds} rounds", stacklevel=2)
    zero = F.array(*[F.lit(0.0)] * k)
    if not values:
        return ids.select("id", zero.alias("v")), values
    q = written(each(q, lambda v: v[:, :k], "v"), "subspace")
    top = q.groupBy(F.shiftright("id", BLOCK_BITS).alias("block")).agg(*[F.max(F.struct(F.abs(F.col("v")[j]), -F.col("id"), F.col("v")[j])).alias(f"t{j}") for j in range(k)]).collect()
    signs = {r["block"]: np.diag([-1.0 if r[f"t{j}"][2] < 0 else 1.0 for j in range(k)]) for r in top}
    return ids.join(_turned(q, signs), "id", "left").select("id", F.coalesce("v", zero).alias("v")), values


# ---------------------------------------------------------------- linear systems


def solved(a: Sparse | Blocks, diagonal: DataFrame, b: DataFrame, width: int, tolerance: float = 1e-6, rounds: int = 1000, kind: str = "double") -> DataFrame:
    """(id, v): A x = b for ``width`` columns at once by conjugate gradients, preconditioned by the diagonal (id, d).

    A is symmetric and positive semidefinite and b in its range.  Every round writes one table and sums two numbers a column.
    Tables and products are of ``kind``, the sums over all rows in double precision.
    """
    zero = F.array(*[F.lit(0.0)] * width).cast(f"array<{kind}>")
    start = diagonal.join(b.hint("merge"), "id", "left").select("id", "d", F.coalesce("v", zero).alias("r"))
    start = each(start, lambda r, d: (np.zeros_like(r), r, r / np.maximum(d, 1e-300)[:, None]), "r", "d", keep=("id", "d"), out=("x", "r", "p"), kind=kind)
    state = written(start, "cg")
    rz = total(state, lambda r, p: (r * p).sum(axis=0, dtype=float), (width,), "r", "p")
    first = np.maximum(rz, 1e-300)
    for _ in range(rounds):
        active = rz > tolerance**2 * first
        if not active.any():
            return state.select("id", F.col("x").alias("v"))
        q = a.times(state.select("id", F.col("p").alias("v")))
        step = written(state.join(q.withColumnRenamed("v", "q").hint("merge"), "id", "left").withColumn("q", F.coalesce("q", zero)), "cg-step")

        pq = total(step, lambda p, q: (p * q).sum(axis=0, dtype=float), (width,), "p", "q")
        # Columns that are solved stand still: what is left of them is rounding.
        going = active & (pq > 1e-12 * rz)
        alpha = np.where(going, rz / np.where(going, pq, 1.0), 0.0)
        # What follows is made of the written step as it is read, so it needs no table of its own.
        residual = lambda r, q, d, alpha=alpha: ((r - alpha * q) ** 2 / np.maximum(d, 1e-300)[:, None]).sum(axis=0)
        after = total(step, residual, (width,), "r", "q", "d")
        beta = np.where(going, after / np.maximum(rz, 1e-300), 0.0)

        def update(x, r, p, q, d, alpha=alpha, beta=beta):
            r = r - alpha * q
            return x + alpha * p, r, r / np.maximum(d, 1e-300)[:, None] + beta * p

        state = each(step, update, "x", "r", "p", "q", "d", keep=("id", "d"), out=("x", "r", "p"), kind=kind)
        rz = np.where(going, after, 0.0)
    raise ArithmeticError(f"no solution within {rounds} rounds")


def laplacian(edges: DataFrame, n: int | None = None) -> tuple[Sparse | Blocks, DataFrame]:
    """(matrix, diagonal) of an undirected graph that holds both directions; by blocks if its nodes are the places 0 .. ``n`` - 1."""
    degree = written(edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("d")), "degrees")
    off = edges.select("src", "dst", (-F.col("weight")).alias("weight"))
    rows = off.unionByName(degree.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("d").alias("weight")))
    return Sparse.of(rows) if n is None else Blocks.of(rows, n), degree
