"""Merkle manifests of datasets: a tree for each partition (a source, say), and one over their roots.

A leaf is the hash of a row.  The leaves of a partition stand in order and have indices from 0; of every
level, each ``fanout`` consecutive nodes become the hash of their digests, and a short last run is
hashed as it is (nothing is padded), until one node remains, the partition's root.  The roots, in
order of the partitions, have a tree of the same kind above them.

Rows are sorted by ranges and numbered, then cut into chunks of ``chunk_rows`` indices, whichever
trees these belong to.  A task keeps a mountain range for its stretch of each tree: a stack of
peaks.  A pushed leaf carries as in counting to the base ``fanout``: whenever the last node of a run
stands on the stack with its run complete below it, the run becomes its parent, a node record is emitted,
and the parent carries on.  Runs that began in an earlier chunk or end in a later one stay open: a
stretch of any length leaves about 2 * (fanout - 1) peaks a level.  Those peaks alone go on: tasks over
groups of about the square root of the number of chunks push them onto ranges in the same manner, and one
last task merges what the groups left, a few peaks of each.

Proofs come back down the same way: the last task gives each peak that it took its siblings up to the root,
a group's task puts those of its own level below them, and so does the task of each chunk for
its leaves.  No task holds more than a chunk's leaves or a group's peaks, and no node is looked up by a join on its place,
so that nodes which all rows share are no hot keys.

Defined cases: a null column is the field "-", so that it differs from an empty text; rows without
order column come first, equal ones by their hash; repeated rows are leaves each; a null partition is one of its own and the
first; extra columns are ignored; an empty table has neither nodes nor a root.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.joins import ranked
from .common import join_checked, staged, widened

DIGEST = 32


def digest_of(*parts: bytes) -> bytes:
    """The hash of digests, which count as lowercase hex text."""
    return sha256(b"".join(parts).hex().encode()).digest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


class Mountains:
    """Peaks of a stretch of one tree over ``n`` leaves, left to right, as (level, index, digest)."""

    def __init__(self, n: int, fanout: int):
        self.n, self.fanout, self.peaks, self.widths = n, fanout, [], [n]

    def width(self, level: int) -> int:
        while len(self.widths) <= level:
            self.widths.append(-(-self.widths[-1] // self.fanout))
        return self.widths[level]

    def run(self, level: int, index: int) -> tuple[int, int]:
        """(first, last + 1) of the run that the node belongs to."""
        first = index - index % self.fanout
        return first, min(first + self.fanout, self.width(level))

    def is_root(self, level: int) -> bool:
        return self.width(level) == 1

    def push(self, level: int, index: int, digest: bytes):
        """Yields the nodes that this one completes."""
        peaks = self.peaks
        peaks.append((level, index, digest))
        while not self.is_root(level):
            first, end = self.run(level, index)
            k = end - first
            if index != end - 1 or len(peaks) < k or peaks[-k][:2] != (level, first):
                return
            digest = digest_of(*[d for _, _, d in peaks[-k:]])
            del peaks[-k:]
            level, index = level + 1, index // self.fanout
            peaks.append((level, index, digest))
            yield level, index, digest


# ---------------------------------------------------------------- paths

#: A path is a level's (place in the run, siblings) one after the other.
_STEP = struct.Struct("<BB")


def step(place: int, siblings: list[bytes]) -> bytes:
    return _STEP.pack(place, len(siblings)) + b"".join(siblings)


def steps(path: bytes):
    at = 0
    while at < len(path):
        place, n = _STEP.unpack_from(path, at)
        at += 2
        yield place, [path[i : i + DIGEST] for i in range(at, at + n * DIGEST, DIGEST)]
        at += n * DIGEST


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that follows from a leaf and its siblings."""
    for place, siblings in steps(path):
        digest = digest_of(*siblings[:place], digest, *siblings[place:])
    return digest


def siblings_digest(path: bytes) -> bytes:
    return digest_of(*[s for _, siblings in steps(path) for s in siblings])


# ---------------------------------------------------------------- tasks

_MADE = "unit long, tree long, n long, level int, idx long, digest binary, state int"
_MADE_SCHEMA = pa.schema([("unit", pa.int64()), ("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary()), ("state", pa.int32())])
NODE, PEAK, ROOT = 0, 1, 2


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _ordered(table: pa.Table, fanout: int) -> list[tuple]:
    """(tree, n, level, idx, digest, row) of the nodes, from left to right."""
    columns = [table.column(c).to_pylist() for c in ("tree", "n", "level", "idx", "digest")]
    rows = [(*x, i) for i, x in enumerate(zip(*columns))]
    rows.sort(key=lambda r: (r[0], r[3] * fanout ** r[2]))
    return rows


def _grow(fanout: int):
    """A unit's node records, and its peaks or the roots of trees that end in it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        unit, out, held = key[0].as_py(), [], None

        def close(tree: int, held: Mountains) -> None:
            out.extend((unit, tree, held.n, *p, ROOT if held.is_root(p[0]) else PEAK) for p in held.peaks)

        last = None
        for tree, n, level, idx, digest, _ in _ordered(table, fanout):
            if tree != last:
                if held:
                    close(last, held)
                held, last = Mountains(n, fanout), tree
            out.extend((unit, tree, n, *node, NODE) for node in held.push(level, idx, digest))
        if held:
            close(last, held)
        return _table(out, _MADE_SCHEMA)

    return run


_PATH = "unit long, tree long, level int, idx long, path binary, subroot binary"


def _climb(fanout: int, payload: list[str], schema: pa.Schema):
    """The given nodes of a unit with their paths, from the paths of the unit's peaks."""

    def run(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        given = {(t, lv, i): (p, s) for t, lv, i, p, s in zip(*[above.column(c).to_pylist() for c in ("tree", "level", "idx", "path", "subroot")])}
        rows, digests, held, last = _ordered(table, fanout), {}, None, None
        for tree, n, level, idx, digest, _ in rows:
            if tree != last:
                held, last = Mountains(n, fanout), tree
            digests[tree, level, idx] = digest
            digests.update(((tree, lv, i), d) for lv, i, d in held.push(level, idx, digest))
        paths: dict = {}

        def path_of(tree: int, shape: Mountains, level: int, idx: int) -> tuple[bytes, bytes]:
            """Nodes of a run share what lies above it."""
            if got := given.get((tree, level, idx)):
                return got
            parent = (tree, level + 1, idx // fanout)
            if parent not in paths:
                paths[parent] = path_of(tree, shape, level + 1, idx // fanout)
            above_, subroot = paths[parent]
            first, end = shape.run(level, idx)
            return step(idx - first, [digests[tree, level, i] for i in range(first, end) if i != idx]) + above_, subroot

        shape, last, made = None, None, [None] * len(rows)
        for tree, n, level, idx, _, row in rows:
            if tree != last:
                shape, last = Mountains(n, fanout), tree
            made[row] = path_of(tree, shape, level, idx)
        columns = [table.column(c) for c in payload]
        return pa.Table.from_arrays([*columns, pa.array([p for p, _ in made], pa.binary()), pa.array([s for _, s in made], pa.binary())], schema=schema)

    return run


@dataclass
class Forest:
    """Trees over rows (tree, n, idx, digest, chunk and more): the passes' tables, from the chunks to the last merge."""

    rows: DataFrame
    passes: list[DataFrame]
    groups: int
    fanout: int

    @property
    def nodes(self) -> DataFrame:
        """(tree, level, idx, digest) of all inner nodes."""
        out = self.passes[0]
        for made in self.passes[1:]:
            out = out.unionAll(made)
        return out.where(F.col("state") == NODE).select("tree", "level", "idx", "digest")

    @property
    def roots(self) -> DataFrame:
        """(tree, digest), a row for each tree."""
        out = self.passes[0]
        for made in self.passes[1:]:
            out = out.unionAll(made)
        return out.where(F.col("state") == ROOT).select("tree", "digest")

    def paths(self, above: DataFrame) -> DataFrame:
        """``rows`` with path and subroot; ``above`` has (tree, path, subroot): what follows above each tree's root."""
        n_trees = above.count()
        known = None
        for i in (2, 1, 0):
            roots = self.passes[i].where(F.col("state") == ROOT).select("unit", "tree", "level", "idx")
            tops = join_checked(roots, above, ["tree"], "inner", n_trees).select("unit", "tree", "level", "idx", "path", "subroot")
            known = tops if known is None else known.unionByName(tops)
            if i:
                taken = _as_units(self.passes[i - 1].where(F.col("state") == PEAK), i, self.groups)
                payload = ["below", "tree", "level", "idx"]
                schema = pa.schema([("below", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary())])
                down = taken.groupBy("unit").cogroup(known.groupBy("unit")).applyInArrow(_climb(self.fanout, payload, schema), "below long, tree long, level int, idx long, path binary, subroot binary")
                known = staged(down.withColumnRenamed("below", "unit"), "merkle-paths")
        own = self.rows.withColumnRenamed("chunk", "unit").withColumn("level", F.lit(0))
        payload = [c for c in own.columns if c not in ("unit", "level")]
        out = widened(own.select(*payload).schema, path="binary", subroot="binary")
        return own.groupBy("unit").cogroup(known.groupBy("unit")).applyInArrow(_climb(self.fanout, payload, to_arrow_schema(out)), out)


def _as_units(peaks: DataFrame, level: int, groups: int) -> DataFrame:
    unit = F.expr(f"unit div {groups}") if level == 1 else F.lit(0).cast("long")
    return peaks.select(unit.alias("unit"), F.col("unit").alias("below"), "tree", "n", "level", "idx", "digest")


def forest(rows: DataFrame, total: int, fanout: int, chunk_rows: int) -> Forest:
    """``rows``: (pos, tree, n, idx, digest, ...), pos from 0 to ``total`` in the order of tree and idx."""
    rows = rows.withColumn("chunk", F.expr(f"pos div {chunk_rows}")).drop("pos")
    groups = max(2, math.isqrt(max(total // chunk_rows, 1)))
    first = rows.select(F.col("chunk").alias("unit"), "tree", "n", F.lit(0).alias("level"), "idx", "digest")
    passes = [staged(first.groupBy("unit").applyInArrow(_grow(fanout), _MADE), "merkle-chunks")]
    for level in (1, 2):
        peaks = _as_units(passes[-1].where(F.col("state") == PEAK), level, groups)
        passes.append(staged(peaks.groupBy("unit").applyInArrow(_grow(fanout), _MADE), "merkle-peaks"))
    return Forest(rows, passes, groups, fanout)


# ---------------------------------------------------------------- the manifest


@dataclass
class Manifest:
    trees: Forest
    over: Forest | None
    #: (tree, partition, n_leaves, rank): a row for each partition.
    partitions: DataFrame
    root: bytes | None

    def subroots(self) -> DataFrame:
        """(partition, n_leaves, subroot)."""
        return self.partitions.join(self.trees.roots, "tree").select("partition", "n_leaves", F.col("digest").alias("subroot"))

    def proofs(self) -> DataFrame:
        """The leaves' rows with path (see ``steps``), subroot and root."""
        if self.over is None:
            return self.trees.rows.withColumns({"path": F.lit(None).cast("binary"), "subroot": F.lit(None).cast("binary"), "root": F.lit(None).cast("binary")})
        spark = self.partitions.sparkSession
        start = spark.createDataFrame([(0, bytearray(), bytearray(self.root))], "tree long, path binary, subroot binary")
        tops = staged(self.over.paths(start).select("of", "path", F.col("digest").alias("subroot")), "merkle-tops").withColumnRenamed("of", "tree")
        return self.trees.paths(tops).withColumn("root", F.lit(bytearray(self.root)))


def manifest(docs: DataFrame, partition_col: str, order_col: str, digest: Column, payload: dict[str, Column] | None = None, fanout: int = 3, chunk_rows: int = 4096) -> Manifest:
    """The manifest of ``docs``: ``digest`` makes a row's leaf; ``payload`` are columns that the leaves carry along."""
    if not 2 <= fanout <= 256:
        raise ValueError("fanout must be from 2 to 256")
    part = F.col(partition_col).cast("string")
    more = {f"p_{k}": v for k, v in (payload or {}).items()}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s"), part), F.lit("n")).alias("key"), part.alias("partition"), F.col(order_col).alias("at"), digest.alias("digest"),
        *[v.alias(k) for k, v in more.items()], F.monotonically_increasing_id().alias("nth"),
    )
    placed = ranked(leaves, "pos", "key", F.col("at").asc_nulls_first(), "digest", "nth").drop("at", "nth")
    parts = placed.groupBy("key").agg(F.first("partition").alias("partition"), F.min("pos").alias("tree"), F.count("*").alias("n"))
    parts = ranked(parts, "rank", "tree")
    sizes = parts.agg(F.count("*"), F.sum("n")).first()
    n_parts, total = sizes[0], sizes[1] or 0
    rows = join_checked(placed.drop("partition"), parts.select("key", "tree", "n"), ["key"], "inner", n_parts)
    rows = rows.select("pos", "tree", "n", (F.col("pos") - F.col("tree")).alias("idx"), "digest", *more)
    trees = forest(rows, total, fanout, chunk_rows)
    named = parts.select("tree", "partition", F.col("n").alias("n_leaves"), "rank")
    if not total:
        return Manifest(trees, None, named, None)
    tops = named.join(trees.roots, "tree").select(F.col("rank").alias("pos"), F.lit(0).cast("long").alias("tree"), F.lit(n_parts).cast("long").alias("n"), F.col("rank").alias("idx"), "digest", F.col("tree").alias("of"))
    over = forest(staged(tops, "merkle-roots"), n_parts, fanout, chunk_rows)
    return Manifest(trees, over, named, bytes(over.roots.first()["digest"]))


def checked(proofs: DataFrame, presented: str) -> DataFrame:
    """``proofs`` with proof (the siblings' digest), folded (the root that the digests in ``presented`` give) and verified."""
    out = widened(proofs.schema, proof="binary", folded="binary", verified="boolean")

    def run(batches):
        for batch in batches:
            paths, leaves, roots = (batch.column(c).to_pylist() for c in ("path", presented, "root"))
            proof = [siblings_digest(p) for p in paths]
            fold = [folded(x, p) for x, p in zip(leaves, paths)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(proof, pa.binary()), pa.array(fold, pa.binary()), pa.array([a == b for a, b in zip(fold, roots)], pa.bool_())],
                [*batch.schema.names, "proof", "folded", "verified"],
            )

    return proofs.mapInArrow(run, out)


def audited(docs: DataFrame, columns: list[str], presented: list[Column], partition_col: str = "source", order_col: str = "doc_id", fanout: int = 3, chunk_rows: int = 4096) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded, verified), all digests as hex: does each row as ``presented`` still prove to be the manifest's?"""
    digest = leaf_digest(*[F.col(c) for c in columns])
    made = manifest(docs, partition_col, order_col, digest, {"id": F.col(order_col), "shown": leaf_digest(*presented)}, fanout, chunk_rows)
    out = checked(made.proofs(), "p_shown")
    hexed = lambda c: F.lower(F.hex(c))
    return out.select(F.col("p_id").alias(order_col), hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"), hexed("proof").alias("proof"), hexed("folded").alias("folded"), "verified")
