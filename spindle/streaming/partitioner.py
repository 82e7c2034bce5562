"""A streaming partitioner of edge feeds, and windowed counts of edge events.

Edges come in micro-batches.  Each batch is taken in order of ``edge_seq`` by one fold: a free
source goes to the least loaded cluster with room (lowest number first), a free target to its
source's cluster if that has room, else to the least loaded one.  The state, clusters of nodes,
is a table for each batch below ``path``; a batch that is replayed after a failure starts from
the state before it, so its result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def loads(state: dict[int, int], k: int) -> np.ndarray:
    return np.bincount(np.fromiter(state.values(), int, len(state)), minlength=k) if state else np.zeros(k, int)


def fold(state: dict[int, int], edges: np.ndarray, n: int, k: int, load_limit: float = 1.1, load: np.ndarray | None = None) -> dict[int, int]:
    """``state`` after ``edges``; ``load``, that of each cluster, is kept up to date if it is given."""
    most = max(1.0, load_limit * n / k)
    load = loads(state, k) if load is None else load

    def least() -> int:
        return int(np.argmin(np.where(load < most, load, np.iinfo(int).max)))

    for s, d in edges.tolist():
        if s not in state:
            state[s] = least()
            load[state[s]] += 1
        if d not in state:
            state[d] = state[s] if load[state[s]] < most else least()
            load[state[d]] += 1
    return state


def _folded(n, k, load_limit):
    def run(batches):
        state: dict[int, int] = {}
        load = None
        for b in batches:
            kind, a, c = (b.column(x).to_numpy() for x in ("kind", "a", "b"))
            state.update(zip(a[kind == 0].tolist(), c[kind == 0].tolist()))
            if (kind == 1).any():
                load = loads(state, k) if load is None else load
                fold(state, np.stack([a[kind == 1], c[kind == 1]], axis=1), n, k, load_limit, load)
        names, clusters = np.fromiter(state, np.int64, len(state)), np.fromiter(state.values(), np.int64, len(state))
        for at in range(0, len(names), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(names[at : at + (1 << 16)]), pa.array(clusters[at : at + (1 << 16)])], ["id", "cluster"])

    return run


def _telling(batch: DataFrame) -> DataFrame:
    """Edges of ``batch`` that hold a node for the first time; all others leave the fold's state as it is."""
    ends = batch.select(F.col("src").alias("id"), "edge_seq").unionAll(batch.select("dst", "edge_seq"))
    first = ends.groupBy("id").agg(F.min("edge_seq").alias("first"))
    for end in ("src", "dst"):
        batch = batch.join(first.select(F.col("id").alias(end), F.col("first").alias(f"{end}_first")), end)
    return batch.where("edge_seq = src_first or edge_seq = dst_first").select("edge_seq", "src", "dst")


def step(state: DataFrame | None, batch: DataFrame, n: int, k: int, load_limit: float = 1.1) -> DataFrame:
    """(id, cluster) after ``batch`` (edge_seq, src, dst).

    The fold is one task: it needs all loads at every new node. It gets the state and, in order, at most one edge for each
    node of the batch, as a sorted stream of which it holds an Arrow batch and the clusters of the nodes.
    """
    rows = _telling(batch.select("edge_seq", "src", "dst")).select(F.lit(1).alias("kind"), F.col("edge_seq").alias("seq"), F.col("src").alias("a"), F.col("dst").alias("b"))
    if state is not None:
        rows = rows.unionByName(state.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), F.col("id").alias("a"), F.col("cluster").alias("b")))
    return rows.repartition(1).sortWithinPartitions("kind", "seq").mapInArrow(_folded(n, k, load_limit), "id long, cluster long")


def assign_rest(nodes: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """Nodes without edges are dealt over the clusters."""
    from ..operators.joins import ranked

    free = ranked(nodes.select("id").join(state, "id", "left_anti"), "n", "id")
    return state.select("id", "cluster").unionByName(free.select("id", F.pmod("n", F.lit(k)).cast("long").alias("cluster")))


def partition_stream(stream: DataFrame, path: str, n: int, k: int, load_limit: float = 1.1, checkpoint: str | None = None):
    """Start the query; the newest state is ``latest(spark, path)``."""
    spark = stream.sparkSession

    def take(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.parquet(f"{path}/state{batch_id - 1}") if batch_id else None
        step(before, batch, n, k, load_limit).write.mode("overwrite").parquet(f"{path}/state{batch_id}")
        spark.createDataFrame([(batch_id,)], "batch long").write.mode("append").parquet(f"{path}/done")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(availableNow=True).start()


def write_stream_patches(edges: DataFrame, state: DataFrame, path: str, overlap: bool = True) -> DataFrame:
    """Patches of a partitioned stream below ``path``: clusters, both directions of the edges, and each patch's nodes and edges.

    With ``overlap`` a patch also holds the nodes just across its border, so that patches that
    touch share nodes. Returns the patch graph (src, dst, n): shared nodes of every pair.
    """
    from ..operators.patching import overlap_sizes
    from ..session import written

    both = written(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "stream-edges")
    own = state.select(F.col("cluster").alias("patch_id"), F.col("id").alias("node_id"))
    members = own
    if overlap:
        border = both.join(state.select(F.col("id").alias("src"), F.col("cluster").alias("patch_id")), "src").select("patch_id", F.col("dst").alias("node_id"))
        members = own.unionByName(border).distinct()
    members = written(members, "stream-members")
    inner = both.join(members.withColumnRenamed("node_id", "src"), "src").join(members.withColumnRenamed("node_id", "dst"), ["patch_id", "dst"]).select("patch_id", "src", "dst")
    both.write.mode("overwrite").parquet(f"{path}/edges")
    state.select("id", "cluster").write.mode("overwrite").parquet(f"{path}/clusters")
    members.write.mode("overwrite").partitionBy("patch_id").parquet(f"{path}/members")
    inner.write.mode("overwrite").partitionBy("patch_id").parquet(f"{path}/patch_edges")
    return overlap_sizes(members).select(F.col("i").alias("src"), F.col("j").alias("dst"), "n")


class LazyPatch:
    """One patch of those that ``write_stream_patches`` wrote; its tables are read when they are asked for."""

    def __init__(self, spark: SparkSession, path: str, patch_id: int):
        self.spark, self.path, self.patch_id = spark, path, patch_id

    def _part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("patch_id") == self.patch_id).drop("patch_id")

    @property
    def nodes(self) -> DataFrame:
        return self._part("members").select("node_id")

    @property
    def edges(self) -> DataFrame:
        return self._part("patch_edges")

    @property
    def coordinates(self) -> DataFrame:
        rows = self._part("members")
        if "coord" not in rows.columns:
            raise ValueError("this patch was written without coordinates")
        return rows.select("node_id", "coord")

    def graph(self):
        from ..graph import Graph

        return Graph.from_edges(self.edges, self.nodes.select(F.col("node_id").alias("id")))


def latest(spark: SparkSession, path: str) -> DataFrame:
    (batch,) = spark.read.parquet(f"{path}/done").agg(F.max("batch")).first()
    return spark.read.parquet(f"{path}/state{batch}")


def windowed_edges(events: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, src, n) of edge events in tumbling windows; late rows beyond the watermark are dropped in a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "src").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "src", "n")
