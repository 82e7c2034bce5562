"""A streaming partitioner whose state is keyed by node: no task, group or driver holds all nodes.

A micro-batch is admitted in bulk.  A node's first event in the batch decides: a free source is dealt to the least loaded
cluster, a free target wants the cluster of its source, which may itself be new (chains of these are resolved by pointer
jumping).  Wishes are admitted in the order of events up to each cluster's room, the others are dealt again.  The driver sees loads:
one number a cluster.  With one edge a batch this is the rule of ``partitioner.fold``.

Each batch writes the clusters of its new nodes as a table of its own, below ``path`` by batch number, so that a batch that is
replayed after a failure writes the same again.  Late and repeated edges never move a node that has a cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_heavy, ranked
from ..session import written

STATE = "id long, cluster long"


def filled(load: np.ndarray, most: int, n: int) -> np.ndarray:
    """How many of ``n`` nodes each cluster takes if every one goes to the least loaded with room (lowest number first); all clusters full: to the least loaded."""
    load = load.astype(np.int64)
    inside = int(min(n, np.maximum(most - load, 0).sum()))
    taken = lambda level: np.maximum(np.minimum(level, most) - load, 0)
    low, high = int(load.min()), max(int(load.max()), most) + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if taken(mid).sum() <= inside else (low, mid)
    give = taken(low)
    give[np.flatnonzero((load + give == low) & (low < most))[: inside - int(give.sum())]] += 1
    if n > inside:
        give = give + filled(load + give, int((load + give).max()) + n, n - inside)
    return give


def _dealt(rows: DataFrame, give: np.ndarray) -> DataFrame:
    """(id, cluster) of rows (id, place): the first ``give[0]`` places to cluster 0, and so on."""
    ends = np.cumsum(give)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.searchsorted(ends, b.column("place").to_numpy(), "right").astype("i8"))], ["id", "cluster"])

    return rows.select("id", F.col("place").cast("long").alias("place")).mapInArrow(put, STATE)


def admitted(state: DataFrame | None, load: np.ndarray, batch: DataFrame, n: int, load_limit: float = 1.1) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster) of the nodes that are new in ``batch`` (edge_seq, src, dst), the loads after it).

    No cluster exceeds ``load_limit * n / k``, rounded up, as long as there are at most ``n`` nodes. Edges without an end or
    number are ignored; of equal numbers the smaller (src, dst) comes first; a loop makes its node a free source.
    """
    most = max(1, math.ceil(load_limit * n / len(load)))
    e = batch.select(F.col("edge_seq").alias("seq"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).dropna()
    at = lambda role: F.struct("seq", "src", "dst", F.lit(role).alias("role"))
    events = e.select(F.col("src").alias("id"), at(0).alias("at")).unionAll(e.where("src <> dst").select(F.col("dst").alias("id"), at(1).alias("at")))
    first = events.groupBy("id").agg(F.min("at").alias("at"))
    first = first.join(state, "id", "left") if state is not None else first.withColumn("cluster", F.lit(None).cast("long"))
    free = F.col("cluster").isNull() & (F.col("at.role") == 1)
    nodes = written(first.select("id", "at", "cluster", F.when(free, F.col("at.src")).otherwise(F.col("id")).alias("up")), "stream-nodes")
    new = nodes.where("cluster is null")

    heads = ranked(new.where("up = id").select("id", "at"), "place", "at")
    give = filled(load, most, heads.count())
    heads = written(_dealt(heads, give), "stream-heads")
    load = load + give

    # What each follower follows in the end: chains halve in every round.
    total = nodes.count()
    jump = nodes.select("id", "up")
    while True:
        over = jump.groupBy("up").agg(F.count("*").alias("n")).join(jump.select(F.col("id").alias("up"), F.col("up").alias("top")), "up")
        step = written(join_heavy(jump, over.select("up", "top", "n"), "up", "n", total).select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "stream-jump")
        jump = step.select("id", "up")
        if not step.where("moved").limit(1).count():
            break
    settled = nodes.where("cluster is not null").select(F.col("id").alias("up"), "cluster").unionByName(heads.select(F.col("id").alias("up"), "cluster"))
    sizes = jump.groupBy("up").agg(F.count("*").alias("n"))
    wishes = join_heavy(new.where("up <> id").select("id", "at").join(jump, "id"), sizes.join(settled, "up"), "up", "n", total).select("id", "at", "cluster")
    wishes = written(ranked(wishes, "place", "cluster", "at"), "stream-wishes")
    count = np.zeros(len(load), np.int64)
    for r in wishes.groupBy("cluster").agg(F.count("*").alias("n")).collect():
        count[r.cluster] = r.n
    take = np.minimum(count, np.maximum(most - load, 0))
    starts = np.cumsum(count) - count
    table = wishes.sparkSession.createDataFrame([(c, int(starts[c]), int(take[c])) for c in range(len(load))], "cluster long, start long, take long")
    wishes = wishes.join(F.broadcast(table), "cluster").withColumn("granted", F.col("place") - F.col("start") < F.col("take"))
    load = load + take
    rest = ranked(wishes.where("not granted").select("id", "at"), "place", "at")
    give = filled(load, most, int((count - take).sum()))
    return heads.unionByName(wishes.where("granted").select("id", "cluster")).unionByName(_dealt(rest, give)), load + give


class KeyedState:
    """The clusters of all nodes below ``path``: a table for each batch, and from time to time one of all before it."""

    def __init__(self, spark: SparkSession, path: str, k: int, every: int = 16):
        self.spark, self.path, self.k, self.every = spark, path.rstrip("/"), k, every

    def before(self, batch: int) -> DataFrame | None:
        """(id, cluster) before ``batch``; None at the beginning."""
        whole = batch - batch % self.every
        paths = [f"{self.path}/new/{b}" for b in range(whole, batch)]
        if whole:
            paths.append(f"{self.path}/whole/{whole}")
        return self.spark.read.schema(STATE).parquet(*paths) if paths else None

    def load(self, batch: int) -> np.ndarray:
        out = np.zeros(self.k, np.int64)
        if batch:
            for r in self.spark.read.parquet(f"{self.path}/load/{batch - 1}").collect():
                out[r.cluster] = r.n
        return out

    def take(self, rows: DataFrame, batch: int, n: int, load_limit: float = 1.1) -> None:
        """Admit ``rows`` as batch number ``batch``; taken again, it writes the same."""
        new, load = admitted(self.before(batch), self.load(batch), rows, n, load_limit)
        new.write.mode("overwrite").parquet(f"{self.path}/new/{batch}")
        self.spark.createDataFrame([(c, int(m)) for c, m in enumerate(load)], "cluster long, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/load/{batch}")
        if (batch + 1) % self.every == 0:
            everything = self.spark.read.schema(STATE).parquet(f"{self.path}/new/{batch}")
            old = self.before(batch)
            (everything if old is None else old.unionByName(everything)).write.mode("overwrite").parquet(f"{self.path}/whole/{batch + 1}")


def partition_stream(stream: DataFrame, path: str, n: int, k: int, load_limit: float = 1.1, checkpoint: str | None = None, every: int = 16):
    """Start the query over ``stream`` (edge_seq, src, dst); when it has ended, ``clusters`` reads the state."""
    state = KeyedState(stream.sparkSession, path, k, every)
    made = stream.writeStream.foreachBatch(lambda rows, batch: state.take(rows, batch, n, load_limit))
    return made.option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(availableNow=True).start()


def clusters(spark: SparkSession, path: str, k: int, batches: int, every: int = 16) -> DataFrame:
    """(id, cluster) after the first ``batches`` batches."""
    state = KeyedState(spark, path, k, every).before(batches)
    return state if state is not None else spark.createDataFrame([], STATE)
