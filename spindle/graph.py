"""The graph: an edge table (src, dst, weight) and a node table (id, ...).

Undirected graphs hold both directions of each edge.  The node table is explicit, so isolated
nodes exist.  Every method returns a lazy DataFrame that Catalyst plans as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import written


@dataclass
class Graph:
    edges: DataFrame
    nodes: DataFrame
    #: (src, dst, ...) with src < dst: each pair once, where the edges are known to be both directions of these pairs of nodes.
    half: DataFrame | None = None

    @classmethod
    def from_edges(cls, edges: DataFrame, nodes: DataFrame | None = None, weight: str | None = "weight") -> Graph:
        w = F.col(weight).cast("double") if weight and weight in edges.columns else F.lit(1.0)
        edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), w.alias("weight"))
        if nodes is None:
            nodes = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
        return cls(edges, nodes)

    @classmethod
    def mirrored(cls, half: DataFrame, nodes: DataFrame | None = None) -> Graph:
        """Both directions of ``half`` (src, dst, weight), whose pairs are distinct with src < dst; ``nodes`` hold all ends."""
        g = cls.from_edges(half, nodes)
        return cls(g.edges.unionAll(g.reversed()), g.nodes, g.edges)

    @property
    def ids(self) -> DataFrame:
        return self.nodes.select("id")

    def reversed(self) -> DataFrame:
        return self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")

    def undirected(self) -> Graph:
        """Both directions of every edge once; of parallel edges the largest weight stays."""
        both = self.edges.unionAll(self.reversed()).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
        return Graph(both, self.nodes)

    # ---- degrees

    def out_degrees(self) -> DataFrame:
        """(id, degree, strength) of every node, 0 for isolated ones."""
        per = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
        return self.ids.join(per, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))

    def offsets(self) -> DataFrame:
        """(id, start, end) of every node's run in the edges sorted by (src, dst).

        The running sum is taken in two steps, over ranges of ids and then inside each, so that no task holds all nodes.
        """
        d = self.out_degrees().withColumn("bucket", F.floor(F.col("id") / 4096))
        per = d.groupBy("bucket").agg(F.sum("degree").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        per = per.select("bucket", before.alias("before"))
        inside = F.sum("degree").over(Window.partitionBy("bucket").orderBy("id"))
        return d.join(per, "bucket").select("id", (F.col("before") + inside - F.col("degree")).alias("start"), (F.col("before") + inside).alias("end"))

    def is_undirected(self) -> DataFrame:
        """One row: whether the edges with their weights equal their reversal."""
        if self.half is not None:  # by construction, if nothing is null
            unknown = F.col("src").isNull() | F.col("dst").isNull() | F.col("weight").isNull()
            return self.half.agg((F.count_if(unknown) == 0).alias("undirected"))
        ends = self.edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "weight")
        turned = F.sum(F.when(F.col("src") < F.col("dst"), 1).when(F.col("src") > F.col("dst"), -1).otherwise(0))
        unknown = F.max(F.col("src").isNull() | F.col("dst").isNull() | F.col("weight").isNull())
        odd = ends.agg(turned.alias("turned"), unknown.alias("unknown")).where("turned <> 0 or unknown")
        return odd.agg((F.count("*") == 0).alias("undirected"))

    def sorted_edges(self) -> DataFrame:
        """Edges in the order of (src, dst), with their place ``pos``."""
        from .operators.joins import ranked

        return ranked(self.edges, "pos", "src", "dst", "weight")

    def flags(self) -> DataFrame:
        """One row: whether edges are weighted and nodes labelled (``y``), and the length of their features (``x``)."""
        columns = self.nodes.columns
        width = F.coalesce(F.max(F.size("x")), F.lit(0)) if "x" in columns else F.lit(0)
        labels = F.coalesce(F.max(F.col("y").isNotNull()), F.lit(False)) if "y" in columns else F.lit(False)
        n = self.nodes.agg(F.count("*").alias("n_nodes"), labels.alias("has_labels"), width.cast("int").alias("n_features"))
        e = self.edges.agg(F.count("*").alias("n_edges"), F.coalesce(F.max(F.col("weight") != 1.0), F.lit(False)).alias("weighted"))
        return n.join(F.broadcast(e))

    # ---- neighbourhoods

    def neighbours(self, sources: DataFrame) -> DataFrame:
        """Edges that leave ``sources`` (id)."""
        return self.edges.join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select("src", "dst", "weight")

    def has_edges(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (src, dst) with ``found``."""
        known = self.edges.select("src", "dst").distinct().withColumn("found", F.lit(True))
        return pairs.join(known, ["src", "dst"], "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def within_hops(self, sources: DataFrame, hops: int = 1) -> DataFrame:
        """(id, level): nodes within ``hops`` steps of ``sources``, which have level 0."""
        front = written(sources.select(F.col("id").cast("long").alias("id"), F.lit(0).alias("level")).distinct(), "hop")
        seen = front
        for level in range(1, hops + 1):
            reached = self.edges.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
            front = written(reached.join(seen.select("id"), "id", "left_anti").withColumn("level", F.lit(level)), "hop")
            seen = seen.unionAll(front)
        return seen

    def subgraph(self, nodes: DataFrame, relabel: bool = True) -> Graph:
        """Induced by ``nodes`` (id[, pos]); relabelled to 0..k-1 in the order of ``pos`` (of the ids without it)."""
        if "pos" not in nodes.columns:
            from .operators.joins import ranked

            nodes = ranked(nodes, "pos", "id")
        named = nodes.select("id", F.col("pos").cast("long").alias("pos"))
        inner = (
            self.edges.join(named.select(F.col("id").alias("src"), F.col("pos").alias("a")), "src")
            .join(named.select(F.col("id").alias("dst"), F.col("pos").alias("b")), "dst")
        )
        kept = self.nodes.join(named, "id")
        if not relabel:
            return Graph(inner.select("src", "dst", "weight"), kept.drop("pos"))
        return Graph(inner.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), kept.withColumnRenamed("id", "orig_id").withColumnRenamed("pos", "id"))

    # ---- partitions

    def quotient(self, partition: DataFrame, self_loops: bool = True) -> DataFrame:
        """(src, dst, count, weight) between the clusters of ``partition`` (id, cluster)."""
        between = self.clustered(partition)
        if not self_loops:
            between = between.where("cs <> cd")
        return between.groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.count("*").alias("count"), F.sum("weight").alias("weight"))

    def clustered(self, partition: DataFrame) -> DataFrame:
        """Edges with the clusters of both ends, cs and cd."""
        from .operators.joins import join_dealt

        p = partition.select("id", "cluster")
        return join_dealt(join_dealt(self.edges, p.select(F.col("id").alias("src"), F.col("cluster").alias("cs")), "src"), p.select(F.col("id").alias("dst"), F.col("cluster").alias("cd")), "dst")

    def conductance(self, partition: DataFrame) -> DataFrame:
        """(cluster, cut, volume, conductance) of each cluster against all others: cut edges by the smaller volume."""
        e = self.clustered(partition)
        total = self.edges.agg(F.count("*").alias("total"))
        per = e.groupBy(F.col("cs").alias("cluster")).agg(F.count("*").alias("volume"), F.count_if(F.col("cs") != F.col("cd")).alias("cut"))
        least = F.least(F.col("volume"), F.col("total") - F.col("volume"))
        return per.join(F.broadcast(total)).select("cluster", "cut", "volume", F.when(least > 0, F.col("cut") / least).alias("conductance"))
