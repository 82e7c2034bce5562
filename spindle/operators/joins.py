"""Joins on keys that may be hot, and numbers in order without a task that sees all rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bucketed, written


def join_heavy(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "inner", parts: int = 500, small: int = 200_000) -> DataFrame:
    """``left`` with ``right``, a row for each ``key`` and the ``count`` of left rows that hold it.

    A key with over a ``parts``-th of the ``total`` left rows is heavy; there are at most ``parts``
    of them, which are broadcast, so that a hub's rows stay where they are.  Up to ``small`` left
    rows fit a task, whatever their keys, and are joined at once.
    """
    if total <= small:
        return left.join(right.drop(count), key, how)
    least = max(1000, total // parts)
    own = [c for c in right.columns if c not in (key, count)]
    heavy = F.broadcast(right.where(F.col(count) > least).drop(count).withColumn("_heavy", F.lit(1)))
    light = right.where(F.col(count) <= least).drop(count)
    marked = left.join(heavy, key, "left")
    return marked.where("_heavy = 1").drop("_heavy").unionByName(marked.where("_heavy is null").drop("_heavy", *own).join(light, key, how))


def join_dealt(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """``left`` with ``right`` by an exchange of both: in rounds, small sides that are broadcast add up on the driver."""
    return left.join(right.hint("merge"), key, how)


@dataclass
class Spokes:
    """Edges (src, dst) written in buckets by src, so that a join on src moves only the other side; hubs' edges lie apart as they came."""

    light: DataFrame
    heavy: DataFrame | None
    hubs: DataFrame | None

    @classmethod
    def of(cls, edges: DataFrame, total: int, parts: int = 500, small: int = 200_000, seen: int = 1_000_000) -> Spokes:
        """``edges`` of ``total`` rows; a hub has about a ``parts``-th of them or more, by its count among some ``seen`` rows, which settles the layout only."""
        edges = edges.select("src", "dst")
        hubs = None
        if total > small:
            share = min(1.0, seen / total)
            count = edges.sample(share, 7).groupBy("src").agg(F.count("*").alias("n")) if share < 1 else edges.groupBy("src").agg(F.count("*").alias("n"))
            hubs = written(count.where(F.col("n") > max(1000.0, total / parts) * share).select("src"), "hubs")
            hubs = hubs if hubs.limit(1).count() else None
        if hubs is None:
            return cls(bucketed(edges, "src", total, "spokes"), None, None)
        of_hub = lambda how: edges.join(F.broadcast(hubs), "src", how)
        return cls(bucketed(of_hub("left_anti"), "src", total, "spokes"), written(of_hub("left_semi"), "spokes-hubs"), hubs)

    def join(self, rows: DataFrame) -> DataFrame:
        """All edges that leave ``rows`` (src, ...), a row for each src."""
        out = self.light.join(rows.hint("shuffle_hash"), "src")
        if self.hubs is None:
            return out
        return out.unionByName(self.heavy.join(F.broadcast(rows.join(F.broadcast(self.hubs), "src", "left_semi")), "src"))


def ranked(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``df`` with ``name``: each row's place from 0 in the order given.

    Rows are sorted by ranges, numbered within their range as they are written, and each range
    adds the rows before it: one number for each partition.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    rows = written(ranges, "ranked").withColumns({"_part": F.shiftright("_row", 33), "_at": F.col("_row").bitwiseAND((1 << 33) - 1)})
    before, starts = 0, []
    for part, n in sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        starts.append((part, before))
        before += n
    if not starts:
        return rows.withColumn(name, F.col("_row")).drop("_row", "_part", "_at")
    table = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    return rows.join(F.broadcast(table), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_row", "_part", "_at", "_before")
