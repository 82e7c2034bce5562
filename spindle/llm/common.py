"""Shared pieces of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the contracts: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; tests, which leave that unset, get one of the machine's."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spindle-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widened(schema: T.StructType, **fields: str) -> T.StructType:
    """A new schema with more fields behind those of ``schema``."""
    out = T.StructType(list(schema.fields))
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out


def partitions_for(n_bytes: int, each: int = 32 << 20, least: int = 6) -> int:
    return int(max(least, -(-n_bytes // each)))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def unit_hash(*columns: Column) -> Column:
    """A double strictly between 0 and 1, the same on every run."""
    top = F.shiftrightunsigned(F.xxhash64(*columns), 11)
    return (top.cast("double") + 0.5) / F.lit(float(1 << 53))


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str, right_rows: int, limit: int = 200_000, salts: int = 16) -> DataFrame:
    """Join a side of counted size: broadcast up to ``limit`` rows, else a salted shuffle join, which deals a hot key to ``salts`` tasks."""
    if right_rows <= limit:
        return left.join(F.broadcast(right), on, how)
    salt = F.pmod(F.xxhash64(*[left[c] for c in left.columns if c not in on]), F.lit(salts)).cast("int")
    dealt = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(dealt, [*on, "_salt"], how).drop("_salt")


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, how: str = "inner", parts: int = 1000, most: int | None = None) -> DataFrame:
    """Join ``left`` to ``right``, which has a row for each key with the ``count`` of left rows that hold it.

    Keys with over a ``parts``-th of the ``total`` left rows are at most ``parts`` many, so they are
    broadcast; no key of the rest is large enough to weigh down a task of the shuffle join.
    Without such keys (``most`` is the largest count, if known) one shuffle join does: ``left`` is read once.
    """
    least = max(1000, total // parts)
    if min(total, total if most is None else most) <= least:
        return left.join(right.drop(count), on, how)
    heavy = right.where(F.col(count) > least).drop(count).withColumn("_heavy", F.lit(True))
    light = right.where(F.col(count) <= least).drop(count)
    marked = left.join(F.broadcast(heavy), on, "left")
    own = [c for c in right.columns if c not in on and c != count]
    return marked.where("_heavy").drop("_heavy").unionByName(marked.where("_heavy is null").drop("_heavy", *own).join(light, on, how))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them as no column of ``df`` has: helpers never take a caller's column."""
    head = "_"
    while any(c.lower().startswith(head) for c in df.columns):
        head += "_"
    return [head + n for n in names]


def same_row(docs: DataFrame, other: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Condition on a side (_id, h) of ids and text hashes: rows of one id are told apart by their texts, null ids are equal."""
    return docs[id_col].cast("long").eqNullSafe(other["_id"]) & F.xxhash64(docs[text_col]).eqNullSafe(other["h"])


def rows_apart(docs: DataFrame, gone: DataFrame, how: str = "left_anti", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that aren't (or, by left_semi, are) among the distinct (_id, h) of ``gone``, with their own columns only."""
    gone = staged(gone.select("_id", "h").distinct(), "rows")
    if gone.count() <= 1_000_000:  # 16 MB
        gone = F.broadcast(gone)
    return docs.join(gone, same_row(docs, gone, id_col, text_col), how)


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the smallest node of the component of every node of the edges (u, v).

    Each round maps every node to its smallest neighbour and contracts the edges by that map;
    all tables stay distributed, and hubs are joined by broadcasting the few that are large.
    """
    spark = edges.sparkSession
    edges = staged(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-e")
    maps = []
    while n := edges.count():
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = staged(both.groupBy("u").agg(F.least("u", F.min("v")).alias("to"), F.count("*").alias("n")), f"{name}-m")
        maps.append(step.select("u", "to"))
        most = step.agg(F.max("n")).first()[0]
        left = join_counted(edges, step, ["u"], "n", n, most=most).select(F.col("to").alias("a"), F.col("v").alias("u"))
        pairs = join_counted(left, step, ["u"], "n", n, most=most).select(F.col("a"), F.col("to").alias("b")).where("a <> b")
        edges = staged(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"{name}-e")
    if not maps:
        return spark.createDataFrame([], "node long, label long")
    labels = maps[0].select(F.col("u").alias("node"), F.col("to").alias("label"))
    for step in maps[1:]:
        labels = staged(labels, f"{name}-l")
        held = labels.groupBy(F.col("label").alias("u")).agg(F.count("*").alias("n"))
        step = staged(step.join(held, "u", "inner"), f"{name}-s")
        moved = join_counted(labels.withColumn("u", F.col("label")), step, ["u"], "n", labels.count(), "left")
        labels = moved.select("node", F.coalesce("to", "label").alias("label"))
    return labels


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Arrow batches of few rows and bytes: very long texts must not pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
