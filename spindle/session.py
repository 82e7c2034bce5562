"""Session defaults and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("spindle").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spindle-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table below spark.checkpoint.dir: cuts lineage, and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, rows: int, name: str) -> DataFrame:
    """``df`` of about ``rows`` rows as ``written``, in sorted buckets by ``key``: joins and sums by it need no exchange of this side."""
    spark = df.sparkSession
    path = folder(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 4_000_000))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its name only: the files lie outside the warehouse, and ``out`` knows them
    return out
