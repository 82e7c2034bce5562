"""Line deduplication over levelled sorted runs (DataFrame operations only).

The index of lines is a log-structured set of runs.  A run is a table of line hashes, sorted,
with the number of documents that hold each line.  A new batch of documents is counted, merge
anti-joined against the runs' keys that have already reached the limit (those need no further
counting), and written as a sorted run of level 0.  When a level holds ``fanout`` runs, they
are merged into one run of the next level.

Defined cases: a null or empty text is one empty line and stays; lines of white space only
never count; repeated rows count as so many documents; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, shared_dir

KEY = ["h1", "h2"]
_KEY_SCHEMA = "h1 long, h2 long, n long"


class LineRuns:
    """The runs of one index, kept as Parquet below ``path``."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int, fanout: int = 4):
        self.spark, self.path, self.min_docs, self.fanout = spark, path, min_docs, fanout
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def _write(self, run: DataFrame, level: int) -> str:
        path = f"{self.path}/level{level}/run{self.written}"
        self.written += 1
        run.select(*KEY, "n").repartition(*KEY).sortWithinPartitions(*KEY).write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        read = self.spark.read.schema(_KEY_SCHEMA)
        return reduce(DataFrame.unionAll, [read.parquet(p) for p in paths]) if paths else self.spark.createDataFrame([], _KEY_SCHEMA)

    def add(self, batch: DataFrame) -> None:
        """``batch``: rows (h1, h2, n), a row for each key."""
        for path in [p for level in self.levels for p in level]:
            full = self._read([path]).where(F.col("n") >= self.min_docs)
            batch = batch.join(full.hint("merge"), KEY, "left_anti")
        self.levels[0].append(self._write(batch, 0))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            merged = self._read(self.levels[level]).groupBy(*KEY).agg(F.sum("n").alias("n"))
            self.levels[level + 1].append(self._write(merged, level + 1))
            self.levels[level] = []
            level += 1

    def frequent(self) -> DataFrame:
        """Keys of at least ``min_docs`` documents, with the count known when they became full."""
        return self._read([p for level in self.levels for p in level]).groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_docs)


def line_keys(text) -> F.Column:
    return F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.btrim(line, F.lit(WHITE)))


def key_hash(key) -> list:
    """128 bits of a line's key."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x5BD1E995), key).alias("h2")]


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = 4,
    fanout: int = 4,
) -> DataFrame:
    """(id, n_lines, n_dropped, kept): ``kept`` is the text without lines whose key is found in ``min_docs`` documents."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    path = shared_dir(spark, "line-runs")
    # One pass over the texts counts every batch; the runs then work on hashes.
    batch = F.pmod(F.xxhash64("_id", "_text"), F.lit(batches)).cast("int").alias("batch")
    counted = (
        base.select(batch, F.explode(F.array_distinct(line_keys(F.col("_text")))).alias("_line"))
        .where(F.length("_line") >= min_chars)
        .select("batch", *key_hash(F.col("_line")))
        .groupBy("batch", *KEY)
        .agg(F.count("*").alias("n"))
    )
    counted.write.partitionBy("batch").parquet(f"{path}/batches")
    n_docs = spark.read.schema("batch int, h1 long, h2 long, n long").parquet(f"{path}/batches")
    runs = LineRuns(spark, path, min_docs, fanout)
    for i in range(batches):
        runs.add(n_docs.where(F.col("batch") == i).select(*KEY, "n"))
    frequent = runs.frequent()
    frequent.write.parquet(f"{path}/frequent")
    frequent = spark.read.schema(_KEY_SCHEMA).parquet(f"{path}/frequent")
    # A key is heavy from a thousandth of the documents on. A document holds few lines, so there are
    # at most 1000 times the mean number of lines of a document such keys, however many documents there are.
    total = docs.count()
    heavy = F.broadcast(frequent.where(F.col("n") >= max(min_docs, total // 1000)).select(*KEY, F.lit(True).alias("_heavy")))
    light = frequent.where(F.col("n") < max(min_docs, total // 1000)).select(*KEY, F.lit(True).alias("_light"))
    lines = (
        base.select("_id", F.xxhash64("_text").alias("_h"), F.posexplode(line_keys(F.col("_text"))).alias("_at", "_line"))
        .select("_id", "_h", "_at", (F.length("_line") >= min_chars).alias("_long"), *key_hash(F.col("_line")))
        .join(heavy, KEY, "left")
    )
    keep = ["_id", "_h", "_at"]
    settled = lines.where(F.col("_heavy") | ~F.col("_long")).select(*keep, F.coalesce(F.col("_heavy") & F.col("_long"), F.lit(False)).alias("_drop"))
    open_ = lines.where(F.col("_heavy").isNull() & F.col("_long")).join(light, KEY, "left").select(*keep, F.coalesce("_light", F.lit(False)).alias("_drop"))
    marks = settled.unionAll(open_).groupBy("_id", "_h").agg(F.transform(F.sort_array(F.collect_set(F.struct("_at", "_drop"))), lambda m: m["_drop"]).alias("_drops"))
    whole = base.withColumn("_h", F.xxhash64("_text"))
    both = whole.join(marks, whole["_id"].eqNullSafe(marks["_id"]) & (whole["_h"] == marks["_h"]), "left").select(whole["_id"].alias(id_col), "_text", "_drops")
    pairs = F.arrays_zip(F.split("_text", "\n").alias("line"), F.col("_drops").alias("drop"))
    return both.select(
        id_col,
        F.size("_drops").cast("long").alias("n_lines"),
        F.size(F.filter("_drops", lambda d: d)).cast("long").alias("n_dropped"),
        F.concat_ws("\n", F.transform(F.filter(pairs, lambda x: ~x["drop"]), lambda x: x["line"])).alias("kept"),
    )
