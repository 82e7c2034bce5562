"""Readers, writers and encoders of graph datasets.

A dataset is a pair of tables: edges (src, dst, timestamp, ...features) and nodes (id,
timestamp, y, ...features); every column without a fixed name is a feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import log_feature
from ..graph import Graph

DATASETS: dict[str, Callable] = {}
#: Fixed facts: nodes, features, classes of the published datasets.
CATALOG = [("cora", 2708, 1433, 7), ("citeseer", 3327, 3703, 6), ("pubmed", 19717, 500, 3)]


def register_dataset(name: str):
    def add(f):
        DATASETS[name] = f
        return f

    return add


def get_dataset(spark: SparkSession, name: str, **options):
    if name not in DATASETS:
        raise KeyError(f"no dataset {name!r}; there are {sorted(DATASETS)}")
    return DATASETS[name](spark, **options)


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "name string, n_nodes long, n_features long, n_classes int")


@register_dataset("pair")
def read_pair(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """edge_data.parquet and, where it is, node_data.parquet."""
    from pyspark.errors import AnalysisException

    edges = spark.read.parquet(f"{path}/edge_data.parquet")
    try:
        return edges, spark.read.parquet(f"{path}/node_data.parquet")
    except AnalysisException:
        return edges, None


def write_pair(edges: DataFrame, nodes: DataFrame | None, path: str) -> None:
    edges.write.mode("overwrite").parquet(f"{path}/edge_data.parquet")
    if nodes is not None:
        nodes.write.mode("overwrite").parquet(f"{path}/node_data.parquet")


@register_dataset("snapshots")
def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files asYYYYMMDD.txt of tab-separated pairs, # comments, ids from 1: (edges, nodes) by day."""
    raw = spark.read.schema("src long, dst long").option("sep", "\t").option("comment", "#").csv(path)
    day = F.to_timestamp(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{8})", 1), "yyyyMMdd")
    edges = raw.select(day.alias("timestamp"), (F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"))
    return edges, edges.select("timestamp", F.col("src").alias("id")).distinct()


def dense_ids(keys: DataFrame, key: str) -> DataFrame:
    """(key, id): distinct keys numbered from 0 in sorted order, by ranges, so that no task ranks them all."""
    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct()
    ranged = distinct.repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    from ..session import written

    ranged = written(ranged, "ids")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = counts.select("_p", before.alias("before"))
    row = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return ranged.join(F.broadcast(offset), "_p").select(key, (F.col("before") + row).cast("long").alias("id"))


def encode_triples(features: DataFrame, classes: DataFrame, edges: DataFrame, labels: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, key, y) and edges (src, dst) of tables (key), (key, class) and (a, b); unknown classes are 0, edges of unknown ends go."""
    ids = dense_ids(features, "key")
    code = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    nodes = ids.join(classes.select("key", F.col("class").cast("string").alias("c")), "key", "left").select("id", "key", F.coalesce(F.try_element_at(code, F.col("c")), F.lit(0)).alias("y"))
    return nodes, encode_edges(edges, ids)


def encode_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (a, b, ...) between known keys as (src, dst, ...)."""
    a, b = ids.select(F.col("key").alias("a"), F.col("id").alias("src")), ids.select(F.col("key").alias("b"), F.col("id").alias("dst"))
    return edges.join(a, "a").join(b, "b").drop("a", "b")


def label_codes(column, codes: dict[str, int], unlabelled: int = 0, other: int | None = None):
    """Code of a label; null and "null" are ``unlabelled``, unknown ones ``other``."""
    table = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    known = F.try_element_at(table, column)
    return F.when(column.isNull() | (column == "null"), F.lit(unlabelled)).otherwise(F.coalesce(known, F.lit(other if other is not None else max(codes.values()) + 1)))


def feature_matrix(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(id, x): log(1 + x) of the columns, nulls and negatives as 0."""
    return nodes.select("id", F.array(*[log_feature(F.col(c)) for c in columns]).alias("x"))


def bidirectional(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def exact_sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows, the same on every run."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def labelled_only(nodes: DataFrame, label: str = "y") -> DataFrame:
    """Nodes with a label; the filter reaches the scan."""
    return nodes.where(F.col(label).isNotNull())


def edges_between(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges of which both ends are among ``nodes``."""
    ids = nodes.select(F.col(key).alias("_known")).distinct()
    kept = edges.join(ids, F.col("src") == F.col("_known"), "left_semi")
    return kept.join(ids, F.col("dst") == F.col("_known"), "left_semi")


def cached_subset(spark: SparkSession, root: str, parameters: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives for these parameters, written once below ``root`` and read again ever after."""
    import hashlib
    import json

    from pyspark.errors import AnalysisException

    path = f"{root.rstrip('/')}/subset-{hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


# ---- conversions


def snapshots(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the graphs by timestamp: one edge for each (timestamp, src, dst), one node for each (timestamp, id).

    Of several rows the least stays, whole: features are kept, and none is mixed from two rows.
    """

    def one(rows: DataFrame, keys: list[str]) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        if not rest:
            return rows.distinct()
        return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])

    e = one(edges, ["timestamp", "src", "dst"])
    if nodes is None:
        nodes = e.select("timestamp", F.col("src").alias("id")).unionAll(e.select("timestamp", F.col("dst").alias("id")))
    return e, one(nodes, ["timestamp", "id"])


def frames_of(graphs: list[tuple[int | None, Graph]]) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) tables of graphs with their timestamps, 0 where there is none; columns that a graph lacks are null."""
    edges = nodes = None
    for at, g in graphs:
        e, n = (x.withColumn("timestamp", F.lit(at or 0).cast("long")) for x in (g.edges, g.nodes))
        edges = e if edges is None else edges.unionByName(e, allowMissingColumns=True)
        nodes = n if nodes is None else nodes.unionByName(n, allowMissingColumns=True)
    return edges, nodes


def event_stream(edges: DataFrame, features: list[str]) -> DataFrame:
    """(pos, src, dst, timestamp, msg): edges in the order of time, features as one vector."""
    from ..operators.joins import ranked

    message = F.array(*[F.col(c).cast("double") for c in features]) if features else F.array().cast("array<double>")
    return ranked(edges.select("src", "dst", "timestamp", message.alias("msg")), "pos", "timestamp", "src", "dst", "msg")


def papers_as_graph(rows: DataFrame) -> Graph:
    """The graph of a ``subset``: labels are years since 1900, 0 where unknown; no features are made up."""
    nodes = rows.where("type = 'node'").select("id", F.coalesce(F.col("year") - 1900, F.lit(0)).cast("int").alias("y"))
    return Graph.from_edges(rows.where("type = 'edge'").select(F.col("source").alias("src"), F.col("target").alias("dst")), nodes)


def transaction_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: entities, transactions, share of anomalies, amounts and times."""
    e = edges.agg(
        F.count("*").alias("n_edges"), F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_share"), F.sum("btc_amount").alias("total_amount"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
    )
    return nodes.agg(F.count("*").alias("n_nodes")).join(F.broadcast(e))


# ---- results on disk

#: Column names under which embeddings and labels are looked for, in this order.
EMBEDDING_NAMES = ("embedding", "embeddings", "X", "x", "features", "data", "coord")
LABEL_NAMES = ("labels", "y", "Y", "targets", "classes", "label")


def read_embedding(spark: SparkSession, path: str, names: tuple[str, ...] = EMBEDDING_NAMES) -> DataFrame:
    """A Parquet or JSON table with its vectors as ``embedding``; of an npy or npz file (row, embedding[, label]).

    An npz file's labels are looked for under ``LABEL_NAMES``.
    """
    if path.endswith((".npy", ".npz")):
        from .numpy_files import members, read_npy

        if path.endswith(".npy"):
            return read_npy(spark, path).withColumnRenamed("value", "embedding")
        held = members(path)
        name = next((x for x in names if x in held), None)
        if name is None:
            raise KeyError(f"none of {names} among {held}")
        found = read_npy(spark, path, name).withColumnRenamed("value", "embedding")
        label = next((x for x in LABEL_NAMES if x in held), None)
        return found if label is None else found.join(read_npy(spark, path, label).withColumnRenamed("value", "label"), "row", "left")
    rows = spark.read.json(path) if path.endswith(".json") else spark.read.parquet(path)
    for name in names:
        if name in rows.columns:
            return rows.withColumnRenamed(name, "embedding") if name != "embedding" else rows
    raise KeyError(f"none of {names} among {rows.columns}")


def write_embedding(rows: DataFrame, path: str, **facts: str | int | float) -> None:
    """Vectors as Parquet, and one row of facts about them."""
    rows.write.mode("overwrite").parquet(f"{path}/embedding")
    if facts:
        rows.sparkSession.createDataFrame([tuple(facts.values())], list(facts)).write.mode("overwrite").parquet(f"{path}/facts")


def results_summary(runs: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Mean and sample deviation of every measure, and the number of runs."""
    made = [f(c).alias(f"{c}_{n}") for c in measures for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), *made)


def write_results(runs: DataFrame, by: list[str], measures: list[str], path: str) -> None:
    """raw and summary as CSV with headers."""
    runs.write.mode("overwrite").option("header", True).csv(f"{path}/raw")
    results_summary(runs, by, measures).write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def write_points(points: DataFrame, path: str) -> None:
    """(node_id, coord) as CSV, a column for each dimension."""
    width = points.agg(F.max(F.size("coord"))).first()[0] or 0
    rest = [c for c in points.columns if c != "coord"]
    points.select(*rest, *[F.get("coord", F.lit(k)).alias(f"dim_{k}") for k in range(width)]).write.mode("overwrite").option("header", True).csv(path)


# ---- subsets of a citation graph: papers (id, year, field), citations (src, dst)


def papers_between(papers: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Papers of the years first..last, five years where ``last`` is open."""
    return papers.where(F.col("year").between(first, first + 5 if last is None else last))


def papers_of_fields(papers: DataFrame, fields: list) -> DataFrame:
    return papers.where(F.col("field").isin(fields))


def most_cited(papers: DataFrame, citations: DataFrame, k: int) -> DataFrame:
    top = citations.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(k)
    return papers.join(top.select("id"), "id", "left_semi")


def subset(papers: DataFrame, citations: DataFrame) -> DataFrame:
    """Tagged union of renumbered nodes and the citations between them: (type, id, original_id, year, source, target)."""
    ids = dense_ids(papers.select(F.col("id").alias("key")), "key")
    nodes = papers.join(ids.select(F.col("key").alias("id"), F.col("id").alias("n")), "id").select(F.lit("node").alias("type"), F.col("n").alias("id"), F.col("id").alias("original_id"), "year")
    edges = encode_edges(citations.select(F.col("src").alias("a"), F.col("dst").alias("b")), ids).select(F.lit("edge").alias("type"), F.col("src").alias("source"), F.col("dst").alias("target"))
    return nodes.unionByName(edges, allowMissingColumns=True)


def subset_statistics(rows: DataFrame) -> DataFrame:
    node = F.col("type") == "node"
    return rows.agg(
        F.count_if(node).alias("n_nodes"), F.count_if(~node).alias("n_edges"), F.min(F.when(node, F.col("year"))).alias("first_year"),
        F.max(F.when(node, F.col("year"))).alias("last_year"), F.count_distinct(F.when(node, F.col("year"))).alias("n_years"),
    )


# ---- synthetic transactions


@register_dataset("transactions")
def transactions(spark: SparkSession, entities: int = 1000, n: int = 5000, seed: int = 42, start: int = 1_500_000_000) -> tuple[DataFrame, DataFrame]:
    """Entities with types and transactions with lognormal amounts, a twentieth of them anomalous."""
    u = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(m))
    flat = lambda k: (u(k, 1 << 40).cast("double") + 0.5) / float(1 << 40)
    normal = lambda k: F.sqrt(-2 * F.log(flat(k))) * F.cos(2 * F.pi() * flat(k + 1))
    nodes = spark.range(entities).select("id", u(1, 5).cast("int").alias("entity_type_id"), (u(2, 10) < 3).cast("int").alias("is_labeled"), (F.lit(start) + u(3, 86400 * 365)).alias("timestamp"))
    edges = spark.range(n).select(
        u(4, entities).alias("src"), u(5, entities).alias("dst"), (F.lit(start) + u(6, 86400 * 365)).alias("timestamp"),
        F.exp(normal(8)).alias("btc_amount"), (u(7, 20) == 0).cast("int").alias("is_anomaly"), F.col("id").alias("transaction_id"),
    ).withColumn("usd_amount", F.col("btc_amount") * 30000.0)
    return edges, nodes


def anomaly_labels(edges: DataFrame) -> DataFrame:
    return edges.select("transaction_id", F.col("is_anomaly").cast("boolean").alias("is_anomaly"))


# ---- patches on disk


def write_patches(members: DataFrame, path: str, edges: DataFrame | None = None) -> None:
    """Members with coordinates and, where given, edges, partitioned by patch; readers prune to the patches they ask for."""
    members.write.mode("overwrite").partitionBy("patch_id").parquet(f"{path}/members")
    if edges is not None:
        edges.write.mode("overwrite").partitionBy("patch_id").parquet(f"{path}/edges")


def read_patches(spark: SparkSession, path: str, patch: int | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/members")
    return rows if patch is None else rows.where(F.col("patch_id") == patch)


def patches_as_json(members: DataFrame) -> DataFrame:
    """(patch_id, json): one object of node to coordinates for each patch."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("node_id").cast("string").alias("k"), F.col("coord").alias("v")))))
    return members.groupBy("patch_id").agg(F.to_json(entries).alias("json"))


def patches_from_json(rows: DataFrame) -> DataFrame:
    parsed = rows.select("patch_id", F.explode(F.from_json("json", "map<string,array<double>>")).alias("k", "coord"))
    return parsed.select("patch_id", F.col("k").cast("long").alias("node_id"), "coord")


def snapshot(edges: DataFrame, at) -> Graph:
    return Graph.from_edges(edges.where(F.col("timestamp") == at).dropDuplicates(["src", "dst"]))
