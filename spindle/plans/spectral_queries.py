"""Queries over whole-graph iterations: singular vectors, projected resistances, bottleneck paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embedding as em
from ..operators import fixpoints as fx
from ..operators import learning as lr
from ..operators import patching as pt
from ..operators import sparsify as sp
from ..operators import tall
from ..operators.joins import ranked
from ..operators.nearest import Cells
from ..session import folder, written
from ..sources import numpy_files as npf
from ..streaming import keyed
from .fixtures import COPART, TRANSITIONS, copart, t, transitions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("embed_svd")
def embed_svd(spark, d):
    return em.full_graph(copart(spark, d), 8, "svd")


for _name in ("gae", "vgae", "graphsage"):

    def _embed(spark, d, name=_name):
        return em.full_graph(copart(spark, d), 8, name, epochs=3, hidden=16)

    QUERIES[f"embed_{_name}"] = _embed


@query("svd_residuals", f"WITH {COPART} SELECT id, true AS held FROM nodes")
def svd_residuals(spark, d):
    """A (A u) is the square of the singular value times u, at every node, to a fiftieth of the largest square."""
    g = copart(spark, d)
    a = tall.Sparse.of(g.edges)
    u, values = tall.singular_vectors(a, g.ids, 4)
    u = written(u, "singular-vectors")
    twice = a.times(a.times(u)).withColumnRenamed("v", "w")
    zero = F.array(*[F.lit(0.0)] * 4)
    both = u.join(twice, "id", "left").select("id", "v", F.coalesce("w", zero).alias("w"))
    apart = tall.each(both, lambda v, w: abs(w - v * values**2).max(axis=1)[:, None], "v", "w")
    return apart.select("id", (F.col("v")[0] <= 0.02 * float(values[0] ** 2)).alias("held"))


@query("projected_foster_sum", f"WITH {COPART.replace('l_quantity > 45', 'l_quantity > 0')} SELECT CAST(count(*) AS BIGINT) AS n_nodes, true AS held FROM nodes")
def projected_foster_sum(spark, d):
    """Weights times projected resistances sum to the nodes less the components, within a twentieth; all line items."""
    g = copart(spark, d, 0.0)
    r = sp.resistances(g, epsilon=0.7, exact_up_to=0, tolerance=1e-3).where("src < dst").agg(F.sum(F.col("weight") * F.col("resistance")).alias("foster"))
    c = fx.component_labels(g).agg(F.count("*").alias("n_nodes"), (F.count("*") - F.count_distinct("label")).alias("rank"))
    return c.join(F.broadcast(r)).select("n_nodes", (F.abs(F.col("foster") - F.col("rank")) <= 0.05 * F.col("rank")).alias("held"))


@query("bottleneck_paths", f"""WITH RECURSIVE {COPART}, strong AS (SELECT src, dst FROM copart WHERE weight >= 2),
reach AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, s.dst FROM reach r JOIN strong s ON s.src = r.other)
SELECT c.src, c.dst, r.id IS NOT NULL AS by_twos FROM copart c LEFT JOIN reach r ON r.id = c.src AND r.other = c.dst WHERE c.src < c.dst""")
def bottleneck_paths(spark, d):
    """Edges whose ends are joined by edges of two orders at least: the bottleneck of the maximum spanning forest says so."""
    return fx.bottlenecks(copart(spark, d), maximise=True).select("src", "dst", (F.col("bottleneck") <= -2).alias("by_twos"))


@query("relaxed_tree")
def relaxed_tree(spark, d):
    return sp.relaxed_tree(copart(spark, d).edges, 0.5)


# ---- numpy files


@query("numpy_vectors", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings")
def numpy_vectors(spark, d):
    """The vectors written as npy files and read by ranges."""
    v = written(ranked(t(spark, d, "embeddings").select("vec_id", "label", "embedding"), "row", "vec_id"), "numbered")
    path = folder(spark, "npy")
    npf.write_npy(v, f"{path}-x.npy", "embedding", "float32")
    npf.write_npy(v, f"{path}-ids.npy", ["vec_id", "label"], "int64")
    x = npf.read_npy(spark, f"{path}-x.npy", part_bytes=1 << 20).select("row", F.col("value").cast("array<double>").alias("embedding"))
    ids = npf.read_npy(spark, f"{path}-ids.npy", axis=1, columns={"vec_id": 0, "label": 1}, part_bytes=1 << 20)
    return ids.join(x, "row")


@query("numpy_graph", """WITH lines AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
pairs AS (SELECT a.l_partkey AS s, b.l_partkey AS d, CAST(count(*) AS DOUBLE) AS weight FROM lines a JOIN lines b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2),
ids AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS id FROM (SELECT DISTINCT s FROM pairs))
SELECT a.id AS src, b.id AS dst, weight FROM pairs JOIN ids a ON pairs.s = a.s JOIN ids b ON pairs.d = b.s""")
def numpy_graph(spark, d):
    """Parts that share orders, over all lines, relabelled, saved as a folder of npy files and loaded again."""
    g = copart(spark, d, 0.0, dense=True)
    path = folder(spark, "npy-graph")
    npf.save_graph(g, path)
    return npf.load_graph(spark, path, 1 << 20).edges


# ---- nearest neighbours of whole vectors

NEAR = """v AS (SELECT vec_id AS id, label AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
pairs AS (SELECT a.id, a.y, b.id AS other, b.y AS other_y, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.id <> b.id),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM pairs)"""


def _labelled_vectors(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.col("label").alias("y"))


@query("nearest_vectors", f"WITH {NEAR} SELECT id, other, CAST(rank AS INTEGER) AS rank, round(d, 8) AS d FROM near WHERE rank <= 5")
def nearest_vectors(spark, d):
    v = _labelled_vectors(spark, d)
    return Cells(v).nearest(v, 5).select("id", "other", "rank", F.round("d", 8).alias("d"))


@query("nearest_of_label", f"WITH {NEAR}, own AS (SELECT id, other, d, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM pairs WHERE y = other_y) SELECT id, other, CAST(rank AS INTEGER) AS rank, round(d, 8) AS d FROM own WHERE rank <= 5")
def nearest_of_label(spark, d):
    v = _labelled_vectors(spark, d)
    return Cells(v, "y").nearest(v, 5).select("id", "other", "rank", F.round("d", 8).alias("d"))


@query("resample_tomek", f"WITH {NEAR}, one AS (SELECT * FROM near WHERE rank = 1), bad AS (SELECT a.id FROM one a JOIN one b ON a.other = b.id AND b.other = a.id WHERE a.y <> a.other_y) SELECT id, y FROM v WHERE id NOT IN (SELECT id FROM bad)")
def resample_tomek(spark, d):
    return lr.resampled(_labelled_vectors(spark, d), "tomek").select("id", "y")


@query("resample_enn", f"WITH {NEAR}, bad AS (SELECT id FROM near WHERE rank <= 3 GROUP BY id HAVING avg(CASE WHEN y = other_y THEN 1.0 ELSE 0.0 END) < 0.5) SELECT id, y FROM v WHERE id NOT IN (SELECT id FROM bad)")
def resample_enn(spark, d):
    return lr.resampled(_labelled_vectors(spark, d), "enn").select("id", "y")


def _resample(method):
    def made(spark, d):
        return lr.resampled(_labelled_vectors(spark, d), method).select("id", "y")

    return made


for _name in ("borderline_smote", "adasyn", "smote_tomek", "smote_enn"):
    QUERIES[f"resample_{_name}"] = _resample(_name)


@query("voronoi_whole", """WITH v AS (SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS coord FROM embeddings), d AS (SELECT c.node_id AS patch_id, v.node_id, list_distance(v.coord, c.coord) AS d FROM v JOIN v c ON c.node_id % 10 = 0),
m AS (SELECT *, min(d) OVER (PARTITION BY node_id) AS m FROM d) SELECT patch_id, node_id FROM m WHERE d = m OR d < 1.1 * m""")
def voronoi_whole(spark, d):
    """Patches around every tenth vector, over all of the vectors' components."""
    p = _labelled_vectors(spark, d).select(F.col("id").alias("node_id"), F.col("x").alias("coord"))
    return pt.voronoi(p, p.where("node_id % 10 = 0").select(F.col("node_id").alias("patch_id"), F.col("coord").alias("centre")), 1.1)


# ---- streams


@query("stream_keyed", f"WITH {TRANSITIONS}, ids AS (SELECT src AS id FROM transitions UNION SELECT dst FROM transitions) SELECT id, CAST(1 AS BIGINT) AS n, true AS in_range, true AS within_limit FROM ids")
def stream_keyed(spark, d):
    """A stream of all transitions in four micro-batches, nodes' clusters kept by key: each node once, in one of 8 clusters that hold the limit."""
    e = transitions(spark, d).select(F.col("event_id").alias("edge_seq"), "src", "dst")
    e = written(e.repartitionByRange(4, "edge_seq"), "stream-feed")
    n = e.select("src").union(e.select("dst")).distinct().count()
    path = folder(spark, "stream-keyed")
    feed = path + "-in"
    e.coalesce(4).write.parquet(feed)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    run = keyed.partition_stream(stream, path, n, 8)
    run.awaitTermination()
    batches = (run.lastProgress or {"batchId": -1})["batchId"] + 1
    state = written(keyed.clusters(spark, path, 8, batches), "stream-state")
    sizes = state.groupBy("cluster").agg((F.count("*") <= F.ceil(F.lit(1.1 * n / 8))).alias("within_limit"))
    per = state.join(F.broadcast(sizes), "cluster").groupBy("id")
    return per.agg(F.count("*").alias("n"), F.min(F.col("cluster").between(0, 7)).alias("in_range"), F.min("within_limit").alias("within_limit"))
