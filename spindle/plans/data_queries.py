"""Queries over sources, generators, clusterings, embeddings, classifiers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import row_normalised
from ..graph import Graph
from ..operators import clustering as cl
from ..operators import embedding as em
from ..operators import learning as lr
from ..operators import measures as ms
from ..operators import patching as pt
from ..sources import datasets as ds
from ..sources import generators as gn
from ..streaming import partitioner as st
from .fixtures import COPART, PATCHES, TRADE, copart, patches, t, trade, transitions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- sources


@query("dataset_catalog", "SELECT * FROM (VALUES ('cora', 2708, 1433, 7), ('citeseer', 3327, 3703, 6), ('pubmed', 19717, 500, 3)) t(name, n_nodes, n_features, n_classes)")
def dataset_catalog(spark, d):
    return ds.catalog(spark)


@query("dense_ids", "SELECT p_name AS key, CAST(row_number() OVER (ORDER BY p_name) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT p_name FROM part)")
def dense_ids(spark, d):
    return ds.dense_ids(t(spark, d, "part").select(F.col("p_name").alias("key")), "key")


@query("encoded_nodes", """WITH k AS (SELECT DISTINCT c_name AS key FROM customer), n AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS id FROM k)
SELECT CAST(id AS BIGINT) AS id, n.key, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS y FROM n JOIN customer ON c_name = n.key""")
def encoded_nodes(spark, d):
    c = t(spark, d, "customer")
    return ds.encode_triples(c.select(F.col("c_name").alias("key")), c.select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("class")), _cites(spark, d), {"BUILDING": 1, "MACHINERY": 2})[0]


def _cites(spark, d):
    """Customers to customers of the next number in the same nation's list, some of them unknown."""
    c = t(spark, d, "customer")
    return c.select(F.col("c_name").alias("a"), F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 5 == 0, "?").otherwise("")).alias("b"))


@query("encoded_edges", """WITH k AS (SELECT DISTINCT c_name AS key FROM customer), n AS (SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS id FROM k),
e AS (SELECT c_name AS a, c_name || CASE WHEN c_custkey % 5 = 0 THEN '?' ELSE '' END AS b FROM customer) SELECT x.id AS src, y.id AS dst FROM e JOIN n x ON a = x.key JOIN n y ON b = y.key""")
def encoded_edges(spark, d):
    c = t(spark, d, "customer").select(F.col("c_name").alias("key"))
    return ds.encode_edges(_cites(spark, d), ds.dense_ids(c, "key"))


@query("labelled_scan", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand IS NOT NULL AND p_size BETWEEN 10 AND 20")
def labelled_scan(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_brand", "p_size").where("p_brand is not null and p_size between 10 and 20")


@query("edges_between_known", f"WITH {COPART} SELECT src, dst FROM copart WHERE src IN (SELECT p_partkey FROM part WHERE p_size < 25) AND dst IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def edges_between_known(spark, d):
    known = t(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("id"))
    e = copart(spark, d).edges.select("src", "dst")
    return e.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


@query("label_codes", "SELECT c_custkey, CASE WHEN c_mktsegment IS NULL THEN 0 WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN c_mktsegment = 'HOUSEHOLD' THEN 2 ELSE 3 END AS y FROM customer")
def label_codes(spark, d):
    return t(spark, d, "customer").select("c_custkey", ds.label_codes(F.col("c_mktsegment"), {"BUILDING": 1, "HOUSEHOLD": 2}).alias("y"))


@query("log_features", "SELECT c_custkey AS id, round(ln(1 + greatest(coalesce(c_acctbal, 0), 0)), 9) AS x0, round(ln(1 + greatest(c_nationkey, 0)), 9) AS x1 FROM customer")
def log_features(spark, d):
    x = ds.feature_matrix(t(spark, d, "customer").withColumnRenamed("c_custkey", "id"), ["c_acctbal", "c_nationkey"])
    return x.select("id", F.round(F.col("x")[0], 9).alias("x0"), F.round(F.col("x")[1], 9).alias("x1"))


@query("row_normalised", "SELECT l_orderkey, l_linenumber, round(l_quantity / s, 9) AS a, round(l_discount / s, 9) AS b FROM (SELECT *, CASE WHEN l_quantity + l_discount = 0 THEN 1 ELSE l_quantity + l_discount END AS s FROM lineitem)")
def row_normalised_features(spark, d):
    x = t(spark, d, "lineitem").withColumn("x", row_normalised(F.array("l_quantity", "l_discount")))
    return x.select("l_orderkey", "l_linenumber", F.round(F.col("x")[0], 9).alias("a"), F.round(F.col("x")[1], 9).alias("b"))


@query("bidirectional_edges", f"WITH {TRADE} SELECT src, dst, weight FROM trade UNION ALL SELECT dst, src, weight FROM trade")
def bidirectional_edges(spark, d):
    return ds.bidirectional(trade(spark, d).edges)


PAPERS = "papers AS (SELECT p_partkey AS id, 1980 + p_size AS year, p_brand AS field FROM part)"


def _papers(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), (1980 + F.col("p_size")).alias("year"), F.col("p_brand").alias("field"))


@query("papers_in_window", f"WITH {PAPERS} SELECT * FROM papers WHERE year BETWEEN 2000 AND 2005")
def papers_in_window(spark, d):
    return ds.papers_between(_papers(spark, d), 2000)


@query("papers_of_fields", f"WITH {PAPERS} SELECT * FROM papers WHERE field IN (SELECT field FROM papers GROUP BY field ORDER BY field LIMIT 2)")
def papers_of_fields(spark, d):
    p = _papers(spark, d)
    return ds.papers_of_fields(p, [r[0] for r in p.select("field").distinct().orderBy("field").limit(2).collect()])


@query("most_cited_papers", f"WITH {COPART}, {PAPERS}, top AS (SELECT dst FROM copart GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 50) SELECT * FROM papers WHERE id IN (SELECT dst FROM top)")
def most_cited_papers(spark, d):
    return ds.most_cited(_papers(spark, d), copart(spark, d).edges, 50)


SUBSET = f"""{COPART}, {PAPERS}, w AS (SELECT * FROM papers WHERE year BETWEEN 1990 AND 2010), n AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS n FROM w),
s AS (SELECT 'node' AS type, n AS id, w.id AS original_id, year, NULL AS source, NULL AS target FROM w JOIN n USING (id)
UNION ALL SELECT 'edge', NULL, NULL, NULL, a.n, b.n FROM copart JOIN n a ON src = a.id JOIN n b ON dst = b.id)"""


@query("citation_subset", f"WITH {SUBSET} SELECT type, coalesce(id, -1) AS id, coalesce(original_id, -1) AS original_id, coalesce(year, -1) AS year, coalesce(source, -1) AS source, coalesce(target, -1) AS target FROM s")
def citation_subset(spark, d):
    s = ds.subset(ds.papers_between(_papers(spark, d), 1990, 2010), copart(spark, d).edges)
    return s.na.fill(-1)


@query("citation_statistics", f"WITH {SUBSET} SELECT CAST(count(*) FILTER (type = 'node') AS BIGINT) AS n_nodes, CAST(count(*) FILTER (type = 'edge') AS BIGINT) AS n_edges, min(year) AS first_year, max(year) AS last_year, CAST(count(DISTINCT year) AS BIGINT) AS n_years FROM s")
def citation_statistics(spark, d):
    return ds.subset_statistics(ds.subset(ds.papers_between(_papers(spark, d), 1990, 2010), copart(spark, d).edges))


@query("transaction_labels", "SELECT l_orderkey * 10 + l_linenumber AS transaction_id, l_returnflag = 'R' AS is_anomaly FROM lineitem")
def transaction_labels(spark, d):
    e = t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"), (F.col("l_returnflag") == "R").cast("int").alias("is_anomaly"))
    return ds.anomaly_labels(e)


@query("synthetic_transactions")
def synthetic_transactions(spark, d):
    return ds.transactions(spark)[0]


@query("patches_json_round_trip", f"WITH {PATCHES} SELECT patch_id, node_id, round(coord[1], 9) AS v FROM members")
def patches_json_round_trip(spark, d):
    return ds.patches_from_json(ds.patches_as_json(patches(spark, d))).select("patch_id", "node_id", F.round(F.col("coord")[0], 9).alias("v"))


@query("exact_sample", "SELECT CAST(100 AS BIGINT) AS n")
def exact_sample(spark, d):
    return ds.exact_sample(t(spark, d, "customer"), 100, "c_custkey").agg(F.count_distinct("c_custkey").alias("n"))


# ---- generators


@query("random_community_graph")
def random_community_graph(spark, d):
    m = gn.memberships(spark, 150, 6)
    return gn.drawn(gn.agm_probabilities(m, 0.3), m, 0.01).edges


@query("negative_edge_sample")
def negative_edge_sample(spark, d):
    return gn.negative_edges(copart(spark, d), 200)


@query("positive_edge_sample")
def positive_edge_sample(spark, d):
    return gn.positive_edges(copart(spark, d), 200)


@query("gaussian_clusters")
def gaussian_clusters(spark, d):
    return gn.clusters(spark)


# ---- clustering


def _stats(g, p):
    return ms.cluster_sizes(p).join(ms.modularity(g, p))


@query("cluster_fennel")
def cluster_fennel(spark, d):
    return cl.fennel(copart(spark, d), 8, mode="exact")


@query("cluster_fennel_bulk")
def cluster_fennel_bulk(spark, d):
    return cl.fennel(copart(spark, d), 8, mode="bulk")


@query("cluster_spread")
def cluster_spread(spark, d):
    return cl.spread(copart(spark, d), 8)


@query("cluster_louvain")
def cluster_louvain(spark, d):
    g = copart(spark, d)
    return _stats(g, cl.louvain(g))


@query("cluster_multilevel")
def cluster_multilevel(spark, d):
    return cl.multilevel(copart(spark, d), 8, coarsest=400)


@query("cluster_hierarchical")
def cluster_hierarchical(spark, d):
    return cl.hierarchical(copart(spark, d), 400, 4, method=cl.exact_fennel)


# ---- embeddings


def _small(spark, d):
    """Trade between nations, both ways."""
    g = trade(spark, d)
    return Graph(g.undirected().edges.where("src <> dst"), g.nodes)


for _name in ("dgi", "gin", "gat"):

    def _embed(spark, d, name=_name):
        return em.full_graph(_small(spark, d), 4, name, epochs=20)

    QUERIES[f"embed_{_name}"] = _embed


@query("embed_patched")
def embed_patched(spark, d):
    g = copart(spark, d)
    p = cl.fennel(g, 4)
    m, _ = pt.create_patches(g, p, 20, 60, method="none")
    return em.patched(g, m, 4, "svd", least=5)


# ---- classification


def _vectors(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double")).alias("x"), F.col("label").alias("y"))


@query("classify_logistic")
def classify_logistic(spark, d):
    v = ms.stratified_split(_vectors(spark, d))
    return lr.classified(v.where("part = 'train'"), v.where("part = 'test'"))


for _name in ("forest", "rbf"):

    def _classify(spark, d, name=_name):
        v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.col("label").alias("y"))
        v = ms.stratified_split(v)
        return lr.classified(v.where("part = 'train'"), v.where("part = 'test'"), name)

    QUERIES[f"classify_{_name}"] = _classify


@query("resample_over", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label AS y, CAST((SELECT max(n) FROM n) AS BIGINT) AS n FROM n")
def resample_over(spark, d):
    return lr.resampled(_vectors(spark, d), "ros").groupBy("y").agg(F.count("*").alias("n"))


@query("resample_under", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label AS y, CAST((SELECT min(n) FROM n) AS BIGINT) AS n FROM n")
def resample_under(spark, d):
    return lr.resampled(_vectors(spark, d), "rus").groupBy("y").agg(F.count("*").alias("n"))


@query("resample_smote")
def resample_smote(spark, d):
    return lr.resampled(_vectors(spark, d), "smote").select("id", "y")


@query("class_weights", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT vec_id AS id, round((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n), 9) AS weight FROM embeddings JOIN n USING (label)")
def class_weights(spark, d):
    return lr.resampled(_vectors(spark, d), "class_weight").select("id", F.round("weight", 9).alias("weight"))


# ---- streams


@query("streaming_partition")
def streaming_partition(spark, d):
    e = transitions(spark, d).select(F.col("event_id").alias("edge_seq"), "src", "dst")
    n = e.select("src").union(e.select("dst")).distinct().count()
    return st.step(None, e, n, 4)


@query("windowed_edges", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, user_id AS src, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def windowed_edges(spark, d):
    e = t(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("src"))
    return st.windowed_edges(e).withColumn("start", F.date_format("start", "yyyy-MM-dd"))
