"""Queries over conversions, sinks, communities and partition guarantees, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import distance
from ..graph import Graph
from ..operators import align as al
from ..operators import clustering as cl
from ..operators import fixpoints as fx
from ..operators import measures as ms
from ..operators import patching as pt
from ..operators import sparsify as sp
from ..operators import synchronise as sy
from ..session import folder, written
from ..sources import datasets as ds
from ..sources import generators as gn
from ..streaming import partitioner as st
from .fixtures import COPART, PATCHES, TRADE, TRANSITIONS, copart, patches, t, trade, transitions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- graphs and conversions


@query("sorted_edges", f"WITH {TRADE} SELECT CAST(row_number() OVER (ORDER BY src, dst) - 1 AS BIGINT) AS pos, src, dst, weight FROM trade")
def sorted_edges(spark, d):
    return trade(spark, d).sorted_edges()


@query("graph_flags", """WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)
SELECT (SELECT count(*) FROM part) AS n_nodes, true AS has_labels, CAST(2 AS INTEGER) AS n_features, (SELECT count(*) FROM e) AS n_edges, false AS weighted""")
def graph_flags(spark, d):
    nodes = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("y"), F.array("p_retailprice", F.col("p_size").cast("double")).alias("x"))
    edges = t(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return Graph.from_edges(edges, nodes).flags()


@query("labelled_nodes", "SELECT doc_id AS id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def labelled_nodes(spark, d):
    docs = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return ds.labelled_only(docs.withColumnRenamed("doc_id", "id"), "quality")


@query("known_edges", f"WITH {TRANSITIONS}, known AS (SELECT s_suppkey AS id FROM supplier) SELECT event_id, src, dst FROM transitions WHERE src IN (SELECT id FROM known) AND dst IN (SELECT id FROM known)")
def known_edges(spark, d):
    return ds.edges_between(transitions(spark, d), t(spark, d, "supplier"), "s_suppkey").select("event_id", "src", "dst")


@query("snapshot_features", f"""WITH {TRANSITIONS}, e AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS timestamp, src, dst, value, event_id FROM transitions),
r AS (SELECT *, row_number() OVER (PARTITION BY timestamp, src, dst ORDER BY value, event_id) AS k FROM e) SELECT timestamp, src, dst, value, event_id FROM r WHERE k = 1""")
def snapshot_features(spark, d):
    e = transitions(spark, d).select(F.floor(F.unix_timestamp("ts") / 86400).alias("timestamp"), "src", "dst", "value", "event_id")
    return ds.snapshots(e)[0]


@query("graph_frames", f"""WITH {TRADE} SELECT src, dst, weight, CAST(7 AS BIGINT) AS timestamp FROM trade
UNION ALL SELECT l_suppkey, l_partkey, 1.0, CAST(0 AS BIGINT) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""")
def graph_frames(spark, d):
    other = Graph.from_edges(t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct())
    return ds.frames_of([(7, trade(spark, d)), (None, other)])[0]


@query("event_messages", f"""WITH {TRANSITIONS}, e AS (SELECT src, dst, ts AS timestamp, value, event_id FROM transitions)
SELECT CAST(row_number() OVER (ORDER BY timestamp, src, dst, value, event_id) - 1 AS BIGINT) AS pos, src, dst, round(value, 9) AS m0, CAST(event_id AS DOUBLE) AS m1 FROM e""")
def event_messages(spark, d):
    e = transitions(spark, d).withColumnRenamed("ts", "timestamp")
    return ds.event_stream(e, ["value", "event_id"]).select("pos", "src", "dst", F.round(F.col("msg")[0], 9).alias("m0"), F.col("msg")[1].alias("m1"))


def _papers(spark, d):
    """Orders as papers of their year; an order cites its customer's order before."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), "o_custkey")
    from pyspark.sql import Window

    before = F.lag("id").over(Window.partitionBy("o_custkey").orderBy("id"))
    cites = o.select(F.col("id").alias("src"), before.alias("dst")).where("dst is not null")
    return o.select("id", "year"), cites


PAPERS = """papers AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders),
cites AS (SELECT * FROM (SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)"""


@query("paper_labels", f"WITH {PAPERS} SELECT CAST(n AS BIGINT) AS id, CAST(coalesce(year - 1900, 0) AS INTEGER) AS y FROM papers")
def paper_labels(spark, d):
    return ds.papers_as_graph(ds.subset(*_papers(spark, d))).nodes


@query("paper_edges", f"WITH {PAPERS} SELECT CAST(a.n AS BIGINT) AS src, CAST(b.n AS BIGINT) AS dst, CAST(1 AS DOUBLE) AS weight FROM cites JOIN papers a ON src = a.id JOIN papers b ON dst = b.id")
def paper_edges(spark, d):
    return ds.papers_as_graph(ds.subset(*_papers(spark, d))).edges


@query("cached_subset", f"WITH {PAPERS} SELECT id, year FROM papers WHERE year BETWEEN (SELECT min(year) FROM papers) AND (SELECT min(year) + 1 FROM papers)")
def cached_subset(spark, d):
    """Made once, then read: the second call must not make it."""
    papers = _papers(spark, d)[0]
    first = papers.agg(F.min("year")).first()[0]
    root, what = folder(spark, "subsets"), {"first": first, "last": first + 1, "of": d}
    ds.cached_subset(spark, root, what, lambda: ds.papers_between(papers, first, first + 1))
    return ds.cached_subset(spark, root, what, lambda: papers.limit(0))


@query("transaction_statistics", """SELECT (SELECT count(*) FROM customer) AS n_nodes, count(*) AS n_edges, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 9) AS anomaly_share, round(sum(o_totalprice), 2) AS total_amount,
CAST(min(epoch(o_orderdate)) AS BIGINT) AS first, CAST(max(epoch(o_orderdate)) AS BIGINT) AS last FROM orders""")
def transaction_statistics(spark, d):
    e = t(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("is_anomaly"), F.col("o_totalprice").alias("btc_amount"), F.unix_timestamp("o_orderdate").alias("timestamp"))
    return ds.transaction_statistics(e, t(spark, d, "customer")).withColumns({"anomaly_share": F.round("anomaly_share", 9), "total_amount": F.round("total_amount", 2)})


@query("results_summary", """SELECT l_returnflag AS method, l_linenumber AS embedding_dim, count(*) AS runs, round(avg(l_tax), 9) AS accuracy_mean, round(stddev_samp(l_tax), 9) AS accuracy_std, round(avg(l_quantity), 6) AS total_time_mean, round(stddev_samp(l_quantity), 6) AS total_time_std FROM lineitem GROUP BY 1, 2""")
def results_summary(spark, d):
    runs = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("embedding_dim"), F.col("l_tax").alias("accuracy"), F.col("l_quantity").alias("total_time"))
    out = ds.results_summary(runs, ["method", "embedding_dim"], ["accuracy", "total_time"])
    return out.withColumns({c: F.round(c, 9 if c.startswith("acc") else 6) for c in out.columns if c.endswith(("_mean", "_std"))})


@query("embedding_round_trip", "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings")
def embedding_round_trip(spark, d):
    path = folder(spark, "embedding")
    ds.write_embedding(t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("X")), path, method="given")
    return ds.read_embedding(spark, f"{path}/embedding").select("vec_id", F.posexplode("embedding").alias("p", "v"))


@query("patch_coordinates", f"""WITH {PATCHES}, wanted AS (SELECT patch_id, node_id FROM (SELECT DISTINCT patch_id FROM members) CROSS JOIN (SELECT vec_id AS node_id FROM embeddings))
SELECT w.patch_id, w.node_id, m.node_id IS NOT NULL AS found, round(list_sum(m.coord), 6) AS total FROM wanted w LEFT JOIN members m ON w.patch_id = m.patch_id AND w.node_id = m.node_id""")
def patch_coordinates(spark, d):
    m = patches(spark, d)
    wanted = t(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("patch_id"))
    return pt.coordinates_of(m, wanted).select("patch_id", "node_id", "found", F.round(F.aggregate("coord", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("partition_patches", "SELECT label AS patch_id, vec_id AS node_id, CASE WHEN vec_id % 2 = 0 THEN round(CAST(embedding[1] AS DOUBLE), 9) END AS first FROM embeddings")
def partition_patches(spark, d):
    e = t(spark, d, "embeddings")
    p = e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    known = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("node_id"), F.transform("embedding", lambda x: x.cast("double")).alias("coord"))
    return pt.partition_members(p, known).select("patch_id", "node_id", F.round(F.get("coord", F.lit(0)), 9).alias("first"))


# ---- communities: every part with others of its block of 20 keys, and of the block shifted by ten

MEMBERS = "mem AS (SELECT p_partkey AS node_id, p_partkey // 20 AS community, (p_partkey % 10 + 1) / 20 AS st FROM part UNION ALL SELECT p_partkey, 1000000 + (p_partkey + 10) // 20, (p_partkey % 10 + 1) / 20 FROM part)"


def _members(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("node_id"), ((F.col("p_partkey") % 10 + 1) / 20).alias("strength"))
    return p.select("node_id", F.floor(F.col("node_id") / 20).alias("community"), "strength").unionAll(p.select("node_id", 1_000_000 + F.floor((F.col("node_id") + 10) / 20), "strength"))


PAIRS = f"WITH {MEMBERS}, p AS (SELECT x.node_id AS a, y.node_id AS b, x.st AS sa, y.st AS sb FROM mem x JOIN mem y USING (community) WHERE x.node_id < y.node_id)"


@query("agm_probabilities", f"{PAIRS} SELECT a, b, round(1 - power(0.7, count(*)), 9) AS p FROM p GROUP BY 1, 2")
def agm_probabilities(spark, d):
    return gn.agm_probabilities(_members(spark, d), 0.3).withColumn("p", F.round("p", 9))


@query("overlap_probabilities", f"""{PAIRS} SELECT a, b, round(least(1.0, 0.5 * sum(sa * sb)), 9) AS product, round(0.5 * max(least(sa, sb)), 9) AS strongest, round(1 - exp(sum(ln(1 - 0.5 * sa * sb))), 11) AS noisy FROM p GROUP BY 1, 2""")
def overlap_probabilities(spark, d):
    m = _members(spark, d)
    p = lambda how, name: gn.overlap_probabilities(m, how).select("a", "b", F.round("p", 9).alias(name))
    out = p("strength_product", "product").join(p("max_strength", "strongest"), ["a", "b"])
    return out.join(gn.overlap_probabilities(m, "noisy_or").select("a", "b", F.round("p", 11).alias("noisy")), ["a", "b"])


@query("osbm_probabilities", """WITH mem AS (SELECT n_nationkey AS node_id, CAST(n_regionkey AS BIGINT) AS community FROM nation UNION SELECT n_nationkey, 5 + CAST(n_nationkey % 5 AS BIGINT) FROM nation),
mix AS (SELECT a.r AS c, b.r AS d, CASE WHEN a.r = b.r THEN 0.4 ELSE 0.05 END AS p FROM range(10) a(r), range(10) b(r))
SELECT x.node_id AS a, y.node_id AS b, round(1 - exp(sum(ln(1 - p))), 9) AS p FROM mem x JOIN mix ON x.community = c JOIN mem y ON y.community = d WHERE x.node_id < y.node_id GROUP BY 1, 2""")
def osbm_probabilities(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("node_id"), "n_regionkey")
    m = n.select("node_id", F.col("n_regionkey").cast("long").alias("community")).union(n.select("node_id", (5 + F.col("node_id") % 5).cast("long")))
    mix = spark.range(100).select(F.floor(F.col("id") / 10).alias("c"), (F.col("id") % 10).alias("d")).withColumn("p", F.when(F.col("c") == F.col("d"), 0.4).otherwise(0.05))
    return gn.osbm_probabilities(m, mix).withColumn("p", F.round("p", 9))


@query("roc_probabilities", f"{PAIRS} SELECT DISTINCT a, b, 0.3 AS p FROM p")
def roc_probabilities(spark, d):
    m = _members(spark, d)
    return gn.roc_probabilities(m, m, 0.3, 0.01)


@query("community_embeddings", f"WITH {MEMBERS}, c AS (SELECT node_id, 2 * pi() * community / 97.0 AS angle FROM mem) SELECT node_id, round(avg(cos(angle)), 6) AS x, round(avg(sin(angle)), 6) AS y FROM c GROUP BY 1")
def community_embeddings(spark, d):
    return gn.community_embeddings(_members(spark, d), 97).select("node_id", F.round(F.col("coord")[0], 6).alias("x"), F.round(F.col("coord")[1], 6).alias("y"))


@query("strength_statistics", f"WITH {MEMBERS} SELECT community, count(*) AS n, round(avg(st), 9) AS mean, round(stddev_pop(st), 9) AS std, min(st) AS least, max(st) AS largest FROM mem GROUP BY 1")
def strength_statistics(spark, d):
    return ms.strength_statistics(_members(spark, d)).withColumns({c: F.round(c, 9) for c in ("mean", "std")})


@query("roc_membership_counts", "SELECT CAST(500 AS BIGINT) AS nodes, true AS all_in_range, true AS one_or_two")
def roc_membership_counts(spark, d):
    per = gn.roc_memberships(spark, 500, 8).groupBy("node_id").agg(F.count_distinct("community").alias("n"), F.max("community").alias("top"))
    return per.agg(F.count("*").alias("nodes"), (F.max("top") < 8).alias("all_in_range"), ((F.min("n") == 1) & (F.max("n") == 2)).alias("one_or_two"))


# ---- guarantees of partitions, patches, trees and samples: a row for each node or edge, and what must hold of it


def _held(g, p, k: int, limit: float):
    """(id, placed, within): whether each node has a cluster, and that cluster no more than its limit of nodes."""
    n = g.nodes.count()
    size = p.groupBy("cluster").agg(F.count("*").alias("n"))
    most = max(int(limit * n / k), -(-n // k))
    mine = p.join(size, "cluster").select("id", ((F.col("cluster") >= 0) & (F.col("cluster") < k)).alias("placed"), (F.col("n") <= most).alias("within"))
    return g.ids.join(mine, "id", "left")


HELD = f"WITH {COPART} SELECT id, true AS placed, true AS within FROM nodes"


@query("fennel_guarantees", HELD)
def fennel_guarantees(spark, d):
    g = copart(spark, d)
    return _held(g, cl.fennel(g, 8), 8, 1.1)


@query("exact_fennel_guarantees", HELD)
def exact_fennel_guarantees(spark, d):
    g = copart(spark, d)
    return _held(g, cl.fennel(g, 8, mode="exact"), 8, 1.1)


@query("multilevel_guarantees", HELD)
def multilevel_guarantees(spark, d):
    g = copart(spark, d)
    return _held(g, cl.multilevel(g, 8, coarsest=400), 8, 1.15)


@query("multilevel_beats_hashing", "SELECT true AS better, true AS than_bulk_fennel_times_two")
def multilevel_beats_hashing(spark, d):
    """Its cut is below that of clusters dealt by hash, and at most twice bulk FENNEL's."""
    g = copart(spark, d)
    cut = lambda p: g.clustered(p).where("cs <> cd").count()
    a, b, c = (cut(p) for p in (cl.multilevel(g, 8, coarsest=400), g.ids.withColumn("cluster", F.pmod(F.xxhash64("id"), F.lit(8))), cl.fennel(g, 8)))
    return spark.range(1).select(F.lit(a < b).alias("better"), F.lit(a <= 2 * c).alias("than_bulk_fennel_times_two"))


@query("spread_guarantees", f"WITH {COPART} SELECT id, true AS placed FROM nodes")
def spread_guarantees(spark, d):
    g = copart(spark, d)
    return g.ids.join(cl.spread(g, 8).select("id", (F.col("cluster") >= 0).alias("placed")), "id", "left")


@query("hierarchical_guarantees", f"WITH {COPART} SELECT id, true AS within FROM nodes")
def hierarchical_guarantees(spark, d):
    g = copart(spark, d)
    p = cl.hierarchical(g, 400, 4, method=cl.exact_fennel)
    size = p.groupBy("cluster").agg(F.count("*").alias("n"))
    return g.ids.join(p.join(size, "cluster").select("id", (F.col("n") <= 400).alias("within")), "id", "left")


@query("louvain_guarantees", f"WITH {COPART} SELECT id, true AS placed, true AS in_its_component FROM nodes")
def louvain_guarantees(spark, d):
    """A community never reaches over components."""
    g = copart(spark, d)
    p, label = cl.louvain(g), fx.component_labels(g)
    both = p.join(label, "id")
    whole = both.groupBy("cluster").agg((F.min("label") == F.max("label")).alias("in_its_component"))
    return g.ids.join(both.join(whole, "cluster").select("id", F.lit(True).alias("placed"), "in_its_component"), "id", "left")


@query("merged_clusters_guarantees", "SELECT CAST(n_nationkey AS BIGINT) AS id, true AS large_enough FROM nation")
def merged_clusters_guarantees(spark, d):
    p = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.floor(F.sqrt("n_nationkey")).cast("long").alias("cluster"))
    m = pt.merge_small(trade(spark, d), p, 5)
    return m.join(m.groupBy("cluster").agg(F.count("*").alias("n")), "cluster").select("id", (F.col("n") >= 5).alias("large_enough"))


@query("created_patches_cover", f"WITH {COPART} SELECT id AS node_id, id % 8 AS patch_id, true AS held FROM nodes")
def created_patches_cover(spark, d):
    """Every part is within its patch."""
    g = copart(spark, d)
    m, _ = pt.create_patches(g, g.ids.withColumn("cluster", F.col("id") % 8), min_overlap=6, target_overlap=12)
    own = g.ids.select(F.col("id").alias("node_id"), (F.col("id") % 8).alias("patch_id"))
    return own.join(m.withColumn("held", F.lit(True)), ["node_id", "patch_id"], "left")


@query("created_patches_connected", "SELECT true AS connected, true AS enough")
def created_patches_connected(spark, d):
    """The patch graph hangs together over overlaps of at least the size asked for."""
    g = copart(spark, d)
    m, near = pt.create_patches(g, g.ids.withColumn("cluster", F.col("id") % 8), min_overlap=6, target_overlap=12)
    c = fx.is_connected(Graph.from_edges(near.where("n >= 6").select(F.col("i").alias("src"), F.col("j").alias("dst")), m.select(F.col("patch_id").alias("id")).distinct()))
    return c.select("connected", (F.col("n_components") == 1).alias("enough"))


@query("patches_by_size", f"WITH {COPART} SELECT id AS node_id, true AS held FROM nodes")
def patches_by_size(spark, d):
    g = copart(spark, d)
    m, _ = pt.create_patches_by_size(g, 300, min_overlap=6, target_overlap=12)
    return g.ids.select(F.col("id").alias("node_id")).join(m.select("node_id").distinct().withColumn("held", F.lit(True)), "node_id", "left")


@query("spanning_forest_edges", f"""WITH RECURSIVE {COPART}, reach AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, c.dst FROM reach r JOIN copart c ON c.src = r.other),
label AS (SELECT id, min(other) AS label FROM reach GROUP BY 1) SELECT label, CAST(count(*) - 1 AS BIGINT) AS tree_edges, true AS spans FROM label GROUP BY 1""")
def spanning_forest_edges(spark, d):
    """Every component's tree has an edge less than it has nodes, all of them edges of the graph, and joins all of its nodes."""
    g = copart(spark, d)
    tree = fx.spanning_forest(g)
    real = tree.join(g.edges.select("src", "dst"), ["src", "dst"], "left_semi")
    label = fx.component_labels(g)
    per = real.join(label.select(F.col("id").alias("src"), "label"), "src").groupBy("label").agg(F.count("*").alias("tree_edges"))
    inner = fx.component_labels(Graph.from_edges(real.select("src", "dst"), g.nodes))
    whole = label.join(inner.withColumnRenamed("label", "tree"), "id").groupBy("label").agg((F.count_distinct("tree") == 1).alias("spans"))
    return whole.join(per, "label", "left").select("label", F.coalesce("tree_edges", F.lit(0)).alias("tree_edges"), "spans")


SYM = f"{TRADE}, sym AS (SELECT src, dst, max(weight) AS weight FROM (SELECT * FROM trade UNION ALL SELECT dst, src, weight FROM trade) WHERE src <> dst GROUP BY 1, 2)"


def _subset_of(spark, d, method):
    e = trade(spark, d).undirected().edges.where("src <> dst")
    kept = sp.sparsify(e, method, 4.0)
    odd = kept.join(e.select("src", "dst"), ["src", "dst"], "left_anti").count()
    one_way = kept.select("src", "dst").join(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti").count()
    nodes = e.select(F.col("src").alias("id")).distinct()
    c = fx.component_labels(Graph.from_edges(kept.select("src", "dst"), nodes))
    whole = c.select("label").distinct().count() == 1
    return c.select("id", F.lit(odd == 0).alias("real_edges"), F.lit(one_way == 0).alias("both_ways"), F.lit(whole).alias("connected"))


for _method in ("resistance", "sample", "rmst", "neighbors"):

    def _sparse(spark, d, method=_method):
        return _subset_of(spark, d, method)

    QUERIES[f"sparsify_{_method}_guarantees"] = _sparse
    SQL[f"sparsify_{_method}_guarantees"] = f"WITH {SYM} SELECT DISTINCT src AS id, true AS real_edges, true AS both_ways, true AS connected FROM sym"


@query("negative_edges_hold", "SELECT CAST(200 AS BIGINT) AS n, true AS none_is_an_edge")
def negative_edges_hold(spark, d):
    g = copart(spark, d)
    found = gn.negative_edges(g, 200)
    bad = found.join(g.edges.select("src", "dst"), ["src", "dst"], "left_semi").count()
    return found.agg(F.count("*").alias("n"), F.lit(bad == 0).alias("none_is_an_edge"))


@query("positive_edges_hold", "SELECT CAST(200 AS BIGINT) AS n, true AS all_are_edges")
def positive_edges_hold(spark, d):
    g = copart(spark, d)
    found = gn.positive_edges(g, 200)
    bad = found.join(g.edges.select("src", "dst"), ["src", "dst"], "left_anti").count()
    return found.agg(F.count("*").alias("n"), F.lit(bad == 0).alias("all_are_edges"))


# ---- alignment: each node's distance to where it belongs

OWN = f"WITH {PATCHES} SELECT DISTINCT node_id, true AS close FROM members"


def _turned(spark, d):
    """The patches, each scaled, turned in the planes of neighbouring dimensions, and moved, by its number."""
    m = patches(spark, d)
    c, s, k = F.cos(F.col("patch_id") * 0.7), F.sin(F.col("patch_id") * 0.7), 1 + F.col("patch_id") / 10.0
    x = F.col("coord")
    turned = F.transform(x, lambda v, i: F.when(i % 2 == 0, c * v - s * F.get(x, i + 1)).otherwise(s * F.get(x, i - 1) + c * v))
    return m.select("patch_id", "node_id", F.transform(turned, lambda v: v * k + F.col("patch_id")).alias("coord"))


def _residual(spark, d, found, limit: float):
    """(node_id, close): after the best similarity onto the vectors themselves, by one more pair of patches."""
    truth = patches(spark, d).dropDuplicates(["node_id"]).select(F.lit(0).alias("patch_id"), "node_id", "coord")
    both = truth.unionByName(found.select(F.lit(1).alias("patch_id"), "node_id", "coord"))
    _, aligned = al.two_patches_aligned(both)
    a, b = (aligned.where(F.col("patch_id") == k).select("node_id", F.col("coord").alias("ab"[k])) for k in (0, 1))
    return a.join(b, "node_id").select("node_id", (distance(F.col("a"), F.col("b")) < limit).alias("close"))


@query("aligned_nodes", OWN)
def aligned_nodes(spark, d):
    return _residual(spark, d, al.local_to_global(_turned(spark, d))[0], 1e-5)


@query("aligned_nodes_by_tables", OWN)
def aligned_nodes_by_tables(spark, d):
    return _residual(spark, d, al.local_to_global(_turned(spark, d), solver="tables")[0], 1e-5)


def _overlaps_of_turned(spark, d):
    moments = written(al.overlap_moments(_turned(spark, d)), "moments")
    return moments, sy.strengths(moments)


@query("synchronised_scales", f"WITH {PATCHES}, p AS (SELECT DISTINCT patch_id FROM members) SELECT CAST(patch_id AS BIGINT) AS id, round((1 + patch_id / 10.0) / avg(1 + patch_id / 10.0) OVER (), 6) AS scale FROM p")
def synchronised_scales(spark, d):
    """What each patch was scaled by, of mean 1."""
    return sy.scales(*_overlaps_of_turned(spark, d)).select("id", F.round(F.col("v")[0], 6).alias("scale"))


@query("synchronised_rotations", f"""WITH {PATCHES}, p AS (SELECT DISTINCT patch_id FROM members), b AS (SELECT min(patch_id) AS base FROM p), c AS (SELECT unnest(range(64)) AS place)
SELECT CAST(patch_id AS BIGINT) AS id, CAST(place AS INTEGER) AS place, 0.0 + round(CASE WHEN place // 8 = place % 8 THEN cos(0.7 * (patch_id - base)) WHEN place % 8 = place // 8 + 1 AND place % 2 = 1 THEN -sin(0.7 * (patch_id - base)) WHEN place // 8 = place % 8 + 1 AND place % 2 = 0 THEN sin(0.7 * (patch_id - base)) ELSE 0 END, 6) AS value FROM p, b, c""")
def synchronised_rotations(spark, d):
    """All entries of the matrices that turn each patch onto the first."""
    return sy.rotations(*_overlaps_of_turned(spark, d), 8).select("id", F.posexplode("v").alias("place", "value")).withColumn("value", F.round("value", 6) + 0.0)


@query("aligned_nodes_geometric", OWN)
def aligned_nodes_geometric(spark, d):
    return _residual(spark, d, al.geometric(_turned(spark, d), epochs=200)[0], 1e-3)


@query("aligned_nodes_sequential", OWN)
def aligned_nodes_sequential(spark, d):
    return _residual(spark, d, al.recombined(al.procrustes_sequential(_turned(spark, d))), 1e-5)


@query("aligned_nodes_iterative", OWN)
def aligned_nodes_iterative(spark, d):
    return _residual(spark, d, al.aligned_iteratively(_turned(spark, d))[0], 1e-5)


@query("aligned_with_noise", OWN)
def aligned_with_noise(spark, d):
    """With noise of a hundredth of the vectors' spread, every node stays within a tenth of it."""
    m = _turned(spark, d)
    noisy = m.withColumn("coord", F.transform("coord", lambda v, i: v + 0.01 * (gn.uniform("patch_id", "node_id", i) - 0.5)))
    return _residual(spark, d, al.local_to_global(noisy)[0], 0.1)


@query("two_patches_aligned", f"WITH {PATCHES} SELECT node_id, true AS close FROM members WHERE patch_id = 0 UNION SELECT node_id, true FROM members WHERE patch_id = 1")
def two_patches_aligned(spark, d):
    two = _turned(spark, d).where("patch_id in (0, 1)")
    return _residual(spark, d, al.two_patches_aligned(two)[0], 1e-5)


# ---- streams


@query("stream_patches", f"WITH {TRANSITIONS} SELECT DISTINCT node_id, true AS in_own_patch, true AS neighbours_too FROM (SELECT src AS node_id FROM transitions WHERE src <> dst UNION SELECT dst FROM transitions WHERE src <> dst)")
def stream_patches(spark, d):
    """Patches written from a partitioned stream: each node in its own cluster's patch, with all of its neighbours."""
    e = transitions(spark, d).where("src <> dst").select(F.col("event_id").alias("edge_seq"), "src", "dst")
    n = e.select("src").union(e.select("dst")).distinct().count()
    path = folder(spark, "stream-patches")
    st.write_stream_patches(e, written(st.step(None, e, n, 4), "stream-state"), path)
    own = spark.read.parquet(f"{path}/clusters")
    members = spark.read.parquet(f"{path}/members").select(F.col("patch_id").cast("long").alias("patch_id"), "node_id")
    inside = own.join(members, (F.col("id") == F.col("node_id")) & (F.col("cluster") == F.col("patch_id")), "left_semi").select("id", F.lit(True).alias("in_own_patch"))
    both = spark.read.parquet(f"{path}/edges").join(own.withColumnRenamed("id", "src"), "src")
    missing = both.join(members, (F.col("cluster") == F.col("patch_id")) & (F.col("dst") == F.col("node_id")), "left_anti").select(F.col("src").alias("id")).distinct().withColumn("lost", F.lit(True))
    return own.select("id").join(inside, "id", "left").join(missing, "id", "left").select(F.col("id").alias("node_id"), "in_own_patch", F.col("lost").isNull().alias("neighbours_too"))
