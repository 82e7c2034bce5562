"""Queries over graphs, partitions and labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import distance
from ..operators import fixpoints as fx
from ..operators import measures as ms
from .fixtures import COPART, LABELLED, PATCHES, TRADE, TRANSITIONS, copart, labelled, patches, region_partition, t, trade, transitions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


@query("quotient_conductance", f"""WITH {TRADE},
e AS (SELECT a.region AS cs, b.region AS cd, weight FROM trade JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id),
q AS (SELECT cs AS src, cd AS dst, CAST(count(*) AS BIGINT) AS edges, sum(weight) AS weight FROM e GROUP BY 1, 2),
c AS (SELECT cs, count(*) AS vol, count(*) FILTER (cs <> cd) AS cut, (SELECT count(*) FROM trade) AS total FROM e GROUP BY 1)
SELECT src, dst, edges, weight, round(cut / least(vol, total - vol), 9) AS conductance FROM q JOIN c ON q.src = c.cs""")
def quotient_conductance(spark, d):
    g, p = trade(spark, d), region_partition(spark, d)
    c = g.conductance(p).select(F.col("cluster").alias("src"), F.round("conductance", 9).alias("conductance"))
    return g.quotient(p).withColumnRenamed("count", "edges").join(c, "src")


@query("out_degrees", f"""WITH {COPART}
SELECT src AS id, CAST(count(*) AS BIGINT) AS degree, sum(weight) AS strength FROM copart GROUP BY 1""")
def out_degrees(spark, d):
    return copart(spark, d).out_degrees()


@query("csr_offsets", f"""WITH {COPART}, deg AS (SELECT src AS id, count(*) AS n FROM copart GROUP BY 1)
SELECT id, CAST(sum(n) OVER (ORDER BY id) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY id) AS BIGINT) AS "end" FROM deg""")
def csr_offsets(spark, d):
    return copart(spark, d).offsets()


@query("undirected_test", f"""WITH {COPART}, {TRADE.replace('nodes AS', 'nations AS')}
SELECT 'copart' AS graph, NOT EXISTS (SELECT src, dst, weight FROM copart EXCEPT SELECT dst, src, weight FROM copart) AS undirected
UNION ALL SELECT 'trade', NOT EXISTS (SELECT src, dst, weight FROM trade EXCEPT SELECT dst, src, weight FROM trade)""")
def undirected_test(spark, d):
    one = copart(spark, d).is_undirected().select(F.lit("copart").alias("graph"), "undirected")
    return one.unionAll(trade(spark, d).is_undirected().select(F.lit("trade").alias("graph"), "undirected"))


@query("neighbours", f"""WITH {TRADE} SELECT src, dst, weight FROM trade WHERE src IN (0, 3, 7)""")
def neighbours(spark, d):
    return trade(spark, d).neighbours(ids(spark, 0, 3, 7))


@query("neighbour_union", f"""WITH {COPART} SELECT DISTINCT dst AS id FROM copart WHERE src IN (SELECT id FROM nodes WHERE id % 50 = 0)""")
def neighbour_union(spark, d):
    g = copart(spark, d)
    return g.neighbours(g.ids.where("id % 50 = 0")).select(F.col("dst").alias("id")).distinct()


@query("edge_existence", f"""WITH {COPART}, pairs AS (SELECT a.id AS src, b.id AS dst FROM nodes a JOIN nodes b ON b.id = a.id + 1)
SELECT p.src, p.dst, c.src IS NOT NULL AS found FROM pairs p LEFT JOIN copart c ON p.src = c.src AND p.dst = c.dst""")
def edge_existence(spark, d):
    g = copart(spark, d)
    a, b = g.ids.withColumnRenamed("id", "src"), g.ids.withColumnRenamed("id", "dst")
    return g.has_edges(a.join(b, F.col("dst") == F.col("src") + 1))


@query("k_hop", f"""WITH RECURSIVE {COPART},
hop AS (SELECT id, 0 AS level FROM nodes WHERE id % 100 = 0 UNION SELECT dst, level + 1 FROM hop JOIN copart ON src = id WHERE level < 2)
SELECT id, min(level) AS level FROM hop GROUP BY 1""")
def k_hop(spark, d):
    g = copart(spark, d)
    return g.within_hops(g.ids.where("id % 100 = 0"), 2)


@query("khop_subgraph", f"""WITH RECURSIVE {COPART},
hop AS (SELECT id, 0 AS level FROM nodes WHERE id % 100 = 0 UNION SELECT dst, level + 1 FROM hop JOIN copart ON src = id WHERE level < 1),
kept AS (SELECT DISTINCT id FROM hop)
SELECT src, dst, weight FROM copart WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)""")
def khop_subgraph(spark, d):
    g = copart(spark, d)
    return g.subgraph(g.within_hops(g.ids.where("id % 100 = 0"), 1).select("id"), relabel=False).edges


@query("induced_subgraph", f"""WITH {COPART}, named AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM nodes WHERE id % 2 = 0)
SELECT a.pos AS src, b.pos AS dst, weight FROM copart JOIN named a ON src = a.id JOIN named b ON dst = b.id""")
def induced_subgraph(spark, d):
    g = copart(spark, d)
    return g.subgraph(g.ids.where("id % 2 = 0")).edges


CC = """
reach AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, c.dst FROM reach r JOIN copart c ON c.src = r.other),
label AS (SELECT id, min(other) AS label FROM reach GROUP BY 1),
sizes AS (SELECT label, count(*) AS n FROM label GROUP BY 1),
ranked AS (SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS BIGINT) AS component FROM sizes)"""


@query("connected_components", f"WITH RECURSIVE {COPART}, {CC} SELECT id, component FROM label JOIN ranked USING (label)")
def connected_components(spark, d):
    return fx.components(copart(spark, d))


@query("largest_component", f"""WITH RECURSIVE {COPART}, {CC}, lcc AS (SELECT id FROM label JOIN ranked USING (label) WHERE component = 0)
SELECT src, dst, weight FROM copart WHERE src IN (SELECT id FROM lcc)""")
def largest_component(spark, d):
    return fx.largest_component(copart(spark, d), relabel=False).edges


@query("connectivity_check", f"WITH RECURSIVE {COPART}, {CC} SELECT count(*) <= 1 AS connected, CAST(count(*) AS BIGINT) AS n_components FROM sizes")
def connectivity_check(spark, d):
    return fx.is_connected(copart(spark, d))


@query("bfs_levels", f"""WITH RECURSIVE {TRADE}, links AS (SELECT src, dst FROM trade WHERE abs(src - dst) <= 3),
hop AS (SELECT CAST(0 AS BIGINT) AS id, 0 AS level UNION SELECT dst, level + 1 FROM hop JOIN links ON src = id WHERE level < 25),
lv AS (SELECT id, min(level) AS level FROM hop GROUP BY 1)
SELECT l.id, CAST(0 AS BIGINT) AS root, l.level, (SELECT min(p.id) FROM lv p JOIN links ON links.src = p.id AND links.dst = l.id WHERE p.level = l.level - 1) AS parent FROM lv l""")
def bfs_levels(spark, d):
    from ..graph import Graph

    g = trade(spark, d)
    return fx.bfs(Graph(g.edges.where("abs(src - dst) <= 3"), g.nodes), 0, restart=False)


@query("bfs_forest")
def bfs_forest(spark, d):
    return fx.bfs(copart(spark, d), 1)


@query("bfs_order", """WITH RECURSIVE lines AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
near AS (SELECT src, list(dst ORDER BY dst) AS near FROM (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lines a JOIN lines b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey) GROUP BY 1),
ids AS (SELECT list(src ORDER BY src) AS ids FROM near),
walk AS (
  SELECT [CAST(7 AS BIGINT)] AS q, 1 AS i
  UNION ALL
  SELECT list_concat(w.q, CASE WHEN w.i > len(w.q) THEN list_filter(ids, lambda x: NOT list_contains(w.q, x))[1:1]
                               ELSE list_filter(near, lambda x: NOT list_contains(w.q, x)) END), CASE WHEN w.i > len(w.q) THEN w.i ELSE w.i + 1 END
  FROM walk w CROSS JOIN ids LEFT JOIN near ON src = w.q[w.i] WHERE len(w.q) < len(ids)),
whole AS (SELECT q FROM walk ORDER BY len(q) DESC LIMIT 1)
SELECT unnest(q) AS id, CAST(unnest(range(len(q))) AS BIGINT) AS visit FROM whole""")
def bfs_order(spark, d):
    """Parts in the order of a search from part 7 along shared orders, over all lines."""
    return fx.bfs_order(copart(spark, d, 0.0), 7).select("id", "visit")


@query("rolling_window_graph", "SELECT a.r AS i, b.r AS j FROM range(40) a(r) JOIN range(40) b(r) ON abs(a.r - b.r) BETWEEN 1 AND 3")
def rolling_window_graph(spark, d):
    return rolling_window(spark, 40, 4)


def rolling_window(spark, n: int, width: int):
    """Pairs (i, j) with |i - j| in 1..width-1."""
    steps = F.array(*[F.lit(s) for w in range(1, width) for s in (-w, w)])
    return spark.range(n).select(F.col("id").alias("i"), F.explode(steps).alias("s")).select("i", (F.col("i") + F.col("s")).alias("j")).where(f"j >= 0 and j < {n}")


@query("spanning_forest")
def spanning_forest(spark, d):
    return fx.spanning_forest(copart(spark, d), maximise=True)


@query("spanning_forest_size", f"""WITH RECURSIVE {COPART}, {CC} SELECT CAST((SELECT count(*) FROM nodes) - (SELECT count(*) FROM sizes) AS BIGINT) AS n_edges""")
def spanning_forest_size(spark, d):
    return fx.spanning_forest(copart(spark, d)).agg(F.count("*").alias("n_edges"))


@query("conductance_of_set", f"""WITH {TRADE}, e AS (SELECT src % 2 = 0 AS s, dst % 2 = 0 AS d FROM trade)
SELECT CAST(CASE WHEN s THEN 1 ELSE 0 END AS BIGINT) AS cluster, CAST(count(*) FILTER (s <> d) AS BIGINT) AS cut, CAST(count(*) AS BIGINT) AS volume,
round(count(*) FILTER (s <> d) / least(count(*), (SELECT count(*) FROM trade) - count(*)), 9) AS conductance FROM e GROUP BY s""")
def conductance_of_set(spark, d):
    g = trade(spark, d)
    return g.conductance(g.ids.withColumn("cluster", (F.col("id") % 2 == 0).cast("long"))).withColumn("conductance", F.round("conductance", 9))


@query("clustering_coefficients", f"""WITH {COPART}, deg AS (SELECT src AS id, count(*) AS k FROM copart GROUP BY 1),
tri AS (SELECT a.src AS id, count(*) / 2 AS t FROM copart a JOIN copart b ON a.src = b.src AND a.dst <> b.dst JOIN copart c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1)
SELECT id, CAST(k AS BIGINT) AS degree, CAST(coalesce(t, 0) AS BIGINT) AS triangles, round(CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 9) AS coefficient FROM deg LEFT JOIN tri USING (id)""")
def clustering_coefficients(spark, d):
    return ms.clustering_coefficients(copart(spark, d)).withColumn("coefficient", F.round("coefficient", 9))


@query("graph_summary", f"""WITH {COPART}, n AS (SELECT count(*) AS n, (SELECT count(*) FROM copart) // 2 AS m FROM nodes)
SELECT CAST(n AS BIGINT) AS n_nodes, CAST(m AS BIGINT) AS n_edges, round(2.0 * m / (n * (n - 1)), 9) AS density, round(2.0 * m / n, 9) AS mean_degree FROM n""")
def graph_summary(spark, d):
    return ms.graph_summary(copart(spark, d)).select("n_nodes", "n_edges", F.round("density", 9).alias("density"), F.round("mean_degree", 9).alias("mean_degree"))


# ---- partitions


@query("cluster_sizes", """WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS n_clusters, CAST(max(n) AS BIGINT) AS largest, CAST(min(n) AS BIGINT) AS smallest, round(avg(n), 9) AS mean_size, round(stddev_samp(n), 9) AS size_std, round(max(n) / avg(n), 9) AS imbalance FROM n""")
def cluster_sizes(spark, d):
    out = ms.cluster_sizes(t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster")))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_size", "size_std", "imbalance")})


@query("edge_cuts", f"""WITH {TRADE} SELECT a.region AS cluster, CAST(count(*) FILTER (a.region <> b.region) AS BIGINT) AS cut, CAST(count(*) AS BIGINT) AS edges,
round(count(*) FILTER (a.region <> b.region) / count(*), 9) AS cut_ratio FROM trade JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id GROUP BY 1""")
def edge_cuts(spark, d):
    return ms.edge_cuts(trade(spark, d), region_partition(spark, d)).withColumn("cut_ratio", F.round("cut_ratio", 9))


def two_partitions(spark, d):
    p = t(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("cluster")), p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster"))


@query("compare_partitions", """WITH c AS (SELECT p_size AS a, p_brand AS b, count(*) AS n FROM part GROUP BY 1, 2),
ra AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS n FROM c GROUP BY 1), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS pc, (SELECT sum(n * (n - 1) / 2) FROM ra) AS pa, (SELECT sum(n * (n - 1) / 2) FROM rb) AS pb,
  (SELECT sum(c.n / t * ln(c.n * t / (ra.n * rb.n))) FROM c JOIN ra USING (a) JOIN rb USING (b), t) AS mi,
  (SELECT -sum(n / t * ln(n / t)) FROM ra, t) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM rb, t) AS hb, (SELECT t * (t - 1) / 2 FROM t) AS all_pairs)
SELECT round((pc - pa * pb / all_pairs) / ((pa + pb) / 2 - pa * pb / all_pairs), 9) AS adjusted_rand, round(mi / ((ha + hb) / 2), 9) AS normalised_mi FROM s""")
def compare_partitions(spark, d):
    out = ms.compare_partitions(*two_partitions(spark, d))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("validate_partition", """SELECT count(*) = (SELECT count(*) FROM part) AS right_length, min(p_size) >= 0 AS no_negatives,
count(DISTINCT p_size) = max(p_size) + 1 AS contiguous, count(DISTINCT p_size) = 50 AS expected_number FROM part""")
def validate_partition(spark, d):
    first, _ = two_partitions(spark, d)
    return ms.validate_partition(first, first.count(), 50)


@query("modularity", f"""WITH {TRADE}, e AS (SELECT a.region AS cs, b.region AS cd, weight FROM trade JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id), m AS (SELECT sum(weight) AS m2 FROM trade),
p AS (SELECT cs, sum(weight) AS deg, sum(CASE WHEN cs = cd THEN weight ELSE 0 END) AS ins FROM e GROUP BY 1)
SELECT round(sum(ins / m2 - (deg / m2) * (deg / m2)), 9) AS modularity FROM p, m""")
def modularity(spark, d):
    return ms.modularity(trade(spark, d), region_partition(spark, d)).select(F.round("modularity", 9).alias("modularity"))


@query("patch_sizes", f"""WITH {PATCHES}, n AS (SELECT patch_id, count(*) AS n FROM members GROUP BY 1), v AS (SELECT count(*) AS v FROM vectors)
SELECT CAST(min(n) AS BIGINT) AS min_size, CAST(max(n) AS BIGINT) AS max_size, round(avg(n), 9) AS mean_size, round(stddev_pop(n), 9) AS std_size, CAST(median(n) AS DOUBLE) AS median_size,
round(any_value(v) / count(*), 9) AS theoretical_size, round(any_value(v) / sum(n), 9) AS efficiency FROM n, v""")
def patch_sizes(spark, d):
    out = ms.patch_sizes(patches(spark, d), t(spark, d, "embeddings").count())
    return out.withColumns({c: F.round(c, 9) for c in ("mean_size", "std_size", "theoretical_size", "efficiency")})


@query("patch_size_pivot", """SELECT p_brand, CAST(count(*) FILTER (p_size <= 10) AS BIGINT) AS small, CAST(count(*) FILTER (p_size > 10 AND p_size <= 30) AS BIGINT) AS medium, CAST(count(*) FILTER (p_size > 30) AS BIGINT) AS large FROM part GROUP BY 1""")
def patch_size_pivot(spark, d):
    kind = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "medium").otherwise("large")
    return t(spark, d, "part").withColumn("kind", kind).groupBy("p_brand").pivot("kind", ["small", "medium", "large"]).count().na.fill(0)


@query("patch_recovery", f"""WITH {PATCHES}, truth AS (SELECT node_id, node_id % 7 AS community FROM vectors),
i AS (SELECT community, patch_id, count(*) AS i FROM truth JOIN members USING (node_id) GROUP BY 1, 2), a AS (SELECT community, count(*) AS a FROM truth GROUP BY 1), b AS (SELECT patch_id, count(*) AS b FROM members GROUP BY 1)
SELECT community, round(max(i / (a + b - i)), 9) AS best, max(i / (a + b - i)) > 0.5 AS recovered FROM i JOIN a USING (community) JOIN b USING (patch_id) GROUP BY 1""")
def patch_recovery(spark, d):
    m = patches(spark, d)
    truth = m.select("node_id", (F.col("node_id") % 7).alias("community")).distinct()
    return ms.patch_recovery(truth, m).withColumn("best", F.round("best", 9))


@query("community_statistics", f"""WITH {COPART}, mem AS (SELECT id AS node_id, id % 9 AS community FROM nodes UNION SELECT id, id % 5 FROM nodes WHERE id % 3 = 0),
n AS (SELECT community, count(*) AS n FROM mem GROUP BY 1), k AS (SELECT node_id, count(*) AS k FROM mem GROUP BY 1),
e AS (SELECT src, dst, EXISTS (SELECT 1 FROM mem x JOIN mem y ON x.community = y.community WHERE x.node_id = src AND y.node_id = dst) AS same FROM copart WHERE src < dst)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM n) AS n_communities, (SELECT round(avg(n), 9) FROM n) AS mean_size, (SELECT CAST(max(n) AS BIGINT) FROM n) AS largest,
(SELECT round(avg(k), 9) FROM k) AS mean_memberships, (SELECT round(avg(CASE WHEN k > 1 THEN 1.0 ELSE 0 END), 9) FROM k) AS overlap_ratio,
(SELECT CAST(count(*) AS BIGINT) FROM e WHERE same) AS intra_edges, (SELECT CAST(count(*) AS BIGINT) FROM e WHERE NOT same) AS inter_edges""")
def community_statistics(spark, d):
    g = copart(spark, d)
    mem = g.ids.select(F.col("id").alias("node_id"), (F.col("id") % 9).alias("community")).union(g.ids.where("id % 3 = 0").select(F.col("id"), F.col("id") % 5)).distinct()
    out = ms.community_statistics(g, mem)
    return out.withColumns({c: F.round(c, 9) for c in ("mean_size", "mean_memberships", "overlap_ratio")})


@query("class_distribution", f"""WITH {LABELLED}, n AS (SELECT y, count(*) AS n FROM labelled GROUP BY 1)
SELECT y, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (), 9) AS share, round(max(n) OVER () / n, 9) AS imbalance FROM n""")
def class_distribution(spark, d):
    return ms.class_distribution(labelled(spark, d)).withColumns({c: F.round(c, 9) for c in ("share", "imbalance")})


# ---- embeddings


@query("local_errors", f"""WITH {PATCHES}, shifted AS (SELECT patch_id, node_id, list_transform(coord, lambda x: x + 0.01 * patch_id) AS coord FROM members)
SELECT patch_id, node_id, round(list_distance(s.coord, v.coord), 9) AS error FROM shifted s JOIN vectors v USING (node_id)""")
def local_errors(spark, d):
    m = patches(spark, d)
    moved = m.withColumn("coord", F.transform("coord", lambda x: x + 0.01 * F.col("patch_id")))
    ref = t(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("coord"))
    return ms.local_errors(moved, ref).withColumn("error", F.round("error", 9))


@query("transform_error", f"""WITH {PATCHES}, m AS (SELECT patch_id, generate_subscripts(coord, 1) AS pos, unnest(coord) AS v FROM members), a AS (SELECT patch_id, pos, avg(v) AS v FROM m GROUP BY 1, 2)
SELECT round(avg(s), 9) AS error FROM (SELECT pos, stddev_pop(v) AS s FROM a GROUP BY 1)""")
def transform_error(spark, d):
    a = patches(spark, d).select("patch_id", F.posexplode("coord").alias("pos", "v")).groupBy("patch_id", "pos").agg(F.avg("v").alias("v"))
    per = a.groupBy("patch_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("values"))
    return ms.transform_error(per).select(F.round("error", 9).alias("error"))


@query("embedding_health", f"""WITH {PATCHES}, m AS (SELECT generate_subscripts(coord, 1) - 1 AS pos, unnest(coord) AS v FROM vectors)
SELECT CAST(pos AS INTEGER) AS pos, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, round(min(v), 9) AS min, round(max(v), 9) AS max, stddev_pop(v) < 1e-6 AS collapsed, stddev_pop(v) < 0.01 AS low_variance FROM m GROUP BY 1""")
def embedding_health(spark, d):
    v = patches(spark, d).dropDuplicates(["node_id"])
    return ms.embedding_health(v).withColumns({c: F.round(c, 9) for c in ("mean", "std", "min", "max")})


@query("pairwise_distances", f"""WITH {PATCHES}, d AS (SELECT list_distance(a.coord, b.coord) AS d FROM vectors a JOIN vectors b ON a.node_id < b.node_id AND a.label = 3 AND b.label = 3)
SELECT CAST(count(*) AS BIGINT) AS n_pairs, round(avg(d), 9) AS mean, round(stddev_pop(d), 9) AS std, round(min(d), 9) AS min, round(max(d), 9) AS max FROM d""")
def pairwise_distances(spark, d):
    v = t(spark, d, "embeddings").where("label = 3").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("v"))
    return ms.pairwise_distances(v, "vec_id", "v").withColumns({c: F.round(c, 9) for c in ("mean", "std", "min", "max")})


# ---- classification


@query("stratified_split", f"""WITH {LABELLED}, r AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY id) AS r, count(*) OVER (PARTITION BY y) AS n FROM labelled)
SELECT id, y, CASE WHEN r > n - round(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r""")
def stratified_split(spark, d):
    return ms.stratified_split(labelled(spark, d).select("id", "y"), order=F.col("id"))


@query("standardised", """WITH s AS (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mp, stddev_pop(p_retailprice) AS sp FROM part)
SELECT p_partkey, round((p_size - ms) / ss, 6) AS p_size, round((p_retailprice - mp) / sp, 6) AS p_retailprice FROM part, s""")
def standardised(spark, d):
    out = ms.standardised(t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"])
    return out.withColumns({c: F.round(c, 6) for c in ("p_size", "p_retailprice")})


@query("confusion", f"WITH {LABELLED} SELECT y, predicted, CAST(count(*) AS BIGINT) AS n FROM labelled GROUP BY 1, 2")
def confusion(spark, d):
    return ms.confusion(labelled(spark, d))


REPORT = f"""{LABELLED}, k AS (SELECT y AS k FROM labelled UNION SELECT predicted FROM labelled),
c AS (SELECT k, (SELECT count(*) FROM labelled WHERE y = k AND predicted = k) AS tp, (SELECT count(*) FROM labelled WHERE predicted = k) AS np, (SELECT count(*) FROM labelled WHERE y = k) AS s FROM k),
r AS (SELECT k AS y, coalesce(tp / nullif(np, 0), 0) AS precision, coalesce(tp / nullif(s, 0), 0) AS recall, coalesce(2.0 * tp / nullif(np + s, 0), 0) AS f1, CAST(s AS BIGINT) AS support FROM c)"""


@query("class_report", f"WITH {REPORT} SELECT y, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r")
def class_report(spark, d):
    return ms.class_report(labelled(spark, d)).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("classification_scores", f"""WITH {REPORT}, a AS (SELECT avg(CASE WHEN y = predicted THEN 1.0 ELSE 0 END) AS acc FROM labelled)
SELECT round(any_value(acc), 9) AS accuracy, round(avg(recall) FILTER (support > 0), 9) AS balanced_accuracy, round(avg(f1), 9) AS f1_macro, round(sum(f1 * support) / sum(support), 9) AS f1_weighted, round(any_value(acc), 9) AS f1_micro FROM r, a""")
def classification_scores(spark, d):
    out = ms.scores(labelled(spark, d))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("minority_classes", f"""WITH {REPORT} SELECT y, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r WHERE support < 0.2 * (SELECT sum(support) FROM r)""")
def minority_classes(spark, d):
    return ms.minority_classes(labelled(spark, d), share=0.2).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("experiment_summary", """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS l_quantity_mean, round(stddev_samp(l_quantity), 4) AS l_quantity_std, CAST(count(*) AS BIGINT) AS runs FROM lineitem GROUP BY 1, 2""")
def experiment_summary(spark, d):
    return ms.experiment_summary(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"])


@query("best_per_group", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_name DESC) AS r FROM part) SELECT p_brand, p_name AS best, p_retailprice AS value FROM r WHERE r = 1""")
def best_per_group(spark, d):
    return ms.best_per_group(t(spark, d, "part"), "p_brand", "p_name", "p_retailprice")


@query("noise_profile", """SELECT l_discount AS noise, round(avg(e), 6) AS mean_error, round(stddev_pop(e), 6) AS std_error, CAST(count(e) AS BIGINT) AS valid_runs FROM (SELECT l_discount, CASE WHEN l_linenumber > 1 THEN l_tax * l_quantity END AS e FROM lineitem) GROUP BY 1""")
def noise_profile(spark, d):
    runs = t(spark, d, "lineitem").select(F.col("l_discount").alias("noise"), F.when(F.col("l_linenumber") > 1, F.col("l_tax") * F.col("l_quantity")).alias("error"))
    return ms.noise_profile(runs).withColumns({c: F.round(c, 6) for c in ("mean_error", "std_error")})


@query("temporal_features", """WITH n AS (SELECT o_custkey AS id, min(epoch(o_orderdate) / 600) AS first, max(epoch(o_orderdate) / 600) AS last, count(*) AS n, sum(o_totalprice) / 1000 AS total FROM orders GROUP BY 1),
b AS (SELECT *, greatest(last - first, 0) / 144.0 AS duration, exp(-first / 100000.0) AS early, (2000000 - last) / 144.0 AS recency,
  CASE WHEN first < 500000 THEN 0 WHEN first < 1000000 THEN 1 WHEN first < 1500000 THEN 2 ELSE 3 END AS era FROM n),
f AS (SELECT *, least(n / (duration + 1), 1000) AS intensity, least(total / (duration + 1), 1000) AS volume_intensity FROM b),
c AS (SELECT quantile_cont(intensity, 0.8) FILTER (intensity > 0) AS ci, quantile_cont(volume_intensity, 0.6) FILTER (volume_intensity > 0) AS cv, quantile_cont(duration, 0.3) FILTER (duration > 0) AS cd FROM f)
SELECT id, round(duration, 6) AS duration, round(recency, 6) AS recency, round(early, 9) AS early, era, round(intensity, 6) AS intensity, round(volume_intensity, 6) AS volume_intensity,
coalesce(intensity > ci, false) AS bursty, coalesce(volume_intensity > cv, false) AS heavy, coalesce(duration < cd, false) AS short_lived FROM f, c""")
def temporal_features(spark, d):
    at = F.unix_timestamp("o_orderdate") / 600
    n = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"), (F.sum("o_totalprice") / 1000).alias("total"))
    out = ms.temporal_features(n, 2_000_000).drop("first", "last", "n", "total")
    return out.withColumns({c: F.round(c, 9 if c == "early" else 6) for c in ("duration", "recency", "early", "intensity", "volume_intensity")})


@query("thickened_points", """WITH o AS (SELECT x, y FROM range(-1, 2) a(x), range(-1, 2) b(y) UNION ALL SELECT * FROM (VALUES (2, 0), (-2, 0), (0, 2), (0, -2)))
SELECT s_suppkey AS id, round(s_acctbal + o.x, 6) AS x, round(s_nationkey + o.y, 6) AS y FROM supplier, o""")
def thickened_points(spark, d):
    p = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return ms.thickened(p).withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query("node_patches", f"WITH {PATCHES} SELECT node_id, string_agg(CAST(patch_id AS VARCHAR), ',' ORDER BY patch_id) AS patch_ids FROM members GROUP BY 1")
def node_patches(spark, d):
    return patches(spark, d).groupBy("node_id").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("patch_id")), lambda x: x.cast("string"))).alias("patch_ids"))


# ---- conversions of temporal edge tables


@query("snapshot_edges", f"WITH {TRANSITIONS} SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, src, dst FROM transitions")
def snapshot_edges(spark, d):
    return transitions(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "src", "dst").dropDuplicates(["day", "src", "dst"])


@query("snapshot_nodes", """SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS id, arg_min(value, event_id) AS first_value FROM events GROUP BY 1, 2""")
def snapshot_nodes(spark, d):
    return t(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").alias("id")).agg(F.min_by("value", "event_id").alias("first_value"))


@query("event_stream", f"""WITH {TRANSITIONS} SELECT CAST(row_number() OVER (PARTITION BY src ORDER BY ts, event_id) AS INTEGER) AS seq, src, dst, event_id, round(value, 9) AS msg FROM transitions""")
def event_stream(spark, d):
    """Time-ordered events of each source, features as the message vector (one feature here)."""
    from pyspark.sql import Window

    e = transitions(spark, d).withColumn("msg", F.array("value"))
    return e.select(F.row_number().over(Window.partitionBy("src").orderBy("ts", "event_id")).alias("seq"), "src", "dst", "event_id", F.round(F.col("msg")[0], 9).alias("msg"))


@query("undirected_edges", f"WITH {TRADE} SELECT src, dst FROM trade UNION SELECT dst, src FROM trade")
def undirected_edges(spark, d):
    return trade(spark, d).undirected().edges.select("src", "dst")
