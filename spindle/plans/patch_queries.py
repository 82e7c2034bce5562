"""Queries over patches: overlaps, sparsification, alignment, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as al
from ..operators import patching as pt
from ..operators import sparsify as sp
from .fixtures import COPART, PATCHES, TRADE, copart, patches, region_partition, t, trade

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("patch_overlaps", f"WITH {PATCHES} SELECT a.patch_id AS i, b.patch_id AS j, node_id FROM members a JOIN members b USING (node_id) WHERE a.patch_id <> b.patch_id")
def patch_overlaps(spark, d):
    return pt.overlaps(patches(spark, d))


@query("patch_graph", f"WITH {PATCHES} SELECT a.patch_id AS i, b.patch_id AS j, CAST(count(*) AS BIGINT) AS n FROM members a JOIN members b USING (node_id) WHERE a.patch_id <> b.patch_id GROUP BY 1, 2 HAVING count(*) >= 5")
def patch_graph(spark, d):
    return pt.overlap_sizes(patches(spark, d), 5)


@query("patch_intersections", f"""WITH {PATCHES}, x AS (SELECT a.patch_id AS i, b.patch_id AS j, node_id, a.coord AS a, b.coord AS b, count(*) OVER (PARTITION BY a.patch_id, b.patch_id) AS n FROM members a JOIN members b USING (node_id) WHERE a.patch_id < b.patch_id)
SELECT i, j, node_id, round(a[1], 9) AS a0, round(b[8], 9) AS b7 FROM x WHERE n >= 5""")
def patch_intersections(spark, d):
    return pt.intersections(patches(spark, d), 5).select("i", "j", "node_id", F.round(F.col("a")[0], 9).alias("a0"), F.round(F.col("b")[7], 9).alias("b7"))


@query("overlap_statistics", f"""WITH {PATCHES}, o AS (SELECT a.patch_id, b.patch_id AS j, count(*) AS n FROM members a JOIN members b USING (node_id) WHERE a.patch_id < b.patch_id GROUP BY 1, 2)
SELECT (SELECT CAST(count(DISTINCT patch_id) AS BIGINT) FROM members) AS n_patches, (SELECT CAST(count(*) AS BIGINT) FROM members) AS n_members, CAST(count(*) AS BIGINT) AS n_pairs, round(avg(n), 9) AS mean_overlap, CAST(min(n) AS BIGINT) AS min_overlap, CAST(max(n) AS BIGINT) AS max_overlap FROM o""")
def overlap_statistics(spark, d):
    return pt.overlap_statistics(patches(spark, d)).withColumn("mean_overlap", F.round("mean_overlap", 9))


@query("partition_boundary", f"WITH {TRADE} SELECT DISTINCT src AS id, a.region AS cluster, b.region AS other FROM trade JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.region <> b.region")
def partition_boundary(spark, d):
    return pt.boundary(trade(spark, d), region_partition(spark, d))


@query("patch_connectivity", f"""WITH {TRADE}, q AS (SELECT a.region AS src, b.region AS dst, count(*) AS n FROM trade JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.region <> b.region GROUP BY 1, 2), s AS (SELECT src, sum(n) AS s FROM q GROUP BY 1)
SELECT q.src, q.dst, CAST(n AS BIGINT) AS count, round(n / least(a.s, b.s), 9) AS weight FROM q JOIN s a ON q.src = a.src JOIN s b ON q.dst = b.src""")
def patch_connectivity(spark, d):
    return pt.connectivity(trade(spark, d), region_partition(spark, d)).withColumn("weight", F.round("weight", 9))


@query("voronoi_patches", """WITH v AS (SELECT vec_id AS node_id, CAST(embedding[1:8] AS DOUBLE[]) AS coord FROM embeddings), d AS (SELECT c.node_id AS patch_id, v.node_id, list_distance(v.coord, c.coord) AS d FROM v JOIN v c ON c.node_id < 12),
m AS (SELECT *, min(d) OVER (PARTITION BY node_id) AS m FROM d) SELECT patch_id, node_id FROM m WHERE d = m OR d < 1.25 * m""")
def voronoi_patches(spark, d):
    p = t(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("coord"))
    return pt.voronoi(p, p.where("node_id < 12").select(F.col("node_id").alias("patch_id"), F.col("coord").alias("centre")), 1.25)


@query("community_patches", """WITH m AS (SELECT p_brand AS patch_id, p_partkey AS node_id FROM part UNION SELECT 'size' || CAST(p_size AS VARCHAR), p_partkey FROM part), big AS (SELECT patch_id FROM m GROUP BY 1 HAVING count(*) >= 20),
k AS (SELECT * FROM m WHERE patch_id IN (SELECT patch_id FROM big)) SELECT a.patch_id AS i, b.patch_id AS j, CAST(count(*) AS BIGINT) AS n FROM k a JOIN k b USING (node_id) WHERE a.patch_id <> b.patch_id GROUP BY 1, 2 HAVING count(*) >= 5""")
def community_patches(spark, d):
    p = t(spark, d, "part")
    c = p.select(F.col("p_brand").alias("community"), F.col("p_partkey").alias("node_id")).union(p.select(F.concat(F.lit("size"), F.col("p_size").cast("string")), "p_partkey"))
    return pt.communities_to_patches(c, 20, 5)[1]


@query("expanded_patches")
def expanded_patches(spark, d):
    g, p = trade(spark, d), region_partition(spark, d)
    return pt.expand(g, p, pt.connectivity(g, p), 2, 3)


@query("created_patches")
def created_patches(spark, d):
    g = copart(spark, d)
    return pt.create_patches(g, g.ids.withColumn("cluster", F.col("id") % 8), min_overlap=6, target_overlap=12)[0]


@query("merged_clusters")
def merged_clusters(spark, d):
    p = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.floor(F.sqrt("n_nationkey")).cast("long").alias("cluster"))
    return pt.merge_small(trade(spark, d), p, 5)


# ---- sparsification

WEIGHTS = f"{TRADE}, sym AS (SELECT src, dst, max(weight) AS weight FROM (SELECT * FROM trade UNION ALL SELECT dst, src, weight FROM trade) WHERE src <> dst GROUP BY 1, 2)"


def _symmetric(spark, d):
    return trade(spark, d).undirected().edges.where("src <> dst")


@query("conductance_weights", f"WITH {WEIGHTS}, s AS (SELECT src, sum(weight) AS s FROM sym GROUP BY 1) SELECT sym.src, sym.dst, round(weight / least(a.s, b.s), 9) AS weight FROM sym JOIN s a ON sym.src = a.src JOIN s b ON sym.dst = b.src")
def conductance_weights(spark, d):
    return sp.conductance_weights(_symmetric(spark, d)).withColumn("weight", F.round("weight", 9))


@query("mutual_neighbours", f"""WITH {WEIGHTS}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM sym), top AS (SELECT src, dst, weight FROM r WHERE r <= 4)
SELECT src, dst, weight FROM top a WHERE EXISTS (SELECT 1 FROM top b WHERE b.src = a.dst AND b.dst = a.src)""")
def mutual_neighbours(spark, d):
    return sp.mutual_neighbours(_symmetric(spark, d), 4)


for _method in ("resistance", "sample", "neighbors", "rmst"):

    def _sparse(spark, d, method=_method):
        return sp.sparsify(_symmetric(spark, d), method, 4.0)

    QUERIES[f"sparsify_{_method}"] = _sparse


@query("effective_resistance_sum", f"WITH {WEIGHTS} SELECT CAST(count(DISTINCT src) - 1 AS DOUBLE) AS foster FROM sym")
def effective_resistance_sum(spark, d):
    """Foster: weight times resistance sums to nodes - 1."""
    return sp.resistances(_symmetric(spark, d)).where("src < dst").agg(F.round(F.sum(F.col("weight") * F.col("resistance")), 6).alias("foster"))


@query("hierarchical_sparsify")
def hierarchical_sparsify(spark, d):
    return sp.hierarchical(_symmetric(spark, d), [region_partition(spark, d)], 3.0)


# ---- alignment

MOMENTS = f"""{PATCHES}, x AS (SELECT a.patch_id AS i, b.patch_id AS j, node_id, a.coord AS a, b.coord AS b FROM members a JOIN members b USING (node_id) WHERE a.patch_id < b.patch_id),
l AS (SELECT i, j, generate_subscripts(a, 1) AS p, unnest(a) AS a, unnest(b) AS b FROM x)"""


def _moved(spark, d):
    """Patches in coordinates of their own: scaled and shifted by their number."""
    m = patches(spark, d)
    return m.select("patch_id", "node_id", F.transform("coord", lambda x: x * (1 + F.col("patch_id") / 10.0) + F.col("patch_id")).alias("coord"))


MOVED = MOMENTS.replace("x AS (SELECT a.patch_id AS i, b.patch_id AS j, node_id, a.coord AS a, b.coord AS b FROM members a JOIN members b", "moved AS (SELECT patch_id, node_id, list_transform(coord, lambda v: v * (1 + patch_id / 10.0) + patch_id) AS coord FROM members),\nx AS (SELECT a.patch_id AS i, b.patch_id AS j, node_id, a.coord AS a, b.coord AS b FROM moved a JOIN moved b")


@query("patch_degrees", f"WITH {MOMENTS}, o AS (SELECT i, j FROM x GROUP BY 1, 2 HAVING count(*) >= 5), b AS (SELECT i AS patch_id FROM o UNION ALL SELECT j FROM o) SELECT patch_id, CAST(count(*) AS BIGINT) AS degree FROM b GROUP BY 1")
def patch_degrees(spark, d):
    return al.patch_degrees(patches(spark, d), 5)


@query("pair_weights", f"WITH {MOMENTS}, o AS (SELECT i, j, count(*) / 5 AS weight FROM x GROUP BY 1, 2 HAVING count(*) >= 5) SELECT i, j, weight FROM o UNION ALL SELECT j, i, weight FROM o")
def pair_weights(spark, d):
    return al.pair_weights(patches(spark, d), 5)


@query("overlap_covariance", f"""WITH {MOVED}, m AS (SELECT i, j, p, count(*) AS n, avg(a) AS ma, avg(b) AS mb FROM l GROUP BY 1, 2, 3),
y AS (SELECT i, j, a[1] AS a, b[2] AS b FROM x) SELECT i, j, CAST(count(*) AS BIGINT) AS n, round(sum(a * b) - count(*) * avg(a) * avg(b), 6) AS cov01 FROM y GROUP BY 1, 2""")
def overlap_covariance(spark, d):
    return al.overlap_moments(_moved(spark, d)).select("i", "j", "n", F.round(F.col("cov")[1], 6).alias("cov01"))


@query("relative_scales", f"""WITH {MOVED}, m AS (SELECT i, j, p, sum(a * a) - count(*) * avg(a) * avg(a) AS va, sum(b * b) - count(*) * avg(b) * avg(b) AS vb FROM l GROUP BY 1, 2, 3)
SELECT i, j, round(sqrt(sum(va) / sum(vb)), 6) AS scale FROM m GROUP BY 1, 2""")
def relative_scales(spark, d):
    return al.relative_scales(_moved(spark, d)).withColumn("scale", F.round("scale", 6))


@query("mean_differences", f"""WITH {MOVED}, m AS (SELECT i, j, p, count(*) AS n, avg(a - b) AS v FROM l GROUP BY 1, 2, 3)
SELECT i, j, CAST(any_value(n) AS BIGINT) AS n, round(sum(v * p), 6) AS weighted FROM m GROUP BY 1, 2""")
def mean_differences(spark, d):
    return al.mean_differences(_moved(spark, d)).select("i", "j", "n", F.round(F.aggregate(F.transform("difference", lambda x, p: x * (p + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("weighted"))


FLAT = "node_id, CAST(generate_subscripts(coord, 1) - 1 AS INTEGER) AS p, unnest(coord) AS v"


@query("mean_embedding", f"WITH {MOVED}, f AS (SELECT {FLAT} FROM moved) SELECT node_id, p, round(avg(v), 9) AS v FROM f GROUP BY 1, 2")
def mean_embedding(spark, d):
    return al.recombined(_moved(spark, d)).select("node_id", F.posexplode("coord").alias("p", "v")).withColumn("v", F.round("v", 9))


@query("median_embedding", f"WITH {MOVED}, f AS (SELECT {FLAT} FROM moved) SELECT node_id, p, round(median(v), 9) AS v FROM f GROUP BY 1, 2")
def median_embedding(spark, d):
    return al.recombined(_moved(spark, d), "median").select("node_id", F.posexplode("coord").alias("p", "v")).withColumn("v", F.round("v", 9))


@query("centred_patches", f"WITH {MOVED}, f AS (SELECT patch_id, {FLAT} FROM moved) SELECT patch_id, node_id, p, round(v - avg(v) OVER (PARTITION BY patch_id, p), 9) AS v FROM f")
def centred_patches(spark, d):
    return al.centred(_moved(spark, d)).select("patch_id", "node_id", F.posexplode("coord").alias("p", "v")).withColumn("v", F.round("v", 9))


@query("scaled_patches", f"WITH {MOVED} SELECT patch_id, node_id, round(coord[1] * (patch_id + 0.5), 9) AS v FROM moved")
def scaled_patches(spark, d):
    s = spark.range(10).select(F.col("id").cast("int").alias("patch_id"), (F.col("id") + 0.5).alias("scale"))
    return al.scaled(_moved(spark, d), s).select("patch_id", "node_id", F.round(F.col("coord")[0], 9).alias("v"))


@query("rotated_patches", f"WITH {MOVED} SELECT patch_id, node_id, round(coord[2], 9) AS v0, round(-coord[1], 9) AS v1 FROM moved")
def rotated_patches(spark, d):
    rows = [[1.0 if (r, c) == (0, 1) or r == c > 1 else -1.0 if (r, c) == (1, 0) else 0.0 for c in range(8)] for r in range(8)]
    r = spark.createDataFrame([(i, rows) for i in range(10)], "patch_id int, rotation array<array<double>>")
    return al.rotated(_moved(spark, d), r).select("patch_id", "node_id", F.round(F.col("coord")[0], 9).alias("v0"), F.round(F.col("coord")[1], 9).alias("v1"))


@query("overlap_report", f"""WITH {MOVED}, e AS (SELECT i, j, list_distance(a, b) AS d FROM x) SELECT i, j, CAST(count(*) AS BIGINT) AS n, round(avg(d), 6) AS mean_distance, round(max(d), 6) AS max_distance, CAST(count(*) FILTER (d < 3.0) AS BIGINT) AS preserved FROM e GROUP BY 1, 2""")
def overlap_report(spark, d):
    return al.overlap_report(_moved(spark, d), 3.0).withColumns({c: F.round(c, 6) for c in ("mean_distance", "max_distance")})


@query("aligned_error", "SELECT true AS recovered")
def aligned_error(spark, d):
    """Scaled and shifted patches, aligned again, equal the vectors up to a similarity."""
    m = patches(spark, d)
    found, _ = al.local_to_global(_moved(spark, d))
    error = al.procrustes_disparity(found, m.dropDuplicates(["node_id"]).select("node_id", "coord"))
    return spark.range(1).select(F.lit(error < 1e-9).alias("recovered"))


@query("aligned_embedding")
def aligned_embedding(spark, d):
    return al.local_to_global(_moved(spark, d))[0]


@query("aligned_embedding_geometric")
def aligned_embedding_geometric(spark, d):
    return al.geometric(_moved(spark, d), epochs=200)[0]


@query("aligned_sequential")
def aligned_sequential(spark, d):
    return al.recombined(al.procrustes_sequential(_moved(spark, d)))
