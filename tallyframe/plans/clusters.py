"""Scaling, sampling and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import cluster, density, ranking
from tallyframe.plans.registry import Tables, plan
from tallyframe.plans.sales import rounded
from tallyframe.session import materialise

PART_FEATURES = ["p_size", "p_retailprice"]


def spending(t: Tables):
    """Order count, mean and largest price per customer: one row per customer for clustering."""
    return t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("max_price")
    )


SPENDING = ["n_orders", "mean_price", "max_price"]


@plan("robust_scale", "AN14", """
WITH q AS (SELECT quantile_cont(p_size, 0.25)::DOUBLE AS s1, quantile_cont(p_size, 0.5)::DOUBLE AS s2, quantile_cont(p_size, 0.75)::DOUBLE AS s3,
  quantile_cont(p_retailprice, 0.25) AS v1, quantile_cont(p_retailprice, 0.5) AS v2, quantile_cont(p_retailprice, 0.75) AS v3 FROM part)
SELECT p_partkey, round((p_size - s2) / (s3 - s1), 6) AS p_size_scaled, round((p_retailprice - v2) / (v3 - v1), 6) AS p_retailprice_scaled FROM part, q""")
def robust_scale(t: Tables):
    scaled = cluster.robust_scale(t.part.select("p_partkey", *PART_FEATURES), PART_FEATURES)
    return rounded(scaled.drop(*PART_FEATURES), p_size_scaled=6, p_retailprice_scaled=6)


@plan("balanced_sample", "W6", """
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS rn
 FROM documents) WHERE rn <= 25""")
def balanced_sample(t: Tables):
    return ranking.sample_per_group(t.documents.select("doc_id", "source"), ["source"], 25, ["doc_id"])


@plan("best_per_key", "W4 W5", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(l_extendedprice / m, 6) AS of_largest FROM (
 SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn,
        (SELECT max(l_extendedprice) FROM lineitem) AS m FROM lineitem) WHERE rn = 1""")
def best_per_key(t: Tables):
    lines = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    best = ranking.best_per_key(lines, ["l_suppkey"], order)
    largest = t.lineitem.agg(F.max("l_extendedprice")).scalar()
    return best.withColumn("of_largest", F.round(F.col("l_extendedprice") / largest, 6))


@plan("kmeans_profile", "AN15 AN20 AN21 A16")
def kmeans_profile(t: Tables):
    clustered = materialise(cluster.kmeans(spending(t), SPENDING, 3, labels={0: "first", 1: "second"}))
    profile = cluster.group_profile(clustered, "cluster", SPENDING)
    return profile.join(cluster.group_sizes(clustered, "cluster"), "cluster")


@plan("kmedoids", "AN16 AN20")
def kmedoids(t: Tables):
    return cluster.kmedoids(spending(t), "o_custkey", SPENDING, 3)


SCALED = """
WITH RECURSIVE f AS (SELECT o_custkey AS id, count(*)::DOUBLE AS a, avg(o_totalprice) AS b, max(o_totalprice) AS c FROM orders GROUP BY 1),
q AS (SELECT """ + ", ".join(
    f"quantile_cont({x}, 0.5) AS {x}2, quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS {x}w" for x in "abc") + """ FROM f),
s AS (SELECT id, """ + ", ".join(f"({x} - {x}2) / CASE WHEN {x}w = 0 THEN 1 ELSE {x}w END AS {x}" for x in "abc") + """ FROM f, q),
"""


@plan("dbscan", "AN17 AN20", SCALED + """
near AS (SELECT x.id AS i, y.id AS j FROM s x, s y WHERE pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2) <= 0.35 * 0.35),
core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 5),
edges AS (SELECT i, j FROM near SEMI JOIN core ON near.i = core.i WHERE j IN (SELECT i FROM core)),
reach AS (SELECT i AS node, i AS start FROM core UNION SELECT j, start FROM reach JOIN edges ON node = i WHERE j > start),
final AS (SELECT node, min(start) AS root FROM reach GROUP BY node),
numbered AS (SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS number FROM final),
joined AS (SELECT s.id, coalesce(own.number, min(n.number)) AS number FROM s LEFT JOIN numbered own ON own.node = s.id
  LEFT JOIN near ON near.i = s.id LEFT JOIN numbered n ON n.node = near.j GROUP BY s.id, own.number)
SELECT f.id AS o_custkey, CAST(f.a AS BIGINT) AS n_orders, round(f.b, 1) AS mean_price, f.c AS max_price,
       coalesce('Cluster ' || number, 'Outlier') AS cluster FROM f JOIN joined USING (id)""")
def dbscan(t: Tables):
    return rounded(density.dbscan_scaled(spending(t), "o_custkey", SPENDING, eps=0.35, min_samples=5), mean_price=1)


@plan("bisecting", "AN18 A18")
def bisecting(t: Tables):
    return cluster.group_sizes(cluster.bisecting(spending(t), SPENDING, 3), "cluster")


@plan("elbow", "AN19")
def elbow(t: Tables):
    return cluster.elbow(spending(t), SPENDING)


# Audits: facts about a clustering that hold for any right one, checked against the tables.


def _own_centre_share(clustered, features):
    """Share of rows that lie nearer to their own cluster's scaled mean than to any other, in hundredths."""
    scaled = materialise(cluster.robust_scale(clustered, features, "__s"))
    names = [f + "__s" for f in features]
    centres = scaled.groupBy("cluster").agg(*[F.avg(n).alias(n) for n in names]).collect()  # one row per cluster
    gaps = [
        F.struct(sum(((F.col(n) - c[n]) * (F.col(n) - c[n]) for n in names), F.lit(0.0)).alias("gap"), F.lit(c["cluster"]).alias("label"))
        for c in centres
    ]
    nearest = F.array_min(F.array(*gaps))["label"]
    return scaled.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("cluster").alias("n_clusters"),
        F.round(F.avg((nearest == F.col("cluster")).cast("double")), 2).alias("own_centre"),
    )


AUDIT = "SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_rows, CAST(3 AS BIGINT) AS n_clusters, 1.0::DOUBLE AS own_centre FROM orders"


@plan("kmeans_audit", "AN15", AUDIT)
def kmeans_audit(t: Tables):
    return _own_centre_share(cluster.kmeans(spending(t), SPENDING, 3), SPENDING)


@plan("bisecting_audit", "AN18", """
SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_rows, CAST(3 AS BIGINT) AS n_clusters FROM orders""")
def bisecting_audit(t: Tables):
    found = cluster.bisecting(spending(t), SPENDING, 3)
    return found.agg(F.count("*").alias("n_rows"), F.countDistinct("cluster").alias("n_clusters"))


@plan("kmedoids_audit", "AN16 AN20", """
SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_rows, CAST(3 AS BIGINT) AS n_clusters, CAST(3 AS BIGINT) AS n_medoids, TRUE AS nearest FROM orders""")
def kmedoids_audit(t: Tables):
    """Every row sits with the medoid nearest to it."""
    found = materialise(cluster.kmedoids(spending(t), "o_custkey", SPENDING, 3))
    scaled = materialise(cluster.robust_scale(found, SPENDING, "__s"))
    names = [f + "__s" for f in SPENDING]
    gaps = [
        F.struct(sum(((F.col(n) - m[n]) * (F.col(n) - m[n]) for n in names), F.lit(0.0)).alias("gap"), F.lit(m["cluster"]).alias("label"))
        for m in scaled.where("is_medoid").collect()  # k rows
    ]
    own = F.filter(F.array(*gaps), lambda g: g["label"] == F.col("cluster"))[0]["gap"]
    return scaled.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("cluster").alias("n_clusters"),
        F.count_if("is_medoid").alias("n_medoids"),
        F.every(own <= F.array_min(F.array(*gaps))["gap"]).alias("nearest"),
    )


@plan("elbow_audit", "AN19", "SELECT CAST(8 AS BIGINT) AS n_ks, CAST(2 AS INTEGER) AS first_k, CAST(9 AS INTEGER) AS last_k, TRUE AS falls, TRUE AS in_range")
def elbow_audit(t: Tables):
    """Inertia at k = 9 is below that at k = 2, and every silhouette lies in [-1, 1]."""
    found = cluster.elbow(spending(t), SPENDING)
    return found.agg(
        F.count("*").alias("n_ks"),
        F.min("k").alias("first_k"),
        F.max("k").alias("last_k"),
        (F.max_by("inertia", "k") < F.min_by("inertia", "k")).alias("falls"),
        F.every(F.col("silhouette").between(-1.0, 1.0)).alias("in_range"),
    )


@plan("fixed_groups_profile", "AN20 AN21 A16", """
WITH s AS (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS mean_price, max(o_totalprice) AS max_price FROM orders GROUP BY o_custkey),
g AS (SELECT *, CASE WHEN n_orders < 8 THEN 'few' WHEN n_orders < 13 THEN 'Cluster 1' ELSE 'many' END AS cluster FROM s)
""" + " UNION ALL ".join(f"""SELECT cluster, '{c}' AS "column", round(avg({c}), 3) AS mean, round(median({c})::DOUBLE, 3) AS median,
 round(stddev_samp({c}), 3) AS std, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY cluster""" for c in SPENDING))
def fixed_groups_profile(t: Tables):
    number = F.when(F.col("n_orders") < 8, 0).when(F.col("n_orders") < 13, 1).otherwise(2)
    grouped = materialise(spending(t).withColumn("cluster", cluster.label_clusters(number, {0: "few", 2: "many"})))
    profile = cluster.group_profile(grouped, "cluster", SPENDING)
    return profile.join(cluster.group_sizes(grouped, "cluster"), "cluster")


@plan("sampled_clusters", "W6 AN15 AN21", """
SELECT source, CAST(least(count(*), 40) AS BIGINT) AS n FROM documents GROUP BY source""")
def sampled_clusters(t: Tables):
    """Balanced sample, clustering and sizes in one chain; the clusters of each source add up to its sample."""
    docs = t.documents.select("doc_id", "source", "n_chars", F.size(F.split("text", "\n")).alias("n_lines"))
    sampled = ranking.sample_per_group(docs, ["source"], 40, ["doc_id"])
    clustered = cluster.kmeans(sampled, ["n_chars", "n_lines"], 2)
    sizes = clustered.groupBy("source", "cluster").agg(F.count("*").alias("n"))
    return sizes.groupBy("source").agg(F.sum("n").alias("n"))
