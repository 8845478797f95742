"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialise

HUB_PARTS = 16  # a node with very many neighbours is joined in this many parts


def connected_components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) with root the smallest node of each component.

    ``edges`` has bigint columns a, b; ``nodes`` has node. Neighbours are pulled
    to the local minimum in alternating large-star and small-star rounds, which
    settle in about log(n) rounds even on long chains. Neighbours are reduced with
    ``min``, hubs are joined in salted parts, and each round is written to the
    shared folder.
    """
    current = materialise(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct())
    before = _fingerprint(current)
    for _ in range(max_rounds):
        current = materialise(_small_star(_large_star(current)))
        after = _fingerprint(current)
        if after == before:
            roots = current.select(F.col("u").alias("n"), F.col("v").alias("r"))
            joined = nodes.join(roots, F.col("node") == F.col("n"), "left")
            return joined.select("node", F.coalesce("r", "node").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_lowest(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    salted = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(HUB_PARTS)))
    copies = lowest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(HUB_PARTS - 1).cast("bigint"))))
    return salted.join(copies, ["u", "part"]).drop("part")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _with_lowest(both.where("v > u"), lowest).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    pulled = _with_lowest(edges, lowest).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pulled.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
