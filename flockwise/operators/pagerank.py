"""Weighted PageRank on an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.session import checkpoint_dir
from flockwise.settings import Settings


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) usable both ways; parallel and reciprocal edges add up, loops are dropped."""
    there = edges.select("src", "dst", "weight").where("src <> dst")
    back = there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return there.unionByName(back).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def pagerank(nodes: DataFrame, edges: DataFrame, s: Settings, start: float = 1.0, every: int = 5) -> DataFrame:
    """(id, pagerank) after a fixed number of rounds; isolated nodes get 1 - damping.

    A node's rank flows along its edges by weight. Transition shares are computed once and kept; sums are combined
    before the shuffle, so a node with many neighbours is no hot key. Every few rounds the lineage is cut by a
    checkpoint. Edges to unknown nodes are ignored.
    """
    checkpoint_dir(nodes.sparkSession)
    ids = nodes.select("id").distinct()
    both = undirected(edges).join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    out = both.groupBy("src").agg(F.sum("weight").alias("_all"))
    shares = both.join(out.where(F.col("_all") > 0), "src").select("src", "dst", (F.col("weight") / F.col("_all")).alias("share")).checkpoint()
    ranks = ids.withColumn("pagerank", F.lit(float(start)))
    for n in range(1, s.pagerank_iterations + 1):
        got = shares.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("pagerank") * F.col("share")).alias("_in"))
        ranks = ids.join(got, F.col("id") == F.col("dst"), "left").select("id", (F.lit(1 - s.damping) + s.damping * F.coalesce("_in", F.lit(0.0))).alias("pagerank"))
        if n % every == 0 and n < s.pagerank_iterations:
            ranks = ranks.checkpoint()
    return ranks
