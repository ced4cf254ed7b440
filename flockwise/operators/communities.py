"""Community tables from labelled nodes, and the clean-up of nodes with everything that hangs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockwise.functions.scalar import days_before
from flockwise.settings import Settings


def with_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes with `cluster_id` from (id, community); unlabelled nodes have none."""
    return nodes.drop("cluster_id").join(labels.select("id", F.col("community").alias("cluster_id")), "id", "left")


def without_singletons(nodes: DataFrame, s: Settings) -> DataFrame:
    """Nodes of communities of one member are put to the noise community.

    Members are counted before the shuffle, and the only node of a community is known from the count, so that nodes
    meet nodes by their own id and no community, nor all nodes without one, come into one task.
    """
    alone = nodes.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count("*").alias("_n"), F.min("id").alias("id")).where(F.col("_n") == 1)
    joined = nodes.join(alone.select("id", F.lit(True).alias("_alone")), "id", "left")
    return joined.withColumn("cluster_id", F.when(F.col("_alone"), F.lit(s.noise_community)).otherwise(F.col("cluster_id"))).select(*nodes.columns)


def community_sizes(nodes: DataFrame) -> DataFrame:
    """(id, size) of every community that has members."""
    return nodes.where(F.col("cluster_id").isNotNull()).groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("size"))


def memberships(nodes: DataFrame, node: str, community: str) -> DataFrame:
    """Edges from nodes to their community."""
    return nodes.where(F.col("cluster_id").isNotNull()).select(F.col("id").alias(node), F.col("cluster_id").alias(community))


def without_orphans(communities: DataFrame, nodes: DataFrame) -> DataFrame:
    """Communities that have a member."""
    return communities.join(nodes.select(F.col("cluster_id").alias("id")), "id", "left_semi")


def graph_diagnostics(nodes: DataFrame, edges: DataFrame, s: Settings) -> DataFrame:
    """Edges, their weights' sum and percentiles, out-degree percentiles, isolated nodes, resolution per weight; one row."""
    degree = nodes.select("id").join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    seen = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    isolated = nodes.select("id").join(seen, "id", "left_anti").agg(F.count("*").alias("n")).scalar()
    p = lambda c, x: F.coalesce(F.percentile(c, x), F.lit(0.0))
    weights = edges.agg(F.count("*").alias("n_edges"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight_sum"), p("weight", 0.5).alias("weight_p50"),
        p("weight", 0.9).alias("weight_p90"), p("weight", 0.99).alias("weight_p99"))
    ofdeg = lambda x: degree.agg(p("d", x).alias("v")).scalar()
    hint = F.when(F.col("weight_sum") > 0, F.lit(s.leiden_resolution) / F.col("weight_sum")).otherwise(F.lit(0.0))
    return weights.select("*", ofdeg(0.5).alias("degree_p50"), ofdeg(0.9).alias("degree_p90"), ofdeg(0.99).alias("degree_p99"), isolated.alias("n_isolated"),
        hint.alias("resolution_per_weight"))


def inactive(users: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(id) of users seen too long ago; users never seen are kept."""
    return users.where(F.col("last_active") < days_before(as_of, days)).select("id")


def cascade(graph: dict[str, DataFrame], gone_users: DataFrame) -> dict[str, DataFrame]:
    """All tables without those users, their posts and every edge that touches either; emptied communities go too.

    Tables: users, posts, reactions by (user_id, post_id) under any other name, hates (src, dst), interacts (src, dst),
    similar (src, dst of posts), interests (uc, pc), user_communities and post_communities (id, size). Missing ones are left out.
    """
    user = gone_users.select("id")
    posts = graph["posts"]
    gone_posts = posts.join(user.withColumnRenamed("id", "author_id"), "author_id", "left_semi").select("id")
    out = {"users": graph["users"].join(user, "id", "left_anti"), "posts": posts.join(gone_posts, "id", "left_anti")}
    for name, df in graph.items():
        if name in out or name.endswith("_communities") or name == "interests":
            continue
        if {"user_id", "post_id"} <= set(df.columns):
            out[name] = df.join(user.withColumnRenamed("id", "user_id"), "user_id", "left_anti").join(gone_posts.withColumnRenamed("id", "post_id"), "post_id", "left_anti")
        else:
            gone = gone_posts if name == "similar" else user
            out[name] = df.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    for name, nodes in (("user_communities", "users"), ("post_communities", "posts")):
        if name in graph:
            out[name] = community_sizes(out[nodes])
    if "interests" in graph:
        uc = out["users"].select(F.col("cluster_id").alias("uc"))
        pc = out["posts"].select(F.col("cluster_id").alias("pc"))
        out["interests"] = graph["interests"].join(uc, "uc", "left_semi").join(pc, "pc", "left_semi")
    return out


#: What goes with what: purging a kind also empties these tables and columns.
PURGES = {
    "embeddings": ("posts.embedding", "similar", "posts.cluster_id", "interests"),
    "similarity": ("similar", "posts.cluster_id", "interests"),
    "clusters": ("users.cluster_id", "posts.cluster_id", "user_communities", "post_communities", "interests", "recommended"),
    "interests": ("interests",),
    "recommendations": ("recommended",),
    "interactions": ("interacts",),
    "graph": ("users", "posts", "favourited", "reblogged", "replied", "bookmarked", "recommended", "hates", "interacts", "similar", "interests",
        "user_communities", "post_communities"),
}


def purge(graph: dict[str, DataFrame], kind: str) -> dict[str, DataFrame]:
    """All tables with one kind of data and what depends on it emptied; columns become null."""
    out = dict(graph)
    for target in PURGES[kind]:
        name, _, column = target.partition(".")
        if name not in out:
            continue
        if column:
            if column in out[name].columns:
                out[name] = out[name].withColumn(column, F.lit(None).cast(out[name].schema[column].dataType))
        else:
            out[name] = out[name].where(F.lit(False))
    return out
