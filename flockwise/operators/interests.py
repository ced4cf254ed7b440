"""How much user communities care for post communities, and how that is kept up to date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flockwise.functions.scalar import DECAY, days_before, decay, whole_days
from flockwise.settings import Settings

REACTIONS = ("favourited", "reblogged", "replied", "bookmarked")


def reaction_union(edges: dict[str, DataFrame]) -> DataFrame:
    """(user_id, post_id, happened_at, kind) of all edge tables given; a missing kind is like an empty table."""
    return reduce(DataFrame.unionByName, [df.select("user_id", "post_id", "happened_at", F.lit(k).alias("kind")) for k, df in edges.items()])


def community_signals(edges: DataFrame, users: DataFrame, posts: DataFrame, as_of: Column, s: Settings) -> DataFrame:
    """(uc, pc, favourited, ..., recommended): decayed sums per pair of communities, noise left out.

    One pass: edges meet both memberships, and a conditional sum per kind shares a single shuffle.
    """
    of_user = users.where(F.col("cluster_id").isNotNull() & (F.col("cluster_id") != s.noise_community)).select(F.col("id").alias("user_id"), F.col("cluster_id").alias("uc"))
    of_post = posts.where(F.col("cluster_id").isNotNull() & (F.col("cluster_id") != s.noise_community)).select(F.col("id").alias("post_id"), F.col("cluster_id").alias("pc"))
    met = edges.join(of_user, "user_id").join(of_post, "post_id")
    left = decay(whole_days(F.col("happened_at"), as_of), s.half_life_days)
    sums = [F.sum(F.when(F.col("kind") == k, left).otherwise(F.lit(0.0))).alias(k) for k in (*REACTIONS, "recommended")]
    return met.groupBy("uc", "pc").agg(*sums)


def interest_weights(signals: DataFrame, s: Settings, with_ctr: bool) -> DataFrame:
    """(uc, pc, interactions, weight) of the pairs with enough interactions, adjusted by the click-through rate."""
    interactions = sum((F.col(k) for k in REACTIONS[1:]), F.col(REACTIONS[0]))
    weight = F.col("favourited") * s.likes_weight + F.col("reblogged") * s.reblogs_weight + F.col("replied") * s.replies_weight + F.col("bookmarked") * s.bookmarks_weight
    rows = signals.select("uc", "pc", "recommended", interactions.alias("interactions"), weight.alias("base")).where(F.col("interactions") >= s.min_interactions)
    if not with_ctr:
        return rows.select("uc", "pc", "interactions", F.col("base").alias("weight"))
    given = F.col("recommended") + s.ctr_smoothing
    ctr = F.when((F.col("recommended") > 0) | F.lit(s.ctr_smoothing > 0), (F.col("interactions") + s.ctr_smoothing) / given).otherwise(F.lit(0.0))
    rows = rows.withColumn("ctr", ctr).where(F.col("ctr") >= s.min_ctr)
    return rows.select("uc", "pc", "interactions", (F.col("base") * (F.col("ctr") * s.ctr_weight + (1.0 - s.ctr_weight))).alias("weight"))


def scored_interests(weights: DataFrame, as_of: Column, s: Settings) -> DataFrame:
    """(uc, pc, score, based_on, last_updated, expires_at): weights over the largest of the community.

    Communities whose largest weight isn't positive have no interests.
    """
    top = F.max("weight").over(Window.partitionBy("uc"))
    rows = weights.withColumn("_top", top).where(F.col("_top") > 0)
    return rows.select("uc", "pc", (F.col("weight") / F.col("_top")).alias("score"), F.col("interactions").alias("based_on"), as_of.alias("last_updated"),
        days_before(as_of, -s.interest_ttl_days).alias("expires_at"))


def rebuild_interests(edges: dict[str, DataFrame] | DataFrame, users: DataFrame, posts: DataFrame, as_of: Column, s: Settings, communities: DataFrame | None = None) -> DataFrame:
    """All interests from scratch, or those of some user communities (uc).

    `edges` are tables by kind, or one table with a kind, which is read once. The click-through rate is off when no
    recommendation exists at all.
    """
    if isinstance(edges, DataFrame):
        with_ctr = s.ctr_enabled and not edges.where(F.col("kind") == "recommended").isEmpty()
        every = edges.where(F.col("kind").isin(*REACTIONS, *(["recommended"] if with_ctr else [])))
    else:
        with_ctr = s.ctr_enabled and "recommended" in edges and not edges["recommended"].isEmpty()
        every = reaction_union({k: df for k, df in edges.items() if k in REACTIONS or (with_ctr and k == "recommended")})
    signals = community_signals(every, users, posts, as_of, s)
    if communities is not None:
        signals = signals.join(communities.select("uc"), "uc", "left_semi")
    return scored_interests(interest_weights(signals, s, with_ctr), as_of, s)


def dirty_communities(edges: dict[str, DataFrame], users: DataFrame, since: Column, s: Settings) -> DataFrame:
    """(uc) with any reaction of a member after `since`."""
    late = reaction_union({k: df for k, df in edges.items() if k in REACTIONS}).where(F.col("happened_at") > since).select("user_id").distinct()
    mine = users.where(F.col("cluster_id").isNotNull() & (F.col("cluster_id") != s.noise_community))
    return mine.join(late, F.col("id") == F.col("user_id"), "left_semi").select(F.col("cluster_id").alias("uc")).distinct()


def decayed_interests(interests: DataFrame, hours: float, s: Settings) -> DataFrame:
    """Scores after some hours, which may be a fraction."""
    return interests.withColumn("score", F.col("score") * F.exp(F.lit(DECAY * hours / (s.half_life_days * 24.0))))


def refresh_interests(interests: DataFrame, edges: dict[str, DataFrame], users: DataFrame, posts: DataFrame, since: Column, hours: float, as_of: Column, s: Settings) -> DataFrame:
    """Decay all, replace those of communities with new reactions, drop what is nearly zero."""
    dirty = dirty_communities(edges, users, since, s)
    columns = ["uc", "pc", "score", "based_on", "last_updated", "expires_at"]
    kept = decayed_interests(interests.select(*columns), hours, s).join(dirty, "uc", "left_anti")
    fresh = rebuild_interests(edges, users, posts, as_of, s, dirty)
    return kept.select(*columns).unionByName(fresh).where(F.col("score") >= s.least_score)


def unexpired(interests: DataFrame, as_of: Column) -> DataFrame:
    """Interests whose time isn't over; one without an end stays."""
    return interests.where(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))


def similar_communities(members: DataFrame, s: Settings) -> DataFrame:
    """(uc1, uc2, score): Jaccard of member sets, the best few of each community, ties to the smaller id.

    `members` is (user_id, uc); a user may belong to several. Users meet their own communities only; a user in very
    many makes as many pairs, counted before the shuffle. Only positive scores come out.
    """
    rows = members.where(F.col("uc") != s.noise_community).select("user_id", "uc").distinct()
    size = rows.groupBy("uc").agg(F.count("*").alias("n"))
    both = rows.select("user_id", F.col("uc").alias("uc1")).join(rows.select("user_id", F.col("uc").alias("uc2")), "user_id").where("uc1 <> uc2")
    shared = both.groupBy("uc1", "uc2").agg(F.count("*").alias("m"))
    joined = shared.join(size.select(F.col("uc").alias("uc1"), F.col("n").alias("n1")), "uc1").join(size.select(F.col("uc").alias("uc2"), F.col("n").alias("n2")), "uc2")
    scored = joined.select("uc1", "uc2", (F.col("m") / (F.col("n1") + F.col("n2") - F.col("m"))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("uc1").orderBy(F.desc("score"), "uc2"))
    return scored.withColumn("_r", rank).where(F.col("_r") <= s.similar_communities).drop("_r")


def serendipity_by_similarity(similar: DataFrame, interests: DataFrame, s: Settings, combine: str = "min") -> DataFrame:
    """(uc, pc, score): interests of similar communities that a community lacks.

    The best paths by similarity times score are taken, over all communities together; where several lead to a pair
    the smallest of them counts, or the largest with combine='max'.
    """
    paths = similar.join(interests.select(F.col("uc").alias("uc2"), "pc", F.col("score").alias("s2")), "uc2")
    lacking = paths.select(F.col("uc1").alias("uc"), "pc", "uc2", (F.col("score") * F.col("s2")).alias("combined")).join(interests.select("uc", "pc"), ["uc", "pc"], "left_anti")
    best = lacking.orderBy(F.desc("combined"), "uc", "pc", "uc2").limit(s.serendipity_limit)
    agg = F.min if combine == "min" else F.max
    return best.groupBy("uc", "pc").agg((F.lit(s.serendipity_score) * agg("combined")).alias("score"))


def serendipity_at_random(interests: DataFrame, communities: DataFrame, s: Settings, seed: int = 0) -> DataFrame:
    """(uc, pc): pairs a community with interests lacks, a share of them chosen by hash, so the same on every run.

    Each community looks at as many hashed post communities as the share asks for, instead of at all pairs.
    `communities` is (pc). Distinct pairs, at most the limit, smallest hash first. Hashes are the first seven hex
    digits of MD5 over the seed and the ids.
    """
    h = lambda *c: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(x).cast("string") for x in c])), 1, 7), 16, 10).cast("bigint")
    buckets = F.lit(max(1, round(1 / s.serendipity_share)))
    own = interests.select("uc").distinct().withColumn("_b", F.pmod(h("uc"), buckets))
    other = communities.select("pc").distinct().withColumn("_b", F.pmod(h("pc"), buckets))
    lacking = own.join(other, "_b").drop("_b").join(interests.select("uc", "pc"), ["uc", "pc"], "left_anti")
    return lacking.orderBy(h("uc", "pc"), "uc", "pc").limit(s.serendipity_limit)
