"""Upserts of nodes and edges as pure functions: existing and incoming tables in, the new table out.

None of them writes; a caller writes the result to a new version and then moves one pointer (see `state`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_posts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New posts with all their columns; of a known post only the embedding changes. Both have the same columns.

    Several incoming rows of an id count as one, the greatest in column order.
    """
    columns = existing.columns
    new = incoming.select(*columns).groupBy("id").agg(F.max(F.struct(*[c for c in columns if c != "id"])).alias("_n"))
    both = existing.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"), "full_outer")
    known = F.col("o.id").isNotNull()

    def value(c: str) -> Column:
        if c == "id":
            return F.coalesce("o.id", "n.id")
        fresh = F.col(f"n._n.{c}")
        if c == "embedding":
            return F.coalesce(fresh, F.col(f"o.{c}"))
        return F.when(known, F.col(f"o.{c}")).otherwise(fresh)

    return both.select(*[value(c).alias(c) for c in columns])


def ensure_users(users: DataFrame, ids: DataFrame) -> DataFrame:
    """Users with a row for each further id; its other columns are null."""
    lacking = ids.select(F.col(ids.columns[0]).alias("id")).where(F.col("id").isNotNull()).distinct().join(users, "id", "left_anti")
    return users.unionByName(lacking, allowMissingColumns=True)


def merge_wrote(existing: DataFrame, posts: DataFrame) -> DataFrame:
    """(user_id, post_id) authorship edges, each once."""
    return existing.select("user_id", "post_id").unionByName(posts.select(F.col("author_id").alias("user_id"), F.col("id").alias("post_id"))).distinct()


def merge_reactions(existing: DataFrame, incoming: DataFrame, posts: DataFrame) -> DataFrame:
    """(user_id, post_id, happened_at) edges; the first one stays, and edges to unknown posts are dropped.

    `incoming` has (id, user_id, post_id, happened_at); within it the row with the smallest id is the first.
    """
    first = incoming.groupBy("user_id", "post_id").agg(F.min(F.struct("id", "happened_at")).alias("_f"))
    new = first.select("user_id", "post_id", F.col("_f.happened_at").alias("happened_at"))
    new = new.join(posts.select(F.col("id").alias("post_id")).distinct(), "post_id", "left_semi")
    new = new.join(existing, ["user_id", "post_id"], "left_anti")
    return existing.select("user_id", "post_id", "happened_at").unionByName(new.select("user_id", "post_id", "happened_at"))


def merge_aversions(existing: DataFrame, *incoming: DataFrame) -> DataFrame:
    """(src, dst) pairs of users from blocks and mutes, as one set."""
    out = existing.select("src", "dst")
    for df in incoming:
        out = out.unionByName(df.select(F.col("account_id").alias("src"), F.col("target_account_id").alias("dst")))
    return out.distinct()


def merge_interactions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(src, dst, weight): weights of known pairs grow by the new ones."""
    both = existing.select("src", "dst", "weight").unionByName(incoming.select("src", "dst", "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def merge_totals(posts: DataFrame, totals: DataFrame) -> DataFrame:
    """Posts with their counters overwritten where new ones are known; unknown posts are not added."""
    names = ["total_favourites", "total_reblogs", "total_replies"]
    new = totals.groupBy("id").agg(F.max(F.struct(*names)).alias("_t"))
    kept = [c for c in posts.columns if c not in names]
    old = posts.select(*kept, *[(F.col(c) if c in posts.columns else F.lit(None).cast("bigint")).alias(f"_o_{c}") for c in names])
    return old.join(new, "id", "left").select(*kept, *[F.coalesce(f"_t.{c}", f"_o_{c}").alias(c) for c in names])


def merge_activity(users: DataFrame, activity: DataFrame) -> DataFrame:
    """Known users with last activity, locality and languages overwritten; no user is added."""
    names = ["last_active", "is_local", "ui_language", "languages"]
    new = activity.select(F.col("account_id").alias("id"), *[F.col(c).alias(f"_n_{c}") for c in names], F.lit(True).alias("_known"))
    kept = [c for c in users.columns if c not in names]
    joined = users.join(new, "id", "left")
    return joined.select(*kept, *[F.when(F.col("_known"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in names if c in users.columns])


def mark_recommended(existing: DataFrame, feed: DataFrame, at: Column) -> DataFrame:
    """(user_id, post_id, happened_at, score): delivered posts, marked once."""
    new = feed.select("user_id", "post_id", at.alias("happened_at"), "score").join(existing, ["user_id", "post_id"], "left_anti")
    return existing.select("user_id", "post_id", "happened_at", "score").unionByName(new)


def set_feed_time(users: DataFrame, served: DataFrame, at: Column) -> DataFrame:
    """Users with the time of their last feed set where one was written."""
    mark = served.select(F.col("user_id").alias("id"), F.lit(True).alias("_served")).distinct()
    return users.join(mark, "id", "left").withColumn("feed_generated_at", F.when(F.col("_served"), at).otherwise(F.col("feed_generated_at"))).drop("_served")
