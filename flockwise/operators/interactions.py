"""Weighted edges between users from what they do to each other's statuses."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockwise.settings import Settings


@dataclass(frozen=True)
class Cursors:
    """Largest ids that are loaded already, by source."""

    favourites: int = 0
    statuses: int = 0
    mentions: int = 0
    follows: int = 0


def interaction_edges(favourites: DataFrame, statuses: DataFrame, mentions: DataFrame, follows: DataFrame, s: Settings, since: Cursors = Cursors(),
    authors: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight, max_favourite_id, max_status_id, max_mention_id, max_follow_id).

    Favourites, replies, reblogs and loud mentions count by number, a follow once per pair; nobody counts towards
    oneself. Deleted statuses count as well; `authors` are the statuses that parents are looked up in, all of `statuses` if not
    given. Each source is reduced to its pairs before the common sum; the join keys
    are the statuses' ids, so a busy author doesn't make a skewed join.
    """
    author = (statuses if authors is None else authors).select(F.col("id").alias("_p"), F.col("account_id").alias("_a"))
    own = statuses.where(F.col("id") > since.statuses)

    def branch(rows: DataFrame, src: str, dst: str, weight: Column, cursor: str, id_: str) -> DataFrame:
        pairs = rows.where(F.col(src) != F.col(dst)).groupBy(F.col(src).alias("src"), F.col(dst).alias("dst"))
        marks = [(F.max(id_) if c == cursor else F.lit(None)).cast("bigint").alias(c) for c in _CURSORS]
        return pairs.agg(weight.cast("double").alias("weight"), *marks)

    def onto(rows: DataFrame, key: str) -> DataFrame:
        return rows.join(author, F.col(key) == F.col("_p"))

    many = lambda w: F.count("*") * F.lit(w)
    branches = [
        branch(onto(favourites.where(F.col("id") > since.favourites), "status_id"), "account_id", "_a", many(s.likes_weight_edge), "max_favourite_id", "id"),
        branch(onto(own, "in_reply_to_id"), "account_id", "_a", many(s.replies_weight_edge), "max_status_id", "id"),
        branch(onto(own, "reblog_of_id"), "account_id", "_a", many(s.reblogs_weight_edge), "max_status_id", "id"),
        branch(onto(mentions.where((F.col("id") > since.mentions) & ~F.col("silent")), "status_id"), "_a", "account_id", many(s.mentions_weight_edge), "max_mention_id", "id"),
        branch(follows.where(F.col("id") > since.follows), "account_id", "target_account_id", F.lit(s.follows_weight_edge), "max_follow_id", "id"),
    ]
    every = reduce(DataFrame.unionByName, branches)
    return every.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), *[F.max(c).alias(c) for c in _CURSORS])


_CURSORS = ("max_favourite_id", "max_status_id", "max_mention_id", "max_follow_id")


def next_cursors(edges: DataFrame) -> DataFrame:
    """The largest ids of the whole increment, one row."""
    return edges.agg(*[F.coalesce(F.max(c), F.lit(0).cast("bigint")).alias(c) for c in _CURSORS])
