"""Queries on the event graph: interests, feeds, graph algorithms and statistics."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flockwise.functions.scalar import days_before, language_boost, moment, recency, whole_hours
from flockwise.operators import communities, feeds, interests, knn, leiden, merge, stats
from flockwise.operators.pagerank import pagerank
from flockwise.settings import Settings
from flockwise.sources import scans
from flockwise.sources.fixtures import AS_OF, EVENT_SQL, SOCIAL_AS_OF, SOCIAL_SQL, event_graph, reactions_of, social_graph
from flockwise.sources.tables import table

S = Settings()
SINCE = "2024-01-29 00:00:00"
HOURS = 48.5


def _now() -> Column:
    return moment(AS_OF)


def _graph(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return event_graph(spark, d)


def _edges(g: dict[str, DataFrame], ctr: bool = True) -> dict[str, DataFrame]:
    return {k: g[k] for k in (*interests.REACTIONS, *(("recommended",) if ctr else ()))}


def _interests(g: dict[str, DataFrame]) -> DataFrame:
    return interests.rebuild_interests(g["edges"], g["users"], g["posts"], _now(), S)


def _sizes(g: dict[str, DataFrame], nodes: str) -> DataFrame:
    return communities.community_sizes(g[nodes])


def _rated(g: dict[str, DataFrame], s: Settings = S) -> DataFrame:
    return feeds.rated_posts(g["posts"], reactions_of(g), _now(), s)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def interest_scores(spark: SparkSession, d: str) -> DataFrame:
    """Interest of each user community in each post community, scaled by the community's largest."""
    return _rounded(_interests(_graph(spark, d)), "score", "based_on")


def interest_scores_no_ctr(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return _rounded(interests.rebuild_interests(_edges(g, False), g["users"], g["posts"], _now(), S), "score", "based_on")


def interest_dirty(spark: SparkSession, d: str) -> DataFrame:
    """User communities with a reaction after a time."""
    g = _graph(spark, d)
    return interests.dirty_communities(_edges(g), g["users"].where("id % 5 <> 1"), moment("2024-01-30 20:00:00"), S)


def interest_scores_dirty(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    dirty = interests.dirty_communities(_edges(g), g["users"].where("id % 5 <> 1"), moment("2024-01-30 20:00:00"), S)
    return _rounded(interests.rebuild_interests(_edges(g), g["users"], g["posts"], _now(), S, dirty), "score", "based_on")


def interest_global_decay(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(interests.decayed_interests(_interests(_graph(spark, d)), HOURS, S), "score", "based_on").select("uc", "pc", "score")


def _aged(g: dict[str, DataFrame]) -> DataFrame:
    return _interests(g).withColumn("expires_at", F.when(F.col("pc") % 3 > 0, days_before(_now(), 1) + F.make_dt_interval(F.col("pc").cast("int") % 3)))


def interest_unexpired(spark: SparkSession, d: str) -> DataFrame:
    return interests.unexpired(_aged(_graph(spark, d)), _now()).select("uc", "pc", "expires_at")


def interest_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Interests of a week earlier, brought up to date; only communities of late reactions are computed anew."""
    g = _graph(spark, d)
    old = interests.rebuild_interests(_edges(g), g["users"], g["posts"], moment("2024-01-24 00:00:00"), S).withColumn("score",
        F.col("score") * F.when(F.col("pc") == 3, 0.005).otherwise(1.0))
    late = {**_edges(g), **{k: g[k].where("user_id % 5 <> 1 OR happened_at <= TIMESTAMP_NTZ '2024-01-29 00:00:00'") for k in interests.REACTIONS}}
    return _rounded(interests.refresh_interests(old, late, g["users"], g["posts"], moment(SINCE), HOURS, _now(), S), "score", "based_on").select("uc", "pc", "score", "based_on")


def community_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Communities of users by the posts' community they react to, so that a user is in several."""
    g = _graph(spark, d)
    members = g["replied"].select("user_id", (F.col("post_id") % 10).alias("uc"))
    return _rounded(interests.similar_communities(members, S), "score")


def serendipity_similar(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    i = _interests(g).where("(uc + pc) % 3 <> 0")
    near = interests.similar_communities(g["replied"].select("user_id", (F.col("post_id") % 5).alias("uc")), S)
    return _rounded(interests.serendipity_by_similarity(near, i, replace(S, serendipity_limit=1000)), "score")


def serendipity_random(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return interests.serendipity_at_random(_interests(g).where("(uc + pc) % 3 <> 0"), g["posts"].select(F.col("cluster_id").alias("pc")), replace(S, serendipity_share=0.5))


def local_popularity(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    rows = feeds.local_counts(g["posts"], reactions_of(g), S)
    return rows.select("post_id", "local_raw", F.round(F.log10(F.col("local_raw") + 1), 6).alias("contrib"))


def global_popularity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rated(_graph(spark, d), replace(S, popularity_mode="global")).select("id", "global_raw", "popularity_contrib"), "global_raw", "popularity_contrib")


def blended_popularity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rated(_graph(spark, d), replace(S, popularity_mode="blended")).select("id", "popularity_contrib"), "popularity_contrib")


def recency_score(spark: SparkSession, d: str) -> DataFrame:
    age = whole_hours(F.col("created_at"), _now())
    return _graph(spark, d)["posts"].select("id", age.alias("age_hours"), F.round(recency(age, S), 6).alias("recency"))


def language_boosts(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    pairs = g["favourited"].select("user_id", "post_id").join(g["users"].select(F.col("id").alias("user_id"), "ui_language", "languages"), "user_id")
    pairs = pairs.join(g["posts"].select(F.col("id").alias("post_id"), "language"), "post_id")
    return pairs.select("user_id", "post_id", language_boost(F.col("language"), F.col("ui_language"), F.col("languages"), S).alias("boost"))


def _pairs(g: dict[str, DataFrame]) -> DataFrame:
    """Readers and posts that an event links."""
    rows = g["replied"].select("user_id", "post_id").unionByName(g["reblogged"].select("user_id", "post_id")).distinct()
    return rows.join(g["posts"].select(F.col("id").alias("post_id"), "author_id"), "post_id").select("user_id", "post_id", "author_id")


def feed_eligible_pairs(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return feeds.unsuitable(_pairs(g), g["wrote"], g["favourited"], g["recommended"], g["hates"]).select("user_id", "post_id")


def feed_filter_flags(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return feeds.filter_flags(_pairs(g), g["wrote"], g["favourited"], g["recommended"], g["hates"]).drop("author_id")


def _feeds(g: dict[str, DataFrame], columns: tuple[str, ...] = ()) -> DataFrame:
    return feeds.personal_feeds(g["users"], _rated(g), _interests(g), _sizes(g, "posts"), g, S, columns=columns)


def feed_personalized_all(spark: SparkSession, d: str) -> DataFrame:
    """The feeds of all users."""
    return _rounded(_feeds(_graph(spark, d)), "score")


def feed_detail(spark: SparkSession, d: str) -> DataFrame:
    """The same with every component of the score."""
    return _rounded(_feeds(_graph(spark, d), feeds.DETAIL), "score", *(c for c in feeds.DETAIL if c != "age_hours"))


def feed_explain_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How, or why not, each post comes to the feed of each user that an event links to it."""
    g = _graph(spark, d)
    shown = g["reblogged"].select("user_id", "post_id", (F.col("post_id") % 7).cast("double").alias("score"))
    rows = feeds.explain(g["edges"].select("user_id", "post_id"), g["users"], g["posts"], reactions_of(g), _interests(g), _sizes(g, "posts"), g, shown, _now(), S)
    return _rounded(rows, "final_score", *(c for c in feeds.DETAIL if c != "age_hours"))


def feed_cold_start(spark: SparkSession, d: str) -> DataFrame:
    """Feeds that need no community, of all users."""
    g = _graph(spark, d)
    return _rounded(feeds.cold_start(g["users"], _rated(g), g, S), "score")


def public_feed_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of a public feed with rank scores."""
    g = _graph(spark, d)
    return feeds.public_members(feeds.public_feed(g["users"], _rated(g), _interests(g), S, True, False, S.feed_size), "local", S)


def _public(spark: SparkSession, d: str, local: bool, authors: bool) -> DataFrame:
    g = _graph(spark, d)
    return _rounded(feeds.public_feed(g["users"], _rated(g), _interests(g), S, local, authors, 20), "score")


def public_feed_local(spark: SparkSession, d: str) -> DataFrame:
    return _public(spark, d, True, False)


def public_feed_all(spark: SparkSession, d: str) -> DataFrame:
    return _public(spark, d, False, False)


def public_feed_local_authors(spark: SparkSession, d: str) -> DataFrame:
    return _public(spark, d, True, True)


def _members(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "recommendation_detail").where(F.col("viewer_user_id").isNotNull() & F.col("post_id").isNotNull())
    best = rows.groupBy(F.col("viewer_user_id").alias("user_id"), "post_id").agg(F.max("age_hours").alias("a")).withColumn("score", F.coalesce("a", F.lit(0.0)))
    return feeds.feed_members(feeds.top_of_users(best, S.feed_size), S)


def feed_rank_scores(spark: SparkSession, d: str) -> DataFrame:
    """Members of feeds with scores made of the largest id and the rank."""
    return _members(spark, d)


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).withColumn("score", F.when(F.col("post_id") % 3 == 0, F.col("post_id").cast("double")).otherwise(F.col("score")))


def feed_own_entries(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).select("user_id", "post_id", feeds.entry_source(S).alias("source"))


def feed_cleared(spark: SparkSession, d: str) -> DataFrame:
    return feeds.without_own_entries(_mixed(spark, d), S).select("user_id", "post_id")


def feed_member_rank(spark: SparkSession, d: str) -> DataFrame:
    return feeds.member_ranks(_mixed(spark, d)).select("user_id", "post_id", "place")


def feed_range(spark: SparkSession, d: str) -> DataFrame:
    return feeds.member_range(_mixed(spark, d), 2, 4).select("user_id", "post_id", "place")


def feed_lengths(spark: SparkSession, d: str) -> DataFrame:
    return feeds.feed_lengths(_members(spark, d))


def dirty_users(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return feeds.dirty_users(g["users"], g["posts"].where("cluster_id < 5"), _interests(g).withColumn("last_updated", days_before(_now(), 3)), g["recommended"],
        reactions_of(g), _now(), replace(S, active_days=2))


def merge_recommended(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    feed = g["reblogged"].select("user_id", "post_id", F.lit(1.0).alias("score"))
    return merge.mark_recommended(g["recommended"].withColumn("score", F.lit(2.0)), feed, _now())


def feed_times(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return merge.set_feed_time(g["users"], g["reblogged"].where("user_id % 4 = 1"), _now()).select("id", "feed_generated_at")


def active_users(spark: SparkSession, d: str) -> DataFrame:
    return scans.active_users(_graph(spark, d)["users"], _now(), 1, True)


# nearest posts, on the embeddings table

_NEAR = replace(S, similarity_threshold=0.6, knn_neighbours=5)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", days_before(_now(), 0).alias("created_at")).withColumn("created_at",
        F.col("created_at") - F.make_dt_interval((F.col("id") % 30).cast("int")))


def knn_edges(spark: SparkSession, d: str) -> DataFrame:
    """Young vectors and their nearest of any age."""
    return _rounded(knn.similarity_edges(_vectors(spark, d), _now(), _NEAR, 64), "weight")


def knn_edges_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(knn.similarity_edges(_vectors(spark, d), _now(), replace(_NEAR, similarity_threshold=0.2), 64, "cosine"), "weight")


def knn_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that a later build has to search for."""
    v = _vectors(spark, d)
    old = knn.similarity_edges(v.where("id % 2 = 0"), _now(), _NEAR, 64)
    return knn.posts_to_connect(v, old, _NEAR.similarity_signature(), _NEAR)


def knn_incremental_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges of a later build: the former ones of half of the vectors, and those of vectors that lacked any."""
    v = _vectors(spark, d)
    old = knn.similarity_edges(v.where("id % 2 = 0"), _now(), _NEAR, 64)
    return _rounded(knn.updated_edges(v, old, _NEAR.similarity_signature(), _now(), _NEAR, 64), "weight")


def similarity_stats(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return _rounded(knn.similarity_stats(knn.similarity_edges(v, _now(), _NEAR, 64), v), "min_weight", "avg_weight", "median_weight", "max_weight")


def similarity_pruned(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    e = knn.similarity_edges(v, _now(), replace(_NEAR, similarity_recency_days=40), 64)
    temporal = knn.pruned(e, v, _now(), replace(_NEAR, prune_days=20)).select("src", "dst", F.lit("temporal").alias("strategy"))
    partial = knn.pruned(e, v, _now(), replace(_NEAR, prune_strategy="partial", prune_threshold=0.7)).select("src", "dst", F.lit("partial").alias("strategy"))
    return temporal.unionByName(partial)


def vector_readiness(spark: SparkSession, d: str) -> DataFrame:
    return knn.vector_readiness(table(spark, d, "post"), 64)


# graphs of users who react to the same authors

def _user_graph(g: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    e = g["favourited"].join(g["wrote"].select(F.col("user_id").alias("dst"), "post_id"), "post_id").select(F.col("user_id").alias("src"), "dst").where("src <> dst")
    return g["users"].select("id"), e.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def page_rank(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _user_graph(_graph(spark, d))
    return _rounded(pagerank(nodes, edges, S), "pagerank")


def _post_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = _vectors(spark, d)
    return v.select("id"), knn.similarity_edges(v, _now(), replace(_NEAR, similarity_recency_days=40), 64)


def user_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of users by their interactions."""
    nodes, edges = _user_graph(_graph(spark, d))
    return leiden.leiden(nodes, edges, replace(S, leiden_resolution=1.0))


def post_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of vectors by similarity."""
    nodes, edges = _post_graph(spark, d)
    return leiden.leiden(nodes, edges, replace(S, leiden_resolution=1.0))


def connected_parts(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of a sparse graph of vectors."""
    nodes, edges = _post_graph(spark, d)
    return leiden.components(nodes, edges.where("weight > 0.68"))


def modularity(spark: SparkSession, d: str) -> DataFrame:
    """Of the users' stand-in communities."""
    g = _graph(spark, d)
    nodes, edges = _user_graph(g)
    return _rounded(leiden.modularity(edges, g["users"].select("id", F.col("cluster_id").alias("community"))), "modularity")


def singleton_collapse(spark: SparkSession, d: str) -> DataFrame:
    users = _graph(spark, d)["users"].withColumn("cluster_id", F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(F.col("cluster_id")))
    return communities.without_singletons(users, S).select("id", "cluster_id")


def community_sizes(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return _sizes(g, "users").withColumn("kind", F.lit("user")).unionByName(_sizes(g, "posts").withColumn("kind", F.lit("post")))


def community_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Communities that still have members after some users are left out."""
    g = _graph(spark, d)
    return communities.without_orphans(_sizes(g, "users"), g["users"].where("cluster_id <> 2")).select("id", "size")


def graph_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _user_graph(_graph(spark, d))
    return _rounded(communities.graph_diagnostics(nodes, edges, S), "resolution_per_weight", digits=9)


def cleanup_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table after users seen too long ago are removed with all that hangs on them."""
    g = _graph(spark, d)
    g["interests"], g["user_communities"], g["post_communities"] = _interests(g), _sizes(g, "users"), _sizes(g, "posts")
    del g["edges"]
    return stats.table_counts(communities.cascade(g, communities.inactive(g["users"].withColumn("last_active",
        F.when(F.col("id") % 6 > 0, F.col("last_active"))), moment("2024-01-31 18:00:00"), 1)))


def purge_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are left in each table, and vectors and memberships, after each kind of purge."""
    g = _graph(spark, d)
    g["interests"], g["user_communities"], g["post_communities"] = _interests(g), _sizes(g, "users"), _sizes(g, "posts")
    _, g["interacts"] = _user_graph(g)
    counted = ("users", "posts", "favourited", "recommended", "interacts", "interests", "user_communities", "post_communities")

    def left(kind: str) -> DataFrame:
        out = communities.purge(g, kind)
        parts = {n: out[n] for n in counted} | {"embedded": out["posts"].where("embedding IS NOT NULL"),
            "clustered_users": out["users"].where("cluster_id IS NOT NULL"), "clustered_posts": out["posts"].where("cluster_id IS NOT NULL")}
        return stats.table_counts(parts).withColumn("kind", F.lit(kind))

    return reduce(DataFrame.unionByName, [left(kind) for kind in communities.PURGES])


def _soundness(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes, labelled ones, communities that hang apart or have another label than their smallest id, and whether modularity is above that of single nodes."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    labels = labels.checkpoint()
    apart = labels.join(leiden.connected(both, labels).withColumnRenamed("community", "c"), "id").where("c <> community")
    gain = lambda x: leiden.modularity(edges, x).select("modularity").scalar()
    return nodes.agg(F.count("*").alias("nodes")).select(
        "nodes", labels.agg(F.count_distinct("id").alias("n")).scalar().alias("labelled"), apart.agg(F.count("*").alias("n")).scalar().alias("apart"),
        (gain(labels) > gain(labels.withColumn("community", F.col("id")))).alias("better"),
    )


def user_community_soundness(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _user_graph(_graph(spark, d))
    return _soundness(nodes, edges, user_communities(spark, d))


def post_community_soundness(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _post_graph(spark, d)
    return _soundness(nodes, edges, post_communities(spark, d))


def constraint_check(spark: SparkSession, d: str) -> DataFrame:
    """Repeated keys and vectors of another length in the tables as they come."""
    tables = {"post": table(spark, d, "post"), "statuses": table(spark, d, "statuses"), "favourites": table(spark, d, "favourites"), "embeddings": table(spark, d, "embeddings")}
    keys = {"post": ("id",), "statuses": ("id",), "favourites": ("account_id", "status_id"), "embeddings": ("vec_id",)}
    return stats.constraint_violations(tables, keys, 64)


def pairs_in_both(spark: SparkSession, d: str) -> DataFrame:
    """Users and posts that are linked by a favourite and by a reblog."""
    g = _graph(spark, d)
    return stats.in_both(g["favourited"], g["reblogged"], ("user_id", "post_id"))


def pairs_in_first(spark: SparkSession, d: str) -> DataFrame:
    """Users and posts that are linked by a favourite and not by a reply."""
    g = _graph(spark, d)
    return stats.only_in_first(g["favourited"], g["replied"], ("user_id", "post_id"))


# statistics

def node_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return stats.table_counts({k: g[k] for k in ("users", "posts", "favourited", "reblogged", "replied", "bookmarked", "recommended", "hates", "wrote")})


def connectivity(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _user_graph(_graph(spark, d))
    return _rounded(stats.connectivity(nodes, edges), "avg_degree")


def embedding_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.embedding_coverage(table(spark, d, "post")), "percent")


def mean_interactions(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return _rounded(stats.mean_interactions(g["users"], g["posts"], reactions_of(g)), "per_user", "per_post")


def top_languages(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_languages(table(spark, d, "documents").withColumnRenamed("lang", "language"), 5)


def _author_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("author").isNotNull()).groupBy(F.col("author").alias("id")).agg(F.count("*").alias("size"))


def size_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.size_distribution(_author_sizes(spark, d)), "percent")


def size_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.size_stats(_author_sizes(spark, d)), "avg_size", "median_size", "p90_size")


def top_user_communities(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    _, edges = _user_graph(g)
    return _rounded(stats.top_user_communities(g["users"], _sizes(g, "users"), edges, reactions_of(g)), "avg_activity", "most_active_activity")


def top_post_communities(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return _rounded(stats.top_post_communities(g["posts"], _sizes(g, "posts"), _rated(g, replace(S, feed_days=100))), "avg_popularity", "popular_post_popularity_contrib")


def user_profile(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return stats.user_profile(g["users"], 3, g["wrote"], reactions_of(g), _interests(g))


def post_profile(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return stats.post_profile(g["posts"], 5, reactions_of(g), _sizes(g, "posts"))


def interest_overview(spark: SparkSession, d: str) -> DataFrame:
    return stats.interest_overview(_aged(_graph(spark, d)), _now())


def export_interests(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.top_interests(_interests(_graph(spark, d))), "score")


def export_members(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return stats.member_samples(g["users"], _sizes(g, "users"), 3, 4)


def export_edges(spark: SparkSession, d: str) -> DataFrame:
    _, edges = _user_graph(_graph(spark, d))
    return stats.edge_sample(edges, 25)


def graph_readiness(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return stats.readiness(g["posts"].where(F.lit(False)), g["users"], _interests(g))


# the relational tables as a graph, at their own size

SOCIAL = replace(S, half_life_days=180.0, min_interactions=1.0, feed_days=90)


def _social(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], Column]:
    return social_graph(spark, d), moment(SOCIAL_AS_OF)


def _social_interests(g: dict[str, DataFrame], now: Column) -> DataFrame:
    return interests.rebuild_interests(_edges(g), g["users"], g["posts"], now, SOCIAL)


def _social_rated(g: dict[str, DataFrame], now: Column) -> DataFrame:
    return feeds.rated_posts(g["posts"], interests.reaction_union(_edges(g, False)), now, SOCIAL)


def social_interests(spark: SparkSession, d: str) -> DataFrame:
    """Interests of the accounts' communities in the posts' clusters."""
    g, now = _social(spark, d)
    return _rounded(_social_interests(g, now), "score", "based_on").select("uc", "pc", "score", "based_on")


def social_feeds(spark: SparkSession, d: str) -> DataFrame:
    """The feeds of all accounts."""
    g, now = _social(spark, d)
    return _rounded(feeds.personal_feeds(g["users"], _social_rated(g, now), _social_interests(g, now), _sizes(g, "posts"), g, SOCIAL), "score")


def social_cold_start(spark: SparkSession, d: str) -> DataFrame:
    """Feeds of all accounts that need no community."""
    g, now = _social(spark, d)
    return _rounded(feeds.cold_start(g["users"], _social_rated(g, now), g, SOCIAL), "score")


def social_public_feed(spark: SparkSession, d: str) -> DataFrame:
    """The best posts of local authors for everybody."""
    g, now = _social(spark, d)
    return _rounded(feeds.public_feed(g["users"], _social_rated(g, now), _social_interests(g, now), SOCIAL, True, True, S.feed_size), "score")


# SQL

_B = f"WITH {EVENT_SQL}"
_T = f"TIMESTAMP '{AS_OF}'"


def _interest_sql(at: str = AS_OF, ctr: bool = True, only: str = "true", late: str = "true", half: float = 14.0, least: float = 5.0) -> str:
    """Interests at a time; `only` is a condition on uc, `late` on the reactions."""
    base = "l * 1.0 + r * 3.0 + p * 5.0 + b * 2.0"
    weight = f"({base}) * (0.5 * ((l + r + p + b + 1.0) / (rec + 1.0)) + 0.5)" if ctr else base
    return f"""SELECT uc, pc, w / top AS score, n AS based_on, TIMESTAMP '{at}' AS last_updated, TIMESTAMP '{at}' + INTERVAL 30 DAY AS expires_at FROM (
SELECT *, max(w) OVER (PARTITION BY uc) AS top FROM (SELECT uc, pc, l + r + p + b AS n, {weight} AS w FROM (
SELECT u.cluster_id AS uc, q.cluster_id AS pc, sum(CASE WHEN kind = 'favourited' THEN x ELSE 0.0 END) AS l, sum(CASE WHEN kind = 'reblogged' THEN x ELSE 0.0 END) AS r,
sum(CASE WHEN kind = 'replied' THEN x ELSE 0.0 END) AS p, sum(CASE WHEN kind = 'bookmarked' THEN x ELSE 0.0 END) AS b, sum(CASE WHEN kind = 'recommended' THEN x ELSE 0.0
END) AS rec
FROM (SELECT *, exp(-0.693147::DOUBLE * date_sub('day', happened_at, TIMESTAMP '{at}') / {half}) AS x FROM (SELECT * FROM reactions WHERE {late} UNION ALL SELECT *,
'recommended' FROM recommended)) k
JOIN users u ON u.id = k.user_id JOIN posts q ON q.id = k.post_id WHERE u.cluster_id <> -1 AND q.cluster_id <> -1 GROUP BY 1, 2) WHERE l + r + p + b >= {least}) WHERE
{only}) WHERE top > 0"""


_I = f"i AS ({_interest_sql()})"
_SIZES = "us AS (SELECT cluster_id AS id, count(*) AS size FROM users GROUP BY 1), ps AS (SELECT cluster_id AS id, count(*) AS size FROM posts GROUP BY 1)"
_LOCAL = """lr AS (SELECT p.id AS post_id, coalesce(sum(CASE kind WHEN 'favourited' THEN 1.0::DOUBLE WHEN 'reblogged' THEN 3.0 WHEN 'replied' THEN 5.0 WHEN 'bookmarked' THEN 2.0
END), 0.0) AS local_raw FROM posts p LEFT JOIN reactions r ON r.post_id = p.id GROUP BY 1)"""
_GLOBAL = "coalesce(total_favourites, 0) / 3.0::DOUBLE + coalesce(total_reblogs, 0) / 3.0::DOUBLE + coalesce(total_replies, 0) / 3.0::DOUBLE"


def _rated_sql(days: int = 7, at: str = AS_OF) -> str:
    return f"""{_LOCAL}, rp AS (SELECT p.* REPLACE (coalesce(pagerank, 0.0) AS pagerank), local_raw, {_GLOBAL} AS global_raw, log10(local_raw + 1.0) AS pop, date_sub('hour', created_at,
TIMESTAMP '{at}') AS age_hours
FROM posts p JOIN lr ON lr.post_id = p.id WHERE created_at > TIMESTAMP '{at}' - INTERVAL {days} DAY)"""


_BOOST = """CASE WHEN {p}.language IS NULL THEN 0.3::DOUBLE WHEN {u}.ui_language IS NULL AND ({u}.languages IS NULL OR len({u}.languages) = 0) THEN 0.3
WHEN {u}.ui_language IS NOT NULL AND {p}.language = {u}.ui_language THEN 0.5 WHEN {u}.languages IS NOT NULL AND list_contains({u}.languages, {p}.language) THEN 0.3 ELSE
0.0 END"""
_UNSEEN = """NOT EXISTS (SELECT 1 FROM recommended z WHERE z.user_id = {u} AND z.post_id = {p}) AND NOT EXISTS (SELECT 1 FROM wrote z WHERE z.user_id = {u} AND z.post_id = {p})
AND NOT EXISTS (SELECT 1 FROM favourited z WHERE z.user_id = {u} AND z.post_id = {p}) AND NOT EXISTS (SELECT 1 FROM hates z WHERE z.src = {u} AND z.dst = {a})"""
_FEED_PART = f"""tot AS (SELECT uc, sum(score) AS sum_i, max(coalesce(size, 0)::DOUBLE) AS top FROM i LEFT JOIN ps ON ps.id = i.pc GROUP BY 1),
fd AS (SELECT u.id AS user_id, p.id AS post_id, i.score AS interest_score, CASE WHEN sum_i > 0 THEN i.score / sum_i ELSE 0.0 END AS share_i, CASE WHEN top > 0 THEN
coalesce(size, 0) / top ELSE 0.0 END AS norm_pc_size,
local_raw, global_raw, pop AS popularity_contrib, age_hours, pagerank, {_BOOST.format(p='p', u='u')} AS language_match, p.author_id
FROM users u JOIN i ON i.uc = u.cluster_id JOIN tot ON tot.uc = i.uc LEFT JOIN ps ON ps.id = i.pc JOIN rp p ON p.cluster_id = i.pc),
sc AS (SELECT *, share_i * 0.45 + norm_pc_size * 0.05 + popularity_contrib * 0.3 + (1.0 / (age_hours / 24.0 + 1.0)) * 0.2 + pagerank * 0.1 + language_match AS score FROM
fd)"""
_FEED = f"{_I}, {_SIZES}, {_rated_sql()}, {_FEED_PART}"
_TOP = f"""t AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, post_id DESC) AS INTEGER) AS rank FROM sc WHERE
{_UNSEEN.format(u='sc.user_id', p='sc.post_id', a='sc.author_id')})"""
_PAIRS = """pr AS (SELECT x.user_id, x.post_id, p.author_id FROM (SELECT user_id, post_id FROM replied UNION SELECT user_id, post_id FROM reblogged) x JOIN posts p ON p.id =
x.post_id)"""


def _hash_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 7) AS BIGINT)"


def _public_sql(local: bool, authors: bool) -> str:
    interest = "SELECT pc, sum(score * n) AS ci FROM i JOIN (SELECT cluster_id AS uc, count(*) AS n FROM users WHERE is_local GROUP BY 1) USING (uc) GROUP BY 1" if local else "SELECT pc, sum(score) AS ci FROM i GROUP BY 1"
    keep = "WHERE author_id IN (SELECT id FROM users WHERE is_local)" if authors else ""
    return f"""{_B}, {_I}, {_rated_sql()}, w AS ({interest}) SELECT id AS post_id, round(ci * 0.5 + pop * 0.3 + 0.2 / (age_hours / 24.0 + 1.0) + pagerank * 0.1, 6) AS score FROM rp JOIN
w ON w.pc = rp.cluster_id {keep} ORDER BY ci * 0.5 + pop * 0.3 + 0.2 / (age_hours / 24.0 + 1.0) + pagerank * 0.1 DESC, id DESC LIMIT 20"""


_MEM = """m0 AS (SELECT viewer_user_id AS user_id, post_id, coalesce(max(age_hours), 0.0) AS s FROM recommendation_detail WHERE viewer_user_id IS NOT NULL AND post_id IS NOT NULL
GROUP BY 1, 2),
m1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, post_id DESC) AS rank FROM m0), m2 AS (SELECT * FROM m1 WHERE rank <= 500),
mem AS (SELECT user_id, post_id, CAST(CAST(max(post_id) OVER w AS HUGEINT) * 10 + count(*) OVER w - (rank - 1) AS DOUBLE) AS score FROM m2 WINDOW w AS (PARTITION BY
user_id)),
mix AS (SELECT * REPLACE (CASE WHEN post_id % 3 = 0 THEN CAST(post_id AS DOUBLE) ELSE score END AS score) FROM mem)"""
_PLACE = "pl AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, CAST(post_id AS VARCHAR) DESC) - 1 AS INTEGER) AS place FROM mix)"
_V = f"v AS (SELECT vec_id AS id, [x::DOUBLE for x in embedding] AS e, {_T} - to_days(CAST(vec_id % 30 AS INTEGER)) AS created_at FROM embeddings)"


def _knn_sql(days: int, weight: str, least: float, keep: str = "true") -> str:
    return f"""c AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id WHERE {keep} AND a.created_at > {_T} - INTERVAL {days}
DAY),
ed AS (SELECT src, dst, {weight} AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) AS n FROM c) WHERE n <= 5 AND {weight} > {least})"""


_KNN = _knn_sql(7, "(1 + c) / 2", 0.6)
_KNN40 = _knn_sql(40, "(1 + c) / 2", 0.6)
_UG = """ug AS (SELECT f.user_id AS src, w.user_id AS dst, count(*)::DOUBLE AS weight FROM favourited f JOIN wrote w ON w.post_id = f.post_id WHERE f.user_id <> w.user_id GROUP BY
1, 2)"""
_BOTH = "bo AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM ug UNION ALL SELECT dst, src, weight FROM ug) GROUP BY 1, 2)"
_KNOWN = "bo2 AS (SELECT * FROM bo WHERE src IN (SELECT id FROM users) AND dst IN (SELECT id FROM users))"
_RANKS = ", ".join(
    ["sh AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS s FROM bo2)", "r0 AS (SELECT id, 1.0::DOUBLE AS r FROM users)"]
    + [f"r{n} AS (SELECT u.id, 0.15 + 0.85 * coalesce(x.g, 0.0) AS r FROM users u LEFT JOIN (SELECT dst, sum(r * s) AS g FROM sh JOIN r{n - 1} ON r{n - 1}.id = sh.src GROUP BY 1) x ON x.dst = u.id)" for n in range(1, S.pagerank_iterations + 1)]
)
_DIRTY = """SELECT DISTINCT cluster_id FROM users WHERE id % 5 <> 1 AND cluster_id <> -1 AND id IN (SELECT user_id FROM reactions WHERE happened_at > TIMESTAMP '2024-01-30 20:00:00')"""
_LATE = "(user_id % 5 <> 1 OR happened_at <= TIMESTAMP '2024-01-29 00:00:00')"
_AUTHORS = "sz AS (SELECT author AS id, count(*) AS size FROM documents WHERE author IS NOT NULL GROUP BY 1)"
_ACTIVE = """acts AS (SELECT u.id, u.cluster_id, u.ui_language, coalesce(w, 0.0) + coalesce(r, 0) AS activity FROM users u LEFT JOIN (SELECT src, sum(weight) AS w FROM ug GROUP BY 1)
a ON a.src = u.id LEFT JOIN (SELECT user_id, count(*) AS r FROM reactions GROUP BY 1) b ON b.user_id = u.id)"""


def _langs(rows: str, column: str) -> str:
    return f"""(SELECT cluster_id, string_agg({column}, ',' ORDER BY n DESC, {column}) AS l FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, {column}) AS k
FROM (SELECT cluster_id, {column}, count(*) AS n FROM {rows} WHERE {column} IS NOT NULL GROUP BY 1, 2)) WHERE k <= 3 GROUP BY 1)"""


def _counts(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in names)


_GONE = """gu AS (SELECT id FROM users WHERE id % 6 > 0 AND last_active < TIMESTAMP '2024-01-31 18:00:00' - INTERVAL 1 DAY), gp AS (SELECT id FROM posts WHERE author_id IN (SELECT id FROM gu))"""
_LEFT = {k: f"SELECT * FROM {k} WHERE user_id NOT IN (SELECT id FROM gu) AND post_id NOT IN (SELECT id FROM gp)" for k in ("favourited", "reblogged", "replied",
    "bookmarked", "recommended", "wrote")}
_LEFT |= {"users": "SELECT * FROM users WHERE id NOT IN (SELECT id FROM gu)", "posts": "SELECT * FROM posts WHERE id NOT IN (SELECT id FROM gp)",
    "hates": "SELECT * FROM hates WHERE src NOT IN (SELECT id FROM gu) AND dst NOT IN (SELECT id FROM gu)"}
_LEFT |= {"user_communities": f"SELECT DISTINCT cluster_id FROM ({_LEFT['users']})", "post_communities": f"SELECT DISTINCT cluster_id FROM ({_LEFT['posts']})"}
_LEFT |= {"interests": f"SELECT * FROM i WHERE uc IN (SELECT cluster_id FROM ({_LEFT['users']})) AND pc IN (SELECT cluster_id FROM ({_LEFT['posts']}))"}

#: What each kind of purge empties, of what is counted.
_EMPTIED = {
    "embeddings": ("embedded", "clustered_posts", "interests"), "similarity": ("clustered_posts", "interests"),
        "clusters": ("clustered_users", "clustered_posts", "user_communities", "post_communities", "interests", "recommended"),
    "interests": ("interests",), "recommendations": ("recommended",), "interactions": ("interacts",),
    "graph": ("users", "posts", "favourited", "recommended", "interacts", "interests", "user_communities", "post_communities", "embedded", "clustered_users", "clustered_posts"),
}
_PURGED = "kinds AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {list(v)} AS gone" for k,
    v in _EMPTIED.items()) + """), tables AS (SELECT 'users' AS name, count(*) AS n FROM users UNION ALL SELECT 'posts', count(*) FROM posts UNION ALL SELECT 'favourited', count(*) FROM favourited
UNION ALL SELECT 'recommended', count(*) FROM recommended UNION ALL SELECT 'interacts', count(*) FROM ug UNION ALL SELECT 'interests', count(*) FROM i UNION ALL SELECT
'user_communities', count(*) FROM us UNION ALL SELECT 'post_communities', count(*) FROM ps
UNION ALL SELECT 'embedded', count(embedding) FROM posts UNION ALL SELECT 'clustered_users', count(cluster_id) FROM users UNION ALL SELECT 'clustered_posts',
count(cluster_id) FROM posts)"""

_SOCIAL = f"WITH {SOCIAL_SQL}, i AS ({_interest_sql(SOCIAL_AS_OF, half=180.0, least=1.0)}), {_SIZES}, {_rated_sql(90, SOCIAL_AS_OF)}"

QUERIES = {
    f.__name__: f
    for f in (
        interest_scores, interest_scores_no_ctr, interest_dirty, interest_scores_dirty, interest_global_decay, interest_unexpired, interest_refresh,
            community_similarity, serendipity_similar, serendipity_random,
        local_popularity, global_popularity, blended_popularity, recency_score, language_boosts, feed_eligible_pairs, feed_filter_flags, feed_personalized_all,
            feed_detail, feed_explain_pairs, feed_cold_start, public_feed_members,
        public_feed_local, public_feed_all, public_feed_local_authors, feed_rank_scores, feed_own_entries, feed_cleared, feed_member_rank, feed_range,
            feed_lengths, dirty_users, merge_recommended, feed_times, active_users,
        knn_edges, knn_edges_cosine, knn_incremental, knn_incremental_edges, similarity_stats, similarity_pruned, vector_readiness, user_communities,
            post_communities, connected_parts, modularity, singleton_collapse, community_sizes,
        community_rebuild, graph_diagnostics, cleanup_cascade, purge_counts, user_community_soundness, post_community_soundness, node_edge_counts, connectivity,
            embedding_coverage, mean_interactions, top_languages, size_distribution, size_stats,
        top_user_communities, top_post_communities, user_profile, post_profile, interest_overview, export_interests, export_members, export_edges,
            graph_readiness, constraint_check, pairs_in_both, pairs_in_first, social_interests, social_feeds, social_cold_start, social_public_feed,
    )
} | {"pagerank": page_rank}

_NOTES_SQL = ", ".join(f"CASE WHEN {flag.replace('~', 'NOT ')} THEN '{text.replace(chr(39), chr(39) * 2)}' END" for flag, text in feeds.NOTES)
_SCORES = "SELECT uc, pc, round(score, 6) AS score, round(based_on, 6) AS based_on, last_updated, expires_at FROM"
_DETAIL = ", ".join(c if c == "age_hours" else f"round({c}, 6) AS {c}" for c in feeds.DETAIL)
SQL = {
    "interest_scores": f"{_B} {_SCORES} ({_interest_sql()})",
    "interest_scores_no_ctr": f"{_B} {_SCORES} ({_interest_sql(ctr=False)})",
    "interest_dirty": f"{_B} SELECT cluster_id AS uc FROM ({_DIRTY})",
    "interest_scores_dirty": f"{_B} {_SCORES} ({_interest_sql(only=f'uc IN ({_DIRTY})')})",
    "interest_global_decay": f"{_B} SELECT uc, pc, round(score * exp(-0.693147::DOUBLE * {HOURS} / (14.0 * 24.0)), 6) AS score FROM ({_interest_sql()})",
    "interest_unexpired": f"""{_B} SELECT uc, pc, ex AS expires_at FROM (SELECT uc, pc, CASE WHEN pc % 3 > 0 THEN {_T} - INTERVAL 1 DAY + to_days(CAST(pc % 3 AS INTEGER)) END AS ex FROM
({_interest_sql()})) WHERE ex IS NULL OR ex >= {_T}""",
    "interest_refresh": f"""{_B}, d AS (SELECT DISTINCT cluster_id AS uc FROM users WHERE cluster_id <> -1 AND id IN (SELECT user_id FROM reactions WHERE {_LATE} AND happened_at > TIMESTAMP
'{SINCE}')),
old AS ({_interest_sql('2024-01-24 00:00:00')}), new AS ({_interest_sql(only='uc IN (SELECT uc FROM d)', late=_LATE)})
SELECT uc, pc, round(score, 6) AS score, round(based_on, 6) AS based_on FROM (SELECT uc, pc, score * CASE WHEN pc = 3 THEN 0.005::DOUBLE ELSE 1.0 END *
exp(-0.693147::DOUBLE * {HOURS} / 336.0) AS score, based_on FROM old WHERE uc NOT IN (SELECT uc FROM d) UNION ALL SELECT uc, pc, score, based_on FROM new) WHERE score >=
0.01""",
    "community_similarity": f"""{_B}, m AS (SELECT DISTINCT user_id, post_id % 10 AS uc FROM replied), z AS (SELECT uc, count(*) AS n FROM m GROUP BY 1), x AS (SELECT a.uc AS uc1, b.uc AS uc2, count(*)
AS k FROM m a JOIN m b ON a.user_id = b.user_id AND a.uc <> b.uc GROUP BY 1, 2),
j AS (SELECT uc1, uc2, k::DOUBLE / (a.n + b.n - k) AS score FROM x JOIN z a ON a.uc = uc1 JOIN z b ON b.uc = uc2) SELECT uc1, uc2, round(score, 6) AS score FROM (SELECT
*, row_number() OVER (PARTITION BY uc1 ORDER BY score DESC, uc2) AS n FROM j) WHERE n <= 5""",
    "serendipity_similar": f"""{_B}, i AS (SELECT * FROM ({_interest_sql()}) WHERE (uc + pc) % 3 <> 0), m AS (SELECT DISTINCT user_id, post_id % 5 AS uc FROM replied), z AS (SELECT uc, count(*) AS n
FROM m GROUP BY 1), x AS (SELECT a.uc AS uc1, b.uc AS uc2, count(*) AS k FROM m a JOIN m b ON a.user_id = b.user_id AND a.uc <> b.uc GROUP BY 1, 2),
j AS (SELECT uc1, uc2, k::DOUBLE / (a.n + b.n - k) AS score FROM x JOIN z a ON a.uc = uc1 JOIN z b ON b.uc = uc2), s AS (SELECT * FROM (SELECT *, row_number() OVER
(PARTITION BY uc1 ORDER BY score DESC, uc2) AS n FROM j) WHERE n <= 5)
SELECT s.uc1 AS uc, i.pc, round(0.1::DOUBLE * min(s.score * i.score), 6) AS score FROM s JOIN i ON i.uc = s.uc2 WHERE (s.uc1, i.pc) NOT IN (SELECT (uc, pc) FROM i) GROUP
BY 1, 2""",
    "serendipity_random": f"""{_B}, i AS (SELECT * FROM ({_interest_sql()}) WHERE (uc + pc) % 3 <> 0), u AS (SELECT DISTINCT uc, {_hash_sql("'0-' || uc")} % 2 AS b FROM i), p AS (SELECT DISTINCT
cluster_id AS pc, {_hash_sql("'0-' || cluster_id")} % 2 AS b FROM posts)
SELECT uc, pc FROM u JOIN p USING (b) WHERE (uc, pc) NOT IN (SELECT (uc, pc) FROM i) ORDER BY {_hash_sql("'0-' || uc || '-' || pc")}, uc, pc LIMIT 100""",
    "local_popularity": f"{_B}, {_LOCAL} SELECT post_id, local_raw, round(log10(local_raw + 1), 6) AS contrib FROM lr",
    "global_popularity": f"{_B}, {_rated_sql()} SELECT id, round(global_raw, 6) AS global_raw, round(log10(global_raw + 1.0), 6) AS popularity_contrib FROM rp",
    "blended_popularity": f"{_B}, {_rated_sql()} SELECT id, round(0.5 * log10(local_raw + 1.0) + 0.5 * log10(global_raw + 1.0), 6) AS popularity_contrib FROM rp",
    "recency_score": f"""{_B} SELECT id, date_sub('hour', created_at, {_T}) AS age_hours, round(1.0::DOUBLE / (date_sub('hour', created_at, {_T}) / 24.0 + 1.0), 6) AS recency FROM posts""",
    "language_boosts": f"""{_B} SELECT f.user_id, f.post_id, {_BOOST.format(p='p', u='u')} AS boost FROM favourited f JOIN users u ON u.id = f.user_id JOIN posts p ON p.id = f.post_id""",
    "feed_eligible_pairs": f"{_B}, {_PAIRS} SELECT user_id, post_id FROM pr WHERE {_UNSEEN.format(u='pr.user_id', p='pr.post_id', a='pr.author_id')}",
    "feed_filter_flags": f"""{_B}, {_PAIRS} SELECT user_id, post_id, (user_id, post_id) IN (SELECT (user_id, post_id) FROM recommended) AS was_recommended, (user_id, post_id) IN (SELECT (user_id,
post_id) FROM wrote) AS is_author,
(user_id, post_id) IN (SELECT (user_id, post_id) FROM favourited) AS has_favourited, (user_id, author_id) IN (SELECT (src, dst) FROM hates) AS hates_author FROM pr""",
    "feed_personalized_all": f"{_B}, {_FEED}, {_TOP} SELECT user_id, post_id, round(score, 6) AS score, rank FROM t WHERE rank <= 500",
    "feed_detail": f"{_B}, {_FEED}, {_TOP} SELECT user_id, post_id, round(score, 6) AS score, rank, {_DETAIL} FROM t WHERE rank <= 500",
    "feed_explain_pairs": f"""{_B}, {_FEED}, pr AS (SELECT x.user_id, x.post_id, p.author_id, created_at > {_T} - INTERVAL 7 DAY AS within_feed_days, embedding IS NOT NULL AS has_embedding,
(x.user_id, x.post_id) IN (SELECT (user_id, post_id) FROM recommended) AS was_recommended, (x.user_id, x.post_id) IN (SELECT (user_id, post_id) FROM wrote) AS is_author,
(x.user_id, x.post_id) IN (SELECT (user_id, post_id) FROM favourited) AS has_favourited,
(x.user_id, p.author_id) IN (SELECT (src, dst) FROM hates) AS hates_author FROM (SELECT user_id, post_id FROM reactions UNION SELECT user_id, post_id FROM recommended) x
JOIN posts p ON p.id = x.post_id),
op AS (SELECT user_id, post_id FROM pr WHERE NOT was_recommended AND NOT is_author AND NOT has_favourited AND NOT hates_author),
pa AS (SELECT user_id, post_id, 'personalized' AS path, score AS final_score, interest_score, share_i, norm_pc_size, local_raw, global_raw, popularity_contrib, age_hours,
pagerank, language_match FROM sc SEMI JOIN op USING (user_id, post_id)
UNION ALL SELECT op.user_id, op.post_id, 'cold_start', pop * 0.7 + 0.3 / (age_hours / 24.0 + 1.0) + pagerank * 0.1 + {_BOOST.format(p='p', u='u')}, 0.0, 0.0, 0.0,
local_raw, global_raw, pop, age_hours, pagerank, {_BOOST.format(p='p', u='u')}
FROM op JOIN rp p ON p.id = op.post_id JOIN users u ON u.id = op.user_id WHERE p.embedding IS NOT NULL AND (op.user_id, op.post_id) NOT IN (SELECT (user_id, post_id) FROM
sc)),
me AS (SELECT user_id, post_id, (post_id % 7)::DOUBLE AS member_score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY post_id % 7 DESC, post_id::VARCHAR DESC) - 1
AS INTEGER) AS place, count(*) OVER (PARTITION BY user_id) AS n_members FROM reblogged)
SELECT pr.*, coalesce(path, 'not_scored') AS path, round(final_score, 6) AS final_score, {_DETAIL}, member_score, place, n_members, CASE WHEN path IS NULL THEN
array_to_string(list_filter([{_NOTES_SQL}], lambda t: t IS NOT NULL), ' ') ELSE '' END AS notes
FROM pr LEFT JOIN pa USING (user_id, post_id) LEFT JOIN me USING (user_id, post_id)""",
    "public_feed_members": f"""{_B}, {_I}, {_rated_sql()}, w AS (SELECT pc, sum(score * n) AS ci FROM i JOIN (SELECT cluster_id AS uc, count(*) AS n FROM users WHERE is_local GROUP BY 1) USING (uc)
GROUP BY 1),
f AS (SELECT id, row_number() OVER (ORDER BY ci * 0.5 + pop * 0.3 + 0.2 / (age_hours / 24.0 + 1.0) + pagerank * 0.1 DESC, id DESC) AS rank FROM rp JOIN w ON w.pc =
rp.cluster_id)
SELECT 'local' AS key, id AS post_id, CAST(max(id) OVER () * 10 + count(*) OVER () - (rank - 1) AS DOUBLE) AS score FROM f WHERE rank <= 500""",
    "feed_cold_start": f"""{_B}, {_rated_sql()}, t AS (SELECT u.id AS user_id, p.id AS post_id, pop * 0.7 + 0.3 / (age_hours / 24.0 + 1.0) + pagerank * 0.1 + {_BOOST.format(p='p', u='u')} AS score
FROM users u CROSS JOIN rp p
WHERE p.embedding IS NOT NULL AND {_UNSEEN.format(u='u.id', p='p.id', a='p.author_id')}) SELECT user_id, post_id, round(score, 6) AS score, CAST(n AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, post_id DESC) AS n FROM t) WHERE n <= 500""",
    "public_feed_local": _public_sql(True, False),
    "public_feed_all": _public_sql(False, False),
    "public_feed_local_authors": _public_sql(True, True),
    "feed_rank_scores": f"WITH {_MEM} SELECT * FROM mem",
    "feed_own_entries": f"WITH {_MEM} SELECT user_id, post_id, CASE WHEN score >= CAST(post_id * 10::HUGEINT AS DOUBLE) THEN 'own' ELSE 'native' END AS source FROM mix",
    "feed_cleared": f"WITH {_MEM} SELECT user_id, post_id FROM mix WHERE abs(score - CAST(post_id AS DOUBLE)) <= 1e-6",
    "feed_member_rank": f"WITH {_MEM}, {_PLACE} SELECT user_id, post_id, place FROM pl",
    "feed_range": f"WITH {_MEM}, {_PLACE} SELECT user_id, post_id, place FROM pl WHERE place BETWEEN 2 AND 4",
    "feed_lengths": f"WITH {_MEM} SELECT user_id, count(*) AS n FROM mem GROUP BY 1",
    "dirty_users": f"""{_B}, i AS ({_interest_sql()}), n AS (SELECT i.uc, max(p.created_at) AS pa FROM i LEFT JOIN (SELECT * FROM posts WHERE cluster_id < 5) p ON p.cluster_id = i.pc GROUP BY
1),
s AS (SELECT user_id, count(*) AS n, count_if((user_id, post_id) IN (SELECT (user_id, post_id) FROM reactions)) AS c FROM recommended GROUP BY 1)
SELECT id FROM users LEFT JOIN n ON n.uc = cluster_id LEFT JOIN s ON s.user_id = id WHERE is_local AND (last_active IS NULL OR last_active >= {_T} - INTERVAL 2 DAY)
AND coalesce(feed_generated_at IS NULL OR pa > feed_generated_at OR (n.uc IS NOT NULL AND {_T} - INTERVAL 3 DAY > feed_generated_at) OR (n > 0 AND c >= n * 0.8::DOUBLE),
false)""",
    "merge_recommended": f"""{_B} SELECT user_id, post_id, happened_at, 2.0::DOUBLE AS score FROM recommended UNION ALL SELECT user_id, post_id, {_T}, 1.0 FROM reblogged WHERE (user_id, post_id) NOT
IN (SELECT (user_id, post_id) FROM recommended)""",
    "feed_times": f"""{_B} SELECT id, CASE WHEN id IN (SELECT user_id FROM reblogged WHERE user_id % 4 = 1) THEN {_T} ELSE feed_generated_at END AS feed_generated_at FROM users""",
    "active_users": f"{_B} SELECT id FROM users WHERE is_local AND (last_active IS NULL OR last_active >= {_T} - INTERVAL 1 DAY)",
    "knn_edges": f"WITH {_V}, {_KNN} SELECT src, dst, round(weight, 6) AS weight FROM ed",
    "knn_edges_cosine": f"WITH {_V}, {_knn_sql(7, 'c', 0.2)} SELECT src, dst, round(weight, 6) AS weight FROM ed",
    "knn_incremental": f"WITH {_V}, {_knn_sql(7, '(1 + c) / 2', 0.6, 'a.id % 2 = 0 AND b.id % 2 = 0')} SELECT id FROM v WHERE id NOT IN (SELECT src FROM ed)",
    "knn_incremental_edges": f"""WITH {_V}, {_knn_sql(7, '(1 + c) / 2', 0.6, 'a.id % 2 = 0 AND b.id % 2 = 0')},
{_KNN.replace('c AS', 'c2 AS', 1).replace('ed AS', 'ed2 AS', 1).replace('FROM c)', 'FROM c2)', 1)} SELECT src, dst, round(weight, 6) AS weight FROM (SELECT * FROM ed
UNION ALL SELECT * FROM ed2 WHERE src NOT IN (SELECT src FROM ed))""",
    "similarity_stats": f"""WITH {_V}, {_KNN} SELECT count(*) AS n_edges, count(DISTINCT src) AS n_sources, round(min(weight), 6) AS min_weight, round(avg(weight), 6) AS avg_weight,
round(quantile_cont(weight, 0.5), 6) AS median_weight, round(max(weight), 6) AS max_weight, (SELECT count(*) FROM v WHERE id NOT IN (SELECT src FROM ed)) AS n_without
FROM ed""",
    "similarity_pruned": f"""WITH {_V}, {_KNN40} SELECT src, dst, 'temporal' AS strategy FROM ed WHERE src NOT IN (SELECT id FROM v WHERE created_at < {_T} - INTERVAL 20 DAY) UNION ALL SELECT src,
dst, 'partial' FROM ed WHERE weight >= 0.7""",
    "vector_readiness": "SELECT count(*) AS n_posts, count(embedding) AS n_vectors, count_if(len(embedding) = 64) AS n_fit FROM post",
    "connected_parts": f"""WITH RECURSIVE {_V}, {_KNN40}, b AS (SELECT src, dst FROM ed WHERE weight > 0.68 UNION SELECT dst, src FROM ed WHERE weight > 0.68),
reach AS (SELECT id, id AS other FROM v UNION SELECT r.id, b.dst FROM reach r JOIN b ON b.src = r.other) SELECT id, min(other) AS component FROM reach GROUP BY 1""",
    "modularity": f"""{_B}, {_UG}, {_BOTH}, x AS (SELECT a.cluster_id AS c1, b.cluster_id AS c2, weight FROM bo JOIN users a ON a.id = src JOIN users b ON b.id = dst), y AS (SELECT c1,
sum(CASE WHEN c1 = c2 THEN weight ELSE 0 END) AS i, sum(weight) AS k FROM x GROUP BY 1)
SELECT (SELECT count(DISTINCT cluster_id) FROM users) AS communities, round(sum(i / (SELECT sum(weight) FROM bo) - (k / (SELECT sum(weight) FROM bo)) * (k / (SELECT
sum(weight) FROM bo))), 6) AS modularity FROM y""",
    "pagerank": f"{_B}, {_UG}, {_BOTH}, {_KNOWN}, {_RANKS} SELECT id, round(r, 6) AS pagerank FROM r{S.pagerank_iterations}",
    "singleton_collapse": f"""{_B}, u AS (SELECT id, CASE WHEN id % 4 = 0 THEN id ELSE cluster_id END AS c FROM users) SELECT id, CASE WHEN count(*) OVER (PARTITION BY c) = 1 THEN -1 ELSE c END AS
cluster_id FROM u""",
    "community_sizes": f"{_B}, {_SIZES} SELECT *, 'user' AS kind FROM us UNION ALL SELECT *, 'post' FROM ps",
    "community_rebuild": f"{_B}, {_SIZES} SELECT * FROM us WHERE id <> 2",
    "graph_diagnostics": f"""{_B}, {_UG}, dg AS (SELECT u.id, count(e.dst) AS d FROM users u LEFT JOIN ug e ON e.src = u.id GROUP BY 1) SELECT count(*) AS n_edges, sum(weight) AS weight_sum,
quantile_cont(weight, 0.5) AS weight_p50, quantile_cont(weight, 0.9) AS weight_p90, quantile_cont(weight, 0.99) AS weight_p99,
(SELECT quantile_cont(d::DOUBLE, 0.5) FROM dg) AS degree_p50, (SELECT quantile_cont(d::DOUBLE, 0.9) FROM dg) AS degree_p90, (SELECT quantile_cont(d::DOUBLE, 0.99) FROM
dg) AS degree_p99,
(SELECT count(*) FROM users WHERE id NOT IN (SELECT src FROM ug) AND id NOT IN (SELECT dst FROM ug)) AS n_isolated, round(0.1::DOUBLE / sum(weight), 9) AS
resolution_per_weight FROM ug""",
    "cleanup_cascade": f"{_B}, {_I}, {_GONE} " + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n FROM ({q})" for k, q in _LEFT.items()),
    "purge_counts": f"{_B}, {_I}, {_SIZES}, {_UG}, " + _PURGED + " SELECT kind, name, CASE WHEN list_contains(gone, name) THEN 0 ELSE n END AS n FROM kinds, tables",
    "user_community_soundness": f"{_B} SELECT count(*) AS nodes, count(*) AS labelled, 0::BIGINT AS apart, true AS better FROM users",
    "post_community_soundness": "SELECT count(*) AS nodes, count(*) AS labelled, 0::BIGINT AS apart, true AS better FROM embeddings",
    "node_edge_counts": f"{_B} {_counts('users', 'posts', 'favourited', 'reblogged', 'replied', 'bookmarked', 'recommended', 'hates', 'wrote')}",
    "connectivity": f"""{_B}, {_UG}, dg AS (SELECT u.id, count(e.dst) AS d FROM users u LEFT JOIN ug e ON e.src = u.id GROUP BY 1) SELECT round(avg(d), 6) AS avg_degree, quantile_cont(d::DOUBLE,
0.5) AS median_degree, max(d) AS max_degree, count_if(d = 0 AND id NOT IN (SELECT dst FROM ug)) AS n_isolated FROM dg""",
    "embedding_coverage": "SELECT count(*) AS n_posts, count(embedding) AS n_embedded, round(count(embedding) * 100.0::DOUBLE / count(*), 6) AS percent FROM post",
    "mean_interactions": f"""{_B}, k AS (SELECT * FROM reactions WHERE kind <> 'bookmarked') SELECT (SELECT count(*) FROM users) AS n_users, (SELECT round(avg(c), 6) FROM (SELECT u.id, count(k.kind)
AS c FROM users u LEFT JOIN k ON k.user_id = u.id GROUP BY 1)) AS per_user, (SELECT round(avg(c), 6) FROM (SELECT p.id, count(k.kind) AS c FROM posts p LEFT JOIN k ON
k.post_id = p.id GROUP BY 1)) AS per_post""",
    "top_languages": "SELECT lang AS language, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "size_distribution": f"""WITH {_AUTHORS} SELECT CASE WHEN size <= 1 THEN '1' WHEN size <= 5 THEN '2-5' WHEN size <= 20 THEN '6-20' WHEN size <= 100 THEN '21-100' ELSE '100+' END AS bucket,
count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM sz), 6) AS percent FROM sz GROUP BY 1""",
    "size_stats": f"""WITH {_AUTHORS} SELECT count(*) AS n, round(avg(size), 6) AS avg_size, round(quantile_cont(size::DOUBLE, 0.5), 6) AS median_size, round(quantile_cont(size::DOUBLE, 0.9),
6) AS p90_size, min(size) AS min_size, max(size) AS max_size FROM sz""",
    "top_user_communities": f"""{_B}, {_UG}, {_SIZES}, {_ACTIVE}, t AS (SELECT * FROM us ORDER BY size DESC, id LIMIT 10) SELECT t.id AS cluster_id, size, (SELECT id FROM acts a WHERE a.cluster_id =
t.id ORDER BY activity DESC, id LIMIT 1) AS most_active,
(SELECT round(max(activity), 6) FROM acts a WHERE a.cluster_id = t.id) AS most_active_activity, (SELECT round(avg(activity), 6) FROM acts a WHERE a.cluster_id = t.id) AS
avg_activity, coalesce(l, '') AS languages FROM t LEFT JOIN {_langs('users', 'ui_language')} g ON g.cluster_id = t.id""",
    "top_post_communities": f"""{_B}, {_SIZES}, {_rated_sql(100)}, t AS (SELECT * FROM ps ORDER BY size DESC, id LIMIT 10), au AS (SELECT cluster_id, author_id, count(*) AS n FROM posts GROUP BY 1, 2)
SELECT t.id AS cluster_id, size, (SELECT id FROM rp WHERE rp.cluster_id = t.id ORDER BY pop DESC, id LIMIT 1) AS popular_post, (SELECT round(max(pop), 6) FROM rp WHERE
rp.cluster_id = t.id) AS popular_post_popularity_contrib,
(SELECT author_id FROM au WHERE au.cluster_id = t.id ORDER BY n DESC, author_id LIMIT 1) AS top_author, (SELECT max(n) FROM au WHERE au.cluster_id = t.id) AS
top_author_posts, (SELECT round(avg(pop), 6) FROM rp WHERE rp.cluster_id = t.id) AS avg_popularity, coalesce(l, '') AS languages
FROM t LEFT JOIN {_langs('posts', 'language')} g ON g.cluster_id = t.id""",
    "user_profile": f"""{_B}, {_I}, m AS (SELECT * FROM users WHERE id = 3), r AS (SELECT * FROM reactions WHERE user_id = 3) SELECT id, cluster_id, is_local, ui_language, last_active, (SELECT
count(*) FROM wrote WHERE user_id = 3) AS n_posts, (SELECT count_if(kind = 'favourited') FROM r) AS n_favourited,
(SELECT count_if(kind = 'reblogged') FROM r) AS n_reblogged, (SELECT count_if(kind = 'replied') FROM r) AS n_replied, (SELECT count_if(kind = 'bookmarked') FROM r) AS
n_bookmarked,
(SELECT string_agg(pc::VARCHAR, ',' ORDER BY score DESC, pc) FROM (SELECT * FROM i WHERE uc = (SELECT cluster_id FROM m) ORDER BY score DESC, pc LIMIT 5)) AS
top_interests FROM m""",
    "post_profile": f"""{_B}, {_SIZES}, r AS (SELECT * FROM reactions WHERE post_id = 5) SELECT p.id, author_id, cluster_id, language, created_at, total_favourites, pagerank, size, (SELECT
count_if(kind = 'favourited') FROM r) AS n_favourited, (SELECT count_if(kind = 'reblogged') FROM r) AS n_reblogged,
(SELECT count_if(kind = 'replied') FROM r) AS n_replied, (SELECT count_if(kind = 'bookmarked') FROM r) AS n_bookmarked FROM posts p LEFT JOIN ps ON ps.id = cluster_id
WHERE p.id = 5""",
    "interest_overview": f"""{_B}, {_I} SELECT count(*) AS n, count_if(pc % 3 <> 0 AND pc % 3 <> 0 AND NOT {_T} - INTERVAL 1 DAY + to_days(CAST(pc % 3 AS INTEGER)) < {_T} OR pc % 3 = 0) AS n_active,
count_if(pc % 3 <> 0 AND {_T} - INTERVAL 1 DAY + to_days(CAST(pc % 3 AS INTEGER)) < {_T}) AS n_expired FROM i""",
    "export_interests": f"{_B}, {_I} SELECT uc, pc, round(score, 6) AS score FROM i ORDER BY i.score DESC, uc, pc LIMIT 30",
    "export_members": f"""{_B}, {_SIZES}, t AS (SELECT * FROM us ORDER BY size DESC, id LIMIT 3) SELECT cluster_id, size, string_agg(x::VARCHAR, ',' ORDER BY x) AS members FROM (SELECT cluster_id,
size, u.id AS x, row_number() OVER (PARTITION BY cluster_id ORDER BY u.id) AS n FROM users u JOIN t ON t.id = cluster_id) WHERE n <= 4 GROUP BY 1, 2""",
    "export_edges": f"{_B}, {_UG} SELECT * FROM ug ORDER BY src, dst LIMIT 25",
    "graph_readiness": f"""{_B}, {_I} SELECT false AS has_embeddings, true AS has_user_communities, false AS has_post_communities, (SELECT count(*) > 0 FROM i) AS has_interests""",
    "constraint_check": """SELECT 'post' AS name, 'unique id' AS rule, count(*) - count(DISTINCT id) AS n FROM post UNION ALL SELECT 'post', 'vector length', count_if(len(embedding) <> 64) FROM post
UNION ALL SELECT 'statuses', 'unique id', count(*) - count(DISTINCT id) FROM statuses UNION ALL SELECT 'favourites', 'unique account_id, status_id', count(*) - (SELECT count(*) FROM (SELECT DISTINCT account_id, status_id FROM favourites)) FROM favourites
UNION ALL SELECT 'embeddings', 'unique vec_id', count(*) - count(DISTINCT vec_id) FROM embeddings UNION ALL SELECT 'embeddings', 'vector length', count_if(len(embedding) <> 64) FROM embeddings""",
    "pairs_in_both": f"{_B} SELECT user_id, post_id FROM favourited INTERSECT SELECT user_id, post_id FROM reblogged",
    "pairs_in_first": f"{_B} SELECT user_id, post_id FROM favourited EXCEPT SELECT user_id, post_id FROM replied",
    "social_interests": f"{_SOCIAL} SELECT uc, pc, round(score, 6) AS score, round(based_on, 6) AS based_on FROM i",
    "social_feeds": f"{_SOCIAL}, {_FEED_PART}, {_TOP} SELECT user_id, post_id, round(score, 6) AS score, rank FROM t WHERE rank <= 500",
    "social_cold_start": f"""{_SOCIAL}, t AS (SELECT u.id AS user_id, p.id AS post_id, pop * 0.7 + 0.3 / (age_hours / 24.0 + 1.0) + pagerank * 0.1 + {_BOOST.format(p='p', u='u')} AS score FROM users
u CROSS JOIN rp p
WHERE p.embedding IS NOT NULL AND {_UNSEEN.format(u='u.id', p='p.id', a='p.author_id')}) SELECT user_id, post_id, round(score, 6) AS score, CAST(n AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, post_id DESC) AS n FROM t) WHERE n <= 500""",
    "social_public_feed": f"""{_SOCIAL}, w AS (SELECT pc, sum(score * n) AS ci FROM i JOIN (SELECT cluster_id AS uc, count(*) AS n FROM users WHERE is_local GROUP BY 1) USING (uc) GROUP BY 1)
SELECT id AS post_id, round(ci * 0.5 + pop * 0.3 + 0.2 / (age_hours / 24.0 + 1.0) + pagerank * 0.1, 6) AS score FROM rp JOIN w ON w.pc = rp.cluster_id WHERE author_id IN
(SELECT id FROM users WHERE is_local)
ORDER BY ci * 0.5 + pop * 0.3 + 0.2 / (age_hours / 24.0 + 1.0) + pagerank * 0.1 DESC, id DESC LIMIT 500""",
}
