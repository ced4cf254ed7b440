"""Statistics of the graph, and profiles of single users and posts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flockwise.operators.interests import REACTIONS


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(k).alias("name"), F.count("*").alias("n")) for k, df in tables.items()])


def connectivity(users: DataFrame, interacts: DataFrame) -> DataFrame:
    """Mean, median and largest out-degree, users without any interaction; one row, zeros when empty."""
    out = interacts.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    into = interacts.select(F.col("dst").alias("id")).distinct().withColumn("_i", F.lit(1))
    rows = users.select("id").join(out, "id", "left").join(into, "id", "left").select(F.coalesce("d", F.lit(0)).alias("d"), F.col("_i"))
    return rows.agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("avg_degree"), F.coalesce(F.percentile("d", 0.5), F.lit(0.0)).alias("median_degree"),
        F.coalesce(F.max("d"), F.lit(0)).alias("max_degree"), F.count_if((F.col("d") == 0) & F.col("_i").isNull()).alias("n_isolated"))


def embedding_coverage(posts: DataFrame) -> DataFrame:
    """Posts, posts with a vector and their percentage; one row."""
    n, e = F.count("*"), F.count("embedding")
    return posts.agg(n.alias("n_posts"), e.alias("n_embedded"), F.when(n > 0, e * 100.0 / n).otherwise(F.lit(0.0)).alias("percent"))


def mean_interactions(users: DataFrame, posts: DataFrame, reactions: DataFrame) -> DataFrame:
    """Mean favourites, reblogs and replies per user and per post; bookmarks don't count; one row."""
    rows = reactions.where(F.col("kind").isin(*REACTIONS[:3]))
    per = lambda nodes, key: nodes.select(F.col("id").alias(key)).join(rows.groupBy(key).agg(F.count("*").alias("c")), key,
        "left").agg(F.coalesce(F.avg(F.coalesce("c", F.lit(0))), F.lit(0.0)).alias("v")).scalar()
    return users.agg(F.count("*").alias("n_users")).select("n_users", per(users, "user_id").alias("per_user"), per(posts, "post_id").alias("per_post"))


def top_languages(posts: DataFrame, limit: int) -> DataFrame:
    """The most frequent languages, ties by code."""
    return posts.where(F.col("language").isNotNull()).groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(limit)


BUCKETS = ((1, "1"), (5, "2-5"), (20, "6-20"), (100, "21-100"))


def size_bucket(size: Column) -> Column:
    """The class of a community's size."""
    out = F.when(size <= BUCKETS[0][0], BUCKETS[0][1])
    for top, name in BUCKETS[1:]:
        out = out.when(size <= top, name)
    return out.otherwise("100+")


def size_distribution(sizes: DataFrame) -> DataFrame:
    """(bucket, n, percent) of community sizes."""
    per = sizes.groupBy(size_bucket(F.col("size")).alias("bucket")).agg(F.count("*").alias("n"))
    return per.withColumn("percent", F.col("n") * 100.0 / sizes.agg(F.count("*").alias("n")).scalar())


def size_stats(sizes: DataFrame) -> DataFrame:
    """Number, mean, median, percentiles and extremes of community sizes; one row."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return sizes.agg(F.count("*").alias("n"), z(F.avg("size")).alias("avg_size"), z(F.percentile("size", 0.5)).alias("median_size"),
        z(F.percentile("size", 0.9)).alias("p90_size"), F.coalesce(F.min("size"), F.lit(0)).alias("min_size"), F.coalesce(F.max("size"), F.lit(0)).alias("max_size"))


def largest(sizes: DataFrame, limit: int) -> DataFrame:
    """The largest communities, ties by id."""
    return sizes.orderBy(F.desc("size"), "id").limit(limit)


def _first(rows: DataFrame, key: str, by: str, name: str) -> DataFrame:
    """(key, name): of each group the id with the largest `by`, ties to the smallest id; one row per task and group is shuffled."""
    return rows.groupBy(key).agg(F.max(F.struct(by, (-F.col("id")).alias("o"))).alias("_m")).select(key, (-F.col("_m.o")).alias(name), F.col(f"_m.{by}").alias(f"{name}_{by}"))


def top_values(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, top): arrays of the k most frequent values of each group, ties by value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))
    return counts.withColumn("_r", rank).where(F.col("_r") <= k).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", value))), lambda x: x[value]).alias("top"))


def user_activity_scores(users: DataFrame, interacts: DataFrame, reactions: DataFrame) -> DataFrame:
    """(id, cluster_id, activity): weight of interactions plus number of reactions."""
    w = interacts.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("w"))
    r = reactions.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("r"))
    joined = users.select("id", "cluster_id", "ui_language").join(w, "id", "left").join(r, "id", "left")
    return joined.select("id", "cluster_id", "ui_language", (F.coalesce("w", F.lit(0.0)) + F.coalesce("r", F.lit(0))).alias("activity"))


def top_user_communities(users: DataFrame, sizes: DataFrame, interacts: DataFrame, reactions: DataFrame, limit: int = 10) -> DataFrame:
    """The largest user communities with their most active member, mean activity and up to three languages."""
    scores = user_activity_scores(users, interacts, reactions).join(largest(sizes, limit).select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    means = scores.groupBy("cluster_id").agg(F.avg("activity").alias("avg_activity"))
    out = largest(sizes, limit).withColumnRenamed("id", "cluster_id").join(_first(scores, "cluster_id", "activity", "most_active"), "cluster_id").join(means, "cluster_id")
    tops = top_values(scores, "cluster_id", "ui_language", 3)
    return out.join(tops, "cluster_id", "left").select("cluster_id", "size", "most_active", "most_active_activity", "avg_activity",
        F.array_join(F.coalesce("top", F.array().cast("array<string>")), ",").alias("languages"))


def top_post_communities(posts: DataFrame, sizes: DataFrame, rated: DataFrame, limit: int = 10) -> DataFrame:
    """The largest post communities with their most popular post, most productive author, mean popularity and languages.

    `rated` has (id, popularity_contrib).
    """
    rows = posts.join(largest(sizes, limit).select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").join(rated.select("id", "popularity_contrib"), "id")
    authors = rows.groupBy("cluster_id", F.col("author_id").alias("id")).agg(F.count("*").alias("posts"))
    means = rows.groupBy("cluster_id").agg(F.avg("popularity_contrib").alias("avg_popularity"))
    out = largest(sizes, limit).withColumnRenamed("id", "cluster_id").join(_first(rows, "cluster_id", "popularity_contrib", "popular_post"), "cluster_id")
    out = out.join(_first(authors, "cluster_id", "posts", "top_author"), "cluster_id").join(means,
        "cluster_id").join(top_values(rows, "cluster_id", "language", 3), "cluster_id", "left")
    return out.select("cluster_id", "size", "popular_post", "popular_post_popularity_contrib", "top_author", "top_author_posts", "avg_popularity",
        F.array_join(F.coalesce("top", F.array().cast("array<string>")), ",").alias("languages"))


def user_profile(users: DataFrame, user_id: int, wrote: DataFrame, reactions: DataFrame, interests: DataFrame) -> DataFrame:
    """One user: community, posts, reactions by kind, and the communities of most interest."""
    me = users.where(F.col("id") == user_id).select("id", "cluster_id", "is_local", "ui_language", "last_active")
    mine = reactions.where(F.col("user_id") == user_id)
    counts = mine.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in REACTIONS])
    posts = wrote.where(F.col("user_id") == user_id).agg(F.count("*").alias("n")).scalar()
    wants = interests.join(me.select(F.col("cluster_id").alias("uc")), "uc", "left_semi").orderBy(F.desc("score"), "pc").limit(5)
    top = wants.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "pc"))), lambda x: x["pc"].cast("string")),
        ",").alias("top")).scalar()
    return me.select("*", posts.alias("n_posts"), *[counts.select(c).scalar().alias(c) for c in counts.columns], top.alias("top_interests"))


def post_profile(posts: DataFrame, post_id: int, reactions: DataFrame, sizes: DataFrame) -> DataFrame:
    """One post: community and its size, counters and reactions by kind."""
    me = posts.where(F.col("id") == post_id).select("id", "author_id", "cluster_id", "language", "created_at", "total_favourites", "pagerank")
    counts = reactions.where(F.col("post_id") == post_id).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in REACTIONS])
    sized = me.join(sizes.select(F.col("id").alias("cluster_id"), "size"), "cluster_id", "left")
    return sized.select(*me.columns, "size", *[counts.select(c).scalar().alias(c) for c in counts.columns])


def feed_top_posts(members: DataFrame, posts: DataFrame, user_id: int, limit: int = 5) -> DataFrame:
    """(place, post_id, score, source, preview) of the first members of a user's feed."""
    from flockwise.functions.scalar import preview
    from flockwise.operators.feeds import entry_source, member_range
    from flockwise.settings import Settings

    mine = member_range(members.where(F.col("user_id") == user_id), 0, limit - 1)
    text = posts.select(F.col("id").alias("post_id"), (preview(F.col("text"), 60) if "text" in posts.columns else F.lit("")).alias("preview"))
    return mine.join(text, "post_id", "left").select("place", "post_id", "score", entry_source(Settings()).alias("source"), "preview").orderBy("place")


def feed_shares(members: DataFrame, multiplier: int) -> DataFrame:
    """(user_id, n, own, native) of each feed: how many members this engine wrote."""
    mine = F.lit(multiplier > 1) & (F.col("score") >= F.col("post_id") * multiplier)
    return members.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(mine).alias("own"), F.count_if(~mine).alias("native"))


def interest_overview(interests: DataFrame, as_of: Column) -> DataFrame:
    """Interests, and how many of them are running or over; one row."""
    over = F.col("expires_at") < as_of
    return interests.agg(F.count("*").alias("n"), F.count_if(F.coalesce(~over, F.lit(True))).alias("n_active"), F.count_if(over).alias("n_expired"))


def top_interests(interests: DataFrame, limit: int = 30) -> DataFrame:
    """The strongest interests, ties by ids."""
    return interests.select("uc", "pc", "score").orderBy(F.desc("score"), "uc", "pc").limit(limit)


def member_samples(nodes: DataFrame, sizes: DataFrame, communities: int, members: int) -> DataFrame:
    """(cluster_id, size, members): the smallest member ids of the largest communities."""
    top = largest(sizes, communities).withColumnRenamed("id", "cluster_id")
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("id"))
    rows = nodes.join(top, "cluster_id").withColumn("_r", rank).where(F.col("_r") <= members)
    return rows.groupBy("cluster_id", "size").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("members"))


def edge_sample(edges: DataFrame, limit: int) -> DataFrame:
    """The first edges by ids, the same on every run."""
    return edges.select("src", "dst", "weight").orderBy("src", "dst").limit(limit)


def readiness(posts: DataFrame, users: DataFrame, interests: DataFrame) -> DataFrame:
    """Whether there are vectors, communities and interests; reads one row of each where it can."""
    has = lambda df: df.limit(1).agg((F.count("*") > 0).alias("v")).scalar()
    return posts.sparkSession.range(1).select(
        has(posts.where(F.col("embedding").isNotNull())).alias("has_embeddings"), has(users.where(F.col("cluster_id").isNotNull())).alias("has_user_communities"),
        has(posts.where(F.col("cluster_id").isNotNull())).alias("has_post_communities"), has(interests).alias("has_interests"),
    )


def constraint_violations(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]], dims: int) -> DataFrame:
    """(name, rule, n): rows beyond the first of a key, and vectors of another length, of each table.

    What a database keeps by unique constraints and a vector index of fixed length is checked here, as merges already
    keep it; nothing else needs an index.
    """
    found = []
    for name, key in keys.items():
        df = tables[name]
        many = df.groupBy(*key).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))
        found.append(many.select(F.lit(name).alias("name"), F.lit("unique " + ", ".join(key)).alias("rule"), "n"))
        if "embedding" in df.columns:
            found.append(df.agg(F.count_if(F.size("embedding") != dims).alias("n")).select(F.lit(name).alias("name"), F.lit("vector length").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, found)


def in_both(a: DataFrame, b: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Distinct rows of the columns that both tables have."""
    return a.select(*columns).intersect(b.select(*columns))


def only_in_first(a: DataFrame, b: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Distinct rows of the columns that only the first table has."""
    return a.select(*columns).subtract(b.select(*columns))


def health(user_communities: int, posts: int, warnings: int) -> str:
    """'FAILED' without user communities, 'DEGRADED' with warnings or without posts, else 'HEALTHY'."""
    if not user_communities:
        return "FAILED"
    return "DEGRADED" if warnings or not posts else "HEALTHY"
