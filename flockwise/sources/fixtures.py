"""Stand-in graphs for tests and queries: the events table as a small graph with every kind of edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockwise.session import checkpoint_dir
from flockwise.sources.tables import accounts_newest, favourites_newest, statuses_newest, table

#: The time that every query of this graph is asked at.
AS_OF = "2024-01-31 00:00:00"
KINDS = {"favourited": "click", "reblogged": "purchase", "replied": "signup", "recommended": "view"}


def event_edges(spark: SparkSession, directory: str) -> DataFrame:
    """(event_id, user_id, post_id, kind, happened_at) of all events; the post is the number in their properties."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, directory, "events").select("event_id", "user_id", k.alias("post_id"), F.col("event_type").alias("kind"), F.col("ts").alias("happened_at"))


def event_graph(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """Users, posts, edges of each kind (first one per pair), rejections and authorship.

    The events' properties are parsed once and written to the checkpoint folder, where all tables read them.
    """
    checkpoint_dir(spark)
    e = event_edges(spark, directory).checkpoint()
    languages = F.array(*[F.lit(c) for c in ("en", "de", "es", "fr")])
    u = e.groupBy(F.col("user_id").alias("id")).agg(F.max("happened_at").alias("last_active"))
    users = u.select(
        "id", (F.col("id") % 5).alias("cluster_id"), (F.col("id") % 2 == 0).alias("is_local"), "last_active",
        F.when(F.col("id") % 5 != 0, F.get(languages, (F.col("id") % 4).cast("int"))).alias("ui_language"),
        F.when(F.col("id") % 3 == 0, F.array(F.get(languages, ((F.col("id") + 1) % 4).cast("int")), F.lit("pt"))).alias("languages"),
        F.when(F.col("id") % 3 != 0, F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval((F.col("id") % 6).cast("int"))).alias("feed_generated_at"),
    )
    p = e.groupBy(F.col("post_id").alias("id")).agg(F.count("*").alias("n"))
    v = table(spark, directory, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    posts = p.join(v, "id", "left").select(
        "id", (F.col("id") % 7).alias("author_id"), (F.col("id") % 10).alias("cluster_id"),
            F.when(F.col("id") % 7 != 0, F.get(languages, (F.col("id") % 4).cast("int"))).alias("language"),
        (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), (F.col("id") * 5 + 1).cast("int"))).alias("created_at"),
        (F.col("n") * 3).alias("total_favourites"), F.col("n").alias("total_reblogs"), F.when(F.col("id") % 4 != 0, F.col("n") % 11).alias("total_replies"),
            (F.col("id") / 1000.0).alias("pagerank"), "embedding",
    )

    def first(kind: str) -> DataFrame:
        return e.where(F.col("kind") == kind).groupBy("user_id", "post_id").agg(F.min("happened_at").alias("happened_at"))

    graph = {name: first(kind) for name, kind in KINDS.items()}
    graph["bookmarked"] = first("click").where((F.col("user_id") + F.col("post_id")) % 3 == 0)
    # all kinds at once, from one pass over the events; a click may also be a bookmark
    name = F.create_map(*[F.lit(x) for n, k in KINDS.items() for x in (k, n)])
    firsts = e.where(F.col("kind").isin(*KINDS.values())).groupBy("user_id", "post_id", "kind").agg(F.min("happened_at").alias("happened_at"))
    marked = (F.col("kind") == "click") & ((F.col("user_id") + F.col("post_id")) % 3 == 0)
    kinds = F.when(marked, F.array(F.lit("favourited"), F.lit("bookmarked"))).otherwise(F.array(name[F.col("kind")]))
    graph["edges"] = firsts.select("user_id", "post_id", "happened_at", F.explode(kinds).alias("kind"))
    graph["hates"] = e.where(F.col("kind") == "error").select(F.col("user_id").alias("src"), (F.col("post_id") % 7).alias("dst")).where("src <> dst").distinct()
    graph["wrote"] = posts.select(F.col("author_id").alias("user_id"), F.col("id").alias("post_id"))
    return {"users": users, "posts": posts, **graph}


def reactions_of(graph: dict[str, DataFrame]) -> DataFrame:
    """(user_id, post_id, happened_at, kind) of the four kinds of reaction."""
    return graph["edges"].where(F.col("kind") != "recommended")


#: The time that queries of the social graph are asked at.
SOCIAL_AS_OF = "2026-06-01 00:00:00"


def social_graph(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The relational tables as a graph: accounts, posts with their clusters, favourites, reblogs, replies, recommendations.

    Communities of accounts are id % 20, every third favourite counts as a bookmark too, and the author of every
    eleventh reply rejects whom it answers.
    """
    statuses, favourites = statuses_newest(spark, directory), favourites_newest(spark, directory)
    languages = F.array(*[F.lit(c) for c in ("en", "de", "fr", "es")])
    n = F.col("id")
    users = accounts_newest(spark, directory).select(
        "id", (n % 20).alias("cluster_id"), F.col("domain").isNull().alias("is_local"), F.when(n % 5 != 0, F.get(languages, (n % 4).cast("int"))).alias("ui_language"),
        F.when(n % 3 == 0, F.array(F.get(languages, ((n + 1) % 4).cast("int")), F.lit("pt"))).alias("languages"),
    )
    columns = ("author_id", "language", "cluster_id", "created_at", "total_favourites", "total_reblogs", "total_replies", "pagerank", "embedding")
    posts = table(spark, directory, "post").groupBy("id").agg(*[F.max(c).alias(c) for c in columns])
    known = posts.select(F.col("id").alias("post_id"))

    def first(rows: DataFrame, target: str) -> DataFrame:
        pairs = rows.where(F.col(target).isNotNull()).groupBy(F.col("account_id").alias("user_id"), F.col(target).alias("post_id")).agg(F.min("created_at").alias("happened_at"))
        return pairs.join(known, "post_id", "left_semi").select("user_id", "post_id", "happened_at")

    graph = {"favourited": first(favourites, "status_id"), "reblogged": first(statuses, "reblog_of_id"), "replied": first(statuses, "in_reply_to_id")}
    graph["bookmarked"] = graph["favourited"].where((F.col("user_id") + F.col("post_id")) % 3 == 0)
    shown = table(spark, directory, "recommendation_detail").where("viewer_user_id IS NOT NULL AND post_id IS NOT NULL").groupBy(F.col("viewer_user_id").alias("user_id"), "post_id").agg(F.max("post_created_at").alias("happened_at"))
    graph["recommended"] = shown.join(known, "post_id", "left_semi").select("user_id", "post_id", "happened_at")
    graph["hates"] = statuses.where("id % 11 = 0 AND in_reply_to_account_id <> account_id").select(F.col("account_id").alias("src"),
        F.col("in_reply_to_account_id").alias("dst")).distinct()
    graph["wrote"] = posts.select(F.col("author_id").alias("user_id"), F.col("id").alias("post_id"))
    return {"users": users, "posts": posts, **graph}


#: The same graph as common table expressions.
EVENT_SQL = f"""
e AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS post_id, event_type AS kind, ts AS happened_at FROM events),
users AS (SELECT id, id % 5 AS cluster_id, id % 2 = 0 AS is_local, last_active,
    CASE WHEN id % 5 <> 0 THEN (['en','de','es','fr'])[id % 4 + 1] END AS ui_language,
    CASE WHEN id % 3 = 0 THEN [(['en','de','es','fr'])[(id + 1) % 4 + 1], 'pt'] END AS languages,
    CASE WHEN id % 3 <> 0 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(id % 6 AS INTEGER)) END AS feed_generated_at
    FROM (SELECT user_id AS id, max(happened_at) AS last_active FROM e GROUP BY 1)),
posts AS (SELECT p.id, p.id % 7 AS author_id, p.id % 10 AS cluster_id,
    CASE WHEN p.id % 7 <> 0 THEN (['en','de','es','fr'])[p.id % 4 + 1] END AS language,
    TIMESTAMP '{AS_OF}' - to_hours(p.id * 5 + 1) AS created_at, n * 3 AS total_favourites, n AS total_reblogs,
    CASE WHEN p.id % 4 <> 0 THEN n % 11 END AS total_replies, p.id / 1000.0::DOUBLE AS pagerank, embedding
    FROM (SELECT post_id AS id, count(*) AS n FROM e GROUP BY 1) p LEFT JOIN embeddings v ON v.vec_id = p.id),
firsts AS (SELECT user_id, post_id, kind, min(happened_at) AS happened_at FROM e GROUP BY ALL),
favourited AS (SELECT user_id, post_id, happened_at FROM firsts WHERE kind = 'click'),
reblogged AS (SELECT user_id, post_id, happened_at FROM firsts WHERE kind = 'purchase'),
replied AS (SELECT user_id, post_id, happened_at FROM firsts WHERE kind = 'signup'),
recommended AS (SELECT user_id, post_id, happened_at FROM firsts WHERE kind = 'view'),
bookmarked AS (SELECT * FROM favourited WHERE (user_id + post_id) % 3 = 0),
hates AS (SELECT DISTINCT user_id AS src, post_id % 7 AS dst FROM e WHERE kind = 'error' AND user_id <> post_id % 7),
wrote AS (SELECT author_id AS user_id, id AS post_id FROM posts),
reactions AS (SELECT *, 'favourited' AS kind FROM favourited UNION ALL SELECT *, 'reblogged' FROM reblogged
    UNION ALL SELECT *, 'replied' FROM replied UNION ALL SELECT *, 'bookmarked' FROM bookmarked)"""

#: The newest rows of the relational tables.
TABLE_SQL = """
st AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM statuses) WHERE rn = 1),
fv AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM favourites) WHERE rn = 1),
ac AS (SELECT * EXCLUDE rn REPLACE (lower(trim(domain)) AS domain) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, username DESC, domain DESC) AS rn FROM accounts) WHERE rn = 1)"""

#: The social graph as common table expressions, after those of the newest rows.
SOCIAL_SQL = f"""{TABLE_SQL},
users AS (SELECT id, id % 20 AS cluster_id, domain IS NULL AS is_local, CASE WHEN id % 5 <> 0 THEN (['en','de','fr','es'])[id % 4 + 1] END AS ui_language,
    CASE WHEN id % 3 = 0 THEN [(['en','de','fr','es'])[(id + 1) % 4 + 1], 'pt'] END AS languages FROM ac),
posts AS (SELECT id, max(author_id) AS author_id, max(language) AS language, max(cluster_id) AS cluster_id, max(created_at) AS created_at, max(total_favourites) AS total_favourites,
    max(total_reblogs) AS total_reblogs, max(total_replies) AS total_replies, max(pagerank) AS pagerank, max(embedding) AS embedding FROM post GROUP BY id),
favourited AS (SELECT account_id AS user_id, status_id AS post_id, min(created_at) AS happened_at FROM fv WHERE status_id IN (SELECT id FROM posts) GROUP BY 1, 2),
reblogged AS (SELECT account_id AS user_id, reblog_of_id AS post_id, min(created_at) AS happened_at FROM st WHERE reblog_of_id IN (SELECT id FROM posts) GROUP BY 1, 2),
replied AS (SELECT account_id AS user_id, in_reply_to_id AS post_id, min(created_at) AS happened_at FROM st WHERE in_reply_to_id IN (SELECT id FROM posts) GROUP BY 1, 2),
bookmarked AS (SELECT * FROM favourited WHERE (user_id + post_id) % 3 = 0),
recommended AS (SELECT viewer_user_id AS user_id, post_id, max(post_created_at) AS happened_at FROM recommendation_detail WHERE viewer_user_id IS NOT NULL AND post_id IN (SELECT id FROM posts) GROUP BY 1, 2),
hates AS (SELECT DISTINCT account_id AS src, in_reply_to_account_id AS dst FROM st WHERE id % 11 = 0 AND in_reply_to_account_id <> account_id),
wrote AS (SELECT author_id AS user_id, id AS post_id FROM posts),
reactions AS (SELECT *, 'favourited' AS kind FROM favourited UNION ALL SELECT *, 'reblogged' FROM reblogged
    UNION ALL SELECT *, 'replied' FROM replied UNION ALL SELECT *, 'bookmarked' FROM bookmarked)"""
