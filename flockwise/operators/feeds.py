"""Feeds for all users at once: candidates, scores, ranks, and the members of delivered feeds.

The score of a post is the same for all readers of one community with the same languages. So posts are ranked for these
classes of readers, and a reader takes the first places of its class that it hasn't seen. No reader meets a post that
can't be in its feed, and a post meets only classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flockwise.functions.aggregates import top_k
from flockwise.functions.scalar import days_before, language_boost, popularity, recency, whole_hours
from flockwise.settings import Settings


def local_counts(posts: DataFrame, reactions: DataFrame, s: Settings) -> DataFrame:
    """(post_id, local_raw): weighted number of each kind of reaction; posts without any have 0.

    `reactions` is (user_id, post_id, kind); counted before the join, so a popular post costs one row.
    """
    weights = {"favourited": s.likes_weight, "reblogged": s.reblogs_weight, "replied": s.replies_weight, "bookmarked": s.bookmarks_weight}
    weight = F.lit(0.0)
    for kind, w in weights.items():
        weight = F.when(F.col("kind") == kind, F.lit(float(w))).otherwise(weight)
    sums = reactions.groupBy("post_id").agg(F.sum(weight).alias("_w"))
    return posts.select(F.col("id").alias("post_id")).join(sums, "post_id", "left").select("post_id", F.coalesce("_w", F.lit(0.0)).alias("local_raw"))


def global_count(s: Settings) -> Column:
    """Weighted counters of a post."""
    zero = F.lit(0)
    return F.coalesce("total_favourites", zero) * F.lit(s.global_favourites_weight) + F.coalesce("total_reblogs",
        zero) * F.lit(s.global_reblogs_weight) + F.coalesce("total_replies", zero) * F.lit(s.global_replies_weight)


def rated_posts(posts: DataFrame, reactions: DataFrame, as_of: Column, s: Settings) -> DataFrame:
    """Recent posts with everything about them that doesn't depend on the reader."""
    recent = posts.where(F.col("created_at") > days_before(as_of, s.feed_days))
    rows = recent.join(local_counts(recent, reactions, s), F.col("id") == F.col("post_id")).drop("post_id")
    rows = rows.withColumn("global_raw", global_count(s)).withColumn("popularity_contrib", popularity(F.col("local_raw"), F.col("global_raw"), s))
    return rows.withColumn("age_hours", whole_hours(F.col("created_at"), as_of)).withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))


def unsuitable(pairs: DataFrame, wrote: DataFrame, favourited: DataFrame, recommended: DataFrame, hates: DataFrame) -> DataFrame:
    """`pairs` without what the reader wrote, liked or was shown, or whose author the reader rejects."""
    key = ["user_id", "post_id"]
    out = pairs
    for seen in (recommended, wrote, favourited):
        out = out.join(seen.select(*key), key, "left_anti")
    disliked = hates.select(F.col("src").alias("user_id"), F.col("dst").alias("author_id"))
    return out.join(disliked, ["user_id", "author_id"], "left_anti")


def filter_flags(pairs: DataFrame, wrote: DataFrame, favourited: DataFrame, recommended: DataFrame, hates: DataFrame) -> DataFrame:
    """The same conditions as flags of each pair."""
    key = ["user_id", "post_id"]
    out = pairs
    for name, seen in (("was_recommended", recommended), ("is_author", wrote), ("has_favourited", favourited)):
        out = out.join(seen.select(*key).distinct().withColumn(name, F.lit(True)), key, "left")
    rejected = hates.select(F.col("src").alias("user_id"), F.col("dst").alias("author_id")).distinct().withColumn("hates_author", F.lit(True))
    out = out.join(rejected, ["user_id", "author_id"], "left")
    flags = ["was_recommended", "is_author", "has_favourited", "hates_author"]
    return out.select(*pairs.columns, *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])


def community_totals(interests: DataFrame, post_communities: DataFrame) -> DataFrame:
    """(uc, sum_i, max_pc_size) over all interests, noise and expired ones included."""
    sized = interests.join(post_communities.select(F.col("id").alias("pc"), "size"), "pc", "left")
    return sized.groupBy("uc").agg(F.sum("score").alias("sum_i"), F.max(F.coalesce("size", F.lit(0)).cast("double")).alias("max_pc_size"))


def _wants(interests: DataFrame, post_communities: DataFrame, s: Settings) -> DataFrame:
    """(uc, pc, interest_score, share_i, norm_pc_size): what the terms of a pair of communities are made of."""
    wants = interests.where(F.col("pc") != F.lit(s.noise_community)).select("uc", "pc", F.col("score").alias("interest_score"))
    wants = wants.join(community_totals(interests, post_communities), "uc").join(post_communities.select(F.col("id").alias("pc"), "size"), "pc", "left")
    share = F.when(F.col("sum_i") > 0, F.col("interest_score") / F.col("sum_i")).otherwise(F.lit(0.0))
    size = F.when(F.col("max_pc_size") > 0, F.coalesce("size", F.lit(0)).cast("double") / F.col("max_pc_size")).otherwise(F.lit(0.0))
    return wants.select("uc", "pc", "interest_score", share.alias("share_i"), size.alias("norm_pc_size"))


def _items(rated: DataFrame) -> DataFrame:
    return rated.select(F.col("id").alias("post_id"), "author_id", F.col("language").alias("post_language"), F.col("created_at").alias("post_created_at"),
        F.col("cluster_id").alias("pc"), "local_raw", "global_raw", "popularity_contrib", "age_hours", "pagerank")


def _readers(users: DataFrame, s: Settings) -> DataFrame:
    noise = F.lit(s.noise_community)
    return users.where(F.col("cluster_id").isNotNull() & (F.col("cluster_id") != noise)).select(F.col("id").alias("user_id"), F.col("cluster_id").alias("uc"),
        "ui_language", "languages")


def _score(s: Settings, base: Column) -> Column:
    """The whole score, summed in one order everywhere, so that equal terms give equal doubles."""
    return F.col("share_i") * s.share_weight + F.col("norm_pc_size") * s.size_weight + base + F.col("language_match")


def _post_terms(s: Settings) -> Column:
    return F.col("popularity_contrib") * s.popularity_weight + recency(F.col("age_hours"), s) * s.recency_weight + F.col("pagerank") * s.pagerank_weight


def personalised(users: DataFrame, rated: DataFrame, interests: DataFrame, post_communities: DataFrame, seen: dict[str, DataFrame], s: Settings) -> DataFrame:
    """Every suitable (user, post) with its score and all components, for a few users or posts (see `personal_feeds`).

    The path user - community - interest - post community - post.
    """
    pairs = _readers(users, s).join(_wants(interests, post_communities, s), "uc").join(_items(rated), "pc")
    rows = unsuitable(pairs, seen["wrote"], seen["favourited"], seen["recommended"], seen["hates"])
    rows = rows.withColumn("language_match", language_boost(F.col("post_language"), F.col("ui_language"), F.col("languages"), s))
    return rows.withColumn("score", _score(s, _post_terms(s)))


DETAIL = ("interest_score", "share_i", "norm_pc_size", "local_raw", "global_raw", "popularity_contrib", "age_hours", "pagerank", "language_match")


def top_of_users(scored: DataFrame, size: int, columns: tuple[str, ...] = ()) -> DataFrame:
    """The best posts of every user, by score and then id, both descending, with rank from 1."""
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("post_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("user_id", "post_id", "score", "rank", *columns)


#: Lists that posts are ranked in besides those of their languages: all posts, and those without a language.
ALL_POSTS, NO_LANGUAGE = "*", ""


def _best(rows: DataFrame, keys: list[str], by: str, k: int) -> DataFrame:
    """The k rows of each key with the largest (by, post_id), with `place` from 1; bounded heaps before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, by, "post_id")]
    heaps = rows.groupBy(*keys).agg(top_k(F.struct(by, "post_id", *rest), k).alias("_t"))
    return heaps.select(*keys, F.posexplode(F.sort_array("_t", asc=False)).alias("_p", "_e")).select(*keys, "_e.*", (F.col("_p") + 1).alias("place"))


def _listed(rows: DataFrame) -> DataFrame:
    """Posts once in the list of all and once in that of their language."""
    return rows.withColumn("list", F.explode(F.array(F.lit(ALL_POSTS), F.coalesce("post_language", F.lit(NO_LANGUAGE)))))


def _hidden(items: DataFrame, seen: dict[str, DataFrame]) -> DataFrame:
    """(user_id, post_id) of the items that a reader wrote, liked, was shown, or whose author it rejects."""
    disliked = seen["hates"].select(F.col("src").alias("user_id"), F.col("dst").alias("author_id")).join(items.select("author_id", "post_id"),
        "author_id").select("user_id", "post_id")
    known = [seen[k].select("user_id", "post_id") for k in ("recommended", "wrote", "favourited")]
    every = known[0].unionByName(known[1]).unionByName(known[2]).join(items.select("post_id"), "post_id", "left_semi").select("user_id", "post_id")
    return every.unionByName(disliked).distinct()


def _class_feeds(readers: DataFrame, ranked: DataFrame, hidden: DataFrame, size: int, most: int, s: Settings, columns: tuple[str, ...]) -> DataFrame:
    """The first `size` suitable posts of every reader.

    `readers` is (user_id, uc, ui_language, languages), `ranked` the best `most` posts by `base` of each list of each
    community, `most` at least `size` plus what any reader has hidden. A reader needs no place of its class beyond
    `size` plus what it has hidden itself. A class takes the posts of its languages and of none from their own lists
    and others from the list of all: what is among its best is among the best there.
    """
    need = readers.join(hidden.groupBy("user_id").agg(F.count("*").alias("_h")), "user_id", "left")
    languages = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("languages", F.array().cast("array<string>")))))
    need = need.select("user_id", "uc", "ui_language", languages.alias("languages"), (F.coalesce("_h", F.lit(0)) + size).alias("need"))
    need = need.withColumn("class", F.to_json(F.struct("uc", "ui_language", "languages")))
    classes = need.groupBy("class", "uc", "ui_language", "languages").agg(F.max("need").alias("need"))
    own = F.array_distinct(F.array_compact(F.concat(F.array(F.lit(NO_LANGUAGE), F.col("ui_language")), F.col("languages"))))
    none = F.col("ui_language").isNull() & (F.size("languages") == 0)
    wanted = classes.withColumn("_own", own).withColumn("list", F.explode(F.when(none, F.array(F.lit(ALL_POSTS))).otherwise(F.array_append("_own", F.lit(ALL_POSTS)))))
    met = wanted.join(ranked, ["uc", "list"])
    twice = (F.col("list") == ALL_POSTS) & ~none & F.array_contains("_own", F.coalesce("post_language", F.lit(NO_LANGUAGE)))
    met = met.where(~twice).withColumn("language_match", language_boost(F.col("post_language"), F.col("ui_language"), F.col("languages"), s))
    carried = [c for c in ("share_i", "norm_pc_size", *columns) if c in met.columns and c != "language_match"]
    scored = met.withColumn("score", _score(s, F.col("post_base")) if "share_i" in met.columns else F.col("post_base") + F.col("language_match"))
    best = _best(scored.select("class", "need", "post_id", "score", "language_match", *dict.fromkeys(carried)), ["class", "need"], "score",
        most).where(F.col("place") <= F.col("need")).drop("need")
    # readers meet their class by blocks of `size` places, so that a long need costs its reader only
    placed = best.withColumn("_b", F.floor((F.col("place") - 1) / size).cast("int"))
    asked = need.select("user_id", "class", "need", F.explode(F.sequence(F.lit(0), F.floor((F.col("need") - 1) / size).cast("int"))).alias("_b"))
    pairs = asked.join(placed, ["class", "_b"]).where(F.col("place") <= F.col("need")).join(hidden, ["user_id", "post_id"], "left_anti")
    return top_of_users(pairs, size, columns)


def _most(hidden: DataFrame, size: int) -> int:
    """`size` plus the largest number of hidden posts of a reader: one number comes to the driver."""
    return size + (hidden.groupBy("user_id").count().agg(F.max("count").alias("m")).first()["m"] or 0)


def personal_feeds(users: DataFrame, rated: DataFrame, interests: DataFrame, post_communities: DataFrame, seen: dict[str, DataFrame], s: Settings,
    size: int | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, post_id, score, rank, columns): the best suitable posts of every user, by score and then id.

    The same rows as the best of `personalised`. Posts are cut to the best of each community and language, then of
    each pair of communities, then of each class of readers, by bounded heaps, before readers come in.
    """
    size = s.feed_size if size is None else size
    items, readers, wants = _items(rated), _readers(users, s), _wants(interests, post_communities, s)
    hidden = _hidden(items, seen).join(readers.select("user_id"), "user_id", "left_semi")
    most = _most(hidden, size)
    listed = _best(_listed(items.withColumn("post_base", _post_terms(s))), ["pc", "list"], "post_base", most).drop("place")
    met = wants.join(listed, "pc").withColumn("language_match", F.lit(0.0))
    ranked = _best(met.withColumn("base", _score(s, F.col("post_base"))).drop("language_match"), ["uc", "list"], "base", most).drop("place")
    return _class_feeds(readers, ranked, hidden, size, most, s, columns)


def cold_start(users: DataFrame, rated: DataFrame, seen: dict[str, DataFrame], s: Settings) -> DataFrame:
    """(user_id, post_id, score, rank) for users without a personalised feed, from posts with an embedding."""
    size = min(s.feed_size, s.cold_start_limit)
    base = F.col("popularity_contrib") * s.cold_popularity_weight + recency(F.col("age_hours"), s) * s.cold_recency_weight + F.col("pagerank") * s.pagerank_weight
    items = rated.where(F.col("embedding").isNotNull()).select(F.col("id").alias("post_id"), "author_id", F.col("language").alias("post_language"),
        base.alias("post_base"), F.lit(0).alias("uc"))
    readers = users.select(F.col("id").alias("user_id"), F.lit(0).alias("uc"), "ui_language", "languages")
    hidden = _hidden(items, seen).join(readers.select("user_id"), "user_id", "left_semi")
    most = _most(hidden, size)
    ranked = _best(_listed(items), ["uc", "list"], "post_base", most).drop("place")
    return _class_feeds(readers, ranked, hidden, size, most, s, ())


#: Why a pair isn't scored, by flag.
NOTES = (
    ("~within_feed_days", "Post is older than the feed's days."), ("~has_embedding", "A cold start needs a vector."), ("was_recommended", "Shown before."),
    ("is_author", "Written by the reader."), ("has_favourited", "Favoured by the reader."), ("hates_author", "The reader rejects the author."),
)


def explain(pairs: DataFrame, users: DataFrame, posts: DataFrame, reactions: DataFrame, interests: DataFrame, post_communities: DataFrame,
    seen: dict[str, DataFrame], members: DataFrame, as_of: Column, s: Settings) -> DataFrame:
    """One row for each (user_id, post_id) of known users and posts: how the post comes to the user's feed, or why not.

    `path` is 'personalized', 'cold_start' or 'not_scored', by the rules of the feeds; the components are those of the
    path, null for none; `member_score`, `place` (from 0, best first) and `n_members` tell the delivered feed;
    `notes` says why a pair isn't scored. The pairs may be any table; each operator sees only their users and posts.
    """
    key = ["user_id", "post_id"]
    asked = pairs.select(*key).distinct().join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    asked = asked.join(posts.select(F.col("id").alias("post_id"), "author_id",
        (F.col("created_at") > days_before(as_of, s.feed_days)).alias("within_feed_days"), F.col("embedding").isNotNull().alias("has_embedding")), "post_id")
    flagged = filter_flags(asked, seen["wrote"], seen["favourited"], seen["recommended"], seen["hates"])
    here = users.join(asked.select(F.col("user_id").alias("id")), "id", "left_semi")
    rated = rated_posts(posts.join(asked.select(F.col("post_id").alias("id")), "id", "left_semi"), reactions, as_of, s)
    open_ = flagged.where("NOT was_recommended AND NOT is_author AND NOT has_favourited AND NOT hates_author").select(*key)
    items = open_.join(_items(rated), "post_id")
    wants = _wants(interests, post_communities, s)
    own = items.join(_readers(here, s), "user_id").join(wants, ["uc", "pc"])
    own = own.withColumn("language_match", language_boost(F.col("post_language"), F.col("ui_language"), F.col("languages"), s))
    own = own.select(*key, F.lit("personalized").alias("path"), _score(s, _post_terms(s)).alias("final_score"), *DETAIL)
    cold = items.join(rated.where(F.col("embedding").isNotNull()).select(F.col("id").alias("post_id")), "post_id", "left_semi").join(own.select(*key), key, "left_anti")
    cold = cold.join(here.select(F.col("id").alias("user_id"), "ui_language", "languages"), "user_id")
    cold = cold.withColumn("language_match", language_boost(F.col("post_language"), F.col("ui_language"), F.col("languages"), s))
    base = F.col("popularity_contrib") * s.cold_popularity_weight + recency(F.col("age_hours"), s) * s.cold_recency_weight + F.col("pagerank") * s.pagerank_weight
    nothing = [F.lit(0.0).alias(c) for c in DETAIL[:3]]
    cold = cold.select(*key, F.lit("cold_start").alias("path"), (base + F.col("language_match")).alias("final_score"), *nothing, *DETAIL[3:])
    mine = members.join(asked.select("user_id").distinct(), "user_id", "left_semi")
    placed = member_ranks(mine).join(feed_lengths(mine).withColumnRenamed("n", "n_members"), "user_id").select(*key, F.col("score").alias("member_score"), "place", "n_members")
    rows = flagged.join(own.unionByName(cold), key, "left").join(placed, key, "left").withColumn("path", F.coalesce("path", F.lit("not_scored")))
    said = F.array_compact(F.array(*[F.when((~F.col(flag[1:]) if flag[0] == "~" else F.col(flag)) & (F.col("path") == "not_scored"), F.lit(text)) for flag, text in NOTES]))
    return rows.withColumn("notes", F.array_join(said, " "))


def public_feed(users: DataFrame, rated: DataFrame, interests: DataFrame, s: Settings, local_interests: bool, local_authors: bool, size: int) -> DataFrame:
    """(post_id, score): the best posts for everybody.

    With `local_interests` a community counts once for each of its local users, else once. With `local_authors` only
    posts of local users come in.
    """
    noise = F.lit(s.noise_community)
    wants = interests.where((F.col("uc") != noise) & (F.col("pc") != noise)).select("uc", "pc", "score")
    if local_interests:
        local = users.where("is_local").groupBy(F.col("cluster_id").alias("uc")).agg(F.count("*").alias("n"))
        wants = wants.join(local, "uc").select("uc", "pc", (F.col("score") * F.col("n")).alias("score"))
    total = wants.groupBy("pc").agg(F.sum("score").alias("community_interest"))
    items = rated
    if local_authors:
        items = items.join(users.where("is_local").select(F.col("id").alias("author_id")), "author_id", "left_semi")
    rows = items.join(total, F.col("cluster_id") == F.col("pc"))
    score = F.col("community_interest") * (s.share_weight + s.size_weight) + F.col("popularity_contrib") * s.popularity_weight + recency(F.col("age_hours"),
        s) * s.recency_weight + F.col("pagerank") * s.pagerank_weight
    return rows.select(F.col("id").alias("post_id"), score.alias("score")).orderBy(F.desc("score"), F.desc("post_id")).limit(size)


def dirty_users(users: DataFrame, posts: DataFrame, interests: DataFrame, recommended: DataFrame, consumed: DataFrame, as_of: Column, s: Settings, share: float = 0.8) -> DataFrame:
    """Local, lately active users whose feed is out of date.

    Never served; or since then a new post in a community of interest, a newer interest, or most of what was
    recommended is consumed. Times are compared by their maxima, so a community costs one row.
    """
    mine = users.where(F.col("is_local") & (F.col("last_active").isNull() | (F.col("last_active") >= days_before(as_of, s.active_days))))
    newest = posts.groupBy(F.col("cluster_id").alias("pc")).agg(F.max("created_at").alias("post_at"))
    per = interests.join(newest, "pc", "left").groupBy("uc").agg(F.max("post_at").alias("post_at"), F.max("last_updated").alias("interest_at"))
    used = consumed.select("user_id", "post_id").distinct().withColumn("_c", F.lit(1))
    shown = recommended.select("user_id", "post_id").distinct().join(used, ["user_id", "post_id"], "left").groupBy("user_id").agg(F.count("*").alias("n"), F.count("_c").alias("c"))
    rows = mine.join(per, F.col("cluster_id") == F.col("uc"), "left").join(shown, F.col("id") == F.col("user_id"), "left")
    last = F.col("feed_generated_at")
    stale = last.isNull() | (F.col("post_at") > last) | (F.col("interest_at") > last) | ((F.col("n") > 0) & (F.col("c") >= F.col("n") * share))
    return rows.where(F.coalesce(stale, F.lit(False))).select("id")


def feed_members(feed: DataFrame, s: Settings) -> DataFrame:
    """(user_id, post_id, score): rank scores, (largest post id) * multiplier + (length - rank), rank from 0.

    The product is exact in decimal arithmetic before it becomes a double, as ids exceed what a double holds.
    """
    whole = Window.partitionBy("user_id")
    score = F.max("post_id").over(whole).cast("decimal(38,0)") * s.rank_multiplier + F.count("*").over(whole) - (F.col("rank") - 1)
    return feed.select("user_id", "post_id", score.cast("double").alias("score"))


def public_members(feed: DataFrame, key: str, s: Settings) -> DataFrame:
    """(key, post_id, score) of a public feed, which is bounded by its size: rank scores as in `feed_members`."""
    ranked = top_of_users(feed.select(F.lit(key).alias("user_id"), "post_id", "score"), s.feed_size)
    return feed_members(ranked, s).withColumnRenamed("user_id", "key")


def own_entry(s: Settings) -> Column:
    """Whether a member was written by this engine: its score exceeds the id by the multiplier."""
    return F.lit(s.rank_multiplier > 1) & (F.col("score") >= F.col("post_id") * s.rank_multiplier)


def entry_source(s: Settings) -> Column:
    """'own' or 'native'."""
    return F.when(own_entry(s), "own").otherwise("native")


def without_own_entries(members: DataFrame, s: Settings) -> DataFrame:
    """Members whose score is their id; nothing is removed if the multiplier is 1 or less."""
    if s.rank_multiplier <= 1:
        return members
    return members.where(F.abs(F.col("score") - F.col("post_id")) <= s.own_entry_tolerance)


def member_ranks(members: DataFrame) -> DataFrame:
    """Members with their place from 0, best first; equal scores by member as text, descending."""
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc(F.col("post_id").cast("string")))
    return members.withColumn("place", F.row_number().over(order) - 1)


def member_range(members: DataFrame, start: int, stop: int, best_first: bool = True) -> DataFrame:
    """Members of places start to stop, both included, of every feed."""
    last, text = ("score", F.col("post_id").cast("string"))
    keys = [F.desc(last), text.desc()] if best_first else [F.asc(last), text.asc()]
    ranked = members.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*keys)) - 1)
    return ranked.where(F.col("place").between(start, stop))


def member_score(members: DataFrame, user_id: int, post_id: int) -> DataFrame:
    """The score of one member, no row if it isn't there."""
    return members.where((F.col("user_id") == user_id) & (F.col("post_id") == post_id)).select("score")


def feed_lengths(members: DataFrame) -> DataFrame:
    """Number of members of each feed."""
    return members.groupBy("user_id").agg(F.count("*").alias("n"))
