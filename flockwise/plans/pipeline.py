"""The engine end to end: load, connect, cluster, score, serve, with versioned tables and one state file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flockwise.functions.scalar import days_before, moment
from flockwise.operators import communities, feeds, interests, knn, merge, stats
from flockwise.operators.export import as_json, markdown_table, mermaid_graph, report
from flockwise.operators.interactions import Cursors, interaction_edges, next_cursors
from flockwise.operators.leiden import leiden
from flockwise.operators.pagerank import pagerank
from flockwise.operators.text import added_phrases, hashed_embeddings, joined_phrases, pair_counts, scored_phrases, served_embeddings, to_embed_again, tokens, trained_embeddings, word2vec, word_counts
from flockwise.settings import Settings
from flockwise.sources import scans
from flockwise.sources.state import State, load_state, save_state
from flockwise.sources.tables import accounts_newest, favourites_newest, has_table, optional, statuses_newest

_EDGE = "user_id long, post_id long, happened_at timestamp_ntz"
_USER = "id long, last_active timestamp_ntz, is_local boolean, ui_language string, languages array<string>, feed_generated_at timestamp_ntz"
_POST = "id long, author_id long, text string, language string, created_at timestamp_ntz, embedding array<float>, total_favourites long, total_reblogs long, total_replies long"
#: Columns that are read of tables that may be missing.
SOURCES = {
    "bookmarks": "id long, account_id long, status_id long, created_at timestamp_ntz",
    "blocks": "id long, account_id long, target_account_id long", "mutes": "id long, account_id long, target_account_id long",
    "follows": "id long, account_id long, target_account_id long", "mentions": "id long, status_id long, account_id long, silent boolean",
    "account_stats": "account_id long, last_status_at timestamp_ntz", "users": "account_id long, current_sign_in_at timestamp_ntz, locale string, chosen_languages array<string>",
    "status_stats": "status_id long, favourites_count long, reblogs_count long, replies_count long, untrusted_favourites_count long, untrusted_reblogs_count long",
}
#: Tables of a version that a clean-up or a new embedding carries over.
KEPT = ("posts_loaded", "users_loaded", "users", "posts", "favourited", "reblogged", "replied", "bookmarked", "recommended", "hates", "interacts", "similar",
    "interests", "user_communities", "post_communities", "similar_communities", "feed_members", "public_members")


def _last(df: DataFrame, column: str = "id") -> int:
    return df.agg(F.max(column).alias("m")).first()["m"] or 0


@dataclass
class Engine:
    """Runs over a directory of source tables, with results under `root`.

    Every step writes its table to the version in work and reads it again, so a step that fails is repeated alone and
    no plan grows over the whole run. The state file is replaced last: until then the former version counts, so a run
    that is interrupted begins anew from it. Tables of SOURCES may be missing. Vectors come from `embed`, a function
    of texts, from the model in `model` (a version that `train` has written), or from hashed subwords; `tokenise` makes
    words of a text for the latter two.
    """

    spark: SparkSession
    source: str
    root: str
    settings: Settings = Settings()
    embed: Callable[[list[str]], list[list[float]]] | None = None
    embed_name: str = ""
    model: str = ""
    dims: int = 64
    tokenise: Callable[[Column], Column] = tokens

    def state(self) -> State:
        return load_state(self.spark, f"{self.root}/state.json")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={self.state().version if version is None else version}/{name}")

    def signature(self) -> str:
        """Changes when posts must be embedded again."""
        kind = f"served:{self.embed_name}" if self.embed else f"trained:{self.model}" if self.model else "local:hashed"
        return f"{kind}:{self.dims}"

    def embeddings(self, texts: DataFrame) -> DataFrame:
        """(id, embedding) of (id, text)."""
        if self.embed:
            return served_embeddings(texts, self.embed)
        words = texts.select("id", self.tokenise(F.col("text")).alias("tokens"))
        if self.model:
            from pyspark.ml.feature import Word2VecModel

            known = joined_phrases(words, self.spark.read.parquet(f"{self.model}/phrases"))
            return trained_embeddings(known, Word2VecModel.load(f"{self.model}/words"), self.dims)
        return hashed_embeddings(words, self.dims)

    def run(self, as_of: str, feeds_too: bool = True) -> State:
        """Full run as of a time: rows beyond the cursors are merged, then all analytics and the feeds due are made."""
        old, now, s = self.state(), moment(as_of), self.settings.validated()
        version = old.version + 1
        former = {"version": old.version}

        def keep(name: str, df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{self.root}/v={version}/{name}")
            return self.table(name, version)

        def before(name: str, like: str) -> DataFrame:
            return optional_version(self, name, like, former["version"])

        graph, cursors = self._load(old, now, s, keep, before)
        users, posts, edges = self._analysed(graph, old, now, s, keep, before)
        wants = self._interests(edges, users, posts, now, s, keep)
        self._feeds(users, posts, edges, wants, graph["hates"], now, s, keep, before, feeds_too)
        new = old.advanced(**cursors, last_rebuild_at=as_of, similarity_signature=s.similarity_signature(), embedding_signature=self.signature(), updated_at=as_of, version=version)
        save_state(self.spark, f"{self.root}/state.json", new)
        return new

    def _source(self, name: str) -> DataFrame:
        return optional(self.spark, self.source, name, SOURCES[name])

    def _load(self, old: State, now: Column, s: Settings, keep, before) -> tuple[dict[str, DataFrame], dict[str, int]]:
        """Posts, users, edges of every kind and who rejects whom, with the cursors reached."""
        spark = self.spark
        statuses, favourites, accounts = statuses_newest(spark, self.source), favourites_newest(spark, self.source), accounts_newest(spark, self.source)
        bookmarks, blocks, mutes, mentions, follows = (self._source(n) for n in ("bookmarks", "blocks", "mutes", "mentions", "follows"))
        # a time bound takes the place of cursors for what has times; statuses keep both
        days = s.since_days()
        since = None if days is None else days_before(now, days)
        cursor = lambda name: 0 if days is not None else getattr(old, name)
        fresh = scans.statuses_since(statuses, old.last_status_id, since)
        fit = scans.embeddable(fresh.select("id", "text"), s.min_embedding_chars, s.skip_shortest_share)
        vectors = self.embeddings(fit)
        nothing = [F.lit(None).cast("bigint").alias(c) for c in ("total_favourites", "total_reblogs", "total_replies")]
        incoming = fresh.join(vectors, "id").select("id", F.col("account_id").alias("author_id"), "text", "language", "created_at", "embedding", *nothing)
        known = before("posts_loaded", _POST)
        if old.version and old.embedding_signature != self.signature():
            known = known.drop("embedding").join(self.embeddings(known.select("id", "text")), "id", "left").select(*known.columns)
        posts = merge.merge_posts(known, incoming)
        posts = keep("posts_loaded", merge.merge_totals(posts, scans.status_totals(self._source("status_stats"), old.last_stats_status_id)))

        edges = {}
        for name, rows in (("favourited", scans.reactions_since(favourites, cursor("last_favourite_id"), since)),
            ("bookmarked", scans.reactions_since(bookmarks, cursor("last_bookmark_id"), since))):
            rows = rows.select("id", F.col("account_id").alias("user_id"), F.col("status_id").alias("post_id"), F.col("created_at").alias("happened_at"))
            edges[name] = keep(name, merge.merge_reactions(before(name, _EDGE), rows, posts))
        for name, column in (("reblogged", "reblog_of_id"), ("replied", "in_reply_to_id")):
            rows = fresh.where(F.col(column).isNotNull()).select("id", F.col("account_id").alias("user_id"), F.col(column).alias("post_id"),
                F.col("created_at").alias("happened_at"))
            edges[name] = keep(name, merge.merge_reactions(before(name, _EDGE), rows, posts))
        edges["recommended"] = before("recommended", f"{_EDGE}, score double")
        hates = keep("hates", merge.merge_aversions(before("hates", "src long, dst long"), scans.aversions_since(blocks, "block", old.last_block_id),
            scans.aversions_since(mutes, "mute", old.last_mute_id)))
        beyond = Cursors(old.last_interaction_favourite_id, old.last_interaction_status_id, old.last_mention_id, old.last_follow_id)
        more = keep("interactions_new", interaction_edges(favourites, statuses, mentions, follows, s, beyond, authors=statuses))
        interacts = keep("interacts", merge.merge_interactions(before("interacts", "src long, dst long, weight double"), more))

        # every author and everybody who reacts is a user; what the accounts tell of them comes with activity
        ids = posts.select(F.col("author_id").alias("id"))
        for df in edges.values():
            ids = ids.unionByName(df.select(F.col("user_id").alias("id")))
        people = merge.ensure_users(before("users_loaded", _USER), ids.unionByName(hates.select(F.col("src").alias("id"))))
        seen = self._source("account_stats")
        if not has_table(spark, self.source, "account_stats"):  # the same from the statuses
            seen = statuses.groupBy("account_id").agg(F.max("created_at").alias("last_status_at"))
        signed = self._source("users")
        if not has_table(spark, self.source, "users"):
            signed = favourites.groupBy("account_id").agg(F.max("created_at").alias("current_sign_in_at")).select("*",
                F.lit(None).cast("string").alias("locale"), F.lit(None).cast("array<string>").alias("chosen_languages"))
        users = keep("users_loaded", merge.merge_activity(people, scans.user_activity(accounts, seen, signed, now, s.active_days)))

        met = next_cursors(more).first()
        reached = {"last_status_id": _last(fresh), "last_favourite_id": _last(favourites), "last_bookmark_id": _last(bookmarks), "last_block_id": _last(blocks),
            "last_mute_id": _last(mutes)}
        reached |= {"last_interaction_favourite_id": met["max_favourite_id"], "last_interaction_status_id": met["max_status_id"],
            "last_mention_id": met["max_mention_id"], "last_follow_id": met["max_follow_id"]}
        reached |= {"last_stats_status_id": _last(self._source("status_stats"), "status_id"), "last_activity_account_id": _last(accounts)}
        return {"posts": posts, "users": users, "interacts": interacts, "hates": hates, **edges}, reached

    def _analysed(self, graph: dict[str, DataFrame], old: State, now: Column, s: Settings, keep, before) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
        """Users and posts with communities and ranks, from the graph of interactions and the nearest posts."""
        users, posts = graph["users"], graph["posts"]
        users = keep("users_clustered", communities.without_singletons(communities.with_labels(users, leiden(users, graph["interacts"], s)), s))
        keep("user_communities", communities.community_sizes(users))
        edge = "src long, dst long, weight double"
        signature = old.similarity_signature if old.version and old.embedding_signature == self.signature() else None
        similar = keep("similar_all", knn.updated_edges(posts, before("similar", edge), signature, now, s, self.dims))
        clustered = communities.without_singletons(communities.with_labels(posts, leiden(posts, similar, s)), s)
        ranks = pagerank(posts, similar, s) if s.pagerank_enabled else posts.select("id", F.lit(0.0).alias("pagerank"))
        posts = keep("posts", clustered.join(ranks, "id", "left"))
        keep("post_communities", communities.community_sizes(posts))
        keep("similar", knn.pruned(similar, posts, now, s))
        return users, posts, {k: graph[k] for k in (*interests.REACTIONS, "recommended")}

    def _interests(self, edges: dict[str, DataFrame], users: DataFrame, posts: DataFrame, now: Column, s: Settings, keep) -> DataFrame:
        """Interests with those of chance: from similar communities, or at random where these are off."""
        own = keep("interests_own", interests.rebuild_interests(edges, users, posts, now, s))
        near = keep("similar_communities", interests.similar_communities(communities.memberships(users, "user_id", "uc"), s))
        if s.community_similarity_enabled:
            more = interests.serendipity_by_similarity(near, own, s)
        else:
            other = posts.where(F.col("cluster_id").isNotNull() & (F.col("cluster_id") != s.noise_community)).select(F.col("cluster_id").alias("pc"))
            more = interests.serendipity_at_random(own, other, s).withColumn("score", F.lit(s.serendipity_score))
        more = more.select("uc", "pc", "score", F.lit(0.0).alias("based_on"), now.alias("last_updated"),
            days_before(now, -s.interest_ttl_days).alias("expires_at"), F.lit(True).alias("serendipity"))
        return keep("interests", own.withColumn("serendipity", F.lit(False)).unionByName(more))

    def _feeds(self, users: DataFrame, posts: DataFrame, edges: dict[str, DataFrame], wants: DataFrame, hates: DataFrame, now: Column, s: Settings, keep,
        before, feeds_too: bool) -> None:
        """Feeds of the users who are due, all in one job; the others keep theirs."""
        members = before("feed_members", "user_id long, post_id long, score double")
        if not feeds_too:
            keep("feed_members", members), keep("recommended", edges["recommended"]), keep("users", users), keep("public_members",
                before("public_members", "key string, post_id long, score double"))
            return
        sizes = communities.community_sizes(posts)
        hidden = {**edges, "wrote": posts.select(F.col("author_id").alias("user_id"), F.col("id").alias("post_id")), "hates": hates}
        reactions = interests.reaction_union({k: edges[k] for k in interests.REACTIONS})
        rated = keep("rated", feeds.rated_posts(posts, reactions, now, s))
        due = scans.active_users(users, now, s.active_days, True) if s.feed_force_refresh else feeds.dirty_users(users, posts, wants, edges["recommended"], reactions, now, s)
        local = keep("users_due", users.join(due, "id", "left_semi"))
        own = keep("feeds_personal", feeds.personal_feeds(local, rated, wants, sizes, hidden, s))
        cold = feeds.cold_start(local.join(own.select(F.col("user_id").alias("id")), "id", "left_anti"), rated, hidden, s)
        feed = keep("feeds", own.unionByName(cold))
        keep("feed_members", members.join(feed.select("user_id").distinct(), "user_id", "left_anti").unionByName(feeds.feed_members(feed, s)))
        keep("recommended", merge.mark_recommended(edges["recommended"], feed, now))
        served = keep("users", merge.set_feed_time(users, feed, now))
        keep("users_loaded", served.select(*[f.split()[0] for f in _USER.split(", ")]))
        public = self.spark.createDataFrame([], "key string, post_id long, score double")
        if s.public_feed_enabled:
            everybody = feeds.public_feed(users, rated, wants, s, s.public_feed_strategy == "local_communities", False, s.feed_size)
            nearby = feeds.public_feed(users, rated, wants, s, True, True, s.feed_size)
            public = feeds.public_members(everybody, s.public_timeline_key, s).unionByName(feeds.public_members(nearby, s.local_timeline_key, s))
        keep("public_members", public)

    def refresh(self, as_of: str, hours: float) -> DataFrame:
        """Interests brought up to date without clustering anew; a rebuild if there was no run yet."""
        old = self.state()
        if not old.last_rebuild_at:
            self.run(as_of)
            return self.table("interests")
        edges = {k: self.table(k) for k in (*interests.REACTIONS, "recommended")}
        return interests.refresh_interests(self.table("interests"), edges, self.table("users"), self.table("posts"), moment(old.last_rebuild_at), hours,
            moment(as_of), self.settings)

    def export(self, as_of: str, user_id: int | None = None) -> str:
        """A Markdown report of the state of the graph, with the feed of one user if asked for."""
        wants, users, posts = self.table("interests"), self.table("users"), self.table("posts")
        overview = stats.table_counts({n: self.table(n) for n in ("users", "posts", "favourited", "interests", "similar", "feed_members")})
        sections = {
            "Tables": markdown_table(overview.orderBy("name")), "Interests": markdown_table(stats.interest_overview(wants, moment(as_of))),
            "Strongest interests": mermaid_graph(stats.top_interests(wants), "uc", "pc", "score", ("U", "P")),
            "Members": markdown_table(stats.member_samples(users, self.table("user_communities"), 10, 5)),
                "Posts of communities": markdown_table(stats.member_samples(posts, self.table("post_communities"), 10, 5)),
            "Interactions": markdown_table(stats.edge_sample(self.table("interacts"), 30)), "Nearest posts": markdown_table(stats.edge_sample(self.table("similar"), 30)),
            "Interaction graph": markdown_table(as_json(communities.graph_diagnostics(users, self.table("interacts"), self.settings))),
            "Feeds": markdown_table(stats.feed_shares(self.table("feed_members"), self.settings.rank_multiplier).orderBy("user_id").limit(30)),
        }
        if user_id is not None:
            sections["Feed"] = markdown_table(stats.feed_top_posts(self.table("feed_members"), posts, user_id, 50))
        return report(f"State at {as_of}", sections)

    def _new_version(self, changed: dict[str, DataFrame], **to: object) -> State:
        """A version with some tables replaced and the others carried over."""
        old = self.state()
        for name in KEPT:
            (changed[name] if name in changed else self.table(name)).write.mode("overwrite").parquet(f"{self.root}/v={old.version + 1}/{name}")
        new = State(**{**old.__dict__, **to, "version": old.version + 1})
        save_state(self.spark, f"{self.root}/state.json", new)
        return new

    def clean(self, kind: str) -> State:
        """A new version without one kind of data and what depends on it (see `communities.PURGES`)."""
        changed = communities.purge({n: self.table(n) for n in KEPT if n not in ("posts_loaded", "users_loaded")}, kind)
        loaded, people = self.table("posts_loaded"), self.table("users_loaded")
        if kind == "embeddings":
            loaded = loaded.withColumn("embedding", F.lit(None).cast("array<float>"))
        if kind == "graph":
            changed |= {n: changed[n].where(F.lit(False)) for n in ("feed_members", "public_members", "similar_communities")}
            return self._new_version({**changed, "posts_loaded": loaded.where(F.lit(False)), "users_loaded": people.where(F.lit(False))},
                **{k: v for k, v in State().__dict__.items() if k.startswith("last_")})
        return self._new_version({**changed, "posts_loaded": loaded})

    def cleanup(self, as_of: str, days: int | None = None) -> State:
        """A new version without users seen longest ago and all that hangs on them, expired interests and pruned edges."""
        now, s = moment(as_of), self.settings
        known = {n: self.table(n) for n in KEPT if n not in ("posts_loaded", "users_loaded", "similar_communities", "public_members")}
        left = communities.cascade(known, communities.inactive(known["users"], now, s.active_days if days is None else days))
        left["interests"] = interests.unexpired(left["interests"], now)
        left["similar"] = knn.pruned(left["similar"], left["posts"], now, s)
        loaded = {"posts_loaded": self.table("posts_loaded").join(left["posts"].select("id"), "id", "left_semi"),
            "users_loaded": self.table("users_loaded").join(left["users"].select("id"), "id", "left_semi")}
        return self._new_version({**left, **loaded})

    def reindex(self) -> State:
        """A new version whose posts without a vector, or all if the model's signature has changed, are embedded again."""
        old = self.state()
        posts = self.table("posts_loaded")
        todo = to_embed_again(posts, old.embedding_signature or None, self.signature())
        vectors = self.embeddings(todo.select("id", "text")).withColumnRenamed("embedding", "_new")
        fresh = posts.join(vectors, "id", "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")
        return self._new_version({"posts_loaded": fresh}, embedding_signature=self.signature(), similarity_signature="")

    def train(self, model_dir: str, min_chars: int = 10, min_docs: int = 100, incremental: bool = True, **options: int) -> dict[str, object]:
        """Fits phrases and a word model on the public corpus as a new version `model_dir`/v=n; returns its extent.

        An incremental training counts only texts beyond the former version's last one and adds that version's counts;
        the word model is fitted on the whole corpus, as it can't be continued. A served version is never changed.
        """
        old = load_state(self.spark, f"{model_dir}/state.json")
        incremental = incremental and old.version > 0
        texts = scans.corpus(statuses_newest(self.spark, self.source), min_chars)
        place = f"{model_dir}/v={old.version + 1}"
        more = scans.corpus_tokens(texts.where(F.col("id") > old.last_status_id) if incremental else texts)
        counts = {"pairs": pair_counts(more), "words": word_counts(more)}
        if incremental:
            kept = f"{model_dir}/v={old.version}"
            counts["pairs"] = added_phrases(self.spark.read.parquet(f"{kept}/pair_counts"), counts["pairs"])
            counts["words"] = self.spark.read.parquet(f"{kept}/word_counts").unionByName(counts["words"]).groupBy("w").agg(F.sum("c").alias("c"))
        for name, df in counts.items():
            df.write.mode("overwrite").parquet(f"{place}/{name[:-1]}_counts")
        pairs, words = (self.spark.read.parquet(f"{place}/{n}_counts") for n in ("pair", "word"))
        scored_phrases(pairs, words).write.mode("overwrite").parquet(f"{place}/phrases")
        # tokens and phrases are made once and read in every pass of the training
        joined_phrases(scans.corpus_tokens(texts), self.spark.read.parquet(f"{place}/phrases")).write.mode("overwrite").parquet(f"{place}/corpus")
        joined = self.spark.read.parquet(f"{place}/corpus")
        word2vec(joined, min_docs=min_docs, **options).write().overwrite().save(f"{place}/words")
        extent = scans.corpus_extent(texts).first().asDict()
        save_state(self.spark, f"{model_dir}/state.json", old.advanced(version=old.version + 1, last_status_id=extent["max_id"] or 0))
        return {**extent, "version": old.version + 1, "model": place}

    def warnings(self) -> list[str]:
        """What a run has found too little of."""
        posts = self.table("posts")
        ready = knn.vector_readiness(posts, self.dims).first()
        empty = {"interests": "no interests", "similar": "no nearest posts", "feed_members": "no feeds"}
        out = [text for name, text in empty.items() if self.table(name).isEmpty()]
        keys = {"users": ("id",), "posts": ("id",), "interacts": ("src", "dst"), "favourited": ("user_id", "post_id"), "recommended": ("user_id", "post_id")}
        broken = stats.constraint_violations({n: self.table(n) for n in keys}, keys, self.dims).where((F.col("n") > 0) & (F.col("rule") != "vector length"))
        out += [f"{r['name']}: {r['n']} rows against {r['rule']}" for r in broken.collect()]
        return out + ([f"{ready['n_posts'] - ready['n_fit']} posts without a fitting vector"] if ready["n_fit"] < ready["n_posts"] else [])

    def validate(self) -> str:
        """'HEALTHY', 'DEGRADED' or 'FAILED' for the version that counts."""
        return stats.health(self.table("user_communities").limit(1).count(), self.table("posts").limit(1).count(), len(self.warnings()))

    def user(self, user_id: int) -> list[DataFrame]:
        """A user's profile, and the first posts of its feed."""
        reactions = interests.reaction_union({k: self.table(k) for k in interests.REACTIONS})
        posts = self.table("posts")
        wrote = posts.select(F.col("author_id").alias("user_id"), F.col("id").alias("post_id"))
        return [stats.user_profile(self.table("users"), user_id, wrote, reactions, self.table("interests")), stats.feed_top_posts(self.table("feed_members"), posts, user_id)]

    def post(self, post_id: int, as_of: str, user_id: int | None = None) -> list[DataFrame]:
        """A post's profile, and how it comes to a user's feed."""
        edges = {k: self.table(k) for k in (*interests.REACTIONS, "recommended")}
        reactions = interests.reaction_union({k: edges[k] for k in interests.REACTIONS})
        posts, sizes = self.table("posts"), self.table("post_communities")
        out = [stats.post_profile(posts, post_id, reactions, sizes)]
        if user_id is not None:
            seen = {**edges, "wrote": posts.select(F.col("author_id").alias("user_id"), F.col("id").alias("post_id")), "hates": self.table("hates")}
            pair = self.spark.createDataFrame([(user_id, post_id)], "user_id long, post_id long")
            out.append(feeds.explain(pair, self.table("users"), posts, reactions, self.table("interests"), sizes, seen, self.table("feed_members"), moment(as_of), self.settings))
        return out


def optional_version(engine: Engine, name: str, like: str, version: int) -> DataFrame:
    """A table of a version with the columns of `like`; an empty one before the first version."""
    empty = engine.spark.createDataFrame([], like)
    return engine.table(name, version).select(*empty.columns) if version else empty
