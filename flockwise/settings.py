"""Parameters of the engine and their defaults (fixed values that results depend on)."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """All time spans are counted from an explicit `as_of`, never from the wall clock."""

    # loading
    min_embedding_chars: int = 1
    skip_shortest_share: float = 0.0
    load_since: str = ""
    # interaction edges
    likes_weight_edge: float = 1.0
    replies_weight_edge: float = 3.0
    reblogs_weight_edge: float = 2.0
    mentions_weight_edge: float = 1.0
    follows_weight_edge: float = 10.0
    # nearest posts
    knn_neighbours: int = 10
    knn_self_slot: int = 1
    similarity_threshold: float = 0.7
    similarity_recency_days: int = 7
    prune_strategy: str = "temporal"
    prune_threshold: float = 0.9
    prune_days: int = 30
    # communities
    leiden_resolution: float = 0.1
    leiden_levels: int = 10
    noise_community: int = -1
    # pagerank
    pagerank_enabled: bool = True
    damping: float = 0.85
    pagerank_iterations: int = 20
    pagerank_weight: float = 0.1
    # interests
    likes_weight: float = 1.0
    reblogs_weight: float = 3.0
    replies_weight: float = 5.0
    bookmarks_weight: float = 2.0
    min_interactions: float = 5.0
    half_life_days: float = 14.0
    interest_ttl_days: int = 30
    ctr_enabled: bool = True
    ctr_weight: float = 0.5
    ctr_smoothing: float = 1.0
    min_ctr: float = 0.0
    least_score: float = 0.01
    serendipity_score: float = 0.1
    serendipity_limit: int = 100
    serendipity_share: float = 0.1
    similar_communities: int = 5
    community_similarity_enabled: bool = True
    # feeds
    feed_days: int = 7
    feed_size: int = 500
    cold_start_limit: int = 500
    share_weight: float = 0.45
    size_weight: float = 0.05
    popularity_weight: float = 0.3
    recency_weight: float = 0.2
    cold_popularity_weight: float = 0.7
    cold_recency_weight: float = 0.3
    recency_numerator: float = 1.0
    recency_smoothing: float = 1.0
    popularity_mode: str = "local"
    popularity_smoothing: float = 1.0
    global_smoothing: float = 1.0
    global_favourites_weight: float = 1.0 / 3
    global_reblogs_weight: float = 1.0 / 3
    global_replies_weight: float = 1.0 / 3
    blend_local: float = 0.5
    blend_global: float = 0.5
    language_weight: float = 0.3
    ui_language_weight: float = 0.5
    rank_multiplier: int = 10
    own_entry_tolerance: float = 1e-6
    feed_force_refresh: bool = False
    public_feed_enabled: bool = True
    public_feed_strategy: str = "local_communities"
    public_timeline_key: str = "timeline:public"
    local_timeline_key: str = "timeline:public:local"
    # users
    active_days: int = 90

    def validated(self) -> Settings:
        """These settings, or an error that names the first one out of range."""
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name.endswith(("_weight", "_days", "_size", "_limit", "_smoothing")) and value < 0:
                raise ValueError(f"{f.name} must not be negative")
        if self.noise_community == 0:
            raise ValueError("noise_community must not be 0, which is a valid community")
        if self.ui_language_weight < self.language_weight:
            raise ValueError("ui_language_weight must be at least language_weight")
        if self.popularity_mode not in ("local", "global", "blended"):
            raise ValueError("popularity_mode must be local, global or blended")
        if self.prune_strategy not in ("aggressive", "partial", "temporal", "none"):
            raise ValueError("prune_strategy must be aggressive, partial, temporal or none")
        if self.public_feed_strategy not in ("local_communities", "all_communities"):
            raise ValueError("public_feed_strategy must be local_communities or all_communities")
        self.since_days()
        if not 0 < self.damping < 1:
            raise ValueError("damping must lie between 0 and 1")
        return self

    def since_days(self) -> int | None:
        """The days of `load_since`, written '30d'; None if it is empty."""
        if not self.load_since:
            return None
        number = self.load_since.strip().lower().removesuffix("d")
        if not self.load_since.strip().lower().endswith("d") or not number.isdigit() or int(number) < 1:
            raise ValueError("load_since must be a number of days like 30d")
        return int(number)

    def similarity_signature(self) -> str:
        """Changes when the nearest-post graph must be built anew."""
        return f"knn:{self.knn_neighbours}:threshold:{self.similarity_threshold}:recency:{self.similarity_recency_days}"
