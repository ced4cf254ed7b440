"""Queries on the relational tables: scans, lookups, interaction edges and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockwise.functions.scalar import handle_domain, handle_user, moment, preview, primary_subtag, snowflake_time, status_reference, to_double, to_long, without_secrets
from flockwise.operators import merge
from flockwise.operators.interactions import Cursors, interaction_edges, next_cursors
from flockwise.operators.text import phrase_scores, tokens
from flockwise.settings import Settings
from flockwise.sources import scans
from flockwise.sources.fixtures import TABLE_SQL
from flockwise.sources.tables import accounts_newest, favourites_newest, statuses_newest, table

SINCE, AS_OF = "2025-10-01 00:00:00", "2026-06-01 00:00:00"
CURSOR = 115_000_000_000_000_000
S = Settings()
_FLOOR = f"epoch_ms(TIMESTAMP '{SINCE}') << 16"


def _mentions(statuses: DataFrame) -> DataFrame:
    return statuses.where(F.col("in_reply_to_account_id").isNotNull()).select("id", F.col("id").alias("status_id"),
        F.col("in_reply_to_account_id").alias("account_id"), (F.col("id") % 3 == 0).alias("silent"))


def _follows(statuses: DataFrame) -> DataFrame:
    return statuses.where(F.col("in_reply_to_account_id").isNotNull()).select("id", "account_id", F.col("in_reply_to_account_id").alias("target_account_id"))


def status_scan_since(spark: SparkSession, d: str) -> DataFrame:
    return scans.statuses_since(statuses_newest(spark, d), since=SINCE)


def status_scan_cursor(spark: SparkSession, d: str) -> DataFrame:
    return scans.statuses_since(statuses_newest(spark, d), last_id=CURSOR)


def favourite_scan(spark: SparkSession, d: str) -> DataFrame:
    return scans.reactions_since(favourites_newest(spark, d), 1000, SINCE)


def bookmark_scan(spark: SparkSession, d: str) -> DataFrame:
    """Favourites stand for bookmarks."""
    return scans.reactions_since(favourites_newest(spark, d), 500)


def _aversions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = favourites_newest(spark, d).join(statuses_newest(spark, d).select(F.col("id").alias("status_id"), F.col("account_id").alias("target_account_id")), "status_id")
    return scans.aversions_since(f.where("id % 2 = 0"), "block", 100), scans.aversions_since(f.where("id % 2 = 1"), "mute", 100)


def block_mute_scan(spark: SparkSession, d: str) -> DataFrame:
    blocks, mutes = _aversions(spark, d)
    return blocks.unionByName(mutes)


def block_mute_union(spark: SparkSession, d: str) -> DataFrame:
    blocks, mutes = _aversions(spark, d)
    return merge.merge_aversions(spark.createDataFrame([], "src long, dst long"), blocks, mutes)


def user_activity(spark: SparkSession, d: str) -> DataFrame:
    stats = statuses_newest(spark, d).groupBy("account_id").agg(F.max("created_at").alias("last_status_at"))
    signed = favourites_newest(spark, d).groupBy("account_id").agg(F.max("created_at").alias("current_sign_in_at"))
    n = F.col("account_id")
    locale = F.when(n % 3 == 0, "en").when(n % 3 == 1, "de")
    chosen = F.when(n % 2 == 0, F.array(F.lit("fr"), F.coalesce(locale, F.lit("pt"))))
    people = signed.select("*", locale.alias("locale"), chosen.alias("chosen_languages"))
    return scans.user_activity(accounts_newest(spark, d), stats, people, moment(AS_OF), 90)


def active_user_count(spark: SparkSession, d: str) -> DataFrame:
    return user_activity(spark, d).agg(F.count("*").alias("n_active"))


def account_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The local accounts that share the name of the account with the smallest id."""
    accounts = accounts_newest(spark, d)
    name = accounts.where(F.col("domain").isNull()).orderBy("id").limit(1).collect()
    return scans.account_lookup(accounts, name[0]["username"].upper() if name else "", None, 5)


def account_by_handle(spark: SparkSession, d: str) -> DataFrame:
    rows = accounts_newest(spark, d).select("id", F.concat(F.lit("@"), F.col("username"), F.coalesce(F.concat(F.lit("@"), F.col("domain")), F.lit(""))).alias("handle"))
    return rows.select("id", handle_user(F.col("handle")).alias("name"), handle_domain(F.col("handle")).alias("host"))


def status_by_uri(spark: SparkSession, d: str) -> DataFrame:
    return scans.statuses_by_uri(statuses_newest(spark, d), "/statuses/11", 25)


def status_references(spark: SparkSession, d: str) -> DataFrame:
    return statuses_newest(spark, d).where(F.col("uri").isNotNull()).select("id", status_reference(F.col("uri")).alias("ref"))


def accounts_by_id(spark: SparkSession, d: str) -> DataFrame:
    accounts = accounts_newest(spark, d)
    ids = [r[0] for r in accounts.orderBy("id").limit(20).select("id").collect()]
    return scans.rows_by_id(accounts, ids, ["username", "domain"])


def table_stats(spark: SparkSession, d: str) -> DataFrame:
    s, f = statuses_newest(spark, d), favourites_newest(spark, d)
    return scans.table_stats(s, "statuses", True).unionByName(scans.table_stats(f, "favourites", False))


def snowflake_times(spark: SparkSession, d: str) -> DataFrame:
    return statuses_newest(spark, d).select("id", snowflake_time(F.col("id")).alias("at_time"))


def status_totals(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "post").groupBy("id").agg(F.max("total_favourites").alias("favourites_count"), F.max("total_reblogs").alias("reblogs_count"),
        F.max("total_replies").alias("replies_count"))
    stats = p.select(F.col("id").alias("status_id"), "favourites_count", "reblogs_count", "replies_count",
        F.when(F.col("id") % 2 == 0, F.col("reblogs_count")).alias("untrusted_favourites_count"), F.lit(1).cast("bigint").alias("untrusted_reblogs_count"))
    return scans.status_totals(stats, CURSOR)


def interactions(spark: SparkSession, d: str) -> DataFrame:
    s = statuses_newest(spark, d)
    return interaction_edges(favourites_newest(spark, d), s, _mentions(s), _follows(s), S)


def interaction_cursors(spark: SparkSession, d: str) -> DataFrame:
    return next_cursors(interactions(spark, d))


def interaction_edges_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The edges up to a cursor, and those beyond it merged into them."""
    s, f = statuses_newest(spark, d), favourites_newest(spark, d)
    cut = 3000
    old = interaction_edges(f.where(F.col("id") <= cut), s.where(F.col("id") <= CURSOR), _mentions(s).where(F.col("id") <= CURSOR), _follows(s).where(F.lit(False)), S, authors=s)
    new = interaction_edges(f, s, _mentions(s), _follows(s), S, Cursors(cut, CURSOR, CURSOR, 0))
    return merge.merge_interactions(old, new)


def corpus_filter(spark: SparkSession, d: str) -> DataFrame:
    return scans.corpus(statuses_newest(spark, d), 10)


def corpus_extent(spark: SparkSession, d: str) -> DataFrame:
    return scans.corpus_extent(corpus_filter(spark, d))


def corpus_tokens(spark: SparkSession, d: str) -> DataFrame:
    return scans.corpus_tokens(corpus_filter(spark, d)).select("id", F.size("tokens").alias("n_tokens"))


def embeddable_texts(spark: SparkSession, d: str) -> DataFrame:
    return scans.embeddable(statuses_newest(spark, d).select("id", "text"), 10, 0.1).select("id")


def embeddable_by_batch(spark: SparkSession, d: str) -> DataFrame:
    return scans.embeddable(statuses_newest(spark, d).select("id", "text"), 10, 0.1, F.col("id") % 7).select("id")


def tweet_tokens(spark: SparkSession, d: str) -> DataFrame:
    return corpus_filter(spark, d).select("id", tokens(F.col("text")).alias("t")).select("id", F.size("t").alias("n_tokens"))


def phrases(spark: SparkSession, d: str) -> DataFrame:
    t = scans.corpus_tokens(corpus_filter(spark, d))
    return phrase_scores(t, 5, 10.0).select("first", "second", "n", F.round("score", 6).alias("score"))


def merge_posts_keep_old(spark: SparkSession, d: str) -> DataFrame:
    """Half of the posts are known; all come in with another vector and counter."""
    p = table(spark, d, "post").where(F.size("embedding") == 64).groupBy("id").agg(F.max(F.struct("author_id", "language", "created_at", "total_favourites",
        "embedding")).alias("r")).select("id", "r.*")
    fresh = p.withColumn("embedding", F.array(F.col("id").cast("float"))).withColumn("total_favourites", F.lit(-1).cast("bigint"))
    out = merge.merge_posts(p.where("id % 2 = 0"), fresh)
    return out.select("id", "author_id", "total_favourites", F.size("embedding").alias("dims"))


def merge_favourites_first_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = favourites_newest(spark, d).select("id", F.col("account_id").alias("user_id"), F.col("status_id").alias("post_id"), F.col("created_at").alias("happened_at"))
    posts = statuses_newest(spark, d).where(F.col("deleted_at").isNull()).select("id")
    none = spark.createDataFrame([], "user_id long, post_id long, happened_at timestamp_ntz")
    first = merge.merge_reactions(none, rows.where("id % 2 = 0"), posts)
    return merge.merge_reactions(first, rows, posts)


def merge_reblogs(spark: SparkSession, d: str) -> DataFrame:
    """Reblogs and replies are branches of one scan; a row may be in both."""
    s = statuses_newest(spark, d)
    none = spark.createDataFrame([], "user_id long, post_id long, happened_at timestamp_ntz")

    def of(column: str) -> DataFrame:
        rows = s.where(F.col(column).isNotNull()).select("id", F.col("account_id").alias("user_id"), F.col(column).alias("post_id"), F.col("created_at").alias("happened_at"))
        return merge.merge_reactions(none, rows, s.select("id"))

    return of("reblog_of_id").withColumn("kind", F.lit("reblogged")).unionByName(of("in_reply_to_id").withColumn("kind", F.lit("replied")))


def merge_bookmarks(spark: SparkSession, d: str) -> DataFrame:
    """Favourites stand for bookmarks, which come in two loads."""
    rows = favourites_newest(spark, d).select("id", F.col("account_id").alias("user_id"), F.col("status_id").alias("post_id"), F.col("created_at").alias("happened_at"))
    none = spark.createDataFrame([], "user_id long, post_id long, happened_at timestamp_ntz")
    posts = statuses_newest(spark, d).select("id")
    return merge.merge_reactions(merge.merge_reactions(none, rows.where("id <= 3000"), posts), rows.where("id > 3000"), posts)


def merge_totals(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "post").groupBy("id").agg(F.max("author_id").alias("author_id"))
    return merge.merge_totals(posts, status_totals(spark, d))


def merge_activity(spark: SparkSession, d: str) -> DataFrame:
    users = accounts_newest(spark, d).where("id % 2 = 0").select("id", F.lit(None).cast("timestamp_ntz").alias("last_active"), F.lit(False).alias("is_local"))
    users = users.select("*", F.lit("xx").alias("ui_language"), F.lit(None).cast("array<string>").alias("languages"))
    return merge.merge_activity(users, user_activity(spark, d))


def ensure_users(spark: SparkSession, d: str) -> DataFrame:
    users = accounts_newest(spark, d).select("id", "username")
    return merge.ensure_users(users, favourites_newest(spark, d).select("account_id"))


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    s = statuses_newest(spark, d)
    dsn = F.concat(F.lit("postgresql://u"), F.col("account_id").cast("string"), F.lit(":secret@host/db"))
    return s.select(
        "id", primary_subtag(F.col("language")).alias("subtag"), preview(F.col("text"), 20).alias("short"), to_long(F.col("language"), -1).alias("as_long"),
        to_double(F.col("account_id").cast("string")).alias("as_double"), without_secrets(dsn).alias("dsn"),
    )


_WITH = f"WITH {TABLE_SQL}"
_CORPUS = """SELECT id, text FROM st WHERE deleted_at IS NULL AND visibility = 0 AND reblog_of_id IS NULL AND (NOT coalesce(reply, false) OR in_reply_to_account_id = account_id) AND
text <> '' AND length(text) >= 10"""
_LOCALE = "CASE id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END"
_ACTIVITY = f"""SELECT id AS account_id, greatest(coalesce(ls, created_at), coalesce(si, created_at)) AS last_active, domain IS NULL AS is_local,
CASE WHEN b IS NOT NULL THEN {_LOCALE} END AS ui_language, CASE WHEN b IS NOT NULL AND id % 2 = 0 THEN ['fr', coalesce({_LOCALE}, 'pt')] END AS languages
FROM ac LEFT JOIN (SELECT account_id AS a, max(created_at) AS ls FROM st GROUP BY 1) x ON x.a = id
LEFT JOIN (SELECT account_id AS b, max(created_at) AS si FROM fv GROUP BY 1) y ON y.b = id
WHERE greatest(coalesce(ls, created_at), coalesce(si, created_at)) >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY"""
_TOTALS = f"""SELECT id, coalesce(f, 0) + coalesce(CASE WHEN id % 2 = 0 THEN r END, 0) AS total_favourites, coalesce(r, 0) + 1 AS total_reblogs, p AS total_replies
FROM (SELECT id, max(total_favourites) AS f, max(total_reblogs) AS r, max(total_replies) AS p FROM post GROUP BY id) WHERE id > {CURSOR}"""
_AVERSE = """SELECT f.id, f.account_id, s.account_id AS target_account_id, CASE WHEN f.id % 2 = 0 THEN 'block' ELSE 'mute' END AS type
FROM fv f JOIN st s ON s.id = f.status_id WHERE f.id > 100"""


def _edges(fav: str, own: str, men: str, fol: str) -> str:
    w = f"{S.likes_weight_edge}, {S.replies_weight_edge}, {S.reblogs_weight_edge}, {S.mentions_weight_edge}, {S.follows_weight_edge}".split(", ")
    return f"""SELECT src, dst, CAST(sum(w) AS DOUBLE) AS weight, CAST(max(mf) AS BIGINT) AS max_favourite_id, CAST(max(ms) AS BIGINT) AS max_status_id, CAST(max(mm) AS BIGINT) AS
max_mention_id, CAST(max(ml) AS BIGINT) AS max_follow_id FROM (
SELECT f.account_id AS src, s.account_id AS dst, count(*) * {w[0]}::DOUBLE AS w, max(f.id) AS mf, NULL AS ms, NULL AS mm, NULL AS ml FROM fv f JOIN st s ON s.id =
f.status_id WHERE f.account_id <> s.account_id AND {fav} GROUP BY 1, 2
UNION ALL SELECT r.account_id, p.account_id, count(*) * {w[1]}::DOUBLE, NULL, max(r.id), NULL, NULL FROM st r JOIN st p ON p.id = r.in_reply_to_id WHERE r.account_id <>
p.account_id AND {own} GROUP BY 1, 2
UNION ALL SELECT r.account_id, p.account_id, count(*) * {w[2]}::DOUBLE, NULL, max(r.id), NULL, NULL FROM st r JOIN st p ON p.id = r.reblog_of_id WHERE r.account_id <>
p.account_id AND {own} GROUP BY 1, 2
UNION ALL SELECT r.account_id, r.in_reply_to_account_id, count(*) * {w[3]}::DOUBLE, NULL, NULL, max(r.id), NULL FROM st r WHERE r.in_reply_to_account_id IS NOT NULL AND
r.id % 3 <> 0 AND r.account_id <> r.in_reply_to_account_id AND {men} GROUP BY 1, 2
UNION ALL SELECT r.account_id, r.in_reply_to_account_id, {w[4]}::DOUBLE, NULL, NULL, NULL, max(r.id) FROM st r WHERE r.in_reply_to_account_id IS NOT NULL AND r.account_id
<> r.in_reply_to_account_id AND {fol} GROUP BY 1, 2
) GROUP BY 1, 2"""


_ALL_EDGES = _edges("true", "true", "true", "true")
_TOKENS = f"SELECT id, list_filter(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda t: t <> '') AS t FROM ({_CORPUS})"
_SUBTAG = "CASE WHEN contains(lower(trim(language)), '-') THEN split_part(lower(trim(language)), '-', 1) ELSE split_part(lower(trim(language)), '_', 1) END"
_FIRST = "SELECT user_id, post_id, min_by(happened_at, id) AS happened_at"
_ROWS = "SELECT id, account_id AS user_id, status_id AS post_id, created_at AS happened_at FROM fv WHERE status_id IN (SELECT id FROM st WHERE deleted_at IS NULL)"
_COLUMNS = "id, account_id, text, language, reblog_of_id, in_reply_to_id, created_at"

QUERIES = {
    f.__name__: f
    for f in (
        status_scan_since, status_scan_cursor, favourite_scan, bookmark_scan, block_mute_scan, block_mute_union, user_activity, active_user_count,
            account_lookup, account_by_handle,
        status_by_uri, status_references, accounts_by_id, table_stats, snowflake_times, status_totals, interaction_cursors, interaction_edges_incremental,
            corpus_filter, corpus_extent,
        corpus_tokens, embeddable_texts, embeddable_by_batch, tweet_tokens, phrases, merge_posts_keep_old, merge_favourites_first_wins, merge_reblogs,
            merge_bookmarks, merge_totals, merge_activity,
        ensure_users, scalar_functions,
    )
} | {"interaction_edges": interactions}

SQL = {
    "status_scan_since": f"{_WITH} SELECT {_COLUMNS} FROM st WHERE id > {_FLOOR} AND deleted_at IS NULL",
    "status_scan_cursor": f"{_WITH} SELECT {_COLUMNS} FROM st WHERE id > {CURSOR} AND deleted_at IS NULL",
    "favourite_scan": f"{_WITH} SELECT id, account_id, status_id, created_at FROM fv WHERE id > 1000 AND created_at >= TIMESTAMP '{SINCE}'",
    "bookmark_scan": f"{_WITH} SELECT id, account_id, status_id, created_at FROM fv WHERE id > 500",
    "block_mute_scan": f"{_WITH} {_AVERSE}",
    "block_mute_union": f"{_WITH} SELECT DISTINCT account_id AS src, target_account_id AS dst FROM ({_AVERSE})",
    "user_activity": f"{_WITH} {_ACTIVITY}",
    "active_user_count": f"{_WITH} SELECT count(*) AS n_active FROM ({_ACTIVITY})",
    "account_lookup": f"""{_WITH} SELECT id, username, domain FROM ac WHERE domain IS NULL AND lower(username) = (SELECT lower(username) FROM ac WHERE domain IS NULL ORDER BY id LIMIT 1) ORDER BY
id LIMIT 5""",
    "account_by_handle": f"{_WITH} SELECT id, username AS name, domain AS host FROM ac",
    "status_by_uri": f"{_WITH} SELECT DISTINCT id, uri FROM st WHERE contains(uri, '/statuses/11') ORDER BY id LIMIT 25",
    "status_references": f"{_WITH} SELECT id, TRY_CAST(nullif(regexp_extract(trim(uri), '(?:/statuses/|/@[^/]+/|^)(\\d+)/?(?:[?#].*)?$', 1), '') AS BIGINT) AS ref FROM st WHERE uri IS NOT NULL",
    "accounts_by_id": f"{_WITH} SELECT id, username, domain FROM ac ORDER BY id LIMIT 20",
    "table_stats": f"""{_WITH} SELECT 'statuses' AS table_name, max(id) AS max_id, count(*) AS n_rows, make_timestamp((max(id) >> 16) * 1000) AS max_date FROM st UNION ALL SELECT 'favourites',
max(id), count(*), max(created_at) FROM fv""",
    "snowflake_times": f"{_WITH} SELECT id, make_timestamp((id >> 16) * 1000) AS at_time FROM st",
    "status_totals": _TOTALS,
    "interaction_edges": f"{_WITH} {_ALL_EDGES}",
    "interaction_cursors": f"""{_WITH} SELECT coalesce(max(max_favourite_id), 0) AS max_favourite_id, coalesce(max(max_status_id), 0) AS max_status_id, coalesce(max(max_mention_id), 0) AS
max_mention_id, coalesce(max(max_follow_id), 0) AS max_follow_id FROM ({_ALL_EDGES})""",
    "interaction_edges_incremental": f"{_WITH} SELECT src, dst, weight FROM ({_ALL_EDGES})",
    "corpus_filter": f"{_WITH} {_CORPUS}",
    "corpus_extent": f"{_WITH} SELECT count(*) AS n_texts, max(id) AS max_id FROM ({_CORPUS})",
    "corpus_tokens": f"{_WITH} SELECT id, CAST(len(t) AS INTEGER) AS n_tokens FROM ({_TOKENS})",
    "embeddable_texts": f"""{_WITH}, t AS (SELECT id, row_number() OVER (ORDER BY length(text), id) AS r, count(*) OVER () AS c FROM st WHERE text <> '' AND length(text) >= 10) SELECT id FROM t
WHERE r > floor(c * 0.1::DOUBLE)""",
    "embeddable_by_batch": f"""{_WITH}, t AS (SELECT id, row_number() OVER (PARTITION BY id % 7 ORDER BY length(text), id) AS r, count(*) OVER (PARTITION BY id % 7) AS c FROM st WHERE text <> '' AND
length(text) >= 10) SELECT id FROM t WHERE r > floor(c * 0.1::DOUBLE)""",
    "phrases": f"""{_WITH}, t AS ({_TOKENS}), w AS (SELECT w, count(*) AS c FROM (SELECT unnest(t) AS w FROM t) GROUP BY 1),
p AS (SELECT t[i] AS a, t[i + 1] AS b, count(*) AS n FROM (SELECT t, unnest(range(1, len(t))) AS i FROM t) GROUP BY 1, 2 HAVING count(*) >= 5),
x AS (SELECT a, b, n, (n - 5) * (SELECT count(*) FROM w)::DOUBLE / (wa.c * wb.c) AS s FROM p JOIN w wa ON wa.w = a JOIN w wb ON wb.w = b)
SELECT a AS first, b AS second, n, round(s, 6) AS score FROM x WHERE s > 10""",
    "merge_posts_keep_old": """SELECT id, max(author_id) AS author_id, CASE WHEN id % 2 = 0 THEN max_by(total_favourites, (author_id, language, created_at, total_favourites)) ELSE -1 END AS
total_favourites, CAST(1 AS INTEGER) AS dims FROM post WHERE len(embedding) = 64 GROUP BY id""",
    "merge_favourites_first_wins": f"""{_WITH}, r AS ({_ROWS}), a AS ({_FIRST} FROM r WHERE id % 2 = 0 GROUP BY 1, 2), b AS ({_FIRST} FROM r GROUP BY 1, 2) SELECT * FROM a UNION ALL SELECT * FROM b WHERE
(user_id, post_id) NOT IN (SELECT (user_id, post_id) FROM a)""",
    "merge_reblogs": f"""{_WITH}, r AS (SELECT id, account_id AS user_id, reblog_of_id AS post_id, created_at AS happened_at, 'reblogged' AS kind FROM st UNION ALL SELECT id, account_id,
in_reply_to_id, created_at, 'replied' FROM st) {_FIRST}, kind FROM r WHERE post_id IN (SELECT id FROM st) GROUP BY user_id, post_id, kind""",
    "merge_bookmarks": f"""{_WITH} {_FIRST} FROM (SELECT id, account_id AS user_id, status_id AS post_id, created_at AS happened_at FROM fv WHERE status_id IN (SELECT id FROM st)) GROUP BY 1, 2""",
    "merge_totals": f"""SELECT p.id, author_id, total_favourites, total_reblogs, total_replies FROM (SELECT id, max(author_id) AS author_id FROM post GROUP BY 1) p LEFT JOIN ({_TOTALS}) t ON
t.id = p.id""",
    "merge_activity": f"""{_WITH} SELECT ac.id, a.last_active, coalesce(a.is_local, false) AS is_local, CASE WHEN a.account_id IS NULL THEN 'xx' ELSE a.ui_language END AS ui_language, a.languages
FROM ac LEFT JOIN ({_ACTIVITY}) a ON a.account_id = ac.id WHERE ac.id % 2 = 0""",
    "ensure_users": f"""{_WITH} SELECT id, username FROM ac UNION ALL SELECT DISTINCT account_id, NULL FROM fv WHERE account_id IS NOT NULL AND account_id NOT IN (SELECT id FROM ac)""",
    "scalar_functions": f"""{_WITH} SELECT id, nullif({_SUBTAG}, '') AS subtag,
replace(CASE WHEN length(p) > 20 THEN substr(p, 1, 20) || '...' ELSE p END, '|', '\\|') AS short, coalesce(TRY_CAST(language AS BIGINT), -1) AS as_long,
coalesce(TRY_CAST(CAST(account_id AS VARCHAR) AS DOUBLE), 0.0) AS as_double,
'postgresql://u' || account_id || ':***@host/db' AS dsn FROM (SELECT *, regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g') AS p FROM st)""",
}
