"""Incremental scans of the relational tables, lookups and table statistics.

Every scan is a lazy projection and filter, so column pruning and filters reach the Parquet files.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flockwise.functions.scalar import days_before, moment, snowflake_floor, snowflake_time
from flockwise.session import checkpoint_dir


def statuses_since(df: DataFrame, last_id: int = 0, since: str | datetime | None = None) -> DataFrame:
    """Live statuses beyond a cursor; a time bound becomes a bound on the id, which prunes row groups."""
    floor = F.lit(last_id).cast("bigint")
    if since is not None:
        floor = F.greatest(floor, snowflake_floor(moment(since)))
    columns = ["id", "account_id", "text", "language", "reblog_of_id", "in_reply_to_id", "created_at"]
    return df.where((F.col("id") > floor) & F.col("deleted_at").isNull()).select(*columns)


def reactions_since(df: DataFrame, last_id: int = 0, since: str | datetime | None = None) -> DataFrame:
    """Favourites or bookmarks beyond a cursor; their ids hold no time, so the time bound is on the row."""
    rows = df.where(F.col("id") > last_id)
    if since is not None:
        rows = rows.where(F.col("created_at") >= moment(since))
    return rows.select("id", "account_id", "status_id", "created_at")


def aversions_since(df: DataFrame, kind: str, last_id: int = 0) -> DataFrame:
    """Blocks or mutes beyond a cursor, with their kind; an expiry is not looked at."""
    return df.where(F.col("id") > last_id).select("id", "account_id", "target_account_id", F.lit(kind).alias("type"))


def user_activity(accounts: DataFrame, account_stats: DataFrame, users: DataFrame, as_of: Column, active_days: int, last_account_id: int = 0) -> DataFrame:
    """Accounts seen within `active_days`, with the later of last status and last sign-in; no value counts as creation."""
    stats = account_stats.select(F.col("account_id").alias("_s"), "last_status_at")
    people = users.select(F.col("account_id").alias("_u"), "current_sign_in_at", "locale", "chosen_languages")
    joined = accounts.join(stats, F.col("id") == F.col("_s"), "left").join(people, F.col("id") == F.col("_u"), "left")
    last = F.greatest(F.coalesce("last_status_at", "created_at"), F.coalesce("current_sign_in_at", "created_at"))
    rows = joined.select(F.col("id").alias("account_id"), last.alias("last_active"), F.col("domain").isNull().alias("is_local"),
        F.col("locale").alias("ui_language"), F.col("chosen_languages").alias("languages"))
    return rows.where((F.col("last_active") >= days_before(as_of, active_days)) & (F.col("account_id") > last_account_id))


def status_totals(stats: DataFrame, last_id: int = 0) -> DataFrame:
    """Trusted and untrusted counters added; replies have one counter, which stays null if it is."""
    zero = F.lit(0).cast("bigint")
    return stats.where(F.col("status_id") > last_id).select(
        F.col("status_id").alias("id"),
        (F.coalesce("favourites_count", zero) + F.coalesce("untrusted_favourites_count", zero)).alias("total_favourites"),
        (F.coalesce("reblogs_count", zero) + F.coalesce("untrusted_reblogs_count", zero)).alias("total_reblogs"),
        F.col("replies_count").alias("total_replies"),
    )


def corpus(df: DataFrame, min_chars: int = 1, last_id: int = 0) -> DataFrame:
    """Texts to learn from: public, live, no reblogs, no replies to others; (id, text)."""
    own_thread = ~F.coalesce("reply", F.lit(False)) | (F.col("in_reply_to_account_id") == F.col("account_id"))
    rows = df.where((F.col("id") > last_id) & F.col("deleted_at").isNull() & (F.col("visibility") == 0) & F.col("reblog_of_id").isNull() & own_thread)
    return rows.where((F.col("text") != "") & (F.length("text") >= min_chars)).select("id", "text")


def corpus_tokens(texts: DataFrame) -> DataFrame:
    """(id, tokens): lower-case words between blanks."""
    return texts.select("id", F.filter(F.split(F.trim(F.lower("text")), r"\s+"), lambda t: t != "").alias("tokens"))


def corpus_extent(texts: DataFrame) -> DataFrame:
    """Number of texts and the largest id, the next cursor."""
    return texts.agg(F.count("*").alias("n_texts"), F.max("id").alias("max_id"))


def embeddable(texts: DataFrame, min_chars: int, skip_share: float, batch: Column | None = None) -> DataFrame:
    """Texts of at least `min_chars` characters, without the shortest share of each batch (the whole if none is given).

    The shortest are told by length and then id. Without batches the bound is found from counts: rows are counted per
    length, and those of the one length that is cut within per range of ids, so nothing is sorted.
    """
    rows = texts.where((F.col("text") != "") & (F.length("text") >= min_chars)).withColumn("_n", F.length("text"))
    if skip_share <= 0:
        return rows.drop("_n")
    if batch is None:
        return _without_shortest(rows, skip_share).select(*texts.columns)
    from pyspark.sql import Window

    whole = rows.withColumn("_b", batch)
    order = Window.partitionBy("_b").orderBy("_n", "id")
    ranked = whole.withColumn("_r", F.row_number().over(order)).withColumn("_c", F.count("*").over(Window.partitionBy("_b")))
    return ranked.where(F.col("_r") > F.floor(F.col("_c") * F.lit(skip_share))).select(*texts.columns)


#: Ranges that rows of one length are counted in, and rows of a range that is sorted.
_RANGES, _SORTED_ROWS = 1024, 1 << 16


def _without_shortest(rows: DataFrame, skip_share: float) -> DataFrame:
    """Rows without the shortest share by (_n, id); what comes to the driver is two numbers for each narrowing."""
    skip = int(rows.count() * skip_share)
    if not skip:
        return rows
    checkpoint_dir(rows.sparkSession)
    counts = rows.groupBy("_n").agg(F.count("*").alias("c")).checkpoint()  # one row for each length
    # the largest length of which fewer than `skip` rows are shorter: halve the range of lengths
    low, high = 0, counts.agg(F.max("_n").alias("m")).first()["m"]
    while low < high:
        middle = (low + high) // 2
        if (counts.where(F.col("_n") <= middle).agg(F.sum("c").alias("s")).first()["s"] or 0) >= skip:
            high = middle
        else:
            low = middle + 1
    shorter = counts.where(F.col("_n") < low).agg(F.sum("c").alias("s")).first()["s"] or 0
    left = skip - shorter
    same = rows.where(F.col("_n") == low)
    first, last = same.agg(F.min("id"), F.max("id")).first()
    # of that length the `left` smallest ids go: narrow the range of ids until few rows are left in it
    while True:
        inside = same.where(F.col("id").between(first, last))
        width = (last - first) // _RANGES + 1
        per = dict(inside.groupBy(((F.col("id") - first) / width).cast("bigint").alias("b")).count().collect())
        if sum(per.values()) <= _SORTED_ROWS or first == last:
            break
        for b in sorted(per):
            if left <= per[b]:
                first, last = first + b * width, min(last, first + (b + 1) * width - 1)
                break
            left -= per[b]
    ids = [r[0] for r in inside.select("id").orderBy("id").limit(left).collect()]  # of at most _SORTED_ROWS rows
    bound = ids[-1] if ids else first - 1
    return rows.where((F.col("_n") > low) | ((F.col("_n") == low) & (F.col("id") > bound)))


def account_lookup(accounts: DataFrame, username: str, domain: str | None, limit: int = 2) -> DataFrame:
    """Accounts of a name on a host, case doesn't matter; no host means local accounts."""
    wanted = F.lit(domain.lower() if domain is not None else None).cast("string")
    match = (F.lower("username") == username.lower()) & F.lower("domain").eqNullSafe(wanted)
    return accounts.where(match).select("id", "username", "domain").orderBy("id").limit(limit)


def statuses_by_uri(statuses: DataFrame, fragment: str, limit: int = 2) -> DataFrame:
    """Statuses whose uri holds a fragment; two rows mean that it is ambiguous."""
    return statuses.where(F.col("uri").contains(fragment)).select("id", "uri").distinct().orderBy("id").limit(limit)


def resolve_status(statuses: DataFrame, reference: str) -> tuple[str, int | None]:
    """('found', id), ('not found', None) or ('multiple', None) for an id or a part of a uri."""
    rows = statuses.where(F.col("id") == int(reference)).select("id").limit(1).collect() if reference.isdigit() else []
    rows = rows or statuses_by_uri(statuses, reference).collect()
    if not rows:
        return "not found", None
    return ("found", rows[0]["id"]) if len(rows) == 1 else ("multiple", None)


def rows_by_id(df: DataFrame, ids: list[int], columns: list[str]) -> DataFrame:
    """Rows whose id is in a short list."""
    return df.where(F.col("id").isin(ids)).select("id", *columns)


def table_stats(df: DataFrame, name: str, ids_hold_time: bool) -> DataFrame:
    """Largest id, rows, and the latest time: of the id where it holds one, else of the rows."""
    latest = snowflake_time(F.max("id")) if ids_hold_time else F.max("created_at")
    return df.agg(F.lit(name).alias("table_name"), F.max("id").alias("max_id"), F.count("*").alias("n_rows"), latest.alias("max_date"))


def active_users(users: DataFrame, as_of: Column, active_days: int, local_only: bool = False) -> DataFrame:
    """Ids of users seen lately or never seen."""
    rows = users.where(F.col("last_active").isNull() | (F.col("last_active") >= days_before(as_of, active_days)))
    return (rows.where("is_local") if local_only else rows).select("id")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, partitions: int, fetch_size: int = 10_000, **options: str) -> DataFrame:
    """A table of a database, read by ranges of its key in parallel, in blocks of rows; needs the driver's jar."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).option("fetchsize", fetch_size)
    for k, v in {"partitionColumn": key, "lowerBound": lower, "upperBound": upper, "numPartitions": partitions, **options}.items():
        reader = reader.option(k, v)
    return reader.load()
