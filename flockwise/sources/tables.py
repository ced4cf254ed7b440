"""Reading tables and picking the row that counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def has_table(spark: SparkSession, directory: str, name: str) -> bool:
    """Whether a data directory holds the table, on any file system Spark knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{directory}/{name}.parquet")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def optional(spark: SparkSession, directory: str, name: str, like: str) -> DataFrame:
    """The table, with the columns of the schema `like` (null where it lacks one), or an empty one."""
    empty = spark.createDataFrame([], like)
    if not has_table(spark, directory, name):
        return empty
    df = table(spark, directory, name)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])


def newest(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per `key`: the one with the largest `order`, then the largest other values in the order of `columns`.

    The maximum is taken before the shuffle as well, so a key that holds a third of all rows sends one row per
    task. Rows whose key is null don't count; a null `order` is older than any other. Other columns are not read.
    """
    rest = [c for c in columns if c not in (key, order)]
    best = F.max(F.struct(order, *rest)).alias("_row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_row.{c}") for c in columns if c != key])


def month(at: str | Column) -> Column:
    """'YYYY-MM' of a time."""
    return F.date_format(at, "yyyy-MM")


def within_bytes(df: DataFrame, bound: int, columns: list[str]) -> bool:
    """Whether all values of `columns` together take at most `bound` bytes; one aggregate, nothing is collected."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(16))
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    return total <= bound


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores.

    Only a table of fewer splits than that is moved, so a large one, which has many, is read in place.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def statuses_newest(spark: SparkSession, directory: str) -> DataFrame:
    """One row per status."""
    columns = ["id", "updated_at", "account_id", "text", "language", "visibility", "reblog_of_id", "in_reply_to_id", "in_reply_to_account_id", "created_at",
        "deleted_at", "reply", "uri"]
    return newest(table(spark, directory, "statuses"), "id", "updated_at", columns)


def favourites_newest(spark: SparkSession, directory: str) -> DataFrame:
    """One row per favourite."""
    return newest(table(spark, directory, "favourites"), "id", "updated_at", ["id", "updated_at", "account_id", "status_id", "created_at"])


def accounts_newest(spark: SparkSession, directory: str) -> DataFrame:
    """One row per account, its domain in lower case without blanks around it."""
    rows = newest(table(spark, directory, "accounts"), "id", "updated_at", ["id", "updated_at", "username", "domain", "created_at"])
    return rows.withColumn("domain", F.lower(F.trim("domain")))
