"""References to records that do not exist, are deleted or appear only later.

References and parent keys are hashed to the same partitions and sorted there, and both streams are merged in one
linear pass (Spark's sort-merge join, asked for by hint). A parent is one validity interval: it exists from
`valid_from` until `valid_to`, if that is set. A parent that holds a third of all references makes a skewed
partition, which adaptive execution splits on the reference side, the parent's single row being repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.sources.tables import month, newest

KINDS = ("missing", "deleted", "late")


def references(df: DataFrame, name: str, key: str, target: str, at: str, order: str) -> DataFrame:
    """(ref_table, ref_id, target, at): each referring key once, by its newest row; a null target refers to nothing."""
    rows = newest(df, key, order, [key, order, target, at])
    return rows.where(F.col(target).isNotNull()).select(
        F.lit(name).alias("ref_table"), F.col(key).alias("ref_id"), F.col(target).alias("target"), F.col(at).alias("at")
    )


def validity(df: DataFrame, key: str, start: str, end: str, order: str) -> DataFrame:
    """(parent, valid_from, valid_to): one interval per key, by its newest row."""
    return newest(df, key, order, [key, order, start, end]).select(
        F.col(key).alias("parent"), F.col(start).alias("valid_from"), F.col(end).alias("valid_to")
    )


def orphans(refs: list[DataFrame], parents: DataFrame) -> DataFrame:
    """(ref_table, ref_id, kind, ref_month) of each reference that doesn't hold.

    `kind` is the first that applies: 'missing' (no parent has the key), 'deleted' (`valid_to` is set, whatever its
    time), 'late' (the parent begins after the reference). A reference or parent without a time is never 'late'; its
    `ref_month` is null. Empty tables give no rows, or, for an empty parent table, every reference as 'missing'.
    """
    every = reduce(DataFrame.unionByName, refs)
    kind = (
        F.when(F.col("parent").isNull(), KINDS[0])
        .when(F.col("valid_to").isNotNull(), KINDS[1])
        .when(F.col("valid_from") > F.col("at"), KINDS[2])
    )
    met = every.join(parents.hint("merge"), every["target"] == parents["parent"], "left")
    return met.select("ref_table", "ref_id", kind.alias("kind"), month("at").alias("ref_month")).where(F.col("kind").isNotNull())


def orphan_report(found: DataFrame) -> DataFrame:
    """Number of orphan references per table, month and kind."""
    return found.groupBy("ref_table", "ref_month", "kind").agg(F.count("*").alias("n_refs"))
