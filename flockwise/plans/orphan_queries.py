"""Queries on references that do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flockwise.operators.orphans import orphan_report, orphans, references, validity
from flockwise.sources.tables import table


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Each reference of favourites and replies whose status is missing, deleted or late."""
    statuses = table(spark, directory, "statuses")
    favourites = table(spark, directory, "favourites")
    refs = [
        references(favourites, "favourites", "id", "status_id", "created_at", "updated_at"),
        references(statuses, "statuses", "id", "in_reply_to_id", "created_at", "updated_at"),
    ]
    return orphans(refs, validity(statuses, "id", "created_at", "deleted_at", "updated_at"))


def p4_orphan_report(spark: SparkSession, directory: str) -> DataFrame:
    """Orphan references counted per table, month and kind."""
    return orphan_report(p4_found(spark, directory))


_FOUND = """
WITH s AS (SELECT id, max_by(struct_pack(c := created_at, d := deleted_at, r := in_reply_to_id), updated_at) AS v
           FROM statuses GROUP BY id),
f AS (SELECT id, max_by(struct_pack(c := created_at, t := status_id), updated_at) AS v FROM favourites GROUP BY id),
refs AS (SELECT 'favourites' AS ref_table, id AS ref_id, v.t AS target, v.c AS ref_at FROM f
         UNION ALL SELECT 'statuses', id, v.r, v.c FROM s),
met AS (SELECT ref_table, ref_id,
               CASE WHEN s.id IS NULL THEN 'missing' WHEN s.v.d IS NOT NULL THEN 'deleted'
                    WHEN s.v.c > ref_at THEN 'late' END AS kind,
               strftime(ref_at, '%Y-%m') AS ref_month
        FROM refs LEFT JOIN s ON s.id = refs.target WHERE target IS NOT NULL)
SELECT ref_table, ref_id, kind, ref_month FROM met WHERE kind IS NOT NULL"""

QUERIES = {"p4_found": p4_found, "p4_orphan_report": p4_orphan_report}
SQL = {
    "p4_found": _FOUND,
    "p4_orphan_report": f"SELECT ref_table, ref_month, kind, count(*) AS n_refs FROM ({_FOUND}) GROUP BY ALL",
}
