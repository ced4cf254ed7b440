"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockwise.llm.garbled import garbled
from flockwise.llm.language import label_cases, languages
from flockwise.llm.leaks import leaks
from flockwise.llm.packing import pack_texts, packing_report
from flockwise.llm.similar import similar
from flockwise.llm.terms import marked, term_counts
from flockwise.llm.topn import top_n_per_group
from flockwise.sources.tables import newest, table

NEIGHBOURS, LEAST_COSINE, QUERY_EVERY = 10, 0.9, 100
RARE_RECORDS, COMMON_SHARE, TOP_POSTS = 2, 0.05, 10


def p1_languages(spark: SparkSession, directory: str) -> DataFrame:
    """The newest row of each status with its language, confidence and one-language segments."""
    statuses = table(spark, directory, "statuses")
    rows = newest(statuses, "id", "updated_at", ["id", "updated_at", "text", "language"])
    return languages(rows, "id", "text", "language", training=statuses)


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Statuses with a missing or wrong label or several languages, one row per language of the text."""
    return label_cases(p1_languages(spark, directory), "id")


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of posts of cosine 0.9 or more of which one is among the ten nearest of the other."""
    near = similar(table(spark, directory, "post"), "id", "embedding", NEIGHBOURS, least=LEAST_COSINE)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p2_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    """The ten nearest posts of every post whose id is divisible by 100, whatever their cosine."""
    return similar(table(spark, directory, "post"), "id", "embedding", NEIGHBOURS, asks=lambda c: c % QUERY_EVERY == 0)


def p3_top_posts(spark: SparkSession, directory: str) -> DataFrame:
    """The ten posts of each viewer with the highest final score, with score and rank."""
    return top_n_per_group(table(spark, directory, "recommendation_detail"), "viewer_user_id", "post_id", "final_score", TOP_POSTS)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """The pairs of viewer and post among them."""
    return p3_top_posts(spark, directory).select("viewer_user_id", "post_id")


def p5_terms(spark: SparkSession, directory: str) -> DataFrame:
    """Every term of the newest statuses with its occurrences, records and mark."""
    statuses = table(spark, directory, "statuses")
    total = statuses.select("id").where(F.col("id").isNotNull()).agg(F.count_distinct("id").alias("n"))
    counts = term_counts(newest(statuses, "id", "updated_at", ["id", "updated_at", "text"]), "text")
    return marked(counts, total, RARE_RECORDS, COMMON_SHARE)


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Terms that are too rare or too common."""
    return p5_terms(spark, directory).where(F.col("mark").isNotNull()).select("term", "mark")


def p6_containers(spark: SparkSession, directory: str) -> DataFrame:
    """The container of each document, or of each piece of a document larger than the capacity, for each budget."""
    held = table(spark, directory, "token_budgets").select("budget_id", "capacity_tokens").distinct().collect()
    budgets = sorted((r[0], r[1]) for r in held if r[0] is not None and r[1])
    return pack_texts(table(spark, directory, "documents"), "doc_id", "text", "source", budgets).withColumnRenamed("id", "doc_id")


def p6_report(spark: SparkSession, directory: str) -> DataFrame:
    """How well the room of the containers is used, and how near they are to the mixture of all texts."""
    return packing_report(p6_containers(spark, directory))


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents with at least 15 consecutive words of an evaluation passage, and the item."""
    return leaks(table(spark, directory, "documents"), "doc_id", "text", table(spark, directory, "eval_items"), "item_id", "passage")


def p7_item_report(spark: SparkSession, directory: str) -> DataFrame:
    """Number of documents that each leaked item is in."""
    return p7_found(spark, directory).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p8_restored(spark: SparkSession, directory: str) -> DataFrame:
    """Each document with garbled text, its restored text, the layers undone and whether damage remains."""
    return garbled(table(spark, directory, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents with garbled text."""
    return p8_restored(spark, directory).select("doc_id").distinct()


_TOP = """
SELECT viewer_user_id, post_id, final_score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY viewer_user_id ORDER BY final_score DESC, post_id DESC) AS INTEGER) AS rank
  FROM (SELECT viewer_user_id, post_id, max(final_score) + 0.0 AS final_score FROM recommendation_detail
        WHERE viewer_user_id IS NOT NULL AND post_id IS NOT NULL AND final_score IS NOT NULL AND isfinite(final_score)
        GROUP BY 1, 2)) WHERE rank <= 10"""

QUERIES = {"p1_found": p1_found, "p1_languages": p1_languages, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p3_found": p3_found,
    "p3_top_posts": p3_top_posts, "p5_found": p5_found, "p5_terms": p5_terms, "p6_containers": p6_containers, "p6_report": p6_report, "p7_found": p7_found,
    "p7_item_report": p7_item_report, "p8_found": p8_found, "p8_restored": p8_restored}
_NEAR = """
WITH v AS (SELECT id, [x::DOUBLE for x in max(embedding)] AS e FROM post
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
           GROUP BY id),
s AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS n FROM s)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM r WHERE n <= 10 AND c >= 0.9"""
SQL = {"p2_found": _NEAR, "p3_found": f"SELECT viewer_user_id, post_id FROM ({_TOP})", "p3_top_posts": _TOP}
