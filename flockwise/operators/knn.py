"""The nearest-post graph: cosine neighbours by an inverted file, statistics and pruning.

Vectors are put into cells by their nearest centroid, fitted on a bounded sample. A search goes to the PROBES cells
nearest to it, where all vectors are compared exactly. A collection of up to PROBES cells is searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockwise.functions.aggregates import top_k
from flockwise.functions.scalar import days_before
from flockwise.functions.vectors import kmeans, nearest_centre
from flockwise.settings import Settings

#: Vectors of a cell, about, cells that a search goes to, and searches that a task compares with a cell, about.
CELL_ROWS, PROBES, SEARCH_ROWS = 16_384, 16, 65_536
#: Vectors that the centroids are fitted on, at least, and for each cell.
SAMPLE_ROWS, SAMPLE_PER_CELL = 16_384, 16


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return np.array(flat.to_numpy(zero_copy_only=False), np.float64).reshape(rows, -1)


def _cut(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    src, dst, sim = (np.concatenate([p[n] for p in parts]) for n in range(3))
    order = np.lexsort((dst, -sim, src))
    src, dst, sim = src[order], dst[order], sim[order]
    begin = np.concatenate([[True], src[1:] != src[:-1]]) if len(src) else np.zeros(0, bool)
    rank = np.arange(len(src)) - np.maximum.accumulate(np.where(begin, np.arange(len(src)), 0))
    return src[rank < k], dst[rank < k], sim[rank < k]


def _compared(k: int):
    """The k best of each search among a cell's vectors, by exact cosine in double precision."""

    def run(table: pa.Table) -> pa.Table:
        kind, ids = table["kind"].to_numpy(), table["id"].to_numpy()
        v = _unit(_matrix(table["v"], len(ids)))
        held, asked = np.nonzero(kind == 0)[0], np.nonzero(kind == 1)[0]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a in range(0, len(asked), 2048):
            rows = asked[a : a + 2048]
            for b in range(0, len(held), 8192):
                there = held[b : b + 8192]
                sims = v[rows] @ v[there].T
                sims[ids[rows][:, None] == ids[there][None]] = -np.inf
                take = min(k, len(there))
                # all that reach the k-th value, so that ties are settled by id and not by position
                least = np.partition(sims, len(there) - take, axis=1)[:, len(there) - take]
                i, j = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
                best.append((ids[rows][i], ids[there][j], sims[i, j]))
            best = [_cut(best, k)]
        src, dst, sim = best[0]
        return pa.table({"src": src, "dst": dst, "cosine": sim})

    return run


def nearest(sources: DataFrame, posts: DataFrame, k: int, dims: int, cell_rows: int = CELL_ROWS, probes: int = PROBES) -> DataFrame:
    """(src, dst, cosine): the k nearest of `posts` for each of `sources`, both (id, embedding), by cosine, then id.

    Both are shuffled by cell, a vector once and a search to `probes` cells; exact while there are no more cells than
    that, approximate beyond. A cell of several times its share is cut into parts, and many searches of one
    cell too. Vectors of another length or without direction take no part.
    """
    spark = posts.sparkSession
    fine = lambda df: df.where((F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("embedding",
        lambda x: x != 0)).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    wanted, held = fine(sources), fine(posts)
    total = held.count()
    cells = max(1, -(-total // cell_rows))
    if cells > 1:
        share = min(1.0, max(SAMPLE_ROWS, SAMPLE_PER_CELL * cells) / total)
        sample = held.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow()["v"]
        points = _unit(_matrix(sample, len(sample))).astype(np.float32)
        centres = kmeans(points, cells)
        expected = np.bincount(nearest_centre(points, centres), minlength=len(centres)) / max(1, len(points)) * total
    else:
        centres, expected = np.zeros((1, dims), np.float32), np.array([float(total)])
    parts = np.maximum(1, np.ceil(expected / (4 * cell_rows))).astype(np.int64)
    chunks = max(1, -(-wanted.count() * min(probes, len(centres)) // (len(centres) * SEARCH_ROWS)))
    sent = spark.sparkContext.broadcast((centres, parts))

    def placed(searching: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book, cut = sent.value
            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    part = batch.slice(start, 4096)
                    u = _unit(_matrix(part.column(1), part.num_rows)).astype(np.float32)
                    away = (book**2).sum(1) - 2 * u @ book.T
                    near = np.argpartition(away, min(probes, len(book)) - 1, axis=1)[:, : min(probes, len(book))] if searching else away.argmin(1)[:, None]
                    at, cell = np.repeat(np.arange(len(u)), near.shape[1]), near.reshape(-1)
                    ids = part.column(0).to_numpy()
                    # an entry goes to its part for every chunk of searches, a search to its chunk for every part
                    times = cut[cell] if searching else np.full(len(at), chunks)
                    again = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                    at, cell = np.repeat(at, times), np.repeat(cell, times)
                    entry = again if searching else ids[at] % cut[cell]
                    chunk = ids[at] % chunks if searching else again
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array((entry * chunks + chunk).astype(np.int64)),
                        pa.array(np.full(len(at), int(searching), np.int8)), part.column(0).take(take), part.column(1).take(take)], names=["cell", "task", "kind", "id", "v"])

        return run

    kind = "cell int, task long, kind byte, id long, v array<double>"
    both = held.mapInArrow(placed(False), kind).unionByName(wanted.mapInArrow(placed(True), kind))
    near = both.groupBy("cell", "task").applyInArrow(_compared(k), "src long, dst long, cosine double")
    top = near.groupBy("src").agg(top_k(F.struct("cosine", (-F.col("dst")).alias("o")), k).alias("t"))
    return top.select("src", F.explode("t").alias("e")).select("src", (-F.col("e.o")).alias("dst"), F.col("e.cosine").alias("cosine"))


def similarity_edges(posts: DataFrame, as_of: Column, s: Settings, dims: int, score_mode: str = "normalised", sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight): recent posts and their nearest posts of any age above the threshold.

    One of the neighbours asked for is the post itself if `knn_self_slot` is 0. The score is the cosine or, normalised,
    (1 + cosine) / 2. With `sources` (id) only those are searched, for an incremental build.
    """
    k = max(1, s.knn_neighbours + s.knn_self_slot) - 1
    recent = posts.where(F.col("created_at") > days_before(as_of, s.similarity_recency_days))
    if sources is not None:
        recent = recent.join(sources.select("id"), "id", "left_semi")
    near = nearest(recent.select("id", "embedding"), posts.select("id", "embedding"), max(k, 1), dims)
    weight = (1 + F.col("cosine")) / 2 if score_mode == "normalised" else F.col("cosine")
    return near.select("src", "dst", weight.alias("weight")).where(F.col("weight") > s.similarity_threshold)


def posts_to_connect(posts: DataFrame, edges: DataFrame, old_signature: str | None, s: Settings) -> DataFrame:
    """(id): all posts with a vector if the signature has changed, else those without an outgoing edge."""
    fit = posts.where(F.col("embedding").isNotNull()).select("id")
    if old_signature != s.similarity_signature():
        return fit
    return fit.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def updated_edges(posts: DataFrame, old: DataFrame, old_signature: str | None, as_of: Column, s: Settings, dims: int, score_mode: str = "normalised") -> DataFrame:
    """All edges after a build: the former ones and those of posts that lacked any, or all anew if the signature has changed."""
    if old_signature != s.similarity_signature():
        return similarity_edges(posts, as_of, s, dims, score_mode)
    todo = posts_to_connect(posts, old, old_signature, s)
    return old.select("src", "dst", "weight").unionByName(similarity_edges(posts, as_of, s, dims, score_mode, todo))


def similarity_stats(edges: DataFrame, posts: DataFrame) -> DataFrame:
    """Edges, sources, least, mean, median and largest weight, posts with a vector but no edge; one row."""
    linked = posts.where(F.col("embedding").isNotNull()).select("id").join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    return edges.agg(
        F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_sources"), F.coalesce(F.min("weight"), F.lit(0.0)).alias("min_weight"),
            F.coalesce(F.avg("weight"), F.lit(0.0)).alias("avg_weight"),
        F.coalesce(F.percentile("weight", 0.5), F.lit(0.0)).alias("median_weight"), F.coalesce(F.max("weight"), F.lit(0.0)).alias("max_weight"),
    ).withColumn("n_without", linked.agg(F.count("*").alias("n")).scalar())


def pruned(edges: DataFrame, posts: DataFrame, as_of: Column, s: Settings) -> DataFrame:
    """Edges that stay: none, those of enough weight, those of young sources, or all, by the strategy."""
    if s.prune_strategy == "aggressive":
        return edges.where(F.lit(False))
    if s.prune_strategy == "partial":
        return edges.where(F.col("weight") >= s.prune_threshold)
    if s.prune_strategy == "temporal":
        old = posts.where(F.col("created_at") < days_before(as_of, s.prune_days)).select(F.col("id").alias("src"))
        return edges.join(old, "src", "left_anti")
    return edges


def vector_readiness(posts: DataFrame, dims: int) -> DataFrame:
    """Posts, posts with a vector, vectors of the right length; one row."""
    return posts.agg(F.count("*").alias("n_posts"), F.count("embedding").alias("n_vectors"), F.count_if(F.size("embedding") == dims).alias("n_fit"))
