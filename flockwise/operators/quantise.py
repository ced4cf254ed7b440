"""Product quantisation: vectors as a byte for each of their parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.functions.vectors import kmeans, nearest_centre

#: Vectors that the codebooks are fitted on, about, and centroids of a codebook, at most 256.
SAMPLE_ROWS, CENTROIDS = 16_384, 256


def codebooks(vectors: DataFrame, dims: int, parts: int, column: str = "embedding") -> np.ndarray:
    """(parts, centroids, dims / parts), fitted on a bounded sample of (id, vector) by hashed id.

    Vectors of another length or null take no part; without any vector the books are empty.
    """
    if dims % parts:
        raise ValueError("dims must be a multiple of parts")
    rows = vectors.where(F.size(column) == dims)
    share = min(1.0, SAMPLE_ROWS / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col(column).cast("array<float>").alias("v")).toArrow()["v"]
    flat = np.array(sample.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, parts, dims // parts)
    return np.stack([kmeans(flat[:, p], CENTROIDS, seed=p) for p in range(parts)])


def encoded(vectors: DataFrame, books: np.ndarray, column: str = "embedding") -> DataFrame:
    """(id, code): a byte for each part of a vector; one narrow pass."""
    parts, _, width = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float32).reshape(batch.num_rows, parts, width)
            codes = np.stack([nearest_centre(v[:, p], sent.value[p]) for p in range(parts)], 1).astype(np.uint8) if batch.num_rows else np.zeros((0, parts), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "code"])

    rows = vectors.where(F.size(column) == parts * width).select(F.col("id").cast("long").alias("id"), F.col(column).cast("array<float>").alias("v"))
    return rows.mapInArrow(run, "id long, code binary")


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, embedding): the centroids that a code names."""
    parts, _, width = books.shape
    sent = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, parts)
            flat = pa.array(sent.value[np.arange(parts), at].astype(np.float32).reshape(-1))
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * parts * width, parts * width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["id", "embedding"])

    return codes.select("id", "code").mapInArrow(run, "id long, embedding array<float>")
