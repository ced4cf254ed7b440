"""Vectors of nodes from the graph alone, by fast random projection, and groups of vectors by k-means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.functions.vectors import normalised
from flockwise.operators.pagerank import undirected
from flockwise.session import Scratch


def random_projection(nodes: DataFrame, edges: DataFrame, dims: int = 32, weights: tuple[float, ...] = (0.0, 1.0, 1.0), seed: int = 0) -> DataFrame:
    """(id, embedding) after Chen et al. 2019: hashed sparse vectors, averaged over neighbours as many times as there are weights less one.

    A component of the first vector is 1, 0 or -1 with chances 1/6, 2/3 and 1/6, by a hash of node and place. Each
    step takes the weighted mean over the neighbours (edges both ways), scaled to length one; the result is the sum
    of the steps by `weights`. Nodes without edges keep their first vector's share. Sums are combined before the
    shuffle by (node, place), so a hub is no hot key.
    """
    scratch = Scratch(nodes.sparkSession)
    ids = nodes.select("id").distinct()
    both = undirected(edges).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    both = scratch.cut(both.where("weight > 0"), "edges")
    place = F.sequence(F.lit(0), F.lit(dims - 1))
    sixth = lambda d: F.pmod(F.xxhash64("id", d, F.lit(seed)), F.lit(6))
    first = F.transform(place, lambda d: F.when(sixth(d) == 0, 1.0).when(sixth(d) == 1, -1.0).otherwise(0.0))
    now = scratch.cut(ids.select("id", normalised(first).alias("v")), "step")
    scaled = lambda w: F.transform("v", lambda x: x * F.lit(float(w)))
    total = now.select("id", scaled(weights[0]).alias("t"))
    for weight in weights[1:]:
        met = both.join(now.withColumnRenamed("id", "dst"), "dst").select("src", "weight", F.posexplode("v").alias("d", "x"))
        mean = met.groupBy("src", "d").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x"))
        rows = mean.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("v"))  # of `dims` places
        now = scratch.cut(rows.select(F.col("src").alias("id"), normalised(F.col("v")).alias("v")), "step")
        more = total.join(now, "id", "left")
        added = F.zip_with("t", scaled(weight), lambda a, b: a + b)
        total = scratch.cut(more.select("id", F.when(F.col("v").isNull(), F.col("t")).otherwise(added).alias("t")), "total")
    out = total.select("id", F.transform("t", lambda x: x.cast("float")).alias("embedding")).checkpoint()
    scratch.drop()
    return out


def grouped(vectors: DataFrame, k: int, column: str = "embedding", steps: int = 20, seed: int = 1) -> DataFrame:
    """(id, community) by k-means (pyspark.ml) over vectors of one length; fewer distinct vectors than k give fewer groups."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(column).isNotNull()).select("id", array_to_vector(F.col(column).cast("array<double>")).alias("_v"))
    if rows.isEmpty():
        return rows.select("id", F.lit(0).cast("bigint").alias("community"))
    model = KMeans(k=k, maxIter=steps, seed=seed, featuresCol="_v", predictionCol="_c").fit(rows)
    return model.transform(rows).select("id", F.col("_c").cast("bigint").alias("community"))
