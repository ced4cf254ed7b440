"""The N best items of every group, by a mergeable bounded heap.

Each task keeps, for every group it meets, the N best distinct items with their best scores, so before anything is
shuffled a group of any size is down to N rows for each task (or for each `most_rows` rows of the table a task holds).
An item of the result is among the N best distinct items of the task that holds its best row, so nothing is lost. The
tables are sent by hashed group, an item's best score is taken, and a bounded priority queue merges them by score,
then item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.functions.aggregates import top_k

#: Rows that a task gathers before it cuts them down, and rows it holds before it sends them on.
STEP_ROWS, MOST_ROWS = 200_000, 1_000_000


def finite(column: str):
    """Whether a double is a number and not infinite."""
    c = F.col(column).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _best(rows: pa.Table, n: int) -> pa.Table:
    """The n best distinct items of each group, each with its best score."""
    best = rows.group_by(["g", "i"], use_threads=False).aggregate([("s", "max")]).rename_columns({"s_max": "s"}).select(["g", "i", "s"])
    best = best.take(pc.sort_indices(best, [("g", "ascending"), ("s", "descending"), ("i", "descending")]))
    g = best["g"].combine_chunks()
    begin = np.concatenate([[True], pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)])
    place = np.arange(len(begin))
    return best.filter(pa.array(place - np.maximum.accumulate(np.where(begin, place, 0)) < n))


def _heaps(n: int, step_rows: int, most_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        fresh = 0

        def cut() -> pa.Table | None:
            return _best(pa.concat_tables(held), n) if held else None

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            fresh += batch.num_rows
            if fresh >= step_rows:
                held, fresh = [cut()], 0
                if held[0].num_rows > most_rows:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from cut().to_batches()

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int, step_rows: int = STEP_ROWS, most_rows: int = MOST_ROWS) -> DataFrame:
    """(group, item, score, rank) of the first n items of each group, by score, then item, both descending.

    Rows with a null group or item or a score that is null, NaN or infinite don't take part; zero of either sign is
    one value. An item counts once per group, with its highest score. Fewer than n items give all; an empty table
    none. The input may hold other columns of any name, they are not read.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), (F.col(score).cast("double") + F.lit(0.0)).alias("s"))
    rows = rows.where(F.col("g").isNotNull() & F.col("i").isNotNull() & finite("s"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("g", "i")}
    # hashed by group once: the two aggregates after it need no further exchange
    heaps = rows.mapInArrow(_heaps(n, step_rows, most_rows), f"g {kinds['g']}, i {kinds['i']}, s double").repartition("g")
    best = heaps.groupBy("g", "i").agg(F.max("s").alias("s"))
    merged = best.groupBy("g").agg(top_k(F.struct("s", "i"), n).alias("top"))
    ranked = merged.select("g", F.posexplode(F.sort_array("top", asc=False)).alias("r", "e"))
    return ranked.select(F.col("g").alias(group), F.col("e.i").alias(item), F.col("e.s").alias(score), (F.col("r") + 1).alias("rank"))
