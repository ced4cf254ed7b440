"""Filling containers of fixed capacity with whole texts, to a mixture of sources.

Texts are spread over partitions by hash. In each, every source has a queue of its texts. A container is filled by
deficit round-robin: the source that is furthest behind its share of tokens gives its next text that fits, and after
each container every source is credited its share of what the container holds. Near the end of a container, when the
room is that of a few texts, the largest text that fits is taken, of whatever source. What a source is behind or ahead
when a partition ends is carried into the next; as all texts of a partition are placed, these carries follow from
token totals alone and the partitions can work at the same time. Containers that stay underfilled at the end of a
partition are emptied and packed again with those of neighbouring partitions, with the carry of what these have kept.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockwise.session import checkpoint_dir

#: Tokens of a partition, about, and partitions (a power of two) whose underfilled containers are packed again together.
PARTITION_TOKENS, JOINED = 8 << 20, 64
#: Share of its capacity below which a container is packed again.
UNDERFILLED = 0.98
#: Texts of mean size, about, that are put into a container by their size and not by their source.
CLOSING = 4
#: Rows that one window function orders at most, when sums go over all partitions.
RADIX = 1024
#: Bits of a container's number that tell it from others of its partition.
_PART_BITS = 30


def text_sizes(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(id, source, size): tokens are the bytes of the UTF-8 form; null and empty texts need no room and are left out."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.octet_length(text).cast("long").alias("size"))
    return rows.where(F.col("size") > 0)


class Queues:
    """Sources with their texts, and what each is behind its share."""

    def __init__(self, sources: list[str], sizes: list[int], target: dict[str, float], carry: dict[str, float]) -> None:
        names = sorted({*sources, *target})
        number = {s: n for n, s in enumerate(names)}
        self.of = [number[s] for s in sources]
        self.every = sorted((z, n) for n, z in enumerate(sizes))
        self.queues: list[list[tuple[int, int]]] = [[] for _ in names]
        for z, n in self.every:
            self.queues[self.of[n]].append((z, n))
        self.least = np.array([q[0][0] if q else np.inf for q in self.queues], float)
        self.target = np.array([target.get(s, 0.0) for s in names])
        self.behind = np.array([carry.get(s, 0.0) for s in names])
        self.closing = CLOSING * sum(sizes) / max(1, len(sizes))
        self.left, self.taken = len(sizes), 0

    def take(self, entry: tuple[int, int]) -> tuple[int, int]:
        source = self.of[entry[1]]
        queue = self.queues[source]
        del queue[bisect_left(queue, entry)]
        del self.every[bisect_left(self.every, entry)]
        self.least[source] = queue[0][0] if queue else np.inf
        self.behind[source] -= entry[0]
        self.left -= 1
        self.taken += 1
        return entry

    def next(self, room: int, first: bool) -> tuple[int, int] | None:
        """(size, item) for that much room in a container, None if nothing fits."""
        behind = np.where(self.least <= room, self.behind, -np.inf)
        source = int(behind.argmax())
        if behind[source] == -np.inf:
            return None
        queue = self.queues[source]
        fit = bisect_right(queue, (room, self.left + self.taken))
        if room > self.closing:
            return self.take(queue[(self.taken * 2654435761 >> 7) % fit])  # any of those that fit, the same on every run
        entry = queue[fit - 1]
        if not first:
            largest = self.every[bisect_right(self.every, (room, self.left + self.taken)) - 1]
            entry = largest if largest[0] > entry[0] else entry
        return self.take(entry)

    def credit(self, tokens: float) -> None:
        self.behind += self.target * tokens


def pack(sources: list[str], sizes: list[int], capacity: int, target: dict[str, float], carry: dict[str, float]) -> list[int]:
    """The container of each text; none of the sizes is larger than the capacity."""
    queues = Queues(sources, sizes, target, carry)
    container = [0] * len(sizes)
    n = 0
    while queues.left:
        room = capacity
        while room and (found := queues.next(room, room == capacity)):
            room -= found[0]
            container[found[1]] = n
        queues.credit(capacity - room)
        n += 1
    return container


_PLACED = "budget_id int, part long, container long, capacity long, filled long, id long, piece int, start long, size long, source string"


def _packed(first: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.lexsort((table["start"].to_numpy(), table["size"].to_numpy(), table["id"].to_numpy()))))  # the same on every run
        capacity = table["capacity"][0].as_py()
        ids, size, start, piece = (table[c].to_numpy() for c in ("id", "size", "start", "piece"))
        source = np.array(table["source"].to_pylist(), object)
        target = dict(zip(source.tolist(), table["target"].to_pylist()))
        carry = dict(zip(source.tolist(), table["carry"].to_pylist()))
        # what exceeds the capacity is cut into pieces that fill containers of their own, and a rest
        whole = np.where(size > capacity, size // capacity, 0)
        rest = size - whole * capacity
        of = np.repeat(np.arange(len(size)), whole)
        number = np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)
        for s, t in zip(source[of].tolist(), [capacity] * len(of)):
            carry[s] -= t
        for s in target:
            carry[s] += target[s] * capacity * len(of)
        loose = np.nonzero(rest > 0)[0]
        container = np.array(pack(source[loose].tolist(), rest[loose].tolist(), capacity, target, carry), np.int64)
        filled = np.bincount(container, weights=rest[loose]).astype(np.int64)[container] if len(loose) else container
        at = np.concatenate([loose, of])
        n = int(container.max(initial=-1)) + 1
        part = table["part"][0].as_py()
        fixed = lambda x, kind: pa.array(np.full(len(at), x), kind)
        return pa.table({
            "budget_id": fixed(table["budget_id"][0].as_py(), pa.int32()), "part": fixed(part, pa.int64()),
            "container": pa.array(first + (part << _PART_BITS) + np.concatenate([container, n + np.arange(len(of))])), "capacity": fixed(capacity, pa.int64()),
            "filled": pa.array(np.concatenate([filled, np.full(len(of), capacity, np.int64)])), "id": pa.array(ids[at]),
            "piece": pa.array(np.concatenate([piece[loose] + whole[loose], number]).astype(np.int32)),
                "start": pa.array(np.concatenate([start[loose] + whole[loose] * capacity, number * capacity])),
            "size": pa.array(np.concatenate([rest[loose], np.full(len(of), capacity, np.int64)])), "source": pa.array(source[at].tolist(), pa.string()),
        })

    return run


def sums_before(df: DataFrame, keys: list[str], at: str, value: str, most: int, radix: int = RADIX) -> DataFrame:
    """`df` with `before`: the sum of `value` over the rows of the same keys with a smaller `at`.

    `at` is below `most` and comes once for each combination of keys. Sums go in levels, so no window orders more than
    `radix` rows, however many partitions there are.
    """
    if most <= radix:
        earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("before", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    block, inner, outer = (f"{at}_{x}" for x in ("block", "inner", "outer"))
    blocked = df.withColumn(block, F.floor(F.col(at) / radix).cast("long"))
    earlier = Window.partitionBy(*keys, block).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    own = blocked.withColumn(inner, F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    totals = blocked.groupBy(*keys, block).agg(F.sum(value).alias(value))
    above = sums_before(totals, keys, block, value, -(-most // radix), radix).select(*keys, block, F.col("before").alias(outer))
    return own.join(above, [*keys, block]).withColumn("before", F.col(inner) + F.col(outer)).drop(block, inner, outer)


def _carries(held: DataFrame, goal: DataFrame, parts: int) -> DataFrame:
    """(part, source, target, carry): what each source is behind before each partition, from (part, source, held)."""
    given = sums_before(held, ["source"], "part", "held", parts).select("part", "source", F.col("before").alias("given"))
    whole = held.groupBy("part").agg(F.sum("held").alias("held"))
    passed = sums_before(whole, [], "part", "held", parts).select("part", F.col("before").alias("passed"))
    target = F.coalesce("target", F.lit(0.0))
    return given.join(passed, "part").join(goal, "source", "left").select("part", "source", target.alias("target"), (target * F.col("passed") - F.col("given")).alias("carry"))


def pack_texts(docs: DataFrame, key: str, text: str, source: str, budgets: list[tuple[int, int]], shares: dict[str, float] | None = None,
    partition_tokens: int = PARTITION_TOKENS) -> DataFrame:
    """(budget_id, container, capacity, filled, id, piece, start, size, source): where each text of a budget lies.

    `budgets` are (budget_id, capacity) pairs. A text of at most the capacity is one piece; a larger one is cut into
    pieces of the capacity, which fill containers of their own, and a rest that is packed like a text; `start` and
    `size` are in bytes. `shares` gives each source's share of tokens, by default its share of all tokens; a source
    without one comes when nothing else fits. Null and empty texts have no row, an empty table gives none. A null
    source is a source of its own. Rows that repeat an id are texts of their own.
    """
    spark = docs.sparkSession
    if any(c < 1 for _, c in budgets):
        raise ValueError("capacities must be positive")
    checkpoint_dir(spark)
    sized = text_sizes(docs, key, text, source)
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // partition_tokens))
    sizes = sized.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).checkpoint()

    held = sizes.groupBy("part", "source").agg(F.sum("size").alias("held"))
    if shares is None:
        goal = held.groupBy("source").agg((F.sum("held") / F.lit(float(max(total, 1)))).alias("target"))
    else:
        scale = sum(shares.values()) or 1.0
        goal = spark.createDataFrame([(s, x / scale) for s, x in shares.items()] or [("", 0.0)], "source string, target double")
    each = F.array(*[F.struct(F.lit(b).cast("int").alias("budget_id"), F.lit(c).cast("long").alias("capacity")) for b, c in budgets])
    start = [F.lit(0).cast("int").alias("piece"), F.lit(0).cast("long").alias("start")]
    wide = sizes.join(_carries(held, goal, parts), ["part", "source"]).select("part", "source", "target", "carry", F.col("id").cast("long").alias("id"), "size",
        *start, F.explode(each).alias("b"))
    packed = wide.select("*", "b.*").drop("b").groupBy("budget_id", "part").applyInArrow(_packed(0), _PLACED).checkpoint()

    joined = F.shiftright("part", JOINED.bit_length() - 1).alias("part")
    good = F.col("filled") >= F.col("capacity") * UNDERFILLED
    kept = packed.where(good).groupBy("budget_id", joined, "source").agg(F.sum("size").alias("kept"))
    all_kept = kept.groupBy("budget_id", "part").agg(F.sum("kept").alias("all_kept"))
    before = _carries(held.groupBy(joined, "source").agg(F.sum("held").alias("held")), goal, -(-parts // JOINED))
    loose = packed.where(~good).withColumn("part", joined).join(before, ["part", "source"])
    loose = loose.join(all_kept, ["budget_id", "part"], "left").join(kept, ["budget_id", "part", "source"], "left")
    carry = F.col("carry") + F.col("target") * F.coalesce("all_kept", F.lit(0)) - F.coalesce("kept", F.lit(0))
    again = loose.select("budget_id", "part", "capacity", "id", "piece", "start", "size", "source", "target", carry.alias("carry"))
    repacked = again.groupBy("budget_id", "part").applyInArrow(_packed(1 << 60), _PLACED)
    placed = packed.where(good).unionByName(repacked)
    return placed.select("budget_id", "container", "capacity", "filled", "id", "piece", "start", "size", "source")


def packing_report(placed: DataFrame) -> DataFrame:
    """Per budget: containers, tokens, the fullest container, pieces, the share of room used, and the mixture.

    `mean_distance` and `p90_distance` tell how far containers are from the mixture of all tokens: the share of a
    container's tokens that would have to be of other sources, on average and for nine in ten (to 0.0001). What is
    placed is written to the checkpoint folder, as it is read several times.
    """
    checkpoint_dir(placed.sparkSession)
    placed = placed.checkpoint()
    parts = placed.groupBy("budget_id", "capacity", "container", "source").agg(F.sum("size").alias("tokens"), F.count("*").alias("pieces"))
    sources = placed.groupBy("budget_id", "source").agg(F.sum("size").alias("held"))
    goal = sources.join(sources.groupBy("budget_id").agg(F.sum("held").alias("all")), "budget_id").select("budget_id", "source", (F.col("held") / F.col("all")).alias("target"))
    filled = parts.groupBy("budget_id", "container").agg(F.sum("tokens").alias("filled"))
    off = F.greatest(F.col("tokens") / F.col("filled") - F.col("target"), F.lit(0.0))
    per = parts.join(filled, ["budget_id", "container"]).join(goal, ["budget_id", "source"]).groupBy("budget_id", "capacity",
        "container").agg(F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), F.sum(off).alias("distance"))
    room = F.count("*") * F.col("capacity")
    return per.groupBy("budget_id", "capacity").agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.sum("pieces").alias("pieces"),
        (F.sum("tokens") / room).alias("used"), F.avg("distance").alias("mean_distance"), F.percentile_approx("distance", 0.9, 10_000).alias("p90_distance"),
    )
