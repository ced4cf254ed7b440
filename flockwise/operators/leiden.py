"""Communities by the Leiden method (Traag, Waltman and van Eck 2019).

A level moves nodes to neighbouring communities while modularity grows, refines each community from single nodes into
connected parts, and makes these parts the nodes of the next level, which begins from the communities found. Connected
components are found first. While a component's graph has more edges than a task should hold, its levels are joins and
aggregates over the whole graph, in rounds in which a hashed share of the nodes moves at once; the graph of parts that
fits a task is finished there, node by node. Communities are cut into their connected parts at the end. The objective
is modularity with a resolution. Labels are the smallest node id of the community.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.operators.pagerank import undirected
from flockwise.session import Scratch, checkpoint_dir
from flockwise.settings import Settings

#: Directed edges of a component that are finished in one task.
LOCAL_EDGES = 2_000_000
#: A level's rounds end when fewer than one node in so many has moved.
STILL_MOVING = 1000


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that can be reached, edges taken both ways.

    Labels take the least label around and then jump to their label's label, which halves paths each round, until no
    label changes; each round is checkpointed. Minima are combined before the shuffle, so hubs are no hot keys.
    """
    checkpoint_dir(nodes.sparkSession)
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct().checkpoint()
    labels = nodes.select("id").distinct().withColumn("component", F.col("id")).checkpoint()
    while True:
        around = both.join(labels, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("component").alias("_m"))
        moved = labels.join(around, F.col("id") == F.col("src"), "left").select("id", F.col("component").alias("_old"),
            F.least("component", F.coalesce("_m", "component")).alias("component"))
        up = labels.select(F.col("id").alias("_c"), F.col("component").alias("_up"))
        jumped = moved.join(up, F.col("component") == F.col("_c"), "left").select("id", "_old",
            F.least("component", F.coalesce("_up", "component")).alias("component")).checkpoint()
        labels = jumped.select("id", "component")
        if jumped.where("_old <> component").isEmpty():
            return labels


def _adjacency(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((dst, src))
    starts = np.searchsorted(src[order], np.arange(n + 1))
    return starts, dst[order], w[order]


def _moved(n: int, starts, dst, w, strength, total: float, gamma: float, label: np.ndarray, within: np.ndarray | None) -> bool:
    """Moves nodes while modularity grows; with `within`, only singletons, and only inside their community."""
    mass = np.bincount(label, weights=strength, minlength=n)
    count = np.bincount(label, minlength=n)
    queue, waiting, changed = list(range(n)), np.ones(n, bool), False
    at = 0
    while at < len(queue):
        v = queue[at]
        at += 1
        waiting[v] = False
        own = label[v]
        if within is not None and count[own] > 1:
            continue
        links: dict[int, float] = {}
        for e in range(starts[v], starts[v + 1]):
            u = dst[e]
            if u != v and (within is None or within[u] == within[v]):
                links[label[u]] = links.get(label[u], 0.0) + w[e]
        k = strength[v]
        stay = links.get(own, 0.0) - gamma * k * (mass[own] - k) / total
        best, gain = own, stay + 1e-12
        for c in sorted(links):
            g = links[c] - gamma * k * (mass[c] - (k if c == own else 0)) / total
            if g > gain:
                best, gain = c, g
        if best != own:
            mass[own] -= k
            mass[best] += k
            count[own] -= 1
            count[best] += 1
            label[v] = best
            changed = True
            if within is None:
                for e in range(starts[v], starts[v + 1]):
                    u = dst[e]
                    if label[u] != best and not waiting[u]:
                        waiting[u] = True
                        queue.append(u)
    return changed


def leiden_local(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, total: float, gamma: float, levels: int, start: np.ndarray | None = None) -> np.ndarray:
    """Community of each of n nodes; edges are given both ways, `total` is the weight of the whole graph, both ways.

    A loop holds the weight inside a node, both ways. `start` gives communities to begin from, single nodes by default.
    """
    member = np.arange(n)
    strength = np.bincount(src, weights=w, minlength=n)
    label = np.arange(n) if start is None else np.unique(start, return_inverse=True)[1]
    size = n
    for _ in range(levels):
        starts, d, ww = _adjacency(size, src, dst, w)
        changed = _moved(size, starts, d, ww, strength, total, gamma, label, None)
        fine = np.arange(size)
        _moved(size, starts, d, ww, strength, total, gamma, fine, label)
        _, fine = np.unique(fine, return_inverse=True)
        groups = int(fine.max(initial=-1)) + 1
        if groups == size or not changed:
            break
        coarse = np.zeros(groups, np.int64)
        coarse[fine] = label
        member = fine[member]
        key = fine[src] * groups + fine[dst]
        pairs, inverse = np.unique(key, return_inverse=True)
        w = np.bincount(inverse, weights=w)
        src, dst = pairs // groups, pairs % groups
        strength = np.bincount(fine, weights=strength, minlength=groups)
        _, label = np.unique(coarse, return_inverse=True)
        size = groups
    return label[member]


def _quality(label: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, total: float, gamma: float) -> float:
    """What the nodes of these edges add to modularity."""
    mass = np.bincount(label[src], weights=w)
    return float(w[label[src] == label[dst]].sum() / total - gamma * ((mass / total) ** 2).sum())


def _solved(gamma: float, levels: int, total: float):
    def run(table: pa.Table) -> pa.Table:
        a, b, w = table["src"].to_numpy(), table["dst"].to_numpy(), table["weight"].to_numpy()
        ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        start = np.zeros(len(ids), np.int64)
        start[inverse[: len(a)]] = table["community"].to_numpy()
        src, dst = inverse[: len(a)], inverse[len(a) :]
        label = leiden_local(len(ids), src, dst, w, total, gamma, levels)
        if len(np.unique(start)) < len(ids):  # parts of an earlier level may do better from its communities
            other = leiden_local(len(ids), src, dst, w, total, gamma, levels, start)
            label = max(label, other, key=lambda x: _quality(x, src, dst, w, total, gamma))
        least = np.full(int(label.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        return pa.table({"id": ids, "community": least[label]})

    return run


def _round(edges: DataFrame, state: DataFrame, total: float, gamma: float, number: int, refining: bool) -> DataFrame:
    """`state` (id, k, within, community) after one round, with `moved`.

    A share of the nodes, by hash, goes to the neighbouring community of the largest gain. When refining, only single
    nodes go, to communities inside their `within`, and never to a single node that may go itself, so what has
    come together stays connected.
    """
    share = 2 + number // 8  # fewer move at once when many rounds were needed, so moves no longer cross
    turn = lambda c: F.pmod(F.xxhash64(c, F.lit(number)), F.lit(share)) == 0
    mass = state.groupBy("community").agg(F.sum("k").alias("m"), F.count("*").alias("n"))
    there = state.select(F.col("id").alias("dst"), F.col("community").alias("c"), F.col("within").alias("w2"))
    near = edges.where("src <> dst").join(there, "dst")
    if refining:
        near = near.join(state.select(F.col("id").alias("src"), "within"), "src").where("within = w2")
    links = near.groupBy("src", "c").agg(F.sum("weight").alias("l"))
    stay = state.select(F.col("id").alias("src"), F.col("community").alias("c"), F.lit(0.0).alias("l"))
    both = links.unionByName(stay).groupBy("src", "c").agg(F.sum("l").alias("l"))
    met = both.join(mass.withColumnRenamed("community", "c"), "c").join(state.withColumnRenamed("id", "src"), "src")
    own = F.col("c") == F.col("community")
    gain = F.col("l") - F.lit(gamma / total) * F.col("k") * (F.col("m") - F.when(own, F.col("k")).otherwise(0.0))
    # two single nodes don't change places: the one of the larger label goes
    allowed = (F.col("n") > 1) | (~turn("c") if refining else (F.col("c") < F.col("community")))
    alone = F.max(F.when(own, F.col("n")))
    best = met.groupBy("src").agg(
        F.max(F.when(~own & allowed, F.struct(gain.alias("g"), (-F.col("c")).alias("c")))).alias("b"),
            F.max(F.when(~own, F.struct(gain.alias("g"), (-F.col("c")).alias("c")))).alias("any"),
        F.max(F.when(own, gain)).alias("stay"), alone.alias("n"), F.first("k").alias("k"), F.first("within").alias("within"), F.first("community").alias("community"),
    )
    if refining:
        goes = (F.col("n") == 1) & turn("src") & (F.col("b.g") > F.col("stay") + 1e-12)
        to = -F.col("b.c")
    else:
        to = -F.when(F.col("n") == 1, F.col("b.c")).otherwise(F.col("any.c"))
        goes = turn("src") & (F.when(F.col("n") == 1, F.col("b.g")).otherwise(F.col("any.g")) > F.col("stay") + 1e-12)
    goes = F.coalesce(goes, F.lit(False))
    return best.select(F.col("src").alias("id"), "k", "within", F.when(goes, to).otherwise(F.col("community")).alias("community"), goes.alias("moved"))


def _settled(scratch: Scratch, edges: DataFrame, state: DataFrame, nodes: int, total: float, gamma: float, refining: bool) -> DataFrame:
    """`state` after rounds until (almost) nothing moves in as many of them as give every node its turn."""
    number, still = 0, 0
    while still < 2 + number // 8:
        state = scratch.cut(_round(edges, state, total, gamma, number, refining), "refined" if refining else "moved")
        moved = state.where("moved").count()
        state = state.drop("moved")
        still = still + 1 if moved * STILL_MOVING < nodes or not moved else 0
        number += 1
    return state


def _spread_levels(large: DataFrame, part: DataFrame, total: float, gamma: float, levels: int, local_edges: int) -> DataFrame:
    """(id, community) of components that are too large for a task; `large` holds their edges both ways."""
    scratch = Scratch(large.sparkSession)
    edges = scratch.cut(large, "edges")
    state = edges.groupBy("src").agg(F.sum("weight").alias("k")).select(F.col("src").alias("id"), "k", F.col("src").alias("within"), F.col("src").alias("community"))
    state = scratch.cut(state, "state")
    member = state.select("id", F.col("id").alias("node"))
    nodes = state.count()
    for level in range(levels):
        state = _settled(scratch, edges, state, nodes, total, gamma, False)
        fine = state.select("id", "k", F.col("community").alias("within"), F.col("id").alias("community"))
        fine = _settled(scratch, edges, fine, nodes, total, gamma, True)
        to = fine.select("id", F.col("community").alias("to"))
        groups = scratch.cut(fine.groupBy("community").agg(F.sum("k").alias("k"), F.min("within").alias("within")), "groups")
        count = groups.count()
        if count == nodes:
            break
        edges = edges.join(to.withColumnRenamed("id", "src"), "src").withColumn("src", F.col("to")).drop("to").join(to.withColumnRenamed("id", "dst"), "dst")
        edges = scratch.cut(edges.groupBy("src", F.col("to").alias("dst")).agg(F.sum("weight").alias("weight")), "edges")
        member = scratch.cut(member.join(to.withColumnRenamed("id", "node"), "node").select("id", F.col("to").alias("node")), "member")
        nodes = count
        state = groups.select(F.col("community").alias("id"), "k", "within", F.col("within").alias("community"))
        placed = edges.join(part.select(F.col("id").alias("src"), "component"), "src")
        if placed.groupBy("component").count().where(F.col("count") > local_edges).isEmpty():
            begin = placed.join(state.select(F.col("id").alias("src"), "community"), "src").select("component", "src", "dst", "weight", "community")
            state = begin.groupBy("component").applyInArrow(_solved(gamma, levels - level, total), "id long, community long")
            break
    # nodes that a later level has left in the wrong community go once more
    first = large.groupBy("src").agg(F.sum("weight").alias("k")).withColumnRenamed("src", "id")
    found = member.join(state.select(F.col("id").alias("node"), "community"), "node").select("id", "community").join(first, "id")
    found = scratch.cut(found.select("id", "k", F.col("community").alias("within"), "community"), "found")
    found = _settled(scratch, large, found, found.count(), total, gamma, False).select("id", "community").checkpoint()
    scratch.drop()
    return found


def leiden(nodes: DataFrame, edges: DataFrame, s: Settings, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, community) of every node; nodes without edges are communities of their own.

    Without any edge all nodes are in community 0; without nodes there are no rows. Edges are taken both ways, parallel
    ones add up.
    """
    checkpoint_dir(nodes.sparkSession)
    ids = nodes.select("id").distinct()
    both = undirected(edges).where(F.col("weight") > 0).select("src", "dst", F.col("weight").cast("double").alias("weight")).checkpoint()
    total = both.agg(F.sum("weight").alias("t")).first()["t"]
    if not total:
        return ids.withColumn("community", F.lit(0).cast("bigint"))
    part = components(both.select(F.col("src").alias("id")).distinct(), both)
    placed = both.join(part.select(F.col("id").alias("src"), "component"), "src").checkpoint()
    sizes = placed.groupBy("component").agg(F.count("*").alias("n")).checkpoint()
    small = placed.join(sizes.where(F.col("n") <= local_edges), "component").select("component", "src", "dst", "weight", F.col("src").alias("community"))
    found = small.groupBy("component").applyInArrow(_solved(s.leiden_resolution, s.leiden_levels, total), "id long, community long")
    if not sizes.where(F.col("n") > local_edges).isEmpty():
        large = placed.join(sizes.where(F.col("n") > local_edges), "component").select("src", "dst", "weight").checkpoint()
        found = found.unionByName(_spread_levels(large, part, total, s.leiden_resolution, s.leiden_levels, local_edges))
        found = connected(both, found)
    return ids.join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def connected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, community): communities cut into their connected parts, labelled by their smallest id."""
    inside = edges.join(labels.select(F.col("id").alias("src"), F.col("community").alias("c1")),
        "src").join(labels.select(F.col("id").alias("dst"), F.col("community").alias("c2")), "dst").where("c1 = c2")
    return components(labels.select("id"), inside).withColumnRenamed("component", "community")


def modularity(edges: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(communities, modularity) of labelled nodes; one row. Loops are left out, edges taken both ways."""
    both = undirected(edges)
    a = labels.select(F.col("id").alias("src"), F.col("community").alias("c1"))
    b = labels.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    per = both.join(a, "src").join(b, "dst").groupBy("c1").agg(F.sum(F.when(F.col("c1") == F.col("c2"), F.col("weight")).otherwise(0.0)).alias("inside"),
        F.sum("weight").alias("k"))
    total = both.agg(F.sum("weight").alias("t")).scalar()
    q = F.sum(F.col("inside") / total - F.lit(gamma) * (F.col("k") / total) * (F.col("k") / total))
    return per.agg(q.alias("modularity")).select(labels.agg(F.count_distinct("community").alias("n")).scalar().alias("communities"),
        F.coalesce("modularity", F.lit(0.0)).alias("modularity"))
