"""Traversal and paths: level-synchronous loops whose levels are written once, so no level is computed twice."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.model import oriented
from graphloom.operators.expand import capped, induced
from graphloom.session import cut, discard, measured


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None, orientation: str = "out", cap: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """(id, depth) of all nodes within ``max_depth`` steps of any seed, or of all that are reached.

    ``cap`` limits the edges a node is left by. With ``max_nodes`` no further level is entered once so many nodes are
    found, and of the last level the first by id are kept.
    """
    steps = oriented(edges, orientation).where("src <> dst").select("src", "dst", "seq")
    if cap is not None:
        steps = cut(capped(steps, ["src"], ["seq", "dst"], cap))
    steps = steps.select("src", "dst")
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)), F.count(F.lit(1)).alias("n"))
    frontier, found = seen, measured(seen)["n"]
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        if max_nodes is not None and found >= max_nodes:
            break
        nxt = steps.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        new = nxt.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth))
        if max_nodes is not None:
            new = new.orderBy("id").limit(max_nodes - found)
        frontier = cut(new, F.count(F.lit(1)).alias("n"))
        if not measured(frontier)["n"]:
            break
        found += measured(frontier)["n"]
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:  # long walks: the plan stays small
            seen = cut(seen)
    return seen


def seeded_bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None, orientation: str = "out") -> DataFrame:
    """(seed, id, depth): the distances of every node from each seed on its own; without a depth, of all that are reached."""
    steps = oriented(edges, orientation).where("src <> dst").select("src", "dst")
    seen = cut(seeds.select("id").distinct().select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")))
    frontier = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        nxt = frontier.select("seed", F.col("id").alias("src")).join(steps, "src").select("seed", F.col("dst").alias("id")).distinct()
        frontier = cut(nxt.join(seen, ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth)), F.count(F.lit(1)).alias("n"))
        if not measured(frontier)["n"]:
            break
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:
            seen = cut(seen)
    return seen


def weighted_distances(costs: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(id, depth, cost): the cheapest path from any seed over ``costs(src, dst, cost)`` of at most ``max_hops`` edges.

    Rounds improve costs from the nodes that changed last, until nothing changes; ``depth`` is the edges of that path.
    """
    best = cut(seeds.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(0.0).alias("cost"), F.lit(0).alias("round")), F.count(F.lit(1)).alias("n"))
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        last = best.where(F.col("round") == hop - 1).select(F.col("id").alias("src"), F.col("depth").alias("d"), F.col("cost").alias("c"))
        step = costs.join(last, "src").select(F.col("dst").alias("id"), (F.col("d") + 1).alias("depth"), F.round(F.col("c") + F.col("cost"), 9).alias("cost"), F.lit(hop).alias("round"))
        new = best.unionByName(step).groupBy("id").agg(F.min(F.struct("cost", "round", "depth")).alias("m")).select("id", "m.depth", "m.cost", "m.round")
        nxt = cut(new, F.count(F.when(F.col("round") == hop, 1)).alias("n"))
        discard(best)
        best = nxt
        if not measured(best)["n"]:
            break
    return best.select("id", "depth", "cost")


def ego(edges: DataFrame, seeds: DataFrame, max_depth: int, orientation: str = "both", cap: int | None = None) -> DataFrame:
    """The edges among all nodes near the seeds."""
    return induced(edges, bfs(edges, seeds, max_depth, orientation, cap))


def simple_paths(edges: DataFrame, seeds: DataFrame, max_hops: int, orientation: str = "out", allow: list[str] | None = None, deny: list[str] = (), cap: int | None = None, extend: Column | None = None) -> DataFrame:
    """(start, path, metas, hops): paths without a repeated node, of 1 to ``max_hops`` edges.

    A denied metaedge is never walked and an empty ``allow`` allows all others. ``cap`` bounds how many paths of a
    length may start at a seed, taken by the order of entry of their edges. ``extend`` is a condition on (metas, path).
    """
    e = oriented(edges, orientation).select(F.col("src").alias("end"), F.col("dst").alias("next"), "metaedge", "seq")
    if deny:
        e = e.where(~F.col("metaedge").isin(list(deny)))
    if allow:
        e = e.where(F.col("metaedge").isin(allow))
    level = seeds.select("id").distinct().select(F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("path"), F.array().cast("array<string>").alias("metas"), F.array().cast("array<bigint>").alias("seqs"))
    found = []
    for hop in range(1, max_hops + 1):
        grown = level.join(e, "end").where(~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("end"), F.concat("path", F.array("next")).alias("path"), F.concat("metas", F.array("metaedge")).alias("metas"), F.concat("seqs", F.array("seq")).alias("seqs"))
        if extend is not None:
            grown = grown.where(extend)
        if cap is not None:
            grown = capped(grown, ["start"], ["seqs", "path"], cap)
        level = cut(grown) if hop < max_hops else grown
        found.append(level.withColumn("hops", F.lit(hop)))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select("start", "end", "path", "metas", "seqs", "hops")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int, orientation: str = "out", k: int | None = None) -> DataFrame:
    """(s, t, path, hops): all shortest paths of each pair (s, t) up to ``max_depth`` edges, the first ``k`` by path.

    The search goes from both ends to the middle, so neither side spreads over more than half of the depth; paths are
    then walked from the middle to both ends over nodes whose distance falls by one at every step.
    """
    ahead = (max_depth + 1) // 2
    back = {"out": "in", "in": "out"}.get(orientation, "both")
    wanted = pairs.where("s <> t").select("s", "t").distinct()
    fore = cut(seeded_bfs(edges, wanted.select(F.col("s").alias("id")), ahead, orientation).select(F.col("seed").alias("s"), "id", F.col("depth").alias("i")))
    aft = cut(seeded_bfs(edges, wanted.select(F.col("t").alias("id")), max_depth - ahead, back).select(F.col("seed").alias("t"), "id", F.col("depth").alias("j")))
    met = fore.join(aft, "id").join(wanted, ["s", "t"])
    best = met.groupBy("s", "t").agg(F.min(F.col("i") + F.col("j")).alias("hops"))
    # One middle a path: the node at which the forward search ends.
    level = cut(met.join(best, ["s", "t"]).where((F.col("i") == F.least("hops", F.lit(ahead))) & (F.col("i") + F.col("j") == F.col("hops"))).select("s", "t", "hops", "i", "j", "id", F.array("id").alias("path")))
    steps = oriented(edges, orientation).where("src <> dst").select("src", "dst")

    def walked(level: DataFrame, near: DataFrame, side: str, at: str, into: DataFrame, front: bool, most: int) -> DataFrame:
        done = level.where(F.col(at) == 0)
        for left in range(most, 0, -1):
            now = level.where(F.col(at) == left).withColumnRenamed("id", "here")
            path = F.concat(F.array("id"), "path") if front else F.concat("path", F.array("id"))
            nxt = now.drop(at).join(into, "here").join(near.where(F.col(at) == left - 1).select(side, "id", at), [side, "id"])
            level = cut(level.where(F.col(at) < left).unionByName(nxt.select("s", "t", "hops", "i", "j", "id", path.alias("path")).distinct()))
            done = level
        return done

    to_s = walked(level, fore, "s", "i", steps.select(F.col("dst").alias("here"), F.col("src").alias("id")), True, ahead)
    mid = to_s.withColumn("id", F.element_at("path", -1))
    both = walked(mid, aft, "t", "j", steps.select(F.col("src").alias("here"), F.col("dst").alias("id")), False, max_depth - ahead)
    out = both.select("s", "t", "path", "hops")
    return out if k is None else capped(out, ["s", "t"], ["path"], k)


def k_simple_paths(edges: DataFrame, pairs: DataFrame, k: int, max_hops: int, orientation: str = "out") -> DataFrame:
    """(s, t, path, hops, rank): the ``k`` shortest simple paths of each pair within ``max_hops``; ties by path."""
    # Only nodes that can still reach a target in time are walked.
    back = "in" if orientation == "out" else "out" if orientation == "in" else "both"
    near = cut(seeded_bfs(edges, pairs.select(F.col("t").alias("id")), max_hops, back).select(F.col("seed").alias("t"), F.col("id").alias("end"), F.col("depth").alias("left")))
    steps = oriented(edges, orientation).where("src <> dst").select(F.col("src").alias("end"), F.col("dst").alias("next")).distinct()
    level = pairs.where("s <> t").select("s", "t", F.col("s").alias("end"), F.array("s").alias("path"))
    found = None
    for hop in range(1, max_hops + 1):
        grown = level.join(steps, "end").where(~F.array_contains("path", F.col("next"))).select("s", "t", F.col("next").alias("end"), F.concat("path", F.array("next")).alias("path"))
        level = cut(grown.join(near, ["t", "end"]).where(F.col("left") <= max_hops - hop).drop("left"))
        ended = level.where("end = t").select("s", "t", "path", F.lit(hop).alias("hops"))
        found = ended if found is None else found.unionByName(ended)
        level = level.where("end <> t")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("s", "t").orderBy("hops", "path")))
    return ranked.where(F.col("rank") <= k)


def pattern_paths(edges: DataFrame, seeds: DataFrame, pattern: list[str], orientation: str = "both") -> DataFrame:
    """(start, end, path): paths that follow a sequence of metaedges, none visiting a node twice."""
    rows = seeds.select("id").distinct().select(F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("path"))
    for code in pattern:
        e = oriented(edges.where(F.col("metaedge") == code), orientation).select(F.col("src").alias("end"), F.col("dst").alias("next")).distinct()
        rows = rows.join(e, "end").where(~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("end"), F.concat("path", F.array("next")).alias("path"))
    return rows


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the least key of each weakly connected component.

    Alternating large-star and small-star rounds; every round moves edges towards the least key, so the number of
    rounds grows with the logarithm of the longest path, and a hub's edges are never held by one task.
    """
    same = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"))
    pairs = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), *same)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        nxt = cut(small.where("u <> v").distinct(), *same)
        if measured(nxt) == measured(pairs):  # rows and hash are those of the round before
            break
        discard(pairs)
        pairs = nxt
    return nodes.select("id").join(pairs.select(F.col("u").alias("id"), F.col("v").alias("c")), "id", "left").select("id", F.coalesce("c", "id").alias("component"))


def dfs(edges: DataFrame, seeds: DataFrame, max_depth: int, orientation: str = "out", metaedges: list[str] | None = None) -> DataFrame:
    """(start, id, depth, ord): depth-first preorder from each seed, edges in order of entry, nodes visited once.

    The order of a depth-first walk is sequential by nature: one task walks the neighbourhood of one seed, as far as
    ``max_depth - 1`` steps lead, of which it keeps the distinct steps. ``metaedges`` limits the edges walked.
    """
    if metaedges is not None:
        edges = edges.where(F.col("metaedge").isin(metaedges))
    near = seeded_bfs(edges, seeds, max_depth - 1 if max_depth > 0 else 0, orientation)
    e = near.select("seed", F.col("id").alias("src")).join(oriented(edges, orientation).select("src", "dst", "seq"), "src", "left").groupBy("seed", "src", "dst").agg(F.min("seq").alias("seq"))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        start = part.seed.iloc[0]
        order = part[part.dst.notna()].sort_values(["seq", "dst"])
        nxt: dict[str, list[str]] = {}
        for a, b in zip(order.src, order.dst):
            nxt.setdefault(a, []).append(b)
        seen, rows, stack = {start}, [(start, start, 0)], [(start, iter(nxt.get(start, ())), 0)]
        while stack:
            _, it, depth = stack[-1]
            b = next((x for x in it if x not in seen), None) if depth < max_depth else None
            if b is None:
                stack.pop()
                continue
            seen.add(b)
            rows.append((start, b, depth + 1))
            stack.append((b, iter(nxt.get(b, ())), depth + 1))
        return pd.DataFrame([(*r, i) for i, r in enumerate(rows)], columns=["start", "id", "depth", "ord"])

    return e.groupBy("seed").applyInPandas(walk, "start string, id string, depth int, ord int")
