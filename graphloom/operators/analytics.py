"""Iterative graph analytics; each round reads its state several times, so it is written once a round.

Lineage stays short, and an executor may be lost: the written state is in the shared checkpoint folder.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from graphloom.operators.stats import degrees, undirected
from graphloom.operators.traverse import seeded_bfs
from graphloom.session import cut, discard, measured


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, alpha: float = 0.85, tolerance: float | None = None, start: DataFrame | None = None) -> DataFrame:
    """(id, rank) over parallel edges among ``nodes``; what dangling nodes hold is spread evenly.

    With a ``tolerance`` it ends when the ranks move by less than ``n * tolerance`` in all, otherwise after ``rounds``.
    ``start(id)``: the nodes to which jumps lead, all by default. A round joins the state with the links, whose shares
    were written once, and sums contributions and old state by node in one exchange; what dangling nodes hold and how
    far the ranks moved is measured while the state is written.
    """
    ids = cut(nodes.select("id").distinct(), F.count(F.lit(1)).alias("n"))
    n = measured(ids)["n"]
    if n == 0:
        return ids.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = cut(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).join(out, "src").select("src", "dst", (F.col("m") / F.col("out")).alias("share")))
    if start is None:
        jump = ids.select("id", F.lit(1.0 / n).alias("jump"))
    else:
        chosen = cut(start.select("id").distinct().join(ids, "id", "left_semi"), F.count(F.lit(1)).alias("n"))
        jump = ids.join(chosen.withColumn("jump", F.lit(1.0 / max(1, measured(chosen)["n"]))), "id", "left").select("id", F.coalesce("jump", F.lit(0.0)).alias("jump"))
    dangling = links.select(F.col("src").alias("id")).distinct().withColumn("held", F.lit(0.0))
    measures = (F.coalesce(F.sum(F.col("rank") * F.col("held")), F.lit(0.0)).alias("lost"), F.coalesce(F.sum(F.abs(F.col("rank") - F.col("old"))), F.lit(0.0)).alias("moved"))
    first = jump.join(dangling, "id", "left").select("id", "jump", F.coalesce("held", F.lit(1.0)).alias("held"), F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("old"))
    state = cut(first, *measures)
    for _ in range(rounds):
        got = links.join(state.select(F.col("id").alias("src"), "rank"), "src").select(F.col("dst").alias("id"), (F.col("rank") * F.col("share")).alias("in"), *[F.lit(None).cast("double").alias(c) for c in ("jump", "held", "old")])
        rows = got.unionByName(state.select("id", F.lit(0.0).alias("in"), "jump", "held", F.col("rank").alias("old")))
        new = rows.groupBy("id").agg(F.sum("in").alias("in"), *[F.max(c).alias(c) for c in ("jump", "held", "old")])
        lost = measured(state)["lost"]
        nxt = cut(new.select("id", "jump", "held", ((1 - alpha) * F.col("jump") + alpha * (F.col("in") + lost * F.col("jump"))).alias("rank"), "old"), *measures)
        discard(state)
        state = nxt
        if tolerance is not None and measured(state)["moved"] < n * tolerance:
            break
    return state.select("id", "rank")


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, centrality): degree over the number of other nodes."""
    n = nodes.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("k"))
    d = nodes.select("id").join(degrees(edges), "id", "left").withColumn("k", F.lit(1)).join(F.broadcast(n), "k")
    return d.select("id", F.coalesce(F.try_divide(F.coalesce("degree", F.lit(0)).cast("double"), F.col("n") - 1), F.lit(0.0)).alias("centrality"))


def closeness(edges: DataFrame, nodes: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, closeness) of ``targets(id)`` by the distances that lead to them, scaled by the share that can reach them."""
    n = nodes.count()
    d = seeded_bfs(edges, targets, max_depth, "in").where("depth > 0").groupBy(F.col("seed").alias("id")).agg(F.count(F.lit(1)).alias("r"), F.sum("depth").alias("total"))
    return targets.select("id").distinct().join(d, "id", "left").select("id", F.coalesce((F.col("r") / F.col("total")) * (F.col("r") / F.lit(max(1, n - 1))), F.lit(0.0)).alias("closeness"))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label): synchronous rounds; each node takes the most frequent label around it, the least of equals."""
    e = undirected(edges)
    both = cut(e.select(F.col("u").alias("id"), F.col("v").alias("nb")).unionByName(e.select(F.col("v").alias("id"), F.col("u").alias("nb"))))
    state = cut(nodes.select("id").distinct().select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        votes = both.join(state.select(F.col("id").alias("nb"), "label"), "nb").groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
        # A node's own label stands with no votes, so it stays only where there are no neighbours.
        best = votes.unionByName(state.select("id", "label", F.lit(0).cast("bigint").alias("n"))).groupBy("id").agg(F.min(F.struct(-F.col("n"), "label")).alias("m"))
        nxt = cut(best.select("id", "m.label"))
        discard(state)
        state = nxt
    return state


def eigenvector(nodes: DataFrame, edges: DataFrame, rounds: int = 20, scale_every: int = 5) -> DataFrame:
    """(id, value): power iteration of A + I over incoming edges; scaled to unit length every few rounds and at the end."""
    links = cut(edges.select("src", "dst").distinct())
    state = cut(nodes.select("id").distinct().withColumn("x", F.lit(1.0)))
    for i in range(1, rounds + 1):
        got = links.join(state.select(F.col("id").alias("src"), "x"), "src").select(F.col("dst").alias("id"), "x")
        new = got.unionByName(state).groupBy("id").agg(F.sum("x").alias("x"))
        nxt = cut(new.join(nodes.select("id").distinct(), "id", "left_semi"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
        discard(state)
        state = nxt
        if i % scale_every == 0 or i == rounds:
            scaled = cut(state.select("id", F.coalesce(F.try_divide("x", F.lit(measured(state)["size"])), F.lit(0.0)).alias("x")))
            discard(state)
            state = scaled
    return state.select("id", F.col("x").alias("value"))


def betweenness(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, betweenness) from the given sources: shares of shortest paths, accumulated level by level (Brandes).

    One level-synchronous walk of all sources at once gives distances and path counts, and the dependencies come from the
    levels in reverse, so neither holds a graph in one task. A level is kept with its counts; nodes seen before are
    dropped from the next.
    """
    steps = cut(edges.where("src <> dst").select("src", "dst").distinct())
    levels = [cut(sources.select("id").distinct().select(F.col("id").alias("seed"), "id", F.lit(1.0).alias("paths")))]
    seen = levels[0].select("seed", "id")
    for d in count(1) if max_depth is None else range(1, max_depth + 1):
        reach = levels[-1].select("seed", F.col("id").alias("src"), "paths").join(steps, "src").groupBy("seed", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        level = cut(reach.join(seen, ["seed", "id"], "left_anti"), F.count(F.lit(1)).alias("n"))
        if not measured(level)["n"]:
            break
        levels.append(level)
        seen = seen.unionByName(level.select("seed", "id"))
        if d % 16 == 0:
            seen = cut(seen)
    below = levels[-1].withColumn("dep", F.lit(0.0))
    total = below.select("seed", "id", "dep")
    for level in reversed(levels[:-1]):
        part = level.select("seed", F.col("id").alias("src"), F.col("paths").alias("mine")).join(steps, "src").join(below.select("seed", F.col("id").alias("dst"), "paths", "dep"), ["seed", "dst"])
        dep = part.groupBy("seed", F.col("src").alias("id")).agg(F.sum(F.col("mine") / F.col("paths") * (1 + F.col("dep"))).alias("dep"))
        below = cut(level.join(dep, ["seed", "id"], "left").select("seed", "id", "paths", F.coalesce("dep", F.lit(0.0)).alias("dep")))
        total = total.unionByName(below.select("seed", "id", "dep"))
    return total.where("seed <> id").groupBy("id").agg(F.sum("dep").alias("betweenness"))


def _moved(both: DataFrame, ids: DataFrame, rounds: int, resolution: float) -> DataFrame:
    """(id, c): local moving over ``both(id, nb, w)``, a graph given both ways with weights and loops.

    In round ``i`` only nodes of one half (by hash and round) move, so that neighbours don't swap; each goes to the
    neighbouring community of the largest gain, the least key of equals, if that beats its own.
    """
    deg = cut(both.groupBy("id").agg(F.sum("w").alias("k")), F.sum("k").alias("m"))
    two_m = measured(deg)["m"]
    state = cut(ids.select("id").distinct().select("id", F.col("id").alias("c")))
    if not two_m:
        return state
    for i in range(rounds):
        mass = state.join(deg, "id").groupBy("c").agg(F.sum("k").alias("mass"))
        links = both.where("id <> nb").join(state.select(F.col("id").alias("nb"), "c"), "nb").groupBy("id", "c").agg(F.sum("w").alias("w"))
        own = state.select("id", F.col("c").alias("mine"))
        scored = links.join(deg, "id").join(mass, "c").join(own, "id")
        gain = F.col("w") - resolution * F.col("k") * (F.col("mass") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0)) / two_m
        scored = scored.select("id", "c", "mine", F.round(gain, 9).alias("gain"))
        best = scored.groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("g"), "c")).alias("b"), F.max(F.when(F.col("c") == F.col("mine"), F.col("gain"))).alias("stay"))
        moves = best.select("id", F.col("b.c").alias("to"), (-F.col("b.g")).alias("top"), "stay").where(F.col("top") > F.coalesce("stay", F.lit(0.0)))
        moves = moves.where(F.pmod(F.xxhash64("id", F.lit(i // 2)), F.lit(2)) == i % 2).select("id", "to")
        nxt = cut(state.join(moves, "id", "left").select("id", F.coalesce("to", "c").alias("c")))
        discard(state)
        state = nxt
    return state


def _weighted(edges: DataFrame) -> DataFrame:
    e = undirected(edges).withColumn("w", F.lit(1.0))
    return cut(e.select(F.col("u").alias("id"), F.col("v").alias("nb"), "w").unionByName(e.select(F.col("v").alias("id"), F.col("u").alias("nb"), "w")))


def modularity_communities(nodes: DataFrame, edges: DataFrame, rounds: int = 4, resolution: float = 1.0) -> DataFrame:
    """(id, community): synchronous local moving by modularity gain, one level."""
    return _moved(_weighted(edges), nodes, rounds, resolution).select("id", F.col("c").alias("community"))


def louvain(nodes: DataFrame, edges: DataFrame, levels: int = 3, rounds: int = 8, resolution: float = 1.0) -> DataFrame:
    """(id, community): local moving, then the same over communities as nodes, level by level while any of them join."""
    both, ids = _weighted(edges), nodes.select("id").distinct()
    found = cut(ids.select("id", F.col("id").alias("community")))
    for _ in range(levels):
        state = _moved(both, ids, rounds, resolution)
        ids = cut(state.select(F.col("c").alias("id")).distinct(), F.count(F.lit(1)).alias("n"))
        joined = state.where("id <> c").isEmpty()
        found = cut(found.join(state.select(F.col("id").alias("community"), "c"), "community").select("id", F.col("c").alias("community")))
        if joined:
            break
        a, b = state.select("id", F.col("c").alias("x")), state.select(F.col("id").alias("nb"), F.col("c").alias("y"))
        both = cut(both.join(a, "id").join(b, "nb").groupBy(F.col("x").alias("id"), F.col("y").alias("nb")).agg(F.sum("w").alias("w")))
    return found


def prune(nodes: DataFrame, edges: DataFrame, rounds: int = 3, centrality: float = 0.1, confidence: float = 0.6) -> DataFrame:
    """Edges that stay: each round keeps those whose ends are central on average or whose weight is above a bound."""
    e = edges
    for _ in range(rounds):
        c = degree_centrality(nodes, e)
        e = cut(
            e.join(c.select(F.col("id").alias("src"), F.col("centrality").alias("a")), "src")
            .join(c.select(F.col("id").alias("dst"), F.col("centrality").alias("b")), "dst")
            .where(((F.col("a") + F.col("b")) / 2 > centrality) | (F.col("weight") > confidence))
            .select(edges.columns)
        )
    return e


def mean_distance(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, orientation: str = "both") -> DataFrame:
    """One row: pairs reached, mean distance and largest distance from the given sources."""
    d = seeded_bfs(edges, sources, max_depth, orientation).where("depth > 0")
    return d.agg(F.count(F.lit(1)).alias("pairs"), F.avg("depth").alias("mean_distance"), F.max("depth").alias("diameter"))


def distance_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row over all pairs of a graph, taken without direction: pairs reached, mean and largest distance, connected."""
    d = seeded_bfs(edges, nodes, None, "both")
    n = nodes.select("id").distinct().count()
    one = d.agg(F.count(F.when(F.col("depth") > 0, 1)).alias("pairs"), F.avg(F.when(F.col("depth") > 0, F.col("depth"))).alias("mean_distance"), F.max("depth").alias("diameter"), F.count(F.lit(1)).alias("all"))
    return one.select("pairs", "mean_distance", "diameter", (F.col("all") == n * n).alias("connected"))
