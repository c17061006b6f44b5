"""Ranking and fusion of hits: deduplication, quotas, multi-method merges, path and node scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Weights of the methods in the ensemble, of the parts of a path's rank and of the fused score.
ENSEMBLE = {"BFS": 1.0, "DFS": 0.8, "NEIGHBORS": 0.9}
RANK_WEIGHTS = {"match": 0.35, "strength": 0.25, "fit": 0.20, "hop": 0.10, "hub": 0.05, "diversity": 0.05}
HOP_SCORE, HOP_REST = {1: 1.0, 2: 0.8, 3: 0.6}, 0.4
FUSION = {"similarity": 0.45, "pagerank": 0.35, "schema": 0.20, "hub": 0.10, "core": 1.0}


def best_per_key(hits: DataFrame, key: str = "id", score: str = "score", tie: str = "seq") -> DataFrame:
    """The hit of the largest score of each key; the first by ``tie`` of equals."""
    rest = [c for c in hits.columns if c != key]
    best = hits.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(tie))).alias("m"))
    return best.select(key, *[F.col(f"m.{c}").alias(c) for c in rest])


def merge_methods(parts: dict[str, DataFrame]) -> DataFrame:
    """(id, depth, methods, n_methods, score) of hits (id, depth) by method: least depth, 1 + 0.5 for every further method."""
    hits = reduce(DataFrame.unionByName, [p.select("id", "depth", F.lit(m).alias("method")) for m, p in parts.items()])
    each = hits.groupBy("id", "method").agg(F.min("depth").alias("depth"))
    out = each.groupBy("id").agg(F.min("depth").alias("depth"), F.array_join(F.array_sort(F.collect_list("method")), "+").alias("methods"), F.count(F.lit(1)).alias("n_methods"))
    return out.withColumn("score", 1 + 0.5 * (F.col("n_methods") - 1))


def ensemble(parts: dict[str, DataFrame], weights: dict[str, float] = ENSEMBLE) -> DataFrame:
    """(id, n_methods, score): weights over depth + 1 summed, raised by a tenth for each method."""
    hits = reduce(DataFrame.unionByName, [p.select("id", "depth", F.lit(m).alias("method"), F.lit(weights[m]).alias("w")) for m, p in parts.items()])
    each = hits.groupBy("id", "method", "w").agg(F.min("depth").alias("depth"))
    out = each.groupBy("id").agg(F.sum(F.col("w") / (F.col("depth") + 1)).alias("s"), F.count(F.lit(1)).alias("n_methods"))
    return out.select("id", "n_methods", (F.col("s") * (1 + 0.1 * F.col("n_methods"))).alias("score"))


#: Scores of the methods in the adaptive merge.
ADAPTIVE, OTHER_METHOD = {"Expression-Direct": 5.0, "Expression-Reverse": 4.5, "Expression-DFS": 4.0, "BFS": 3.5, "DFS": 3.0, "Neighbors": 2.5, "Hybrid": 2.0}, 1.0


def adaptive(hits: DataFrame) -> DataFrame:
    """(id, method, depth, score) of ``hits(id, depth, method, ord)``: the last method by ``ord`` that found a node names it."""
    out = hits.groupBy("id").agg(F.max_by("method", "ord").alias("method"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n"))
    value = F.lit(OTHER_METHOD)
    for m, v in ADAPTIVE.items():
        value = F.when(F.col("method") == m, v).otherwise(value)
    return out.select("id", "method", "depth", (value * (1 + 0.1 * F.col("n")) / (F.col("depth") + 1)).alias("score"))


def group_quota(hits: DataFrame, group: str, k: int) -> DataFrame:
    """Up to ``max(1, k // groups)`` best hits (id, score) of each group, then the best ``k`` of all."""
    sizes = hits.agg(F.greatest(F.lit(1), F.floor(F.lit(k) / F.greatest(F.countDistinct(group), F.lit(1)))).alias("quota"))
    ranked = hits.withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), "id")))
    kept = ranked.where(F.col("rn") <= k).withColumn("one", F.lit(1)).join(F.broadcast(sizes.withColumn("one", F.lit(1))), "one").where("rn <= quota")
    return kept.drop("one", "rn", "quota").orderBy(F.desc("score"), "id").limit(k)


def hop_score(hops: Column) -> Column:
    """Preference for short paths."""
    col = F.when(hops <= 1, HOP_SCORE[1])
    return col.when(hops == 2, HOP_SCORE[2]).when(hops == 3, HOP_SCORE[3]).otherwise(HOP_REST)


def rank_paths(paths: DataFrame, allow: list[str], nodes: DataFrame, edges: DataFrame, degrees: DataFrame, match: Column) -> DataFrame:
    """Rank of paths (start, end, path, metas, seqs, hops): weighted parts, and a bonus for the first path to each end.

    Strength is the mean over a path's edges of a base (1.2 for treatment, up to 1.5 by weight for covariation, else 1)
    plus 0.05 for each piece of evidence; the hub part prefers genes of low degree; ``match`` says how well a path fits
    the question.
    """
    p = paths.withColumn("pid", F.concat_ws(",", "start", F.transform("seqs", lambda x: x.cast("string"))))
    base = F.when(F.col("metaedge") == "CtD", 1.2).when(F.col("metaedge") == "GcG", 1.0 + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), "weight"))).otherwise(1.0)
    power = p.select("pid", F.explode("seqs").alias("seq")).join(edges.select("seq", (base + 0.05 * F.coalesce("evidence", F.lit(0))).alias("s")), "seq").groupBy("pid").agg(F.avg("s").alias("strength"))
    genes = nodes.where("kind = 'Gene'").select("id").join(degrees.select("id", "degree"), "id")
    hub = p.select("pid", F.explode("path").alias("id")).join(genes, "id").groupBy("pid").agg(F.avg(1.0 / (1.0 + F.log1p("degree"))).alias("hub"))
    fit = F.size(F.filter("metas", lambda m: m.isin(allow))) / F.size("metas")
    w = RANK_WEIGHTS
    value = w["match"] * match + w["strength"] * F.col("strength") + w["fit"] * fit + w["hop"] * hop_score(F.col("hops")) + w["hub"] * F.coalesce("hub", F.lit(1.0))
    scored = p.join(power, "pid").join(hub, "pid", "left").withColumn("value", F.round(value, 9))
    first = F.row_number().over(W.partitionBy("start", "end").orderBy(F.desc("value"), F.array_join("path", ">"), F.array_join("metas", ">"))) == 1
    return scored.withColumn("score", F.col("value") + F.when(first, w["diversity"]).otherwise(0.0)).drop("pid", "hub", "strength", "value")


def fuse(similarity: Column, pagerank: Column, schema: Column, hops: Column, core: Column) -> Column:
    """Fused relevance of an entity."""
    f = FUSION
    return f["similarity"] * similarity + f["pagerank"] * pagerank + f["schema"] * schema - f["hub"] * F.log1p(hops) + F.when(core, f["core"]).otherwise(0.0)
