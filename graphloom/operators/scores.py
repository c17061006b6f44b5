"""Scores of nodes, paths and patterns as Column expressions, and paths as edges and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bonus of the method that found a node, and of words in the relations of a gene.
SOURCE_BONUS, OTHER_SOURCE = {"hybrid": 2.0, "pagerank": 1.5, "semantic": 1.0}, 0.5
RELATION_BONUS = (("disease", 2.0), ("drug", 1.5), ("pathway", 1.0))
#: Scores of direct hits by (kind of the seed, kind of the hit, metaedge); the second number counts where
#: the hit is found against the edge. Farther hits of an expression question score 4 by depth, others 3 by depth.
EXPRESSION_SCORES = {"AeG": (5.0, 4.0), "AuG": (4.5, 3.5), "AdG": (4.0, 3.0)}
FAR_EXPRESSION, FAR_DISEASE, DIRECT, FAR = 4.0, 4.0, 4.0, 3.0
#: A gene that is asked for, cancers among its diseases, and cancers found farther away.
CORE_GENE, NEAR_CANCER, FAR_CANCER = 10.0, 2.0, 1.5


def pattern_score(pattern: Column, metas: Column) -> Column:
    """How well the metaedges of a path fit a pattern, less by its length."""
    whole = F.when(metas == pattern, 2.0).when(F.size(F.array_except(pattern, metas)) == 0, 1.0).otherwise(0.0)
    return (F.lit(5.0) + whole + 0.5 * F.size(metas)) / (F.size(metas) + 1)


def path_importance(n_nodes: Column, mean_degree: Column, gene_share: Column) -> Column:
    """Importance of a path: short, of connected nodes, of genes."""
    return 0.3 / n_nodes + 0.4 * mean_degree + 0.3 * gene_share


def node_importance(degree: Column, closeness: Column, gene: Column) -> Column:
    """Importance of a node by degree, closeness and kind."""
    return 0.4 * degree + 0.3 * closeness + 0.3 * F.when(gene, 1.0).otherwise(0.5)


def hybrid_score(source: Column, pagerank: Column, similarity: Column) -> Column:
    """Bonus of the finding method plus what it measured; null measures count 0."""
    bonus = F.lit(OTHER_SOURCE)
    for name, b in SOURCE_BONUS.items():
        bonus = F.when(source == name, b).otherwise(bonus)
    return bonus + F.coalesce(pagerank, F.lit(0.0)) + F.coalesce(similarity, F.lit(0.0))


def relation_bonus(relation: Column) -> Column:
    """Bonus of one relation text, 0 where no word holds."""
    r, col = F.lower(relation), F.lit(0.0)
    for word, b in reversed(RELATION_BONUS):
        col = F.when(r.contains(word), b).otherwise(col)
    return col


def biological_importance(rows: DataFrame) -> DataFrame:
    """(id, importance) of ``rows(id, nb, relation)``: a tenth for each neighbour plus the bonus of each relation."""
    each = rows.groupBy("id", "nb").agg(F.max(relation_bonus(F.col("relation"))).alias("bonus"))
    return each.groupBy("id").agg((0.1 * F.count(F.lit(1)) + F.sum("bonus")).alias("importance"))


def rank_node(gene: Column, neighbors: Column, centrality: Column) -> Column:
    """Rank of a node: 2 for genes, a tenth for each neighbour, five times the degree centrality."""
    return F.when(gene, 2.0).otherwise(0.0) + 0.1 * neighbors + 5.0 * centrality


def feature_score(features: Column, weights: dict[str, float]) -> Column:
    """Weighted sum of a map of rank features; what is missing counts 0."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * F.coalesce(F.try_element_at(features, F.lit(name)), F.lit(0.0))
    return total


def path_edges(path: Column, metas: Column) -> Column:
    """Array of (src, dst, metaedge) along a path."""
    return F.transform(metas, lambda m, i: F.struct(F.get(path, i).alias("src"), F.get(path, i + 1).alias("dst"), m.alias("metaedge")))


def path_sentence(names: Column, metas: Column) -> Column:
    """A path as text: names joined by metaedges."""
    rest = F.zip_with(metas, F.slice(names, 2, F.size(metas)), lambda m, n: F.concat(F.lit(" -["), m, F.lit("]-> "), n))
    return F.concat(F.get(names, F.lit(0)), F.array_join(rest, ""))


def named_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``paths(path, ...)`` with ``names``, the names of their nodes in order, keys where there is no name."""
    keyed = paths.withColumn("__p", F.array_join("path", "\u0001"))
    steps = keyed.select("__p", F.posexplode("path").alias("i", "id")).distinct().join(nodes.select("id", F.coalesce("name", "id").alias("n")), "id", "left")
    named = steps.groupBy("__p").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("n", "id").alias("n")))).alias("x"))
    return keyed.join(named, "__p").withColumn("names", F.transform("x", lambda s: s["n"])).drop("__p", "x")


def path_measures(paths: DataFrame, nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """``paths(path, ...)`` with importance, gene and disease shares and their sum."""
    keyed = paths.withColumn("__p", F.array_join("path", "\u0001"))
    steps = keyed.select("__p", F.posexplode("path").alias("i", "id")).distinct().join(nodes.select("id", "kind"), "id", "left").join(degrees.select("id", "degree"), "id", "left")
    share = lambda kind: F.avg(F.coalesce((F.col("kind") == kind).cast("double"), F.lit(0.0)))
    m = steps.groupBy("__p").agg(F.count(F.lit(1)).alias("n_nodes"), F.avg(F.coalesce("degree", F.lit(0))).alias("mean_degree"), share("Gene").alias("gene_share"), share("Disease").alias("disease_share"))
    out = keyed.join(m, "__p").drop("__p")
    return out.select(*paths.columns, path_importance(F.col("n_nodes"), F.col("mean_degree"), F.col("gene_share")).alias("importance"), "gene_share", "disease_share", (F.col("gene_share") + F.col("disease_share")).alias("significance"))
