"""Graph statistics: histograms, degrees, density, clustering, distances, connection strength, inverted indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def histogram(df: DataFrame, col: str) -> DataFrame:
    """(value, n) of one column."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, out_degree, in_degree); both ends of an edge count, summed before the ends are brought together."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts and the three usual densities; a graph of fewer than two nodes has density 0."""
    n, m = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.lit(1).alias("k")), edges.agg(F.count(F.lit(1)).alias("n_edges"), F.lit(1).alias("k"))
    one, x, e = n.join(F.broadcast(m), "k"), F.col("n_nodes").cast("double"), F.col("n_edges").cast("double")
    safe = lambda c: F.coalesce(F.try_divide(*c), F.lit(0.0))
    return one.select("n_nodes", "n_edges", safe((e, x * (x - 1))).alias("directed"), safe((2 * e, x * (x - 1))).alias("undirected"), safe((e, 2 * x * (x - 1))).alias("multigraph"), safe((2 * e, x)).alias("average_degree"))


def strength(edges: DataFrame) -> DataFrame:
    """(id, strength): summed weight of the edges that leave a node."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("strength"))


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v) pairs with u < v, each once."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles). Every edge points from the end of lower degree to the other, so no node leads to many wedges."""
    e = undirected(edges)
    deg = e.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    both = e.join(deg.select(F.col("id").alias("u"), F.col("d").alias("du")), "u").join(deg.select(F.col("id").alias("v"), F.col("d").alias("dv")), "v")
    low = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    way = both.select(F.when(low, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedge = way.alias("x").join(way.alias("y"), F.col("x.a") == F.col("y.a")).where(F.col("x.b") < F.col("y.b")).select(F.col("x.a").alias("a"), F.col("x.b").alias("u"), F.col("y.b").alias("v"))
    closed = wedge.join(e, ["u", "v"])
    return closed.select(F.explode(F.array("a", "u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, clustering): closed share of the pairs of a node's neighbours; 0 for fewer than two."""
    e = undirected(edges)
    deg = e.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    both = nodes.select("id").join(deg, "id", "left").join(triangles(edges), "id", "left")
    return both.select("id", F.coalesce(F.when(F.col("d") > 1, 2.0 * F.coalesce("triangles", F.lit(0)) / (F.col("d") * (F.col("d") - 1))), F.lit(0.0)).alias("clustering"))


def inverted(df: DataFrame, value: str, key: str) -> DataFrame:
    """(value, n, first_keys): how many keys hold a value, with the first of them as samples."""
    return df.groupBy(F.col(value).alias("value")).agg(F.countDistinct(key).alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def samples(df: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """(group, key) of the first ``k`` keys of each group."""
    from graphloom.operators.expand import capped

    return capped(df.select(group, key).distinct(), [group], [key], k)


def info(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of nodes, edges, kinds and metaedges and whether any edge has a weight other than 0."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("kind").alias("n_kinds"), F.lit(1).alias("k"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("metaedge").alias("n_metaedges"), F.bool_or(F.col("weight") != 0).alias("weighted"), F.lit(1).alias("k"))
    return n.join(F.broadcast(e), "k").drop("k")


def rollup(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by both columns, by the first and over all."""
    return df.rollup(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def ratio(part: Column, whole: Column) -> Column:
    """Share, 0 of nothing."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def answer_quality(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of ``hits(id, score)``: how many, their mean score, and distinct edges among them for each hit."""
    from graphloom.operators.expand import induced

    m = induced(edges, hits).select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("m"), F.lit(1).alias("k"))
    h = hits.agg(F.count(F.lit(1)).alias("n_hits"), F.avg("score").alias("mean_score"), F.lit(1).alias("k"))
    return h.join(F.broadcast(m), "k").select("n_hits", "mean_score", ratio(F.col("m"), F.col("n_hits")).alias("density"))


def without_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that an edge touches."""
    return nodes.join(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")
