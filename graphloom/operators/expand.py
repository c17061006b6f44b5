"""One-hop operators: expansion from seeds, induced subgraphs, enrichment and metaedge chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.model import BACKWARD_FACTOR, PropertyGraph, metaedge_score, oriented
from graphloom.session import cut


def expand(g: PropertyGraph, seeds: DataFrame, metaedges: list[str] | None = None, orientation: str = "out") -> DataFrame:
    """(id, name, kind, depth, score) of the neighbours of ``seeds(id)``: the best score of each, backward edges damped."""
    e = oriented(g.edges, orientation)
    if metaedges is not None:
        e = e.where(F.col("metaedge").isin(metaedges))
    hits = e.join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(F.broadcast(g.schema.select("metaedge", "base_score")), "metaedge", "left")
    score = metaedge_score(F.col("metaedge"), F.col("base_score"), F.lit(1)) * F.when(F.col("backward"), BACKWARD_FACTOR).otherwise(1.0)
    best = hits.groupBy(F.col("dst").alias("id")).agg(F.max(score).alias("score"))
    return best.join(g.nodes, "id").select("id", "name", "kind", F.lit(1).alias("depth"), F.round("score", 6).alias("score"))


def top_hits(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits; ties by id."""
    return hits.orderBy(F.desc("score"), "id").limit(k)


def neighbors(g: PropertyGraph, seeds: DataFrame, kind: str | None = None, orientation: str = "out") -> DataFrame:
    """(src, id, name, kind) of the distinct neighbours of each seed, of one kind if given."""
    e = oriented(g.edges, orientation).join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    n = g.nodes if kind is None else g.nodes.where(F.col("kind") == kind)
    return e.select("src", F.col("dst").alias("id")).distinct().join(n, "id").select("src", "id", "name", "kind")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both endpoints in ``ids(id)``."""
    keys = ids.select("id").distinct()
    return edges.join(keys.withColumnRenamed("id", "src"), "src", "left_semi").join(keys.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def forward_pairs(edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """(src, dst) edges between ``ranked(id, rank)`` nodes that lead from a better to a worse rank."""
    a, b = ranked.select(F.col("id").alias("src"), F.col("rank").alias("i")), ranked.select(F.col("id").alias("dst"), F.col("rank").alias("j"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("i < j").select("src", "dst")


def enrich(edges: DataFrame, nodes: DataFrame, schema: DataFrame) -> DataFrame:
    """Edges with the names and kinds of their ends and a readable relation; what is unknown stays as key or code."""
    s, t = nodes.select(F.col("id").alias("src"), F.col("name").alias("src_name"), F.col("kind").alias("src_kind_")), nodes.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"), F.col("kind").alias("dst_kind_"))
    e = edges.join(s, "src", "left").join(t, "dst", "left").join(F.broadcast(schema.select("metaedge", "verb")), "metaedge", "left")
    return e.select("src", "metaedge", "dst", F.concat_ws(" ", F.coalesce("src_name", "src"), F.coalesce("verb", "metaedge"), F.coalesce("dst_name", "dst")).alias("sentence"), F.coalesce("src_kind_", F.lit("Unknown")).alias("src_kind"), F.coalesce("dst_kind_", F.lit("Unknown")).alias("dst_kind"))


def capped(rows: DataFrame, keys: list[str], order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each group."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= cap).drop("__rn")


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with ``place``, their number within the key by order, without a task that holds a hot key.

    Rows are range partitioned below the key, numbered within each stretch, and moved on by what the stretches before
    hold of the key; there are at most (keys + partitions) such counts.
    """
    part = rows.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("__part", F.spark_partition_id())
    part = cut(part)
    counts = part.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy(*keys, "__part").orderBy(*order))
    both = part.withColumn("__rn", place).join(counts.withColumn("__before", before).drop("__n"), [*keys, "__part"])
    return both.withColumn("place", (F.col("__rn") + F.col("__before")).cast("int")).drop("__part", "__rn", "__before")


def chain(g: PropertyGraph, start_kind: str, steps: list[tuple[str, str, int | None]]) -> DataFrame:
    """Paths n0..nk that begin at nodes of a kind and follow (metaedge, orientation, cap per reached node) steps.

    The cap keeps, for each node reached so far, its first edges in order of entry.
    """
    rows = g.nodes.where(F.col("kind") == start_kind).select(F.col("id").alias("n0"))
    for i, (code, orientation, cap) in enumerate(steps):
        e = oriented(g.edges.where(F.col("metaedge") == code), orientation).select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}"), "seq")
        if cap is not None:
            e = capped(e, [f"n{i}"], ["seq"], cap)
        rows = rows.join(e.drop("seq"), f"n{i}")
    return rows.select(*[f"n{i}" for i in range(len(steps) + 1)])
