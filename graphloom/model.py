"""The typed property graph: one node a key, a directed multigraph of typed edges, and its schema.

``nodes(id, name, kind, seq)`` has the latest row of each key; ``edges(src, dst, metaedge, weight, evidence, seq)`` has
the latest delivery of each (source, metaedge, target), its endpoints being nodes. ``seq`` is the order of entry and
breaks every tie. Orientation is a parameter of each operator, never a property of the graph.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.session import cut, table

#: Forward metaedges and their reverse codes; relations of a kind to itself have none.
REVERSE = {
    "AeG": "GeA", "AuG": "GuA", "AdG": "GdA", "DaG": "GaD", "DuG": "GuD", "DdG": "GdD", "CtD": "DtC", "CuG": "GuC", "CdG": "GdC", "CbG": "GbC",
    "DlA": "AlD", "DpS": "SpD", "CcSE": "SEcC", "GpBP": "BPpG", "GpMF": "MFpG", "GpCC": "CCpG", "GpPW": "PWpG", "PCiC": "CiPC",
}
#: Default score, damping of similarity, penalty by depth and bonus of a metaedge.
DEFAULT_SCORE, SIMILAR, SIMILAR_FACTOR = 2.5, ("DrD", "CrC"), 0.6
DEPTH_PENALTY, DEEP_PENALTY = {1: 1.0, 2: 0.7, 3: 0.5}, 0.3
BONUS = {1.2: ("AeG", "GiG", "GpBP", "DaG", "CtD"), 1.1: ("Gr>G", "GpPW", "CbG")}
BACKWARD_FACTOR = 0.8


def latest_nodes(rows: DataFrame) -> DataFrame:
    """The latest row of each key."""
    last = rows.where("id is not null").groupBy("id").agg(F.max(F.struct("node_row", "name", "kind")).alias("m"))
    return last.select("id", "m.name", F.coalesce("m.kind", F.lit("Unknown")).alias("kind"), F.col("m.node_row").alias("seq"))


def collapse(rows: DataFrame) -> DataFrame:
    """The latest delivery of each (src, metaedge, dst)."""
    last = rows.where("source is not null and target is not null").groupBy(F.col("source").alias("src"), "metaedge", F.col("target").alias("dst")).agg(F.max(F.struct("edge_id", "weight", "evidence_count")).alias("m"))
    return last.select("src", "dst", "metaedge", F.coalesce("m.weight", F.lit(1.0)).alias("weight"), F.col("m.evidence_count").cast("bigint").alias("evidence"), F.col("m.edge_id").alias("seq"))


def referential(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose endpoints are both nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


@dataclass
class PropertyGraph:
    """Nodes, edges and the schema table (metaedge, src_kind, verb, dst_kind, base_score)."""

    nodes: DataFrame
    edges: DataFrame
    schema: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, d: str) -> PropertyGraph:
        nodes = latest_nodes(table(spark, d, "graph_nodes"))
        return cls(nodes, referential(collapse(table(spark, d, "graph_edges")), nodes), table(spark, d, "metaedges"))

    @cached_property
    def kept(self) -> PropertyGraph:
        """The same graph with its views written once, for operators that read them many times."""
        return PropertyGraph(cut(self.nodes), cut(self.edges), self.schema)


def oriented(edges: DataFrame, orientation: str = "out") -> DataFrame:
    """(src, dst, metaedge, weight, seq, backward) as walked: along the edges, against them or both ways."""
    out = edges.select("src", "dst", "metaedge", "weight", "seq", F.lit(False).alias("backward"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "metaedge", "weight", "seq", F.lit(True).alias("backward"))
    if orientation == "out":
        return out
    if orientation == "in":
        return back
    if orientation == "both":
        return out.unionByName(back)
    raise ValueError(f"orientation {orientation!r} is none of out, in, both")


def depth_penalty(depth: Column) -> Column:
    """What a hit loses with its distance."""
    col = F.when(depth == 1, DEPTH_PENALTY[1])
    for k in (2, 3):
        col = col.when(depth == k, DEPTH_PENALTY[k])
    return col.otherwise(DEEP_PENALTY)


def metaedge_score(metaedge: Column, base: Column, depth: Column) -> Column:
    """Base score of a metaedge, damped for similarity, times depth penalty and bonus."""
    bonus = F.lit(1.0)
    for factor, codes in BONUS.items():
        bonus = F.when(metaedge.isin(*codes), factor).otherwise(bonus)
    return F.coalesce(base, F.lit(DEFAULT_SCORE)) * F.when(metaedge.isin(*SIMILAR), SIMILAR_FACTOR).otherwise(1.0) * depth_penalty(depth) * bonus


#: SQL of the same views, for the oracles.
GRAPH_SQL = """
N AS (SELECT id, name, coalesce(kind, 'Unknown') AS kind, seq FROM (SELECT id, name, kind, node_row AS seq, row_number() OVER (PARTITION BY id ORDER BY node_row DESC) AS rn FROM graph_nodes WHERE id IS NOT NULL) WHERE rn = 1),
E AS (SELECT source AS src, target AS dst, metaedge, coalesce(weight, 1.0) AS weight, CAST(evidence_count AS BIGINT) AS evidence, edge_id AS seq
  FROM (SELECT *, row_number() OVER (PARTITION BY source, metaedge, target ORDER BY edge_id DESC) AS rn FROM graph_edges WHERE source IS NOT NULL AND target IS NOT NULL)
  WHERE rn = 1 AND source IN (SELECT id FROM N) AND target IN (SELECT id FROM N))
"""
SCORE_SQL = """(coalesce(m.base_score, 2.5) * CASE WHEN {e}.metaedge IN ('DrD','CrC') THEN 0.6 ELSE 1.0 END
  * CASE {d} WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 WHEN 3 THEN 0.5 ELSE 0.3 END
  * CASE WHEN {e}.metaedge IN ('AeG','GiG','GpBP','DaG','CtD') THEN 1.2 WHEN {e}.metaedge IN ('Gr>G','GpPW','CbG') THEN 1.1 ELSE 1.0 END)"""
