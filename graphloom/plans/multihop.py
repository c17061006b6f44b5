"""Questions of several steps: metaedge patterns walked from seeds, and questions with fixed scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from graphloom.model import BACKWARD_FACTOR, DEFAULT_SCORE, REVERSE, PropertyGraph, depth_penalty, metaedge_score, oriented
from graphloom.operators import scores as C, traverse as T
from graphloom.plans import intent as I
from graphloom.session import cut

_FORWARD = {back: code for code, back in REVERSE.items()}


def question_patterns(question: str) -> tuple[tuple[str, ...], ...]:
    """Patterns of metaedges by the type of one question, none for other types."""
    q = question.lower()
    for name, a, b in I.COMPLEX:
        if any(w in q for w in a) and any(w in q for w in b):
            return I.PATTERNS.get(name, ())
    kind, codes = next(((n, set(ms)) for n, ps, ms in I.RULES if any(p in q for p in ps)), ("general", set()))
    for name, one, other in I.COMPLEX_EDGES:
        if codes & set(one) and codes & set(other):
            return I.PATTERNS.get(name, ())
    return I.PATTERNS.get(kind, ())


def pattern_ends(edges: DataFrame, seeds: DataFrame, pattern: tuple[str, ...]) -> DataFrame:
    """(start, end, path, metas) over a pattern; reverse codes walk their edge backwards."""
    rows = seeds.select("id").distinct().select(F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("path"))
    for code in pattern:
        way = "in" if code in _FORWARD else "out"
        e = oriented(edges.where(F.col("metaedge") == _FORWARD.get(code, code)), way).select(F.col("src").alias("end"), F.col("dst").alias("next")).distinct()
        rows = rows.join(e, "end").where(~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("end"), F.concat("path", F.array("next")).alias("path"))
    return rows.withColumn("metas", F.array(*[F.lit(c) for c in pattern]))


def multi_hop(g: PropertyGraph, seeds: DataFrame, question: str) -> DataFrame:
    """(id, depth, score): the best score of each end over all patterns of a question."""
    patterns = question_patterns(question)
    if not patterns:
        return seeds.select("id", F.lit(0).alias("depth"), F.lit(0.0).alias("score")).where("false")
    ends = [pattern_ends(g.edges, seeds, p).select(F.col("end").alias("id"), F.size("metas").alias("depth"), C.pattern_score(F.array(*[F.lit(c) for c in p]), F.col("metas")).alias("score")) for p in patterns]
    return reduce(DataFrame.unionByName, ends).groupBy("id").agg(F.min("depth").alias("depth"), F.round(F.max("score"), 6).alias("score"))


def _best(hits: DataFrame) -> DataFrame:
    return hits.groupBy("id").agg(F.min_by("depth", F.struct(-F.round("score", 9), "depth")).alias("depth"), F.round(F.max("score"), 6).alias("score"))


def expression_hits(g: PropertyGraph, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """(id, depth, score): genes that tissues express, by fixed scores; farther ones by a walk over expression edges."""
    codes = list(C.EXPRESSION_SCORES)
    e = oriented(g.edges.where(F.col("metaedge").isin(codes)), "both").join(seeds.select(F.col("id").alias("src")), "src", "left_semi")
    value = F.lit(0.0)
    for code, (ahead, back) in C.EXPRESSION_SCORES.items():
        value = F.when(F.col("metaedge") == code, F.when(F.col("backward"), back).otherwise(ahead)).otherwise(value)
    near = e.select(F.col("dst").alias("id"), F.lit(1).alias("depth"), value.alias("score"))
    far = T.dfs(g.edges, seeds, max_depth, metaedges=["AeG"]).where("depth > 0").select("id", "depth", (C.FAR_EXPRESSION / F.col("depth")).alias("score"))
    return _best(near.unionByName(far).join(g.nodes.where("kind = 'Gene'").select("id"), "id", "left_semi"))


def gene_disease_hits(g: PropertyGraph, genes: DataFrame, words: tuple[str, ...] = I.CANCER_WORDS[:3], max_depth: int = 2) -> DataFrame:
    """(id, depth, score): genes that are asked for and diseases around them, more where their names hold one of the words."""
    named = F.lit(False)
    for w in words:
        named = named | F.coalesce(F.lower("name").contains(w), F.lit(False))
    diseases = g.nodes.where("kind = 'Disease'").select("id", named.alias("named"))
    e = oriented(g.edges, "both").join(genes.select(F.col("id").alias("src")), "src", "left_semi").withColumnRenamed("dst", "id").join(diseases, "id").join(F.broadcast(g.schema.select("metaedge", "base_score")), "metaedge", "left")
    score = metaedge_score(F.col("metaedge"), F.col("base_score"), F.lit(1)) * F.when(F.col("named"), C.NEAR_CANCER).otherwise(1.0) * F.when(F.col("backward"), BACKWARD_FACTOR).otherwise(1.0)
    core = genes.select("id", F.lit(0).alias("depth"), F.lit(C.CORE_GENE).alias("score"))
    far = cut(T.dfs(g.edges, genes, max_depth).where("depth > 0").select("id", "depth")).join(diseases, "id")
    far = far.select("id", "depth", (DEFAULT_SCORE * depth_penalty(F.col("depth")) * F.when(F.col("named"), C.FAR_CANCER).otherwise(1.0) / F.col("depth")).alias("score"))
    return _best(core.unionByName(e.select("id", F.lit(1).alias("depth"), score.alias("score"))).unionByName(far))
