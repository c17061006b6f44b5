"""A question from words to answer: tokens, bound nodes, retrieval, context."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from graphloom.functions.text import STOP_EN, STOP_FA
from graphloom.model import PropertyGraph
from graphloom.operators.expand import enrich, induced
from graphloom.plans import match as Q, retrieve as V
from graphloom.plans.context import render
from graphloom.session import cut

#: Words that ask.
ASKING = ("what", "which", "who", "how", "where", "why", "when", "does", "do", "did", "can")


def keywords(question: str) -> list[str]:
    """Distinct words of a question in order, without stop words, asking words and single characters."""
    words = re.findall(r"[\w-]+", question)
    drop = {*STOP_EN, *STOP_FA, *ASKING}
    return list(dict.fromkeys(w for w in words if len(w) > 1 and w.lower() not in drop))


def bound(g: PropertyGraph, question: str) -> DataFrame:
    """(token, id, stage, seq): the words of a question that nodes were found for."""
    tokens = g.nodes.sparkSession.createDataFrame([(w,) for w in keywords(question)], "token string")
    return Q.cascade(tokens, g.nodes)


def contained(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """(token, id): nodes whose names hold a token or lie in it, in any case."""
    names = Q._Names(cut(nodes))
    t = cut(tokens.select("token", F.lower("token").alias("lt")).where("lt <> ''").distinct())
    return names.holders(t.select("token", F.array("lt").alias("held"))).unionByName(names.held_by(t)).select("token", "id").distinct()


def process(g: PropertyGraph, question: str, method: str = "intelligent", k: int = 10, style: str = "simple") -> DataFrame:
    """(id, name, kind, depth, score, context): the best hits of a question with their sentences among the hits and seeds."""
    seeds = cut(bound(g, question).select("id").distinct())
    hits = cut(V.retrieve(method, g, seeds, k, question))
    among = induced(g.edges, hits.select("id").unionByName(seeds))
    said = enrich(among, g.nodes, g.schema)
    ends = said.select("src", "metaedge", "sentence").unionByName(said.select(F.col("dst").alias("src"), "metaedge", "sentence")).distinct()
    text = render(ends, "src", 5, style)
    return hits.join(text.withColumnRenamed("src", "id"), "id", "left")


def compare(g: PropertyGraph, question: str, a: str, b: str, k: int = 10) -> DataFrame:
    """One row: hits of two methods on one question, of both, and their shared part."""
    seeds = cut(bound(g, question).select("id").distinct())
    x, y = (V.retrieve(m, g, seeds, k, question).select("id", F.lit(1).alias(c)) for m, c in ((a, "in_a"), (b, "in_b")))
    both = x.join(y, "id", "full").agg(F.count("in_a").alias("hits_a"), F.count("in_b").alias("hits_b"), F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1)).alias("shared"))
    return both.withColumn("overlap", F.coalesce(F.try_divide("shared", F.col("hits_a") + F.col("hits_b") - F.col("shared")), F.lit(0.0)))
