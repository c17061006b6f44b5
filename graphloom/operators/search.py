"""Document search: exact nearest vectors in blocks, keyword scores, hybrid fusion, reranking, citations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

BLOCK = 4096


def vector_topk(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` nearest rows of ``base`` by cosine for each query, itself left out.

    Queries and rows are cut into blocks by hash; each pair of blocks is one matrix product that keeps its best ``k`` a
    query, and the partial results are merged. Blocks are bounded, whatever the tables hold. A null vector or one
    without length has no neighbours; equal scores rank by key.
    """
    nb, nq = max(1, -(-base.count() // block)), max(1, -(-queries.count() // block))
    vec = lambda c: F.transform(c, lambda x: x.cast("double"))
    b = base.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("key"), vec(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(nb)).alias("bb"))
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("key"), vec(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(nq)).alias("qb"))
    left = q.withColumn("bb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nb - 1).cast("bigint"))))
    right = b.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint"))))

    def unit(s: pd.Series) -> np.ndarray:
        m = np.vstack([np.asarray(x, np.float64) for x in s])
        n = np.sqrt((m * m).sum(1))
        return m / np.where(n > 0, n, np.nan)[:, None]

    def best(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "key": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if qs.empty or bs.empty:
            return out
        bs = bs.sort_values("key")
        score = np.round(unit(qs.v) @ unit(bs.v).T, 9)
        keys = bs.key.to_numpy()
        rows = []
        for i, qk in enumerate(qs.key):
            s = np.where((keys == qk) | np.isnan(score[i]), -np.inf, score[i])
            top = np.argsort(-s, kind="stable")[:k]
            rows += [(qk, keys[j], s[j]) for j in top if s[j] > -np.inf]
        return pd.DataFrame(rows, columns=["query_id", "key", "score"]) if rows else out

    parts = left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInPandas(best, "query_id bigint, key bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k)


def keyword_score(docs: DataFrame, key: str, tokens: str, terms: list[str]) -> DataFrame:
    """(key, score): share of the terms that a document's tokens hold."""
    hit = F.size(F.array_intersect(F.col(tokens), F.array(*[F.lit(t) for t in terms])))
    return docs.select(key, (hit / F.lit(max(1, len(terms)))).alias("score")).where("score > 0")


def inverse_frequency(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """(term, idf): smooth inverse document frequency over all documents."""
    n = docs.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("k"))
    df = docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.lit(1).alias("k"))
    return df.join(F.broadcast(n), "k").select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))


def bm25(docs: DataFrame, key: str, tokens: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents that hold any of the terms; frequencies count over all documents."""
    asked = F.array(*[F.lit(t) for t in sorted(set(terms))])
    stat = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens)).alias("mean"), F.lit(1).alias("k"))
    tf = docs.select(key, F.size(tokens).alias("len"), F.explode(F.filter(F.col(tokens), lambda t: F.array_contains(asked, t))).alias("term")).groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = tf.join(F.broadcast(df), "term").withColumn("k", F.lit(1)).join(F.broadcast(stat), "k")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return x.groupBy(key).agg(F.sum(part).alias("score"))


def fuse_scores(parts: list[tuple[DataFrame, float]], key: str) -> DataFrame:
    """(key, score): weighted sum of scores, each scaled by its largest; what a part lacks counts 0."""
    scaled = []
    for i, (p, w) in enumerate(parts):
        most = p.agg(F.max("score").alias("most"), F.lit(1).alias("k"))
        scaled.append(p.select(key, "score", F.lit(1).alias("k")).join(F.broadcast(most), "k").select(key, (w * F.coalesce(F.try_divide("score", "most"), F.lit(0.0))).alias("score")))
    rows = scaled[0]
    for s in scaled[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy(key).agg(F.sum("score").alias("score"))


def citations(pieces: DataFrame, sources: DataFrame, k: int = 3, least: float = 0.5, block: int = BLOCK) -> DataFrame:
    """(piece, source, score, rank) of the best ``k`` sources of each piece above a score: 0.1 shared words, 0.9 cosine.

    ``pieces(piece, words, v)`` and ``sources(source, words, v)``: every piece meets every source, in blocks as in
    ``vector_topk``. Null words count as none; a null vector or one without length has cosine 0. Equal scores rank by
    source.
    """
    nb, nq = max(1, -(-sources.count() // block)), max(1, -(-pieces.count() // block))
    row = lambda df, key, own, n: df.select(F.col(key).cast("bigint").alias("key"), F.col("words").alias("words"), F.transform("v", lambda x: x.cast("double")).alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).alias(own))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left, right = row(pieces, "piece", "qb", nq).withColumn("bb", every(nb)), row(sources, "source", "bb", nb).withColumn("qb", every(nq))

    def unit(s: pd.Series, size: int) -> np.ndarray:
        m = np.vstack([np.zeros(size) if x is None else np.asarray(x, np.float64) for x in s])
        n = np.sqrt((m * m).sum(1))
        return m / np.where(n > 0, n, 1.0)[:, None]

    def best(ps: pd.DataFrame, ss: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"piece": pd.Series(dtype="int64"), "source": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if ps.empty or ss.empty:
            return out
        ss = ss.sort_values("key")
        size = max((len(x) for x in [*ps.v, *ss.v] if x is not None), default=1)
        near = unit(ps.v, size) @ unit(ss.v, size).T
        having: dict[str, list[int]] = {}
        count = np.zeros(len(ss))
        for j, w in enumerate(ss.words):
            own = set(() if w is None else w)
            count[j] = len(own)
            for x in own:
                having.setdefault(x, []).append(j)
        keys, rows = ss.key.to_numpy(), []
        for i, (pk, w) in enumerate(zip(ps.key, ps.words)):
            own, shared = set(() if w is None else w), np.zeros(len(ss))
            for x in own:
                shared[having.get(x, [])] += 1
            score = np.round(0.1 * shared / np.maximum(1, len(own) + count - shared) + 0.9 * near[i], 9)
            top = np.argsort(-score, kind="stable")[:k]
            rows += [(pk, keys[j], score[j]) for j in top if score[j] > least]
        return pd.DataFrame(rows, columns=["piece", "source", "score"]) if rows else out

    parts = left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInPandas(best, "piece bigint, source bigint, score double")
    rank = F.row_number().over(W.partitionBy("piece").orderBy(F.desc("score"), "source"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k)


def document_search(docs: DataFrame, key: str, filters: dict | None = None, score: DataFrame | None = None, order: list | None = None, offset: int = 0, limit: int | None = None, fields: list[str] | None = None) -> DataFrame:
    """Rows of a document table: equality filters (lists as alternatives), scores joined, sorted, a page, some fields.

    A field that the table lacks holds for no row. Without an order, rows come by score and key.
    """
    rows = docs
    for name, value in (filters or {}).items():
        if name not in docs.columns:
            return docs.where("false").select(*(fields or docs.columns))
        rows = rows.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    if score is not None:
        rows = rows.join(score.select(key, "score"), key)
    by = order or ([F.desc("score"), key] if score is not None else [key])
    rows = rows.orderBy(*by).offset(offset)
    return (rows if limit is None else rows.limit(limit)).select(*(fields or rows.columns))


def highlighted(c, words: list[str]):
    """Text with the given words, whole and in any case, between marks."""
    return F.regexp_replace(c, f"(?i)(?<![A-Za-z0-9_])({'|'.join(sorted(words))})(?![A-Za-z0-9_])", "<em>$1</em>") if words else c


def rerank_rows(rows: DataFrame, key: str, weights: dict[str, float], text: float = 0.3, vector: float = 0.7) -> DataFrame:
    """(key, score) of ``rows(key, shared, near, features)``: shared words, near vectors and weighted rank features."""
    from graphloom.operators.scores import feature_score

    return rows.select(key, (text * F.coalesce("shared", F.lit(0.0)) + vector * F.coalesce("near", F.lit(0.0)) + feature_score(F.col("features"), weights)).alias("score"))
