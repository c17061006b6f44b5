"""Merging of extracted entities and relations, and canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def confidence(score: Column, conf: Column) -> Column:
    """Score, where it is missing or 0 the confidence; 0.5 if neither is given."""
    return F.coalesce(F.nullif(F.coalesce(score, F.lit(0.5)), F.lit(0.0)), conf, F.lit(0.5))


def merge_entities(rows: DataFrame, key: str, conf: str, keep: list[str], least: float = 0.0) -> DataFrame:
    """One row a key: frequency, mean confidence and the ``keep`` columns of its most confident row; sparse keys dropped."""
    m = rows.groupBy(key).agg(F.count(F.lit(1)).alias("frequency"), F.avg(conf).alias("confidence"), F.max_by(F.struct(*keep), F.struct(F.col(conf), *[F.col(k) for k in keep])).alias("best"))
    return m.where(F.col("confidence") >= least).select(key, "frequency", "confidence", (F.col("frequency") * F.col("confidence")).alias("weight"), *[F.col(f"best.{k}").alias(k) for k in keep])


def merge_relations(rows: DataFrame, conf: str, least: float = 0.0) -> DataFrame:
    """One row a (src, dst, metaedge): frequency, mean confidence, weight = frequency x (0.5 + 0.5 confidence)."""
    m = rows.groupBy("src", "dst", "metaedge").agg(F.count(F.lit(1)).alias("frequency"), F.avg(F.coalesce(conf, F.lit(0.5))).alias("confidence"))
    return m.where(F.col("confidence") >= least).withColumn("weight", F.col("frequency") * (0.5 + 0.5 * F.col("confidence")))


def canonical(rows: DataFrame, name: str) -> DataFrame:
    """Rows by canonical name: title case of the lower-case name, with the number of spellings."""
    c = F.initcap(F.lower(F.trim(name)))
    return rows.groupBy(c.alias("canonical")).agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct(name).alias("spellings"))


def apply_changes(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` after a log of (op, key, ...) changes: removed keys go, added rows come, modified rows replace theirs."""
    gone = changes.where(F.col("op").isin("remove", "modify")).select(key).distinct()
    come = changes.where(F.col("op").isin("add", "modify")).select(rows.columns)
    return rows.join(gone, key, "left_anti").select(rows.columns).unionByName(come)
