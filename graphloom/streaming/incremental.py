"""Incremental forms: counts by event time with late data, a graph that grows by batches, deduplication with a bound.

Each takes a streaming DataFrame; ``run_available`` drains a source once, which is how the queries and tests run them.
State is bounded by watermarks where results are appended; complete results keep one row a group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.session import ensure_checkpoint_dir


def stream_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of a data directory as a stream of its files."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}*.parquet")


def _timed(rows: DataFrame, time: str) -> DataFrame:
    """Rows whose time is a timestamp, as watermarks need it; times without a zone are read in the session's."""
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(events: DataFrame, time: str, by: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """(start, by, n) in tumbling or sliding windows; events later than ``late`` are dropped in append mode."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return _timed(events, time).withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def session_counts(events: DataFrame, time: str, by: str, gap: str, late: str) -> DataFrame:
    """(start, end, by, n) of sessions that end after a gap."""
    return _timed(events, time).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def growing_relations(edges: DataFrame) -> DataFrame:
    """(src, dst, metaedge, frequency, first_seq) of edges that arrive batch by batch."""
    e = edges.where("source is not null and target is not null")
    return e.groupBy(F.col("source").alias("src"), F.col("target").alias("dst"), "metaedge").agg(F.count(F.lit(1)).alias("frequency"), F.min("edge_id").alias("first_seq"))


def first_deliveries(edges: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Rows whose keys were not seen within the watermark; the state of older keys is dropped."""
    return _timed(edges, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Drain a stream into files of the shared checkpoint folder and give the result.

    In complete mode each batch replaces the result, otherwise it is added.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    write = "overwrite" if mode == "complete" else "append"
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode(write).parquet(f"{base}/out")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
