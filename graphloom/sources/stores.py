"""Stores over Parquet folders: keyed values with expiry, named graphs, extraction results as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ENTRY = "key string, value string, stored_at timestamp, ttl_seconds bigint, seq string"


class KeyValues:
    """Keyed values as an appended log: the latest entry of a key counts, null values are deletions, expired ones are gone.

    Appending never rewrites what is stored; ``compact`` keeps only what is live.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(ENTRY).parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], ENTRY)
            raise

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def set(self, rows: DataFrame, now: Column, ttl_seconds: int | None = None) -> None:
        """Store ``rows(key, value)``."""
        stamp = F.concat(F.date_format(now, "yyyyMMddHHmmssSSSSSS"), F.lit(uuid.uuid4().hex))
        self._append(rows.select("key", F.col("value").cast("string").alias("value"), now.alias("stored_at"), F.lit(ttl_seconds).cast("bigint").alias("ttl_seconds"), stamp.alias("seq")))

    def delete(self, keys: DataFrame, now: Column) -> None:
        """Forget ``keys(key)``."""
        self.set(keys.select("key", F.lit(None).cast("string").alias("value")), now)

    def live(self, now: Column) -> DataFrame:
        """(key, value, stored_at, ttl_seconds) of all live keys."""
        last = self._log().groupBy("key").agg(F.max_by(F.struct("value", "stored_at", "ttl_seconds"), F.struct("stored_at", "seq")).alias("m")).select("key", "m.*")
        return last.where(F.col("value").isNotNull() & (F.col("ttl_seconds").isNull() | (F.unix_timestamp("stored_at") + F.col("ttl_seconds") > F.unix_timestamp(now))))

    def get(self, keys: DataFrame, now: Column) -> DataFrame:
        """(key, value) of the asked keys that are live."""
        return self.live(now).join(keys.select("key").distinct(), "key", "left_semi").select("key", "value")

    def expire(self, keys: DataFrame, now: Column, ttl_seconds: int) -> None:
        """Let live keys end after a time from now."""
        self.set(self.get(keys, now), now, ttl_seconds)

    def ttl(self, now: Column) -> DataFrame:
        """(key, ttl): seconds left of live keys, -1 where they don't expire."""
        left = F.unix_timestamp("stored_at") + F.col("ttl_seconds") - F.unix_timestamp(now)
        return self.live(now).select("key", F.coalesce(left, F.lit(-1)).alias("ttl"))

    def keys(self, now: Column, pattern: str = "*") -> DataFrame:
        """(key) of live keys that fit a pattern with ``*`` and ``?``."""
        regex = "".join(".*" if c == "*" else "." if c == "?" else f"\\Q{c}\\E" for c in pattern)
        return self.live(now).where(F.col("key").rlike(f"(?s)^{regex}\\z")).select("key")

    def flush(self) -> None:
        """Forget everything."""
        self.spark.createDataFrame([], ENTRY).write.mode("overwrite").parquet(self.path)

    def compact(self, now: Column) -> None:
        """Rewrite the log with live entries only."""
        kept = f"{self.path}-{uuid.uuid4().hex}"
        self.live(now).withColumn("seq", F.lit("")).write.parquet(kept)
        self.spark.read.schema(ENTRY).parquet(kept).write.mode("overwrite").parquet(self.path)
        _delete(self.spark, kept)


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> bool:
    p, fs = _files(spark, path)
    return fs.delete(p, True)


def list_graphs(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(name, modified in milliseconds) of the graphs saved below a folder, the latest first."""
    p, fs = _files(spark, root)
    if not fs.exists(p):
        return []
    found = [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def delete_graph(spark: SparkSession, root: str, name: str) -> bool:
    """Delete a saved graph; false where there is none."""
    if "/" in name or name in ("", ".", ".."):
        raise ValueError(f"{name!r} is no name of a graph")
    return _delete(spark, f"{root}/{name}")


def save_extracted(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables of an extraction as JSON lines, one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def load_extracted(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Read the tables of an extraction."""
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def save_index(index: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Write an index so that a lookup by key reads one part of it."""
    index.withColumn("part", F.pmod(F.xxhash64(key), F.lit(buckets))).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def look_up(spark: SparkSession, path: str, key: str, value: str, buckets: int = 64) -> DataFrame:
    """Rows of a saved index of one key."""
    rows = spark.read.parquet(path)
    return rows.where((F.col("part") == F.pmod(F.xxhash64(F.lit(value)), F.lit(buckets))) & (F.col(key) == value)).drop("part")
