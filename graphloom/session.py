"""Session helpers shared by operators: table loading, shuffle width, durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


_SHIPPED: set[str] = set()
_WRITTEN: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that Python operators find it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions of a wide exchange, as the session sets it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_bytes(df: DataFrame) -> int:
    """Size of the result as the planner estimates it, for scans that of the columns in their files; 0 if unknown."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if size >= 1 << 60 else size


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where all tasks see it."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or f"file://{os.path.join(tempfile.gettempdir(), 'graphloom-checkpoints')}")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, *measures: Column) -> DataFrame:
    """``df`` as a table written to the shared checkpoint folder, which cuts its lineage.

    A written table outlives any executor, is computed once (a checkpoint computes its last stage twice) and has a size
    that the planner knows. ``measures`` are aggregates taken while it is written; ``measured`` gives their values.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    seen = Observation()
    (df.observe(seen, *measures) if measures else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN.append(path)
    out._cut = (path, seen.get if measures else {})
    return out


def measured(df: DataFrame) -> dict:
    """The measures of a table that ``cut`` wrote, by name."""
    return df._cut[1]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more, such as the state of an earlier round."""
    for df in tables:
        _delete(df.sparkSession, df._cut[0])
        if df._cut[0] in _WRITTEN:
            _WRITTEN.remove(df._cut[0])


def release(spark: SparkSession) -> int:
    """Delete every table that ``cut`` wrote in this process, once their results are used; gives their number."""
    n = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    return n


#: Operators above a scan after which rows are spread already.
_SPREAD_BY = ("Aggregate", "Join", "Sort", "RepartitionBy", "Repartition", "Window", "Distinct", "Deduplicate")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    For costly Python operators over few or small files. Spark splits larger inputs by itself: they stay as they are,
    so this shuffles no more than a few megabytes a core. What comes from a shuffle stays as it is, too, and is not
    planned twice.
    """
    plan = str(df._jdf.queryExecution().optimizedPlan().toString())
    if any(f"{x} " in plan or f"{x}(" in plan for x in _SPREAD_BY):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
