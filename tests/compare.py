"""Runs queries against their SQL and prints or returns the differences."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings graph_nodes graph_edges raw_edges wiki_pages metaedges chunk_limits mix_targets".split()


def make_spark(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            p = f"{sf_dir}/{t}.parquet" if Path(f"{sf_dir}/{t}.parquet").is_file() else f"{sf_dir}/{t}.parquet/*.parquet"
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(cols: list[str], rows: list) -> list:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


def compare(spark: SparkSession, c: duckdb.DuckDBPyConnection, f, sql: str, sf_dir: str) -> str:
    df = f(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    res = c.sql(sql)
    want = rows_of(res.columns, res.fetchall())
    if sorted(df.columns) != sorted(res.columns):
        return f"columns {sorted(df.columns)} != {sorted(res.columns)}"
    if got == want:
        return ""
    a, b = set(map(repr, got)), set(map(repr, want))
    return f"rows {len(got)} and {len(want)}; only Spark {sorted(a - b)[:4]}; only SQL {sorted(b - a)[:4]}"


if __name__ == "__main__":
    import __spark_entry__ as E

    sf = sys.argv[1]
    names = sys.argv[2:] or list(E.queries())
    spark, con = make_spark(), duck(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    for n in names:
        t = time.time()
        try:
            if n in sqls:
                said = compare(spark, con, qs[n], sqls[n], sf)
            else:
                df = qs[n](spark, sf)
                said = f"rows only: {len(df.collect())} rows, e.g. {str(df.limit(2).collect())[:300]}"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:1500]}"
        print(f"{time.time() - t:6.1f}s {n}: {said or 'ok'}", flush=True)
