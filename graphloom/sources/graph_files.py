"""Graph files: edge lists, node tables, statistics text, graph exchange formats; readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_sif(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(src, metaedge, dst) of a tab-separated edge list, compressed or not; lines of fewer than three fields are left out."""
    rows = spark.read.option("sep", "\t").option("header", str(header).lower()).option("mode", "PERMISSIVE").option("quote", "").schema("src string, metaedge string, dst string").csv(path)
    return rows.where("src is not null and metaedge is not null and dst is not null")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, kind) of a tab-separated node table with a header, byte order mark or not."""
    rows = spark.read.option("sep", "\t").option("header", "true").option("quote", "").option("encoding", "UTF-8").csv(path)
    first = rows.columns[0]
    return rows.withColumnRenamed(first, first.lstrip("﻿")).select("id", "name", "kind")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame]:
    """(nodes, edges) by the ending of a path: an edge list or a folder of Parquet tables."""
    name = path.lower().removesuffix(".gz")
    if name.endswith((".sif", ".tsv", ".txt", ".csv")):
        edges = read_sif(spark, path) if not name.endswith(".csv") else spark.read.schema("src string, metaedge string, dst string").csv(path).where("src is not null and metaedge is not null and dst is not null")
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("kind", F.lit("entity"))
        return nodes, edges
    if name.endswith(".pkl"):
        raise ValueError("pickled graphs run code when they are read; convert them to edge lists first")
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write a graph as two tables, edges by metaedge so that scans of one type read only it."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.repartition("metaedge", F.pmod(F.xxhash64("src"), F.lit(16))).write.mode("overwrite").partitionBy("metaedge").parquet(f"{path}/edges")


def stats_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line) of a statistics text: counts by kind and metaedge, largest first."""
    k = nodes.groupBy("kind").count().select(F.lit(1).alias("part"), "count", F.concat(F.lit("kind\t"), "kind", F.lit("\t"), F.col("count").cast("string")).alias("line"))
    m = edges.groupBy("metaedge").count().select(F.lit(2).alias("part"), "count", F.concat(F.lit("metaedge\t"), "metaedge", F.lit("\t"), F.col("count").cast("string")).alias("line"))
    return k.unionByName(m).orderBy("part", F.desc("count"), "line").select("line")


def _escaped(c: str):
    out = F.coalesce(F.col(c), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _fixed(spark: SparkSession, lines: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(lines, "part int, line string")


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line) of a GraphML file; in order of ``part`` the lines are the file."""
    keys = [("name", "node", "string"), ("kind", "node", "string"), ("metaedge", "edge", "string"), ("weight", "edge", "double")]
    frame = [(0, '<?xml version="1.0" encoding="UTF-8"?>'), (1, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), (3, '<graph id="G" edgedefault="directed">'), (6, "</graph>"), (7, "</graphml>")]
    frame += [(2, f'<key id="{k}" for="{w}" attr.name="{k}" attr.type="{t}"/>') for k, w, t in keys]
    n = nodes.select(F.lit(4).alias("part"), F.concat(F.lit('<node id="'), _escaped("id"), F.lit('"><data key="name">'), _escaped("name"), F.lit('</data><data key="kind">'), _escaped("kind"), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(5).alias("part"), F.concat(F.lit('<edge source="'), _escaped("src"), F.lit('" target="'), _escaped("dst"), F.lit('"><data key="metaedge">'), _escaped("metaedge"), F.lit('</data><data key="weight">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("line"))
    return _fixed(nodes.sparkSession, frame).unionByName(n).unionByName(e)


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line) of a GEXF file; in order of ``part`` the lines are the file."""
    frame = [(0, '<?xml version="1.0" encoding="UTF-8"?>'), (1, '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><attributes class="node"><attribute id="0" title="kind" type="string"/></attributes>'), (2, "<nodes>"), (4, "</nodes><edges>"), (6, "</edges></graph></gexf>")]
    named = nodes.withColumn("label", F.coalesce("name", "id"))
    n = named.select(F.lit(3).alias("part"), F.concat(F.lit('<node id="'), _escaped("id"), F.lit('" label="'), _escaped("label"), F.lit('"><attvalues><attvalue for="0" value="'), _escaped("kind"), F.lit('"/></attvalues></node>')).alias("line"))
    e = edges.select(F.lit(5).alias("part"), F.concat(F.lit('<edge id="'), F.col("seq").cast("string"), F.lit('" source="'), _escaped("src"), F.lit('" target="'), _escaped("dst"), F.lit('" label="'), _escaped("metaedge"), F.lit('" weight="'), F.col("weight").cast("string"), F.lit('"/>')).alias("line"))
    return _fixed(nodes.sparkSession, frame).unionByName(n).unionByName(e)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write (part, line) rows as text files whose names and lines are in order of ``part``."""
    lines.repartitionByRange("part").sortWithinPartitions("part").select("line").write.mode("overwrite").text(path)


def view_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, json): nodes and edges as JSON objects for a viewer."""
    n = nodes.select(F.lit("node").alias("part"), "id", F.to_json(F.struct("id", F.col("name").alias("label"), F.col("kind").alias("type"))).alias("json"))
    e = edges.select(F.lit("edge").alias("part"), F.col("seq").cast("string").alias("id"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("metaedge").alias("label"))).alias("json"))
    return n.unionByName(e)


def sql_rows(spark: SparkSession, views: dict[str, DataFrame], sql: str, limit: int | None = None) -> DataFrame:
    """Rows of a SQL text over named views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(sql)
    return out if limit is None else out.limit(limit)


def cached_values(entries: DataFrame, now) -> DataFrame:
    """(key, value) of cache entries (key, value, stored_at, ttl_seconds): the latest of each key that hasn't expired."""
    last = entries.groupBy("key").agg(F.max_by(F.struct("value", "stored_at", "ttl_seconds"), "stored_at").alias("m")).select("key", "m.*")
    return last.where(F.col("ttl_seconds").isNull() | (F.unix_timestamp("stored_at") + F.col("ttl_seconds") > F.unix_timestamp(now))).select("key", "value")
