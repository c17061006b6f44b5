"""Queries of the core data-quality operators: orphan references, hot keys, unreadable lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators.orphans import OrphanState, Reference, orphan_references, orphan_report
from graphloom.operators.skew import heavy_hitters, keyed_stats
from graphloom.queries.base import Registry
from graphloom.session import table
from graphloom.sources.records import parse_edge_records

R = Registry()
HEAVY = 0.025

REFS_SQL = """
refs AS (
  SELECT 'graph_edges' AS tbl, edge_id AS row_id, 'source' AS field, source AS key, observed_at AS seen FROM graph_edges WHERE source IS NOT NULL
  UNION ALL SELECT 'graph_edges', edge_id, 'target', target, observed_at FROM graph_edges WHERE target IS NOT NULL
  UNION ALL SELECT 'wiki_pages', page_id, 'node_id', node_id, fetched_at FROM wiki_pages WHERE node_id IS NOT NULL),
orphans AS (
  SELECT * FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM graph_nodes n WHERE n.id = r.key AND n.created_at <= r.seen AND (n.deleted_at IS NULL OR r.seen < n.deleted_at)))
"""


def _refs(edges: DataFrame, pages: DataFrame) -> list[Reference]:
    return [Reference(edges, "graph_edges", "edge_id", "source", "observed_at"), Reference(edges, "graph_edges", "edge_id", "target", "observed_at"), Reference(pages, "wiki_pages", "page_id", "node_id", "fetched_at")]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs, nodes = _refs(table(spark, d, "graph_edges"), table(spark, d, "wiki_pages")), table(spark, d, "graph_nodes")
    return orphan_references(refs, OrphanState.of(nodes, refs))


@R.add("p2_found", f"WITH {REFS_SQL} SELECT tbl, row_id, field FROM orphans")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("tbl", "row_id", "field")


@R.add("p2_report", f"WITH {REFS_SQL} SELECT tbl, field, strftime(seen, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n_orphans, CAST(count(DISTINCT key) AS BIGINT) AS n_keys FROM orphans GROUP BY ALL")
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


CURRENT_SQL = f"""WITH {REFS_SQL},
    live AS (SELECT id AS key, sum(CASE WHEN deleted_at IS NULL THEN 1 ELSE 0 END) AS n FROM graph_nodes WHERE created_at IS NOT NULL GROUP BY id)
    SELECT r.key, CAST(count(*) AS BIGINT) AS n_refs FROM refs r LEFT JOIN live l ON r.key = l.key WHERE coalesce(l.n, 0) = 0 GROUP BY r.key"""


@R.add("p2_current_keys", CURRENT_SQL)
def p2_current_keys(spark: SparkSession, d: str) -> DataFrame:
    refs = _refs(table(spark, d, "graph_edges"), table(spark, d, "wiki_pages"))
    return OrphanState.of(table(spark, d, "graph_nodes"), refs).current().select("key", "n_refs")


@R.add("p2_maintained_keys", CURRENT_SQL)
def p2_maintained_keys(spark: SparkSession, d: str) -> DataFrame:
    """The same report from a state that takes the deliveries of all tables quarter by quarter."""
    state = None
    quarter = F.coalesce(F.quarter("loaded_at"), F.lit(1))
    for q in range(1, 5):
        edges, pages, nodes = (table(spark, d, t).where(quarter == q) for t in ("graph_edges", "wiki_pages", "graph_nodes"))
        batch = OrphanState.of(nodes, _refs(edges, pages))
        state = batch if state is None else state.merge(batch)
    return state.current().select("key", "n_refs")


STATS_SQL = """
ends AS (SELECT 'source' AS field, source AS node_id, target AS nb, weight FROM graph_edges UNION ALL SELECT 'target', target, source, weight FROM graph_edges),
stats AS (SELECT field, node_id, CAST(count(*) AS BIGINT) AS n_edges, round(coalesce(sum(weight), 0), 6) AS sum_weight, CAST(count(DISTINCT nb) AS BIGINT) AS n_neighbors
  FROM ends WHERE node_id IS NOT NULL GROUP BY field, node_id)
"""


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return keyed_stats(table(spark, d, "graph_edges"), {"source": "target", "target": "source"}, "weight", "edge_id")


@R.add("p3_found", f"WITH {STATS_SQL} SELECT field, node_id FROM stats WHERE n_edges >= {HEAVY} * (SELECT count(*) FROM graph_edges)")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "graph_edges").count()
    return heavy_hitters(_stats(spark, d), total, HEAVY).select("field", F.col("key").alias("node_id"))


@R.add("p3_node_stats", f"WITH {STATS_SQL} SELECT * FROM stats")
def p3_node_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).select("field", F.col("key").alias("node_id"), F.col("n_rows").alias("n_edges"), F.round("sum_weight", 6).alias("sum_weight"), "n_neighbors")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "metaedges").select("metaedge", "src_kind", "dst_kind").collect()  # the fixed vocabulary of 24 metaedges
    kinds = sorted({k for r in rules for k in (r.src_kind, r.dst_kind) if k})
    return parse_edge_records(table(spark, d, "raw_edges"), kinds, sorted({r.metaedge for r in rules if r.metaedge}))


# A plain-regex statement of the line rules; fields are cut by one pattern per field.
_FIELD = '(?:"(?:[^"]|"")*"|[^"\\t][^"\\t]*|)'
RAW_SQL = f"""
cut AS (SELECT raw_id, regexp_replace(regexp_replace(line, '^\\x{{FEFF}}', ''), '\\r\\z', '') AS s FROM raw_edges),
open AS (SELECT * FROM cut WHERE NOT (regexp_full_match(s, ' *') OR starts_with(s, '#') OR s = concat_ws(chr(9), 'source', 'relation', 'target', 'weight', 'evidence', 'observed_on', 'note'))),
f AS (SELECT raw_id, s, regexp_full_match(s, '{_FIELD}(\\t{_FIELD}){{6}}', 's') AS whole,
  regexp_extract(s, '^({_FIELD})\\t({_FIELD})\\t({_FIELD})\\t({_FIELD})\\t({_FIELD})\\t({_FIELD})\\t({_FIELD})\\z', ['a', 'b', 'c', 'd', 'e', 'o', 'n'], 's') AS x FROM open),
u AS (SELECT raw_id, whole, {', '.join(f"CASE WHEN starts_with(x.{c}, chr(34)) THEN replace(substr(x.{c}, 2, length(x.{c}) - 2), chr(34) || chr(34), chr(34)) ELSE x.{c} END AS {c}" for c in 'abcdeon')} FROM f),
kinds AS (SELECT src_kind AS k FROM metaedges UNION SELECT dst_kind FROM metaedges),
v AS (SELECT *, whole
   AND EXISTS (SELECT 1 FROM kinds WHERE starts_with(a, k || '::') AND length(a) > length(k) + 2)
   AND b IN (SELECT metaedge FROM metaedges)
   AND EXISTS (SELECT 1 FROM kinds WHERE starts_with(c, k || '::') AND length(c) > length(k) + 2)
   AND (d = '' OR (regexp_full_match(d, '([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(TRY_CAST(d AS DOUBLE) BETWEEN 0 AND 1, false)))
   AND regexp_full_match(e, '[0-9]*')
   AND (o = '' OR (regexp_full_match(o, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST(o AS DATE) IS NOT NULL)) AS ok FROM u)
"""


@R.add("p6_found", f"WITH {RAW_SQL} SELECT raw_id FROM v WHERE NOT ok")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("status = 'error'").select("raw_id")


@R.add("p6_edges", f"WITH {RAW_SQL} SELECT raw_id, a AS source, b AS relation, c AS target, TRY_CAST(d AS DOUBLE) AS weight, TRY_CAST(e AS BIGINT) AS evidence, TRY_CAST(o AS DATE) AS observed_on, n AS note FROM v WHERE ok")
def p6_edges(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("status = 'edge'").drop("status", "reason", "error_at")


@R.add("p6_errors")
def p6_errors(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("status = 'error'").select("raw_id", "reason", "error_at")
