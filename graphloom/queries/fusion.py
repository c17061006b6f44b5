"""Queries of fused retrieval, constraints, cleaning, text comparison and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import text as X
from graphloom.model import GRAPH_SQL, REVERSE
from graphloom.operators import analytics as A, rank as K, search as S, traverse as T
from graphloom.operators.expand import capped
from graphloom.operators.extract import entities
from graphloom.operators.stats import degrees
from graphloom.queries.analysis import DEGREE_SQL, _pagerank_sql
from graphloom.queries.base import Registry
from graphloom.queries.graph import SEEDS_SQL, STEP_SQL, _bfs_sql, load, seeds
from graphloom.queries.texts import ENTITY_SQL, WORDS
from graphloom.session import table
from graphloom.streaming import incremental as W

R = Registry()

ASKED = ("syndrome", "pain", "kinase")
_HITS = " + ".join(f"CASE WHEN list_contains(w, '{t}') THEN 1 ELSE 0 END" for t in ASKED)


@R.add(
    "kg_fusion",
    f"""WITH RECURSIVE {GRAPH_SQL}, {SEEDS_SQL}, {STEP_SQL}, {_bfs_sql('SEEDS', 2, 'UND')}, H AS (SELECT id, min(depth) AS hops FROM B GROUP BY id),
    S AS (SELECT id, ({_HITS}) / {float(len(ASKED))} AS sim FROM (SELECT id, {WORDS.format(c='name')} AS w FROM N WHERE name IS NOT NULL)), SS AS (SELECT * FROM S WHERE sim > 0),
    J AS (SELECT coalesce(SS.id, H.id) AS id, CASE WHEN hops = 0 THEN 1.0 ELSE coalesce(sim, 0) END AS sim, coalesce(hops, 3) AS hops FROM SS FULL JOIN H ON H.id = SS.id), {_pagerank_sql(10)}
    SELECT j.id, round(0.45 * sim + 0.35 * CASE WHEN hops = 0 THEN 1.0 ELSE r.r END + 0.20 * CASE WHEN n.kind = 'Gene' THEN 0.2 WHEN n.kind IN ('Disease', 'Compound') THEN 0.15 ELSE 0.1 END - 0.10 * ln(1.0 + hops) + CASE WHEN hops = 0 THEN 1.0 ELSE 0 END, 6) AS score
    FROM J j JOIN N n ON n.id = j.id JOIN R10 r ON r.id = j.id""",
)
def kg_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Entities by keyword and by nearness to the core, full outer merged and scored together; the core counts as certain."""
    g = load(spark, d).kept
    named = g.nodes.where("name is not null").select("id", X.words(F.col("name")).alias("w"))
    similar = S.keyword_score(named, "id", "w", list(ASKED)).select("id", F.col("score").alias("sim"))
    near = T.bfs(g.edges, seeds(g), 2, "both").select("id", F.col("depth").alias("hops"))
    core = F.coalesce(F.col("hops") == 0, F.lit(False))
    both = similar.join(near, "id", "full").select("id", F.when(core, 1.0).otherwise(F.coalesce("sim", F.lit(0.0))).alias("sim"), F.coalesce("hops", F.lit(3)).alias("hops"))
    rows = both.join(g.nodes.select("id", "kind"), "id").join(A.pagerank(g.nodes, g.edges, 10), "id")
    schema = F.when(F.col("kind") == "Gene", 0.2).when(F.col("kind").isin("Disease", "Compound"), 0.15).otherwise(0.1)
    rank = F.when(F.col("hops") == 0, 1.0).otherwise(F.col("rank"))
    score = K.fuse(F.col("sim"), rank, schema, F.col("hops"), F.col("hops") == 0)
    return rows.select("id", F.round(score, 6).alias("score"))


@R.add(
    "path_constraints",
    f"""WITH {GRAPH_SQL}, {SEEDS_SQL}, A AS (SELECT src, dst, metaedge FROM E WHERE metaedge IN ('CtD', 'CpD', 'DaG', 'CbG', 'DlA')),
    P AS (SELECT s.id AS start, [s.id, a.dst, b.dst] AS path, [a.metaedge, b.metaedge] AS metas FROM SEEDS s JOIN A a ON a.src = s.id JOIN A b ON b.src = a.dst WHERE a.dst <> s.id AND b.dst <> s.id AND b.dst <> a.dst)
    SELECT start, array_to_string(path, ' > ') AS path, array_to_string(metas, ' ') AS metas FROM P WHERE (metas[1] IN ('CtD', 'CpD') AND path[2] IN (SELECT id FROM N WHERE kind = 'Disease')) OR (metas[2] IN ('CtD', 'CpD') AND path[3] IN (SELECT id FROM N WHERE kind = 'Disease'))""",
)
def path_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Paths of two edges of which a treatment or palliation leads to a disease."""
    g = load(spark, d).kept
    paths = T.simple_paths(g.edges, seeds(g), 2, allow=["CtD", "CpD", "DaG", "CbG", "DlA"]).where("hops = 2").withColumn("pid", F.monotonically_increasing_id())
    kept = T.cut(paths)
    steps = kept.select("pid", F.posexplode("metas").alias("i", "metaedge"), "path").where(F.col("metaedge").isin("CtD", "CpD")).select("pid", F.col("path")[F.col("i") + 1].alias("id"))
    good = steps.join(g.nodes.where("kind = 'Disease'").select("id"), "id", "left_semi").select("pid")
    return kept.join(good, "pid", "left_semi").select("start", F.array_join("path", " > ").alias("path"), F.array_join("metas", " ").alias("metas"))


@R.add("reverse_codes", "WITH R(metaedge, reverse) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in REVERSE.items()) + ") SELECT m.metaedge, m.src_kind, m.dst_kind, R.reverse FROM metaedges m LEFT JOIN R ON R.metaedge = m.metaedge")
def reverse_codes(spark: SparkSession, d: str) -> DataFrame:
    lookup = F.create_map(*[x for a, b in REVERSE.items() for x in (F.lit(a), F.lit(b))])
    return table(spark, d, "metaedges").select("metaedge", "src_kind", "dst_kind", F.try_element_at(lookup, F.col("metaedge")).alias("reverse"))


@R.add("clean_graph", "SELECT DISTINCT trim(source, ' ') AS src, trim(target, ' ') AS dst, coalesce(metaedge, relation, 'related') AS metaedge FROM graph_edges WHERE trim(coalesce(source, ''), ' ') <> '' AND trim(coalesce(target, ''), ' ') <> ''")
def clean_graph(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "graph_edges").select(F.trim("source").alias("src"), F.trim("target").alias("dst"), F.coalesce("metaedge", "relation", F.lit("related")).alias("metaedge"))
    return e.where("src <> '' and dst <> ''").distinct()


@R.add("support_filter", f"WITH {GRAPH_SQL}, K AS (SELECT * FROM E WHERE weight >= 0.7 AND coalesce(evidence, 1) >= 2) SELECT n.id, n.kind FROM N n WHERE n.id IN (SELECT src FROM K UNION SELECT dst FROM K)")
def support_filter(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that keep an edge of enough weight and evidence; the others are isolated."""
    g = load(spark, d)
    kept = g.edges.where((F.col("weight") >= 0.7) & (F.coalesce("evidence", F.lit(1)) >= 2))
    ends = kept.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return g.nodes.join(ends, "id", "left_semi").select("id", "kind")


@R.add("entity_text_filter", f"WITH {ENTITY_SQL}, {GRAPH_SQL}, K AS (SELECT DISTINCT lower(name) AS w FROM N WHERE name IS NOT NULL) SELECT doc_id, name, type FROM ENT WHERE lower(name) IN (SELECT w FROM K)")
def entity_text_filter(spark: SparkSession, d: str) -> DataFrame:
    """Extracted entities that are named nodes."""
    known = load(spark, d).nodes.where("name is not null").select(F.lower("name").alias("w")).distinct()
    found = entities(table(spark, d, "documents"), "doc_id", "text").withColumn("w", F.lower("name"))
    return found.join(known, "w", "left_semi").select("doc_id", "name", "type")


@R.add("attribute_merge", "SELECT source AS src, target AS dst, string_agg(DISTINCT source_db, '+' ORDER BY source_db) AS sources, CAST(sum(coalesce(evidence_count, 0)) AS BIGINT) AS evidence FROM graph_edges WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY ALL")
def attribute_merge(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of parallel edges united: distinct sources, summed evidence."""
    e = table(spark, d, "graph_edges").where("source is not null and target is not null")
    m = e.groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.array_sort(F.collect_set("source_db")).alias("s"), F.sum(F.coalesce("evidence_count", F.lit(0))).alias("evidence"))
    return m.select("src", "dst", F.when(F.size("s") > 0, F.array_join("s", "+")).alias("sources"), "evidence")


@R.add(
    "tfidf_cosine",
    f"""WITH A AS (SELECT doc_id, list_filter({WORDS.format(c='title')}, lambda w: length(w) > 1) AS x, list_filter({WORDS.format(c='text')}, lambda w: length(w) > 1) AS y FROM documents WHERE title IS NOT NULL AND text IS NOT NULL),
    T AS (SELECT doc_id, w, sum(a) AS a, sum(b) AS b FROM (SELECT doc_id, unnest(x) AS w, 1 AS a, 0 AS b FROM A UNION ALL SELECT doc_id, unnest(y), 0, 1 FROM A) GROUP BY doc_id, w),
    V AS (SELECT doc_id, a * i AS a, b * i AS b FROM (SELECT *, ln(3.0 / (1 + CASE WHEN a > 0 AND b > 0 THEN 2 ELSE 1 END)) + 1 AS i FROM T))
    SELECT A.doc_id, round(coalesce(sum(V.a * V.b) / nullif(sqrt(sum(V.a * V.a)) * sqrt(sum(V.b * V.b)), 0), 0), 6) AS cosine FROM A LEFT JOIN V ON V.doc_id = A.doc_id GROUP BY A.doc_id""",
)
def tfidf_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of title and text over the two-text corpus, with smooth inverse frequencies."""
    docs = table(spark, d, "documents").where("title is not null and text is not null").select("doc_id", *[F.filter(X.words(F.col(c)), lambda w: F.length(w) > 1).alias(c) for c in ("title", "text")])
    sides = F.concat(F.transform("title", lambda w: F.struct(w.alias("w"), F.lit(1).alias("a"), F.lit(0).alias("b"))), F.transform("text", lambda w: F.struct(w.alias("w"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    tf = docs.select("doc_id", F.explode(sides).alias("s")).groupBy("doc_id", "s.w").agg(F.sum("s.a").alias("a"), F.sum("s.b").alias("b"))
    idf = F.log(3.0 / (1 + F.when((F.col("a") > 0) & (F.col("b") > 0), 2).otherwise(1))) + 1
    v = tf.select("doc_id", (F.col("a") * idf).alias("a"), (F.col("b") * idf).alias("b")).groupBy("doc_id").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return docs.select("doc_id").join(v, "doc_id", "left").select("doc_id", F.round(F.coalesce(F.try_divide("ab", F.sqrt("aa") * F.sqrt("bb")), F.lit(0.0)), 6).alias("cosine"))


@R.add("sliding_windows", "SELECT w AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY ALL")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return W.windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 hour", "1 day", "30 minutes")


@R.add(
    "session_windows",
    """WITH G AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
    S AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM G)
    SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, CAST(count(*) AS BIGINT) AS n FROM S GROUP BY user_id, s""",
)
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return W.session_counts(table(spark, d, "events"), "ts", "user_id", "30 minutes", "1 day")


@R.add("stream_first_deliveries", "SELECT count(*) AS n FROM (SELECT DISTINCT source, target, metaedge, relation FROM graph_edges WHERE source IS NOT NULL)")
def stream_first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges of a drained stream; one batch, so no watermark has passed."""
    e = W.stream_table(spark, d, "graph_edges").where("source is not null")
    once = W.first_deliveries(e, "loaded_at", ["source", "target", "metaedge", "relation"], "100000 days")
    return W.run_available(once, "append").agg(F.count(F.lit(1)).alias("n"))


@R.add("central_neighbors", f"WITH {GRAPH_SQL}, {DEGREE_SQL} SELECT src, dst FROM (SELECT x.src, x.dst, row_number() OVER (PARTITION BY x.src ORDER BY d.degree DESC, x.dst) AS rn FROM (SELECT DISTINCT src, dst FROM E WHERE src <> dst) x JOIN DEG d ON d.id = x.dst) WHERE rn <= 3")
def central_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The three most connected neighbours of every node."""
    g = load(spark, d).kept
    e = g.edges.where("src <> dst").select("src", "dst").distinct().join(degrees(g.edges).select(F.col("id").alias("dst"), "degree"), "dst")
    return capped(e, ["src"], [F.desc("degree"), "dst"], 3).select("src", "dst")


@R.add("approx_distinct")
def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d).edges.groupBy("metaedge").agg(F.approx_count_distinct("src", 0.02).alias("sources"), F.approx_count_distinct("dst", 0.02).alias("targets"))
