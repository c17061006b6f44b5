"""Queries of statistics, ranking, fusion and analytics over the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.model import GRAPH_SQL
from graphloom.operators import analytics as A, rank as K, stats as S, traverse as T
from graphloom.operators.expand import capped, induced
from graphloom.plans.retrieve import adaptive_hits, parts
from graphloom.queries.base import Registry
from graphloom.queries.graph import GENES_SQL, HUB_SQL, SEEDS_SQL, STEP_SQL, _bfs_sql, hub, load, seeds, walk_sql

R = Registry()


@R.add("node_type_hist", f"WITH {GRAPH_SQL} SELECT kind AS value, CAST(count(*) AS BIGINT) AS n FROM N GROUP BY kind")
def node_type_hist(spark: SparkSession, d: str) -> DataFrame:
    return S.histogram(load(spark, d).nodes, "kind")


@R.add("edge_type_hist", f"WITH {GRAPH_SQL} SELECT metaedge AS value, CAST(count(*) AS BIGINT) AS n FROM E GROUP BY metaedge")
def edge_type_hist(spark: SparkSession, d: str) -> DataFrame:
    return S.histogram(load(spark, d).edges, "metaedge")


DEGREE_SQL = "DEG AS (SELECT id, CAST(count(*) AS BIGINT) AS degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(1 - o) AS BIGINT) AS in_degree FROM (SELECT src AS id, 1 AS o FROM E UNION ALL SELECT dst, 0 FROM E) GROUP BY id)"


@R.add("degree_topk", f"WITH {GRAPH_SQL}, {DEGREE_SQL} SELECT * FROM DEG ORDER BY degree DESC, id LIMIT 100")
def degree_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.degrees(load(spark, d).edges).orderBy(F.desc("degree"), "id").limit(100)


@R.add("degrees", f"WITH {GRAPH_SQL}, {DEGREE_SQL} SELECT * FROM DEG")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return S.degrees(load(spark, d).edges)


@R.add("graph_density", f"WITH {GRAPH_SQL}, C AS (SELECT (SELECT count(*) FROM N) AS n, (SELECT count(*) FROM E) AS m) SELECT n AS n_nodes, m AS n_edges, round(m / (n * (n - 1.0)), 9) AS directed, round(2.0 * m / (n * (n - 1.0)), 9) AS undirected, round(m / (2.0 * n * (n - 1.0)), 9) AS multigraph, round(2.0 * m / n, 6) AS average_degree FROM C")
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    s = S.density(g.nodes, g.edges)
    return s.select("n_nodes", "n_edges", *[F.round(c, 9).alias(c) for c in ("directed", "undirected", "multigraph")], F.round("average_degree", 6).alias("average_degree"))


@R.add("conn_strength", f"WITH {GRAPH_SQL} SELECT src AS id, round(sum(weight), 6) AS strength FROM E GROUP BY src")
def conn_strength(spark: SparkSession, d: str) -> DataFrame:
    return S.strength(load(spark, d).edges).select("id", F.round("strength", 6).alias("strength"))


UND_SQL = "U AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM E WHERE src <> dst), UU AS (SELECT u AS a, v AS b FROM U UNION ALL SELECT v, u FROM U)"


@R.add("clustering", f"WITH {GRAPH_SQL}, {UND_SQL}, D AS (SELECT a, count(*) AS d FROM UU GROUP BY a), TRI AS (SELECT x.a, count(*) AS t FROM UU x JOIN UU y ON x.a = y.a AND x.b < y.b JOIN U ON U.u = x.b AND U.v = y.b GROUP BY x.a) SELECT n.id, round(coalesce(CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) END, 0), 6) AS clustering FROM N n LEFT JOIN D ON D.a = n.id LEFT JOIN TRI ON TRI.a = n.id")
def clustering(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return S.clustering(g.nodes, g.edges).select("id", F.round("clustering", 6).alias("clustering"))


@R.add("inverted_index", f"WITH {GRAPH_SQL} SELECT name AS value, CAST(count(DISTINCT id) AS BIGINT) AS n, min(id) AS first_key, max(id) AS last_key FROM N GROUP BY name")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return S.inverted(load(spark, d).nodes, "name", "id")


@R.add("type_samples", f"WITH {GRAPH_SQL} SELECT kind, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY id) AS rn FROM N) WHERE rn <= 5")
def type_samples(spark: SparkSession, d: str) -> DataFrame:
    return S.samples(load(spark, d).nodes, "kind", "id", 5)


@R.add("graph_info", f"WITH {GRAPH_SQL} SELECT (SELECT count(*) FROM N) AS n_nodes, (SELECT count(DISTINCT kind) FROM N) AS n_kinds, (SELECT count(*) FROM E) AS n_edges, (SELECT count(DISTINCT metaedge) FROM E) AS n_metaedges, (SELECT bool_or(weight <> 0) FROM E) AS weighted")
def graph_info(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return S.info(g.nodes, g.edges)


@R.add("rollup_kind_edge", f"WITH {GRAPH_SQL} SELECT n.kind, e.metaedge, CAST(count(*) AS BIGINT) AS n, CAST(grouping(n.kind, e.metaedge) AS INTEGER) AS level FROM E e JOIN N n ON n.id = e.src GROUP BY ROLLUP (n.kind, e.metaedge)")
def rollup_kind_edge(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return S.rollup(g.edges.join(g.nodes.select(F.col("id").alias("src"), "kind"), "src"), "kind", "metaedge")


@R.add("relation_groups", f"WITH {GRAPH_SQL}, G AS (SELECT metaedge, count(*) AS n FROM E GROUP BY metaedge ORDER BY n DESC, metaedge LIMIT 5) SELECT G.metaedge, CAST(G.n AS BIGINT) AS n, x.src, x.dst FROM G JOIN (SELECT metaedge, src, dst, row_number() OVER (PARTITION BY metaedge ORDER BY seq) AS rn FROM E) x ON x.metaedge = G.metaedge AND x.rn <= 2")
def relation_groups(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d).edges
    top = e.groupBy("metaedge").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "metaedge").limit(5)
    return top.join(capped(e.select("metaedge", "src", "dst", "seq"), ["metaedge"], ["seq"], 2), "metaedge").select("metaedge", "n", "src", "dst")


@R.add("neighbor_type_hist", f"WITH {GRAPH_SQL} SELECT e.src AS id, n.kind, CAST(count(DISTINCT e.dst) AS BIGINT) AS n FROM E e JOIN N n ON n.id = e.dst GROUP BY e.src, n.kind")
def neighbor_type_hist(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    e = g.edges.select("src", F.col("dst").alias("id")).distinct().join(g.nodes.select("id", "kind"), "id")
    return e.groupBy(F.col("src").alias("id"), "kind").agg(F.count(F.lit(1)).alias("n"))


@R.add("subgraph_stats", f"WITH {GRAPH_SQL}, I AS (SELECT id, kind FROM N WHERE kind IN ('Gene', 'Disease')) SELECT a.kind AS src_kind, e.metaedge, b.kind AS dst_kind, CAST(count(*) AS BIGINT) AS n, round(avg(e.weight) + 1e-10, 6) AS mean_weight FROM E e JOIN I a ON a.id = e.src JOIN I b ON b.id = e.dst GROUP BY ALL")
def subgraph_stats(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    ids = g.nodes.where(F.col("kind").isin("Gene", "Disease")).select("id", "kind")
    e = g.edges.join(ids.select(F.col("id").alias("src"), F.col("kind").alias("src_kind")), "src").join(ids.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind")), "dst")
    return e.groupBy("src_kind", "metaedge", "dst_kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("weight") + 1e-10, 6).alias("mean_weight"))


@R.add("top_degree_subgraph", f"WITH {GRAPH_SQL}, {DEGREE_SQL}, I AS (SELECT id FROM DEG ORDER BY degree DESC, id LIMIT 60) SELECT src, dst, metaedge, seq FROM E WHERE src IN (SELECT id FROM I) AND dst IN (SELECT id FROM I)")
def top_degree_subgraph(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    top = S.degrees(g.edges).orderBy(F.desc("degree"), "id").limit(60)
    return induced(g.edges, top).select("src", "dst", "metaedge", "seq")


@R.add("paginate_sort", f"WITH {GRAPH_SQL} SELECT id, name, kind FROM N ORDER BY kind DESC, name NULLS FIRST, id LIMIT 25 OFFSET 50")
def paginate_sort(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d).nodes.select("id", "name", "kind").orderBy(F.desc("kind"), F.asc_nulls_first("name"), "id").offset(50).limit(25)


def dfs_sql(seed: str) -> str:
    """DW(seed, id, depth): depth-first preorder to depth 2, the children of a seed taken in order of entry.

    A child seen before, below an earlier one, is not entered again, so its own children stay unseen.
    """
    return f"""CH AS (SELECT src, list(dst ORDER BY seq, dst) AS ch FROM (SELECT src, dst, min(seq) AS seq FROM E GROUP BY src, dst) GROUP BY src),
DF AS (SELECT s.id AS seed, 0 AS i, CAST([] AS VARCHAR[]) AS d1, [s.id] AS vis, coalesce(c.ch, []) AS ch FROM {seed} s LEFT JOIN CH c ON c.src = s.id
  UNION ALL SELECT w.seed, w.i + 1, CASE WHEN list_contains(w.vis, w.ch[w.i + 1]) THEN w.d1 ELSE list_append(w.d1, w.ch[w.i + 1]) END,
    CASE WHEN list_contains(w.vis, w.ch[w.i + 1]) THEN w.vis ELSE list_distinct(list_concat(list_append(w.vis, w.ch[w.i + 1]), coalesce(c.ch, []))) END, w.ch
  FROM DF w LEFT JOIN CH c ON c.src = w.ch[w.i + 1] WHERE w.i < len(w.ch)),
DW AS (SELECT seed, x AS id, CASE WHEN x = seed THEN 0 WHEN list_contains(d1, x) THEN 1 ELSE 2 END AS depth FROM (SELECT seed, d1, unnest(vis) AS x FROM DF WHERE i = len(ch)))"""


METHOD_SQL = f"""{SEEDS_SQL}, {STEP_SQL}, {_bfs_sql('SEEDS', 2, 'STEP')}, {dfs_sql('SEEDS')},
M1 AS (SELECT id, min(depth) AS depth FROM B GROUP BY id),
M2 AS (SELECT id, min(depth) AS depth FROM DW GROUP BY id),
M3 AS (SELECT DISTINCT dst AS id, 1 AS depth FROM STEP WHERE src IN (SELECT id FROM SEEDS))"""
MULTI_SQL = "H AS (SELECT id, depth, 'BFS' AS m FROM M1 UNION ALL SELECT id, depth, 'DFS' FROM M2 UNION ALL SELECT id, depth, 'NEIGHBORS' FROM M3)"
ENSEMBLE_SQL = "H AS (SELECT id, depth, 1.0 AS w FROM M1 UNION ALL SELECT id, depth, 0.8 FROM M2 UNION ALL SELECT id, depth, 0.9 FROM M3)"


def _parts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    g = load(spark, d).kept
    return parts(g, seeds(g))


@R.add("multi_method", f"WITH RECURSIVE {GRAPH_SQL}, {METHOD_SQL}, {MULTI_SQL} SELECT id, CAST(min(depth) AS INTEGER) AS depth, string_agg(m, '+' ORDER BY m) AS methods, CAST(count(*) AS BIGINT) AS n_methods, CAST(1 + 0.5 * (count(*) - 1) AS DOUBLE) AS score FROM H GROUP BY id")
def multi_method(spark: SparkSession, d: str) -> DataFrame:
    return K.merge_methods(_parts(spark, d)).withColumn("score", F.col("score").cast("double"))


@R.add("ensemble", f"WITH RECURSIVE {GRAPH_SQL}, {METHOD_SQL}, {ENSEMBLE_SQL} SELECT id, CAST(count(*) AS BIGINT) AS n_methods, round(sum(w / (depth + 1)) * (1 + 0.1 * count(*)), 6) AS score FROM H GROUP BY id")
def ensemble(spark: SparkSession, d: str) -> DataFrame:
    return K.ensemble(_parts(spark, d)).withColumn("score", F.round("score", 6))


ADAPTIVE_SQL = f"""{STEP_SQL}, {dfs_sql('KS')}, SB AS (SELECT id AS seed, id, 0 AS depth FROM KS UNION SELECT s.seed, e.dst, s.depth + 1 FROM SB s JOIN STEP e ON e.src = s.id WHERE s.depth < 2),
W2 AS (SELECT seed, id, min(depth) AS depth FROM SB GROUP BY seed, id),
H AS (SELECT w.id, w.depth, CASE WHEN k.kind IN ('Gene', 'Disease', 'Biological Process', 'Pathway') THEN 'BFS' ELSE 'Hybrid' END AS m, (w.seed, 0) AS o FROM W2 w JOIN KS k ON k.id = w.seed WHERE k.kind <> 'Compound'
  UNION ALL SELECT w.id, w.depth, 'DFS', (w.seed, CASE WHEN k.kind = 'Compound' THEN 0 ELSE 1 END) FROM DW w JOIN KS k ON k.id = w.seed WHERE k.kind IN ('Compound', 'Biological Process', 'Pathway')),
AD AS (SELECT id, arg_max(m, o) AS method, min(depth) AS depth, count(*) AS n FROM H GROUP BY id),
AH AS (SELECT id, method, depth, CASE method WHEN 'BFS' THEN 3.5 WHEN 'DFS' THEN 3.0 ELSE 2.0 END * (1 + 0.1 * n) / (depth + 1) AS score FROM AD)"""


@R.add("adaptive", f"WITH RECURSIVE {GRAPH_SQL}, KS AS (SELECT min(id) AS id, kind FROM N GROUP BY kind), {ADAPTIVE_SQL} SELECT id, method, CAST(depth AS INTEGER) AS depth, round(score, 6) AS score FROM AH")
def adaptive(spark: SparkSession, d: str) -> DataFrame:
    """From one seed of every kind, each walked as its kind asks."""
    g = load(spark, d).kept
    return adaptive_hits(g, g.nodes.groupBy("kind").agg(F.min("id").alias("id"))).withColumn("score", F.round("score", 6))


@R.add("per_group_quota", f"WITH {GRAPH_SQL}, {DEGREE_SQL}, H AS (SELECT n.id, n.kind, d.degree AS score FROM N n JOIN DEG d ON d.id = n.id), Q AS (SELECT greatest(1, 60 // greatest(count(DISTINCT kind), 1)) AS q FROM H), X AS (SELECT id, kind, score, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS rn FROM H) SELECT id, kind, score FROM X, Q WHERE rn <= q ORDER BY score DESC, id LIMIT 60")
def per_group_quota(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    hits = S.degrees(g.edges).join(g.nodes.select("id", "kind"), "id").select("id", "kind", F.col("degree").alias("score"))
    return K.group_quota(hits, "kind", 60)


@R.add("core_lock", f"WITH RECURSIVE {GRAPH_SQL}, {GENES_SQL}, {STEP_SQL}, {_bfs_sql('SEEDS', 2, 'UND')}, D AS (SELECT id, min(depth) AS depth FROM B GROUP BY id) SELECT id, CAST(CASE depth WHEN 0 THEN 120.0 ELSE 5.0 END AS DOUBLE) AS bonus FROM D")
def core_lock(spark: SparkSession, d: str) -> DataFrame:
    """Core entities score 100 and 20 more at distance 0; what lies within two steps gets 5."""
    g = load(spark, d).kept
    return T.bfs(g.edges, seeds(g, "Gene", 5), 2, "both").select("id", F.when(F.col("depth") == 0, 120.0).otherwise(5.0).alias("bonus"))


RANK_SQL = f"""{SEEDS_SQL}, {DEGREE_SQL},
A AS (SELECT * FROM E WHERE metaedge IN ('CbG', 'GiG', 'Gr>G', 'CtD', 'DaG')),
P AS (SELECT s.id AS start, a.dst AS nd, [s.id, a.dst] AS path, [a.metaedge] AS metas, [a.seq] AS seqs, 1 AS hops FROM SEEDS s JOIN A a ON a.src = s.id WHERE a.dst <> s.id
  UNION ALL SELECT s.id, b.dst, [s.id, a.dst, b.dst], [a.metaedge, b.metaedge], [a.seq, b.seq], 2 FROM SEEDS s JOIN A a ON a.src = s.id JOIN A b ON b.src = a.dst WHERE a.dst <> s.id AND b.dst <> s.id AND b.dst <> a.dst),
G AS (SELECT n.id, 1.0 / (1.0 + ln(1.0 + d.degree)) AS h FROM N n JOIN DEG d ON d.id = n.id WHERE n.kind = 'Gene'),
ST AS (SELECT seq, CASE metaedge WHEN 'CtD' THEN 1.2 WHEN 'GcG' THEN 1.0 + 0.5 * least(1.0, greatest(0.0, weight)) ELSE 1.0 END + 0.05 * coalesce(evidence, 0) AS s FROM E),
PS AS (SELECT p.start, p.nd, p.path, p.metas, p.seqs, p.hops, avg(st.s) AS strength FROM (SELECT *, unnest(seqs) AS sq FROM P) p JOIN ST st ON st.seq = p.sq GROUP BY ALL),
PH AS (SELECT p.seqs, avg(g.h) AS hub FROM (SELECT *, unnest(path) AS x FROM P) p JOIN G g ON g.id = p.x GROUP BY p.seqs),
V AS (SELECT ps.*, round(0.35 * CASE WHEN list_contains(metas, 'CtD') THEN 1.0 ELSE 0.0 END + 0.25 * strength + 0.20 * len(list_filter(metas, lambda m: m IN ('CtD', 'DaG'))) / len(metas) + 0.10 * CASE hops WHEN 1 THEN 1.0 ELSE 0.8 END + 0.05 * coalesce(ph.hub, 1.0), 9) AS v FROM PS ps LEFT JOIN PH ph ON ph.seqs = ps.seqs),
RK AS (SELECT *, row_number() OVER (PARTITION BY start, nd ORDER BY v DESC, array_to_string(path, '>'), array_to_string(metas, '>')) AS rn FROM V)"""


@R.add("rank_paths", f"WITH {GRAPH_SQL}, {RANK_SQL} SELECT start, array_to_string(path, ' > ') AS path, array_to_string(metas, ' ') AS metas, round(v + CASE WHEN rn = 1 THEN 0.05 ELSE 0 END, 6) AS score FROM RK")
def rank_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of a treatment question: matched by a treatment edge, fitted to treatment and association edges."""
    g = load(spark, d).kept
    paths = T.simple_paths(g.edges, seeds(g), 2, allow=["CbG", "GiG", "Gr>G", "CtD", "DaG"])
    match = F.array_contains("metas", "CtD").cast("double")
    ranked = K.rank_paths(paths, ["CtD", "DaG"], g.nodes, g.edges, S.degrees(g.edges), match)
    return ranked.select("start", F.array_join("path", " > ").alias("path"), F.array_join("metas", " ").alias("metas"), F.round("score", 6).alias("score"))


def _pagerank_sql(rounds: int) -> str:
    parts = ["O AS (SELECT src, count(*) AS o FROM E GROUP BY src)", "L AS (SELECT e.src, e.dst, count(*) * 1.0 / max(O.o) AS share FROM E e JOIN O ON O.src = e.src GROUP BY e.src, e.dst)", "CN AS (SELECT count(*) AS n FROM N)", "R0 AS (SELECT id, 1.0 / (SELECT n FROM CN) AS r FROM N)"]
    for i in range(rounds):
        parts.append(f"X{i} AS (SELECT L.dst AS id, sum(p.r * L.share) AS i FROM L JOIN R{i} p ON p.id = L.src GROUP BY L.dst)")
        parts.append(f"R{i + 1} AS (SELECT n.id, 0.15 / CN.n + 0.85 * (coalesce(x.i, 0) + (SELECT coalesce(sum(p.r), 0) FROM R{i} p WHERE p.id NOT IN (SELECT src FROM O)) / CN.n) AS r FROM N n CROSS JOIN CN LEFT JOIN X{i} x ON x.id = n.id)")
    return ", ".join(parts)


@R.add("pagerank10", f"WITH {GRAPH_SQL}, {_pagerank_sql(10)} SELECT id, round(r, 8) AS rank FROM R10")
def pagerank10(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return A.pagerank(g.nodes, g.edges, 10).select("id", F.round("rank", 8).alias("rank"))


GENE_SUB = GRAPH_SQL.replace("N AS (", "N0 AS (", 1).replace("E AS (", "E0 AS (", 1).replace("FROM N)", "FROM N0)")


@R.add("gene_pagerank", f"WITH {GENE_SUB}, N AS (SELECT * FROM N0 WHERE kind = 'Gene'), E AS (SELECT * FROM E0 WHERE src IN (SELECT id FROM N) AND dst IN (SELECT id FROM N)), {_pagerank_sql(5)} SELECT id, round(r, 8) AS rank FROM R5")
def gene_pagerank(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    genes = g.nodes.where("kind = 'Gene'")
    return A.pagerank(genes, induced(g.edges, genes), 5).select("id", F.round("rank", 8).alias("rank"))


@R.add("degree_centrality", f"WITH {GRAPH_SQL}, {DEGREE_SQL} SELECT n.id, round(coalesce(d.degree, 0) / ((SELECT count(*) FROM N) - 1.0), 8) AS centrality FROM N n LEFT JOIN DEG d ON d.id = n.id")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return A.degree_centrality(g.nodes, g.edges).select("id", F.round("centrality", 8).alias("centrality"))


@R.add("closeness", f"WITH RECURSIVE {GRAPH_SQL}, {SEEDS_SQL}, {STEP_SQL}, BACK AS (SELECT dst AS src, src AS dst FROM STEP), {walk_sql('SEEDS', 'BACK')}, C AS (SELECT seed, count(*) AS r, sum(depth) AS t FROM M WHERE depth > 0 GROUP BY seed) SELECT s.id, round(coalesce(r * 1.0 / t * r / ((SELECT count(*) FROM N) - 1.0), 0), 8) AS closeness FROM SEEDS s LEFT JOIN C ON C.seed = s.id")
def closeness(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return A.closeness(g.edges, g.nodes, seeds(g)).select("id", F.round("closeness", 8).alias("closeness"))


def _lpa_sql(rounds: int) -> str:
    parts = ["L0 AS (SELECT id, id AS label FROM N)"]
    for i in range(rounds):
        parts.append(f"V{i} AS (SELECT UU.a AS id, l.label, count(*) AS n FROM UU JOIN L{i} l ON l.id = UU.b GROUP BY ALL)")
        parts.append(f"W{i} AS (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS rn FROM V{i}) WHERE rn = 1)")
        parts.append(f"L{i + 1} AS (SELECT l.id, coalesce(w.label, l.label) AS label FROM L{i} l LEFT JOIN W{i} w ON w.id = l.id)")
    return ", ".join(parts)


@R.add("label_propagation5", f"WITH {GRAPH_SQL}, {UND_SQL}, {_lpa_sql(5)} SELECT id, label FROM L5")
def label_propagation5(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return A.label_propagation(g.nodes, g.edges, 5)


def _eigen_sql(rounds: int, every: int) -> str:
    out = ["LN AS (SELECT DISTINCT src, dst FROM E)", "V0 AS (SELECT id, 1.0::DOUBLE AS x FROM N)"]
    for i in range(1, rounds + 1):
        out.append(f"U{i} AS (SELECT v.id, v.x + coalesce(g.s, 0) AS x FROM V{i - 1} v LEFT JOIN (SELECT LN.dst AS id, sum(p.x) AS s FROM LN JOIN V{i - 1} p ON p.id = LN.src GROUP BY LN.dst) g ON g.id = v.id)")
        scale = f"/ (SELECT sqrt(sum(x * x)) FROM U{i})" if i % every == 0 or i == rounds else ""
        out.append(f"V{i} AS (SELECT id, x {scale} AS x FROM U{i})")
    return ", ".join(out)


@R.add("eigenvector20", f"WITH {GRAPH_SQL}, {_eigen_sql(20, 5)} SELECT id, round(x, 8) AS value FROM V20")
def eigenvector20(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return A.eigenvector(g.nodes, g.edges, 20).select("id", F.round("value", 8).alias("value"))


BRANDES = f"""{walk_sql('SEEDS', 'STEP')},
D AS (SELECT a.seed, s.src, s.dst, b.depth FROM STEP s JOIN M a ON a.id = s.src JOIN M b ON b.id = s.dst AND b.seed = a.seed WHERE b.depth = a.depth + 1),
P AS (SELECT seed, id, 0 AS depth, 1.0::DOUBLE AS paths FROM M WHERE depth = 0 UNION ALL SELECT d.seed, d.dst, d.depth, sum(p.paths) FROM P p JOIN D d ON d.seed = p.seed AND d.src = p.id AND d.depth = p.depth + 1 GROUP BY d.seed, d.dst, d.depth),
B AS (SELECT seed, id, depth, 0.0::DOUBLE AS dep FROM M WHERE depth = (SELECT max(depth) FROM M)
  UNION ALL SELECT m.seed, m.id, m.depth, coalesce(sum(pm.paths / pb.paths * (1 + b.dep)), 0) FROM M m JOIN (SELECT max(depth) - 1 AS l FROM B) x ON m.depth = x.l JOIN P pm ON pm.seed = m.seed AND pm.id = m.id
    LEFT JOIN D d ON d.seed = m.seed AND d.src = m.id LEFT JOIN B b ON b.seed = d.seed AND b.id = d.dst LEFT JOIN P pb ON pb.seed = d.seed AND pb.id = d.dst GROUP BY m.seed, m.id, m.depth)"""


@R.add("betweenness_seeds", f"WITH RECURSIVE {GRAPH_SQL}, {SEEDS_SQL}, {STEP_SQL}, {BRANDES} SELECT id, round(sum(dep), 6) AS betweenness FROM B WHERE seed <> id GROUP BY id")
def betweenness_seeds(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)  # read once by the walk's own table of steps
    return A.betweenness(g.edges, seeds(g, "Compound", 3)).withColumn("betweenness", F.round("betweenness", 6))


@R.add("modularity_communities")
def modularity_communities(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return A.modularity_communities(g.nodes, g.edges)


def _prune_sql(rounds: int) -> str:
    out = ["K0 AS (SELECT * FROM E)"]
    for i in range(rounds):
        out.append(f"D{i} AS (SELECT id, count(*) / ((SELECT count(*) FROM N) - 1.0) AS c FROM (SELECT src AS id FROM K{i} UNION ALL SELECT dst FROM K{i}) GROUP BY id)")
        out.append(f"K{i + 1} AS (SELECT k.* FROM K{i} k JOIN D{i} a ON a.id = k.src JOIN D{i} b ON b.id = k.dst WHERE (a.c + b.c) / 2 > 0.1 OR k.weight > 0.6)")
    return ", ".join(out)


@R.add("structure_pruning", f"WITH {GRAPH_SQL}, {_prune_sql(3)} SELECT src, dst, metaedge, seq FROM K3")
def structure_pruning(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return A.prune(g.nodes, g.edges).select("src", "dst", "metaedge", "seq")


@R.add("mean_distance", f"WITH RECURSIVE {GRAPH_SQL}, {SEEDS_SQL}, {STEP_SQL}, {walk_sql('SEEDS', 'UND')} SELECT CAST(count(*) AS BIGINT) AS pairs, round(avg(depth), 6) AS mean_distance, CAST(max(depth) AS INTEGER) AS diameter FROM M WHERE depth > 0")
def mean_distance(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return A.mean_distance(g.edges, seeds(g)).withColumn("mean_distance", F.round("mean_distance", 6))


@R.add("pagerank_summary", f"WITH {GRAPH_SQL}, {_pagerank_sql(5)}, T AS (SELECT r.id, r.r, n.kind FROM R5 r JOIN N n ON n.id = r.id ORDER BY round(r.r, 12) DESC, r.id LIMIT 100) SELECT round(avg(r), 8) AS mean_rank, round(avg(CASE WHEN kind = 'Gene' THEN 1.0 ELSE 0 END), 6) AS gene_share FROM T")
def pagerank_summary(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    top = A.pagerank(g.nodes, g.edges, 5).join(g.nodes.select("id", "kind"), "id").orderBy(F.desc(F.round("rank", 12)), "id").limit(100)
    return top.agg(F.round(F.avg("rank"), 8).alias("mean_rank"), F.round(F.avg((F.col("kind") == "Gene").cast("double")), 6).alias("gene_share"))


@R.add("hub_seed", f"WITH {GRAPH_SQL}, {HUB_SQL} SELECT id FROM HUB")
def hub_seed(spark: SparkSession, d: str) -> DataFrame:
    return hub(load(spark, d))
