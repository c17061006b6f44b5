"""Queries of scores, patterns of several steps, distances, communities and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.model import GRAPH_SQL, REVERSE, SCORE_SQL, oriented
from graphloom.operators import analytics as A, scores as C, stats as S, traverse as T
from graphloom.operators.expand import enrich, induced
from graphloom.plans import intent as I, multihop as M
from graphloom.plans.context import ANSWERS, STYLES, answers, line_counts, render
from graphloom.queries.analysis import BRANDES, DEGREE_SQL, _pagerank_sql, dfs_sql
from graphloom.queries.base import Registry
from graphloom.queries.graph import GENES_SQL, SEEDS_SQL, STEP_SQL, load, seeds, walk_sql

R = Registry()

_TWO = """P AS (SELECT s.id AS start, [s.id, a.dst] AS path, [a.metaedge] AS metas FROM SEEDS s JOIN E a ON a.src = s.id WHERE a.dst <> s.id
  UNION ALL SELECT s.id, [s.id, a.dst, b.dst], [a.metaedge, b.metaedge] FROM SEEDS s JOIN E a ON a.src = s.id JOIN E b ON b.src = a.dst WHERE a.dst <> s.id AND b.dst NOT IN (s.id, a.dst))"""


@R.add(
    "path_importance",
    f"""WITH {GRAPH_SQL}, {SEEDS_SQL}, {DEGREE_SQL}, {_TWO}, X AS (SELECT DISTINCT path, unnest(path) AS id FROM P),
    Y AS (SELECT path, count(*) AS n, avg(d.degree) AS deg, avg(CASE WHEN n.kind = 'Gene' THEN 1.0 ELSE 0.0 END) AS g, avg(CASE WHEN n.kind = 'Disease' THEN 1.0 ELSE 0.0 END) AS ds FROM X JOIN N n ON n.id = X.id JOIN DEG d ON d.id = X.id GROUP BY path)
    SELECT p.start, array_to_string(p.path, ' > ') AS path, array_to_string(p.metas, ' ') AS metas, round(0.3 / n + 0.4 * deg + 0.3 * g, 6) AS importance, round(g, 6) AS gene_share, round(ds, 6) AS disease_share, round(g + ds, 6) AS significance FROM P p JOIN Y ON Y.path = p.path""",
)
def path_importance(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    paths = T.cut(T.simple_paths(g.edges, seeds(g), 2).select("start", "path", "metas"))
    m = C.path_measures(paths, g.nodes, S.degrees(g.edges))
    return m.select("start", F.array_join("path", " > ").alias("path"), F.array_join("metas", " ").alias("metas"), *[F.round(c, 6).alias(c) for c in ("importance", "gene_share", "disease_share", "significance")])


@R.add("path_sentences", f"WITH {GRAPH_SQL}, {SEEDS_SQL}, {_TWO}, NM AS (SELECT id, coalesce(name, id) AS nm FROM N) SELECT array_to_string(p.path, ' > ') AS path, array_to_string(p.metas, ' ') AS metas, CASE WHEN len(p.path) = 2 THEN a.nm || ' -[' || p.metas[1] || ']-> ' || b.nm ELSE a.nm || ' -[' || p.metas[1] || ']-> ' || b.nm || ' -[' || p.metas[2] || ']-> ' || c.nm END AS sentence FROM P p JOIN NM a ON a.id = p.path[1] JOIN NM b ON b.id = p.path[2] LEFT JOIN NM c ON c.id = p.path[3]")
def path_sentences(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    paths = T.cut(T.simple_paths(g.edges, seeds(g), 2).select("path", "metas"))
    named = C.named_paths(paths, g.nodes)
    return named.select(F.array_join("path", " > ").alias("path"), F.array_join("metas", " ").alias("metas"), C.path_sentence(F.col("names"), F.col("metas")).alias("sentence"))


@R.add("path_edges", f"WITH {GRAPH_SQL}, {SEEDS_SQL}, {_TWO} SELECT array_to_string(path, ' > ') AS path, CAST(i AS INTEGER) AS place, path[i] AS src, path[i + 1] AS dst, metas[i] AS metaedge FROM (SELECT path, metas, unnest(range(1, len(metas) + 1)) AS i FROM P)")
def path_edges(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    e = T.simple_paths(g.edges, seeds(g), 2).select("path", F.posexplode(C.path_edges(F.col("path"), F.col("metas"))).alias("i", "e"))
    return e.select(F.array_join("path", " > ").alias("path"), (F.col("i") + 1).alias("place"), "e.*")


@R.add("node_importance", f"WITH RECURSIVE {GRAPH_SQL}, {GENES_SQL}, {STEP_SQL}, {DEGREE_SQL}, {walk_sql('SEEDS', 'UND')}, C AS (SELECT seed, count(*) AS r, sum(depth) AS t FROM M WHERE depth > 0 GROUP BY seed) SELECT s.id, round(0.4 * coalesce(d.degree, 0) + 0.3 * coalesce(r * 1.0 / t * r / ((SELECT count(*) FROM N) - 1.0), 0) + 0.3 * CASE WHEN n.kind = 'Gene' THEN 1.0 ELSE 0.5 END, 6) AS importance FROM SEEDS s JOIN N n ON n.id = s.id LEFT JOIN DEG d ON d.id = s.id LEFT JOIN C ON C.seed = s.id")
def node_importance(spark: SparkSession, d: str) -> DataFrame:
    """Degree, closeness without direction and kind of the first genes."""
    g = load(spark, d).kept
    s = T.cut(seeds(g, "Gene", 5))
    both = oriented(g.edges, "both")
    rows = s.join(g.nodes.select("id", "kind"), "id").join(S.degrees(g.edges).select("id", "degree"), "id", "left").join(A.closeness(both, g.nodes, s), "id")
    return rows.select("id", F.round(C.node_importance(F.coalesce("degree", F.lit(0)), F.col("closeness"), F.col("kind") == "Gene"), 6).alias("importance"))


_REL = "RL AS (SELECT e.src AS id, e.dst AS nb, max(CASE WHEN contains(r, 'disease') THEN 2.0 WHEN contains(r, 'drug') THEN 1.5 WHEN contains(r, 'pathway') THEN 1.0 ELSE 0.0 END) AS b FROM (SELECT e.src, e.dst, lower(coalesce(m.verb, e.metaedge) || ' ' || coalesce(m.dst_kind, '')) AS r FROM E e LEFT JOIN metaedges m ON m.metaedge = e.metaedge) e GROUP BY e.src, e.dst)"


@R.add("biological_importance", f"WITH {GRAPH_SQL}, {_REL} SELECT id, round(CAST(0.1 * count(*) + sum(b) AS DOUBLE), 6) AS importance FROM RL GROUP BY id")
def biological_importance(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    text = F.concat_ws(" ", F.coalesce("verb", "metaedge"), F.coalesce("dst_kind", F.lit("")))
    rows = g.edges.join(F.broadcast(g.schema.select("metaedge", "verb", "dst_kind")), "metaedge", "left").select(F.col("src").alias("id"), F.col("dst").alias("nb"), text.alias("relation"))
    return C.biological_importance(rows).select("id", F.round("importance", 6).alias("importance"))


@R.add("feature_scores", f"WITH {GRAPH_SQL}, {DEGREE_SQL} SELECT n.id, round(0.5 * coalesce(d.degree, 0) + 2.0 * coalesce(w.s, 0), 6) AS score FROM N n LEFT JOIN DEG d ON d.id = n.id LEFT JOIN (SELECT src AS id, sum(weight) AS s FROM E GROUP BY src) w ON w.id = n.id")
def feature_scores(spark: SparkSession, d: str) -> DataFrame:
    """Weighted sum of rank features, missing ones counting 0."""
    g = load(spark, d).kept
    f = S.degrees(g.edges).select("id", "degree").join(S.strength(g.edges), "id", "full")
    rows = g.nodes.select("id").join(f, "id", "left").select("id", F.create_map(F.lit("degree"), F.col("degree").cast("double"), F.lit("strength"), F.col("strength")).alias("features"))
    return rows.select("id", F.round(C.feature_score(F.col("features"), {"degree": 0.5, "strength": 2.0, "absent": 9.0}), 6).alias("score"))


_CANCER = " OR ".join(f"contains(lower(n.name), '{w}')" for w in ("cancer", "tumor", "malignancy", "syndrome"))


@R.add(
    "expression_scores",
    f"""WITH RECURSIVE {GRAPH_SQL}, SEEDS AS (SELECT id FROM N WHERE kind = 'Anatomy' ORDER BY id LIMIT 3), EA AS (SELECT * FROM E WHERE metaedge = 'AeG'), {dfs_sql('SEEDS').replace('FROM E ', 'FROM EA ')},
    H AS (SELECT e.dst AS id, 1 AS depth, CASE e.metaedge WHEN 'AeG' THEN 5.0 WHEN 'AuG' THEN 4.5 ELSE 4.0 END AS score FROM E e WHERE e.src IN (SELECT id FROM SEEDS) AND e.metaedge IN ('AeG', 'AuG', 'AdG')
      UNION ALL SELECT e.src, 1, CASE e.metaedge WHEN 'AeG' THEN 4.0 WHEN 'AuG' THEN 3.5 ELSE 3.0 END FROM E e WHERE e.dst IN (SELECT id FROM SEEDS) AND e.metaedge IN ('AeG', 'AuG', 'AdG')
      UNION ALL SELECT id, depth, 4.0 / depth FROM DW WHERE depth > 0)
    SELECT h.id, CAST(arg_min(depth, (-score, depth)) AS INTEGER) AS depth, CAST(max(score) AS DOUBLE) AS score FROM H h JOIN N n ON n.id = h.id AND n.kind = 'Gene' GROUP BY h.id""",
)
def expression_scores(spark: SparkSession, d: str) -> DataFrame:
    """Genes expressed in the first tissues: fixed scores by metaedge and direction, less with depth."""
    g = load(spark, d).kept
    return M.expression_hits(g, seeds(g, "Anatomy", 3))


@R.add(
    "gene_disease_scores",
    f"""WITH RECURSIVE {GRAPH_SQL}, {GENES_SQL}, {dfs_sql('SEEDS')}, DN AS (SELECT n.id, ({_CANCER}) AS c FROM N n WHERE n.kind = 'Disease'),
    H AS (SELECT id, 0 AS depth, 10.0 AS score FROM SEEDS
      UNION ALL SELECT e.dst, 1, {SCORE_SQL.format(e='e', d='1')} * CASE WHEN c THEN 2.0 ELSE 1.0 END FROM E e JOIN DN ON DN.id = e.dst LEFT JOIN metaedges m ON m.metaedge = e.metaedge WHERE e.src IN (SELECT id FROM SEEDS)
      UNION ALL SELECT e.src, 1, 0.8 * {SCORE_SQL.format(e='e', d='1')} * CASE WHEN c THEN 2.0 ELSE 1.0 END FROM E e JOIN DN ON DN.id = e.src LEFT JOIN metaedges m ON m.metaedge = e.metaedge WHERE e.dst IN (SELECT id FROM SEEDS)
      UNION ALL SELECT w.id, w.depth, 2.5 * CASE w.depth WHEN 1 THEN 1.0 ELSE 0.7 END * CASE WHEN c THEN 1.5 ELSE 1.0 END / w.depth FROM DW w JOIN DN ON DN.id = w.id WHERE w.depth > 0)
    SELECT id, CAST(arg_min(depth, (-round(score, 9), depth)) AS INTEGER) AS depth, round(max(score), 6) AS score FROM H GROUP BY id""",
)
def gene_disease_scores(spark: SparkSession, d: str) -> DataFrame:
    """The first genes and the diseases around them; those named as cancers (here also syndromes) count more."""
    g = load(spark, d).kept
    return M.gene_disease_hits(g, seeds(g, "Gene", 5), ("cancer", "tumor", "malignancy", "syndrome"))


_BACK = {b: a for a, b in REVERSE.items()}
_STEP = lambda code: f"(SELECT dst AS src, src AS dst FROM E WHERE metaedge = '{_BACK[code]}')" if code in _BACK else f"(SELECT src, dst FROM E WHERE metaedge = '{code}')"
_HITS = " UNION ALL ".join(
    f"SELECT DISTINCT b.dst AS id, 2 AS depth, (5.0 + 2.0 + 1.0) / 3 AS score FROM SEEDS s JOIN {_STEP(p[0])} a ON a.src = s.id JOIN {_STEP(p[1])} b ON b.src = a.dst WHERE a.dst <> s.id AND b.dst NOT IN (s.id, a.dst)" for p in I.PATTERNS["complex_treatment"]
)


@R.add("multi_hop_search", f"WITH {GRAPH_SQL}, SEEDS AS (SELECT id FROM N WHERE kind IN ('Compound', 'Disease')) SELECT id, CAST(min(depth) AS INTEGER) AS depth, round(max(score), 6) AS score FROM ({_HITS}) GROUP BY id")
def multi_hop_search(spark: SparkSession, d: str) -> DataFrame:
    """Ends of the patterns of a treatment question of several steps, from all compounds and diseases."""
    g = load(spark, d).kept
    return M.multi_hop(g, g.nodes.where(F.col("kind").isin("Compound", "Disease")), "Which drug treats the disease?")


@R.add("pagerank_converged", f"WITH {GRAPH_SQL}, {_pagerank_sql(30)}, MV AS (" + " UNION ALL ".join(f"SELECT {i + 1} AS i, (SELECT sum(abs(a.r - b.r)) FROM R{i} a JOIN R{i + 1} b ON b.id = a.id) AS moved" for i in range(30)) + "), LAST AS (SELECT min(i) AS i FROM MV WHERE moved < (SELECT n FROM CN) * 1e-6), " + "A AS (" + " UNION ALL ".join(f"SELECT {i + 1} AS i, id, r FROM R{i + 1}" for i in range(30)) + ") SELECT id, round(r, 8) AS rank FROM A WHERE i = (SELECT i FROM LAST)")
def pagerank_converged(spark: SparkSession, d: str) -> DataFrame:
    """Until the ranks move by less than a millionth a node; the SQL unrolls thirty rounds and picks the first such one."""
    g = load(spark, d).kept
    return A.pagerank(g.nodes, g.edges, 100, tolerance=1e-6).select("id", F.round("rank", 8).alias("rank"))


@R.add("pagerank_top5", f"WITH {GRAPH_SQL}, {_pagerank_sql(5)} SELECT id, round(r, 8) AS rank FROM (SELECT id, r FROM R5 ORDER BY round(r, 12) DESC, id LIMIT 5)")
def pagerank_top5(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return A.pagerank(g.nodes, g.edges, 5).orderBy(F.desc(F.round("rank", 12)), "id").limit(5).select("id", F.round("rank", 8).alias("rank"))


_DRD = f"{GRAPH_SQL}, SEEDS AS (SELECT id FROM N WHERE kind = 'Disease'), DE AS (SELECT src, dst FROM E WHERE metaedge = 'DrD' AND src IN (SELECT id FROM SEEDS) AND dst IN (SELECT id FROM SEEDS)), STEP AS (SELECT DISTINCT src, dst FROM DE WHERE src <> dst), UND AS (SELECT src, dst FROM STEP UNION SELECT dst, src FROM STEP)"


@R.add("all_distances", f"WITH RECURSIVE {_DRD}, {walk_sql('SEEDS', 'UND')} SELECT CAST(count(*) FILTER (depth > 0) AS BIGINT) AS pairs, round(avg(depth) FILTER (depth > 0), 6) AS mean_distance, CAST(max(depth) AS INTEGER) AS diameter, count(*) = (SELECT count(*) * count(*) FROM SEEDS) AS connected FROM M")
def all_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances between all diseases over similarity edges, and whether they are one component."""
    g = load(spark, d).kept
    nodes = g.nodes.where("kind = 'Disease'")
    edges = T.cut(induced(g.edges.where("metaedge = 'DrD'"), nodes))
    return A.distance_summary(edges, nodes).withColumn("mean_distance", F.round("mean_distance", 6))


@R.add("betweenness_whole", f"WITH RECURSIVE {_DRD}, {BRANDES} SELECT id, round(sum(dep), 6) AS betweenness FROM B WHERE seed <> id GROUP BY id")
def betweenness_whole(spark: SparkSession, d: str) -> DataFrame:
    """Over all sources of the graph of similar diseases."""
    g = load(spark, d).kept
    nodes = g.nodes.where("kind = 'Disease'")
    edges = T.cut(induced(g.edges.where("metaedge = 'DrD'"), nodes))
    return A.betweenness(edges, nodes).withColumn("betweenness", F.round("betweenness", 6))


@R.add("louvain_communities")
def louvain_communities(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return A.louvain(g.nodes, g.edges)


@R.add("disease_gene_stats", f"WITH {GRAPH_SQL}, DG AS (SELECT DISTINCT e.src AS d, e.dst AS g FROM E e JOIN N a ON a.id = e.src AND a.kind = 'Disease' JOIN N b ON b.id = e.dst AND b.kind = 'Gene') SELECT CAST(count(*) AS BIGINT) AS pairs, CAST(count(DISTINCT d) AS BIGINT) AS diseases, CAST(count(DISTINCT g) AS BIGINT) AS genes, round(count(*) * 1.0 / count(DISTINCT d), 6) AS genes_per_disease FROM DG")
def disease_gene_stats(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    kind = lambda k, c: g.nodes.where(F.col("kind") == k).select(F.col("id").alias(c))
    pairs = g.edges.select("src", "dst").distinct().join(kind("Disease", "src"), "src", "left_semi").join(kind("Gene", "dst"), "dst", "left_semi")
    m = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("src").alias("diseases"), F.countDistinct("dst").alias("genes"))
    return m.withColumn("genes_per_disease", F.round(F.try_divide("pairs", "diseases"), 6))


_SENT = "S AS (SELECT e.src, e.metaedge, concat_ws(' ', coalesce(a.name, e.src), coalesce(m.verb, e.metaedge), coalesce(b.name, e.dst)) AS s FROM E e LEFT JOIN N a ON a.id = e.src LEFT JOIN N b ON b.id = e.dst LEFT JOIN metaedges m ON m.metaedge = e.metaedge)"


def _fill_sql(t: str, **v: str) -> str:
    for k, x in v.items():
        t = t.replace("{" + k + "}", f"\x00{x}\x00")
    parts = t.split("\x00")
    return " || ".join(p if i % 2 else "'" + p.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for i, p in enumerate(parts) if i % 2 or p) or "''"


def _style_sql(name: str) -> str:
    head, line, glue, codes = STYLES[name]
    rows = "S" if codes is None else f"(SELECT * FROM S WHERE metaedge IN {codes})"
    return f"SELECT '{name}' AS style, src, {_fill_sql(head, k='src')} || string_agg({_fill_sql(line, s='s', m='metaedge', i='CAST(rn AS VARCHAR)')}, {_fill_sql(glue)} ORDER BY metaedge, s) AS context FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY metaedge, s) AS rn FROM {rows}) WHERE rn <= 5 GROUP BY src"


@R.add("context_styles", f"WITH {GRAPH_SQL}, {_SENT}, C AS ({' UNION ALL '.join(map(_style_sql, STYLES))}) SELECT style, src, md5(context) AS context FROM C")
def context_styles(spark: SparkSession, d: str) -> DataFrame:
    """Every node's context in every style."""
    g = load(spark, d)
    s = T.cut(enrich(g.edges, g.nodes, g.schema).select("src", "metaedge", "sentence"))
    out = None
    for style in STYLES:
        c = render(s, "src", 5, style).select(F.lit(style).alias("style"), "src", F.md5("context").alias("context"))
        out = c if out is None else out.unionByName(c)
    return out


@R.add("context_line_counts", f"WITH {GRAPH_SQL}, {_SENT}, C AS ({_style_sql('stepwise')}), L AS (SELECT src, lower(unnest(string_split(context, chr(10)))) AS line FROM C), W AS (SELECT unnest(['expresses', 'treats', 'regulates', 'pain']) AS word) SELECT src, word, CAST(count(*) FILTER (contains(line, word)) AS BIGINT) AS n FROM L CROSS JOIN W GROUP BY src, word")
def context_line_counts(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return line_counts(render(enrich(g.edges, g.nodes, g.schema).select("src", "metaedge", "sentence"), "src", 5, "stepwise"), "src", ["expresses", "treats", "regulates", "pain"])


@R.add("answer_sentences", f"WITH {GRAPH_SQL}, NM AS (SELECT id, coalesce(name, id) AS nm FROM N), PH AS (SELECT unnest({list(ANSWERS)}) AS metaedge, unnest({list(ANSWERS.values())}) AS p), T AS (SELECT e.src, e.metaedge, n.nm, e.dst, row_number() OVER (PARTITION BY e.src, e.metaedge ORDER BY n.nm, e.dst) AS rn FROM E e JOIN NM n ON n.id = e.dst) SELECT T.src AS id, T.metaedge, any_value(a.nm) || ' ' || any_value(p) || ' ' || string_agg(T.nm, ', ' ORDER BY rn) || '.' AS answer FROM T JOIN PH ON PH.metaedge = T.metaedge JOIN NM a ON a.id = T.src WHERE rn <= 3 GROUP BY T.src, T.metaedge")
def answer_sentences(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return answers(g.edges, g.nodes)


@R.add("answer_quality", f"WITH {GRAPH_SQL}, {SEEDS_SQL}, {STEP_SQL}, H AS (SELECT dst AS id, max(weight) AS score FROM E WHERE src IN (SELECT id FROM SEEDS) GROUP BY dst), I AS (SELECT count(*) AS m FROM (SELECT DISTINCT src, dst FROM E WHERE src IN (SELECT id FROM H) AND dst IN (SELECT id FROM H))) SELECT CAST(count(*) AS BIGINT) AS n_hits, round(avg(score) + 1e-10, 6) AS mean_score, round(any_value(m) * 1.0 / count(*) + 1e-10, 6) AS density FROM H, I")
def answer_quality(spark: SparkSession, d: str) -> DataFrame:
    """Hits next to the seeds: how many, their mean score and the edges among them for each."""
    g = load(spark, d).kept
    hits = g.edges.join(seeds(g).select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.max("weight").alias("score"))
    return S.answer_quality(T.cut(hits), g.edges).select("n_hits", F.round(F.col("mean_score") + 1e-10, 6).alias("mean_score"), F.round(F.col("density") + 1e-10, 6).alias("density"))
