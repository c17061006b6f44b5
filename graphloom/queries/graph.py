"""Queries of expansion, traversal and paths over the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.model import GRAPH_SQL, SCORE_SQL, PropertyGraph
from graphloom.operators import expand as X, traverse as T
from graphloom.queries.base import Registry

R = Registry()

HUB_SQL = "HUB AS (SELECT src AS id FROM E GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
SEEDS_SQL = "SEEDS AS (SELECT id FROM N WHERE kind = 'Compound' ORDER BY id LIMIT 3)"
GENES_SQL = "SEEDS AS (SELECT id FROM N WHERE kind = 'Gene' ORDER BY id LIMIT 5)"


def load(spark: SparkSession, d: str) -> PropertyGraph:
    return PropertyGraph.load(spark, d)


def hub(g: PropertyGraph) -> DataFrame:
    """The node that most edges leave: the seed of hub queries."""
    return g.edges.groupBy(F.col("src").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id")


def seeds(g: PropertyGraph, kind: str = "Compound", k: int = 3) -> DataFrame:
    """The first ``k`` nodes of a kind: the fallback seeds of a question."""
    return g.nodes.where(F.col("kind") == kind).select("id").orderBy("id").limit(k)


EXPAND_SQL = f"""hits AS (SELECT e.dst AS id, {SCORE_SQL.format(e='e', d='1')} AS s FROM E e LEFT JOIN metaedges m ON e.metaedge = m.metaedge WHERE e.src IN (SELECT id FROM HUB)),
back AS (SELECT e.src AS id, 0.8 * {SCORE_SQL.format(e='e', d='1')} AS s FROM E e LEFT JOIN metaedges m ON e.metaedge = m.metaedge WHERE e.dst IN (SELECT id FROM HUB))"""


@R.add("kg_expand", f"WITH {GRAPH_SQL}, {HUB_SQL}, {EXPAND_SQL} SELECT n.id, n.name, n.kind, 1 AS depth, round(max(s), 6) AS score FROM hits h JOIN N n ON n.id = h.id GROUP BY n.id, n.name, n.kind ORDER BY score DESC, n.id LIMIT 50")
def kg_expand(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return X.top_hits(X.expand(g, hub(g)), 50)


@R.add("expand_both_damped", f"WITH {GRAPH_SQL}, {HUB_SQL}, {EXPAND_SQL} SELECT n.id, n.kind, round(max(s), 6) AS score FROM (SELECT * FROM hits UNION ALL SELECT * FROM back) h JOIN N n ON n.id = h.id GROUP BY n.id, n.kind")
def expand_both_damped(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return X.expand(g, hub(g), orientation="both").select("id", "kind", "score")


@R.add("expand_in_codes", f"WITH {GRAPH_SQL}, D AS (SELECT id FROM N WHERE kind = 'Disease') SELECT n.id, n.kind, round(max(0.8 * {SCORE_SQL.format(e='e', d='1')}), 6) AS score FROM E e LEFT JOIN metaedges m ON e.metaedge = m.metaedge JOIN N n ON n.id = e.src WHERE e.metaedge IN ('CtD', 'CpD') AND e.dst IN (SELECT id FROM D) GROUP BY n.id, n.kind")
def expand_in_codes(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return X.expand(g, g.nodes.where("kind = 'Disease'"), ["CtD", "CpD"], "in").select("id", "kind", "score")


@R.add("neighbors_by_type", f"WITH {GRAPH_SQL}, {HUB_SQL} SELECT DISTINCT e.src, n.id, n.name, n.kind FROM E e JOIN N n ON n.id = e.dst WHERE e.src IN (SELECT id FROM HUB) AND n.kind = 'Gene'")
def neighbors_by_type(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return X.neighbors(g, hub(g), "Gene")


@R.add("search_nodes", "WITH " + GRAPH_SQL + " SELECT id, name, kind FROM N WHERE contains(lower(name), 'syndrome') OR lower(kind) = 'pathway'")
def search_nodes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d).nodes.where(F.lower("name").contains("syndrome") | (F.lower("kind") == "pathway")).select("id", "name", "kind")


@R.add("search_edges", "WITH " + GRAPH_SQL + " SELECT src, dst, metaedge FROM E WHERE metaedge NOT IN ('DrD', 'CrC') AND metaedge IN ('CtD', 'CpD', 'DrD')")
def search_edges(spark: SparkSession, d: str) -> DataFrame:
    deny, allow = ["DrD", "CrC"], ["CtD", "CpD", "DrD"]
    return load(spark, d).edges.where(~F.col("metaedge").isin(deny) & F.col("metaedge").isin(allow)).select("src", "dst", "metaedge")


@R.add("induced_edges", f"WITH {GRAPH_SQL}, I AS (SELECT id FROM N WHERE kind IN ('Disease', 'Symptom', 'Anatomy')) SELECT src, dst, metaedge, seq FROM E WHERE src IN (SELECT id FROM I) AND dst IN (SELECT id FROM I)")
def induced_edges(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return X.induced(g.edges, g.nodes.where(F.col("kind").isin("Disease", "Symptom", "Anatomy"))).select("src", "dst", "metaedge", "seq")


@R.add("has_edge_pairs", f"WITH {GRAPH_SQL}, K AS (SELECT id FROM N WHERE kind = 'Gene') SELECT DISTINCT e.src, e.dst FROM E e JOIN K a ON a.id = e.src JOIN K b ON b.id = e.dst WHERE a.id < b.id")
def has_edge_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Of all genes, ranked by id."""
    g = load(spark, d)
    return X.forward_pairs(g.edges, g.nodes.where("kind = 'Gene'").select("id", F.col("id").alias("rank")))


@R.add("enrich_left", f"WITH {GRAPH_SQL} SELECT e.src, e.metaedge, e.dst, concat_ws(' ', coalesce(a.name, e.src), coalesce(m.verb, e.metaedge), coalesce(b.name, e.dst)) AS sentence, coalesce(a.kind, 'Unknown') AS src_kind, coalesce(b.kind, 'Unknown') AS dst_kind FROM E e LEFT JOIN N a ON a.id = e.src LEFT JOIN N b ON b.id = e.dst LEFT JOIN metaedges m ON m.metaedge = e.metaedge")
def enrich_left(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return X.enrich(g.edges, g.nodes, g.schema)


@R.add("referential_filter", f"WITH {GRAPH_SQL} SELECT src, metaedge, dst, seq FROM E")
def referential_filter(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d).edges.select("src", "metaedge", "dst", "seq")


CHAIN_SQL = """
c1 AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY seq) AS rn FROM E WHERE metaedge = 'DlA'),
c2 AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY seq) AS rn FROM E WHERE metaedge = 'AeG'),
c3 AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY seq) AS rn FROM E WHERE metaedge = 'GpBP'),
c4 AS (SELECT dst AS src, src AS dst, row_number() OVER (PARTITION BY dst ORDER BY seq) AS rn FROM E WHERE metaedge = 'CtD'),
c5 AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY seq) AS rn FROM E WHERE metaedge = 'CuG')"""


@R.add("chain_anatomy", f"WITH {GRAPH_SQL}, {CHAIN_SQL} SELECT d.id AS n0, c1.dst AS n1, c2.dst AS n2, c3.dst AS n3 FROM N d JOIN c1 ON c1.src = d.id JOIN c2 ON c2.src = c1.dst AND c2.rn <= 3 JOIN c3 ON c3.src = c2.dst AND c3.rn <= 2 WHERE d.kind = 'Disease'")
def chain_anatomy(spark: SparkSession, d: str) -> DataFrame:
    return X.chain(load(spark, d), "Disease", [("DlA", "out", None), ("AeG", "out", 3), ("GpBP", "out", 2)])


@R.add("chain_compound", f"WITH {GRAPH_SQL}, {CHAIN_SQL} SELECT d.id AS n0, c4.dst AS n1, c5.dst AS n2, c3.dst AS n3 FROM N d JOIN c4 ON c4.src = d.id JOIN c5 ON c5.src = c4.dst AND c5.rn <= 3 JOIN c3 ON c3.src = c5.dst AND c3.rn <= 2 WHERE d.kind = 'Disease'")
def chain_compound(spark: SparkSession, d: str) -> DataFrame:
    return X.chain(load(spark, d), "Disease", [("CtD", "in", None), ("CuG", "out", 3), ("GpBP", "out", 2)])


@R.add("gene_lists", f"WITH {GRAPH_SQL} SELECT e.src AS id, e.metaedge, e.dst, CAST(row_number() OVER (PARTITION BY e.src, e.metaedge ORDER BY e.dst) AS INTEGER) AS place, CAST(count(*) OVER (PARTITION BY e.src, e.metaedge) AS BIGINT) AS n FROM E e JOIN N g ON g.id = e.src WHERE g.kind = 'Gene'")
def gene_lists(spark: SparkSession, d: str) -> DataFrame:
    """What each gene is joined with, by metaedge, as numbered rows: no list of a hot gene is held in one row."""
    g = load(spark, d)
    e = T.cut(g.edges.join(g.nodes.where("kind = 'Gene'").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), "metaedge", "dst"))
    n = e.groupBy("id", "metaedge").agg(F.count(F.lit(1)).alias("n"))
    return X.numbered(e, ["id", "metaedge"], ["dst"]).join(n, ["id", "metaedge"]).select("id", "metaedge", "dst", "place", "n")


def _bfs_sql(seed: str, depth: int, step: str) -> str:
    return f"B AS (SELECT id, 0 AS depth FROM {seed} UNION SELECT s.dst, b.depth + 1 FROM B b JOIN {step} s ON s.src = b.id WHERE b.depth < {depth})"


def walk_sql(seed: str, step: str) -> str:
    """M(seed, id, depth): distances from each seed, until nothing new is reached."""
    return f"M(seed, id, depth) USING KEY (seed, id) AS (SELECT id, id, 0 FROM {seed} UNION SELECT m.seed, s.dst, m.depth + 1 FROM M m JOIN {step} s ON s.src = m.id LEFT JOIN recurring.M r ON r.seed = m.seed AND r.id = s.dst WHERE r.id IS NULL)"


STEP_SQL = "STEP AS (SELECT DISTINCT src, dst FROM E WHERE src <> dst), UND AS (SELECT src, dst FROM STEP UNION SELECT dst, src FROM STEP)"


@R.add("bfs_depth2", f"WITH RECURSIVE {GRAPH_SQL}, {HUB_SQL}, {STEP_SQL}, {_bfs_sql('HUB', 2, 'STEP')} SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM B GROUP BY id")
def bfs_depth2(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return T.bfs(g.edges, hub(g), 2)


@R.add("bfs_multi_both", f"WITH RECURSIVE {GRAPH_SQL}, {SEEDS_SQL}, {STEP_SQL}, {_bfs_sql('SEEDS', 2, 'UND')} SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM B GROUP BY id")
def bfs_multi_both(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return T.bfs(g.edges, seeds(g), 2, "both")


@R.add("exact_depth", f"WITH RECURSIVE {GRAPH_SQL}, {GENES_SQL}, {STEP_SQL}, {_bfs_sql('SEEDS', 2, 'STEP')} SELECT id FROM B GROUP BY id HAVING min(depth) = 2")
def exact_depth(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return T.bfs(g.edges, seeds(g, "Gene", 5), 2).where("depth = 2").select("id")


@R.add("seeded_depths", f"WITH RECURSIVE {GRAPH_SQL}, {SEEDS_SQL}, {STEP_SQL}, S AS (SELECT id AS seed, id, 0 AS depth FROM SEEDS UNION SELECT s.seed, e.dst, s.depth + 1 FROM S s JOIN STEP e ON e.src = s.id WHERE s.depth < 2) SELECT seed, id, CAST(min(depth) AS INTEGER) AS depth FROM S GROUP BY seed, id")
def seeded_depths(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return T.seeded_bfs(g.edges, seeds(g), 2)


@R.add("ego_subgraph", f"WITH {GRAPH_SQL}, {SEEDS_SQL}, {STEP_SQL}, I AS (SELECT id FROM SEEDS UNION SELECT dst FROM UND WHERE src IN (SELECT id FROM SEEDS)) SELECT src, dst, metaedge, seq FROM E WHERE src IN (SELECT id FROM I) AND dst IN (SELECT id FROM I)")
def ego_subgraph(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return T.ego(g.edges, seeds(g), 1).select("src", "dst", "metaedge", "seq")


@R.add("ego_capped", f"WITH {GRAPH_SQL}, {SEEDS_SQL}, C AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY seq, dst) AS rn FROM E WHERE src <> dst) WHERE rn <= 4), L1 AS (SELECT dst AS id FROM C WHERE src IN (SELECT id FROM SEEDS)), I AS (SELECT id FROM SEEDS UNION SELECT id FROM L1 UNION SELECT dst FROM C WHERE src IN (SELECT id FROM L1)) SELECT src, dst, metaedge, seq FROM E WHERE src IN (SELECT id FROM I) AND dst IN (SELECT id FROM I)")
def ego_capped(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return T.ego(g.edges, seeds(g), 2, "out", 4).select("src", "dst", "metaedge", "seq")


PAIRS_SQL = "PAIRS AS (SELECT a.id AS s, b.id AS t FROM (SELECT id FROM N WHERE kind = 'Compound' ORDER BY id LIMIT 3) a CROSS JOIN (SELECT id FROM N WHERE kind = 'Gene' ORDER BY id LIMIT 5) b)"


def pairs(g: PropertyGraph) -> DataFrame:
    """The seed pairs of path questions: each of 3 compounds with each of 5 genes."""
    a = seeds(g, "Compound", 3).select(F.col("id").alias("s"), F.lit(1).alias("one"))
    return a.join(F.broadcast(seeds(g, "Gene", 5).select(F.col("id").alias("t"), F.lit(1).alias("one"))), "one").select("s", "t")


@R.add(
    "all_shortest_paths",
    f"""WITH RECURSIVE {GRAPH_SQL}, {PAIRS_SQL}, {STEP_SQL},
    P AS (SELECT s AS s, s AS nd, [s] AS path FROM (SELECT DISTINCT s FROM PAIRS) UNION ALL SELECT p.s, e.dst, list_append(p.path, e.dst) FROM P p JOIN STEP e ON e.src = p.nd WHERE len(p.path) <= 3 AND NOT list_contains(p.path, e.dst)),
    F AS (SELECT p.s, q.t, p.path, len(p.path) - 1 AS hops, min(len(p.path) - 1) OVER (PARTITION BY p.s, q.t) AS best FROM P p JOIN PAIRS q ON q.s = p.s AND q.t = p.nd)
    SELECT s, t, array_to_string(path, ' > ') AS path, CAST(hops AS INTEGER) AS hops FROM F WHERE hops = best""",
)
def all_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return T.shortest_paths(g.edges, pairs(g), 3).select("s", "t", F.array_join("path", " > ").alias("path"), "hops")


@R.add(
    "k_simple_paths",
    f"""WITH RECURSIVE {GRAPH_SQL}, {PAIRS_SQL}, {STEP_SQL},
    P AS (SELECT s AS s, s AS nd, [s] AS path FROM (SELECT DISTINCT s FROM PAIRS) UNION ALL SELECT p.s, e.dst, list_append(p.path, e.dst) FROM P p JOIN STEP e ON e.src = p.nd WHERE len(p.path) <= 3 AND NOT list_contains(p.path, e.dst)),
    F AS (SELECT p.s, q.t, p.path, len(p.path) - 1 AS hops, row_number() OVER (PARTITION BY p.s, q.t ORDER BY len(p.path), p.path) AS rank FROM P p JOIN PAIRS q ON q.s = p.s AND q.t = p.nd)
    SELECT s, t, array_to_string(path, ' > ') AS path, CAST(hops AS INTEGER) AS hops, CAST(rank AS INTEGER) AS rank FROM F WHERE rank <= 5""",
)
def k_simple_paths(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return T.k_simple_paths(g.edges, pairs(g), 5, 3).select("s", "t", F.array_join("path", " > ").alias("path"), "hops", "rank")


@R.add(
    "n_hop_paths",
    f"""WITH RECURSIVE {GRAPH_SQL}, {SEEDS_SQL},
    P AS (SELECT id AS start, id AS nd, [id] AS path, CAST([] AS VARCHAR[]) AS metas FROM SEEDS UNION ALL SELECT p.start, e.dst, list_append(p.path, e.dst), list_append(p.metas, e.metaedge) FROM P p JOIN E e ON e.src = p.nd WHERE len(p.metas) < 2 AND NOT list_contains(p.path, e.dst) AND e.metaedge NOT IN ('DrD', 'CrC'))
    SELECT start, array_to_string(path, ' > ') AS path, array_to_string(metas, ' ') AS metas, CAST(len(metas) AS INTEGER) AS hops FROM P WHERE len(metas) > 0""",
)
def n_hop_paths(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return T.simple_paths(g.edges, seeds(g), 2, deny=["DrD", "CrC"]).select("start", F.array_join("path", " > ").alias("path"), F.array_join("metas", " ").alias("metas"), "hops")


@R.add(
    "allowlist_paths",
    f"""WITH {GRAPH_SQL}, {SEEDS_SQL}, A AS (SELECT src, dst, metaedge, seq FROM E WHERE metaedge IN ('CbG', 'GiG', 'Gr>G', 'GpPW', 'GpBP')),
    H1 AS (SELECT * FROM (SELECT s.id AS start, a.dst AS nd, [s.id, a.dst] AS path, [a.metaedge] AS metas, [a.seq] AS seqs, row_number() OVER (PARTITION BY s.id ORDER BY [a.seq], [s.id, a.dst]) AS rn FROM SEEDS s JOIN A a ON a.src = s.id WHERE a.dst <> s.id) WHERE rn <= 100),
    H2 AS (SELECT * FROM (SELECT h.start, a.dst AS nd, list_append(h.path, a.dst) AS path, list_append(h.metas, a.metaedge) AS metas, row_number() OVER (PARTITION BY h.start ORDER BY list_append(h.seqs, a.seq), list_append(h.path, a.dst)) AS rn FROM H1 h JOIN A a ON a.src = h.nd WHERE NOT list_contains(h.path, a.dst)) WHERE rn <= 100),
    P AS (SELECT start, nd, path, metas, 1 AS hops FROM H1 UNION ALL SELECT start, nd, path, metas, 2 FROM H2)
    SELECT p.start, array_to_string(path, ' > ') AS path, array_to_string(metas, ' ') AS metas, CAST(hops AS INTEGER) AS hops, n.kind AS end_kind FROM P p JOIN N n ON n.id = p.nd WHERE n.kind IN ('Pathway', 'Biological Process')""",
)
def allowlist_paths(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    paths = T.simple_paths(g.edges, seeds(g), 2, allow=["CbG", "GiG", "Gr>G", "GpPW", "GpBP"], cap=100)
    ends = g.nodes.where(F.col("kind").isin("Pathway", "Biological Process")).select(F.col("id").alias("end"), F.col("kind").alias("end_kind"))
    return paths.join(ends, "end").select("start", F.array_join("path", " > ").alias("path"), F.array_join("metas", " ").alias("metas"), "hops", "end_kind")


@R.add(
    "pattern_paths",
    f"""WITH {GRAPH_SQL}, {SEEDS_SQL}, B AS (SELECT src, dst, metaedge FROM E UNION SELECT dst, src, metaedge FROM E)
    SELECT DISTINCT s.id AS start, concat_ws(' > ', s.id, a.dst, b.dst) AS path FROM SEEDS s JOIN B a ON a.src = s.id AND a.metaedge = 'CtD' JOIN B b ON b.src = a.dst AND b.metaedge = 'DaG' WHERE a.dst <> s.id AND b.dst <> s.id AND b.dst <> a.dst""",
)
def pattern_paths(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return T.pattern_paths(g.edges, seeds(g), ["CtD", "DaG"]).select("start", F.array_join("path", " > ").alias("path"))


@R.add(
    "components",
    f"""WITH RECURSIVE {GRAPH_SQL}, KN AS (SELECT id FROM N WHERE kind IN ('Disease', 'Compound')), D AS (SELECT src, dst FROM E WHERE metaedge IN ('DrD', 'CrC') AND src <> dst AND src IN (SELECT id FROM KN) AND dst IN (SELECT id FROM KN)), U AS (SELECT src, dst FROM D UNION SELECT dst, src FROM D),
    Q AS (SELECT id, id AS c FROM N WHERE kind IN ('Disease', 'Compound') UNION SELECT u.dst, q.c FROM Q q JOIN U u ON u.src = q.id)
    SELECT id, min(c) AS component FROM Q GROUP BY id""",
)
def components(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    nodes = g.nodes.where(F.col("kind").isin("Disease", "Compound"))
    return T.components(X.induced(g.edges.where(F.col("metaedge").isin("DrD", "CrC")), nodes), nodes)


@R.add("components_whole", f"WITH RECURSIVE {GRAPH_SQL}, {STEP_SQL}, Q(id, c) USING KEY (id) AS (SELECT id, id FROM N UNION SELECT u.dst, min(q.c) FROM Q q JOIN UND u ON u.src = q.id JOIN recurring.Q r ON r.id = u.dst WHERE q.c < r.c GROUP BY u.dst) SELECT c AS component, CAST(count(*) AS BIGINT) AS n_nodes FROM Q GROUP BY c")
def components_whole(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return T.components(g.edges, g.nodes).groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


@R.add("dfs_preorder")
def dfs_preorder(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    return T.dfs(g.edges, seeds(g), 2)
