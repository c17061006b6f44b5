"""Queries of question analysis, retrieval methods, context, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.model import GRAPH_SQL, SCORE_SQL
from graphloom.operators.expand import enrich
from graphloom.plans import intent as I, match as Q, retrieve as V
from graphloom.plans.context import render
from graphloom.queries.base import Registry
from graphloom.queries.analysis import ADAPTIVE_SQL, DEGREE_SQL, ENSEMBLE_SQL, GENE_SUB, METHOD_SQL, MULTI_SQL, UND_SQL, _lpa_sql, _pagerank_sql
from graphloom.queries.graph import SEEDS_SQL, _bfs_sql, load, seeds
from graphloom.queries.texts import WORDS
from graphloom.session import table
from graphloom.sources import graph_files as G
from graphloom.streaming import incremental as W

R = Registry()

_TYPE_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(q, '{p}')" for p in ps) + f" THEN '{n}'" for n, ps, _ in I.RULES) + " ELSE 'general' END"


def _any_sql(ps) -> str:
    return "(" + " OR ".join(f"contains(q, '{p}')" for p in ps) + ")"


_SCHEMA_SQL = "'general'"
for _group in I.SCHEMA_GROUPS:
    _SCHEMA_SQL = "CASE " + " ".join(f"WHEN {_any_sql(r[0])} THEN '{r[1]}'" for r in _group) + f" ELSE {_SCHEMA_SQL} END"
_LISTED = lambda rules: "list_filter([" + ", ".join(f"CASE WHEN {_any_sql(ws)} THEN '{n}' END" for n, ws in rules) + "], lambda x: x IS NOT NULL)"
_COMPLEX_SQL = (
    "CASE "
    + " ".join(f"WHEN {_any_sql(a)} AND {_any_sql(b)} THEN '{n}'" for n, a, b in I.COMPLEX)
    + " "
    + " ".join(f"WHEN list_has_any(me, {list(a)}) AND list_has_any(me, {list(b)}) THEN '{n}'" for n, a, b in I.COMPLEX_EDGES)
    + f" WHEN qt IN {I.SIMPLE_TYPES} THEN qt ELSE 'general' END"
)
_EDGES_SQL = "CASE qt " + " ".join(f"WHEN '{n}' THEN {list(ms)}" for n, _, ms in I.RULES) + " ELSE CAST([] AS VARCHAR[]) END"


@R.add(
    "question_analysis",
    f"""WITH Q AS (SELECT doc_id, lower(translate(text, 'İΣ', 'iσ')) AS q FROM documents WHERE text IS NOT NULL), T AS (SELECT *, {_TYPE_SQL} AS qt FROM Q), M AS (SELECT *, {_EDGES_SQL} AS me FROM T)
    SELECT doc_id, {_COMPLEX_SQL} AS complex_type, array_to_string({_LISTED(I.ANSWER_TYPES)}, '+') AS answer_types, array_to_string({_LISTED(I.KIND_WORDS.items())}, '+') AS kinds,
      CASE WHEN {_any_sql(I.BACKWARD_WORDS)} THEN 'reverse' ELSE 'forward' END AS direction, {_any_sql(I.CANCER_WORDS)} AS about_cancer FROM M""",
)
def question_analysis(spark: SparkSession, d: str) -> DataFrame:
    """What every text would ask for as a question: steps, kinds of answers and of nodes, direction, cancers."""
    q = F.translate("text", "İΣ", "iσ")
    return table(spark, d, "documents").where("text is not null").select("doc_id", I.complex_type(q).alias("complex_type"), F.array_join(I.answer_types(q), "+").alias("answer_types"), F.array_join(I.question_kinds(q), "+").alias("kinds"), I.direction(q).alias("direction"), I.about_cancer(q).alias("about_cancer"))


@R.add("intent_rules", f"SELECT doc_id, {_TYPE_SQL} AS question_type, {_SCHEMA_SQL} AS intent FROM (SELECT doc_id, lower(text) AS q FROM documents WHERE source = 'qa_pairs' AND text IS NOT NULL)")
def intent_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source = 'qa_pairs' and text is not null").select("doc_id", I.question_type(F.col("text")).alias("question_type"), I.schema_intent(F.col("text")).alias("intent"))


@R.add(
    "token_match",
    f"""WITH {GRAPH_SQL}, T AS (SELECT DISTINCT title AS token FROM documents WHERE title IS NOT NULL UNION SELECT DISTINCT name FROM N WHERE name IS NOT NULL),
    NN AS (SELECT id, name, seq FROM N WHERE name IS NOT NULL),
    A AS (SELECT token, {WORDS.format(c='token')} AS ws FROM T), AW AS (SELECT token, len(list_distinct(ws)) AS want, unnest(list_distinct(ws)) AS w FROM A),
    IW AS (SELECT id, seq, unnest(list_distinct({WORDS.format(c='name')})) AS w FROM NN),
    M AS (SELECT token, id, 1 AS stage, seq FROM T JOIN NN ON token = name UNION ALL SELECT token, id, 2, seq FROM T JOIN NN ON lower(token) = lower(name)
      UNION ALL SELECT token, id, 3, seq FROM AW JOIN IW USING (w) GROUP BY token, want, id, seq HAVING count(*) = want)
    SELECT token, id, CAST(stage AS INTEGER) AS stage FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY stage, seq, id) AS rn FROM M) WHERE rn = 1""",
)
def token_match(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    tokens = table(spark, d, "documents").select(F.col("title").alias("token")).unionByName(g.nodes.select(F.col("name").alias("token")))
    return Q.match(tokens, g.nodes).select("token", "id", "stage")


_KIND_SQL = "[" + ", ".join(f"{{'w': '{w}', 'k': '{k}'}}" for w, k in {w: k for k, ws in Q.KIND_TOKENS.items() for w in ws}.items()) + "]"
_FA_SQL = "[" + ", ".join(f"{{'w': '{a}', 'e': '{b}'}}" for a, b in Q.PERSIAN_TOKENS.items()) + "]"
_EXTRA = [*{w: 0 for ws in Q.KIND_TOKENS.values() for w in ws}, *Q.PERSIAN_TOKENS, "XZELQ9", "the kinase", "Zel loss of pain", "QQQ"]
_ALIASES = (("p1", "PAMA"), ("qqq", "TUK"))


@R.add(
    "token_cascade",
    f"""WITH {GRAPH_SQL}, T AS (SELECT DISTINCT token, lower(token) AS lt, regexp_full_match(token, '[A-Za-z0-9-]{{2,10}}') AND length(regexp_replace(token, '[^A-Z]', '', 'g')) >= 2 AS sym
      FROM (SELECT unnest(string_split(title, ' ')) AS token FROM documents UNION ALL SELECT unnest({_EXTRA})) WHERE token IS NOT NULL AND token <> ''),
    NN AS (SELECT id, seq, kind, name, lower(name) AS ln FROM N WHERE name IS NOT NULL AND name <> ''), AL AS (SELECT unnest([{', '.join(f"'{a}'" for a, _ in _ALIASES)}]) AS a, lower(unnest([{', '.join(f"'{b}'" for _, b in _ALIASES)}])) AS alias),
    KW AS (SELECT x.w, x.k FROM (SELECT unnest({_KIND_SQL}) AS x)), FA AS (SELECT x.w, x.e FROM (SELECT unnest({_FA_SQL}) AS x)),
    H AS (SELECT token, id, seq, kind, sym FROM T JOIN NN ON contains(ln, lt)),
    M AS (SELECT token, 0 AS st, id, seq FROM T JOIN AL ON lt = a JOIN NN ON kind = 'Gene' AND ln = alias
      UNION ALL SELECT token, 1, id, seq FROM T JOIN AL ON lt = a JOIN NN ON kind = 'Gene' AND contains(ln, alias)
      UNION ALL SELECT token, 2, id, seq FROM H WHERE NOT sym OR kind <> 'Gene' UNION ALL SELECT token, 2, id, seq FROM T JOIN NN ON sym AND kind = 'Gene' AND upper(name) = upper(token)
      UNION ALL SELECT token, 3, id, seq FROM T JOIN NN ON ln = lt WHERE length(token) >= 3
      UNION ALL SELECT token, 4, id, seq FROM H WHERE length(token) >= 3
      UNION ALL SELECT token, 5, id, seq FROM (SELECT token, id, seq, row_number() OVER (PARTITION BY token ORDER BY round(CASE WHEN contains(ln, lt) THEN length(lt) * 1.0 / length(ln) WHEN len(list_filter(string_split(lt, ' '), lambda w: contains(ln, w))) > 0 THEN 0.5 ELSE 0.1 END, 12) DESC, seq) AS rn FROM T JOIN KW ON KW.w = lt JOIN NN ON NN.kind = KW.k) WHERE rn = 1
      UNION ALL SELECT token, 6, id, seq FROM T JOIN NN ON contains(lt, ' ') AND len(list_filter(string_split(lt, ' '), lambda w: NOT contains(ln, w))) = 0
      UNION ALL SELECT token, 7, id, seq FROM T JOIN FA ON FA.w = token JOIN NN ON contains(ln, e)
      UNION ALL SELECT token, 8, id, seq FROM T JOIN NN ON length(token) >= 3 AND kind = 'Gene' AND (contains(ln, lt) OR contains(lt, ln) OR len(list_filter(string_split_regex(lt, '[ \t\n\r]+'), lambda w: w <> '' AND contains(ln, w))) > 0))
    SELECT token, id, CAST(greatest(st, 1) AS INTEGER) AS stage FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY st, CASE WHEN st = 5 THEN 0 ELSE seq END) AS rn FROM M) WHERE rn = 1""",
)
def token_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Words of titles, kind words, Persian words and a few made-up ones, bound to nodes by eight stages."""
    titles = table(spark, d, "documents").select(F.explode(F.split("title", " ")).alias("token"))
    extra, aliases = spark.createDataFrame([(w,) for w in _EXTRA], "token string"), spark.createDataFrame(list(_ALIASES), "token string, alias string")
    return Q.cascade(titles.unionByName(extra), load(spark, d).nodes, aliases).select("token", "id", "stage")


ANSWER_SQL = f"""D AS (SELECT id, name FROM N WHERE kind = 'Disease' AND name IS NOT NULL),
QS AS (SELECT id AS qid, name AS token, 'What compounds treat ' || name || '?' AS question FROM D),
TY AS (SELECT qid, token, {_TYPE_SQL} AS t FROM (SELECT qid, token, lower(question) AS q FROM QS)),
RM AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{m}')" for n, _, ms in I.RULES for m in ms)}) v(t, metaedge)),
FN AS (SELECT name, arg_min(id, seq) AS id FROM N WHERE name IS NOT NULL GROUP BY name),
H AS (SELECT TY.qid, e.metaedge, e.dst AS hit, 1.0 AS f FROM TY JOIN FN ON FN.name = TY.token JOIN RM ON RM.t = TY.t JOIN E e ON e.src = FN.id AND e.metaedge = RM.metaedge
  UNION ALL SELECT TY.qid, e.metaedge, e.src, 0.8 FROM TY JOIN FN ON FN.name = TY.token JOIN RM ON RM.t = TY.t JOIN E e ON e.dst = FN.id AND e.metaedge = RM.metaedge)"""


@R.add("answer_questions", f"WITH {GRAPH_SQL}, {ANSWER_SQL} SELECT h.qid, h.hit, round(max(h.f * {SCORE_SQL.format(e='h', d='1')}), 6) AS score FROM H h LEFT JOIN metaedges m ON m.metaedge = h.metaedge GROUP BY h.qid, h.hit")
def answer_questions(spark: SparkSession, d: str) -> DataFrame:
    """One treatment question for every named disease: type, metaedges, seed and scored hits, all as one batch."""
    from graphloom.model import BACKWARD_FACTOR, metaedge_score, oriented

    g = load(spark, d).kept
    qs = g.nodes.where("kind = 'Disease' and name is not null").select(F.col("id").alias("qid"), F.col("name").alias("token"), F.concat(F.lit("What compounds treat "), "name", F.lit("?")).alias("question"))
    typed = qs.select("qid", "token", I.question_type(F.col("question")).alias("question_type")).join(F.broadcast(I.rule_metaedges(spark)), "question_type")
    first = g.nodes.where("name is not null").groupBy(F.col("name").alias("token")).agg(F.min_by("id", "seq").alias("src"))
    hits = typed.join(first, "token").join(oriented(g.edges, "both"), ["src", "metaedge"]).join(F.broadcast(g.schema.select("metaedge", "base_score")), "metaedge", "left")
    score = metaedge_score(F.col("metaedge"), F.col("base_score"), F.lit(1)) * F.when(F.col("backward"), BACKWARD_FACTOR).otherwise(1.0)
    return hits.groupBy("qid", F.col("dst").alias("hit")).agg(F.round(F.max(score), 6).alias("score"))


QUESTION = "Which compound treats the pain syndrome?"
_NEAR = f"{_bfs_sql('SEEDS', 1, 'UND').replace('B AS', 'B1 AS', 1).replace('FROM B b', 'FROM B1 b')}, G1 AS (SELECT id FROM N WHERE kind = 'Gene' AND id IN (SELECT id FROM B1))"
_EXP = f"""EX AS (SELECT e.dst AS id, {SCORE_SQL.format(e='e', d='1')} AS s FROM E e LEFT JOIN metaedges m ON e.metaedge = m.metaedge WHERE e.src IN (SELECT id FROM SEEDS)
  UNION ALL SELECT e.src, 0.8 * {SCORE_SQL.format(e='e', d='1')} FROM E e LEFT JOIN metaedges m ON e.metaedge = m.metaedge WHERE e.dst IN (SELECT id FROM SEEDS)), IT AS (SELECT id, 1 AS depth, round(max(s), 6) AS score FROM EX GROUP BY id)"""
_HOPS = "PH AS (SELECT s.id AS seed, e.dst AS id, 1 AS hops FROM SEEDS s JOIN E e ON e.src = s.id WHERE e.dst <> s.id AND e.metaedge NOT IN ('DrD', 'CrC') UNION ALL SELECT p.seed, e.dst, 2 FROM PH p JOIN E e ON e.src = p.id WHERE p.hops = 1 AND e.dst NOT IN (p.seed, p.id) AND e.metaedge NOT IN ('DrD', 'CrC')), NH AS (SELECT id, min(hops) AS depth FROM PH GROUP BY id)"
_BOTH = "BE AS (SELECT src, dst, metaedge, seq FROM E UNION ALL SELECT dst, src, metaedge, seq FROM E)"
_PATHS = f"""{_BOTH}, DIS AS (SELECT list(id) AS ids FROM N WHERE kind = 'Disease'), BA AS (SELECT * FROM BE WHERE metaedge IN ('CtD', 'CpD', 'PCiC', 'CbG')),
P AS (SELECT id AS start, id AS nd, [id] AS path, CAST([] AS VARCHAR[]) AS metas, CAST([] AS BIGINT[]) AS seqs FROM SEEDS
  UNION ALL SELECT p.start, b.dst, list_append(p.path, b.dst), list_append(p.metas, b.metaedge), list_append(p.seqs, b.seq) FROM P p JOIN BA b ON b.src = p.nd WHERE len(p.metas) < 3 AND NOT list_contains(p.path, b.dst)),
KP AS (SELECT p.*, len(metas) AS hops FROM P p JOIN N n ON n.id = p.nd, DIS WHERE len(metas) > 0 AND n.kind IN ('Compound', 'Pharmacologic Class') AND len(list_filter(range(1, len(metas) + 1), lambda i: metas[i] IN ('CtD', 'CpD') AND (list_contains(ids, path[i]) OR list_contains(ids, path[i + 1])))) > 0),
ST AS (SELECT seq, CASE metaedge WHEN 'CtD' THEN 1.2 WHEN 'GcG' THEN 1.0 + 0.5 * least(1.0, greatest(0.0, weight)) ELSE 1.0 END + 0.05 * coalesce(evidence, 0) AS s FROM E),
GH AS (SELECT n.id, 1.0 / (1.0 + ln(1.0 + d.degree)) AS h FROM N n JOIN DEG d ON d.id = n.id WHERE n.kind = 'Gene'),
PS AS (SELECT start, seqs, avg(s) AS strength FROM (SELECT start, seqs, unnest(seqs) AS sq FROM KP) JOIN ST ON seq = sq GROUP BY start, seqs),
HB AS (SELECT start, seqs, avg(h) AS hub FROM (SELECT start, seqs, unnest(path) AS x FROM KP) JOIN GH ON id = x GROUP BY start, seqs),
V AS (SELECT k.*, round(0.35 * CASE WHEN list_contains(metas, 'CtD') THEN 1.0 ELSE 0.0 END + 0.25 * strength + 0.20 + 0.10 * CASE hops WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE 0.6 END + 0.05 * coalesce(hub, 1.0), 9) AS v FROM KP k JOIN PS ON PS.start = k.start AND PS.seqs = k.seqs LEFT JOIN HB ON HB.start = k.start AND HB.seqs = k.seqs),
RK AS (SELECT *, v + CASE WHEN row_number() OVER (PARTITION BY start, nd ORDER BY v DESC, array_to_string(path, '>'), array_to_string(metas, '>')) = 1 THEN 0.05 ELSE 0 END AS score FROM V)"""


def _between(seed: str) -> str:
    """SP(s, t, id, depth): nodes on shortest paths of at most three edges between two seeds, with their place."""
    return f"""DD AS (SELECT id AS seed, id, 0 AS depth FROM {seed} UNION SELECT x.seed, u.dst, x.depth + 1 FROM DD x JOIN UND u ON u.src = x.id WHERE x.depth < 3), DM AS (SELECT seed, id, min(depth) AS depth FROM DD GROUP BY seed, id),
    SP AS (SELECT a.seed AS s, b.seed AS t, a.id, a.depth FROM DM a JOIN DM b ON b.id = a.id AND a.seed < b.seed JOIN DM c ON c.seed = a.seed AND c.id = b.seed WHERE a.depth + b.depth = c.depth)"""


def _linked_sql(codes: str, kind: str) -> str:
    return f"LK AS (SELECT DISTINCT g.id AS gene, x.id FROM G1 g JOIN (SELECT src AS gene, dst AS id FROM E WHERE metaedge IN {codes} AND src <> dst UNION SELECT dst, src FROM E WHERE metaedge IN {codes} AND src <> dst) x ON x.gene = g.id JOIN N n ON n.id = x.id AND n.kind = '{kind}')"


_COUNTED = "SELECT id, 2 AS depth, CAST(count(*) AS DOUBLE) AS score FROM LK GROUP BY id"
_NO_DEPTH = "CAST(NULL AS INTEGER) AS depth"
_NAME_WORDS = WORDS.format(c="name")
_ASKED = "['compound', 'pain', 'syndrome', 'the', 'treats', 'which']"
_WORD_SIM = f"WS AS (SELECT id, len(list_intersect(list_distinct({_NAME_WORDS}), {_ASKED})) * 1.0 / len(list_distinct(list_concat({_NAME_WORDS}, {_ASKED}))) AS score FROM N WHERE name IS NOT NULL)"
_CTD = SCORE_SQL.format(e="e", d="1")


def _expand_sql(name: str, seeds_: str) -> str:
    return f"{name} AS (SELECT id, round(max(s), 6) AS score FROM (SELECT e.dst AS id, {_CTD} AS s FROM E e LEFT JOIN metaedges m ON e.metaedge = m.metaedge WHERE e.metaedge = 'CtD' AND e.src IN (SELECT id FROM {seeds_}) UNION ALL SELECT e.src, 0.8 * {_CTD} FROM E e LEFT JOIN metaedges m ON e.metaedge = m.metaedge WHERE e.metaedge = 'CtD' AND e.dst IN (SELECT id FROM {seeds_})) GROUP BY id)"


_COST = "CO AS (SELECT src, dst, 2.0 - weight AS cost FROM E), W0 AS (SELECT id, 0.0::DOUBLE AS c FROM SEEDS), " + ", ".join(f"W{h} AS (SELECT dst AS id, min(round(c + cost, 9)) AS c FROM CO JOIN W{h - 1} w ON w.id = CO.src GROUP BY dst)" for h in (1, 2, 3))
#: Hits (id, depth, score) of each method as SQL, from the first three compounds.
HITS = {
    "bfs": ("", "SELECT id, depth, 1.0 / (depth + 1) AS score FROM M1"),
    "dfs": ("", "SELECT id, depth, 1.0 / (depth + 1) AS score FROM M2"),
    "neighbors": ("", "SELECT id, depth, 1.0 / (depth + 1) AS score FROM M3"),
    "hybrid": ("", "SELECT id, depth, 1.0 / (depth + 1) AS score FROM M1"),
    "multi_method": (MULTI_SQL, "SELECT id, min(depth) AS depth, 1 + 0.5 * (count(*) - 1) AS score FROM H GROUP BY id"),
    "ensemble": (ENSEMBLE_SQL, f"SELECT id, {_NO_DEPTH}, sum(w / (depth + 1)) * (1 + 0.1 * count(*)) AS score FROM H GROUP BY id"),
    "intelligent": (_EXP, "SELECT * FROM IT"),
    "semantic_similarity": (_EXP, "SELECT * FROM IT"),
    "n_hop": (_HOPS, "SELECT id, depth, 1.0 / (depth + 1) AS score FROM NH"),
    "pagerank": (f"{_pagerank_sql(5)}, {_bfs_sql('SEEDS', 2, 'UND').replace('B AS', 'B2 AS', 1).replace('FROM B b', 'FROM B2 b')}", "SELECT b.id, min(b.depth) AS depth, max(r.r) AS score FROM B2 b JOIN R5 r ON r.id = b.id GROUP BY b.id"),
    "community_detection": (f"{UND_SQL}, {_lpa_sql(5)}, {DEGREE_SQL}", f"SELECT l.id, {_NO_DEPTH}, CAST(coalesce(d.degree, 0) AS DOUBLE) AS score FROM L5 l LEFT JOIN DEG d ON d.id = l.id WHERE l.label IN (SELECT label FROM L5 WHERE id IN (SELECT id FROM SEEDS))"),
    "no_retrieval": ("", "SELECT id, 0 AS depth, 0.0 AS score FROM SEEDS WHERE false"),
    "shortest_path": (_between("SEEDS"), "SELECT id, min(depth) AS depth, 1.0 / (min(depth) + 1) AS score FROM SP GROUP BY id"),
    "kg_search": (f"{DEGREE_SQL}, {_PATHS}", "SELECT nd AS id, min(hops) AS depth, max(score) AS score FROM RK GROUP BY nd"),
    "hybrid_new": (f"{_EXP}, {_HOPS}, {_pagerank_sql(10)}, TR AS (SELECT id, 0 AS depth, r AS score FROM R10 ORDER BY round(r, 12) DESC, id LIMIT 6), U AS (SELECT id, 0 AS depth, 120.0 AS score FROM SEEDS UNION ALL SELECT * FROM IT UNION ALL SELECT id, depth, 1.0 / (depth + 1) FROM NH UNION ALL SELECT * FROM TR)", "SELECT id, arg_min(depth, (-score, depth)) AS depth, max(score) AS score FROM U GROUP BY id"),
    "dijkstra": (_COST, "SELECT id, arg_min(h, (c, h)) AS depth, 1.0 / (1.0 + min(c)) AS score FROM (SELECT id, c, 0 AS h FROM W0 UNION ALL SELECT id, c, 1 FROM W1 UNION ALL SELECT id, c, 2 FROM W2 UNION ALL SELECT id, c, 3 FROM W3) GROUP BY id"),
    "limited_bfs": (f"{_bfs_sql('SEEDS', 3, 'STEP').replace('B AS', 'B3 AS', 1).replace('FROM B b', 'FROM B3 b')}, LB AS (SELECT id, min(depth) AS depth FROM B3 GROUP BY id ORDER BY depth, id LIMIT 20)", "SELECT id, depth, 1.0 / (depth + 1) AS score FROM LB"),
    "word_similarity": (_WORD_SIM, f"SELECT id, {_NO_DEPTH}, score FROM WS WHERE score > 0"),
    "enhanced_n_hop": (
        f"{DEGREE_SQL}, PA AS (SELECT s.id AS seed, s.id, 0 AS hops FROM SEEDS s UNION ALL SELECT s.id, e.dst, 1 FROM SEEDS s JOIN E e ON e.src = s.id WHERE e.dst <> s.id UNION ALL SELECT s.id, f.dst, 2 FROM SEEDS s JOIN E e ON e.src = s.id JOIN E f ON f.src = e.dst WHERE e.dst <> s.id AND f.dst NOT IN (s.id, e.dst)), NB AS (SELECT src AS id, count(DISTINCT dst) AS nb FROM STEP GROUP BY src)",
        "SELECT p.id, min(p.hops) AS depth, max(CASE WHEN n.kind = 'Gene' THEN 2.0 ELSE 0.0 END + 0.1 * coalesce(nb, 0) + 5.0 * coalesce(d.degree, 0) / ((SELECT count(*) FROM N) - 1.0)) AS score FROM PA p JOIN N n ON n.id = p.id LEFT JOIN NB ON NB.id = p.id LEFT JOIN DEG d ON d.id = p.id GROUP BY p.id",
    ),
    "group_based": (f"{_NEAR}, {_linked_sql(chr(40) + repr('GpBP') + chr(41), 'Biological Process')}", "SELECT gene AS id, 2 AS depth, CAST(count(*) AS DOUBLE) AS score FROM LK WHERE id IN (SELECT id FROM LK GROUP BY id HAVING count(*) > 1) GROUP BY gene"),
    "biological_pathway": (f"{_NEAR}, {_linked_sql(chr(40) + repr('GpPW') + chr(41), 'Pathway')}", _COUNTED),
    "gene_cluster": (f"{_NEAR}, {_linked_sql(str(('GiG', 'GcG', 'Gr>G')), 'Gene')}", _COUNTED),
    "disease_gene_network": (f"{_NEAR}, {_linked_sql(str(('DaG', 'DuG', 'DdG')), 'Disease')}", _COUNTED),
    "neighbors_enhanced": ("", "SELECT dst AS id, 1 AS depth, sum(weight) AS score FROM E WHERE src IN (SELECT id FROM SEEDS) AND src <> dst GROUP BY dst"),
    "shortest_path_enhanced": (
        f"{_NEAR}, G5 AS (SELECT id FROM G1 ORDER BY id LIMIT 5), {_between('G5')}, U1 AS (SELECT a.s, a.t, [a.id] AS p, a.id AS x, a.depth AS i FROM SP a WHERE a.depth = 0), "
        "PP AS (SELECT s, t, p, x, i FROM U1 UNION ALL SELECT q.s, q.t, list_append(q.p, n.id), n.id, n.depth FROM PP q JOIN SP n ON n.s = q.s AND n.t = q.t AND n.depth = q.i + 1 JOIN UND u ON u.src = q.x AND u.dst = n.id)",
        f"SELECT y AS id, {_NO_DEPTH}, CAST(count(*) AS DOUBLE) AS score FROM (SELECT unnest(p) AS y FROM PP WHERE x = t) GROUP BY y",
    ),
    "targeted": (f"{_expand_sql('T1', 'SEEDS')}, {_expand_sql('T2', 'T1')}", "SELECT id, min(depth) AS depth, max(score) AS score FROM (SELECT id, 1 AS depth, score FROM T1 UNION ALL SELECT id, 2, score * 0.7 FROM T2) GROUP BY id"),
    "hybrid_enhanced": (f"{_pagerank_sql(5)}, {_WORD_SIM}, TR AS (SELECT id, r FROM R5 ORDER BY round(r, 12) DESC, id LIMIT 20), U AS (SELECT id, 2.0 AS score FROM M1 UNION ALL SELECT id, 1.5 + r FROM TR UNION ALL SELECT id, 1.0 + score FROM WS WHERE score > 0)", f"SELECT id, {_NO_DEPTH}, max(score) AS score FROM U GROUP BY id"),
}


def _hits_sql(ctes: str, hits: str, base: str = METHOD_SQL, graph: str = GRAPH_SQL) -> str:
    return f"WITH RECURSIVE {graph}, {base}{', ' if ctes else ''}{ctes}, HT AS ({hits}), TP AS (SELECT id, depth, round(score, 6) AS score FROM HT ORDER BY round(score, 6) DESC, id LIMIT 20) SELECT n.id, n.name, n.kind, CAST(t.depth AS INTEGER) AS depth, CAST(t.score AS DOUBLE) AS score FROM TP t JOIN N n ON n.id = t.id"


_RETRIEVE_SQL = {m: _hits_sql(*x) for m, x in HITS.items()}
_RETRIEVE_SQL["adaptive"] = _hits_sql("", "SELECT id, depth, score FROM AH", f"{SEEDS_SQL}, KS AS (SELECT id, kind FROM N WHERE id IN (SELECT id FROM SEEDS)), {ADAPTIVE_SQL}")
_RETRIEVE_SQL["targeted_pagerank"] = _hits_sql(f"N AS (SELECT * FROM N0 WHERE kind = 'Gene'), E AS (SELECT * FROM E0 WHERE src IN (SELECT id FROM N) AND dst IN (SELECT id FROM N)), {_pagerank_sql(10)}", f"SELECT id, {_NO_DEPTH}, r AS score FROM R10", "X AS (SELECT 1)", GENE_SUB)


def _method(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = load(spark, d).kept
        return V.retrieve(name, g, seeds(g), 20, QUESTION)

    run.__name__ = f"retrieve_{name}"
    return run


for _m in V.METHODS:
    R.add(f"retrieve_{_m}", _RETRIEVE_SQL.get(_m))(_method(_m))


@R.add("method_catalog", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}', '{v}')" for k, n, v in [*(("method", m, "") for m in V.METHODS), *(("preset", p, "/".join(map(str, x))) for p, x in V.PRESETS.items()), *(("question", n, " ".join(ms)) for n, _, ms in I.RULES), *(("answer", n, " ".join(ws)) for n, ws in I.ANSWER_TYPES)]) + ") v(kind, name, value)")
def method_catalog(spark: SparkSession, d: str) -> DataFrame:
    return V.catalog(spark)


@R.add(
    "context_simple",
    f"WITH {GRAPH_SQL}, S AS (SELECT e.src, e.metaedge, concat_ws(' ', coalesce(a.name, e.src), coalesce(m.verb, e.metaedge), coalesce(b.name, e.dst)) AS sentence FROM E e LEFT JOIN N a ON a.id = e.src LEFT JOIN N b ON b.id = e.dst LEFT JOIN metaedges m ON m.metaedge = e.metaedge), K AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY metaedge, sentence) AS rn FROM S) SELECT src, string_agg(sentence || '.', ' ' ORDER BY metaedge, sentence) AS context FROM K WHERE rn <= 5 GROUP BY src",
)
def context_simple(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return render(enrich(g.edges, g.nodes, g.schema).select("src", "metaedge", "sentence"), "src")


@R.add("stats_text", f"WITH {GRAPH_SQL} SELECT 'kind' || chr(9) || kind || chr(9) || count(*) AS line FROM N GROUP BY kind UNION ALL SELECT 'metaedge' || chr(9) || metaedge || chr(9) || count(*) FROM E GROUP BY metaedge")
def stats_text(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return G.stats_lines(g.nodes, g.edges)


_XML = "replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"
_KEYS = (("name", "node"), ("kind", "node"), ("metaedge", "edge"), ("weight", "edge"))


@R.add(
    "graphml_export",
    f"""WITH {GRAPH_SQL} SELECT CAST(x.part AS INTEGER) AS part, x.line FROM (SELECT unnest([{{'part': 0, 'line': '<?xml version="1.0" encoding="UTF-8"?>'}}, {{'part': 1, 'line': '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'}}, {{'part': 3, 'line': '<graph id="G" edgedefault="directed">'}}, {{'part': 6, 'line': '</graph>'}}, {{'part': 7, 'line': '</graphml>'}}]) AS x)
    UNION ALL SELECT 2, x FROM (SELECT unnest([{", ".join(f"'<key id={chr(34)}{k}{chr(34)} for={chr(34)}{w}{chr(34)} attr.name={chr(34)}{k}{chr(34)} attr.type={chr(34)}{'double' if k == 'weight' else 'string'}{chr(34)}/>'" for k, w in _KEYS)}]) AS x)
    UNION ALL SELECT 4, '<node id="' || {_XML.format(c='id')} || '"><data key="name">' || {_XML.format(c='name')} || '</data><data key="kind">' || {_XML.format(c='kind')} || '</data></node>' FROM N
    UNION ALL SELECT 5, '<edge source="' || {_XML.format(c='src')} || '" target="' || {_XML.format(c='dst')} || '"><data key="metaedge">' || {_XML.format(c='metaedge')} || '</data><data key="weight">' || CAST(weight AS VARCHAR) || '</data></edge>' FROM E""",
)
def graphml_export(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return G.graphml_lines(g.nodes, g.edges)


@R.add("gexf_export", f"""WITH {GRAPH_SQL} SELECT 3 AS part, '<node id="' || {_XML.format(c='id')} || '" label="' || {_XML.format(c='coalesce(name, id)')} || '"><attvalues><attvalue for="0" value="' || {_XML.format(c='kind')} || '"/></attvalues></node>' AS line FROM N
    UNION ALL SELECT 5, '<edge id="' || seq || '" source="' || {_XML.format(c='src')} || '" target="' || {_XML.format(c='dst')} || '" label="' || {_XML.format(c='metaedge')} || '" weight="' || CAST(weight AS VARCHAR) || '"/>' FROM E""")
def gexf_export(spark: SparkSession, d: str) -> DataFrame:
    """The node and edge lines of the file."""
    g = load(spark, d)
    return G.gexf_lines(g.nodes, g.edges).where("part in (3, 5)")


@R.add("graph_view_json", f"""WITH {GRAPH_SQL} SELECT 'node' AS part, id, '{{"id":' || to_json(id) || CASE WHEN name IS NULL THEN '' ELSE ',"label":' || to_json(name) END || ',"type":' || to_json(kind) || '}}' AS json FROM N UNION ALL SELECT 'edge', CAST(seq AS VARCHAR), '{{"source":' || to_json(src) || ',"target":' || to_json(dst) || CASE WHEN metaedge IS NULL THEN '' ELSE ',"label":' || to_json(metaedge) END || '}}' FROM E""")
def graph_view_json(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return G.view_json(g.nodes, g.edges)


@R.add("sql_passthrough", f"WITH {GRAPH_SQL} SELECT kind, CAST(count(*) AS BIGINT) AS n FROM N GROUP BY kind ORDER BY n DESC, kind LIMIT 5")
def sql_passthrough(spark: SparkSession, d: str) -> DataFrame:
    return G.sql_rows(spark, {"kg_nodes": load(spark, d).nodes}, "SELECT kind, count(*) AS n FROM kg_nodes GROUP BY kind ORDER BY n DESC, kind", 5)


@R.add("cache_lookup", "SELECT value, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id) WHERE ts + INTERVAL 3600 SECOND > TIMESTAMP '2024-01-01 12:00:00' GROUP BY value")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    last = e.groupBy(F.col("user_id").alias("key")).agg(F.max_by(F.struct(F.col("event_type").alias("value"), F.col("ts").alias("stored_at")), F.struct("ts", "event_id")).alias("m")).select("key", "m.*", F.lit(3600).alias("ttl_seconds"))
    return G.cached_values(last, F.lit("2024-01-01 12:00:00").cast("timestamp")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@R.add("stream_window_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return W.run_available(W.windowed_counts(W.stream_table(spark, d, "events"), "ts", "event_type", "1 hour", "1 day"))


@R.add("stream_relations", "SELECT source AS src, target AS dst, metaedge, CAST(count(*) AS BIGINT) AS frequency, min(edge_id) AS first_seq FROM graph_edges WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY ALL")
def stream_relations(spark: SparkSession, d: str) -> DataFrame:
    return W.run_available(W.growing_relations(W.stream_table(spark, d, "graph_edges")))
