"""Queries of smaller operators: predicates, casts, comparison methods, path statistics, quotas, reranking, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import text as X
from graphloom.model import GRAPH_SQL
from graphloom.operators import analytics as A, search as S, traverse as T
from graphloom.operators.expand import capped
from graphloom.operators.extract import entities
from graphloom.operators.stats import degrees
from graphloom.queries.analysis import DEGREE_SQL, _pagerank_sql
from graphloom.queries.base import Registry
from graphloom.queries.graph import SEEDS_SQL, load, seeds
from graphloom.queries.texts import ASKED, BM_SQL, ENTITY_SQL, NORMAL, WORDS
from graphloom.session import table

R = Registry()


@R.add("gene_like_nodes", f"WITH {GRAPH_SQL} SELECT id FROM N WHERE regexp_matches(lower(kind), 'gene|protein')")
def gene_like_nodes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d).nodes.where(F.lower("kind").rlike("gene|protein")).select("id")


_NUMBER = "'[ \\t\\r]*(?i:[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?|nan|[+-]?inf(inity)?)[ \\t\\r]*'"


@R.add("safe_numbers", f"SELECT raw_id, CASE WHEN x IS NULL OR NOT regexp_full_match(x, {_NUMBER}) THEN 0.0 ELSE round(CAST(trim(x, chr(32) || chr(9) || chr(13)) AS DOUBLE), 6) END AS weight FROM (SELECT raw_id, string_split(line, chr(9))[4] AS x FROM raw_edges)")
def safe_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Of all lines; what is no decimal number, infinity or NaN gives 0."""
    rows = table(spark, d, "raw_edges").select("raw_id", F.try_element_at(F.split("line", "\t"), F.lit(4)).alias("x"))
    return rows.select("raw_id", F.round(X.safe_double(F.col("x")), 6).alias("weight"))


_CHARS = "list_distinct(string_split({c}, ''))"


@R.add("char_jaccard", f"WITH {GRAPH_SQL}, A AS (SELECT id, {NORMAL.format(c='name')} AS x, {NORMAL.format(c='kind')} AS y FROM N WHERE name IS NOT NULL) SELECT id, round(coalesce(len(list_intersect({_CHARS.format(c='x')}, {_CHARS.format(c='y')})) * 1.0 / nullif(len(list_distinct(list_concat({_CHARS.format(c='x')}, {_CHARS.format(c='y')}))), 0), 0), 6) AS similarity FROM A WHERE x <> '' AND y <> ''")
def char_jaccard(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d).nodes.where("name is not null").select("id", X.normal(F.col("name")).alias("x"), X.normal(F.col("kind")).alias("y")).where("x <> '' and y <> ''")
    return rows.select("id", F.round(X.char_jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


@R.add("compare_methods", f"SELECT doc_id, method, round(CASE method WHEN 'levenshtein' THEN CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0 ELSE 1 - levenshtein(x, y) * 1.0 / greatest(length(x), length(y)) END WHEN 'jaccard' THEN coalesce(len(list_intersect(a, b)) * 1.0 / nullif(len(list_distinct(list_concat(a, b))), 0), 0) ELSE CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) * 1.0 / least(len(a), len(b)) END END, 4) AS similarity FROM (SELECT doc_id, {NORMAL.format(c='title')} AS x, {NORMAL.format(c='node_id')} AS y, list_distinct({WORDS.format(c='title')}) AS a, list_distinct({WORDS.format(c='node_id')}) AS b, unnest(['levenshtein', 'jaccard', 'overlap']) AS method FROM documents WHERE title IS NOT NULL AND node_id IS NOT NULL)")
def compare_methods(spark: SparkSession, d: str) -> DataFrame:
    """Title against key by three methods, rounded to four places."""
    rows = table(spark, d, "documents").where("title is not null and node_id is not null")
    x, y, a, b = X.normal(F.col("title")), X.normal(F.col("node_id")), X.words(F.col("title")), X.words(F.col("node_id"))
    scores = {"levenshtein": X.levenshtein_similarity(x, y), "jaccard": X.jaccard(a, b), "overlap": X.overlap(a, b)}
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.round(s, 4).alias("similarity")) for m, s in scores.items()])
    return rows.select("doc_id", F.explode(each).alias("s")).select("doc_id", "s.*")


@R.add(
    "path_stats",
    f"""WITH {GRAPH_SQL}, {SEEDS_SQL}, A AS (SELECT src, dst FROM E WHERE src <> dst),
    P AS (SELECT s.id AS start, [s.id, a.dst] AS path FROM SEEDS s JOIN E a ON a.src = s.id WHERE a.dst <> s.id UNION ALL SELECT s.id, [s.id, a.dst, b.dst] FROM SEEDS s JOIN E a ON a.src = s.id JOIN E b ON b.src = a.dst WHERE a.dst <> s.id AND b.dst <> s.id AND b.dst <> a.dst),
    G AS (SELECT id FROM N WHERE kind = 'Gene')
    SELECT start, CAST(count(*) AS BIGINT) AS n_paths, round(avg(len(path) - 1), 6) AS mean_hops, CAST(count(*) FILTER (path[2] IN (SELECT id FROM G) OR path[3] IN (SELECT id FROM G)) AS BIGINT) AS with_gene FROM P GROUP BY start""",
)
def path_stats(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    paths = T.cut(T.simple_paths(g.edges, seeds(g), 2).withColumn("pid", F.monotonically_increasing_id()))
    genes = paths.select("pid", F.explode(F.slice("path", 2, 9)).alias("id")).join(g.nodes.where("kind = 'Gene'").select("id"), "id", "left_semi").select("pid").distinct().withColumn("gene", F.lit(1))
    return paths.join(genes, "pid", "left").groupBy("start").agg(F.count(F.lit(1)).alias("n_paths"), F.round(F.avg("hops"), 6).alias("mean_hops"), F.count("gene").alias("with_gene"))


@R.add("non_gene_quota", f"WITH {GRAPH_SQL}, {_pagerank_sql(3)}, H AS (SELECT r.id, round(r.r, 10) AS s, n.kind = 'Gene' AS gene FROM R3 r JOIN N n ON n.id = r.id), X AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY s DESC, id) AS rn FROM H) SELECT id, gene FROM X WHERE rn <= CASE WHEN gene THEN 70 ELSE 30 END")
def non_gene_quota(spark: SparkSession, d: str) -> DataFrame:
    """The best of a ranking with three tenths reserved for other kinds than genes."""
    g = load(spark, d).kept
    hits = A.pagerank(g.nodes, g.edges, 3).join(g.nodes.select("id", (F.col("kind") == "Gene").alias("gene")), "id").withColumn("s", F.round("rank", 10))
    top = capped(hits.where("gene"), ["gene"], [F.desc("s"), "id"], 70).unionByName(capped(hits.where("not gene"), ["gene"], [F.desc("s"), "id"], 30))
    return top.select("id", "gene")


@R.add("rerank", f"WITH {BM_SQL}, TOP AS (SELECT doc_id, round(score, 9) AS score FROM BM ORDER BY round(score, 9) DESC, doc_id LIMIT 200), W AS (SELECT TOP.doc_id, list_distinct(T.w) AS w FROM TOP JOIN T ON T.doc_id = TOP.doc_id) SELECT doc_id, round(0.3 * len(list_intersect(w, ['dose', 'headache', 'kidney'])) / len(list_distinct(list_concat(w, ['dose', 'headache', 'kidney']))) + 1e-10, 6) AS score FROM W")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    """The best 200 by keyword score, scored again by shared words (0.3; no vectors, so 0.7 of nothing)."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", X.words(F.col("text")).alias("w"))
    top = S.bm25(docs, "doc_id", "w", list(ASKED)).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(200)
    asked = F.array(*[F.lit(t) for t in sorted(ASKED)])
    return top.select("doc_id").join(docs, "doc_id").select("doc_id", F.round(0.3 * X.jaccard(F.array_distinct("w"), asked) + 1e-10, 6).alias("score"))


@R.add("entity_documents", f"WITH {ENTITY_SQL} SELECT name, type, CAST(count(*) AS BIGINT) AS frequency, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM ENT GROUP BY name, type")
def entity_documents(spark: SparkSession, d: str) -> DataFrame:
    """Entities with how many and which documents name them first and last: the incremental graph's node state."""
    found = entities(table(spark, d, "documents"), "doc_id", "text")
    return found.groupBy("name", "type").agg(F.count(F.lit(1)).alias("frequency"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@R.add("neighbor_strength", f"WITH {GRAPH_SQL}, {SEEDS_SQL} SELECT e.src AS id, n.kind, CAST(count(*) AS BIGINT) AS n_edges, round(sum(e.weight) + 1e-10, 6) AS strength FROM E e JOIN N n ON n.id = e.dst WHERE e.src IN (SELECT id FROM SEEDS) GROUP BY e.src, n.kind")
def neighbor_strength(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).kept
    e = g.edges.join(seeds(g).select(F.col("id").alias("src")), "src", "left_semi").join(g.nodes.select(F.col("id").alias("dst"), "kind"), "dst")
    return e.groupBy(F.col("src").alias("id"), "kind").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("weight") + 1e-10, 6).alias("strength"))


@R.add("gene_groups", f"WITH {GRAPH_SQL}, P AS (SELECT DISTINCT p.id AS pathway, e.src AS gene FROM E e JOIN N p ON p.id = e.dst WHERE e.metaedge = 'GpPW' AND p.kind = 'Pathway'), C AS (SELECT pathway, count(*) AS n FROM P GROUP BY pathway HAVING count(*) >= 2) SELECT P.pathway, P.gene, CAST(C.n AS BIGINT) AS n_genes FROM P JOIN C ON C.pathway = P.pathway")
def gene_groups(spark: SparkSession, d: str) -> DataFrame:
    """Pathways that at least two genes take part in, a row for each of those genes."""
    g = load(spark, d)
    e = T.cut(g.edges.where("metaedge = 'GpPW'").select(F.col("src").alias("gene"), F.col("dst").alias("id")).distinct().join(g.nodes.where("kind = 'Pathway'").select("id"), "id", "left_semi"))
    n = e.groupBy("id").agg(F.count(F.lit(1)).alias("n_genes")).where("n_genes >= 2")
    return e.join(n, "id").select(F.col("id").alias("pathway"), "gene", "n_genes")


@R.add("fuzzy_names", f"WITH {GRAPH_SQL}, A AS (SELECT DISTINCT {NORMAL.format(c='name')} AS x FROM N WHERE name IS NOT NULL), Q AS (SELECT DISTINCT {NORMAL.format(c='name')} AS x FROM N WHERE name IS NOT NULL AND seq % 50 = 0) SELECT q.x AS asked, a.x AS name, round(1 - levenshtein(q.x, a.x) * 1.0 / greatest(length(q.x), length(a.x)), 6) AS similarity FROM Q q JOIN A a ON a.x <> q.x WHERE q.x <> '' AND a.x <> '' AND levenshtein(q.x, a.x) <= 0.2 * greatest(length(q.x), length(a.x)) + 1e-9")
def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of all kinds close to every fiftieth name, with a similarity of 0.8 or more."""
    from graphloom.operators.resolve import close_names

    forms = load(spark, d).nodes.where("name is not null").select(X.normal(F.col("name")).alias("x"), (F.col("seq") % 50 == 0).alias("q")).where("x <> ''")
    return close_names(forms.where("q").select("x").distinct(), forms.select("x").distinct()).select("asked", "name", F.round("similarity", 6).alias("similarity"))


@R.add("answer_template", f"WITH {GRAPH_SQL}, T AS (SELECT e.dst AS id, e.src, row_number() OVER (PARTITION BY e.dst ORDER BY coalesce(n.name, n.id), n.id) AS rn, coalesce(n.name, n.id) AS name FROM E e JOIN N n ON n.id = e.src WHERE e.metaedge = 'CtD') SELECT d.id, coalesce(d.name, d.id) || ' is treated by ' || string_agg(T.name, ', ' ORDER BY T.rn) || '.' AS answer FROM N d JOIN T ON T.id = d.id WHERE T.rn <= 3 GROUP BY d.id, d.name")
def answer_template(spark: SparkSession, d: str) -> DataFrame:
    """A sentence for each disease with up to three treatments."""
    g = load(spark, d)
    e = g.edges.where("metaedge = 'CtD'").select(F.col("dst").alias("id"), "src").join(g.nodes.select(F.col("id").alias("src"), F.coalesce("name", "id").alias("drug")), "src")
    top = capped(e, ["id"], ["drug", "src"], 3).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("drug", "src"))).alias("t"))
    named = F.array_join(F.transform("t", lambda x: x["drug"]), ", ")
    return g.nodes.join(top, "id").select("id", F.concat(F.coalesce("name", "id"), F.lit(" is treated by "), named, F.lit(".")).alias("answer"))


@R.add("hub_share", f"WITH {GRAPH_SQL}, {DEGREE_SQL} SELECT n.kind, CAST(max(d.degree) AS BIGINT) AS most, round(avg(d.degree) + 1e-10, 6) AS mean FROM N n JOIN DEG d ON d.id = n.id GROUP BY n.kind")
def hub_share(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return degrees(g.edges).join(g.nodes.select("id", "kind"), "id").groupBy("kind").agg(F.max("degree").alias("most"), F.round(F.avg("degree") + 1e-10, 6).alias("mean"))


@R.add("cache_keys")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.cache_key(F.col("title"), F.col("lang"), F.col("source")).alias("key"))
