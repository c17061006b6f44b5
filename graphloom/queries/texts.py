"""Queries of text functions, extraction, merging, resolution and search over documents, names and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import text as X
from graphloom.functions.python import html_text_udf, sequence_ratio_udf
from graphloom.model import GRAPH_SQL, latest_nodes
from graphloom.operators import extract as E, merge as M, resolve as Z, search as S
from graphloom.operators.stats import histogram
from graphloom.queries.base import Registry
from graphloom.queries.graph import load
from graphloom.session import table

R = Registry()

SQUEEZE = "trim(regexp_replace({c}, '[ \\t\\n\\r]+', ' ', 'g'), ' ')"
NORMAL = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 \\t\\n\\r]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), ' ')"
WORDS = "list_filter(string_split(" + NORMAL + ", ' '), lambda w: w <> '')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@R.add("normalize_text", f"SELECT doc_id, md5({NORMAL.format(c='text')}) AS normal, CAST(len({WORDS.format(c='text')}) AS INTEGER) AS n_words FROM documents WHERE text IS NOT NULL")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(X.normal(F.col("text"))).alias("normal"), F.size(X.words(F.col("text"))).alias("n_words"))


@R.add("squeeze_title", f"SELECT doc_id, {SQUEEZE.format(c='title')} AS title FROM documents")
def squeeze_title(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.squeeze(F.col("title")).alias("title"))


@R.add("truncate_text", "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE concat(CASE WHEN regexp_extract(substr(text, 1, 100), '(?s)^(.*) ', 1) <> '' THEN regexp_extract(substr(text, 1, 100), '(?s)^(.*) ', 1) ELSE substr(text, 1, 100) END, '...') END AS head FROM documents WHERE text IS NOT NULL")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", X.truncate(F.col("text"), 100).alias("head"))


@R.add("dedupe_normal", f"SELECT normal, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM (SELECT doc_id, md5({NORMAL.format(c='text')}) AS normal FROM documents WHERE text IS NOT NULL) GROUP BY normal")
def dedupe_normal(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").groupBy(F.md5(X.normal(F.col("text"))).alias("normal")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@R.add("jaccard_title", f"SELECT doc_id, round(coalesce(len(list_intersect(a, b)) * 1.0 / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) AS jaccard, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) * 1.0 / least(len(a), len(b)) END, 6) AS overlap FROM (SELECT doc_id, list_distinct({WORDS.format(c='title')}) AS a, list_distinct({WORDS.format(c='text')}) AS b FROM documents WHERE title IS NOT NULL AND text IS NOT NULL)")
def jaccard_title(spark: SparkSession, d: str) -> DataFrame:
    a, b = X.words(F.col("title")), X.words(F.col("text"))
    return _docs(spark, d).where("title is not null and text is not null").select("doc_id", F.round(X.jaccard(a, b), 6).alias("jaccard"), F.round(X.overlap(a, b), 6).alias("overlap"))


@R.add("levenshtein_names", f"WITH {GRAPH_SQL}, A AS (SELECT e.seq, {NORMAL.format(c='a.name')} AS x, {NORMAL.format(c='b.name')} AS y FROM E e JOIN N a ON a.id = e.src JOIN N b ON b.id = e.dst WHERE e.metaedge IN ('DrD', 'CrC') AND a.name IS NOT NULL AND b.name IS NOT NULL) SELECT seq, round(CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0 ELSE 1 - levenshtein(x, y) * 1.0 / greatest(length(x), length(y)) END, 6) AS similarity FROM A")
def levenshtein_names(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    n = g.nodes.where("name is not null").select("id", X.normal(F.col("name")).alias("w"))
    e = g.edges.where(F.col("metaedge").isin("DrD", "CrC")).join(n.select(F.col("id").alias("src"), F.col("w").alias("x")), "src").join(n.select(F.col("id").alias("dst"), F.col("w").alias("y")), "dst")
    return e.select("seq", F.round(X.levenshtein_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@R.add("sequence_ratio")
def sequence_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("title is not null and node_id is not null").select("doc_id", F.round(sequence_ratio_udf("title", "node_id"), 6).alias("ratio"))


@R.add("lang_detect", "SELECT doc_id, CASE WHEN s > 0.5 THEN 'fa' WHEN s > 0.1 THEN 'mixed' ELSE 'en' END AS script FROM (SELECT doc_id, coalesce(length(regexp_replace(text, '[^\\x{0600}-\\x{06FF}]', '', 'g')) * 1.0 / nullif(length(regexp_replace(text, '[ \\t\\n\\r]', '', 'g')), 0), 0) AS s FROM documents WHERE text IS NOT NULL)")
def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", X.script_language(F.col("text")).alias("script"))


@R.add("persian_normal", "SELECT doc_id, md5(regexp_replace(translate(regexp_replace(text, '\\x{200C}', ' ', 'g'), 'يكة٠١٢٣٤٥٦٧٨٩', 'یکه۰۱۲۳۴۵۶۷۸۹'), '\\x{200D}', '', 'g')) AS normal FROM documents WHERE text IS NOT NULL")
def persian_normal(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(X.persian_normal(F.col("text"))).alias("normal"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_EN + X.STOP_FA)


@R.add("stopword_strip", f"SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(lower(translate(text, 'İΣ', 'iσ')), '[ \\t\\n\\r]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP})), ' ')) AS kept FROM documents WHERE text IS NOT NULL")
def stopword_strip(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(X.without_stop_words(F.col("text"))).alias("kept"))


@R.add("emoji_strip", "SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]', '', 'g')) AS INTEGER) AS n_emoji FROM documents WHERE text IS NOT NULL")
def emoji_strip(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).where("text is not null").select("doc_id", (F.length(t) - F.length(X.without_emoji(t))).alias("n_emoji"))


@R.add("fulltext_keywords", "SELECT doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(trim(regexp_replace(lower(title), '[ :|\\r\\n\\t,?/`!&^%()\\[\\]{}<>]+', ' ', 'g')), '(^| )(what|who|how|which|where|why)(''re|''s)? ', ' ', 'g'), ' +'), lambda w: length(w) > 1)[1:10], ' ') AS keywords FROM documents WHERE title IS NOT NULL")
def fulltext_keywords(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("title is not null").select("doc_id", F.array_join(X.fulltext_keywords(F.col("title")), " ").alias("keywords"))


@R.add("keyword_topk", f"SELECT w AS term, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({WORDS.format(c='text')}) AS w FROM documents) WHERE length(w) > 2 AND w NOT IN ({_STOP}) GROUP BY w ORDER BY n DESC, w LIMIT 100")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    w = _docs(spark, d).select(F.explode(X.words(F.col("text"))).alias("term")).where((F.length("term") > 2) & ~F.col("term").isin(*X.STOP_EN, *X.STOP_FA))
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(100)


@R.add("sentence_split", "SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[.!?؟][ \\t\\n\\r]+'), lambda s: trim(s, ' ') <> '')) AS INTEGER) AS n_sentences, CAST(len(list_filter(string_split_regex(text, '\\n[ \\t\\r]*\\n'), lambda s: trim(s, ' ') <> '')) AS INTEGER) AS n_paragraphs FROM documents WHERE text IS NOT NULL")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(X.sentences(t)).alias("n_sentences"), F.size(X.paragraphs(t)).alias("n_paragraphs"))


@R.add("chunk_fixed", "SELECT doc_id, CAST(s AS INTEGER) AS start, md5(substr(text, s + 1, 300)) AS chunk FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 300 THEN [0] ELSE range(0, ((length(text) - 50 - 1) // 250) * 250 + 1, 250) END) AS s FROM documents WHERE text IS NOT NULL)")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("text is not null").select("doc_id", F.explode(X.fixed_chunks(F.col("text"), 300, 50)).alias("c"))
    return rows.select("doc_id", "c.start", F.md5("c.chunk").alias("chunk"))


def _pack_sql(table_: str, key: str, pattern: str, most: int) -> str:
    """Greedy packing of the parts of a text, one part after the other."""
    return f"""WITH RECURSIVE S AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) AS i, s, CAST(floor(len(list_filter(string_split_regex(s, '[ \\t\\n\\r]+'), lambda w: w <> '')) * 1.33) AS INTEGER) AS t
      FROM (SELECT {key}, unnest(range(1, len(p) + 1)) AS i, trim(unnest(p), ' ') AS s FROM (SELECT {key}, string_split_regex(text, '{pattern}') AS p FROM {table_} WHERE text IS NOT NULL)) WHERE s <> ''),
    R AS (SELECT {key}, i, 0 AS c, t AS n FROM S WHERE i = 1 UNION ALL SELECT s.{key}, s.i, CASE WHEN r.n + s.t <= {most} THEN r.c ELSE r.c + 1 END, CASE WHEN r.n + s.t <= {most} THEN r.n + s.t ELSE s.t END FROM R r JOIN S s ON s.{key} = r.{key} AND s.i = r.i + 1)
    SELECT R.{key}, CAST(c AS INTEGER) AS chunk_no, string_agg(s, ' ' ORDER BY R.i) AS text, CAST(sum(t) AS INTEGER) AS tokens FROM R JOIN S ON S.{key} = R.{key} AND S.i = R.i GROUP BY R.{key}, c"""


@R.add("chunk_sentences", _pack_sql("documents", "doc_id", "[.!?؟][ \\t\\n\\r]+", 60))
def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("text is not null").select("doc_id", F.posexplode(X.pack(X.sentences(F.col("text")), 60)).alias("chunk_no", "c"))
    return rows.select("doc_id", "chunk_no", "c.text", "c.tokens")


@R.add("chunk_paragraphs", _pack_sql("(SELECT DISTINCT page_id, text FROM wiki_pages)", "page_id", "\\n[ \\t\\r]*\\n", 200))
def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "wiki_pages").where("text is not null").select("page_id", F.posexplode(X.pack(X.paragraphs(F.col("text")), 200)).alias("chunk_no", "c"))
    return rows.select("page_id", "chunk_no", "c.text", "c.tokens")


TOKENS = "string_split_regex({c}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')"
GENES = "list_filter(" + TOKENS + ", lambda w: regexp_full_match(w, '[A-Z][A-Z0-9]+'))"
DRUGS = "list_filter(" + TOKENS.replace("{c}", "lower({c})") + ", lambda w: regexp_full_match(w, '[a-z]+(" + X.DRUG_ENDINGS + ")'))"


@R.add("regex_entities", f"SELECT g AS name, CAST(count(*) AS BIGINT) AS mentions, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM (SELECT doc_id, unnest({GENES.format(c='text')}) AS g FROM documents) GROUP BY g")
def regex_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", F.explode(X.gene_symbols(F.col("text"))).alias("name"))
    each = rows.groupBy("name", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("name").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("docs"))


DISEASE_SQL = "'" + E.DISEASE + "'"
ENTITY_SQL = f"""ENT AS (SELECT DISTINCT doc_id, name, type FROM (
  SELECT doc_id, unnest({GENES.format(c='text')}) AS name, 'Gene' AS type FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, {DISEASE_SQL}, 1)), 'Disease' FROM documents
  UNION ALL SELECT doc_id, unnest({DRUGS.format(c='text')}), 'Compound' FROM documents))"""


@R.add("extract_simple", f"WITH {ENTITY_SQL} SELECT * FROM ENT")
def extract_simple(spark: SparkSession, d: str) -> DataFrame:
    return E.entities(_docs(spark, d), "doc_id", "text")


REL_SQL = "REL AS (" + " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, '(?i){p}', 1)) AS src, unnest(regexp_extract_all(text, '(?i){p}', 2)) AS dst, '{m}' AS metaedge FROM documents" for p, m in E.RELATIONS) + ")"


@R.add("extract_relations", f"WITH {REL_SQL} SELECT * FROM REL")
def extract_relations(spark: SparkSession, d: str) -> DataFrame:
    return E.relations(_docs(spark, d), "doc_id", "text")


@R.add("merge_entities", f"WITH {ENTITY_SQL}, C AS (SELECT *, lower(trim(name, ' ')) AS key, CASE type WHEN 'Gene' THEN 0.9 WHEN 'Disease' THEN 0.7 ELSE 0.6 END AS conf FROM ENT) SELECT key, CAST(count(*) AS BIGINT) AS frequency, round(avg(conf), 6) AS confidence, round(count(*) * avg(conf), 6) AS weight, arg_max(name, (conf, name, type)) AS name, arg_max(type, (conf, name, type)) AS type FROM C GROUP BY key HAVING avg(conf) >= 0.5")
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    conf = F.when(F.col("type") == "Gene", 0.9).when(F.col("type") == "Disease", 0.7).otherwise(0.6)
    rows = E.entities(_docs(spark, d), "doc_id", "text").withColumn("key", F.lower(F.trim("name"))).withColumn("conf", conf)
    m = M.merge_entities(rows, "key", "conf", ["name", "type"], 0.5)
    return m.withColumn("confidence", F.round("confidence", 6)).withColumn("weight", F.round("weight", 6))


@R.add("weight_relations", f"WITH {REL_SQL} SELECT src, dst, metaedge, CAST(count(*) AS BIGINT) AS frequency, CAST(0.5 AS DOUBLE) AS confidence, CAST(count(*) * 0.75 AS DOUBLE) AS weight FROM REL GROUP BY ALL")
def weight_relations(spark: SparkSession, d: str) -> DataFrame:
    return M.merge_relations(E.relations(_docs(spark, d), "doc_id", "text").withColumn("conf", F.lit(None).cast("double")), "conf")


@R.add("merge_edges", "SELECT source AS src, target AS dst, metaedge, CAST(count(*) AS BIGINT) AS frequency, round(avg(coalesce(weight, 0.5)) + 1e-10, 6) AS confidence, round(count(*) * (0.5 + 0.5 * avg(coalesce(weight, 0.5))) + 1e-10, 6) AS weight FROM graph_edges WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY ALL HAVING avg(coalesce(weight, 0.5)) >= 0.3")
def merge_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "graph_edges").where("source is not null and target is not null").select(F.col("source").alias("src"), F.col("target").alias("dst"), "metaedge", F.col("weight").alias("conf"))
    # Means of a power of two of decimals end on ties; the small addend rounds them up whatever their last bit.
    return M.merge_relations(e, "conf", 0.3).withColumn("confidence", F.round(F.col("confidence") + 1e-10, 6)).withColumn("weight", F.round(F.col("weight") + 1e-10, 6))


@R.add("canonicalize", f"WITH {ENTITY_SQL} SELECT key AS canonical, CAST(count(*) AS BIGINT) AS mentions, CAST(count(DISTINCT name) AS BIGINT) AS spellings FROM (SELECT name, upper(name[1]) || lower(name[2:]) AS key FROM ENT WHERE type <> 'Disease') GROUP BY key")
def canonicalize(spark: SparkSession, d: str) -> DataFrame:
    return M.canonical(E.entities(_docs(spark, d), "doc_id", "text").where("type <> 'Disease'"), "name")


@R.add("cooccur_pairs", f"WITH S AS (SELECT list_sort(list_distinct({GENES.format(c='s')})) AS g FROM (SELECT unnest(string_split_regex(text, '[.!?؟][ \\t\\n\\r]+')) AS s FROM documents WHERE text IS NOT NULL)) SELECT a, b, CAST(count(*) AS BIGINT) AS n FROM (SELECT x.a, unnest(list_filter(g, lambda z: z > x.a)) AS b FROM (SELECT g, unnest(g) AS a FROM S WHERE len(g) > 1) x) GROUP BY a, b")
def cooccur_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.cooccurring(_docs(spark, d), "doc_id", "text")


def _refs(docs: DataFrame) -> DataFrame:
    """Where a text says "the gene": references to the nearest symbol."""
    parts = F.transform(F.split("text", "the gene "), lambda s: F.length(s))
    rows = docs.where("text is not null").select("doc_id", parts.alias("p")).where("size(p) > 1")
    each = rows.select("doc_id", "p", F.posexplode(F.slice("p", F.lit(1), F.size("p") - 1)).alias("i", "x"))
    begin = F.aggregate(F.slice("p", F.lit(1), F.col("i") + 1), F.lit(0), lambda s, x: s + x) + F.col("i") * 9
    return each.select("doc_id", begin.alias("ref_begin"))


@R.add("nearest_entity")
def nearest_entity(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return E.nearest(_refs(docs), E.spans(docs, "doc_id", "text"), "doc_id")


@R.add("span_overlap")
def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    refs = _refs(docs).select("doc_id", F.col("ref_begin").alias("a_begin"), (F.col("ref_begin") + 20).alias("a_end"))
    marks = E.spans(docs, "doc_id", "text").select("doc_id", F.col("begin").alias("b_begin"), F.col("end").alias("b_end"))
    return E.overlapping(refs, marks, "doc_id")


@R.add("entity_candidates")
def entity_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Of each name that is similar to others of its kind: the number of its links and the best of them."""
    forms = Z.distinct_forms(latest_nodes(table(spark, d, "graph_nodes")))
    pairs = Z.unblocked(Z.candidates(forms)).withColumn("similarity", F.round("similarity", 6))
    return Z.links(pairs)


@R.add("resolve_entities")
def resolve_entities(spark: SparkSession, d: str) -> DataFrame:
    forms = Z.distinct_forms(latest_nodes(table(spark, d, "graph_nodes")))
    return Z.star_groups(forms, Z.unblocked(Z.candidates(forms)))


REDIRECT_SQL = f"WITH {GRAPH_SQL}, K AS (SELECT kind, name, min(id) AS keep FROM N WHERE name IS NOT NULL GROUP BY kind, name), MAP AS (SELECT n.id, k.keep FROM N n JOIN K k ON k.kind = n.kind AND k.name = n.name), X AS (SELECT coalesce(a.keep, e.src) AS src, e.metaedge, coalesce(b.keep, e.dst) AS dst, e.weight, e.seq, e.src = e.dst AS lp FROM E e LEFT JOIN MAP a ON a.id = e.src LEFT JOIN MAP b ON b.id = e.dst) SELECT src, metaedge, dst, max(weight) AS weight, min(seq) AS seq FROM X WHERE src <> dst OR lp GROUP BY src, metaedge, dst"


@R.add("resolve_endpoints", REDIRECT_SQL)
def resolve_endpoints(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    keep = g.nodes.where("name is not null").groupBy("kind", "name").agg(F.min("id").alias("to"))
    mapping = g.nodes.join(keep, ["kind", "name"]).select("id", "to")
    return Z.redirect(g.edges, mapping)


@R.add("graph_delta_apply", "WITH C AS (SELECT * FROM graph_nodes WHERE id IS NOT NULL), L AS (SELECT id, max(node_row) AS node_row FROM C WHERE deleted_at IS NULL GROUP BY id) SELECT c.id, c.node_row FROM C c JOIN L l ON l.id = c.id AND l.node_row = c.node_row")
def graph_delta_apply(spark: SparkSession, d: str) -> DataFrame:
    """Live keys after replaying the log: each row adds or replaces its key unless it is deleted."""
    rows = table(spark, d, "graph_nodes").where("id is not null").select("id", "node_row", "deleted_at")
    log = rows.groupBy("id").agg(F.max(F.when(F.col("deleted_at").isNull(), F.col("node_row"))).alias("node_row")).select("id", "node_row", F.when(F.col("node_row").isNull(), "remove").otherwise("modify").alias("op"))
    return M.apply_changes(rows.groupBy("id").agg(F.min("node_row").alias("node_row")), log, "id")


@R.add("vector_topk", "WITH V AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL), X AS (SELECT q.vec_id AS query_id, b.vec_id AS key, round(list_cosine_similarity(q.v, b.v), 9) AS score FROM V q JOIN V b ON b.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0) SELECT query_id, key, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM X) WHERE rank <= 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return S.vector_topk(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 10).select("query_id", "key", F.round("score", 6).alias("score"), "rank")


ASKED = ("kidney", "dose", "headache")
_LIST = "[" + ", ".join(f"'{t}'" for t in sorted(ASKED)) + "]"
BM_SQL = f"""T AS (SELECT doc_id, {WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL),
ST AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM T),
TF AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(list_filter(w, lambda x: list_contains({_LIST}, x))) AS term FROM T) GROUP BY ALL),
DF AS (SELECT term, count(*) AS df FROM TF GROUP BY term),
BM AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM TF JOIN DF USING (term), ST GROUP BY doc_id)"""


@R.add("bm25_search", f"WITH {BM_SQL} SELECT doc_id, round(score, 6) AS score FROM BM")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).where("text is not null").select("doc_id", X.words(F.col("text")).alias("w"))
    return S.bm25(docs, "doc_id", "w", list(ASKED)).select("doc_id", F.round("score", 6).alias("score"))


@R.add("hybrid_search", f"WITH {BM_SQL}, V AS (SELECT vec_id AS doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings WHERE embedding IS NOT NULL), U AS (SELECT doc_id, 0.3 * score / (SELECT max(score) FROM BM) AS s FROM BM UNION ALL SELECT doc_id, 0.7 * score / (SELECT max(score) FROM V) FROM V) SELECT doc_id, round(sum(s), 6) AS score FROM U GROUP BY doc_id")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword part 0.3 and vector part 0.7; the question's vector is that of row 0."""
    docs = _docs(spark, d).where("text is not null").select("doc_id", X.words(F.col("text")).alias("w"))
    v = table(spark, d, "embeddings").where("embedding is not null")
    q = F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("q"), F.lit(1).alias("k")))
    near = v.withColumn("k", F.lit(1)).join(q, "k").select(F.col("vec_id").cast("bigint").alias("doc_id"), X.cosine(F.col("embedding"), F.col("q")).alias("score"))
    return S.fuse_scores([(S.bm25(docs, "doc_id", "w", list(ASKED)), 0.3), (near, 0.7)], "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@R.add("tfidf_terms", f"WITH T AS (SELECT doc_id, {WORDS.format(c='title')} AS w FROM documents WHERE title IS NOT NULL), C AS (SELECT count(*) AS n FROM T) SELECT term, round(ln((1.0 + (SELECT n FROM C)) / (1.0 + count(*))) + 1, 6) AS idf FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM T) GROUP BY term")
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).where("title is not null").select("doc_id", X.words(F.col("title")).alias("w"))
    return S.inverse_frequency(docs, "doc_id", "w").select("term", F.round("idf", 6).alias("idf"))


@R.add(
    "citations",
    f"""WITH T AS (SELECT d.doc_id AS id, list_distinct({WORDS.format(c='title')}) AS w, CAST(v.embedding AS DOUBLE[]) AS v FROM documents d JOIN embeddings v ON v.vec_id = d.doc_id WHERE d.title IS NOT NULL AND v.embedding IS NOT NULL),
    X AS (SELECT p.id AS piece, s.id AS source, round(0.1 * len(list_intersect(p.w, s.w)) / greatest(1, len(list_distinct(list_concat(p.w, s.w)))) + 0.9 * list_cosine_similarity(p.v, s.v), 9) AS score FROM T p JOIN T s ON true WHERE p.id % 50 = 0)
    SELECT piece, source, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY score DESC, source) AS rank FROM X WHERE score > 0.3) WHERE rank <= 3""",
)
def citations(spark: SparkSession, d: str) -> DataFrame:
    """Titles with a vector cite the titles of others: shared words and near vectors above a score."""
    v = table(spark, d, "embeddings").where("embedding is not null")
    t = _docs(spark, d).where("title is not null").select(F.col("doc_id").alias("vec_id"), X.words(F.col("title")).alias("words")).join(v, "vec_id")
    pieces = t.where("vec_id % 50 = 0").select(F.col("vec_id").alias("piece"), "words", F.col("embedding").alias("v"))
    return S.citations(pieces, t.select(F.col("vec_id").alias("source"), "words", F.col("embedding").alias("v")), least=0.3).withColumn("score", F.round("score", 6))


@R.add("quality_levels", "SELECT CASE WHEN w >= 0.9 THEN 'excellent' WHEN w >= 0.8 THEN 'very good' WHEN w >= 0.7 THEN 'good' WHEN w >= 0.6 THEN 'fair' WHEN w >= 0.5 THEN 'weak' ELSE 'poor' END AS value, CAST(count(*) AS BIGINT) AS n FROM (SELECT coalesce(weight, 0) AS w FROM graph_edges) GROUP BY 1")
def quality_levels(spark: SparkSession, d: str) -> DataFrame:
    return histogram(table(spark, d, "graph_edges").select(X.level(F.coalesce("weight", F.lit(0.0))).alias("level")), "level")


@R.add("html_main_text")
def html_main_text(spark: SparkSession, d: str) -> DataFrame:
    """Sections set as a page and read back: headings and paragraphs of the main content."""
    part = F.transform("sections", lambda s: F.concat(F.lit("<h2>"), F.coalesce(s["heading"], F.lit("")), F.lit("</h2><nav>menu</nav><p>"), F.regexp_replace(F.coalesce(s["text"], F.lit("")), "[<>&]", " "), F.lit("</p>")))
    pages = table(spark, d, "wiki_pages").select("page_id", F.concat(F.lit("<html><script>x</script><body>"), F.array_join(part, ""), F.lit("</body></html>")).alias("html"))
    return pages.select("page_id", html_text_udf("html").alias("text"))
