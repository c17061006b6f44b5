"""Queries of text clean-up, text to graph, references, document search and whole question answering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import text as X
from graphloom.functions.python import chunks_udf, wiki_parts_udf
from graphloom.model import GRAPH_SQL
from graphloom.operators import resolve as Z, search as S, stats as T
from graphloom.plans import answer as P, build as B
from graphloom.queries.base import Registry
from graphloom.queries.graph import load
from graphloom.queries.texts import BM_SQL, DRUGS, ENTITY_SQL, GENES, REL_SQL, TOKENS, WORDS
from graphloom.session import table

R = Registry()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b-\x1f\x7f-\x{{9f}}]', '', 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+\z', '', 'g')"


@R.add("clean_lines", f"SELECT doc_id, md5({_CLEAN.format(c='text')}) AS clean FROM documents WHERE text IS NOT NULL")
def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(X.clean_lines(F.col("text"))).alias("clean"))


@R.add(
    "truncate_smart",
    f"""WITH H AS (SELECT doc_id, text, substr(text, 1, 200) AS h FROM documents WHERE text IS NOT NULL),
    L AS (SELECT *, length(regexp_extract(h, '(?s)^(.*)\\n\\n', 1)) AS p, length(regexp_extract(h, '(?s)^(.*[.!?][ \\n])', 1)) AS s, length(regexp_extract(h, '(?s)^(.*) ', 1)) AS b FROM H)
    SELECT doc_id, md5(CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, CASE WHEN p > 160 THEN p WHEN s - 2 > 140 THEN s WHEN b > 180 THEN b ELSE 200 END) || '{X.CUT_MARK}' END) AS head FROM L""",
)
def truncate_smart(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(X.truncate_smart(F.col("text"), 200)).alias("head"))


@R.add("url_parts", "SELECT page_id, title AS from_url, true AS valid, contains(title, ' ') AS spaced FROM wiki_pages WHERE title IS NOT NULL AND title <> ''")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    """Addresses made of titles and read back."""
    rows = table(spark, d, "wiki_pages").where("title is not null and title <> ''")
    url = F.concat(F.lit("https://xx.example.org/wiki/"), F.replace(F.url_encode("title"), F.lit("+"), F.lit("_")), F.lit("?action=view#top"))
    return rows.select("page_id", X.title_from_url(url).alias("from_url"), X.valid_url(url).alias("valid"), F.col("title").contains(" ").alias("spaced"))


@R.add("allowed_files", "SELECT file_name, CAST(count(*) AS BIGINT) AS n, regexp_matches(lower(file_name), '[.](pkl|sif|tsv|csv|txt|gz)$') AS allowed FROM raw_edges WHERE file_name IS NOT NULL GROUP BY file_name")
def allowed_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_edges").where("file_name is not null").groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("allowed", X.allowed_file(F.col("file_name")))


@R.add("script_tokens", "SELECT doc_id, len(t) <= 3 OR len(list_filter(t, lambda w: NOT regexp_full_match(w, '[a-zA-Z]+'))) * 1.0 / len(t) >= 0.7 AS other_script FROM (SELECT doc_id, string_split_regex(title, '[ \\t]+') AS t FROM documents WHERE title IS NOT NULL)")
def script_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("title is not null").select("doc_id", X.mostly_not_latin(F.col("title")).alias("other_script"))


@R.add("escape_queries", "SELECT doc_id, trim(regexp_replace(title, '([:{}/\\[\\]\\-*\"()|+~^])', repeat(chr(92), 3) || '1', 'g'), ' ') AS escaped FROM documents WHERE title IS NOT NULL")
def escape_queries(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("title is not null").select("doc_id", X.escape_query(F.col("title")).alias("escaped"))


@R.add("chunk_smart")
def chunk_smart(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(chunks_udf("smart", 60)(F.col("text"))).alias("chunk_no", "text"))


@R.add("chunk_windows")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(chunks_udf("window", 60, 0.3)(F.col("text"))).alias("chunk_no", "text"))


@R.add("wiki_page_parts")
def wiki_page_parts(spark: SparkSession, d: str) -> DataFrame:
    """Pages set as HTML with infobox, category and link, and read back."""
    safe = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[<>&]", " ")
    part = F.transform("sections", lambda s: F.concat(F.lit("<h2>"), safe(s["heading"]), F.lit("[edit]</h2><p>"), safe(s["text"]), F.lit("</p>")))
    html = F.concat(F.lit('<table class="infobox"><tr><th>Name</th><td>'), safe(F.col("title")), F.lit('</td></tr></table><p><a href="/wiki/Other_page#x">o</a><a href="/wiki/Category:Genes">c</a></p>'), F.array_join(part, ""))
    rows = table(spark, d, "wiki_pages").select("page_id", wiki_parts_udf()(html).alias("p"))
    return rows.select("page_id", F.size("p.sections").alias("n_sections"), F.get("p.categories", F.lit(0)).alias("category"), F.get("p.links", F.lit(0)).alias("link"), F.try_element_at("p.infobox", F.lit("Name")).alias("named"))


@R.add("extract_long", f"WITH {ENTITY_SQL} SELECT * FROM ENT")
def extract_long(spark: SparkSession, d: str) -> DataFrame:
    """Entities over sliding windows of each text; they equal those of the whole text, as no entity crosses a sentence."""
    return B.extract("long", _docs(spark, d), "doc_id", "text")


CAPS = "list_filter(" + TOKENS.format(c="text") + ", lambda w: regexp_full_match(w, '[A-Z]{2,}|[A-Z][a-z]+([A-Z][a-z]+)+|[0-9]+[A-Za-z]+'))"


@R.add("extract_methods", f"WITH A AS (SELECT doc_id, unnest(list_distinct({CAPS})) AS name, 'capitalized' AS m, 'Entity' AS type FROM documents UNION ALL SELECT doc_id, unnest(list_distinct({GENES.format(c='text')})), 'genes', 'Gene' FROM documents) SELECT doc_id, name, min(type) AS type, string_agg(m, '+' ORDER BY m) AS methods FROM A GROUP BY doc_id, name")
def extract_methods(spark: SparkSession, d: str) -> DataFrame:
    return B.union_extractors(["genes", "capitalized"], _docs(spark, d), "doc_id", "text")


TEXT_GRAPH = f"""{ENTITY_SQL}, {REL_SQL}, TN AS (SELECT lower(trim(name, ' ')) AS id, count(*) AS frequency, avg(CASE type WHEN 'Gene' THEN 0.9 WHEN 'Disease' THEN 0.7 ELSE 0.6 END) AS confidence, arg_max(name, (CASE type WHEN 'Gene' THEN 0.9 WHEN 'Disease' THEN 0.7 ELSE 0.6 END, name, type)) AS name, arg_max(type, (CASE type WHEN 'Gene' THEN 0.9 WHEN 'Disease' THEN 0.7 ELSE 0.6 END, name, type)) AS type FROM ENT GROUP BY lower(trim(name, ' '))),
TE AS (SELECT lower(src) AS src, lower(dst) AS dst, metaedge, count(*) AS frequency, count(*) * 0.75 AS weight FROM REL WHERE lower(src) <> lower(dst) AND lower(src) IN (SELECT id FROM TN) AND lower(dst) IN (SELECT id FROM TN) GROUP BY ALL)"""


@R.add("text_graph_edges", f"WITH {TEXT_GRAPH} SELECT src, dst, metaedge, CAST(frequency AS BIGINT) AS frequency, CAST(weight AS DOUBLE) AS weight FROM TE")
def text_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return B.text_graph(_docs(spark, d), "doc_id", "text")[1]


@R.add("text_graph_nodes", f"WITH {TEXT_GRAPH} SELECT id, name, type, CAST(frequency AS BIGINT) AS frequency, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM TN WHERE id IN (SELECT src FROM TE UNION SELECT dst FROM TE)")
def text_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return B.text_graph(_docs(spark, d), "doc_id", "text")[0].withColumn("confidence", F.round("confidence", 6))


_RELATION_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(q, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in X.RELATION_WORDS) + f" ELSE '{X.OTHER_RELATION}' END"


@R.add("sentence_relations", f"WITH S AS (SELECT list_sort(list_distinct({GENES.format(c='s')})) AS g, lower(s) AS q FROM (SELECT unnest(string_split_regex(text, '[.!?؟][ \\t\\n\\r]+')) AS s FROM documents WHERE text IS NOT NULL)) SELECT a, b, relation, CAST(count(*) AS BIGINT) AS n FROM (SELECT x.a, unnest(list_filter(g, lambda z: z > x.a)) AS b, {_RELATION_SQL} AS relation FROM (SELECT g, q, unnest(g) AS a FROM S WHERE len(g) > 1) x) GROUP BY ALL")
def sentence_relations(spark: SparkSession, d: str) -> DataFrame:
    return B.sentence_pairs(_docs(spark, d), "doc_id", "text")


@R.add("coreferences")
def coreferences(spark: SparkSession, d: str) -> DataFrame:
    return B.references(_docs(spark, d), "doc_id", "text", ("gene", "protein", "record", "ژن"))


@R.add("attached_references")
def attached_references(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    refs = B.references(docs, "doc_id", "text", ("gene", "protein", "record", "ژن"))
    return B.attached(B.extract("genes", docs, "doc_id", "text"), refs, "doc_id").select("doc_id", "name", F.array_join("references", "|").alias("refs"))


_NDOC = "NDOC AS (SELECT doc_id, trim(regexp_replace(regexp_replace(translate(regexp_replace(text, '\\x{200C}', ' ', 'g'), 'يكة٠١٢٣٤٥٦٧٨٩', 'یکه۰۱۲۳۴۵۶۷۸۹'), '\\x{200D}', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS text FROM documents)"


@R.add("modular_extraction", f"WITH {_NDOC}, {ENTITY_SQL.replace('FROM documents', 'FROM NDOC')} SELECT doc_id, name, type FROM ENT")
def modular_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Normal form, then entities: the tables of the modular pipeline."""
    return B.pipeline(_docs(spark, d), "doc_id", "text", ("normalize", "entities"))["entities"]


@R.add("entity_node_matches", f"WITH {GRAPH_SQL}, EN AS (SELECT DISTINCT lower(unnest({DRUGS.format(c='text')})) AS e FROM documents), NN AS (SELECT id, lower(name) AS ln FROM N WHERE name IS NOT NULL AND name <> '') SELECT DISTINCT e AS entity, id FROM EN JOIN NN ON contains(ln, e) OR contains(e, ln)")
def entity_node_matches(spark: SparkSession, d: str) -> DataFrame:
    """Drug names of the texts and the nodes whose names hold them or lie in them."""
    names = _docs(spark, d).select(F.explode(X.drug_names(F.col("text"))).alias("token")).distinct()
    return P.contained(names, load(spark, d).nodes).select(F.col("token").alias("entity"), "id")


@R.add("resolved_edges")
def resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges after similar names of a kind are merged into their best connected node."""
    g = load(spark, d).kept
    return Z.resolve_graph(g.nodes, g.edges, T.degrees(g.edges))[1]


@R.add("document_page", f"WITH {BM_SQL}, D AS (SELECT DISTINCT doc_id, lang, source, title FROM documents WHERE lang IN ('en', 'de') AND source = 'abstracts') SELECT d.doc_id, d.title FROM D d JOIN BM USING (doc_id) ORDER BY round(BM.score, 9) DESC, d.doc_id LIMIT 20 OFFSET 5")
def document_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of a filtered search: some fields of the sixth to twenty-fifth best abstracts in two languages."""
    docs = _docs(spark, d)
    w = docs.where("text is not null").select("doc_id", X.words(F.col("text")).alias("w"))
    score = S.bm25(w, "doc_id", "w", ["kidney", "dose", "headache"]).withColumn("score", F.round("score", 9))
    return S.document_search(docs, "doc_id", {"lang": ["en", "de"], "source": "abstracts"}, score, offset=5, limit=20, fields=["doc_id", "title"])


@R.add("document_highlights", "SELECT doc_id, md5(regexp_replace(text, '(?i)\\b(dose|kidney)\\b', '<em>\\1</em>', 'g')) AS marked FROM documents WHERE text IS NOT NULL")
def document_highlights(spark: SparkSession, d: str) -> DataFrame:
    """Words of a question marked in all texts; letters and digits of ASCII make the borders of words."""
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(S.highlighted(F.col("text"), ["dose", "kidney"])).alias("marked"))


@R.add(
    "rerank_features",
    f"""WITH W AS (SELECT doc_id, list_distinct({WORDS.format(c='text')}) AS w, title IS NOT NULL AS t FROM documents WHERE text IS NOT NULL), V AS (SELECT vec_id AS doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS near FROM embeddings WHERE embedding IS NOT NULL)
    SELECT W.doc_id, round(0.3 * len(list_intersect(w, ['dose', 'headache', 'kidney'])) / len(list_distinct(list_concat(w, ['dose', 'headache', 'kidney']))) + 0.7 * coalesce(near, 0) + 10 * CASE WHEN t THEN 0.01 ELSE 0 END, 6) AS score FROM W LEFT JOIN V USING (doc_id)""",
)
def rerank_features(spark: SparkSession, d: str) -> DataFrame:
    """Shared words 0.3, vectors 0.7 and ten times a rank feature."""
    v = table(spark, d, "embeddings").where("embedding is not null")
    q = F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("q"), F.lit(1).alias("k")))
    near = v.withColumn("k", F.lit(1)).join(q, "k").select(F.col("vec_id").cast("bigint").alias("doc_id"), X.cosine(F.col("embedding"), F.col("q")).alias("near"))
    asked = F.array(*[F.lit(t) for t in ("dose", "headache", "kidney")])
    docs = _docs(spark, d).where("text is not null").select("doc_id", X.jaccard(F.array_distinct(X.words(F.col("text"))), asked).alias("shared"), F.create_map(F.lit("pagerank"), F.when(F.col("title").isNotNull(), 0.01).otherwise(0.0)).alias("features"))
    return S.rerank_rows(docs.join(near, "doc_id", "left"), "doc_id", {"pagerank": 10.0}).select("doc_id", F.round("score", 6).alias("score"))


_PART_SQL = "CASE " + " ".join(f"WHEN contains(f, '{p}') THEN '{p}'" for p in X.ANSWER_PARTS) + " END"


@R.add("answer_parts", f"SELECT part, CAST(count(*) AS BIGINT) AS n FROM (SELECT {_PART_SQL} AS part FROM (SELECT lower(string_split(p, chr(10))[1]) AS f FROM (SELECT unnest(string_split(text, chr(10) || chr(10))) AS p FROM documents WHERE text IS NOT NULL))) WHERE part IS NOT NULL GROUP BY part")
def answer_parts(spark: SparkSession, d: str) -> DataFrame:
    p = _docs(spark, d).where("text is not null").select(F.explode(F.split("text", "\n\n")).alias("p"))
    return p.select(X.answer_part(F.col("p")).alias("part")).where("part is not null").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@R.add("extraction_checks", "SELECT doc_id, (doc_id % 3) <> 0 AS valid FROM documents")
def extraction_checks(spark: SparkSession, d: str) -> DataFrame:
    """Extractions as JSON, of which every third lacks its relationships."""
    body = F.to_json(F.struct(F.array("title").alias("entities"), F.when(F.col("doc_id") % 3 != 0, F.array("lang")).alias("relationships")))
    return _docs(spark, d).select("doc_id", X.valid_extraction(body).alias("valid"))


@R.add("process_question")
def process_question(spark: SparkSession, d: str) -> DataFrame:
    """A question from words to answer: bound nodes, retrieved hits and their context in one style."""
    g = load(spark, d).kept
    return P.process(g, "Which compounds treat pain syndrome?", "intelligent", 10, "scientific")


@R.add("compare_contexts")
def compare_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Two retrieval methods on one question: hits of each and of both."""
    g = load(spark, d).kept
    return P.compare(g, "Which compounds treat pain syndrome?", "intelligent", "n_hop", 20)
