"""Text to graph: extractors by name, long texts in windows, references, and the pipeline from documents to tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from graphloom.functions import text as X
from graphloom.functions.python import chunks_udf
from graphloom.operators import extract as E, merge as M, stats as S
from graphloom.session import cut

#: Confidence of extracted entities by type, and of relations.
CONFIDENCE, OTHER_CONFIDENCE = {"Gene": 0.9, "Disease": 0.7}, 0.6

Extractor = Callable[[DataFrame, str, str], DataFrame]
EXTRACTORS: dict[str, Extractor] = {}


def extractor(name: str) -> Callable[[Extractor], Extractor]:
    """Register an extractor: (documents, key, text) to (key, name, type) entities."""

    def keep(f: Extractor) -> Extractor:
        EXTRACTORS[name] = f
        return f

    return keep


@extractor("simple")
def simple(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Genes, diseases and compounds by pattern."""
    return E.entities(docs, key, text)


@extractor("genes")
def genes(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(X.gene_symbols(F.col(text)))).alias("name")).withColumn("type", F.lit("Gene"))


@extractor("capitalized")
def capitalized(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Runs of capitals, words of several capitalized parts, and figures followed by letters."""
    found = F.filter(X.tokens(F.col(text)), lambda w: w.rlike("^(?:[A-Z]{2,}|[A-Z][a-z]+(?:[A-Z][a-z]+)+|[0-9]+[A-Za-z]+)\\z"))
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(found)).alias("name")).withColumn("type", F.lit("Entity"))


@extractor("long")
def long_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Windows of sentences are read one by one and what they give is merged."""
    return windowed(docs, key, text, simple)


@extractor("normalized")
def normalized(docs: DataFrame, key: str, text: str) -> DataFrame:
    """After white space is collapsed and Persian letters are unified."""
    return simple(docs.withColumn(text, X.squeeze(X.persian_normal(F.col(text)))), key, text)


def extract(name: str, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Entities by the extractor of a name."""
    if name not in EXTRACTORS:
        raise ValueError(f"extractor {name!r} is none of {', '.join(sorted(EXTRACTORS))}")
    return EXTRACTORS[name](docs, key, text)


def windowed(docs: DataFrame, key: str, text: str, read: Extractor, most: int = 200, ratio: float = 0.2) -> DataFrame:
    """(key, name, type): an extractor over sliding windows of each text, repeated finds of a text merged."""
    windows = docs.where(F.col(text).isNotNull()).select(key, F.explode(chunks_udf("window", most, ratio)(F.col(text))).alias(text))
    return read(windows, key, text).distinct()


def scored(entities: DataFrame) -> DataFrame:
    """Entities with their confidence and merge key."""
    conf = F.lit(OTHER_CONFIDENCE)
    for t, c in CONFIDENCE.items():
        conf = F.when(F.col("type") == t, c).otherwise(conf)
    return entities.withColumn("key", F.lower(F.trim("name"))).withColumn("conf", conf)


def text_graph(docs: DataFrame, key: str, text: str, method: str = "simple", least_weight: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents: entities merged by name, relations between them weighted; isolated nodes go.

    ``nodes(id, name, type, frequency, confidence)``, ``edges(src, dst, metaedge, frequency, weight)``.
    """
    nodes = cut(M.merge_entities(scored(extract(method, docs, key, text)), "key", "conf", ["name", "type"]).select(F.col("key").alias("id"), "name", "type", "frequency", "confidence"))
    rel = E.relations(docs, key, text).select(F.lower("src").alias("src"), F.lower("dst").alias("dst"), "metaedge").withColumn("conf", F.lit(None).cast("double"))
    ids = nodes.select("id")
    known = rel.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    edges = cut(M.merge_relations(known, "conf").where(F.col("weight") >= least_weight).select("src", "dst", "metaedge", "frequency", "weight"))
    return S.without_isolated(nodes, edges), edges


def sentence_pairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b, relation, n): pairs of symbols in one sentence and the relation its words state."""
    s = docs.where(F.col(text).isNotNull()).select(F.explode(X.sentences(F.col(text))).alias("s")).select("s", F.array_sort(F.array_distinct(X.gene_symbols(F.col("s")))).alias("g")).where(F.size("g") > 1)
    sets = s.groupBy("g", X.sentence_relation(F.col("s")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))  # equal sets once
    pairs = sets.select("n", "relation", "g", F.posexplode("g").alias("i", "a")).select("n", "relation", "a", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("b"))
    return pairs.groupBy("a", "b", "relation").agg(F.sum("n").alias("n"))


#: Words that refer back, before a noun.
REFERRING = ("this", "that", "the", "این", "آن")


def references(docs: DataFrame, key: str, text: str, nouns: tuple[str, ...], reach: int = 200) -> DataFrame:
    """(key, ref, ref_begin, name): each "this gene" and its like with the nearest symbol of the text."""
    pattern = f"(?i)(?<![\\p{{L}}\\p{{M}}\\p{{N}}_])(?:{'|'.join(REFERRING)})[ \\t\\n]+(?:{'|'.join(nouns)})(?![\\p{{L}}\\p{{M}}\\p{{N}}_])"
    t = F.col(text)
    rows = docs.where(t.isNotNull()).select(key, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("refs"), F.transform(F.split(t, pattern), lambda s: F.length(s)).alias("gaps")).where("size(refs) > 0")
    each = rows.select(key, "refs", "gaps", F.posexplode("refs").alias("i", "ref"))
    begin = F.aggregate(F.slice("gaps", F.lit(1), F.col("i") + 1), F.lit(0), lambda s, x: s + x) + F.aggregate(F.slice("refs", F.lit(1), F.col("i")), F.lit(0), lambda s, x: s + F.length(x))
    refs = cut(each.select(key, "ref", begin.alias("ref_begin")))
    near = E.nearest(refs.select(key, "ref_begin"), E.spans(docs, key, text), key, reach)
    return refs.join(near.drop("distance"), [key, "ref_begin"])


def attached(entities: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Entities with the distinct references that lead to them, in order; none gives an empty list."""
    lists = refs.groupBy(key, "name").agg(F.array_sort(F.collect_set("ref")).alias("references"))
    return entities.join(lists, [key, "name"], "left").withColumn("references", F.coalesce("references", F.array().cast("array<string>")))


def pipeline(docs: DataFrame, key: str, text: str, steps: tuple[str, ...] = ("normalize", "entities", "relations", "references")) -> dict[str, DataFrame]:
    """The tables of a modular extraction, each step on what the one before gives."""
    known = {"normalize", "entities", "relations", "references"}
    if unknown := set(steps) - known:
        raise ValueError(f"steps {sorted(unknown)} are none of {', '.join(sorted(known))}")
    rows = docs.withColumn(text, X.squeeze(X.persian_normal(F.col(text)))) if "normalize" in steps else docs
    out = {}
    if "entities" in steps:
        out["entities"] = simple(rows, key, text)
    if "relations" in steps:
        out["relations"] = E.relations(rows, key, text)
    if "references" in steps:
        out["references"] = references(rows, key, text, ("gene", "protein", "ژن", "پروتئین"))
    return out


def union_extractors(names: list[str], docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, type, methods): what several extractors give, merged by name, with those that found it."""
    found = reduce(DataFrame.unionByName, [extract(n, docs, key, text).withColumn("method", F.lit(n)) for n in names])
    return found.groupBy(key, "name").agg(F.min("type").alias("type"), F.array_join(F.array_sort(F.collect_set("method")), "+").alias("methods"))
