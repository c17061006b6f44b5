"""Rule-based extraction of entities and relations, spans, co-occurrence and nearest entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.functions.text import drug_names, gene_symbols, sentences

#: Relation patterns (subject, verb, object) and their metaedges, in order.
RELATIONS = (
    ("(\\w+)\\s+(?:regulates?|controls?)\\s+(\\w+)", "Gr>G"),
    ("(\\w+)\\s+(?:interacts?\\s+with|binds?\\s+to)\\s+(\\w+)", "GiG"),
    ("(\\w+)\\s+(?:treats?|cures?)\\s+(\\w+)", "CtD"),
    ("(\\w+)\\s+(?:participates?\\s+in|involved\\s+in)\\s+(\\w+)", "GpBP"),
    ("(\\w+)\\s+(?:associates?\\s+with|related\\s+to)\\s+(\\w+)", "DaG"),
)
#: Matches begin at words only, so that long runs of letters cost no more than their length.
_WORD_START = "(?i)(?<![A-Za-z0-9_])"
_SYMBOL = "(?<![\\p{L}\\p{M}\\p{N}_])[A-Z][A-Z0-9]+(?![\\p{L}\\p{M}\\p{N}_])"
DISEASE = "\\b([A-Z][a-z]+ (?:disease|syndrome|disorder|cancer|tumor|carcinoma))\\b"


def entities(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, type) distinct genes, diseases and compounds of each text."""
    found = F.concat(
        F.transform(gene_symbols(F.col(text)), lambda x: F.struct(x.alias("name"), F.lit("Gene").alias("type"))),
        F.transform(F.regexp_extract_all(F.col(text), F.lit(DISEASE), F.lit(1)), lambda x: F.struct(x.alias("name"), F.lit("Disease").alias("type"))),
        F.transform(drug_names(F.col(text)), lambda x: F.struct(x.alias("name"), F.lit("Compound").alias("type"))),
    )
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(found)).alias("e")).select(key, "e.name", "e.type")


def _relation(code: str):
    return lambda x, y: F.struct(x.alias("src"), y.alias("dst"), F.lit(code).alias("metaedge"))


def relations(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, src, dst, metaedge) of each match of a relation pattern, repeated ones included."""
    parts = []
    for pattern, code in RELATIONS:
        a = F.regexp_extract_all(F.col(text), F.lit(_WORD_START + pattern), F.lit(1))
        b = F.regexp_extract_all(F.col(text), F.lit(_WORD_START + pattern), F.lit(2))
        parts.append(F.zip_with(a, b, _relation(code)))
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(F.concat(*parts)).alias("r")).select(key, "r.*")


def spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, begin, end) of the gene symbols of each text in order, found from left to right."""
    t = F.col(text)
    cut = F.split(t, _SYMBOL)
    names = F.regexp_extract_all(t, F.lit(_SYMBOL), F.lit(0))
    rows = docs.where(t.isNotNull()).select(key, names.alias("names"), F.transform(cut, lambda s: F.length(s)).alias("gaps"))
    each = rows.select(key, F.posexplode("names").alias("i", "name"), "gaps", "names")
    begin = F.aggregate(F.slice("gaps", F.lit(1), F.col("i") + 1), F.lit(0), lambda s, x: s + x) + F.aggregate(F.slice("names", F.lit(1), F.col("i")), F.lit(0), lambda s, x: s + F.length(x))
    return each.select(key, "name", begin.alias("begin")).withColumn("end", F.col("begin") + F.length("name"))


def cooccurring(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b, n): pairs of gene symbols, a < b, and the number of sentences that name both."""
    s = docs.where(F.col(text).isNotNull()).select(F.explode(sentences(F.col(text))).alias("s")).select(F.array_sort(F.array_distinct(gene_symbols(F.col("s")))).alias("g")).where(F.size("g") > 1)
    # Pairs of one sentence: bounded by what a sentence names; equal sets are counted before they are unfolded.
    sets = s.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    pairs = sets.select("n", "g", F.posexplode("g").alias("i", "a")).select("n", "a", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def nearest(refs: DataFrame, marks: DataFrame, key: str, reach: int = 200) -> DataFrame:
    """Each reference (key, ref_begin) with the nearest (key, name, begin, end) closer than ``reach``; ties by begin.

    A reference meets only marks of its own and the neighbouring stretches of ``reach`` characters, so a long text
    costs no more than as many short ones.
    """
    r = refs.withColumn("bin", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("ref_begin") / reach) - 1), F.floor(F.col("ref_begin") / reach) + 1)))
    m = marks.withColumn("bin", F.explode(F.sequence(F.floor(F.col("begin") / reach), F.floor(F.col("end") / reach))))
    gap = F.when(F.col("ref_begin") < F.col("begin"), F.col("begin") - F.col("ref_begin")).when(F.col("ref_begin") > F.col("end"), F.col("ref_begin") - F.col("end")).otherwise(0)
    both = r.join(m, [key, "bin"]).withColumn("distance", gap).where(F.col("distance") < reach)
    best = F.row_number().over(W.partitionBy(key, "ref_begin").orderBy("distance", "begin", "name"))
    return both.withColumn("rn", best).where("rn = 1").select(key, "ref_begin", "name", "distance")


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int = 64) -> DataFrame:
    """(key, a_begin, a_end, b_begin, b_end) spans that share a character, met in stretches of ``width``."""
    cells = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / width), F.floor((F.greatest(F.col(y), F.col(x) + 1) - 1) / width)))
    left = a.withColumn("cell", cells("a_begin", "a_end"))
    right = b.withColumn("cell", cells("b_begin", "b_end"))
    hit = left.join(right, [key, "cell"]).where("a_begin < b_end and b_begin < a_end")
    # One pair meets in each shared stretch; it counts in the first of them.
    return hit.where(F.col("cell") == F.floor(F.greatest("a_begin", "b_begin") / width)).drop("cell")
