"""Queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm.chunking import items, read_limits, split
from graphloom.llm.language import Profiles, fit, identify
from graphloom.llm.lookalikes import Survey, consistent, inconsistent_rows
from graphloom.llm.mixing import Mixture
from graphloom.llm.mojibake import repair_corpus
from graphloom.llm.tokenizer import encode_corpus
from graphloom.queries.base import Registry
from graphloom.session import table

R = Registry()


def _pieces(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    limits = read_limits(table(spark, d, "chunk_limits"))
    return split(items(table(spark, d, "wiki_pages"), "page_id"), limits, with_text).withColumnRenamed("key", "page_id")


@R.add(
    "p1_found",
    """WITH items AS (
      SELECT page_id, 0 AS item_no, text FROM wiki_pages
      UNION ALL SELECT page_id, CAST(k AS INTEGER), sections[k].text FROM (SELECT page_id, sections, unnest(range(1, len(sections) + 1)) AS k FROM wiki_pages))
    SELECT page_id, CAST(item_no AS INTEGER) AS item_no FROM items
    WHERE length(text) > (SELECT max_chars FROM chunk_limits WHERE item = CASE WHEN item_no = 0 THEN 'text' ELSE 'section' END)""",
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, False).where("piece_no = 0 and n_pieces > 1").select("page_id", "item_no")


@R.add("p1_pieces")
def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, True)


def _profiles(spark: SparkSession, d: str) -> Profiles:
    return fit(table(spark, d, "wiki_pages"), "page_id", "text", "lang")


def _identified(spark: SparkSession, d: str) -> DataFrame:
    return identify(table(spark, d, "wiki_pages"), "page_id", "text", "lang", _profiles(spark, d)).withColumnRenamed("key", "page_id")


@R.add("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    case = F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang")) | (F.size("held") > 1)
    return _identified(spark, d).where(F.col("lang").isNotNull() & case).select("page_id", F.explode("held").alias("lang"))


@R.add("p5_pages")
def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    return _identified(spark, d).select("page_id", "label_lang", "lang", "confidence", F.array_join("held", " ").alias("held"))


@R.add("p5_segments")
def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    return _identified(spark, d).select("page_id", F.posexplode("segments").alias("segment_no", "s")).select("page_id", "segment_no", "s.*")


def _surveys(spark: SparkSession, d: str) -> dict[str, Survey]:
    return {"graph_nodes": Survey(table(spark, d, "graph_nodes"), "node_row", "name", names=True), "wiki_pages": Survey(table(spark, d, "wiki_pages"), "page_id", "text")}


@R.add("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return inconsistent_rows(_surveys(spark, d)).withColumnRenamed("key", "row_id")


@R.add("p4_names")
def p4_names(spark: SparkSession, d: str) -> DataFrame:
    s = _surveys(spark, d)
    return consistent(s["graph_nodes"], [s["wiki_pages"]]).select(F.col("key").alias("node_row"), F.col("text").alias("name"), "changed")


@R.add("p4_texts")
def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    s = _surveys(spark, d)
    return consistent(s["wiki_pages"], [s["graph_nodes"]]).select(F.col("key").alias("page_id"), "text", "changed")


@R.add("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), ["doc_id"])


@R.add("p8_mixture")
def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).rows


@R.add("p8_report")
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).report()


@R.add("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repair_corpus(table(spark, d, "documents"), "doc_id").where("garbled").select("doc_id")


@R.add("p9_restored")
def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return repair_corpus(table(spark, d, "documents"), "doc_id").where("garbled").select("doc_id", F.col("restored").alias("text"), "layers")
