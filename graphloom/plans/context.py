"""Retrieved edges rendered as text: one context a node, of a bounded number of sentences, in several styles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.operators.expand import capped

#: Styles: (head, line, glue, metaedges of the lines or all). A line may use {s} for the sentence, {m} for the metaedge
#: and {i} for its number; a head may use {k} for the node.
STYLES = {
    "simple": ("", "{s}.", " ", None),
    "compact": ("", "{s}", "; ", None),
    "scientific": ("", "{s} [{m}].", " ", None),
    "stepwise": ("", "- {s}", "\n", None),
    "numbered": ("Steps for {k}:\n", "{i}. {s}.", "\n", None),
    "narrative": ("About {k}: ", "{s}", ", and ", None),
    "data_driven": ("{k}\n", "{m}\t{s}", "\n", None),
    "pathway": ("Pathways and processes of {k}: ", "{s}", "; ", ("GpPW", "GpBP", "GpMF", "GpCC")),
    "clinical": ("Clinical notes on {k}: ", "{s}.", " ", ("CtD", "CpD", "DpS", "DlA", "CcSE")),
    "mechanistic": ("Mechanisms of {k}: ", "{s}", " -> ", ("CbG", "CuG", "CdG", "GiG", "Gr>G", "GcG")),
}
#: Phrase of an answer by metaedge.
ANSWERS = {"CtD": "treats", "CpD": "palliates", "CcSE": "can cause", "DpS": "presents", "DlA": "localizes to", "DaG": "is associated with", "AeG": "expresses", "GpPW": "takes part in", "GpBP": "takes part in", "CbG": "binds"}


def _filled(template: str, **values):
    """A template as a Column."""
    out, rest = [], template
    while rest:
        at = min((rest.find("{" + k + "}"), k) for k in [*values, ""] if k and rest.find("{" + k + "}") >= 0) if any("{" + k + "}" in rest for k in values) else None
        if at is None:
            out.append(F.lit(rest))
            break
        if at[0]:
            out.append(F.lit(rest[: at[0]]))
        out.append(values[at[1]])
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*out) if out else F.lit("")


def render(sentences: DataFrame, key: str, k: int = 5, style: str = "simple") -> DataFrame:
    """(key, context) of ``sentences(key, metaedge, sentence)``: the first ``k`` of each node in order."""
    if style not in STYLES:
        raise ValueError(f"style {style!r} is none of {', '.join(STYLES)}")
    head, line, glue, codes = STYLES[style]
    rows = sentences if codes is None else sentences.where(F.col("metaedge").isin(*codes))
    first = capped(rows, [key], ["metaedge", "sentence"], k)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("metaedge", "sentence"))), lambda x, i: _filled(line, s=x["sentence"], m=x["metaedge"], i=(i + 1).cast("string")))
    return first.groupBy(key).agg(F.array_join(lines, glue).alias("lines")).select(key, F.concat(_filled(head, k=F.col(key)), "lines").alias("context"))


def answers(edges: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    """(id, metaedge, answer): a sentence for each node and metaedge with a phrase, naming up to ``k`` of its ends in order."""
    n = nodes.select("id", F.coalesce("name", "id").alias("n"))
    e = edges.where(F.col("metaedge").isin(*ANSWERS)).select("src", "metaedge", "dst").join(n.select(F.col("id").alias("dst"), F.col("n").alias("end")), "dst")
    top = capped(e, ["src", "metaedge"], ["end", "dst"], k).groupBy("src", "metaedge").agg(F.array_sort(F.collect_list(F.struct("end", "dst"))).alias("t"))
    phrase = F.create_map(*[x for m, p in ANSWERS.items() for x in (F.lit(m), F.lit(p))])[F.col("metaedge")]
    named = F.array_join(F.transform("t", lambda x: x["end"]), ", ")
    return top.join(n.withColumnRenamed("id", "src"), "src").select(F.col("src").alias("id"), "metaedge", F.concat("n", F.lit(" "), phrase, F.lit(" "), named, F.lit(".")).alias("answer"))


def line_counts(contexts: DataFrame, key: str, words: list[str]) -> DataFrame:
    """(key, word, n): lines of each context that hold a word."""
    lines = contexts.select(key, F.explode(F.split("context", "\n")).alias("line"))
    each = lines.select(key, "line", F.explode(F.array(*[F.lit(w) for w in words])).alias("word"))
    return each.groupBy(key, "word").agg(F.count(F.when(F.contains(F.lower("line"), F.col("word")), 1)).alias("n"))
