"""Tokens of questions bound to nodes, by stages; the first stage that finds a node wins, ties go to the first entry.

Stages: the exact name, the name in another case, all words of the token among the words of the name. Every stage is an
equi-join, on the name, its lower form or the token's rarest word, so no stage compares all tokens with all names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.functions.text import words
from graphloom.session import cut


def match(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """(token, id, stage, seq): the best node of each of ``tokens(token)``."""
    t = tokens.select("token").where("token is not null").distinct()
    n = nodes.where("name is not null").select("id", "name", "seq")
    exact = t.join(n, F.col("token") == F.col("name")).select("token", "id", F.lit(1).alias("stage"), "seq")
    low = t.join(n, F.lower("token") == F.lower("name")).select("token", "id", F.lit(2).alias("stage"), "seq")
    asked = t.select("token", F.array_distinct(words(F.col("token"))).alias("ws")).where("size(ws) > 0")
    index = n.select("id", "seq", F.array_distinct(words(F.col("name"))).alias("nws")).select("id", "seq", "nws", F.explode("nws").alias("w"))
    common = index.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    # A token meets names by its rarest word only; one with a word that no name has meets none.
    rarest = asked.select("token", "ws", F.explode("ws").alias("w")).join(common, "w", "left").groupBy("token", "ws").agg(F.min_by("w", F.struct("df", "w")).alias("w"), F.count(F.when(F.col("df").isNull(), 1)).alias("unknown")).where("unknown = 0")
    held = rarest.join(index, "w").where(F.size(F.array_except("ws", "nws")) == 0).select("token", "id", F.lit(3).alias("stage"), "seq")
    every = exact.unionByName(low).unionByName(held)
    rank = F.row_number().over(W.partitionBy("token").orderBy("stage", "seq", "id"))
    return every.withColumn("rn", rank).where("rn = 1").drop("rn")


#: Words that name a kind; a later kind takes a word from an earlier one.
KIND_TOKENS = {
    "Gene": ("gene", "genes", "protein", "proteins", "dna", "rna", "mrna", "genetic"),
    "Anatomy": ("anatomy", "anatomical", "organ", "organs", "tissue", "tissues", "body", "body part", "heart", "brain", "liver", "lung", "kidney", "stomach", "muscle", "bone", "blood"),
    "Disease": ("disease", "diseases", "disorder", "disorders", "syndrome", "syndromes", "cancer", "cancers", "tumor", "tumors", "malignancy", "malignancies", "diabetes", "alzheimer", "fibrosis", "breast cancer", "lung cancer", "liver cancer", "brain cancer", "blood cancer", "stomach cancer"),
    "Compound": ("compound", "compounds", "drug", "drugs", "medication", "medications", "medicine", "medicines", "chemical", "chemicals", "molecule", "molecules", "aspirin", "ibuprofen", "caffeine", "vitamin"),
    "Biological Process": ("process", "processes", "biological", "mechanism", "apoptosis", "cell cycle", "dna repair"),
    "Pathway": ("pathway", "pathways", "signaling", "metabolic", "cascade", "cascades", "network", "networks"),
    "Symptom": ("symptom", "symptoms", "sign", "signs", "manifestation", "manifestations", "indication", "pain", "fever", "cough", "fatigue"),
    "Side Effect": ("side effect", "side effects", "adverse", "reaction", "reactions", "toxicity", "nausea", "headache", "dizziness"),
    "Molecular Function": ("molecular", "function", "functions", "activity", "activities", "enzymatic", "enzyme", "receptor", "transporter"),
    "Cellular Component": ("cellular", "component", "components", "organelle", "organelles", "structure", "nucleus", "mitochondria", "membrane"),
    "Pharmacologic Class": ("pharmacologic", "pharmacological", "class", "category", "categories", "type", "nsaid", "antibiotic", "antihypertensive"),
}
#: Persian words and the English ones that names hold.
PERSIAN_TOKENS = {
    "سرطان": "cancer", "کبد": "liver", "مغز": "brain", "قلب": "heart", "ریه": "lung", "کلیه": "kidney", "معده": "stomach", "ماهیچه": "muscle", "استخوان": "bone", "خون": "blood",
    "بافت": "tissue", "اندام": "organ", "بدن": "body", "بیماری": "disease", "دارو": "drug", "آسپرین": "aspirin", "ژن": "gene", "پروتئین": "protein", "فرآیند": "process", "آپوپتوز": "apoptosis",
}


def symbol_like(token: Column) -> Column:
    """Whether a token is written like a gene symbol: short, with at least two capitals."""
    return token.rlike("^[A-Za-z0-9-]{2,10}\\z") & (F.length(F.regexp_replace(token, "[^A-Z]", "")) >= 2)


def _grams(c: Column, sizes: Column) -> Column:
    """Distinct substrings of the given sizes."""
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(c, i, n)))))


def _sizes(c: Column) -> Column:
    return F.array(F.least(F.lit(3), F.length(c)))


class _Names:
    """Names by their substrings of up to three characters, so that containment is an equi-join and a check."""

    def __init__(self, nodes: DataFrame) -> None:
        self.names = nodes.where("name is not null and name <> ''").select("id", "seq", "kind", "name", F.lower("name").alias("ln"))
        self.index = self.names.select("id", "seq", "kind", "ln", F.explode(_grams(F.col("ln"), F.array(F.lit(1), F.lit(2), F.lit(3)))).alias("gram"))
        self.common = self.index.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))

    def holders(self, parts: DataFrame) -> DataFrame:
        """(token, id, seq, kind): names that hold every element of ``parts(token, held)``, met by its rarest substring.

        A token one of whose substrings no name has meets none.
        """
        p = parts.where(F.size("held") > 0)
        longest = F.array_max(F.transform("held", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
        grams = p.select("token", "held", longest.alias("w")).select("token", "held", F.explode(_grams(F.col("w"), _sizes(F.col("w")))).alias("gram")).join(self.common, "gram", "left")
        key = grams.groupBy("token", "held").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"), F.count(F.when(F.col("df").isNull(), 1)).alias("none")).where("none = 0")
        met = key.join(self.index, "gram").where(F.forall("held", lambda w: F.col("ln").contains(w)))
        return met.select("token", "id", "seq", "kind")

    def held_by(self, tokens: DataFrame) -> DataFrame:
        """(token, id, seq, kind): names that lie within ``tokens(token, lt)``, met by their own rarest substring."""
        own = self.index.where(F.length("gram") == F.least(F.lit(3), F.length("ln"))).join(self.common, "gram")
        key = own.groupBy("id", "seq", "kind", "ln").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
        asked = tokens.select("token", "lt", F.explode(_grams(F.col("lt"), F.array(F.lit(1), F.lit(2), F.lit(3)))).alias("gram"))
        return asked.join(key, "gram").where(F.col("lt").contains(F.col("ln"))).select("token", "id", "seq", "kind")


def _first(hits: DataFrame, stage: int) -> DataFrame:
    m = hits.groupBy("token").agg(F.min(F.struct("seq", "id")).alias("m"))
    return m.select("token", F.col("m.id").alias("id"), F.lit(stage).alias("stage"), F.col("m.seq").alias("seq"))


def cascade(tokens: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(token, id, stage, seq): the node of each of ``tokens(token)`` by eight stages; the first that finds one counts.

    1 names of ``aliases(token, alias)`` among genes, equal before containing; 2 a name that holds the token, genes only
    where equal if it is written like a symbol; 3 an equal name in another case; 4 any name that holds it; 5 the best
    node of the kind that the token names: share of the name, or 0.5 with a common word, or 0.1; 6 a name that holds all
    its words; 7 a name that holds its English word; 8 a gene whose name holds it or one of its words or lies in it.
    Within a stage the first node by entry counts. No stage looks at a part of the names only.
    """
    t = cut(tokens.select("token").where("token is not null and token <> ''").distinct().withColumn("lt", F.lower("token")))
    n = _Names(cut(nodes))
    open_, found = t, []

    def settle(hits: DataFrame, stage: int) -> None:
        nonlocal open_
        found.append(cut(_first(hits, stage)))
        open_ = open_.join(found[-1], "token", "left_anti")

    genes = n.names.where("kind = 'Gene'")
    if aliases is not None:
        named = open_.join(aliases.select(F.lower("token").alias("lt"), F.lower("alias").alias("alias")), "lt")
        settle(named.join(genes.select("id", "seq", F.col("ln").alias("alias")), "alias"), 1)
        named = named.join(open_.select("token"), "token", "left_semi")
        pairs = n.holders(named.select(F.concat_ws("\u0001", "token", "alias").alias("token"), F.array("alias").alias("held"))).where("kind = 'Gene'")
        settle(pairs.withColumn("token", F.split("token", "\u0001")[0]), 1)
    like = symbol_like(F.col("token"))
    all_holders = cut(n.holders(open_.select("token", F.array("lt").alias("held"))))
    exact = open_.where(like).join(genes.select("id", "seq", F.upper("name").alias("un")), F.upper("token") == F.col("un")).select("token", "id", "seq")
    settle(all_holders.where(~like | (F.col("kind") != "Gene")).select("token", "id", "seq").unionByName(exact), 2)
    settle(open_.where(F.length("token") >= 3).join(n.names.select("id", "seq", "ln"), F.col("lt") == F.col("ln")).select("token", "id", "seq"), 3)
    settle(all_holders.join(open_.where(F.length("token") >= 3).select("token"), "token", "left_semi"), 4)
    kinds = F.create_map(*[x for k, ws in {w: k for k, ws in KIND_TOKENS.items() for w in ws}.items() for x in (F.lit(k), F.lit(ws))])
    asked = F.broadcast(open_.withColumn("kind", F.try_element_at(kinds, F.col("lt"))).where("kind is not null"))  # no more than the words of the table
    held = F.col("ln").contains(F.col("lt"))
    word = F.exists(F.split("lt", " "), lambda w: F.col("ln").contains(w))
    score = F.when(held, F.length("lt") / F.length("ln")).when(word, 0.5).otherwise(0.1)
    best = asked.join(n.names, "kind").groupBy("token").agg(F.max_by(F.struct("id", "seq"), F.struct(F.round(score, 12), -F.col("seq"))).alias("m"))
    settle(best.select("token", "m.id", "m.seq"), 5)
    settle(n.holders(open_.where(F.col("lt").contains(" ")).select("token", F.filter(F.array_distinct(F.split("lt", "[ \\t\\n\\r]+")), lambda w: w != "").alias("held"))), 6)
    english = F.create_map(*[x for a, b in PERSIAN_TOKENS.items() for x in (F.lit(a), F.lit(b))])
    settle(n.holders(open_.withColumn("w", F.try_element_at(english, F.col("token"))).where("w is not null").select("token", F.array("w").alias("held"))), 7)
    long_ = open_.where(F.length("token") >= 3)
    each = long_.select("token", F.explode(F.array_distinct(F.filter(F.split("lt", "[ \\t\\n\\r]+"), lambda w: w != ""))).alias("w"))
    by_word = n.holders(each.select(F.concat_ws("\u0001", "token", "w").alias("token"), F.array("w").alias("held"))).withColumn("token", F.split("token", "\u0001")[0])
    settle(by_word.unionByName(n.held_by(long_)).where("kind = 'Gene'"), 8)
    return reduce(DataFrame.unionByName, found)
