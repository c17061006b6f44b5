"""Entity resolution: all similar pairs of a kind in blocks, greedy groups by first entry, endpoint rewriting."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphloom.functions.python import close_pairs, entity_form_udf, similar_pairs
from graphloom.session import cut, shuffle_width

BLOCK = 1024


def close_names(asked: DataFrame, names: DataFrame, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(asked, name, similarity): distinct names(x) within a share of edits of distinct ``asked(x)``, other than itself.

    Names of a length meet the asked ones that it is in reach of; both are cut into blocks by hash, so that a task holds
    a bounded number of pairs. Names built on one pattern share most of their letters and are close in masses: pairs are
    weighed as matrices, and each is compared once. None is lost.
    """
    share = 1 - least
    count = lambda df, name: df.groupBy("n").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    n = cut(names.select("x", F.length("x").alias("n")).where("n > 0"))
    reach = F.sequence(F.ceil(least * F.length("x") - 1e-9).cast("int"), F.floor(F.length("x") / least + 1e-9).cast("int"))
    q = cut(asked.where("x <> ''").select("x", F.explode(reach).alias("n")).join(F.broadcast(count(n, "nb")), "n"))
    blocks = cut(count(q, "nq").join(count(n, "nb"), "n"))
    groups = blocks.agg(F.sum(F.col("nq").cast("bigint") * F.col("nb"))).first()[0] or 1
    q = q.drop("nb")
    own = lambda parts: F.pmod(F.xxhash64("x"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = q.join(F.broadcast(blocks), "n").select("n", own("nq").alias("i"), each("nb").alias("j"), "x", F.lit(True).alias("q"))
    right = n.join(F.broadcast(blocks), "n").select("n", each("nq").alias("i"), own("nb").alias("j"), "x", F.lit(False).alias("q"))
    parts = max(shuffle_width(names.sparkSession), int(groups) // 16)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows.x[rows.q].to_numpy(), rows.x[~rows.q].to_numpy()
        if not len(x) or not len(y):
            return pd.DataFrame(columns=["asked", "name", "edits"])
        p, r, edits = close_pairs(list(x), list(y), share)
        return pd.DataFrame({"asked": x[p], "name": y[r], "edits": edits})[edits != 0]

    met = left.unionByName(right).repartition(parts, "n", "i", "j").groupBy("n", "i", "j").applyInPandas(meet, "asked string, name string, edits int")
    most = F.greatest(F.length("asked"), F.length("name"))
    edits = F.when(F.col("edits") < 0, F.levenshtein("asked", "name")).otherwise(F.col("edits"))
    near = met.select("asked", "name", edits.alias("edits"), most.alias("most")).where("asked <> name").where(F.col("edits") <= share * F.col("most") + 1e-9)
    return near.select("asked", "name", (1 - F.col("edits") / F.col("most")).alias("similarity"))


def candidates(entities: DataFrame, threshold: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(kind, a, b, sa, sb, similarity): all pairs of different forms of a kind, a before b by (seq, form), of
    similarity >= ``threshold``.

    ``entities(form, kind, seq)`` has one row a distinct form and kind, so copies never pair with each other. The forms
    of a kind are cut into blocks by hash and each pair of blocks meets in one task: blocks are bounded whatever a kind
    holds, and an upper bound of the similarity drops pairs before the exact test.
    """
    e = cut(entities.where("kind is not null").select("kind", "form", "seq"))
    blocks = e.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb"))
    groups = blocks.agg(F.sum(F.col("nb").cast("bigint") * (F.col("nb") + 1) / 2)).first()[0] or 1
    mine = e.join(F.broadcast(blocks), "kind").withColumn("own", F.pmod(F.xxhash64("form"), F.col("nb")).cast("int"))
    other = mine.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    met = other.select("kind", "form", "seq", "own", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))
    parts = max(shuffle_width(entities.sparkSession), int(groups) // 16)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[rows.own == rows.i.iloc[0]], rows[rows.own == rows.j.iloc[0]]
        if x.empty or y.empty:
            return pd.DataFrame({"kind": [], "a": [], "b": [], "sa": [], "sb": [], "similarity": []})
        p, q, score = similar_pairs(list(x.form), list(y.form), threshold)
        a, b = x.take(p), y.take(q)
        got = pd.DataFrame({"kind": rows.kind.iloc[0], "a": a.form.to_numpy(), "b": b.form.to_numpy(), "sa": a.seq.to_numpy(), "sb": b.seq.to_numpy(), "similarity": score})
        before = (got.sa < got.sb) | ((got.sa == got.sb) & (got.a < got.b))
        if rows.i.iloc[0] == rows.j.iloc[0]:
            return got[before]
        turned = got[~before].rename(columns={"a": "b", "b": "a", "sa": "sb", "sb": "sa"})
        return pd.concat([got[before], turned[got.columns]])

    kind = e.schema["seq"].dataType.simpleString()
    return met.repartition(parts, "kind", "i", "j").groupBy("kind", "i", "j").applyInPandas(meet, f"kind string, a string, b string, sa {kind}, sb {kind}, similarity double")


def links(pairs: DataFrame) -> DataFrame:
    """(kind, form, n_links, nearest, similarity) of ``pairs(kind, a, b, similarity)``: one row a form with a link."""
    both = pairs.select("kind", F.col("a").alias("form"), F.col("b").alias("other"), "similarity").unionByName(pairs.select("kind", F.col("b").alias("form"), F.col("a").alias("other"), "similarity"))
    m = both.groupBy("kind", "form").agg(F.count(F.lit(1)).alias("n_links"), F.min(F.struct((-F.col("similarity")).alias("s"), "other")).alias("m"))
    return m.select("kind", "form", "n_links", F.col("m.other").alias("nearest"), (-F.col("m.s")).alias("similarity"))


def alike(nodes: DataFrame, asked: DataFrame, threshold: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(seed, id, similarity): nodes of a seed's kind whose names are similar to its name; a stated set against all, in blocks."""
    named = cut(nodes.where("name is not null").withColumn("form", entity_form_udf("name")).where("form <> ''").select("id", "kind", "form"))
    mine = cut(asked.select(F.col("id").alias("seed")).distinct().join(named.withColumnRenamed("id", "seed"), "seed"))
    forms = named.groupBy("kind", "form").agg(F.count(F.lit(1)).alias("n"))
    blocks = cut(forms.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb")))
    left = mine.select("kind", "form").distinct().join(F.broadcast(blocks), "kind").select("kind", "form", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"))
    right = cut(forms.join(F.broadcast(blocks), "kind").select("kind", "form", F.pmod(F.xxhash64("form"), F.col("nb")).cast("int").alias("b")))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame(columns=["kind", "a", "form", "similarity"])
        p, q, score = similar_pairs(list(x.form), list(y.form), threshold)
        a, b = list(x.form), list(y.form)
        return pd.DataFrame([(x.kind.iloc[0], a[i], b[j], s) for i, j, s in zip(p, q, score)], columns=["kind", "a", "form", "similarity"])

    pairs = left.groupBy("kind", "b").cogroup(right.groupBy("kind", "b")).applyInPandas(meet, "kind string, a string, form string, similarity double")
    return pairs.join(mine.select("seed", "kind", F.col("form").alias("a")), ["kind", "a"]).join(named, ["kind", "form"]).select("seed", "id", "similarity")


def distinct_forms(nodes: DataFrame) -> DataFrame:
    """(form, kind, seq, n): one row a comparable name of a kind; seq is the first entry."""
    forms = nodes.where("name is not null").withColumn("form", entity_form_udf("name")).where("form <> ''")
    return forms.groupBy("form", "kind").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))


#: Names that are related but distinct, never merged.
BLOCKED = (("cancer", "tumor"), ("neoplasm", "tumor"), ("mapk", "mapk1"), ("mapk", "mapk3"), ("her2", "erbb2"))


def unblocked(pairs: DataFrame, blocked: tuple[tuple[str, str], ...] = BLOCKED) -> DataFrame:
    """Pairs (a, b) that are not blocked in either order."""
    both = sorted({p for a, b in blocked for p in ((a, b), (b, a))})
    held = F.lit(False)
    for a, b in both:
        held = held | ((F.col("a") == a) & (F.col("b") == b))
    return pairs.where(~held)


def representatives(members: DataFrame, degrees: DataFrame) -> DataFrame:
    """(id, to) of ``members(id, group, seq)``: each group is represented by its best connected member, the first of equals."""
    rows = members.join(degrees.select("id", "degree"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = rows.groupBy("group").agg(F.min_by("id", F.struct(-F.col("degree"), "seq")).alias("to"))
    return rows.join(best, "group").select("id", "to")


def resolve_graph(nodes: DataFrame, edges: DataFrame, degrees: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, mapping): similar names of one kind and name space merged, edges led to the representatives.

    The name space is the part of a key before ``::``; nodes without a name stay as they are.
    """
    space = F.concat_ws("\u0001", "kind", F.when(F.col("id").contains("::"), F.substring_index("id", "::", 1)))
    named = cut(nodes.where("name is not null").select("id", "name", "seq", space.alias("kind")).withColumn("form", entity_form_udf("name")).where("form <> ''"))
    forms = cut(named.groupBy("form", "kind").agg(F.min("seq").alias("seq")))
    leaders = star_groups(forms, unblocked(candidates(forms, threshold)))
    members = named.join(leaders, ["form", "kind"]).select("id", "seq", F.concat_ws("\u0001", "kind", "leader").alias("group"))
    mapping = cut(representatives(members, degrees))
    kept = nodes.join(mapping.where("id <> to").select("id"), "id", "left_anti")
    return kept, redirect(edges, mapping), mapping


def star_groups(forms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(form, kind, leader): in order of entry, each form joins the earliest leader it is similar to, or else leads.

    Not transitive. Rounds settle all forms whose earlier neighbours are settled, until no form is open.
    """
    keys = ["kind", "form"]
    pairs = cut(pairs.select("kind", "a", "b", "sa"))
    of = lambda df, side: df.select("kind", F.col(side).alias("form"))
    waiting, links, leads = cut(forms.where("kind is not null").select(*keys)), pairs, []
    while not waiting.isEmpty():
        leads.append(cut(waiting.join(of(links, "b"), keys, "left_anti")))
        led = of(links.join(leads[-1].withColumnRenamed("form", "a"), ["kind", "a"], "left_semi"), "b")
        waiting = cut(waiting.join(leads[-1], keys, "left_anti").join(led, keys, "left_anti"))
        still = lambda side: waiting.withColumnRenamed("form", side)
        links = cut(links.join(still("a"), ["kind", "a"], "left_semi").join(still("b"), ["kind", "b"], "left_semi"))
    if not leads:
        return forms.select("form", "kind", F.col("form").alias("leader"))
    leaders = reduce(DataFrame.unionByName, leads).withColumnRenamed("form", "a")
    first = pairs.join(leaders, ["kind", "a"], "left_semi").groupBy("kind", F.col("b").alias("form")).agg(F.min(F.struct("sa", "a")).alias("m"))
    return forms.select("form", "kind").join(first, keys, "left").select("form", "kind", F.coalesce("m.a", "form").alias("leader"))


def redirect(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with endpoints rewritten by ``mapping(id, to)``; self-loops that this makes and duplicates are dropped."""
    s, t = mapping.select(F.col("id").alias("src"), F.col("to").alias("s")), mapping.select(F.col("id").alias("dst"), F.col("to").alias("t"))
    e = edges.join(s, "src", "left").join(t, "dst", "left")
    moved = e.select(F.coalesce("s", "src").alias("src"), "metaedge", F.coalesce("t", "dst").alias("dst"), "weight", "seq", (F.col("src") == F.col("dst")).alias("loop"))
    kept = moved.where((F.col("src") != F.col("dst")) | F.col("loop"))
    return kept.groupBy("src", "metaedge", "dst").agg(F.max("weight").alias("weight"), F.min("seq").alias("seq"))
