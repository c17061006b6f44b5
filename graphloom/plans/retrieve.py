"""Retrieval methods by name: each takes the graph, seed nodes and a question and gives (id, depth, score) hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions.text import jaccard, words
from graphloom.model import PropertyGraph, depth_penalty
from graphloom.operators import analytics as A, rank as K, resolve as Z, scores as C, stats as S, traverse as T
from graphloom.operators.expand import expand, neighbors
from graphloom.plans import intent as I
from graphloom.session import cut

#: Limits of the presets (nodes, edges, depth, paths).
PRESETS = {"fast": (5, 10, 2, 3), "balanced": (10, 20, 3, 5), "comprehensive": (20, 40, 4, 10), "research": (30, 60, 5, 15)}

Method = Callable[[PropertyGraph, DataFrame, str], DataFrame]
METHODS: dict[str, Method] = {}


def method(*names: str) -> Callable[[Method], Method]:
    """Register a retrieval method under its names."""

    def keep(f: Method) -> Method:
        METHODS.update(dict.fromkeys(names, f))
        return f

    return keep


def _by_depth(hits: DataFrame) -> DataFrame:
    return hits.select("id", "depth", (1.0 / (F.col("depth") + 1)).alias("score"))


def _several(seeds: DataFrame) -> bool:
    return seeds.select("id").distinct().limit(2).count() > 1


@method("bfs")
def bfs(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    return _by_depth(T.bfs(g.edges, seeds, 2))


@method("dfs")
def dfs(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    return _by_depth(T.dfs(g.edges, seeds, 2).groupBy("id").agg(F.min("depth").alias("depth")))


@method("shortest_path")
def shortest_path(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    """Nodes on all shortest paths between two seeds, by their place on them; one seed alone is spread from."""
    if not _several(seeds):
        return bfs(g, seeds)
    s = seeds.select(F.col("id").alias("s"), F.lit(1).alias("k"))
    pairs = s.join(s.withColumnRenamed("s", "t"), "k").where("s < t").select("s", "t")  # of the seeds of one question
    paths = T.shortest_paths(g.edges, pairs, 3, "both")
    return _by_depth(paths.select(F.posexplode("path").alias("depth", "id")).groupBy("id").agg(F.min("depth").alias("depth")))


@method("neighbors")
def near(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    return _by_depth(neighbors(g, seeds).where("src <> id").select("id").distinct().withColumn("depth", F.lit(1)))


@method("hybrid")
def hybrid(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    """The least depth over the walks from all seeds."""
    return _by_depth(T.seeded_bfs(g.edges, seeds, 2).groupBy("id").agg(F.min("depth").alias("depth")))


def parts(g: PropertyGraph, seeds: DataFrame) -> dict[str, DataFrame]:
    """Hits of the methods that are merged."""
    return {"BFS": cut(bfs(g, seeds)), "DFS": cut(dfs(g, seeds)), "NEIGHBORS": near(g, seeds)}


@method("multi_method")
def multi_method(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    return K.merge_methods(parts(g, seeds)).select("id", "depth", F.col("score").cast("double").alias("score"))


@method("ensemble")
def ensemble(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    return K.ensemble(parts(g, seeds)).select("id", F.lit(None).cast("int").alias("depth"), "score")


def adaptive_hits(g: PropertyGraph, seeds: DataFrame) -> DataFrame:
    """(id, method, depth, score): each seed is walked as its kind asks; the last method that found a node names it."""
    kinds = cut(seeds.select("id").distinct().join(g.nodes.select("id", "kind"), "id"))
    plan = F.when(F.col("kind").isin("Gene", "Disease"), F.array(F.lit("BFS"))).when(F.col("kind") == "Compound", F.array(F.lit("DFS")))
    plan = plan.when(F.col("kind").isin("Biological Process", "Pathway"), F.array(F.lit("BFS"), F.lit("DFS"))).otherwise(F.array(F.lit("Hybrid")))
    asked = kinds.select(F.col("id").alias("seed"), F.posexplode(plan).alias("step", "method"))
    wide = T.seeded_bfs(g.edges, kinds, 2).select("seed", "id", "depth")
    deep = T.dfs(g.edges, kinds, 2).select(F.col("start").alias("seed"), "id", "depth")
    rows = asked.where("method <> 'DFS'").join(wide, "seed").unionByName(asked.where("method = 'DFS'").join(deep, "seed"))
    return K.adaptive(rows.withColumn("ord", F.struct("seed", "step")))


@method("adaptive")
def adaptive(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    return adaptive_hits(g, seeds).select("id", "depth", "score")


@method("intelligent", "semantic_similarity")
def intelligent(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    return expand(g, seeds, orientation="both").select("id", "depth", "score")


def path_hits(g: PropertyGraph, seeds: DataFrame, plan: dict) -> DataFrame:
    """Ranked paths (start, end, path, metas, hops, score) that a question's plan allows."""
    paths = T.simple_paths(g.edges, seeds, plan["hops"], "both", allow=plan["allow"], deny=plan["deny"])
    if plan["end_kinds"]:
        paths = paths.join(g.nodes.where(F.col("kind").isin(plan["end_kinds"])).select(F.col("id").alias("end")), "end", "left_semi")
    paths = cut(paths)
    if plan["required"]:
        codes, kind = plan["required"]
        step = paths.select("path", F.explode(C.path_edges(F.col("path"), F.col("metas"))).alias("e")).where(F.col("e.metaedge").isin(list(codes)))
        ends = step.select("path", F.explode(F.array("e.src", "e.dst")).alias("id")).join(g.nodes.where(F.col("kind") == kind).select("id"), "id", "left_semi").select("path").distinct()
        paths = cut(paths.join(ends, "path", "left_semi"))
    match = F.arrays_overlap("metas", F.array(*[F.lit(m) for m in plan["match"]])).cast("double") if plan["match"] else F.lit(0.0)
    return K.rank_paths(paths, plan["allow"], g.nodes, g.edges, S.degrees(g.edges), match)


@method("kg_search")
def kg_search(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    """Traceable paths by the question's plan, or by its fallback where it finds none: the best path to each end."""
    plan = I.schema_plan(question)
    hits = cut(path_hits(g, seeds, plan))
    if hits.isEmpty() and (other := I.fallback_plan(plan)):
        hits = path_hits(g, seeds, other)
    return hits.groupBy(F.col("end").alias("id")).agg(F.min("hops").alias("depth"), F.max("score").alias("score"))


@method("n_hop")
def n_hop(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    paths = T.simple_paths(g.edges, seeds, 2, deny=["DrD", "CrC"])
    return _by_depth(paths.groupBy(F.col("end").alias("id")).agg(F.min("hops").alias("depth")))


@method("pagerank")
def pagerank(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    near_ = T.bfs(g.edges, seeds, 2, "both")
    return A.pagerank(g.nodes, g.edges, 5).join(near_, "id").select("id", "depth", F.col("rank").alias("score"))


@method("community_detection")
def community(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    labels = A.label_propagation(g.nodes, g.edges, 5)
    mine = labels.join(seeds.select("id"), "id", "left_semi").select("label").distinct()
    members = labels.join(mine, "label", "left_semi").join(S.degrees(g.edges), "id", "left")
    return members.select("id", F.lit(None).cast("int").alias("depth"), F.coalesce("degree", F.lit(0)).cast("double").alias("score"))


@method("entity_resolution")
def entity_resolution(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    """Nodes whose names are those of the seeds in another form."""
    same = Z.alike(g.nodes, seeds)
    return same.groupBy("id").agg(F.min(F.when(F.col("id") == F.col("seed"), 0).otherwise(1)).alias("depth"), F.max("similarity").alias("score"))


@method("hybrid_new")
def hybrid_new(g: PropertyGraph, seeds: DataFrame, question: str = "", k: int = 20) -> DataFrame:
    """Seeds first, then neighbours, paths and the third of the answer that ranks best in the graph."""
    core = seeds.select("id", F.lit(0).alias("depth"), F.lit(120.0).alias("score"))
    top = A.pagerank(g.nodes, g.edges, 10).orderBy(F.desc(F.round("rank", 12)), "id").limit(k // 3).select("id", F.lit(0).alias("depth"), F.col("rank").alias("score"))
    both = core.unionByName(intelligent(g, seeds)).unionByName(n_hop(g, seeds)).unionByName(top)
    return both.groupBy("id").agg(F.min_by("depth", F.struct(-F.col("score"), "depth")).alias("depth"), F.max("score").alias("score"))


@method("no_retrieval")
def nothing(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    return seeds.select("id", F.lit(0).alias("depth"), F.lit(0.0).alias("score")).where("false")


@method("dijkstra")
def dijkstra(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    """Nodes by the weight of the best path to them: an edge costs 2 less its weight."""
    d = T.weighted_distances(g.edges.select("src", "dst", (2.0 - F.col("weight")).alias("cost")), seeds, 3)
    return d.select("id", "depth", (1.0 / (1.0 + F.col("cost"))).alias("score"))


@method("limited_bfs")
def limited_bfs(g: PropertyGraph, seeds: DataFrame, question: str = "", max_nodes: int = 20) -> DataFrame:
    """A walk from all seeds that ends with the first ``max_nodes`` nodes."""
    return _by_depth(T.bfs(g.edges, seeds, 3, max_nodes=max_nodes))


@method("word_similarity")
def word_similarity(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    """Names by the words they share with the question."""
    asked = F.array(*[F.lit(w) for w in sorted({w for w in "".join(c if c.isascii() and (c.isalnum() or c.isspace()) else "" for c in question.lower()).split()})]).cast("array<string>")
    return g.nodes.where("name is not null").select("id", F.lit(None).cast("int").alias("depth"), jaccard(words(F.col("name")), asked).alias("score")).where("score > 0")


@method("enhanced_n_hop")
def enhanced_n_hop(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    """Ends of all simple paths, seeds included, ranked by kind, neighbours and centrality."""
    paths = T.simple_paths(g.edges, seeds, 2).select(F.col("end").alias("id"), F.col("hops").alias("depth"))
    hits = paths.unionByName(seeds.select("id", F.lit(0).alias("depth"))).groupBy("id").agg(F.min("depth").alias("depth"))
    nb = g.edges.where("src <> dst").select(F.col("src").alias("id"), "dst").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("nb"))
    rows = hits.join(g.nodes.select("id", "kind"), "id").join(nb, "id", "left").join(A.degree_centrality(g.nodes, g.edges), "id")
    return rows.select("id", "depth", C.rank_node(F.col("kind") == "Gene", F.coalesce("nb", F.lit(0)), F.col("centrality")).alias("score"))


def near_genes(g: PropertyGraph, seeds: DataFrame) -> DataFrame:
    """(id): seeds that are genes and genes next to a seed."""
    return T.bfs(g.edges, seeds, 1, "both").select("id").join(g.nodes.where("kind = 'Gene'").select("id"), "id", "left_semi")


@method("targeted_pagerank")
def targeted_pagerank(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    """Genes ranked within the graph of genes."""
    genes = g.nodes.where("kind = 'Gene'").select("id")
    inner = g.edges.join(genes.withColumnRenamed("id", "src"), "src", "left_semi").join(genes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return A.pagerank(genes, inner, 10).select("id", F.lit(None).cast("int").alias("depth"), F.col("rank").alias("score"))


def _linked(g: PropertyGraph, genes: DataFrame, codes: tuple[str, ...], kind: str) -> DataFrame:
    """(id, gene): nodes of a kind that edges of some metaedges join with the genes, either way."""
    e = g.edges.where(F.col("metaedge").isin(*codes) & (F.col("src") != F.col("dst")))
    both = e.select(F.col("src").alias("gene"), F.col("dst").alias("id")).unionByName(e.select(F.col("dst").alias("gene"), F.col("src").alias("id")))
    hit = both.join(genes.withColumnRenamed("id", "gene"), "gene", "left_semi").distinct()
    return hit.join(g.nodes.where(F.col("kind") == kind).select("id"), "id", "left_semi")


def _counted(hits: DataFrame) -> DataFrame:
    return hits.groupBy("id").agg(F.lit(2).alias("depth"), F.count(F.lit(1)).cast("double").alias("score"))


@method("group_based")
def group_based(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    """Genes by the number of processes that they share with another gene near the seeds."""
    member = cut(_linked(g, near_genes(g, seeds), ("GpBP",), "Biological Process"))
    shared = member.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    return _counted(member.join(shared, "id", "left_semi").select(F.col("gene").alias("id")))


@method("biological_pathway")
def biological_pathway(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    """Pathways by the number of genes near the seeds that take part in them."""
    return _counted(_linked(g, near_genes(g, seeds), ("GpPW",), "Pathway"))


@method("gene_cluster")
def gene_cluster(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    """Genes by the number of genes near the seeds that they interact, vary or are regulated with."""
    return _counted(_linked(g, near_genes(g, seeds), ("GiG", "GcG", "Gr>G"), "Gene"))


@method("disease_gene_network")
def disease_gene_network(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    """Diseases by the number of genes near the seeds that they are joined with."""
    return _counted(_linked(g, near_genes(g, seeds), ("DaG", "DuG", "DdG"), "Disease"))


@method("neighbors_enhanced")
def neighbors_enhanced(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    """Neighbours by the summed weight of the edges that lead to them."""
    e = g.edges.join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi").where("src <> dst")
    return e.groupBy(F.col("dst").alias("id")).agg(F.lit(1).alias("depth"), F.sum("weight").alias("score"))


@method("shortest_path_enhanced")
def shortest_path_enhanced(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    """Nodes of shortest paths between genes near the seeds, by how many of the paths hold them."""
    s = near_genes(g, seeds).orderBy("id").limit(5).select(F.col("id").alias("s"), F.lit(1).alias("k"))
    pairs = s.join(s.withColumnRenamed("s", "t"), "k").where("s < t").select("s", "t")  # of five genes
    paths = T.shortest_paths(g.edges, pairs, 3, "both")
    return paths.select(F.explode("path").alias("id")).groupBy("id").agg(F.lit(None).cast("int").alias("depth"), F.count(F.lit(1)).cast("double").alias("score"))


@method("targeted")
def targeted(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    """Hits over the metaedges of the question's rule, directly and one step farther."""
    codes = next((list(ms) for _, ps, ms in I.RULES if any(p in question.lower() for p in ps)), None)
    first = cut(expand(g, seeds, codes, "both").select("id", "depth", "score"))
    second = expand(g, first, codes, "both").select("id", F.lit(2).alias("depth"), (F.col("score") * depth_penalty(F.lit(2)) / depth_penalty(F.lit(1))).alias("score"))
    both = first.unionByName(second)
    return both.groupBy("id").agg(F.min("depth").alias("depth"), F.max("score").alias("score"))


@method("hybrid_enhanced")
def hybrid_enhanced(g: PropertyGraph, seeds: DataFrame, question: str = "") -> DataFrame:
    """Three sources united; each node scores by the source's bonus and what it measured, the best counting."""
    none = F.lit(None).cast("double")
    wide = hybrid(g, seeds).select("id", F.lit("hybrid").alias("source"), none.alias("pr"), none.alias("sim"))
    ranked = A.pagerank(g.nodes, g.edges, 5).orderBy(F.desc(F.round("rank", 12)), "id").limit(20).select("id", F.lit("pagerank").alias("source"), F.col("rank").alias("pr"), none.alias("sim"))
    named = word_similarity(g, seeds, question).select("id", F.lit("semantic").alias("source"), none.alias("pr"), F.col("score").alias("sim"))
    rows = wide.unionByName(ranked).unionByName(named)
    return rows.groupBy("id").agg(F.lit(None).cast("int").alias("depth"), F.max(C.hybrid_score(F.col("source"), F.col("pr"), F.col("sim"))).alias("score"))


def retrieve(name: str, g: PropertyGraph, seeds: DataFrame, k: int = 10, question: str = "") -> DataFrame:
    """The ``k`` best hits of a method with names and kinds."""
    if name not in METHODS:
        raise ValueError(f"method {name!r} is none of {', '.join(sorted(METHODS))}")
    if not 1 <= k <= 10_000:
        raise ValueError(f"k = {k} is not within 1 to 10000")
    hits = METHODS[name](g, seeds, question).withColumn("score", F.round("score", 6))
    return hits.orderBy(F.desc("score"), "id").limit(k).join(g.nodes.select("id", "name", "kind"), "id").select("id", "name", "kind", "depth", "score")


def catalog(spark: SparkSession) -> DataFrame:
    """(kind, name, value): methods, presets, question types and kinds of answers, for discovery."""
    rows = [("method", m, "") for m in METHODS] + [("preset", p, "/".join(map(str, v))) for p, v in PRESETS.items()]
    rows += [("question", n, " ".join(ms)) for n, _, ms in I.RULES] + [("answer", n, " ".join(ws)) for n, ws in I.ANSWER_TYPES]
    return spark.createDataFrame(sorted(rows), "kind string, name string, value string")
