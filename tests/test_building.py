"""Chunkers, references, stores, graph files, communities and entity resolution against plain Python."""

from __future__ import annotations

import random
import re
import xml.etree.ElementTree as ET
from itertools import combinations

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from graphloom.functions.python import _tokens, entity_form, entity_similarity, smart_chunks, wiki_parts, window_chunks
from graphloom.operators import analytics as A, resolve as Z, traverse as T
from graphloom.plans import answer as P, build as B, intent as I, match as Q
from graphloom.sources import graph_files as G, stores as O

EDGE = "src string, dst string, metaedge string, weight double, evidence bigint, seq bigint"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["one", "two.", "three!", "four", "پنج؟", "\n\n"]), max_size=12).map(" ".join), max_size=6).map("\n\n".join), st.integers(2, 12))
def test_chunks_keep_all_words_and_the_limit(text, most):
    words = text.split()
    cut = lambda t: [s for s in (x.strip() for x in re.split(r"(?<=[.!?؟])\s+", t)) if s]
    size = lambda c: sum(map(_tokens, cut(c)))
    smart = smart_chunks(text, most)
    assert " ".join(smart).split() == words and all(size(c) <= most or len(cut(c)) == 1 or _tokens(c) <= most for c in smart)
    windows = window_chunks(text, most, 0.4)
    assert all(size(w) <= most or w in cut(text) for w in windows)
    assert set(" ".join(windows).split()) == set(words)


def test_chunks_of_nothing():
    assert smart_chunks(None, 5) == smart_chunks("  ", 5) == window_chunks("", 5, 0.2) == window_chunks(None, 5, 0.2) == []


def test_references_find_the_nearest_symbol(spark):
    texts = [(1, "ABC1 rose. Then this gene fell, but XYZ2 and that protein stayed."), (2, "the gene alone"), (3, None), (4, "این ژن QQ7 است"), (5, "The GENE TP5")]
    df = spark.createDataFrame(texts, "k int, t string")
    got = sorted((r.k, r.ref, r.name) for r in B.references(df, "k", "t", ("gene", "protein", "ژن")).collect())
    # In capitals the noun is a symbol itself, and the nearest one.
    assert got == [(1, "that protein", "XYZ2"), (1, "this gene", "ABC1"), (4, "این ژن", "QQ7"), (5, "The GENE", "GENE")]
    lists = {(r.k, r.name): r.references for r in B.attached(B.extract("genes", df, "k", "t"), B.references(df, "k", "t", ("gene", "protein")), "k").collect()}
    assert lists[1, "ABC1"] == ["this gene"] and lists[1, "XYZ2"] == ["that protein"] and lists[4, "QQ7"] == []
    with pytest.raises(ValueError):
        B.extract("none", df, "k", "t")


def test_spans_and_overlaps_against_a_pattern(spark):
    from graphloom.operators import extract as E

    rnd = random.Random(6)
    texts = [(i, " ".join(rnd.choice(["AB1", "cell", "X9.", "(QRS)", "ژن", "é", "ABCDEF", "a"]) for _ in range(40))) for i in range(20)]
    df = spark.createDataFrame(texts, "k int, t string")
    want = {(i, m.group(), m.start(), m.end()) for i, t in texts for m in re.finditer(r"(?<![\w])[A-Z][A-Z0-9]+(?![\w])", t)}
    marks = E.spans(df, "k", "t")
    assert {(r.k, r.name, r.begin, r.end) for r in marks.collect()} == want
    refs = spark.createDataFrame([(i, b, b + 7) for i in range(20) for b in range(0, 90, 11)], "k int, a_begin int, a_end int")
    got = E.overlapping(refs, marks.select("k", F.col("begin").alias("b_begin"), F.col("end").alias("b_end")), "k", 8).collect()
    assert sorted((r.k, r.a_begin, r.b_begin) for r in got) == sorted((k, a, b) for k, a, e in ((r.k, r.a_begin, r.a_end) for r in refs.collect()) for i, _, b, f in want if i == k and a < f and b < e)
    near = {(r.k, r.ref_begin): (r.name, r.distance) for r in E.nearest(refs.select("k", F.col("a_begin").alias("ref_begin")), marks, "k", 16).collect()}
    for k in range(20):
        for b in range(0, 90, 11):
            gaps = sorted((max(s - b, b - e, 0), s, n) for i, n, s, e in want if i == k)
            assert near.get((k, b)) == ((gaps[0][2], gaps[0][0]) if gaps and gaps[0][0] < 16 else None)


def test_wiki_parts():
    html = '<table class="infobox x"><tr><th>Gene</th><td>AB <b>1</b></td></tr><tr><td>no</td></tr></table><p>Short.</p><p>A paragraph that is long enough [3] to stay.</p><h2>Role[edit]</h2><ul><li>a list item of some length</li><li>no</li></ul><a href="/wiki/Other_page#s">x</a><a href="/wiki/Other_page">x</a><a href="/wiki/Category:Genes_of_note">c</a><a href="/wiki/File:x.png">f</a><h2>Empty</h2>'
    assert wiki_parts(html) == {"infobox": {"Gene": "AB 1"}, "categories": ["Genes of note"], "links": ["Other page"], "sections": [{"heading": "", "text": "A paragraph that is long enough  to stay."}, {"heading": "Role", "text": "• a list item of some length"}]}
    assert wiki_parts(None) is None and wiki_parts("")["sections"] == []


def test_key_values(spark, tmp_path):
    kv, at = O.KeyValues(spark, str(tmp_path / "kv")), lambda s: F.lit(f"2024-01-01 00:00:{s:02}").cast("timestamp")
    rows = lambda *x: spark.createDataFrame(list(x), "key string, value string")
    read = lambda s: {r.key: r.value for r in kv.live(at(s)).collect()}
    assert read(0) == {}
    kv.set(rows(("a", "1"), ("b", "2"), ("x.c", "3")), at(1))
    kv.set(rows(("a", "9")), at(2), 5)
    assert read(3) == {"a": "9", "b": "2", "x.c": "3"} and read(7) == {"b": "2", "x.c": "3"}
    assert {r.key: r.ttl for r in kv.ttl(at(3)).collect()} == {"a": 4, "b": -1, "x.c": -1}
    kv.expire(rows(("b", "")), at(3), 2)
    kv.delete(rows(("x.c", "")), at(3))
    assert read(4) == {"a": "9", "b": "2"} and read(5) == {"a": "9"}
    assert [r.key for r in kv.keys(at(4), "?").orderBy("key").collect()] == ["a", "b"] and kv.keys(at(4), "a.").count() == 0
    kv.compact(at(4))
    assert read(4) == {"a": "9", "b": "2"}
    kv.flush()
    assert read(4) == {}


def test_saved_graphs_indexes_and_extractions(spark, tmp_path):
    n = spark.createDataFrame([("a", "A & <b>", "Gene", 1), ("b", None, "Gene", 2)], "id string, name string, kind string, seq bigint")
    e = spark.createDataFrame([("a", "b", "GiG", 0.5, 1, 1)], EDGE)
    G.save_graph(n, e, str(tmp_path / "one"))
    assert [x[0] for x in O.list_graphs(spark, str(tmp_path))] == ["one"] and G.load_graph(spark, str(tmp_path / "one"))[1].count() == 1
    assert O.delete_graph(spark, str(tmp_path), "one") and O.list_graphs(spark, str(tmp_path / "none")) == []
    with pytest.raises(ValueError):
        O.delete_graph(spark, str(tmp_path), "../x")
    O.save_index(n, str(tmp_path / "index"), "id")
    assert [r.name for r in O.look_up(spark, str(tmp_path / "index"), "id", "a").collect()] == ["A & <b>"]
    O.save_extracted({"entities": n.select("id", "name")}, str(tmp_path / "x"))
    assert sorted(O.load_extracted(spark, str(tmp_path / "x"), {"entities": "id string, name string"})["entities"].collect()) == sorted(n.select("id", "name").collect(), key=lambda r: r.id)
    for lines in (G.graphml_lines(n, e), G.gexf_lines(n, e)):
        root = ET.fromstring("\n".join(r.line for r in lines.orderBy("part").collect()).split("?>", 1)[1])
        tags = [x.tag.split("}")[1] for x in root.iter()]
        assert tags.count("node") == 2 and tags.count("edge") == 1
    (tmp_path / "g.csv").write_text("a,GiG,b\na,GiG\n")
    assert G.load_graph(spark, str(tmp_path / "g.csv"))[1].count() == 1
    with pytest.raises(ValueError):
        G.load_graph(spark, "x.pkl")


def test_communities_of_two_cliques(spark):
    ids = [f"{s}{i}" for s in "ab" for i in range(6)]
    pairs = [(x, y) for x, y in combinations(ids, 2) if x[0] == y[0]] + [("a0", "b0")]
    e = spark.createDataFrame([(x, y, "GiG", 1.0, 1, i) for i, (x, y) in enumerate(pairs)], EDGE)
    n = spark.createDataFrame([(i,) for i in [*ids, "alone"]], "id string")
    got = {r.id: r.community for r in A.louvain(n, e, levels=4, rounds=10).collect()}
    assert len({got[i] for i in ids if i[0] == "a"}) == len({got[i] for i in ids if i[0] == "b"}) == 1 and got["a1"] != got["b1"] and got["alone"] == "alone"


def test_weighted_distances_and_limits(spark):
    rnd = random.Random(9)
    ids = [f"n{i:02}" for i in range(25)]
    costs = {(rnd.choice(ids), rnd.choice(ids)): rnd.randint(1, 9) / 2 for _ in range(70)}
    df = spark.createDataFrame([(*k, v) for k, v in costs.items()], "src string, dst string, cost double")
    best = {"n00": 0.0}
    for _ in ids:
        for (a, b), c in costs.items():
            if a in best and best[a] + c < best.get(b, 1e9):
                best[b] = best[a] + c
    one = spark.createDataFrame([("n00",)], "id string")
    assert {r.id: r.cost for r in T.weighted_distances(df, one).collect()} == best
    e = df.select("src", "dst", F.lit("x").alias("metaedge"), F.col("cost").alias("weight"), F.lit(1).cast("bigint").alias("evidence"), F.lit(1).cast("bigint").alias("seq"))
    assert T.bfs(e, one, None, max_nodes=7).count() == 7 and T.bfs(e, one, None).count() == len(best)


def test_resolution_merges_into_the_best_connected(spark):
    names = [("G::1", "delsel pain", "G", 1), ("G::2", "delsel pains", "G", 2), ("H::3", "delsel pain", "G", 3), ("G::4", "Cancer", "G", 4), ("G::5", "cancer", "G", 5), ("G::6", None, "G", 6), ("G::7", "mapk", "G", 7), ("G::8", "mapk1", "G", 8)]
    n = spark.createDataFrame(names, "id string, name string, kind string, seq bigint")
    e = spark.createDataFrame([("G::2", "G::4", "x", 1.0, 1, 1), ("G::2", "G::6", "x", 1.0, 1, 2), ("G::1", "G::5", "x", 1.0, 1, 3), ("G::4", "G::5", "x", 1.0, 1, 4)], EDGE)
    deg = spark.createDataFrame([("G::2", 3), ("G::1", 1)], "id string, degree bigint")
    nodes, edges, mapping = Z.resolve_graph(n, e, deg)
    to = {r.id: r.to for r in mapping.collect()}
    assert to == {"G::1": "G::2", "G::2": "G::2", "H::3": "H::3", "G::4": "G::4", "G::5": "G::4", "G::7": "G::7", "G::8": "G::8"}
    assert {r.id for r in nodes.collect()} == {"G::2", "H::3", "G::4", "G::6", "G::7", "G::8"}
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("G::2", "G::4"), ("G::2", "G::6")]
    assert entity_similarity("mapk", "mapk1") >= 0.8  # blocked although similar
    seeds = spark.createDataFrame([("G::1",)], "id string")
    assert {r.id for r in Z.alike(n, seeds, block=2).collect()} == {i for i, name, _, _ in names if name and entity_similarity("delsel pain", name) >= 0.8} and entity_form("Cancer") == "cancer"


def test_questions():
    plan = I.schema_plan("What treats asthma?")
    assert plan["intent"] == "D→(C|PC)" and plan["required"] == (("CtD", "CpD"), "Disease") and plan["deny"] == ["DrD", "CrC"] and plan["match"] == ["CtD"]
    assert I.fallback_plan(plan)["allow"] == ["CpD", "PCiC"] and I.fallback_plan(I.schema_plan("symptom")) is None
    assert I.schema_plan("drugs similar to x")["deny"] == [] and I.schema_plan("")["intent"] == "general"
    assert P.keywords("Which compounds treat the pain syndrome?") == ["compounds", "treat", "pain", "syndrome"]


def test_cascade_stages(spark):
    nodes = [("g1", "TP9", "Gene", 1), ("g2", "TP9K", "Gene", 2), ("d1", "liver cancer", "Disease", 3), ("d2", "cancer of the liver", "Disease", 4), ("a1", "Liver", "Anatomy", 5), ("p1", "odd path", "Pathway", 6), ("g3", "zz", "Gene", 7)]
    n = spark.createDataFrame(nodes, "id string, name string, kind string, seq bigint")
    asked = ["TP9", "TP9K", "tp9k", "LIVER", "the liver cancer of", "pathway", "network", "کبد", "سرطان", "azzb", "qqq", "pq", None, ""]
    t = spark.createDataFrame([(x,) for x in asked], "token string")
    got = {r.token: (r.id, r.stage) for r in Q.cascade(t, n, spark.createDataFrame([("pq", "tp9k")], "token string, alias string")).collect()}
    assert got == {"TP9": ("g1", 2), "TP9K": ("g2", 2), "tp9k": ("g2", 2), "LIVER": ("d1", 2), "the liver cancer of": ("d2", 6), "pathway": ("p1", 5), "network": ("p1", 5), "کبد": ("d1", 7), "سرطان": ("d1", 7), "azzb": ("g3", 8), "pq": ("g2", 1)}


def test_numbers_of_a_hot_key(spark):
    from graphloom.operators.expand import numbered

    rows = [("hot", i % 700) for i in range(3000)] + [(f"k{i}", 0) for i in range(50)]
    got = numbered(spark.createDataFrame(rows, "k string, v int").repartition(4), ["k"], ["v"]).collect()
    hot = sorted((r.place, r.v) for r in got if r.k == "hot")
    assert [p for p, _ in hot] == list(range(1, 3001)) and [v for _, v in hot] == sorted(v for k, v in rows if k == "hot")
    assert all(r.place == 1 for r in got if r.k != "hot")


def test_written_tables_are_released_and_spread_leaves_shuffles_alone(spark):
    import os

    from graphloom import session as N

    df = spark.range(10).toDF("id")
    a, b = N.cut(df, F.count(F.lit(1)).alias("n")), N.cut(df.where("false"), F.count(F.lit(1)).alias("n"))
    assert N.measured(a) == {"n": 10} and N.measured(b) == {"n": 0}
    paths = [x._cut[0].removeprefix("file:") for x in (a, b)]
    paths = ["/" + p.lstrip("/") for p in paths]
    assert all(map(os.path.isdir, paths))
    N.discard(a)
    assert not os.path.isdir(paths[0]) and paths[1].split("/")[-1] in {w.split("/")[-1] for w in N._WRITTEN}
    grouped = df.groupBy("id").count()
    assert N.spread(grouped) is grouped and N.spread(spark.range(1, numPartitions=1)).rdd.getNumPartitions() >= 8
