"""Graph operators on a small graph worked out by hand and against plain walks."""

from __future__ import annotations

import random
from collections import deque

import pytest

from graphloom.functions.python import common_subsequence, entity_similarity, html_text, loose_json
from graphloom.model import PropertyGraph
from graphloom.operators import analytics as A, expand as X, resolve as Z, stats as S, traverse as T
from graphloom.sources import graph_files as G

EDGE = "src string, dst string, metaedge string, weight double, evidence bigint, seq bigint"
NODE = "id string, name string, kind string, seq bigint"


@pytest.fixture(scope="module")
def graph(spark):
    rnd = random.Random(11)
    ids = [f"n{i:02d}" for i in range(30)]
    edges = sorted({(rnd.choice(ids[:25]), rnd.choice(ids[:25]), rnd.choice(["GiG", "CtD", "DrD"])) for _ in range(60)})
    e = spark.createDataFrame([(*x, 1.0, 1, i) for i, x in enumerate(edges)], EDGE)
    n = spark.createDataFrame([(x, f"name {x}", "Gene" if i % 2 else "Disease", i) for i, x in enumerate(ids)], NODE)
    s = spark.createDataFrame([("GiG", 5.0, "interacts with"), ("CtD", 4.5, "treats")], "metaedge string, base_score double, verb string")
    return PropertyGraph(n.cache(), e.cache(), s), ids, edges


def walk(edges, start, depth):
    nxt: dict = {}
    for a, b, _ in edges:
        nxt.setdefault(a, set()).add(b)
    seen, todo = {start: 0}, deque([start])
    while todo:
        a = todo.popleft()
        for b in nxt.get(a, ()):
            if b not in seen and seen[a] < depth:
                seen[b] = seen[a] + 1
                todo.append(b)
    return seen


def test_bfs_equals_a_plain_walk(spark, graph):
    g, ids, edges = graph
    for start in ids[:4]:
        got = {r.id: r.depth for r in T.bfs(g.edges, spark.createDataFrame([(start,)], "id string"), 3).collect()}
        assert got == walk(edges, start, 3)


def test_components_equal_closure(graph):
    g, ids, edges = graph
    both = edges + [(b, a, m) for a, b, m in edges]
    got = {r.id: r.component for r in T.components(g.edges, g.nodes).collect()}
    assert got == {i: min(walk(both, i, 99)) for i in ids}


def test_components_of_long_path(spark):
    n = 200
    e = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}", "x", 1.0, 1, i) for i in range(n)], EDGE)
    v = spark.createDataFrame([(f"{i:04d}", None, None, i) for i in range(n + 1)], NODE)
    assert T.components(e, v).select("component").distinct().collect() == [("0000",)]


def test_shortest_paths_and_k_paths(spark, graph):
    g, ids, edges = graph
    pairs = spark.createDataFrame([(a, b) for a in ids[:3] for b in ids[3:8]], "s string, t string")
    depth = {(a, b): walk(edges, a, 4).get(b) for a in ids[:3] for b in ids[3:8]}
    rows = T.shortest_paths(g.edges, pairs, 4).collect()
    assert {(r.s, r.t): r.hops for r in rows} == {k: d for k, d in depth.items() if d}
    real = {(a, b) for a, b, _ in edges}
    assert all((a, b) in real for r in rows for a, b in zip(r.path, r.path[1:]))
    best = {(r.s, r.t): r.hops for r in T.k_simple_paths(g.edges, pairs, 3, 4).where("rank = 1").collect()}
    assert best == {k: d for k, d in depth.items() if d}


def test_pagerank_sums_to_one(graph):
    g, *_ = graph
    assert abs(sum(r["rank"] for r in A.pagerank(g.nodes, g.edges, 8).collect()) - 1) < 1e-9


def test_betweenness_of_a_path(spark):
    e = spark.createDataFrame([(a, b, "x", 1.0, 1, i) for i, (a, b) in enumerate(["ab", "bc", "cd", "bd"])], EDGE)
    got = {r.id: r.betweenness for r in A.betweenness(e, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {"b": 2.0, "c": 0.0, "d": 0.0}


def test_clustering_of_a_triangle(spark):
    e = spark.createDataFrame([(a, b, "x", 1.0, 1, i) for i, (a, b) in enumerate(["ab", "bc", "ca", "cd"])], EDGE)
    n = spark.createDataFrame([(x, None, None, 0) for x in "abcde"], NODE)
    got = {r.id: round(r.clustering, 4) for r in S.clustering(n, e).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 0.3333, "d": 0.0, "e": 0.0}


def test_expansion_damps_backward_edges(spark, graph):
    g, ids, edges = graph
    hub = max(ids, key=lambda i: sum(a == i for a, *_ in edges))
    rows = {r.id: r.score for r in X.expand(g, spark.createDataFrame([(hub,)], "id string"), ["GiG"], "both").collect()}
    for i, s in rows.items():
        assert s == (6.0 if (hub, i, "GiG") in edges else 4.8)


def test_dfs_is_a_preorder(spark, graph):
    g, ids, edges = graph
    rows = T.dfs(g.edges, spark.createDataFrame([(ids[0],)], "id string"), 3).orderBy("ord").collect()
    assert rows == [] or rows[0].id == ids[0] and len({r.id for r in rows}) == len(rows) and all(r.depth <= 3 for r in rows)


def test_entity_similarity_goldens():
    assert round(entity_similarity("BRCA1", "BRCA2"), 6) == 0.726667
    assert entity_similarity("Breast Cancer", "breast-cancer") == 1.0
    assert round(entity_similarity("TP53", "TP53BP1"), 6) == 0.62381
    assert round(entity_similarity("Lung Cancer", "Lung Cancers"), 6) == 0.9075
    assert entity_similarity(None, "x") == 0.0 and common_subsequence("", "abc") == 0


def test_redirect_drops_new_loops(spark):
    e = spark.createDataFrame([("a", "b", "x", 1.0, 1, 1), ("b", "c", "x", 2.0, 1, 2), ("d", "d", "x", 1.0, 1, 3)], EDGE)
    m = spark.createDataFrame([("b", "a")], "id string, to string")
    assert sorted((r.src, r.dst) for r in Z.redirect(e, m).collect()) == [("a", "c"), ("d", "d")]


def test_html_and_json_helpers():
    page = "<html><nav>menu item of the page</nav><h1>T</h1><p>" + "word " * 10 + "</p><script>bad()</script><li>a longer entry</li></html>"
    assert html_text(page) == "T\n" + " ".join(["word"] * 10) + "\na longer entry"
    assert html_text(None) is None and html_text("") == ""
    assert loose_json('x ```json\n{"a": [1, 2,], // c\n}```') == '{"a": [1, 2]}' and loose_json("none") is None


def test_files_round_trip(spark, graph, tmp_path):
    g, *_ = graph
    G.save_graph(g.nodes, g.edges, str(tmp_path / "g"))
    n, e = G.load_graph(spark, str(tmp_path / "g"))
    assert n.count() == g.nodes.count() and sorted(map(tuple, e.select("src", "metaedge", "dst").collect())) == sorted(map(tuple, g.edges.select("src", "metaedge", "dst").collect()))
    (tmp_path / "x.sif").write_text('a\tGiG\tb\nshort\tline\nq"\tGiG\tc\n')
    n, e = G.load_graph(spark, str(tmp_path / "x.sif"))
    assert e.count() == 2 and n.count() == 4
    (tmp_path / "n.tsv").write_text("﻿id\tname\tkind\n1\tx\tGene\n")
    assert G.read_nodes(spark, str(tmp_path / "n.tsv")).collect() == [("1", "x", "Gene")]
    with pytest.raises(ValueError):
        G.load_graph(spark, "x.pkl")


def test_operators_on_empty_graphs(spark, graph):
    g, _, _ = graph
    nodes, edges, one = g.nodes.where("false"), g.edges.where("false"), spark.createDataFrame([("n01",)], "id string")
    assert {r.id: r.depth for r in T.bfs(edges, one, 3).collect()} == {"n01": 0}
    assert T.bfs(g.edges, one.where("false"), 3).count() == 0 and T.seeded_bfs(edges, one.where("false"), None).count() == 0
    assert T.components(edges, g.nodes).where("id <> component").count() == 0
    assert A.pagerank(nodes, edges).count() == 0 and A.label_propagation(nodes, edges).count() == 0 and A.eigenvector(nodes, edges, 2).count() == 0
    assert abs(A.pagerank(g.nodes, edges, 3).agg({"rank": "sum"}).first()[0] - 1) < 1e-9
    pairs = spark.createDataFrame([("n01", "n02")], "s string, t string")
    assert T.shortest_paths(edges, pairs, 3).count() == 0 and T.shortest_paths(g.edges, pairs.where("false"), 3).count() == 0


def test_pagerank_to_tolerance_and_with_starts(graph):
    g, ids, _ = graph
    far = {r.id: r.rank for r in A.pagerank(g.nodes, g.edges, 40).collect()}
    near = {r.id: r.rank for r in A.pagerank(g.nodes, g.edges, 100, tolerance=1e-7).collect()}
    assert max(abs(far[i] - near[i]) for i in ids) < 1e-5
    mine = {r.id: r.rank for r in A.pagerank(g.nodes, g.edges, 12, start=g.nodes.where("id = 'n03'")).collect()}
    out = {i: [b for a, b, _ in g_edges if a == i] for i in ids} if (g_edges := graph[2]) else {}
    want = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(12):
        lost = sum(want[i] for i in ids if not out[i])
        want = {i: (0.15 + 0.85 * lost) * (i == "n03") + 0.85 * sum(want[a] / len(out[a]) for a in ids for b in out[a] if b == i) for i in ids}
    assert mine == pytest.approx(want, abs=1e-9)
