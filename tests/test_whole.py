"""Results that a cut would shorten, against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import time
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X

from graphloom.functions.python import entity_form, entity_similarity
from graphloom.operators import resolve as Z


def _names():
    parts = ["acute", "late", "delsel", "dasel", "pain", "fever", "zel", "tube", "loss", "ii"]
    names = [f"{a} {b} {c}" for a in parts[:2] for b in parts[2:4] for c in parts[4:]] + ["acute delsel pain " + "x" * 70, "acute delsel pain " + "x" * 69 + "y", "ж", "درد", "دردو"]
    return [("K" if i % 3 else "L", n, 100 - i) for i, n in enumerate(names)]


@pytest.mark.parametrize("block", [4, 1024])
def test_candidates_and_groups_whole(spark, block):
    forms = [(k, entity_form(n), s) for k, n, s in _names()]
    df = spark.createDataFrame(forms, "kind string, form string, seq bigint")
    got = {(r.kind, r.a, r.b): r.similarity for r in Z.candidates(df, block=block).collect()}
    want = {}
    for p, q in combinations(sorted(forms, key=lambda f: (f[2], f[1])), 2):
        if p[0] == q[0] and (s := entity_similarity(p[1], q[1])) >= 0.8:
            want[p[0], p[1], q[1]] = s
    assert got == pytest.approx(want, abs=1e-12) and got.keys() == want.keys()
    leader: dict = {}
    for k, f, _ in sorted(forms, key=lambda f: (f[2], f[1])):
        leader[k, f] = next((g for (kk, g), lead in leader.items() if kk == k and lead == g and (k, g, f) in want), f)
    groups = Z.star_groups(df, Z.candidates(df, block=block)).collect()
    assert {(r.kind, r.form): r.leader for r in groups} == leader


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


@pytest.mark.parametrize("block", [4, 1024])
def test_close_names_whole(spark, block):
    stem = "acute delsel pain " + "x" * 44
    names = sorted({n for _, n, _ in _names()} | {"", "a", "b", "ab", "aba", "abab", "babab", "дар", "дара", "дарами", "дарамы", "a𝄞cde", "abcde"} | {stem + t for t in ("yy", "yyy", "zz", "zyyy")})
    asked = names[::2]
    n, q = (spark.createDataFrame([(x,) for x in rows], "x string") for rows in (names, asked))
    rows = [(r.asked, r.name, r.similarity) for r in Z.close_names(q, n, block=block).collect()]
    want = {(a, b): 1 - e / most for a in asked for b in names if a != b and (e := _edits(a, b)) <= 0.2 * (most := max(len(a), len(b))) + 1e-9}
    assert len(rows) == len(want) and {r[:2]: r[2] for r in rows} == pytest.approx(want, abs=1e-12)


def test_close_names_of_one_pattern_in_time(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdklmnprst") + rng.choice("aeiou") for _ in range(4))
    names = sorted({f"positive control of {word()} {word()} transport" for _ in range(6000)})
    n, q = (spark.createDataFrame([(x,) for x in rows], "x string") for rows in (names, names[::12]))
    began = time.monotonic()
    got = {(r.asked, r.name) for r in Z.close_names(q, n).collect()}
    assert time.monotonic() - began < 45
    few = names[::480]
    assert {p for p in got if p[0] in few[:2]} == {(a, b) for a in few[:2] for b in names if a != b and _edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9}


def test_citations_meet_without_common_words(spark):
    from graphloom.operators import search as S

    rng = random.Random(3)
    rows = [(i, [rng.choice("abcdefgh") for _ in range(i % 4)], [rng.uniform(-1, 1) for _ in range(5)]) for i in range(60)] + [(60, None, [0.0] * 5)]
    df = spark.createDataFrame(rows, "source bigint, words array<string>, v array<double>")
    pieces = df.where("source < 9").withColumnRenamed("source", "piece")

    def score(p, s):
        a, b = set(p[1] or []), set(s[1] or [])
        size = math.sqrt(sum(x * x for x in p[2]) * sum(x * x for x in s[2]))
        near = sum(x * y for x, y in zip(p[2], s[2])) / size if size else 0.0
        return round(0.1 * (len(a & b) / len(a | b) if a | b else 0.0) + 0.9 * near, 9)

    want = {(p[0], s[0]) for p in rows[:9] for s in sorted(rows, key=lambda s: (-score(p, s), s[0]))[:3] if score(p, s) > 0.5}
    for block in (8, 4096):
        assert {(r.piece, r.source) for r in S.citations(pieces, df, block=block).collect()} == want


def test_stopword_strip_all_scripts(spark, tmp_path):
    from graphloom.queries.texts import stopword_strip

    texts = ["The cell и жизнь", "این دارو برای درمان است", "Été of the Zel", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    stop = set(X.STOP_EN + X.STOP_FA)
    want = {i: hashlib.md5(" ".join(w for w in t.lower().split() if len(w) > 1 and w not in stop).encode()).hexdigest() for i, t in enumerate(texts) if t}
    assert {r.doc_id: r.kept for r in stopword_strip(spark, str(tmp_path)).collect()} == want


def test_walks_until_nothing_is_left(spark):
    from graphloom.operators import analytics as A

    ids = [f"n{i:02}" for i in range(40)]
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "src string, dst string").withColumns({"metaedge": F.lit("GiG"), "weight": F.lit(1.0), "seq": F.lit(1)})
    nodes, first, last = (spark.createDataFrame([(i,) for i in x], "id string") for x in (ids, ids[:1], ids[-1:]))
    far = A.mean_distance(edges, first).first()
    assert (far.pairs, far.mean_distance, far.diameter) == (39, 20.0, 39)
    assert A.closeness(edges, nodes, last).first().closeness == pytest.approx(39 / 780)
    assert {r.id: r.betweenness for r in A.betweenness(edges, first).collect()} == {x: 38.0 - i for i, x in enumerate(ids[1:])}


def test_mean_distance_query_whole(spark):
    from graphloom.queries.analysis import closeness, mean_distance
    from graphloom.queries.graph import load, seeds

    d = "/root/testdata/sf0.01"
    g = load(spark, d)
    both, back = defaultdict(set), defaultdict(set)
    for r in g.edges.where("src <> dst").select("src", "dst").distinct().collect():
        both[r.src].add(r.dst), both[r.dst].add(r.src), back[r.dst].add(r.src)

    def walk(seed, steps):
        seen, edge = {seed: 0}, [seed]
        while edge:
            edge = [y for x in edge for y in steps[x] if y not in seen and seen.setdefault(y, seen[x] + 1)]
        return [n for n in seen.values() if n]

    start = [r.id for r in seeds(g).collect()]
    far = [n for s in start for n in walk(s, both)]
    got = mean_distance(spark, d).first()
    assert (got.pairs, got.diameter) == (len(far), max(far)) and got.mean_distance == pytest.approx(sum(far) / len(far), abs=1e-6)
    n, want = g.nodes.count(), {}
    for s in start:
        to = walk(s, back)
        want[s] = len(to) / sum(to) * len(to) / (n - 1) if to else 0.0
    assert {r.id: r.closeness for r in closeness(spark, d).collect()} == pytest.approx(want, abs=1e-8)


def test_safe_numbers_every_line(spark, tmp_path):
    from graphloom.queries.details import safe_numbers

    fields = {"2.5E-2": 0.025, "1.4e-02": 0.014, "-0.5": -0.5, "+3": 3.0, "weight": 0.0, "": 0.0, ".": 0.0, "0.5\r": 0.5, "9e": 0.0, "1d": 0.0, "0x1p3": 0.0, "inf": math.inf}
    lines = [(i, f"a\tGiG\tb\t{x}") for i, x in enumerate(fields)] + [(len(fields), "a\tGiG\tb"), (len(fields) + 1, None)]
    spark.createDataFrame(lines, "raw_id bigint, line string").write.parquet(str(tmp_path / "raw_edges.parquet"))
    assert {r.raw_id: r.weight for r in safe_numbers(spark, str(tmp_path)).collect()} == dict(enumerate([*fields.values(), 0.0, 0.0]))


def test_has_edge_pairs_all_genes(spark):
    from graphloom.queries.graph import has_edge_pairs, load

    d = "/root/testdata/sf0.1"
    g = load(spark, d)
    genes = {r.id for r in g.nodes.where("kind = 'Gene'").select("id").collect()}
    want = {(r.src, r.dst) for r in g.edges.select("src", "dst").collect() if r.src in genes and r.dst in genes and r.src < r.dst}
    rows = has_edge_pairs(spark, d).collect()
    assert len(rows) == len(want) and {(r.src, r.dst) for r in rows} == want
