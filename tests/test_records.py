"""Orphans, per-key results and edge records against plain Python, on dirty small inputs."""

from __future__ import annotations

import datetime as dt
import random
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from graphloom.operators.orphans import OrphanState, Reference, orphan_references, orphan_report
from graphloom.operators.skew import keyed_stats
from graphloom.sources.records import END, OTHER, QUOTE, START, TAB, TRANSITION, label, parse_edge_records, tokenize

T0 = dt.datetime(2024, 1, 1)
NODES = "id string, created_at timestamp, deleted_at timestamp, tbl string, key string, at string"
EDGES = "edge_id bigint, source string, target string, weight double, observed_at timestamp, field string, part string"


def hours(k):
    return None if k is None else T0 + dt.timedelta(hours=k)


def nodes_df(spark, rows):
    return spark.createDataFrame([(i, hours(a), hours(b), "x", "y", "z") for i, a, b in rows], NODES)


def edges_df(spark, rows):
    return spark.createDataFrame([(e, s, t, w, hours(h), "f", "p") for e, s, t, w, h in rows], EDGES)


def live(nodes, key, at):
    return any(i == key and a is not None and at is not None and a <= at and (b is None or at < b) for i, a, b in nodes)


def test_orphans_against_brute_force(spark):
    rnd = random.Random(3)
    keys = [f"k{i}" for i in range(12)]
    nodes = [(rnd.choice([*keys[:9], None]), rnd.choice([None, *range(20)]), rnd.choice([None, *range(25)])) for _ in range(60)]
    nodes += nodes[:10]
    edges = [(i, "k0" if i % 3 == 0 else rnd.choice([*keys, None]), rnd.choice([*keys, None]), 1.0, rnd.choice([None, *range(25)])) for i in range(400)]
    e = edges_df(spark, edges)
    refs = [Reference(e, "t", "edge_id", "source", "observed_at"), Reference(e, "t", "edge_id", "target", "observed_at")]
    out = orphan_references(refs, OrphanState.of(nodes_df(spark, nodes), refs), heavy_share=0.05, salts=4)
    got = sorted((r.row_id, r.field) for r in out.collect())
    want = sorted((i, f) for i, s, t, _, h in edges for f, k in (("source", s), ("target", t)) if k is not None and not live(nodes, k, h))
    assert got == want
    assert orphan_report(out).agg(F.sum("n_orphans")).first()[0] == len(want)


def test_orphan_state_equals_a_replay_of_deltas(spark):
    rnd = random.Random(4)
    keys = [f"k{i}" for i in range(9)]
    nodes = [(rnd.choice(keys[:7]), rnd.randrange(20), rnd.choice([None, *range(25)])) for _ in range(40)]
    edges = [(i, rnd.choice([*keys, None]), rnd.choice(keys), 1.0, rnd.randrange(25)) for i in range(120)]

    def batch(ns, es, sign=1):
        e = edges_df(spark, es)
        refs = [Reference(e, "t", "edge_id", "source", "observed_at"), Reference(e, "t", "edge_id", "target", "observed_at")]
        return refs, OrphanState.of(nodes_df(spark, ns), refs, sign)

    refs, whole = batch(nodes, edges)
    state = batch(nodes[30:], edges[100:])[1]  # late nodes first
    for ns, es, sign in ((nodes[:10], edges[:50], 1), (nodes[5:9], edges[90:100], 1), (nodes[10:30], edges[50:100], 1), (nodes[5:9], edges[90:100], -1)):
        state = state.merge(batch(ns, es, sign)[1])
    assert sorted(state.current().collect()) == sorted(whole.current().collect())
    assert sorted(orphan_references(refs, state).collect()) == sorted(orphan_references(refs, whole).collect())


def test_orphans_of_empty_tables(spark):
    e, n = edges_df(spark, [(1, "a", None, None, 3)]), nodes_df(spark, [])
    refs = [Reference(e, "t", "edge_id", "source", "observed_at"), Reference(e, "t", "edge_id", "target", "observed_at")]
    assert orphan_references(refs, OrphanState.of(n, refs)).count() == 1
    assert OrphanState.of(n, refs).current().collect()[0].n_refs == 1
    none = [Reference(edges_df(spark, []), "t", "edge_id", "source", "observed_at")]
    assert orphan_references(none, OrphanState.of(n, none)).count() == 0


def test_keyed_stats_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "a", "b", None, ""]), rnd.choice(["x", "y", "y", "y", None, "", *map(str, range(30))]), rnd.choice([None, 0.5, 0.25]), 0) for i in range(3000)]
    rows += [(9000 + i, "hot", "y", 0.5, 0) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {(r.field, r.key): (r.n_rows, round(r.sum_weight, 6), r.n_neighbors) for r in keyed_stats(edges_df(spark, rows), {"source": "target", "target": "source"}, "weight", "edge_id", 7).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want: dict = {}
    for _, s, t, w, _ in rows:
        for f, k, nb in (("source", s, t), ("target", t, s)):
            if k is not None:
                c = want.setdefault((f, k), [0, 0.0, set()])
                c[0] += 1
                c[1] += w or 0
                if nb is not None:
                    c[2].add(nb)
    assert got == {k: (n, round(w, 6), len(s)) for k, (n, w, s) in want.items()}
    assert keyed_stats(edges_df(spark, []), {"source": "target"}, "weight", "edge_id").count() == 0


def run_plain(classes):
    state, out = START, []
    for c in classes:
        out.append(state)
        state = int(TRANSITION[c, state])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([OTHER, TAB, QUOTE, END]), max_size=200), st.integers(1, 40))
def test_composed_states_equal_a_plain_run(classes, chunk):
    import numpy as np

    assert label(np.array(classes, np.int8), chunk).tolist() == run_plain(classes)


FIELD = r'(?:"(?:[^"]|"")*"|[^"\t][^"\t]*|)'
LINE = re.compile(rf"({FIELD})" + rf"\t({FIELD})" * 6, re.S)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='a"\t\n\r#﻿ é', max_size=30), max_size=8), st.integers(1, 9))
def test_tokenizer_against_a_pattern(lines, chunk):
    for line, (status, reason, at, fields) in zip(lines, tokenize(lines, chunk=chunk)):
        s = line[1:] if line[:1] == "﻿" else line
        s = s[:-1] if s[-1:] == "\r" else s
        if not s.strip(" ") or s.startswith("#"):
            assert status == "skip"
            continue
        m = LINE.fullmatch(s)
        assert (status == "edge") == bool(m), (line, reason)
        if m:
            assert fields == [f[1:-1].replace('""', '"') if f[:1] == '"' else f for f in m.groups()]
        else:
            assert reason and (at is None or 0 <= at <= len(line))


def test_parser_cases(spark):
    ok = "Gene::1\tGiG\tGene::2\t0.5\t3\t2024-02-29\tn"
    cases = {
        ok: None,
        ok + "\r": None,
        "﻿" + ok: None,
        "Gene::1\tGiG\tGene::2\t\t\t\t": None,
        '"Gene::1"\tGiG\tGene::2\t1e-3\t3\t\t"a\tb\n""c"""': None,
        ok.replace("0.5", "1.5"): "weight is no number from 0 to 1",
        ok.replace("0.5", "-0"): "weight is no number from 0 to 1",
        ok.replace("0.5", "NaN"): "weight is no number from 0 to 1",
        ok.replace("0.5", "."): "weight is no number from 0 to 1",
        ok.replace("2024-02-29", "2023-02-29"): "observed_on is no date",
        ok.replace("\t3\t", "\t-3\t"): "evidence is no count",
        ok.replace("GiG", "gig"): "relation is unknown",
        ok.replace("Gene::1", "Gene::"): "source is no node key",
        ok.replace("Gene::2", "Gen::2"): "target is no node key",
        "a\tb": "too few fields: 2",
        ok + "\tx": "too many fields: 8",
        ok + '"': "quote inside an unquoted field",
        '"Gene::1"x\tGiG\tGene::2\t\t\t\t': "text after a closing quote",
        '"Gene::1\tGiG': "quote not closed",
        None: "null line",
        "x" * 5000 + "\t": "too few fields: 2",
    }
    raw = spark.createDataFrame([(i, line, "dup", "dup") for i, line in enumerate(cases)], "raw_id bigint, line string, status string, fields string")
    got = {r.raw_id: r for r in parse_edge_records(raw, ["Gene"], ["GiG"]).collect()}
    for i, (line, why) in enumerate(cases.items()):
        assert got[i].reason == why, (line, got[i])
        assert got[i].status == ("error" if why else "edge")
    assert got[4].note == 'a\tb\n"c"' and got[4].weight == 0.001 and got[0].evidence == 3
    assert got[list(cases).index(ok.replace("GiG", "gig"))].error_at == len("Gene::1\t")
    empty = raw.where("false")
    assert parse_edge_records(empty, ["Gene"], ["GiG"]).count() == 0
