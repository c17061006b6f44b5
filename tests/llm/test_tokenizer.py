"""The encoder against the installed public libraries, exact round trips, mixing against brute force."""

from __future__ import annotations

import base64
import itertools
import os

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from graphloom.llm.mixing import Mixture, budgets, fit, knapsack
from graphloom.llm.tokenizer import PATTERN, TOKENIZER_DIR, encode_corpus, load_encoder, token_lengths

tokenizers = pytest.importorskip("tokenizers")
ENC = load_encoder()
REF = tokenizers.Tokenizer.from_file(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json"))
REF.encode_special_tokens = True


def want(s):
    return REF.encode(s, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_library(s):
    assert ENC.encode(s) == want(s)
    assert ENC.decode(ENC.encode(s)) == s


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" ae'st\n\t<|endoftext|>éя‌1", max_size=120))
def test_ids_of_awkward_texts(s):
    assert ENC.encode(s) == want(s)


@pytest.mark.parametrize("s", ["", " ", "\n\n\n", "a" * 50_000, " " * 30_000, "ab" * 20_000, "<|endoftext|>", "🧬" * 2000, "﻿‍", "=" * 9999 + "x"])
def test_extreme_texts(s):
    assert ENC.encode(s) == want(s) and ENC.decode(ENC.encode(s)) == s


def test_rank_file_without_merges():
    tiktoken = pytest.importorskip("tiktoken")
    with open(os.path.join(TOKENIZER_DIR, "byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    ref, mine = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), load_encoder("byte_bpe_multi_50k.tiktoken")
    for s in ("Die Ursache ist ungeklärt.", "Связь между геном и болезнью", "در این بررسی ژن", "x" * 3000, "naïve café ½"):
        assert mine.encode(s) == ref.encode_ordinary(s)


def test_corpus_with_nulls_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a dose of 5 mg", "y"), (3, "a dose of 5 mg", "y"), (4, "w " * 20_000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df.drop("ids"), ["doc_id"]).collect())
    assert got == sorted((i, want(t) if t else []) for i, t, _ in rows)
    assert [r.n_tokens for r in token_lengths(df, ["doc_id"]).orderBy("doc_id").collect()] == [0, 0, 5, 5, len(want("w " * 20_000))]
    assert encode_corpus(df.where("false"), ["doc_id"]).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 3)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_knapsack_is_optimal(items, target):
    sizes, counts = [s for s, _ in items], [n for _, n in items]
    take = knapsack(sizes, counts, target)
    assert all(0 <= t <= n for t, n in zip(take, counts))
    best = max(s for c in itertools.product(*[range(n + 1) for n in counts]) if (s := sum(a * b for a, b in zip(c, sizes))) <= target)
    assert sum(a * b for a, b in zip(take, sizes)) == best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 900), st.integers(1, 500)), min_size=1, max_size=40, unique_by=lambda x: x[0]), st.integers(0, 10**6))
def test_fit_stays_within_counts_and_budget(items, budget):
    sizes, counts = [s for s, _ in items], [n for _, n in items]
    held = sum(s * n for s, n in items)
    passes, take = fit(sizes, counts, budget)
    got = passes * held + sum(s * t for s, t in zip(sizes, take))
    assert all(0 <= t <= n for t, n in zip(take, counts)) and budget - max(sizes) < got <= budget or got == 0 and budget < min(sizes)


def test_budgets():
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("none", 0.2, 3), ("b", 0.1, 9), (None, 1.0, 1), ("zero", 0.0, 1)]
    assert budgets({"a": 1000, "b": 100}, targets) == {"a": 333, "b": 200, "none": 0}
    assert budgets({"a": 1000, "b": 100}, targets, total=1600) == {"a": 1000, "b": 200, "none": 0}
    assert budgets({}, targets) == {"a": 0, "b": 0, "none": 0}


def test_mixture(spark):
    rows = [(i, "word " * (1 + i % 7), "a") for i in range(300)] + [(1000 + i, "word " * 3, "b") for i in range(20)] + [(2000, None, "b"), (2001, "", "b"), (2002, "x", None), (2003, "left out", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("copies", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 4), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = Mixture(docs, targets)
    r = {x.source: x for x in m.report().collect()}
    assert r["gone"].tokens_drawn == 0 and r["b"].most_copies <= 4 and r["a"].most_copies == 1
    assert abs(r["a"].actual_share - 0.6 / 0.9) < 0.01 and abs(sum(x.actual_share for x in r.values()) - 1) < 1e-9
    drawn = {x.doc_id for x in m.rows.collect()}
    assert not drawn & {2000, 2001, 2002, 2003}
    again = {x.doc_id: x.copies for x in Mixture(docs.repartition(7), targets).rows.collect()}
    assert again == {x.doc_id: x.copies for x in m.rows.collect()}
    assert Mixture(docs.where("false"), targets).rows.count() == 0
