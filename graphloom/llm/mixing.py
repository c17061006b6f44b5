"""One mixture of several sources at target shares, by subset-sum budget fitting over exact token lengths.

1. Documents are counted by (source, exact token length): a histogram no larger than the number of distinct lengths.
2. Every source gets a budget of tokens: its share of the total, but no more than ``max_repeats`` times what it has.
   Without a given total, the total is the largest at which no source that has documents is held back by its cap, so
   every such source meets its share exactly (shares are scaled to those of the sources that have documents).
3. Whole passes over a source fill its budget first. For the rest each length gives the same fraction of its documents
   (rounded down), which keeps the length distribution; a greedy step takes what is left down to a few documents'
   worth, and a bounded-knapsack dynamic programme over the remaining counts closes the gap, exactly where some
   subset does. The programme's target is a few times the longest document, whatever the corpus holds.
4. The plan says how many documents of each length to take; those with the smallest seeded hashes are taken. Selection
   first cuts a (source, length) group into hash buckets, so that no task holds the whole of a hot group.

Defined results: documents without tokens (null, empty) and of sources without target are left out; a target without
documents, with a null or non-positive share or without repeats gets nothing and is reported with 0; a source named
twice in the targets counts once, with its largest share; repeated rows are documents of their own; ties in the hash are
broken by id; empty tables give an empty mixture.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.llm.tokenizer import token_lengths
from graphloom.session import cut

SEED = 20_240_517
BUCKETS = 1024
PLAN = "source string, n_tokens bigint, passes bigint, take bigint, n_docs bigint"


def knapsack(lengths: list[int], counts: list[int], target: int) -> list[int]:
    """How many of each length to take so that the sum is as near below ``target`` as any subset's.

    ``first`` keeps for each sum the step that made it possible, so memory is linear in the target.
    """
    first = np.full(target + 1, -1, np.int32)
    first[0] = 0
    steps: list[tuple[int, int]] = [(0, 0)]
    for k, (size, n) in enumerate(zip(lengths, counts)):
        if size > target or first[target] >= 0:
            continue
        lot = 1
        while n > 0 and first[target] < 0:
            lot = min(lot, n)
            n -= lot
            w = lot * size
            if w <= target:
                new = (first[:-w] >= 0) & (first[w:] < 0)
                if new.any():
                    first[w:][new] = len(steps)
                    steps.append((k, lot))
            lot *= 2
    at, take = int(np.flatnonzero(first >= 0)[-1]), [0] * len(lengths)
    while at:
        k, lot = steps[first[at]]
        take[k] += lot
        at -= lot * lengths[k]
    return take


def fit(lengths: list[int], counts: list[int], budget: int) -> tuple[int, list[int]]:
    """(whole passes, documents of each length on top) whose tokens come as near below ``budget`` as can be."""
    held = sum(s * n for s, n in zip(lengths, counts))
    if held <= 0 or budget <= 0:
        return 0, [0] * len(lengths)
    passes, rest = divmod(budget, held)
    take = [n * rest // held for n in counts]
    rest -= sum(s * t for s, t in zip(lengths, take))
    room = 2 * max(lengths)
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        more = min(counts[k] - take[k], max(0, rest - room) // lengths[k])
        take[k] += more
        rest -= more * lengths[k]
    left = [n - t for n, t in zip(counts, take)]
    order = sorted(range(len(lengths)), key=lambda i: lengths[i])
    for k, more in zip(order, knapsack([lengths[i] for i in order], [left[i] for i in order], rest)):
        take[k] += more
    return passes, take


def budgets(held: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> dict[str, int]:
    """Budget of tokens of each target source."""
    want: dict[str, tuple[float, int]] = {}
    for s, share, cap in targets:
        if s is not None and share is not None and cap is not None and share > 0 and cap > 0 and (s not in want or want[s][0] < share):
            want[s] = (float(share), int(cap))
    real = {s: v for s, v in want.items() if held.get(s, 0) > 0}
    if not real:
        return dict.fromkeys(want, 0)
    sum_share = sum(share for share, _ in real.values())
    if total is None:
        total = int(min(cap * held[s] * sum_share / share for s, (share, cap) in real.items()))
    return {s: min(real[s][1] * held[s], round(total * real[s][0] / sum_share)) if s in real else 0 for s in want}


def _fit_groups(quota: dict[str, int]):
    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n_tokens")
        passes, take = fit(g.n_tokens.tolist(), g.n_docs.tolist(), quota.get(g.source.iloc[0], 0))
        return pd.DataFrame({"source": g.source, "n_tokens": g.n_tokens, "passes": passes, "take": take, "n_docs": g.n_docs})

    return one


def _select(docs: DataFrame, plan: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Documents with ``copies``: the plan's passes, and one more for the planned number of each length."""
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    ranked = docs.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 54).cast("int"))
    cells = ranked.groupBy("source", "n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    share = cells.join(plan.select("source", "n_tokens", "passes", "take"), ["source", "n_tokens"]).withColumn("quota", F.greatest(F.lit(0), F.least("n", F.col("take") - before)))
    rows = ranked.join(share.where("passes > 0 or quota > 0").select("source", "n_tokens", "bucket", "passes", "quota", "n"), ["source", "n_tokens", "bucket"])
    whole = rows.where("quota = 0 or quota = n").withColumn("extra", (F.col("quota") > 0).cast("bigint"))
    order = W.partitionBy("source", "n_tokens", "bucket").orderBy("h", id_col)
    part = rows.where("quota > 0 and quota < n").withColumn("extra", (F.row_number().over(order) <= F.col("quota")).cast("bigint"))
    both = whole.unionByName(part)
    return both.select(id_col, "source", "n_tokens", (F.col("passes") + F.col("extra")).alias("copies")).where("copies > 0")


class Mixture:
    """Documents of a mixture and its report."""

    def __init__(self, docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", total: int | None = None, seed: int = SEED, tokenizer: str = "byte_bpe_50k.json") -> None:
        self.id_col, self.targets = id_col, targets
        wanted = targets.select("source", "target_share", "max_repeats").collect()  # a configuration table
        self.wanted = [(r[0], r[1], r[2]) for r in wanted]
        names = sorted({s for s, _, _ in self.wanted if s is not None})
        rows = docs.where(F.col("source").isin(names) if names else F.lit(False))
        sized = token_lengths(rows.select(id_col, "source", text_col), [id_col, "source"], text_col, tokenizer)
        self.sized = cut(sized.where("n_tokens > 0"))  # each text is encoded once
        self.histogram = self.sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
        held = self.histogram.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias("t"), F.sum("n_docs").alias("n")).collect()  # at most one row a target
        self.held, self.docs_held = {r[0]: int(r[1]) for r in held}, {r[0]: int(r[2]) for r in held}
        self.quota = budgets(self.held, self.wanted, total)
        self.plan = cut(self.histogram.groupBy("source").applyInPandas(_fit_groups(self.quota), PLAN))
        self.rows = _select(self.sized, self.plan, id_col, seed)

    def report(self) -> DataFrame:
        """One row a target source: what it has, should give and gives."""
        spark = self.targets.sparkSession
        best: dict[str, tuple] = {}
        for s, share, cap in self.wanted:
            if s is not None and (s not in best or (share or 0) > (best[s][0] or 0)):
                best[s] = (share, cap)
        base = spark.createDataFrame([(s, None if share is None else float(share), None if cap is None else int(cap), self.docs_held.get(s, 0), self.held.get(s, 0), self.quota.get(s, 0)) for s, (share, cap) in sorted(best.items())], "source string, target_share double, max_repeats int, n_docs bigint, tokens_held bigint, tokens_budget bigint")
        got = self.rows.groupBy("source").agg(F.sum("copies").alias("n_drawn"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_drawn"), F.max("copies").alias("most_copies"))
        full = base.join(F.broadcast(got), "source", "left").na.fill(0, ["n_drawn", "tokens_drawn", "most_copies"])
        return full.withColumn("actual_share", F.try_divide(F.col("tokens_drawn"), F.sum("tokens_drawn").over(W.partitionBy(F.lit(1)))))
