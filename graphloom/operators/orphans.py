"""References to records that do not exist, from signed change deltas.

Every node row is two signed existence deltas (+1 at ``created_at``, -1 at ``deleted_at``) and every reference a
positive reference delta. Summing the existence deltas of a key in time order gives its existence count at each
instant; the stretches where the count is positive are its *live intervals*. A reference is an orphan when the
existence count of its key is zero at the time of the reference.

``OrphanState`` keeps both kinds of deltas, summed by key: existence changes per instant and reference counts per table
and field. Batches of changes merge into it (arrivals count +1, removals -1), whatever their order, and it gives the
current orphan report, keys with positive references and zero existence, as well as the live intervals that decide
about single references. State and batches are pre-aggregated tables, so merging costs what the batch and the keys cost,
not what all records do.

Hot keys: existence deltas are pre-aggregated per (key, instant), so copies of one delivery collapse before the
window; references to a key with at least ``heavy_share`` of all references are salted over ``salts`` buckets and the
few live intervals of such keys are repeated once per bucket. At most ``1 / heavy_share`` keys can be heavy, which
bounds the list kept in the plan.

Defined results: a null reference is no reference; a reference without a time is an orphan, as no node is known to be
live then; a node row without id or ``created_at``, or deleted no later than created, is never live; repeated
node rows count once per delivery in the counts but give one live interval; repeated references each come out; empty
tables give empty (no references) or all-orphan (no nodes) results; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window as W, functions as F

from graphloom.session import cut

HEAVY_SHARE = 0.005
SALTS = 32


@dataclass(frozen=True)
class Reference:
    """One referring field: ``df`` is the table, ``at`` the record's time."""

    df: DataFrame
    tbl: str
    row_id: str
    field: str
    at: str


def reference_rows(refs: list[Reference]) -> DataFrame:
    """(tbl, row_id, field, key, at) of every non-null reference; fields of one table share its scan."""
    groups: dict[tuple, list[Reference]] = {}
    for r in refs:
        groups.setdefault((id(r.df), r.tbl, r.row_id, r.at), []).append(r)
    parts = []
    for (_, tbl, row_id, at), rs in groups.items():
        pairs = F.array(*[F.struct(F.lit(r.field).alias("field"), F.col(r.field).cast("string").alias("key")) for r in rs])
        d = rs[0].df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(at).alias("at"), F.explode(pairs).alias("p"))
        parts.append(d.select(F.lit(tbl).alias("tbl"), "row_id", "p.field", "p.key", "at").where("key is not null"))
    return reduce(DataFrame.unionByName, parts)


def existence_deltas(nodes: DataFrame, key: str = "id", start: str = "created_at", end: str = "deleted_at") -> DataFrame:
    """(key, at, delta): signed existence changes, summed per key and instant."""
    valid = nodes.select(F.col(key).alias("key"), F.col(start).alias("s"), F.col(end).alias("e")).where(
        "key is not null and s is not null and (e is null or e > s)"
    )
    changes = F.array(F.struct(F.col("s").alias("at"), F.lit(1).cast("bigint").alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).cast("bigint").alias("d")))
    return valid.select("key", F.explode(changes).alias("c")).where("c.at is not null").groupBy("key", F.col("c.at").alias("at")).agg(F.sum("c.d").alias("delta"))


def live_intervals(deltas: DataFrame) -> DataFrame:
    """(key, live_from, live_to): maximal stretches with a positive existence count; null = still live."""
    order = W.partitionBy("key").orderBy("at")
    running = deltas.where("delta <> 0").withColumn("n", F.sum("delta").over(order.rowsBetween(W.unboundedPreceding, 0)))
    turns = running.where("(n > 0) <> (n - delta > 0)")
    return turns.select("key", "n", F.col("at").alias("live_from"), F.lead("at").over(order).alias("live_to")).where("n > 0").drop("n")


def heavy_keys(rows: DataFrame, key: str, share: float = HEAVY_SHARE) -> list[str]:
    """Keys with at least ``share`` of the rows: no more than ``1 / share`` of them, found in one pass."""
    seen, most = Observation(), int(1 / share) + 1
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).observe(seen, F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n")).limit(most).collect()
    total = seen.get["total"] or 0
    return [r[0] for r in top if r["n"] >= max(2.0, share * total)]


class OrphanState:
    """Signed existence and reference counts per key, maintained from batches of changes."""

    def __init__(self, existence: DataFrame, references: DataFrame) -> None:
        self.existence, self.references = existence, references

    @classmethod
    def of(cls, nodes: DataFrame, refs: list[Reference], sign: int = 1) -> OrphanState:
        """State of a batch of node rows and referring rows; ``sign`` -1 takes them back."""
        e = existence_deltas(nodes).withColumn("delta", F.col("delta") * sign)
        r = reference_rows(refs).groupBy("key", "tbl", "field").agg((F.count(F.lit(1)) * sign).alias("refs"))
        return cls(e, r)

    def merge(self, batch: OrphanState) -> OrphanState:
        """The state after a batch, written; what sums to nothing is dropped."""
        e = self.existence.unionByName(batch.existence).groupBy("key", "at").agg(F.sum("delta").alias("delta")).where("delta <> 0")
        r = self.references.unionByName(batch.references).groupBy("key", "tbl", "field").agg(F.sum("refs").alias("refs")).where("refs <> 0")
        return OrphanState(cut(e), cut(r))

    def live(self) -> DataFrame:
        return live_intervals(self.existence)

    def current(self) -> DataFrame:
        """(key, n_refs, n_live): keys with positive reference and zero existence count after all deltas."""
        zero = F.lit(0).cast("bigint")
        both = self.references.select("key", "refs", zero.alias("live")).unionByName(self.existence.select("key", zero.alias("refs"), F.col("delta").alias("live")))
        return both.groupBy("key").agg(F.sum("refs").alias("n_refs"), F.sum("live").alias("n_live")).where("n_refs > 0 and n_live = 0")


def orphan_references(refs: list[Reference], state: OrphanState, heavy_share: float = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """(tbl, row_id, field, key, at) of references whose key has a zero existence count in ``state`` at their time."""
    rows, live = reference_rows(refs), state.live()
    heavy = heavy_keys(rows, "key", heavy_share)
    hot = F.col("key").isin(heavy) if heavy else F.lit(False)
    salted = rows.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("row_id"), F.lit(salts))).otherwise(F.lit(0).cast("bigint")))
    spread = live.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))))
    l, r = salted.alias("l"), spread.alias("r")
    on = (F.col("l.key") == F.col("r.key")) & (F.col("l.salt") == F.col("r.salt")) & (F.col("l.at") >= F.col("r.live_from")) & (F.col("r.live_to").isNull() | (F.col("l.at") < F.col("r.live_to")))
    return l.join(r, on, "left_anti").drop("salt")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(tbl, field, month, n_orphans, n_keys) counts of orphan references."""
    return orphans.groupBy("tbl", "field", F.date_format("at", "yyyy-MM").alias("month"), "key").agg(F.count(F.lit(1)).alias("n")).groupBy("tbl", "field", "month").agg(F.sum("n").alias("n_orphans"), F.count(F.lit(1)).alias("n_keys"))
