"""Per-key results without hot tasks: range partitioning on (field, key, neighbour, row), then stitching.

Rows are range partitioned on the composite key and the secondary order (neighbour, row id) with sampled quantiles, so
a key with any share of the rows is cut into as many equal stretches as it needs, even where one (key, neighbour) pair
alone is hot. Each partition, sorted, yields one partial state per key: rows, weight, distinct neighbours and the first
and last neighbour. A key's partial states, in range order, are stitched: sums add up, and a neighbour that ends one
stretch and begins the next is counted once. There are at most (keys + partitions) partial states.

Defined results: a null key has no result; a null neighbour counts as an edge but not as a neighbour; a null weight
counts as 0; repeated rows count again as edges and once as neighbours; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.session import plan_bytes, shuffle_width

#: Bytes of a scan that one range partition takes.
PARTITION_BYTES = 64 << 20
PARTIAL = "field string, key string, part int, n bigint, w double, d bigint, first_nb string, last_nb string"


def _differs(col: pa.Array) -> np.ndarray:
    """True where a value differs from the one before it; nulls equal each other."""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    ne = pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_valid(a), pc.is_valid(b)))
    return ne.to_numpy(zero_copy_only=False)


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("field", pa.string()), ("key", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("w", pa.float64()), ("d", pa.int64()), ("first_nb", pa.string()), ("last_nb", pa.string())])
    part, held = TaskContext.get().partitionId(), None
    for b in batches:
        if b.num_rows == 0:
            continue
        field, key, nb = b.column(0), b.column(1), b.column(2)
        new_key, new_nb = np.ones(b.num_rows, bool), np.ones(b.num_rows, bool)
        new_key[1:] = _differs(field) | _differs(key)
        new_nb[1:] = new_key[1:] | _differs(nb)
        new_nb &= nb.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new_key)
        ends = np.append(at[1:], b.num_rows) - 1
        n = np.diff(np.append(at, b.num_rows))
        w = np.add.reduceat(pc.fill_null(b.column(3), 0.0).to_numpy(zero_copy_only=False), at)
        d = np.add.reduceat(new_nb.astype(np.int64), at)
        rows = [field.take(pa.array(at)).to_pylist(), key.take(pa.array(at)).to_pylist(), n.tolist(), w.tolist(), d.tolist(), nb.take(pa.array(at)).to_pylist(), nb.take(pa.array(ends)).to_pylist()]
        if held is not None:
            if (held[0], held[1]) == (rows[0][0], rows[1][0]):
                same = held[6] is not None and held[6] == rows[5][0]
                rows[2][0] += held[2]
                rows[3][0] += held[3]
                rows[4][0] += held[4] - same
                rows[5][0] = held[5]
            else:
                for col, v in zip(rows, held):
                    col.insert(0, v)
        held = [c.pop() for c in rows]
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([rows[0], rows[1], [part] * len(rows[0]), *rows[2:]], schema.types)], schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([held[0], held[1], part, *held[2:]], schema.types)], schema=schema)


def partial_states(rows: DataFrame, partitions: int) -> DataFrame:
    """Partial states of (field, key, nb, w, row) rows, one per key and range partition."""
    spread = rows.repartitionByRange(partitions, "field", "key", "nb", "row").sortWithinPartitions("field", "key", "nb")
    return spread.select("field", "key", "nb", "w").mapInArrow(_partials, PARTIAL)


def stitch(partials: DataFrame) -> DataFrame:
    """Join the partial states of each key in range order."""
    order = W.partitionBy("field", "key").orderBy("part")
    twice = F.when(F.lag("last_nb").over(order) == F.col("first_nb"), 1).otherwise(0)
    return partials.withColumn("twice", twice).groupBy("field", "key").agg(F.sum("n").alias("n_rows"), F.sum("w").alias("sum_weight"), F.sum(F.col("d") - F.col("twice")).alias("n_neighbors"))


def keyed_stats(edges: DataFrame, fields: dict[str, str], weight: str, row_id: str, partitions: int | None = None) -> DataFrame:
    """(field, key, n_rows, sum_weight, n_neighbors) for every non-null value of each field.

    ``fields`` maps a key column to the column that holds its neighbour. The number of range partitions follows the size
    of the input.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("key"), F.col(v).cast("string").alias("nb")) for k, v in fields.items()])
    rows = edges.select(F.explode(pairs).alias("p"), F.col(weight).cast("double").alias("w"), F.col(row_id).alias("row")).select("p.*", "w", "row").where("key is not null")
    wide = max(shuffle_width(edges.sparkSession), len(fields) * plan_bytes(edges.select(*fields, weight, row_id)) // PARTITION_BYTES)
    return stitch(partial_states(rows, partitions or wide))


def heavy_hitters(stats: DataFrame, total: int, share: float) -> DataFrame:
    """Keys whose rows are at least ``share`` of ``total``."""
    return stats.where(F.col("n_rows") >= F.lit(share) * F.lit(total))
