"""Edge records with the reason for failure: a quote-aware finite-state tokenizer over raw records.

All records of an Arrow batch are laid end to end and cut into equal chunks. Every chunk is run from all start states
at once, which gives its transition function; the functions are composed chunk by chunk (a prefix scan), and a second
run from the now known start states labels each character. A record may thus cross any number of chunks, and one very
long record costs no more than as many short ones.

Rules: a carriage return at the end and a byte order mark at the start are dropped. Skipped are lines of spaces only
(the empty line is one), lines that start with ``#`` and lines equal to the header. A valid line has seven fields; a
field that starts with a double quote ends with one and may hold tabs, line ends and doubled quotes; other fields hold
no double quote. Field values are checked by JVM expressions.

Defined results: a null line is an error (``null line``); repeated lines each come out; an empty table gives an empty
result; offsets count code points of the line as delivered; a line with several faults names the first one of the order
tokenizer, field count, source, relation, target, weight, evidence, observed_on. An evidence count beyond 64 bits is
valid and typed as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FIELDS = ("source", "relation", "target", "weight", "evidence", "observed_on", "note")

START, PLAIN, QUOTED, CLOSING, STRAY, AFTER = range(6)
OTHER, TAB, QUOTE, END = range(4)
#: TRANSITION[class, state]: STRAY is a quote inside a plain field, AFTER a character behind a closing quote.
TRANSITION = np.array(
    [
        [PLAIN, PLAIN, QUOTED, AFTER, STRAY, AFTER],
        [START, START, QUOTED, START, STRAY, AFTER],
        [QUOTED, STRAY, CLOSING, QUOTED, STRAY, AFTER],
        [START, START, START, START, START, START],
    ],
    dtype=np.int8,
)
CHUNK = 256
TOKENS = "status string, reason string, error_at int, fields array<string>"


def label(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """State before each character, by composing the transition functions of chunks."""
    n = len(classes)
    if n == 0:
        return np.zeros(0, np.int8)
    k = -(-n // chunk)
    grid = np.full(k * chunk, END, np.int8)
    grid[:n] = classes
    grid = grid.reshape(k, chunk)
    runs = np.tile(np.arange(6, dtype=np.int8), (k, 1))
    for j in range(chunk):
        runs = TRANSITION[grid[:, j, None], runs]
    step = 1
    while step < k:
        runs[step:] = np.take_along_axis(runs[step:], runs[:-step].astype(np.int64), 1)
        step *= 2
    state = np.empty(k, np.int8)
    state[0], state[1:] = START, runs[:-1, START]
    before = np.empty((k, chunk), np.int8)
    for j in range(chunk):
        before[:, j] = state
        state = TRANSITION[grid[:, j], state]
    return before.reshape(-1)[:n]


def tokenize(lines: list[str | None], header: str = "\t".join(FIELDS), n_fields: int = len(FIELDS), chunk: int = CHUNK) -> list[tuple]:
    """(status, reason, error_at, fields) of each line; status is edge, skip or error."""
    cut = [("" if s is None else s) for s in lines]
    lead = [int(s[:1] == "﻿") for s in cut]
    cut = [s[a : len(s) - 1 if s[-1:] == "\r" and len(s) > a else len(s)] for s, a in zip(cut, lead)]
    size = np.fromiter((len(s) + 1 for s in cut), np.int64, len(cut))
    stops = np.cumsum(size) - 1
    codes = np.frombuffer(("\x00".join(cut) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32) if cut else np.zeros(0, np.uint32)
    classes = np.zeros(len(codes), np.int8)
    classes[codes == 9], classes[codes == 34], classes[stops] = TAB, QUOTE, END
    before = label(classes, chunk)
    seps = np.flatnonzero((classes == TAB) & ((before == START) | (before == PLAIN) | (before == CLOSING)))
    at_stop = before[stops]
    bad = np.flatnonzero((classes != END) & np.isin(TRANSITION[classes, before], (STRAY, AFTER)) & (before != STRAY) & (before != AFTER))
    owner_bad, owner_sep = np.searchsorted(stops, bad), np.searchsorted(stops, seps)
    first_bad = dict(zip(owner_bad[::-1].tolist(), bad[::-1].tolist()))
    lo, hi = np.searchsorted(owner_sep, np.arange(len(cut))), np.searchsorted(owner_sep, np.arange(len(cut)), "right")
    out: list[tuple] = []
    for i, s in enumerate(cut):
        begin = int(stops[i]) - len(s)
        if lines[i] is None:
            out.append(("error", "null line", None, None))
        elif not s.strip(" ") or s[0] == "#" or s == header:
            out.append(("skip", None, None, None))
        elif i in first_bad:
            at = first_bad[i]
            out.append(("error", "quote inside an unquoted field" if TRANSITION[classes[at], before[at]] == STRAY else "text after a closing quote", at - begin + lead[i], None))
        elif at_stop[i] == QUOTED:
            opened = np.flatnonzero((classes[begin : stops[i]] == QUOTE) & (before[begin : stops[i]] == START))
            out.append(("error", "quote not closed", int(opened[-1]) + lead[i], None))
        else:
            cuts = [-1, *(seps[lo[i] : hi[i]] - begin).tolist(), len(s)]
            fields = [s[a + 1 : b] for a, b in zip(cuts, cuts[1:])]
            if len(fields) != n_fields:
                out.append(("error", f"{'too few' if len(fields) < n_fields else 'too many'} fields: {len(fields)}", (len(s) if len(fields) < n_fields else cuts[n_fields]) + lead[i], None))
            else:
                out.append(("edge", None, None, [f[1:-1].replace('""', '"') if f[:1] == '"' else f for f in fields]))
    return out


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = tokenize(b.column(1).to_pylist())
        status, reason, at, fields = zip(*got) if got else ((), (), (), ())
        cols = [pa.array(status, pa.string()), pa.array(reason, pa.string()), pa.array([None if x is None else int(x) for x in at], pa.int32()), pa.array(fields, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["rid", "status", "reason", "error_at", "fields"])


def _first_fault(kinds: list[str], relations: list[str]) -> tuple[Column, dict[str, Column]]:
    f = {name: F.col("fields")[i] for i, name in enumerate(FIELDS)}
    node = "^(" + "|".join(f"\\Q{k}\\E" for k in kinds) + ")::(?s:.)+$"
    number = f["weight"].try_cast("double")
    day = f["observed_on"].try_cast("date")
    typed = {
        "source": f["source"],
        "relation": f["relation"],
        "target": f["target"],
        "weight": number,
        "evidence": f["evidence"].try_cast("bigint"),
        "observed_on": day,
        "note": f["note"],
    }
    faults = [
        ("source is no node key", ~f["source"].rlike(node)),
        ("relation is unknown", ~f["relation"].isin(relations)),
        ("target is no node key", ~f["target"].rlike(node)),
        ("weight is no number from 0 to 1", (f["weight"] != "") & ~(f["weight"].rlike(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z") & F.coalesce(number.between(0, 1), F.lit(False)))),
        ("evidence is no count", ~f["evidence"].rlike(r"^[0-9]*\z")),
        ("observed_on is no date", (f["observed_on"] != "") & ~(f["observed_on"].rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & day.isNotNull())),
    ]
    reason = F.coalesce(*[F.when(bad, F.lit(why)) for why, bad in faults])
    return reason, typed


def parse_edge_records(raw: DataFrame, kinds: list[str], relations: list[str], id_col: str = "raw_id", line_col: str = "line") -> DataFrame:
    """(id, status, reason, error_at, source, relation, target, weight, evidence, observed_on, note) of every record.

    ``kinds`` and ``relations`` are the small fixed vocabularies of node kinds and metaedges.
    """
    plain = raw.select(F.col(id_col).cast("bigint").alias("rid"), F.col(line_col).cast("string").alias("text"))
    tokens = plain.mapInArrow(_token_batches, f"rid bigint, {TOKENS}")
    reason, typed = _first_fault(kinds, relations)
    fault = F.when(F.col("status") == "edge", reason)
    order = F.create_map(*[x for i, n in enumerate(FIELDS) for x in (F.lit(n), F.lit(i))])
    at = F.when(fault.isNotNull(), F.aggregate(F.slice("fields", 1, order[F.split(fault, " ")[0]]), F.lit(0), lambda a, x: a + F.length(x) + 1))
    checked = tokens.select("rid", "status", "reason", "error_at", "fields", fault.alias("fault"), at.alias("fault_at"))
    good = (F.col("status") == "edge") & F.col("fault").isNull()
    return checked.select(
        F.col("rid").alias(id_col),
        F.when(F.col("fault").isNotNull(), "error").otherwise(F.col("status")).alias("status"),
        F.coalesce("fault", "reason").alias("reason"),
        F.coalesce("error_at", "fault_at").alias("error_at"),
        *[F.when(good, c).alias(n) for n, c in typed.items()],
    )
