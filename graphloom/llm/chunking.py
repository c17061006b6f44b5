"""Content-defined splitting of oversized texts at natural boundaries.

A rolling hash over ``WINDOW`` code points marks landmarks. Every landmark snaps to the nearest natural boundary within
reach: the end of a paragraph, line or sentence if there is one, else white space, else the landmark itself stays. From
each cut on, the first snapped landmark between the least and the largest size ends the piece; where there is none, the
best natural boundary in that range does (of equals the one with the largest hash), and in text without any boundary the
position with the largest hash. All choices depend on the text near by, so an edit alters only the pieces around it.

A piece begins ``overlap`` characters before the cut, so pieces cover the text and share exactly that many characters;
with the overlap a piece has at most ``max_chars``. No cut falls inside a carriage return and line feed, before a
combining mark or beside a zero-width joiner, unless a range holds nothing else.

Defined results: a null item gives no piece; an item within the limit, the empty one included, is one piece; sizes are
code points; items without a limit are one piece; repeated rows give equal pieces; null sections give no items (item 0,
the text, is numbered whether null or not); further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.session import spread

WINDOW = 24
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)
PARAGRAPH, LINE, SENTENCE, SPACE = 4, 3, 2, 1

_PARAGRAPHS = re.compile(r"\n[^\S\n]*\n\s*")
_LINES = re.compile(r"\r\n?|\n")
_SENTENCES = re.compile("(?<![.!?؟。！？…])[.!?؟。！？…]+[\"'”’»)\\]]*\\s+")
_SPACES = re.compile(r"\s+")


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, BASE, np.uint64), dtype=np.uint64)
        down = np.cumprod(np.full(n, BASE_INVERSE, np.uint64), dtype=np.uint64)
    return up, down


def rolling_hash(codes: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` code points before each position 0..n."""
    n = len(codes)
    up, down = _powers(max(4096, 1 << (n + 1).bit_length()))
    with np.errstate(over="ignore"):
        v = (codes.astype(np.uint64) + np.uint64(1)) * MIX
        v ^= v >> np.uint64(31)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(v * down[:n], out=s[1:], dtype=np.uint64)
        back = np.zeros(n + 1, np.uint64)
        if n > WINDOW:
            back[WINDOW:] = s[: n + 1 - WINDOW]
        h = (s - back) * up[: n + 1]
        h ^= h >> np.uint64(29)
        h *= MIX
        h ^= h >> np.uint64(32)
    return h


def boundaries(text: str) -> np.ndarray:
    """Kind of natural boundary before each position 0..n (0: none)."""
    kind = np.zeros(len(text) + 1, np.int8)
    for pattern, k in ((_SPACES, SPACE), (_SENTENCES, SENTENCE), (_LINES, LINE), (_PARAGRAPHS, PARAGRAPH)):
        at = [m.end() for m in pattern.finditer(text)]
        kind[at] = k
    kind[0] = 0
    return kind


def _joined(before: str, after: str) -> bool:
    """Whether two characters must not be parted."""
    return before == "\r" and after == "\n" or before in "‍‌" or after in "‍‌" or "︀" <= after <= "️" or "\U0001f3fb" <= after <= "\U0001f3ff" or unicodedata.combining(after) > 0 or unicodedata.category(after) in ("Mn", "Me", "Mc")


def _strongest(text: str, h: np.ndarray, at: np.ndarray) -> int | None:
    """Of positions the one with the largest hash that parts nothing."""
    for p in at[np.argsort(h[at], kind="stable")[::-1]]:
        if not _joined(text[p - 1], text[p]):
            return int(p)
    return None


def cuts(text: str, max_chars: int, overlap: int) -> list[int]:
    """Positions at which the pieces of ``text`` end, the last one being its length."""
    n = len(text)
    if n <= max_chars:
        return [n]
    most = max(1, max_chars - overlap)
    least, every, reach = max(1, most // 2), max(8, most // 8), max(4, most // 8)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h, kind = rolling_hash(codes), boundaries(text)
    marks = np.flatnonzero(h % np.uint64(every) == 0)
    marks = marks[(marks > 0) & (marks < n)]
    strong, weak = np.flatnonzero(kind >= SENTENCE), np.flatnonzero(kind == SPACE)

    def nearest(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(of):
            return np.full(len(marks), -1), np.full(len(marks), n + 1)
        i = np.searchsorted(of, marks)
        a, b = of[np.maximum(i - 1, 0)], of[np.minimum(i, len(of) - 1)]
        best = np.where(np.abs(marks - a) <= np.abs(b - marks), a, b)
        return best, np.abs(best - marks)

    s, s_far = nearest(strong)
    w, w_far = nearest(weak)
    snapped = np.where(s_far <= reach, s, np.where(w_far <= reach, w, marks))
    natural = (s_far <= reach) | (w_far <= reach)
    # A landmark that snaps nowhere counts only where no boundary is in reach of it, in text without any.
    snapped = np.unique(snapped[natural | ((s_far > most) & (w_far > most))])
    snapped = snapped[(snapped > 0) & (snapped < n)]
    out, at = [], 0
    while n - at > most:
        i = np.searchsorted(snapped, at + least)
        cut = None
        while i < len(snapped) and snapped[i] <= at + most:
            p = int(snapped[i])
            if kind[p] or not _joined(text[p - 1], text[p]):
                cut = p
                break
            i += 1
        if cut is None:
            span = kind[at + least : at + most + 1]
            best = int(span.max()) if len(span) else 0
            if best:
                cut = _strongest(text, h, at + least + np.flatnonzero(span == best))
            if cut is None:
                cut = _strongest(text, h, np.arange(at + least, at + most + 1))
            if cut is None:
                cut = at + most
        out.append(cut)
        at = cut
    return [*out, n]


def pieces(text: str, max_chars: int | None, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of the pieces of a text."""
    if max_chars is None:
        return [(0, len(text))]
    if not 0 <= overlap < max_chars:
        raise ValueError(f"an overlap of {overlap} doesn't fit pieces of {max_chars}")
    ends = cuts(text, max_chars, overlap)
    return [(max(0, a - overlap) if a else 0, b) for a, b in zip([0, *ends], ends)]


def items(pages: DataFrame, key: str, text: str = "text", sections: str = "sections") -> DataFrame:
    """(key, item_no, text): item 0 is the text, item k the k-th section."""
    parts = F.concat(F.array(F.col(text).cast("string")), F.coalesce(F.transform(sections, lambda s: s["text"]), F.array().cast("array<string>")))
    return pages.select(F.col(key).cast("bigint").alias("key"), F.posexplode(parts).alias("item_no", "text")).where("text is not null")


def split(rows: DataFrame, limits: dict[str, tuple[int, int]], with_text: bool = True) -> DataFrame:
    """(key, item_no, piece_no, n_pieces, begin, end[, text]) of items; ``limits``: (max_chars, overlap) of text and section."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for key, item, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                most, overlap = limits.get("section" if item else "text", (None, 0))
                got = pieces(t, most, overlap)
                for k, (x, y) in enumerate(got):
                    for c, v in zip(cols, (key, item, k, len(got), x, y, t[x:y] if with_text else None)):
                        c.append(v)
            kinds = [pa.int64(), *[pa.int32()] * 5, pa.string()]
            names = ["key", "item_no", "piece_no", "n_pieces", "begin", "end", "text"]
            m = 7 if with_text else 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:m], kinds)], names=names[:m])

    schema = "key bigint, item_no int, piece_no int, n_pieces int, begin int, end int" + (", text string" if with_text else "")
    return spread(rows).mapInArrow(run, schema)


def read_limits(limits: DataFrame) -> dict[str, tuple[int, int]]:
    """(max_chars, overlap) by item, from the small table of limits."""
    return {r.item: (r.max_chars, r.overlap_chars or 0) for r in limits.select("item", "max_chars", "overlap_chars").collect() if r.item is not None and r.max_chars is not None}
