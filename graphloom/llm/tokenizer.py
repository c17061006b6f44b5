"""Byte-level BPE encoding of a whole corpus by backtracking over longest token matches.

A text is cut by the tokenizer's public split pattern; each piece is encoded on its own. For a piece, an Aho-Corasick
automaton over all tokens gives the longest token that starts at each byte. The encoder walks left to right: it takes
the longest token, shortens it to the next token that is a prefix while the pair (previous token, this token) could not
stand side by side in a true BPE result, and steps back when no prefix is left; a byte position from which it had to
step back is never tried again, so the walk is linear in the piece. Two tokens are compatible when undoing their
merges, latest first, never meets a merge across their border that BPE would have made earlier.

Decoding joins all token bytes in one buffer and cuts them by an offset table.

Defined results: a null and an empty text have no ids; strings of special tokens are ordinary text; texts are encoded
whole whatever their length; ties and repeated rows give equal ids; further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from graphloom.session import spread

#: Where the vocabulary files are; a parameter, never part of this repository.
TOKENIZER_DIR = os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the public split pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bounds of what a worker keeps: pieces of at most CACHED_CHARS characters, CACHED_PIECES of them.
CACHED_CHARS, CACHED_PIECES = 48, 400_000


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that JSON vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairEncoder:
    """Exact BPE ids in linear time; ids order the merges."""

    def __init__(self, tokens: list[bytes], halves: dict[int, tuple[int, int]] | None = None) -> None:
        import ahocorasick

        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.size = [len(t) for t in tokens]
        halves = self._derive_halves() if halves is None else halves
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.merged: dict[tuple[int, int], int] = {}
        for i, (a, b) in halves.items():
            self.left[i], self.right[i] = a, b
            self.merged[a, b] = i
        self.matcher = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.matcher.add_word(t.decode("latin-1"), i)
        self.matcher.make_automaton()
        self._shorter: dict[int, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, list[int]] = {}

    def _derive_halves(self) -> dict[int, tuple[int, int]]:
        """The last merge that makes each token, by plain BPE with the merges before it."""
        halves = {}
        for i, t in enumerate(self.tokens):
            if len(t) > 1:
                parts = [t[k : k + 1] for k in range(len(t))]
                while len(parts) > 2:
                    ranks = [self.ids.get(a + b, i) for a, b in zip(parts, parts[1:])]
                    k = min(range(len(ranks)), key=ranks.__getitem__)
                    if ranks[k] >= i:
                        break
                    parts[k : k + 2] = [parts[k] + parts[k + 1]]
                if len(parts) == 2:
                    halves[i] = (self.ids[parts[0]], self.ids[parts[1]])
        return halves

    def _compatible(self, a: int, b: int) -> bool:
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[a, b] = self._stands(a, b)
        return known

    def _stands(self, a: int, b: int) -> bool:
        """Whether BPE leaves a | b: undo the later of the two merges until both sides are single bytes at the border."""
        earliest = len(self.tokens) + 1
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < earliest:
                return False
            a_splits, b_splits = self.right[a] != a, self.left[b] != b
            if not a_splits and not b_splits:
                return True
            # On the left the merge that was undone must come after the one across; on the right, not before it.
            if a_splits and (a > b or not b_splits):
                earliest, a = a, self.right[a]
            else:
                earliest, b = b + 1, self.left[b]

    def _prefix(self, t: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        got = self._shorter.get(t)
        if got is None:
            b = self.tokens[t]
            got = next((self.ids[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.ids), -1)
            self._shorter[t] = got
        return got

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ids.get(data)
        if whole is not None and (len(data) == 1 or self.right[whole] != whole):
            return [whole]
        n, size = len(data), self.size
        longest = [-1] * n
        reach = [0] * n
        for end, t in self.matcher.iter(data.decode("latin-1")):
            start = end + 1 - size[t]
            if size[t] > reach[start]:
                reach[start], longest[start] = size[t], t
        usable = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, t = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while t >= 0 and not (usable[at + size[t]] and (last < 0 or self._compatible(last, t))):
                t = self._prefix(t)
            if t >= 0:
                out.append(t)
                at += size[t]
                t = longest[at] if at < n else -1
            else:
                usable[at] = 0
                if not out:
                    raise ValueError("no token sequence covers the piece")
                t = out.pop()
                at -= size[t]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens."""
        if not text:
            return []
        pieces, out = self._pieces, []
        for p in _split()(text):
            ids = pieces.get(p)
            if ids is None:
                ids = self.encode_bytes(p.encode())
                if len(p) <= CACHED_CHARS:
                    if len(pieces) >= CACHED_PIECES:
                        pieces.clear()
                    pieces[p] = ids
            out += ids
        return out

    def decode_table(self) -> tuple[bytes, np.ndarray]:
        """All token bytes in one buffer and where each token begins."""
        return b"".join(self.tokens), np.concatenate([[0], np.cumsum(self.size)])

    def decode(self, ids: list[int]) -> str:
        """Text of ids."""
        data, at = self.decode_table()
        return b"".join(data[at[i] : at[i + 1]] for i in ids).decode("utf-8", "replace")


@lru_cache(1)
def _split():
    import regex

    return regex.compile(PATTERN).findall


@lru_cache(4)
def load_encoder(name: str = "byte_bpe_50k.json", folder: str = TOKENIZER_DIR) -> BytePairEncoder:
    """The encoder of a vocabulary file: ``.json`` with merges or ``.tiktoken`` with ranks."""
    path = os.path.join(folder, name)
    if not os.path.exists(path):  # an executor without the folder has the file that was sent to it
        path = SparkFiles.get(name)
    if name.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ranked = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
        return BytePairEncoder([t for _, t in ranked])
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_letters()
    spoken = lambda t: bytes(letters[c] for c in t)
    special = {t for t in model["vocab"] if any(c not in letters for c in t) or (t.startswith("<|") and t.endswith("|>"))}
    by_id = {i: spoken(t) for t, i in model["vocab"].items() if t not in special}
    tokens = [by_id[i] for i in range(len(by_id))]
    halves = {}
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        halves[model["vocab"][a + b]] = (model["vocab"][a], model["vocab"][b])
    return BytePairEncoder(tokens, halves)


_SENT: set[tuple[str, str]] = set()


def _send(df: DataFrame, name: str, folder: str) -> None:
    """Send a vocabulary file to the executors once a context."""
    sc = df.sparkSession.sparkContext
    if (sc.applicationId, name) not in _SENT and os.path.exists(os.path.join(folder, name)):
        _SENT.add((sc.applicationId, name))
        sc.addFile(os.path.realpath(os.path.join(folder, name)))


def _encode_batches(batches: Iterator[pa.RecordBatch], name: str, folder: str, lengths_only: bool) -> Iterator[pa.RecordBatch]:
    enc = load_encoder(name, folder)
    for b in batches:
        keep = [b.column(i) for i in range(b.num_columns - 1)]
        names = b.schema.names[:-1]
        ids = [enc.encode(t) for t in b.column(b.num_columns - 1).to_pylist()]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        if lengths_only:
            yield pa.RecordBatch.from_arrays([*keep, pa.array(size)], names=[*names, "n_tokens"])
            continue
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*keep, lists], names=[*names, "ids"])


def encode_corpus(df: DataFrame, key_cols: list[str], text_col: str = "text", name: str = "byte_bpe_50k.json", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key_cols`` and ids (array<int>) of every row."""
    _send(df, name, folder)
    rows = df.select(*key_cols, F.col(text_col).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return spread(rows).mapInArrow(lambda it: _encode_batches(it, name, folder, False), f"{kept}, ids array<int>")


def token_lengths(df: DataFrame, key_cols: list[str], text_col: str = "text", name: str = "byte_bpe_50k.json", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key_cols`` and n_tokens (bigint) of every row."""
    _send(df, name, folder)
    rows = df.select(*key_cols, F.col(text_col).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return spread(rows).mapInArrow(lambda it: _encode_batches(it, name, folder, True), f"{kept}, n_tokens bigint")
