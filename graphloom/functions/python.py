"""Functions that no built-in expression gives, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Spelled Greek letters and Roman numerals of entity names.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "κ": "kappa", "μ": "mu", "π": "pi"}
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "ix": "9", "x": "10"}


def entity_form(name: str | None) -> str:
    """Comparable form of an entity name."""
    if not name:
        return ""
    s = "".join(GREEK.get(c, c) for c in unicodedata.normalize("NFKC", name).lower())
    s = " ".join(ROMAN.get(w, w) for w in s.split(" "))
    return " ".join(re.sub(r"[()\[\]{},.;:/\\_-]+", " ", s).split())


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    if len(a) < len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    for c in a:
        m = row & at.get(c, 0)
        row = (row + m | row - m) & full
    return len(b) - row.bit_count()


def entity_similarity(a: str | None, b: str | None) -> float:
    """0.55 of the characters' Jaccard similarity and 0.45 of the common subsequence; 1 for equal forms."""
    x, y = entity_form(a), entity_form(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    u, v = set(x), set(y)
    return 0.55 * len(u & v) / len(u | v) + 0.45 * common_subsequence(x, y) / max(len(x), len(y))


def _coded(forms: list[str], chars: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters as numbers (filled up with one that no form has), lengths, and the count of each character."""
    n = np.array([len(x) for x in forms])
    codes = np.full((len(forms), n.max()), len(chars), np.int32)
    for i, x in enumerate(forms):
        codes[i, : len(x)] = [chars[c] for c in x]
    bags = np.zeros((len(forms), len(chars) + 1), np.int32)
    np.add.at(bags, (np.arange(len(forms))[:, None], codes), 1)
    return codes, n, bags[:, :-1]


def _common_subsequences(x: list[str], y: list[str], i: np.ndarray, j: np.ndarray, cx: np.ndarray, cy: np.ndarray, width: int) -> np.ndarray:
    """``common_subsequence`` of x[i] and y[j], many pairs a step; forms longer than a word of bits go one by one."""
    out = np.zeros(len(i), np.int64)
    short = np.array([len(s) <= 64 for s in x])
    at = np.zeros((len(x), width + 1), np.uint64)
    for p in range(min(64, cx.shape[1])):
        at[np.arange(len(x)), cx[:, p]] |= np.uint64(1) << np.uint64(p)
    at[:, width] = 0
    for begin in range(0, len(i), 1 << 16):
        a, b = i[begin : begin + (1 << 16)], j[begin : begin + (1 << 16)]
        row = np.full(len(a), ~np.uint64(0))
        for p in range(cy.shape[1]):
            m = row & at[a, cy[b, p]]
            row = (row + m) | (row - m)
        out[begin : begin + len(a)] = np.bitwise_count(~row)
    for k in np.nonzero(~short[i])[0]:
        out[k] = common_subsequence(x[i[k]], y[j[k]])
    return out


def similar_pairs(x: list[str], y: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of all x[i], y[j] with ``entity_similarity`` >= threshold.

    The characters two forms have in common, repeats counted, bound their common subsequence; only pairs that this bound
    lets through get the exact test, so none is lost.
    """
    x, y = [entity_form(s) for s in x], [entity_form(s) for s in y]
    chars = {c: n for n, c in enumerate(sorted(set().union(*x, *y)))}
    none = np.zeros(0, np.int64)
    if not chars:
        return none, none, np.zeros(0)
    (cx, nx, bx), (cy, ny, by) = _coded(x, chars), _coded(y, chars)
    common = both = (bx > 0).astype(np.float32) @ (by > 0).astype(np.float32).T
    for level in range(2, min(bx.max(), by.max()) + 1):
        common = common + (bx >= level).astype(np.float32) @ (by >= level).astype(np.float32).T
    ux, uy = (bx > 0).sum(1), (by > 0).sum(1)
    most = 0.55 * both / np.maximum(1, ux[:, None] + uy[None, :] - both) + 0.45 * common / np.maximum(1, np.maximum(nx[:, None], ny[None, :]))
    i, j = np.nonzero((most >= threshold - 1e-4) & (nx[:, None] > 0) & (ny[None, :] > 0))
    shared = both[i, j].astype(np.int64)
    lcs = _common_subsequences(x, y, i, j, cx, cy, len(chars))
    exact = 0.55 * shared / (ux[i] + uy[j] - shared) + 0.45 * lcs / np.maximum(nx[i], ny[j])
    same = np.array([x[p] == y[q] for p, q in zip(i, j)], bool)
    exact = np.where(same, 1.0, exact)
    kept = exact >= threshold
    return i[kept], j[kept], exact[kept]


def close_pairs(x: list[str], y: list[str], share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, edits) of all x[i], y[j] at most ``share`` of the longer one's length in edits apart; ``y`` is of one length.

    An edit makes up for one character at most, so the longer length less the characters two have in common, repeats
    counted, bounds their edits; only pairs that this bound lets through are compared, many a step, by columns of bits.
    What is longer than a word of bits isn't compared: these pairs come with -1.
    """
    chars = {c: n for n, c in enumerate(sorted(set().union(*x, *y)))}
    (cx, nx, bx), (cy, ny, by) = _coded(x, chars), _coded(y, chars)
    levels = range(1, min(bx.max(), by.max()) + 1)
    ux, uy = (np.concatenate([b >= level for level in levels] or [b > b], axis=1) for b in (bx, by))
    shared = ux.any(0) & uy.any(0)
    longer = np.maximum(nx, ny[0])
    most = np.floor(share * longer + 1e-9).astype(np.int64)
    i, j = np.nonzero(ux[:, shared].astype(np.float32) @ uy[:, shared].astype(np.float32).T >= (longer - most)[:, None].astype(np.float32))
    at = np.zeros((len(x), len(chars) + 1), np.uint64)
    for p in range(min(64, cx.shape[1])):
        at[np.arange(len(x)), cx[:, p]] |= np.uint64(1) << np.uint64(p)
    edits, one = np.full(len(i), -1, np.int64), np.uint64(1)
    short = np.nonzero(nx[i] <= 64)[0]
    for begin in range(0, len(short), 1 << 14):
        k = short[begin : begin + (1 << 14)]
        a, b = i[k], j[k]
        up, down = np.full(len(k), ~np.uint64(0)), np.zeros(len(k), np.uint64)
        for p in range(cy.shape[1]):
            eq = at[a, cy[b, p]]
            across = ((eq & up) + up ^ up) | eq
            rise, fall = (down | ~(across | up)) << one | one, (up & across) << one
            eq |= down
            up, down = fall | ~(eq | rise), rise & eq
        own = ~np.uint64(0) >> (64 - nx[a]).astype(np.uint64)
        edits[k] = ny[0] + np.bitwise_count(up & own).astype(np.int64) - np.bitwise_count(down & own)
    kept = edits <= most[i]
    return i[kept], j[kept], edits[kept]


@F.pandas_udf(StringType())
def entity_form_udf(s: pd.Series) -> pd.Series:
    return s.map(entity_form)


@F.pandas_udf(DoubleType())
def entity_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([entity_similarity(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two strings; null counts as empty."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


class _Main(HTMLParser):
    """Text of the headings, longer paragraphs and list items outside navigation."""

    DROP = {"script", "style", "nav", "aside", "header", "footer", "form", "noscript"}
    LEAST = {"p": 30, "li": 10}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.block, self.parts, self.out = 0, "", [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.DROP:
            self.skip += 1
        elif tag in ("p", "li") or re.fullmatch("h[1-6]", tag):
            self._end()
            self.block = tag

    def handle_endtag(self, tag):
        if tag in self.DROP:
            self.skip = max(0, self.skip - 1)
        elif tag == self.block:
            self._end()

    def handle_data(self, data):
        if not self.skip and self.block:
            self.parts.append(data)

    def _end(self) -> None:
        s = " ".join("".join(self.parts).split())
        if len(s) > self.LEAST.get(self.block, 0):
            self.out.append(s)
        self.block, self.parts = "", []


def html_text(html: str | None) -> str | None:
    """Main text of a page, blocks on lines of their own; null of null."""
    if html is None:
        return None
    p = _Main()
    p.feed(html)
    p.close()
    p._end()
    return "\n".join(p.out)


@F.pandas_udf(StringType())
def html_text_udf(s: pd.Series) -> pd.Series:
    return s.map(html_text, na_action="ignore")


def loose_json(s: str | None) -> str | None:
    """The JSON object in a model's answer: without fences, comments and trailing commas; null if there is none."""
    import json

    if not s:
        return None
    s = re.sub(r"```(?:json)?", "", s)
    a, b = s.find("{"), s.rfind("}")
    if a < 0 or b < a:
        return None
    s = re.sub(r",\s*([}\]])", r"\1", re.sub(r"(?m)(?<!:)//.*$", "", s[a : b + 1]))
    try:
        return json.dumps(json.loads(s), sort_keys=True, ensure_ascii=False)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def loose_json_udf(s: pd.Series) -> pd.Series:
    return s.map(loose_json, na_action="ignore")


_END = re.compile(r"(?<=[.!?؟])\s+")


def _sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _END.split(text)) if s]


def _tokens(text: str) -> int:
    return int(len(text.split()) * 1.33)


def _packed(parts: list[str], most: int) -> list[str]:
    """Greedy packing of parts; a larger part stands alone."""
    out, held, n = [], [], 0
    for p in parts:
        t = _tokens(p)
        if held and n + t > most:
            out.append(" ".join(held))
            held, n = [], 0
        held.append(p)
        n += t
    return [*out, " ".join(held)] if held else out


def smart_chunks(text: str | None, most: int) -> list[str]:
    """Paragraphs as chunks; one of more than ``most`` estimated tokens is cut at its sentences."""
    if not text or not text.strip():
        return []
    out = []
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if p:
            out += [p] if _tokens(p) <= most else _packed(_sentences(p), most)
    return out


def window_chunks(text: str | None, most: int, ratio: float) -> list[str]:
    """Windows of whole sentences of at most ``most`` tokens; each begins with the last sentences of the one before, up to
    a share of its size. A sentence that is too large is a window of its own; every window takes a new sentence."""
    if not text or not text.strip():
        return []
    parts, out, last, i = _sentences(text), [], [], 0
    while i < len(parts):
        held, n = [], 0
        for s in reversed(last):
            if n >= int(most * ratio):
                break
            held.insert(0, s)
            n += _tokens(s)
        if n + _tokens(parts[i]) > most:  # no room beside what overlaps
            held, n = [], 0
        fresh = i
        while i < len(parts) and (i == fresh or n + _tokens(parts[i]) <= most):
            held.append(parts[i])
            n += _tokens(parts[i])
            i += 1
        out.append(" ".join(held))
        last = held
    return out


def chunks_udf(strategy: str, most: int, ratio: float = 0.2):
    """Column function: array of chunks by ``smart`` or ``window``."""
    if strategy not in ("smart", "window"):
        raise ValueError(f"strategy {strategy!r} is none of smart, window")
    cut = (lambda t: smart_chunks(t, most)) if strategy == "smart" else (lambda t: window_chunks(t, most, ratio))
    return F.pandas_udf(lambda s: s.map(lambda t: cut(None if t is None or t != t else t)), "array<string>")


class _Wiki(HTMLParser):
    """Infobox, categories, links and sections of an encyclopedia page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.infobox: list[tuple[str, str]] = []
        self.categories: list[str] = []
        self.links: list[str] = []
        self.sections: list[list] = []
        self.table, self.cell, self.data, self.row, self.heading, self.block = 0, "", [], {}, "", ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.table += "infobox" in (a.get("class") or "") or self.table > 0
        elif self.table and tag in ("th", "td"):
            self.cell, self.data = tag, []
        elif tag in ("h2", "h3", "p", "li") and not self.table:
            self.block, self.data = tag, []
        elif tag == "a" and (a.get("href") or "").startswith("/wiki/"):
            name = a["href"][6:].split("#")[0].replace("_", " ")
            if name.startswith("Category:"):
                self.categories.append(name[9:])
            elif ":" not in name and name and name not in self.links:
                self.links.append(name)

    def handle_endtag(self, tag):
        text = " ".join("".join(self.data).split())
        if tag == "table":
            self.table = max(0, self.table - 1)
        elif self.table and tag == self.cell:
            self.row[tag], self.cell, self.data = text, "", []
        elif self.table and tag == "tr":
            if self.row.get("th") and self.row.get("td"):
                self.infobox.append((self.row["th"], self.row["td"]))
            self.row = {}
        elif tag == self.block and not self.table:
            text = re.sub(r"\[(?:\d+|edit)\]", "", text).strip()
            if tag in ("h2", "h3"):
                self.sections.append([text, []])
            elif len(text) > (20 if tag == "p" else 10):
                if not self.sections:
                    self.sections.append(["", []])
                self.sections[-1][1].append(text if tag == "p" else "• " + text)
            self.block, self.data = "", []

    def handle_data(self, data):
        if self.cell or self.block:
            self.data.append(data)


def wiki_parts(html: str | None, most_links: int = 100) -> dict | None:
    """Infobox pairs, categories, the first distinct links and sections (heading, text) of a page; null of null.

    ``most_links`` is how many links the result names, as the feature asks.
    """
    if html is None:
        return None
    p = _Wiki()
    p.feed(html)
    p.close()
    return {"infobox": dict(p.infobox), "categories": list(dict.fromkeys(p.categories)), "links": p.links[:most_links], "sections": [{"heading": h, "text": "\n".join(x)} for h, x in p.sections if x]}


def wiki_parts_udf():
    """Column function of ``wiki_parts``."""
    kind = "struct<infobox:map<string,string>,categories:array<string>,links:array<string>,sections:array<struct<heading:string,text:string>>>"
    return F.udf(wiki_parts, kind, useArrow=True)


def model_udf(score, kind: str = "double"):
    """Hook for a model: a function from a list of inputs to a list of outputs, applied to Arrow batches of a column."""
    return F.pandas_udf(lambda s: pd.Series(score(s.tolist())), kind)
