"""One consistent form for text that looks the same but is written with different characters.

Characters first: line ends and spaces become plain (a carriage return before a line feed is a plain line end: it is
written as a line feed, but makes no case), invisible characters go, presentation and width forms become
ordinary letters, letters and accents are joined, Persian words get the Persian letters. What visibly differs stays
(raised figures, the numero sign, typographic quotes and dashes, emoji), and so does the zero-width non-joiner inside
Persian words.

Then look-alike letters, by script-aware repair: the dominant script of a token that mixes scripts is that of its
unambiguous letters, or else of most letters, and look-alikes are replaced when the result is in the corpus vocabulary
(counts of all tokens of all rows); where it isn't, the other script's form is asked for. Three cases go beyond this, as
equal names must compare equal:

* a mixed token of which the vocabulary has neither form takes its dominant script;
* a token written wholly in look-alikes changes when the vocabulary holds its other form more often than its own, or
  when it has letters that no language here uses;
* ``script='latin'`` (names) fixes the target: Latin, except tokens of one Greek letter.

A small Greek letter that stands for itself next to Latin letters is only replaced for a vocabulary word. A letter with
an accent looks like the letter that its base looks like, with the same accent.

Defined results: null stays null and is no case; empty and blank texts are kept; texts are handled whole; spaces at the
ends are kept; repeated rows give equal results; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.session import cut, spread

#: Characters without a visible form.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
#: Look-alike letters, pairwise.
CYRILLIC, LATIN_OF_CYRILLIC = "АВЕЅІЈКМНОРСТХУҮԌаеосрухіѕјԁԛԝһ", "ABESIJKMHOPCTXYYGaeocpyxisjdqwh"
GREEK, LATIN_OF_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", "ABEZHIKMNOPTYXov"
SOFT_GREEK, LATIN_OF_SOFT = "αικρτυχγ", "aikptuxy"
#: Latin letters and their Russian look-alikes.
LATIN, CYRILLIC_OF_LATIN = "ABEKMHOPCTXYaeocpyx", "АВЕКМНОРСТХУаеосрух"
#: Cyrillic letters that Russian doesn't use.
NOT_RUSSIAN = set("ЅІЈѕіјҮԌԁԛԝһ")
#: Arabic letters and the Persian ones that look the same.
ARABIC, PERSIAN = "يكىەہھ٠١٢٣٧٨٩", "یکیههه۰۱۲۳۷۸۹"


@lru_cache(1)
def _table() -> dict[int, str]:
    """Character -> its ordinary form."""
    table = {ord(c): "" for c in INVISIBLE}
    table |= {o: " " for o in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
    table |= {o: "\n" for o in (0x0B, 0x0C, 0x85, 0x2028, 0x2029)}
    table |= {ord(a): b for a, b in zip(ARABIC, PERSIAN)}
    table |= {0x2010: "-", 0x2011: "-"}
    forms = [(0xFF01, 0xFFEE), (0xFB00, 0xFB06), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0x2160, 0x217F), (0x1D400, 0x1D7FF), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3)]
    for lo, hi in forms:
        for o in range(lo, hi + 1):
            k = unicodedata.normalize("NFKC", chr(o))
            if k != chr(o):
                table[o] = k.translate({ord(a): b for a, b in zip(ARABIC, PERSIAN)}).replace("ـ", "")
    return table


@lru_cache(1)
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    bad = re.compile("[\r" + "".join(re.escape(chr(o)) for o in _table() if o <= 0xFFFF) + "]")  # wider ones would make it slow
    stray = re.compile("(?<![ؠ-ۿ])‌+|‌+(?![ؠ-ۿ])|(?<=‌)‌+")
    emoji = re.compile("(?<=[☀-➿\U0001f000-\U0001faff️])‍(?=[☀-➿\U0001f000-\U0001faff])")
    return bad, stray, emoji


def plain_characters(s: str) -> str:
    """``s`` with ordinary characters, before any look-alike letters are repaired."""
    bad, stray, emoji = _patterns()
    if s.isascii():
        return s.replace("\r\n", "\n").replace("\r", "\n") if bad.search(s) else s
    if bad.search(s) or max(s) > "\uffff":
        s = s.replace("\r\n", "\n").replace("\r", "\n")
        if "‍" in s:
            s = emoji.sub("", s)
        s = s.translate(_table()).replace("", "‍")
    if not unicodedata.is_normalized("NFC", s):
        s = unicodedata.normalize("NFC", s)
    return stray.sub("", s) if "‌" in s else s


_L, _CG = "A-Za-zÀ-ÖØ-öø-ɏ", "Ͱ-ϿЀ-ԯ"
_BORDER = re.compile(f"[{_L}][0-9]*(?=[{_CG}])|[{_CG}][0-9]*(?=[{_L}])|[Ͱ-Ͽ](?=[Ѐ-ԯ])|[Ѐ-ԯ](?=[Ͱ-Ͽ])")
_WHOLE = re.compile(f"(?<![^\\W_])(?=[{CYRILLIC}{GREEK}])[{CYRILLIC}{GREEK}0-9]+(?![^\\W_])|(?<![^\\W_])[{LATIN}]{{2,}}[0-9]*(?![^\\W_])")
_WORD = re.compile(r"[^\W_]+")
_FOREIGN = re.compile(f"[{_CG}]")


def _accented(table: dict[int, str], lo: int, hi: int) -> dict[int, str]:
    """``table`` with the characters of a range whose base letter it has, accents kept."""
    out = dict(table)
    for o in range(lo, hi):
        base, *marks = unicodedata.normalize("NFD", chr(o))
        if marks and ord(base) in table and len(c := unicodedata.normalize("NFC", table[ord(base)] + "".join(marks))) == 1:
            out.setdefault(o, c)
    return out


_TO_LATIN = _accented({ord(a): b for a, b in zip(CYRILLIC + GREEK, LATIN_OF_CYRILLIC + LATIN_OF_GREEK)}, 0x370, 0x530)
_SOFTLY = _accented(_TO_LATIN | {ord(a): b for a, b in zip(SOFT_GREEK, LATIN_OF_SOFT)}, 0x370, 0x530)
_TO_CYRILLIC = {ord(a): b for a, b in zip(LATIN, CYRILLIC_OF_LATIN)} | {ord("Ë"): "Ё", ord("ë"): "ё"}
_TO_CYRILLIC |= {g: _TO_CYRILLIC[ord(c)] for g, c in ((ord(a), b) for a, b in zip(GREEK, LATIN_OF_GREEK)) if ord(c) in _TO_CYRILLIC}


def script(c: str) -> str:
    """l, g, c or nothing."""
    if "Ͱ" <= c <= "Ͽ":
        return "g" if c.isalpha() else ""
    if "Ѐ" <= c <= "ԯ":
        return "c"
    return "l" if c.isalpha() and c < "ɐ" else ""


def forms(token: str, names: bool) -> tuple[str, str | None, str | None, str | None] | None:
    """(kind, form in the dominant script, form in the other, form without vocabulary) of a token that may need repair, or None."""
    return _forms(token, names) if len(token) <= 64 else _forms.__wrapped__(token, names)


def _only(form: str, other: str) -> str | None:
    """``form`` if it has no letter of the ``other`` scripts."""
    return None if any(script(c) in other for c in form if script(c)) else form


@lru_cache(100_000)
def _forms(token: str, names: bool) -> tuple[str, str | None, str | None, str | None] | None:
    letters = [c for c in token if script(c)]
    scripts = {script(c) for c in letters}
    if not letters or scripts == {"l"} and names:
        return None
    if scripts == {"g"} and len(letters) == 1:
        return None
    lat, cyr = _only(token.translate(_TO_LATIN), "gc"), _only(token.translate(_TO_CYRILLIC), "gl")
    soft = lat or _only(token.translate(_SOFTLY), "gc")
    if names:
        return ("mixed", soft, None, lat)
    if len(scripts) > 1:
        own_l = sum(1 for c in letters if script(c) == "l" and ord(c) not in _TO_CYRILLIC)
        own_c = sum(1 for c in letters if script(c) == "c" and ord(c) not in _TO_LATIN)
        n_l, n_c = sum(script(c) == "l" for c in letters), sum(script(c) == "c" for c in letters)
        if own_l > own_c or own_l == own_c and n_l >= n_c:
            return ("mixed", soft, cyr, lat or cyr)
        return ("mixed", cyr, soft, cyr or lat)
    if len(token) < 2:
        return None
    if scripts == {"l"}:
        return ("whole", None, cyr, None) if cyr and cyr != token else None
    return ("whole", None, lat, lat if NOT_RUSSIAN & set(letters) else None) if lat and lat != token else None


def open_tokens(s: str, names: bool) -> set[str]:
    """Tokens of ``s`` that may hold look-alikes."""
    if s.isascii() or not _FOREIGN.search(s):
        return set()
    if names:
        return {w for w in _WORD.findall(s) if not w.isascii() and forms(w, True)}
    found = {w for w in _WHOLE.findall(s) if forms(w, False)}
    done = 0
    for m in _BORDER.finditer(s):
        a, b = m.start(), m.end()
        if a < done:  # the same token
            continue
        while a > 0 and (s[a - 1].isalnum()):
            a -= 1
        while b < len(s) and s[b].isalnum():
            b += 1
        done = b
        if forms(s[a:b], False):
            found.add(s[a:b])
    return found


def rewrite(s: str, change: dict[str, str]) -> str:
    """``s`` with whole tokens replaced."""
    return _WORD.sub(lambda m: change.get(m.group(), m.group()), s) if change else s


_FIELDS = ("token", "kind", "main", "other", "alone")
_SURVEY = f"key bigint, changed boolean, open array<struct<{','.join(f'{f}:string' for f in _FIELDS)}>>, token string, n bigint"
#: Most tokens whose repairs are sent to the tasks (at most a few megabytes); beyond it they are joined.
SENT_TOKENS = 50_000
_HELD_TOKENS = 200_000


def plain_case(text: str, plain: str) -> bool:
    """Whether a text's characters make it a case."""
    return text != plain and text.replace("\r\n", "\n") != plain


def _survey_batches(batches: Iterator[pa.RecordBatch], names: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("changed", pa.bool_()), ("open", pa.list_(pa.struct([(f, pa.string()) for f in _FIELDS]))), ("token", pa.string()), ("n", pa.int64())])
    held: Counter = Counter()

    def counts() -> pa.RecordBatch:
        words, n = list(held.keys()), list(held.values())
        held.clear()
        none = [pa.nulls(len(words), f.type) for f in schema][:3]
        return pa.RecordBatch.from_arrays([*none, pa.array(words, pa.string()), pa.array(n, pa.int64())], schema=schema)

    for b in batches:
        rows = []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not text:
                continue
            plain = plain_characters(text)
            held.update(_WORD.findall(plain))
            changed, opens = plain_case(text, plain), sorted(open_tokens(plain, names))
            if changed or opens:
                rows.append((key, changed, [dict(zip(_FIELDS, (w, *forms(w, names)))) for w in opens]))
        cols = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([*(pa.array(list(c), f.type) for c, f in zip(cols, schema)), pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), pa.int64())], schema=schema)
        if len(held) > _HELD_TOKENS:
            yield counts()
    yield counts()


def _source(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))


class Survey:
    """One reading of a table's texts, written once: rows that may be cases, with their open tokens, and token counts."""

    def __init__(self, df: DataFrame, key: str, text: str, names: bool = False) -> None:
        self.names, self.source = names, _source(df, key, text)
        self.rows = cut(spread(self.source).mapInArrow(lambda it: _survey_batches(it, names), _SURVEY))

    def opens(self) -> DataFrame:
        return self.rows.where("size(open) > 0").select("key", F.lit(self.names).alias("names"), F.explode("open").alias("o")).select("key", "names", "o.*")


def vocabulary(surveys: list[Survey]) -> DataFrame:
    """(token, n) over all rows of all sources."""
    return reduce(DataFrame.unionByName, [s.rows.where("token is not null").select("token", "n") for s in surveys]).groupBy("token").agg(F.sum("n").alias("n"))


def decisions(surveys: list[Survey]) -> DataFrame:
    """(names, token, repaired) of the distinct open tokens that change, by the vocabulary of all surveys."""
    given = ["names", *_FIELDS]
    asked = reduce(DataFrame.unionByName, [s.opens().drop("key") for s in surveys]).distinct()
    form = F.explode(F.array_distinct(F.array_compact(F.array("token", "main", "other"))))
    counted = asked.select("*", form.alias("form")).join(vocabulary(surveys).withColumnRenamed("token", "form"), "form", "left")
    n = lambda c: F.coalesce(F.max(F.when(F.col("form") == F.col(c), F.col("n"))), F.lit(0))
    found = counted.groupBy(*given).agg(n("token").alias("n_own"), n("main").alias("n_main"), n("other").alias("n_other"))
    mixed = F.when(F.col("n_main") > 0, F.col("main")).when(F.col("n_other") > 0, F.col("other")).otherwise(F.col("alone"))
    whole = F.when(F.col("alone").isNotNull(), F.col("alone")).when(F.col("n_other") > F.col("n_own"), F.col("other"))
    return found.select("names", "token", F.when(F.col("kind") == "mixed", mixed).otherwise(whole).alias("repaired")).where("repaired is not null and repaired <> token")


def inconsistent_rows(surveys: dict[str, Survey]) -> DataFrame:
    """(tbl, key) of rows whose text isn't in the consistent form."""
    change = cut(decisions(list(surveys.values())).select("names", "token"))
    parts = []
    for tbl, s in surveys.items():
        repaired = s.opens().join(change, ["names", "token"], "left_semi").select("key")
        parts.append(s.rows.where("changed").select("key").unionByName(repaired).distinct().select(F.lit(tbl).alias("tbl"), "key"))
    return reduce(DataFrame.unionByName, parts)


def _rewritten(batches: Iterator[pa.RecordBatch], change_of) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got, flags = [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            new = plain = None if text is None else plain_characters(text)
            if plain and (change := change_of(b, i, plain)):
                new = rewrite(plain, change)
            got.append(new)
            flags.append(text is not None and (plain_case(text, plain) or new != plain))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string()), pa.array(flags)], names=["key", "text", "changed"])


def consistent(survey: Survey, others: list[Survey] = ()) -> DataFrame:
    """(key, text, changed) of every row in its consistent form; ``others`` lend their words to the vocabulary.

    The repairs are sent to the tasks while they are few, so that texts are not shuffled; else they are joined by key.
    """
    names = survey.names
    change = cut(decisions([survey, *others]).where(F.col("names") == names).select("token", "repaired"))
    out = "key bigint, text string, changed boolean"
    if change.count() <= SENT_TOKENS:
        known = survey.source.sparkSession.sparkContext.broadcast({r.token: r.repaired for r in change.collect()})

        def sent(b: pa.RecordBatch, i: int, plain: str) -> dict[str, str]:
            return {w: known.value[w] for w in open_tokens(plain, names) if w in known.value}

        return spread(survey.source).mapInArrow(lambda it: _rewritten(it, sent), out)
    by_key = survey.opens().select("key", "token").distinct().join(change, "token").groupBy("key").agg(F.collect_list(F.struct("token", "repaired")).alias("change"))

    def joined(b: pa.RecordBatch, i: int, plain: str) -> dict[str, str]:
        return {e["token"]: e["repaired"] for e in b.column(2)[i].as_py() or ()}

    return survey.source.join(by_key, "key", "left").select("key", "text", "change").mapInArrow(lambda it: _rewritten(it, joined), out)
