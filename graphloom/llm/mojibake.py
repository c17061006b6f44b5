"""Garbled text from wrong character encodings: round-trip repair with a garbling cost.

A text (or a stretch of it) is re-encoded under a legacy encoding and strictly decoded as the intended one. Layers are
undone one after the other while the garbling cost drops, so text that was garbled twice comes back in two steps.

* Multi-byte layers (UTF-8 read as a legacy encoding) are found locally: a stretch of characters whose legacy bytes
  form whole UTF-8 sequences. The first accepted stretch needs evidence of its own, a drop of the cost around it; further
  stretches of the same layer in the same text then only need to decode to plausible characters.
* Single-byte layers (one legacy encoding read as another) always decode, so words decide: the words with non-ASCII
  characters of each sentence are converted, and the change is kept where their cost drops by more than a margin.

The cost counts what clean text of any of the supported scripts does not show: control characters of the C1 range,
symbols glued to letters, letters of two scripts side by side, capital letters behind small ones, letters that are rare
in their script. For single-byte layers it adds the improbability of letters under the small fixed profiles below.

Defined results: a null text is no case; an empty text is no case; texts are handled whole; a replacement character
U+FFFD marks a text whose bytes were lost in decoding (found, not restorable); repeated rows give equal results; further
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.session import spread

#: Legacy encodings under which UTF-8 may have been read, the usual ones first.
LEGACY = ("cp1252", "latin_1", "mac_roman", "cp1251", "cp1256", "cp437", "cp850", "cp1250", "koi8_r", "cp866", "iso8859_2", "cp1253", "cp1254", "mac_cyrillic")
#: (read as, written as) of single-byte layers.
SINGLE = (
    ("latin_1", "cp1251"), ("cp1252", "cp1251"), ("latin_1", "koi8_r"), ("cp1252", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("mac_cyrillic", "cp1251"), ("cp1252", "cp866"), ("cp437", "cp866"), ("mac_roman", "cp1251"),
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1251", "cp1252"), ("cp1253", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"),
    ("cp1252", "cp1256"), ("latin_1", "cp1256"), ("cp1251", "cp1256"), ("cp437", "cp1256"), ("mac_roman", "cp1256"),
    ("cp1256", "cp1252"),
)
#: Longest word whose cost a worker remembers.
LONG_WORD = 64
#: Cost that a character may add when a proven layer is taken to hold for it, too.
SLACK = 0.5


@lru_cache(None)
def to_byte(name: str) -> dict[str, int]:
    """Character -> byte; bytes that the encoding leaves undefined stand for the control character of the same number."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@lru_cache(None)
def from_byte(name: str) -> list[str]:
    """Byte -> character."""
    back = {b: c for c, b in to_byte(name).items()}
    return [back.get(b, "�") for b in range(256)]


@lru_cache(None)
def stretches(name: str) -> re.Pattern:
    """Characters whose bytes under ``name`` form whole multi-byte UTF-8 sequences."""
    of = from_byte(name)

    def chars(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(c) for c in of[lo : hi + 1]) + "]"

    c = chars(0x80, 0xBF)
    return re.compile(f"(?:{chars(0xC2, 0xDF)}{c}|{chars(0xE1, 0xEF)}{c}{c}|{of[0xE0]}{chars(0xA0, 0xBF)}{c}|{chars(0xF0, 0xF4)}{c}{c}{c})+")


#: Characters that clean text glues to no letter in front of them.
_GLUED = "¡¢£¤¥¦§¨©ª¬¯°±´µ¶·¸º¼½¾¿ƒˆˇ˘˙˚˛˜˝‚„†‡•‰‹€∂∆∏∑√∞∫≈≠≤≥◊⌐∙⌠⌡"
_BOXES = "─-▟■"
#: Cyrillic letters outside the Russian alphabet.
_RARE_CYR = "ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЇІіґєјЅѕї"
_RARE_ARA = "ٹڈڑںھہےۂۀؤإأٱًٌٍَُِّْةيىك"
_ODD = [
    (re.compile("[\x80-\x84\x86-\x9f]"), 2),
    (re.compile(f"(?<=[^\\W\\d_])[{re.escape(_GLUED)}┌-▟■]|[{re.escape('ƒ†‡‰‹€√∂∫∞≤≥¬¢£¥¤¦¨©ª®¯´¶·¸º¼½¾˜ˆ˙˚˘˛˝ˇ')}┌-▟■](?=[^\\W\\d_])"), 1),
    (re.compile(f"[{re.escape(_GLUED + 'ÂÃÐÑØÙÎÏâîïãåð')}╨╤╪┬](?=[{re.escape(_GLUED + '“”’‘–—»«ÂÃ³²¹')}{_BOXES}])|├(?=[^─\\s├])"), 1),
    (re.compile("(?<=[A-Za-zÀ-ɏ])[Ѐ-ӿ؀-ۿ]|(?<=[Ѐ-ӿ])[A-Za-zÀ-ɏ؀-ۿ]|(?<=[؀-ۿ])[A-Za-zÀ-ɏЀ-ӿ]"), 1),
    (re.compile(r"(?<=[a-zß-öø-ÿа-я])[À-ÖØ-ÞА-ЯЀ-Џ]|(?<=[À-ÖØ-Þ][À-ÖØ-Þ])[à-öø-ÿ]"), 1),
    (re.compile(f"(?<=[А-я])[{_RARE_CYR}]|[{_RARE_CYR}](?=[А-я])"), 1),
    (re.compile("[ÃÂ](?=[ -¿\u0080-\u009f])|[ÐÑ][ -¿\u0080-\u009fÐÑ‚-™]|[ØÙÚÛ][ -¿\u0080-\u009fØÙÚÛ‚-™]"), 2),
]
_ANY_ODD = re.compile("|".join(p.pattern for p, _ in _ODD))


def cost(s: str) -> int:
    """What of ``s`` clean text does not show."""
    return sum(w * len(p.findall(s)) for p, w in _ODD)


#: Letters of the six languages, of Greek symbols and accents of names, and the usual typographic signs.
_LETTERS = "éèàùâêîôûçëïüñáíóúäößœåšÉÈÀÂÊÎÔÇÑÁÍÓÚÄÖÜαβγδωабвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁاینردهمتوبسشکزلگفخعقجپحآصچطذضژظغثئءأؤ"
_TYPOGRAPHY = "¿¡«»°±،؛؟’“”—–…•№‌"
#: Blocks of what clean text of any script may hold and legacy encodings mostly lack: raised and lowered
#: figures, arrows, pictographs.
_PICTURES = "\u00b2\u2070-\u209c\u2190-\u2193\u2600-\u27bf\ufe0f\U0001f000-\U0001faff"
_UNCOMMON = re.compile(f"[^\\x00-\\x7f{_LETTERS}{_TYPOGRAPHY}{_PICTURES}]")


def score(s: str) -> int:
    """Cost and the number of rare characters."""
    return 2 * cost(s) + len(_UNCOMMON.findall(s))


_FINE_SYMBOLS = set(" ​‌‍‎‏  ﻿­")


@lru_cache(65536)
def plausible(ch: str) -> bool:
    """Whether a decoded character may stand in the texts of this corpus."""
    o = ord(ch)
    if ch in _FINE_SYMBOLS or 0xA1 <= o <= 0x17F or 0x218 <= o <= 0x21B or 0x391 <= o <= 0x3C9 or 0x401 <= o <= 0x45F or o in (0x490, 0x491):
        return True
    if 0x600 <= o <= 0x6FF:
        return ch in "،؛؟ءآأؤإئابةتثجحخدذرزسشصضطظعغـفقكلمنهوىيًٌٍَُِّْ٠١٢٣٤٥٦٧٨٩٪٫٬پچژکگیۀۀ۰۱۲۳۴۵۶۷۸۹"
    if o < 0xA1:
        return 0x80 <= o  # a control character of a further layer
    if o in (0x2C6, 0x2C7, 0x192, 0x402) or 0x2D8 <= o <= 0x2DD:  # signs of the legacy encodings
        return True
    blocks = ((0x1E00, 0x1EFF), (0x2010, 0x2044), (0x2070, 0x209C), (0x20A0, 0x20BF), (0x2100, 0x218F), (0x2190, 0x22FF), (0x2300, 0x23FF), (0x2500, 0x27BF), (0x3000, 0x9FFF), (0xAC00, 0xD7A3), (0x900, 0xE7F), (0xFB00, 0xFEFF), (0x1F000, 0x1FAFF))
    return any(x <= o <= y for x, y in blocks) and unicodedata.category(ch) not in ("Cn", "Co", "Cs", "Cc")


def _is_arabic(s: str) -> bool:
    return all("\u0600" <= c <= "ۿ" for c in s)


def _decoded(s: str, name: str) -> str | None:
    table = to_byte(name)
    try:
        out = bytes(table[c] for c in s).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None
    if not all(map(plausible, out)) or _is_arabic(s) and not _is_arabic(out):
        return None
    return out


def undo_multibyte(text: str) -> str | None:
    """One multi-byte layer less, or None."""
    best: tuple[tuple[int, int], str] | None = None
    for name in LEGACY:
        found = [(m.start(), m.end(), d) for m in stretches(name).finditer(text) if (d := _decoded(m.group(), name)) is not None]
        if not found:
            continue
        proof = 0
        for a, b, d in found:
            left, right = text[max(0, a - 2) : a], text[b : b + 2]
            if not _is_arabic(text[a:b]):
                proof = max(proof, score(left + text[a:b] + right) - score(left + d + right))
            if proof > 0:
                break
        if proof <= 0:
            continue
        out, at = [], 0
        for a, b, d in found:
            out += [text[at:a], d]
            at = b
        out.append(text[at:])
        new = "".join(out)
        drop, covered = score(text) - score(new), sum(b - a for a, b, _ in found)
        if drop > 0 and (best is None or (covered, drop) > best[0]):  # the true layer explains most characters
            best = ((covered, drop), new)
    return best[1] if best else None


#: Letters of Russian from frequent to rare, of Persian likewise, and the accented small letters of the
#: Latin-script languages here.
_RUS = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
_PER = "اینردهمتوبسشکزلگفخعقجپحآصچطذضژظغثئءأؤ"
_LAT = "éèàùâêîôûçëïüñáíóúäößœåšøæìòõãýÿÉÈÀÙÂÊÎÔÛÇËÏÜÑÁÍÓÚÄÖŒÅŠØÆÌÒÕÃ"
_WORDS = re.compile("[^\\s,.;:()!?\"]+")
_HIGH = re.compile("[^\\x00-\\x7f]")


#: Signs that clean text has at word borders, and those it has inside words.
_BORDER = set("“”—–«»°±²³₂№•…„‘’→≤≥×÷−√∞≈≠Δ§¼½µ€£¥¢¶†‡©®™‌\u200b\xa0\u202f")
_INNER = set("’‌²₂")
_LINES = set("─│└├┌┐┘═║╬░▒▓")


def word_cost(w: str) -> float:
    """Improbability of a word with non-ASCII characters; long words aren't remembered."""
    return _word_cost(w) if len(w) <= LONG_WORD else _word_cost.__wrapped__(w)


@lru_cache(65536)
def _word_cost(w: str) -> float:
    if len(w) == 1 and w.isalpha():
        return 0.3
    total = 3.0 * cost(w)
    kinds = set()
    prev = ""
    for i, c in enumerate(w):
        if "Ѐ" <= c <= "ӿ":
            kinds.add("c")
            k = _RUS.find(c.lower())
            total += 0.12 * k if k >= 0 else 5
            if c.isupper() and prev.islower() or c.islower() and prev.isupper() and i > 1:
                total += 3
        elif "؀" <= c <= "ۿ":
            kinds.add("a")
            k = _PER.find(c)
            total += 0.1 * k if k >= 0 else (0.5 if c in "،؛؟" else 5)
        elif "Ͱ" <= c <= "Ͽ":
            total += 0.3 if c in "αβγδωΓΑΒΔΩ" and not prev.isalpha() else 4
        elif c.isalpha():
            kinds.add("l")
            if not c.isascii():
                total += 0.6 if c in _LAT else 1.8 if c in "ÝÞÐýþð" else 2.5 if "Ā" <= c <= "ž" or "Ḁ" <= c <= "ỹ" else 4
                if c.isupper() and i and w[i + 1 : i + 2].islower():
                    total += 4
                elif c.isupper() and prev.islower():
                    total += 3
                if not prev and w[1:2] == "[":
                    total += 3
                if prev and not prev.isascii() and prev.isalpha():
                    total += 2
        elif not c.isascii():
            inside = prev.isalpha() and any(x.isalpha() for x in w[i + 1 :])
            if c in _BORDER and not inside or c in _INNER or ord(c) >= 0x1F000:
                total += 1 if c in "«»" else 0.2
            elif "─" <= c <= "▟":
                total += 0.3 if c in _LINES else 3
            else:
                total += 4 if prev.isalpha() else 2
        prev = c
    if w[:1].islower() and len(w) > 2 and w[1:].isupper():
        total += 4
    return total + 3 * (len(kinds) > 1)


@lru_cache(None)
def _swap(read: str, written: str) -> dict[int, str]:
    to, back = to_byte(read), from_byte(written)
    return {ord(c): back[b] for c, b in to.items() if b >= 0x80}


_SENTENCES = re.compile(r"[^\n.!?]+[.!?]*\s*|[\n.!?]+\s*")


_CYRILLIC = ("cp1251", "koi8_r", "cp866", "mac_cyrillic")


@lru_cache(None)
def _swaps() -> list[tuple[str, bool, dict[int, str]]]:
    """(script of the words it can stand in, whether words change one by one, character map) of each single-byte layer."""
    script = {**dict.fromkeys(_CYRILLIC, "c"), "cp1256": "a"}
    return [(script.get(read, "l"), read not in script and written not in _CYRILLIC and written != "cp1256", _swap(read, written)) for read, written in SINGLE]


def _script(w: str) -> str:
    return "c" if any("Ѐ" <= c <= "ӿ" for c in w) else "a" if any("\u0600" <= c <= "ۿ" for c in w) else "l"


#: Signs that may come out where a letter stood, at a word's border or as an apostrophe.
_SIGNS = set("“”‘’«»¿¡")
_LONE = _SIGNS | set("•–—…°²±№·→")


def _converted(w: str, k: int) -> tuple[float, str] | None:
    return _conversion(w, k) if len(w) <= LONG_WORD else _conversion.__wrapped__(w, k)


@lru_cache(65536)
def _conversion(w: str, k: int) -> tuple[float, str] | None:
    _, single, swap = _swaps()[k]
    if not _swappable(w, swap):
        return None
    new = w.translate(swap)
    if single:
        if len(w) > 1 and w.isalpha() and not any(map(str.isascii, w)):  # no word of a Latin-script language here
            return None
        lost = [i for i, (x, y) in enumerate(zip(w, new)) if x != y and x.isalpha() and not y.isalpha()]
        if any(new[i] not in (_SIGNS if i or w[1:2].isalpha() else _LONE) or 0 < i < len(w) - 1 and new[i] != "’" for i in lost) or len(lost) == len(w) > 1:
            return None
    elif 2 * sum(map(str.isalpha, new)) < sum(map(str.isalpha, w)):
        return None
    return word_cost(new), new


def _gain(words: list[str], k: int, ties: bool = True) -> tuple[float, float, dict[str, str]]:
    """(drop of the cost, cost before, changed words) of a sentence's words of one script under layer ``k``.

    Where both encodings are Latin, words change one by one, if their own cost does not rise; else all words of the
    script change together or not at all.
    """
    single = _swaps()[k][1]
    drop = before = 0.0
    change = {}
    for w in words:
        got = _converted(w, k)
        if got is None:
            if single:
                continue
            return 0.0, 0.0, {}
        old = word_cost(w)
        if single and (got[0] > old or got[0] == old and not (ties and w.isalpha() and got[1].isalpha())):
            continue
        if not single or got[0] < old:
            drop, before = drop + old - got[0], before + old
        if got[1] != w:
            change[w] = got[1]
    return drop, before, change


#: Layers that swap small and capital Cyrillic letters.
_FLIPS = tuple(k for k, pair in enumerate(SINGLE) if pair in (("koi8_r", "cp1251"), ("cp1251", "koi8_r")))


def _flipped(words: list[str]) -> dict[str, str]:
    """Single words in capitals, among small ones, that a layer which swaps the case turns into likelier small ones."""
    if sum(len(w) > 3 and w.islower() for w in words) < 2:
        return {}
    change = {}
    for w in words:
        if len(w) > 4 and w.isalpha() and w[1:].isupper():
            for k in _FLIPS:
                got = _converted(w, k)
                if got and got[1][1:].islower() and got[0] < word_cost(change.get(w, w)) - 1:
                    change[w] = got[1]
    return change


def undo_singlebyte(text: str, margin: float = 2.0) -> str | None:
    """One single-byte layer less, or None."""
    parts = _SENTENCES.findall(text)
    found: dict[int, dict[int, dict[str, str]]] = {}
    total: dict[int, float] = {}
    groups: dict[int, dict[str, list[str]]] = {}
    lone: dict[int, dict[str, str]] = {}
    for i, part in enumerate(parts):
        if part.isascii():
            continue
        by: dict[str, list[str]] = {}
        odd = False
        for w in _WORDS.findall(part):
            if w.isascii():
                continue
            by.setdefault(_script(w), []).append(w)
            odd = odd or word_cost(w) > 1.2 + 1.35 * len(_HIGH.findall(w))
        groups[i] = by
        if not odd:
            continue
        best: tuple[float, int, dict[str, str]] | None = None
        for k, (script, _, _) in enumerate(_swaps()):
            if script in by:
                drop, before, change = _gain(by[script], k)
                if drop > margin + 0.15 * before and (best is None or drop > best[0]):
                    after, high = before - drop, sum(len(_HIGH.findall(w)) for w in change.values())
                    if after <= 1.3 * high + 0.2:
                        best = (drop, k, change)
        if best:
            found.setdefault(best[1], {})[i] = best[2]
            total[best[1]] = total.get(best[1], 0.0) + best[0]
        elif "c" in by and (change := _flipped(by["c"])):
            lone[i] = change
    if not found and not lone:
        return None
    for i, change in lone.items():
        parts[i] = _WORDS.sub(lambda m: change.get(m.group(), m.group()), parts[i])
    if not found:
        return "".join(parts)
    top = max(total, key=lambda k: (total[k], -k))
    script = _swaps()[top][0]
    for i, by in groups.items():  # sentences without evidence of their own
        if script in by and i not in lone and not any(i in at for at in found.values()):
            drop, before, change = _gain(by[script], top, ties=False)
            if drop > 0.1 * before:
                found[top][i] = change if script != "l" else {w: n for w, n in change.items() if len(w) == 1 or word_cost(w) - word_cost(n) > 1}
    touched = {i for at in found.values() for i in at}
    for at in found.values():
        for i, change in at.items():
            parts[i] = _WORDS.sub(lambda m: change.get(m.group(), m.group()), parts[i])
    return _widened(text, "".join(parts), lines_of(text, touched), top)


def lines_of(text: str, touched: set[int]) -> set[int]:
    """Numbers of the lines that hold the given sentences."""
    out, line = set(), 0
    for i, part in enumerate(_SENTENCES.findall(text)):
        if i in touched:
            out.add(line)
        line += part.count("\n")
    return out


def _widened(text: str, repaired: str, touched: set[int], k: int) -> str:
    """``repaired``, or all of the text or of a touched line read again, where its words then cost hardly more.

    A layer proven by some words holds for all characters that went through it: signs, capitals and short words, too.
    ``SLACK`` a character that this changes is what the proof is worth.
    """
    _, single, swap = _swaps()[k]

    def read_again(old: str, new: str) -> str:
        whole = old.translate(swap)
        if whole == new or len(whole) != len(new) or not _swappable(old, swap) or single and _loses(old, whole):
            return new
        slack = SLACK * sum(map(str.__ne__, whole, new))
        return whole if _words_cost(whole) <= _words_cost(new) + slack else new

    whole = read_again(text, repaired)
    if whole is not repaired:
        return whole
    old, new = text.split("\n"), repaired.split("\n")
    if len(old) != len(new):
        return repaired
    return "\n".join(read_again(a, b) if i in touched else b for i, (a, b) in enumerate(zip(old, new)))


def _loses(old: str, new: str) -> bool:
    """Whether a letter becomes a sign where clean words have none, or a usual sign on its own a letter."""
    for i, (x, y) in enumerate(zip(old, new)):
        if x != y and x.isalpha() != y.isalpha():
            before, after = i > 0 and new[i - 1].isalpha(), new[i + 1 : i + 2].isalpha()
            if y.isalpha():
                if x in "–—…•“”‘’" and not before and not after:
                    return True
            elif y not in ("’" if before and after else _SIGNS if before or after else _LONE):
                return True
    return False


def _swappable(s: str, swap: dict[int, str]) -> bool:
    """Whether every letter of ``s`` can have gone through a layer."""
    return not any(c > "\x7f" and ord(c) not in swap and c.isalpha() for c in s)


def _flags(token: str) -> int:
    """1 where a token shows what a multi-byte layer leaves, 2 where a word of it looks like a single-byte layer."""
    multi = bool(_ANY_ODD.search(token) or _UNCOMMON.search(token))
    single = any(word_cost(w) > 1.2 + 1.35 * len(_HIGH.findall(w)) for w in _WORDS.findall(token) if not w.isascii())
    return multi | single << 1


_remembered_flags = lru_cache(65536)(_flags)


def suspicion(text: str) -> int:
    """``_flags`` of the distinct tokens of a text together: no sign of damage reaches over a blank."""
    found = 0
    for t in set(text.replace("\n", " ").split(" ")):
        if not t.isascii():
            found |= _remembered_flags(t) if len(t) <= LONG_WORD else _flags(t)
            if found == 3:
                break
    return found


def _foreign(s: str) -> int:
    """Rare characters beyond the Latin, Greek, Cyrillic and Arabic blocks."""
    return sum(c > "\u06ff" for c in _UNCOMMON.findall(s))


def _words_cost(s: str) -> float:
    return sum(word_cost(w) for w in _WORDS.findall(s) if not w.isascii())


def _one_layer(text: str) -> str | None:
    """One layer less, or None. A multi-byte layer that would give new letters of a foreign script competes with the
    single-byte ones on the cost of all words."""
    signs = suspicion(text)
    multi = undo_multibyte(text) if signs & 1 else None
    if multi is not None and _foreign(multi) <= _foreign(text):
        return multi
    single = undo_singlebyte(text) if signs & 2 else None
    if multi is None or single is None:
        return single if multi is None else multi
    return single if _words_cost(single) < _words_cost(multi) else multi


def repair(text: str | None) -> tuple[bool, str | None, int]:
    """(garbled, text with all layers undone that can be, number of layers)."""
    if not text or text.isascii():
        return False, text, 0
    now, layers, seen = text, 0, {text}
    while (new := _one_layer(now)) is not None and new not in seen:
        now, layers = new, layers + 1
        seen.add(now)
    return layers > 0 or "\ufffd" in text, now, layers


def _repair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [repair(t) for t in b.column(b.num_columns - 1).to_pylist()]
        keep = [b.column(i) for i in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*keep, pa.array([g[0] for g in got]), pa.array([g[1] if g[2] else None for g in got], pa.string()), pa.array([g[2] for g in got], pa.int32())], names=[*b.schema.names[:-1], "garbled", "restored", "layers"])


def repair_corpus(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, garbled, restored, layers); ``restored`` is null where no layer could be undone."""
    rows = df.select(F.col(key).cast("bigint").alias("__key"), F.col(text).cast("string").alias("__text"))
    return spread(rows).mapInArrow(_repair_batches, "__key bigint, garbled boolean, restored string, layers int").withColumnRenamed("__key", key)
