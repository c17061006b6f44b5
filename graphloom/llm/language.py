"""Language of each page and of each segment of a mixed text, by rank-order n-gram profiles.

A profile is the list of a language's most frequent n-grams (one to three characters, words padded). A text is compared
with each profile by the out-of-place distance: how far every one of its n-grams is from its rank in the profile, with
a fixed distance for n-grams the profile lacks. The nearest profile gives the language; the confidence compares its
distance with all others.

Profiles are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS`` rows with the smallest hash of their id, whose
label names one of the languages) and on a short built-in paragraph each, so that they exist for empty tables, too.
Labels of the sample may be partly wrong: a profile keeps only the most frequent n-grams of many rows.

Texts are cut into sentences and lines; terms that belong to no language (names with
digits, capitals only) don't count. Each full sentence is classified; neighbours of one language make a segment, and
what is too short to tell joins its neighbour. A language is held by the text if a full sentence is in it clearly, that
is with a distance below ``CLEARLY`` times that of the text's main language.

Defined results: null and blank texts and texts without letters have no language and no segment; texts are handled
whole; ties go to the first language in ``LANGUAGES``; repeated rows give equal results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.llm.lookalikes import plain_characters
from graphloom.session import spread

LANGUAGES = ("en", "de", "fr", "es", "fa", "ru")
SAMPLE_ROWS = 3000
PROFILE = 500
MIN_LETTERS = 20
SHORT_LETTERS = 12
LONG_TOKEN = 64  # longer ones are not remembered
GROUP = 1 << 14  # characters whose sentences are compared at once
CLEARLY = 0.95

#: Usual forms of the languages' labels, besides a region behind a dash.
LABELS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish", "castilian"),
    "fa": ("fa", "fas", "per", "persian", "farsi"),
    "ru": ("ru", "rus", "russian"),
}
SEED = {
    "en": "The results of this study show that the treatment was well tolerated by most of the patients, and there were no other side effects than those which had been reported before. It is not known whether the signal in the heart is caused by the same gene.",
    "de": "Die Ergebnisse dieser Studie zeigen, dass die Behandlung von den meisten Kranken gut vertragen wurde und dass es keine anderen Nebenwirkungen gab als die, über die schon früher berichtet wurde. Es ist nicht bekannt, ob das Signal im Herzen durch dasselbe Gen verursacht wird.",
    "fr": "Les résultats de cette étude montrent que le traitement a été bien toléré par la plupart des malades et qu’il n’y avait pas d’autres effets indésirables que ceux qui avaient déjà été signalés. On ne sait pas si le signal dans le cœur est causé par le même gène.",
    "es": "Los resultados de este estudio muestran que la mayoría de los pacientes toleró bien el tratamiento y que no hubo otros efectos secundarios que los que ya se habían descrito. No se sabe si la señal en el corazón se debe al mismo gen, aunque así lo indica la prueba.",
    "fa": "نتایج این پژوهش نشان می‌دهد که بیشتر بیماران درمان را به خوبی تحمل کردند و عوارض دیگری جز آنچه پیش از این گزارش شده بود دیده نشد. هنوز دانسته نیست که آیا نشانه‌های قلب از همان ژن است یا نه.",
    "ru": "Результаты этого исследования показывают, что большинство больных хорошо перенесли лечение и что не было других побочных действий, кроме тех, о которых уже сообщали раньше. Неизвестно, вызван ли сигнал в сердце тем же геном.",
}

_CUT = re.compile(r"[^\n.!?؟]*(?:[.!?؟]+(?=[^\s.!?؟])[^\n.!?؟]*)*[.!?؟]*\s*|[\n.!?؟]+\s*")
_CAPITALS = re.compile(r"\b[A-ZÀ-Þ]{2,}\b(?:-[A-Z]+)?")
_NUMBERED = re.compile(r"[0-9_<>=/@#]")
_SENTENCE = re.compile(r"^[^\w]*(?:[A-ZÀ-ÞА-ЯЁ]|[\u0600-\u06ff]).*[.!?؟]\W*$", re.S)
_WORDS = re.compile(r"[^\W\d_]+(?:[’'‌][^\W\d_]+)*")


def word_list(token: str, shouted: bool) -> list[str]:
    """Normal words of a token (a stretch without blanks), without terms that belong to no language.

    ``shouted``: the sentence is in capitals only, which then mark no terms.
    """
    if _NUMBERED.search(token):
        return []
    kept = token if shouted else _CAPITALS.sub(" ", token)
    return _WORDS.findall(kept.lower().replace("'", "’"))


def grams(words: list[str]) -> Counter:
    """n-grams of one to three characters of words padded with one blank; none is a blank only."""
    c: Counter = Counter()
    for w in words:
        p = f" {w} "
        c.update(w)
        c.update(map("".join, zip(p, p[1:])))
        c.update(map("".join, zip(p, p[1:], p[2:])))
    return c


def text_words(text: str) -> list[str]:
    """Normal words of a text in ordinary characters."""
    text = plain_characters(text)
    shouted = text.isupper()
    return [w for t in text.split() for w in word_list(t, shouted)]


class Sentence(NamedTuple):
    """What is counted of a sentence: letters, words and the numbers of its n-grams by length, in parts, in order."""

    letters: int
    words: int
    parts: list[np.ndarray]


NO_WORDS = (0, 0, *[np.zeros(0, np.int64)] * 3)


class Profiles:
    """Ranks of n-grams in all languages and the distances of sentences to them.

    n-grams are numbered, those of the profiles first; tokens repeat, so a worker remembers the numbers of each short
    one. Distances are taken of many sentences at once.
    """

    REMEMBERED = 100_000

    def __init__(self, ranked: dict[str, list[str]]) -> None:
        self.missing = PROFILE
        self.row: dict[str, int] = {}
        for gs in ranked.values():
            for g in gs:
                self.row.setdefault(g, len(self.row))
        self.rank = np.full((len(self.row) + 1, len(LANGUAGES)), np.inf, np.float32)
        for j, lang in enumerate(LANGUAGES):
            for r, g in enumerate(ranked.get(lang, [])[:PROFILE]):
                self.rank[self.row[g], j] = r
        self._forget()

    def trim(self) -> None:
        """Bound what a worker remembers; only between groups, whose sentences share one numbering."""
        if len(self._number) > 10 * self.REMEMBERED or sum(map(len, self._tokens)) > self.REMEMBERED:
            self._forget()

    def _forget(self) -> None:
        self._number = dict(self.row)
        self._tokens: tuple[dict[str, tuple], dict[str, tuple]] = {}, {}
        self._words: dict[str, tuple] = {}

    def _word(self, w: str) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        number, p = self._number, f" {w} "
        ids = [[number.setdefault(g, len(number)) for g in gs] for gs in (w, map("".join, zip(p, p[1:])), map("".join, zip(p, p[1:], p[2:])))]
        return (len(w), 1, *(np.array(x, np.int64) for x in ids))

    def _token(self, token: str, shouted: bool) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        es = []
        for w in word_list(token, shouted):
            e = self._words.get(w) or self._word(w)
            if len(w) <= LONG_TOKEN:
                self._words[w] = e
            es.append(e)
        if len(es) > 1:
            e = (sum(x[0] for x in es), len(es), *(np.concatenate(x) for x in list(zip(*es))[2:]))
        elif not es:
            e = NO_WORDS
        if len(token) <= LONG_TOKEN:
            self._tokens[shouted][token] = e
        return e

    def read(self, text: str, plain: bool) -> Sentence:
        """A sentence as counts; ``plain``: its characters are ordinary already."""
        text = text if plain else plain_characters(text)
        shouted = text.isupper()
        known = self._tokens[shouted].get
        es = [e for t in text.split() if (e := known(t) or self._token(t, shouted))[0]]
        if not es:
            return Sentence(0, 0, [])
        letters, words, one, two, three = zip(*es)
        return Sentence(sum(letters), sum(words), [*one, *two, *three])

    def distances(self, many: list[Sentence]) -> np.ndarray:
        """Mean out-of-place distance of each sentence, which must have a word, to each language.

        The n-grams of a sentence are ranked by frequency, ties in order of appearance, by two sorts of packed numbers:
        (sentence, n-gram, place) to count, (sentence, rarity, first place) to rank.
        """
        size = np.array([3 * s.letters + s.words for s in many])
        s_bits, n_bits, p_bits = len(many).bit_length(), len(self._number).bit_length(), int(size.max()).bit_length()
        if s_bits + p_bits + max(n_bits, p_bits) > 62 and len(many) > 1:  # too wide for one number
            half = len(many) // 2
            return np.vstack([self.distances(many[:half]), self.distances(many[half:])])
        ids = np.concatenate([p for s in many for p in s.parts])
        begin = np.cumsum(size) - size
        packed = np.repeat((np.arange(len(many)) << n_bits + p_bits) - begin, size)
        packed += np.arange(len(ids))
        packed += ids << p_bits
        packed.sort()
        gram = packed >> p_bits
        at = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        count = np.diff(np.append(at, len(packed)))
        sentence, first = gram[at] >> n_bits, packed[at] & ((1 << p_bits) - 1)
        packed = (((sentence << p_bits) | (int(count.max()) - count)) << p_bits) | first
        packed.sort()
        sentence, first = packed >> 2 * p_bits, packed & ((1 << p_bits) - 1)
        ids = ids[begin[sentence] + first]
        size = np.bincount(sentence, minlength=len(many))
        mine = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        if (size > PROFILE).any():
            kept = mine < PROFILE
            ids, mine, sentence, size = ids[kept], mine[kept], sentence[kept], np.minimum(size, PROFILE)
        rows, far, begin = np.minimum(ids, len(self.row)), self.missing * 1.5, np.cumsum(size) - size
        away = self.rank[rows]
        # Of a short text most counts are equal: its ranks are spread over the range of the profile.
        away -= (mine * np.repeat(PROFILE / size, size)).astype(np.float32)[:, None]
        np.minimum(np.abs(away, out=away), np.float32(far), out=away)  # ranks are nearer than ``far``, missing ones infinite
        n = np.add.reduceat((rows < len(self.row)).astype(np.int64), begin)
        total = np.add.reduceat(away, begin, dtype=np.float64) - far * (size - n)[:, None]
        return np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], far)  # what no profile has is equally far from all

    def shares(self, d: np.ndarray) -> np.ndarray:
        """Confidence in each language by distances."""
        w = np.exp(-(d - d.min(1, keepdims=True)) / (0.05 * self.missing))
        return w / w.sum(1, keepdims=True)


def full_sentence(text: str, s: Sentence) -> bool:
    """Whether a stretch is long enough, or begins and ends like a sentence, to be one."""
    return s.words >= 2 and s.letters >= MIN_LETTERS or s.letters >= SHORT_LETTERS and s.words >= 3 and bool(_SENTENCE.match(plain_characters(text)))


def sentences(text: str) -> list[tuple[int, int]]:
    """(begin, end) of sentences and lines; together they cover the text."""
    return [m.span() for m in _CUT.finditer(text) if m.end() > m.start()]


Found = tuple[str | None, float, list[tuple[str, int, int, float]], list[str]]


def segments(text: str, profiles: Profiles) -> Found:
    """(main language, confidence, segments (language, begin, end, confidence), languages held)."""
    return many_segments([text], profiles)[0]


def many_segments(texts: list[str], profiles: Profiles) -> list[Found]:
    """``segments`` of each text; all their sentences are compared with the profiles at once."""
    cuts, read = [], []
    profiles.trim()
    for text in texts:
        parts = sentences(text)
        plain = plain_characters(text) == text
        got = [profiles.read(text[a:b], plain) for a, b in parts]
        whole = [full_sentence(text[a:b], s) for (a, b), s in zip(parts, got)]
        if not any(whole) and any(s.letters for s in got):  # too short to be cut
            parts, got, whole = [(0, len(text))], [profiles.read(text, plain)], [True]
        cuts.append((parts, got, whole))
        read += [s for s in got if s.letters]
    if not read:
        return [(None, 0.0, [], [])] * len(texts)
    d = profiles.distances(read)
    share, best = profiles.shares(d), d.argmin(1).tolist()
    out, at = [], 0
    for parts, got, whole in cuts:
        rows = []
        for s in got:
            rows.append(at if s.letters else -1)
            at += s.letters > 0
        out.append(_joined(parts, got, whole, rows, best, d, share))
    return out


def _joined(parts: list[tuple[int, int]], got: list[Sentence], whole: list[bool], rows: list[int], best: list[int], d: np.ndarray, share: np.ndarray) -> Found:
    """One text from its classified sentences; ``rows`` are their places in ``best``, ``d`` and ``share``, or -1."""
    weight = np.zeros(len(LANGUAGES))
    for s, w, r in zip(got, whole, rows):
        if w and r >= 0:
            weight[best[r]] += s.letters
    if not weight.any():
        return None, 0.0, [], []
    main = int(weight.argmax())
    marks: list[int | None] = []
    for w, r in zip(whole, rows):
        clear = w and r >= 0 and (best[r] == main or d[r, best[r]] < CLEARLY * d[r, main])
        marks.append(best[r] if clear else main if w and r >= 0 else None)
    first = next(m for m in marks if m is not None)
    runs: list[list] = []
    for (a, b), m, s, r in zip(parts, marks, got, rows):
        lang = m if m is not None else runs[-1][0] if runs else first
        if not runs or runs[-1][0] != lang:
            runs.append([lang, a, b, 0.0, 0])
        run = runs[-1]
        run[2] = b
        if m is not None:
            run[3] += s.letters * float(share[r, lang])
            run[4] += s.letters
    segs = [(LANGUAGES[x[0]], x[1], x[2], x[3] / x[4] if x[4] else 0.0) for x in runs]
    mine = [s for s in segs if s[0] == LANGUAGES[main]]
    sure = sum(s[3] * (s[2] - s[1]) for s in mine) / max(1, sum(s[2] - s[1] for s in mine))
    return LANGUAGES[main], float(weight[main] / weight.sum()) * sure, segs, sorted({LANGUAGES[m] for m in marks if m is not None})


def label_language(label):
    """Column: the language that a label names in a usual form, '' for another name, null for a missing label."""
    base = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)(?:[-_][A-Za-z0-9-]+)?$", 1))
    known = F.create_map(*[x for lang, names in LABELS.items() for n in names for x in (F.lit(n), F.lit(lang))])
    return F.when(label.isNull() | (F.trim(label) == ""), F.lit(None)).otherwise(F.coalesce(known[base], F.lit("")))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by: dict[str, Counter] = {}
        for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(lang, Counter()).update(grams(text_words(t)))
        rows = [(lang, g, n) for lang, c in by.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "gram", "n"])


def fit(labelled: DataFrame, key: str, text: str, label: str, sample_rows: int = SAMPLE_ROWS) -> Profiles:
    """Profiles from at most ``sample_rows`` labelled rows and the built-in paragraphs."""
    rows = labelled.select(label_language(F.col(label)).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h"), F.col(key).alias("k")).where("lang <> '' and trim(text) <> ''")
    sample = rows.orderBy("h", "k").limit(sample_rows).select("lang", "text")
    counts = sample.repartition(12).mapInArrow(_count_grams, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE).collect()  # at most PROFILE rows a language
    by: dict[str, Counter] = {lang: Counter() for lang in LANGUAGES}
    for r in top:
        by[r.lang][r.gram] += r.n
    for lang, s in SEED.items():
        by[lang].update(grams(text_words(s)))
    return Profiles({lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]] for lang, c in by.items()})


_SEGMENT = "array<struct<lang:string,begin:int,end:int,confidence:double>>"


def identify(df: DataFrame, key: str, text: str, label: str, profiles: Profiles) -> DataFrame:
    """(key, label_lang, lang, confidence, held, segments) of every row; offsets count code points."""
    seg = pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, group, size = [], [], 0
            for t in b.column(2).to_pylist():
                group.append(t or "")
                size += len(group[-1])
                if size >= GROUP:
                    got += many_segments(group, profiles)
                    group, size = [], 0
            got += many_segments(group, profiles)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([round(g[1], 4) if g[0] else None for g in got], pa.float64()),
                    pa.array([g[3] for g in got], pa.list_(pa.string())),
                    pa.array([[dict(zip(("lang", "begin", "end", "confidence"), (s[0], s[1], s[2], round(s[3], 4)))) for s in g[2]] for g in got], seg),
                ],
                names=["key", "label_lang", "lang", "confidence", "held", "segments"],
            )

    rows = df.select(F.col(key).cast("bigint").alias("key"), label_language(F.col(label)).alias("label_lang"), F.col(text).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, f"key bigint, label_lang string, lang string, confidence double, held array<string>, segments {_SEGMENT}")
