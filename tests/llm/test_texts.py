"""Chunks, languages, consistent forms and encodings on small dirty inputs, and held-out accuracy."""

from __future__ import annotations

import random
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from graphloom.llm import chunking as C, language as L, lookalikes as K, mojibake as M
from graphloom.llm.queries import R
from tests.compare import compare

ALPHABET = "ab é.\n\ŕ‍🧬!? "


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=3000), st.integers(20, 400), st.integers(0, 15))
def test_pieces_cover_the_text(s, most, overlap):
    p = C.pieces(s, most, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(s)
    assert all(b - a <= most for a, b in p)
    assert all(c == max(0, b - overlap) and d > b for (_, b), (c, d) in zip(p, p[1:]))
    assert (len(p) > 1) == (len(s) > most)
    assert s == s[: p[0][1]] + "".join(s[x[1] : y[1]] for x, y in zip(p, p[1:]))


def test_edits_alter_only_neighbouring_pieces():
    rnd = random.Random(2)
    s = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) + rnd.choice(["", "", "", "."]) for _ in range(20_000))
    a = {s[x:y] for x, y in C.pieces(s, 2000, 200)}
    edited = s[:50_000] + "an inserted sentence. " + s[50_000:]
    b = {edited[x:y] for x, y in C.pieces(edited, 2000, 200)}
    assert len(a - b) <= 4


def test_split_rows(spark):
    rows = [(1, None, None), (2, "", [("h", None), ("h", "x" * 900), ("h", "")]), (2, "y " * 1500, []), (3, "z" * 2000, [("h", "w" * 800)])]
    df = spark.createDataFrame(rows, "page_id bigint, text string, sections array<struct<heading:string,text:string>>")
    out = C.split(C.items(df, "page_id"), {"text": (2000, 200), "section": (800, 80)}).collect()
    got = {}
    for r in out:
        got.setdefault((r.key, r.item_no), []).append(r)
    assert {k: len(v) for k, v in got.items()} == {(2, 0): 1 + len(C.pieces("y " * 1500, 2000, 200)), (2, 2): 2, (2, 3): 1, (3, 0): 1, (3, 1): 1}
    assert C.split(C.items(df, "page_id"), {}).where("n_pieces > 1").count() == 0
    assert C.split(C.items(df.where("false"), "page_id"), {}).count() == 0
    with pytest.raises(ValueError):
        C.pieces("x" * 100, 10, 10)


def test_chunk_oracle(spark, con, data):
    assert compare(spark, con, R.queries["p1_found"], R.sql["p1_found"], data) == ""


PROFILES = L.Profiles({k: [g for g, _ in L.grams(L.text_words(s)).most_common()] for k, s in L.SEED.items()})
SAMPLES = {
    "en": "It is not clear whether the patients in the other group were treated with the same dose.",
    "de": "Es ist nicht klar, ob die Kranken in der anderen Gruppe mit derselben Dosis behandelt wurden.",
    "fr": "On ne sait pas si les malades de l’autre groupe ont été traités avec la même dose.",
    "es": "No se sabe si los pacientes del otro grupo fueron tratados con la misma dosis.",
    "fa": "هنوز دانسته نیست که آیا بیماران گروه دیگر با همان مقدار درمان شده‌اند.",
    "ru": "Неизвестно, лечили ли больных другой группы той же дозой препарата.",
}


@pytest.mark.parametrize("lang", L.LANGUAGES)
def test_language_from_seed_profiles(lang):
    main, confidence, segs, held = L.segments(SAMPLES[lang] * 2, PROFILES)
    assert main == lang and held == [lang] and 0 < confidence <= 1
    assert segs[0][1] == 0 and segs[-1][2] == len(SAMPLES[lang] * 2)


def test_mixed_text_has_segments():
    s = SAMPLES["en"] + " " + SAMPLES["en"] + "\n\n" + SAMPLES["ru"] + "\n\n" + SAMPLES["en"]
    main, _, segs, held = L.segments(s, PROFILES)
    assert main == "en" and held == ["en", "ru"] and [x[0] for x in segs] == ["en", "ru", "en"]
    assert "".join(s[a:b] for _, a, b, _ in segs) == s


@pytest.mark.parametrize("s", ["123 456", "…", "   ", "ATCG" * 300])
def test_texts_without_language(s):
    assert L.segments(s, PROFILES)[0] is None or L.segments(s, PROFILES)[3]


def test_labels_and_empty_table(spark):
    rows = [(i, x, "t") for i, x in enumerate(["en", "EN-gb", " English ", "eng", "de_AT", None, "", "und", "it", "persian"])]
    df = spark.createDataFrame(rows, "k bigint, lang string, text string")
    got = [r[0] for r in df.orderBy("k").select(L.label_language(df.lang)).collect()]
    assert got == ["en", "en", "en", "en", "de", None, None, "", "", "fa"]
    p = L.fit(df.where("false"), "k", "text", "lang")
    assert L.segments(SAMPLES["es"], p)[0] == "es"
    bad = spark.createDataFrame([(1, None, None), (2, "en", ""), (3, "fr", SAMPLES["de"] * 3)], "k bigint, lang string, text string")
    out = {r.key: r for r in L.identify(bad, "k", "text", "lang", p).collect()}
    assert out[1].lang is None and out[2].lang is None and out[3].lang == "de" and out[3].label_lang == "fr"


PLAIN = {
    "a b": "a b",
    "a\xa0b c　d": "a b c d",
    "a\r\nb\rc d": "a\nb\nc\nd",
    "s\xado​f﻿t⁠": "soft",
    "ＢＲＣＡ１（ａ）": "BRCA1(a)",
    "ﬁbre K Ⅱ": "fibre K II",
    "éä": "éä",
    "x² № CO₂ “q” – 🧬 ½ ™": "x² № CO₂ “q” – 🧬 ½ ™",
    "كتاب علي": "کتاب علی",
    "نشانه‌ی x‌ y": "نشانه‌ی x y",
    "👩‍🔬 a‍b": "👩‍🔬 ab",
    "": "",
}


@pytest.mark.parametrize("s", PLAIN)
def test_plain_characters(s):
    assert K.plain_characters(s) == PLAIN[s] and K.plain_characters(PLAIN[s]) == PLAIN[s]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_plain_is_stable(s):
    once = K.plain_characters(s)
    assert K.plain_characters(once) == once and unicodedata.is_normalized("NFC", once)


@pytest.mark.parametrize("sent", [0, 50_000])
def test_lookalikes(spark, sent, monkeypatch):
    monkeypatch.setattr(K, "SENT_TOKENS", sent)
    names = [(1, "BRCA1"), (2, "ВRСА1"), (3, "α-blocker"), (4, "МАР11"), (5, None), (6, " x "), (7, "ВRСА1")]
    texts = [(1, "the liver from thе Alps"), (2, "Связь между генами и прoба проба"), (3, "СО2 and CO2 and CO2"), (4, "В почках"), (5, None), (6, ""), (7, "TNFα rose"), (8, "NAЅE77 alone"), (9, "line\r\nline"), (10, "line\rline"), (11, "naїve or naïve")]
    n = spark.createDataFrame([(*r, "c") for r in names], "node_row bigint, name string, key string")
    t = spark.createDataFrame([(*r, "c") for r in texts], "page_id bigint, text string, plain string")
    a, b = K.Survey(n, "node_row", "name", names=True), K.Survey(t, "page_id", "text")
    found = {(r.tbl, r.key) for r in K.inconsistent_rows({"n": a, "t": b}).collect()}
    assert found == {("n", k) for k in (2, 4, 7)} | {("t", k) for k in (1, 2, 3, 8, 10, 11)}
    rows = K.consistent(a, [b]).collect()
    assert {r.key: r.text for r in rows} == {1: "BRCA1", 2: "BRCA1", 3: "α-blocker", 4: "MAP11", 5: None, 6: " x ", 7: "BRCA1"} and {r.key for r in rows if r.changed} == {2, 4, 7}
    rows = K.consistent(b, [a]).collect()
    got = {r.key: r.text for r in rows}
    assert got[1] == "the liver from the Alps" and got[2].count("проба") == 2 and got[3] == "CO2 and CO2 and CO2" and got[7] == "TNFα rose" and got[8] == "NASE77 alone"
    assert got[9] == got[10] == "line\nline" and got[11] == "naïve or naïve" and {r.key for r in rows if r.changed} == {1, 2, 3, 8, 10, 11}
    assert K.inconsistent_rows({"t": K.Survey(t.where("false"), "page_id", "text")}).count() == 0


ORIGINALS = ["Le gène a été relevé près du cœur, d’où la fiche.", "Die Übersicht prüfte die Größe der Änderung.", "Связь между геном и болезнью была удалена.", "در این بررسی ژن بیشتر از همه بیان می‌شود.", "¿Quién sabe la razón? El daño fue pequeño."]


@pytest.mark.parametrize("s", ORIGINALS)
@pytest.mark.parametrize("enc", ["cp1252", "latin_1", "mac_roman", "cp1251", "cp437"])
def test_multibyte_layers_come_back(s, enc):
    back = M.from_byte(enc)
    garbled = "".join(back[b] for b in s.encode())
    if enc == "cp1251" and s == ORIGINALS[0]:
        garbled = "".join(back[b] for b in s.encode())
    found, restored, layers = M.repair("A clean line.\n" + garbled)
    assert found and layers >= 1 and restored == "A clean line.\n" + s


def test_nested_layers_come_back():
    s = ORIGINALS[0]
    once = "".join(M.from_byte("cp1252")[b] for b in s.encode())
    twice = "".join(M.from_byte("cp1252")[b] for b in once.encode())
    assert M.repair(twice) == (True, s, 2)


@pytest.mark.parametrize("read,written,s", [("latin_1", "cp1251", ORIGINALS[2]), ("koi8_r", "cp1251", ORIGINALS[2]), ("mac_roman", "cp1252", ORIGINALS[0])])
def test_singlebyte_layers_come_back(read, written, s):
    garbled = s.encode(written).decode(read)
    assert M.repair(garbled)[:2] == (True, s)


def test_six_layers_come_back():
    text = garbled = "La protéine été étudiée à Genève."
    for _ in range(6):
        garbled = garbled.encode().decode("latin_1")
    assert M.repair(garbled) == (True, text, 6)


@pytest.mark.parametrize(
    "read,written,s",
    [
        ("cp1252", "cp1251", "Это да и нет"),
        ("koi8_r", "cp1251", "Кроме того, в тонкой кишке следов не обнаружили."),
        ("mac_roman", "cp1252", "SEE ALSO:\n• The reason isn’t known; “gene panel” of Drórel."),
        ("cp1252", "mac_roman", "• Según el registro, el corazón respondió bien y el daño fue pequeño."),
    ],
)
def test_a_layer_holds_for_the_whole_line(read, written, s):
    garbled = "".join(M.from_byte(read)[M.to_byte(written)[c]] if c > "\x7f" else c for c in s)
    assert M.repair(garbled)[:2] == (True, s)


CLEAN = [*ORIGINALS, None, "", "plain", "├── genes\n│   └── VORK1\n└── drugs ░▒▓", "ÄÖÜ ÆØÅ ÏÎÌ ÔÒÕ ÛÙÝ ÇÐÑ.", "The letters Ã, Â and Ð occur in the old index.", "Fee: 40 € or £12 or ¥900 for Ombrex™ ©; 5 ¢, ¶ 3, † note", "D = √(x² + y²), n → ∞, p ≤ 0.05", "طبيب، ظرف، غذاء، إطار، ضوء", "Čelvová, Dvořel, Żubrań", "Þórvel and Łubra were coded as “ð”", "ФУНКЦИЯ:", "LA GRÂCE À VÉLOR", "😀🧬 x"]


@pytest.mark.parametrize("s", CLEAN)
def test_clean_texts_are_no_case(s):
    assert M.repair(s) == (False, s, 0)


def test_lost_characters_and_long_texts(spark):
    assert M.repair("na�ve")[0] is True
    rows = [(1, None), (2, ""), (3, "cafÃ©"), (3, "cafÃ©"), (4, "x" * 200_000 + " cafÃ©"), (5, "café")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, restored string")
    got = sorted((r.doc_id, r.garbled) for r in M.repair_corpus(df, "doc_id").collect())
    assert got == [(1, False), (2, False), (3, True), (3, True), (4, True), (5, False)]
    assert M.repair_corpus(df.where("false"), "doc_id").count() == 0


@pytest.mark.parametrize("name", [n for n in R.queries if n not in R.sql])
def test_queries_run(spark, data, name):
    assert R.queries[name](spark, data).count() >= 0
