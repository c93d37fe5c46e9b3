"""Numbers in seven languages, by known spellings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions import languages

KNOWN = {
    "en": {"three hundred and forty two": 342, "one million two hundred thousand five": 1200005},
    "de": {"einundzwanzig": 21, "zweihundertfunf": 205, "neunzehnhundertvierundachtzig": 1984, "zweitausenddreihundert": 2300, "tausend": 1000, "dreissig": 30, "eine million": 10**6, "zwei millionen funfhunderttausend": 2500000, "hunderteins": 101, "funfundsiebzigtausendsechshundertzwolf": 75612},
    "fr": {"vingt et un": 21, "soixante dix": 70, "soixante et onze": 71, "quatre vingts": 80, "quatre vingt dix neuf": 99, "deux cents": 200, "deux cent cinq": 205, "mille neuf cent quatre vingt quatre": 1984, "trois millions deux cent mille": 3200000, "dix sept": 17},
    "es": {"veintiuno": 21, "treinta y dos": 32, "cien": 100, "ciento cinco": 105, "quinientos": 500, "mil novecientos ochenta y cuatro": 1984, "dos mil": 2000, "tres millones": 3000000, "cien mil": 100000},
    "it": {"ventuno": 21, "ventotto": 28, "trentadue": 32, "duecento": 200, "centottanta": 180, "millenovecentottantaquattro": 1984, "duemila": 2000, "tre milioni": 3000000, "trecentomila": 300000},
    "nl": {"eenentwintig": 21, "tweeentwintig": 22, "tweehonderdvijf": 205, "negentienhonderdvierentachtig": 1984, "tweeduizend": 2000, "drie miljoen": 3000000, "honderd": 100},
    "pt": {"vinte e um": 21, "cem": 100, "cento e cinco": 105, "mil novecentos e oitenta e quatro": 1984, "dois mil e vinte": 2020, "tres milhoes": 3000000, "duzentos": 200},
}


LARGE = {
    "en": {"two million three hundred thousand": 2_300_000, "one billion two million": 1_002_000_000, "three hundred million and five": 300_000_005},
    "de": {"drei millionen vierhunderttausend": 3_400_000, "zwei milliarden drei millionen": 2_003_000_000, "ein und zwanzig": 21, "hundert funf und dreissig": 135, "zweihundert zwolf": 212},
    "fr": {"deux milliards trois millions": 2_003_000_000, "mille milliards": 10**12, "cinq millions deux mille trois": 5_002_003},
    "es": {"mil millones": 10**9, "dos mil quinientos millones": 2_500_000_000, "tres mil millones cuatro mil": 3_000_004_000, "un millon mil": 1_001_000},
    "it": {"due miliardi tre milioni": 2_003_000_000, "mille miliardi": 10**12, "quattro milioni duemila": 4_002_000},
    "nl": {"een en twintig": 21, "vijf en negentig": 95, "honderd een en twintig": 121, "twee miljard drie miljoen": 2_003_000_000},
    "pt": {"dois mil milhoes": 2_000_000_000, "tres bilhoes e dois milhoes": 3_002_000_000, "um milhao e mil": 1_001_000},
}
DIGITS = {"fr": {"1 234 567": 1234567, "12 345,5 x": 12345.5, "1 2345": [1, 2345], "1234 567": [1234, 567], "1 234,5 678": [1234.5, 678], "7 12 345": [7, 12345]}, "es": {"1.234 567": [1234, 567]}}


@pytest.mark.parametrize("lang", LARGE)
def test_large_and_spaced_numbers(lang):
    for form, value in LARGE[lang].items():
        assert languages.said(["x", *form.split(), "x"], lang) == [(value, "words")], form


def test_groups_of_digits():
    for lang, texts in DIGITS.items():
        for form, want in texts.items():
            assert [float(v) for v, _ in languages.said(form.split(), lang)] == (want if isinstance(want, list) else [want]), form


@pytest.mark.parametrize("lang", KNOWN)
def test_known_spellings(lang):
    for form, value in KNOWN[lang].items():
        assert languages.said(["x", *form.split(), "x"], lang) == [(value, "words")], form


@pytest.mark.parametrize("lang", KNOWN)
def test_every_form_is_read(lang):
    for n in range(1000):
        for form in languages.under_thousand(lang, n):
            if form not in languages.ARTICLES[lang]:
                assert languages.said(form.split(), lang) == [(n, "words")], form


def test_words_that_are_none_and_digits(spark):
    rows = [("de", "ein haus und eine frau"), ("fr", "un chien 1,5"), ("es", "uno 1.234,5"), ("de", "1.234 2,5 1.2"), ("en", "1,234.5 and"), ("xx", "5"), ("it", "un"), (None, "5"), ("fr", "deux trois"), ("pt", "dois e tres")]
    df = spark.createDataFrame(rows, "lang string, t string").select(languages.read_in(F.split("t", " "), "lang").alias("n"))
    assert [[float(x.value) for x in r.n] for r in df.collect()] == [[], [1.5], [1234.5], [1234, 2.5], [1234.5], [], [], [], [2, 3], [2, 3]]


def test_folding_tries_no_class_of_characters_at_every_place():
    """A class of hundreds of ranges took most of the time of long texts; translate looks each character up."""
    from millrace.functions import text

    assert len(text._ACCENTS) > 500 and "[" not in text._ACCENTS


def test_words_that_begin_no_number_are_passed_over(monkeypatch):
    tried = []
    plain = languages.spoken
    monkeypatch.setattr(languages, "spoken", lambda tokens, i, lang: tried.append(i) or plain(tokens, i, lang))
    assert languages.said("wir sahen zwei hunde und 3.000 katzen".split(), "de") == [(2, "words"), ("3000", "digits")] and tried == [2]
