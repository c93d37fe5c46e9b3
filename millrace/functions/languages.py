"""Numbers in words and digits in seven languages: spelled forms are made by rules, and read by the longest form that fits."""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import ARABIC, UNITS, written_value
from .numbers import TENS as ENGLISH_TENS

# Number words without accents, from 0 on, tens from 20 on, hundreds where they have words of their own, scales, and the marks
# between groups of three digits and before decimals. Words that are articles too (ein, un, uno, um, een) are no numbers alone.
ONES = {
    "en": UNITS,
    "de": "null eins zwei drei vier funf sechs sieben acht neun zehn elf zwolf dreizehn vierzehn funfzehn sechzehn siebzehn achtzehn neunzehn".split(),
    "fr": "zero un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize".split(),
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciseis diecisiete dieciocho diecinueve".split(),
    "it": "zero uno due tre quattro cinque sei sette otto nove dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove".split(),
    "nl": "nul een twee drie vier vijf zes zeven acht negen tien elf twaalf dertien veertien vijftien zestien zeventien achttien negentien".split(),
    "pt": "zero um dois tres quatro cinco seis sete oito nove dez onze doze treze quatorze quinze dezesseis dezessete dezoito dezenove".split(),
}
TENS = {
    "en": list(ENGLISH_TENS),
    "de": "zwanzig dreissig vierzig funfzig sechzig siebzig achtzig neunzig".split(),
    "fr": "vingt trente quarante cinquante soixante".split(),
    "es": "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa".split(),
    "it": "venti trenta quaranta cinquanta sessanta settanta ottanta novanta".split(),
    "nl": "twintig dertig veertig vijftig zestig zeventig tachtig negentig".split(),
    "pt": "vinte trinta quarenta cinquenta sessenta setenta oitenta noventa".split(),
}
HUNDREDS = {"es": "ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos".split(), "pt": "cento duzentos trezentos quatrocentos quinhentos seiscentos setecentos oitocentos novecentos".split()}
SCALES = {
    "en": {"thousand": 3, "million": 6, "billion": 9},
    "de": {"tausend": 3, "million": 6, "millionen": 6, "milliarde": 9, "milliarden": 9},
    "fr": {"mille": 3, "million": 6, "millions": 6, "milliard": 9, "milliards": 9},
    "es": {"mil": 3, "millon": 6, "millones": 6},
    "it": {"mille": 3, "mila": 3, "milione": 6, "milioni": 6, "miliardo": 9, "miliardi": 9},
    "nl": {"duizend": 3, "miljoen": 6, "miljard": 9},
    "pt": {"mil": 3, "milhao": 6, "milhoes": 6, "bilhao": 9, "bilhoes": 9},
}
#: Scales that stand for one of them without a number before.
BARE = {"tausend", "mille", "mil", "duizend"}
OTHER_FORMS = {"pt": {"dezasseis": 16, "dezassete": 17, "dezanove": 19, "catorze": 14, "duas": 2, "cem": 100}, "es": {"cien": 100}, "de": {"zwo": 2, "hundert": 100}, "nl": {"honderd": 100}}
ARTICLES = {"de": {"ein"}, "fr": {"un"}, "es": {"uno"}, "it": {"uno"}, "nl": {"een"}, "pt": {"um"}, "en": set()}
JOINTS = {"en": {"and"}, "pt": {"e"}, "fr": set(), "es": set(), "it": set(), "de": {"und"}, "nl": {"en"}}
#: What stands between ones and tens that are words of their own.
APART = {"de": "und", "nl": "en"}
#: What a compound of thousands has within.
PARTS = {"de": ("tausend",), "nl": ("duizend",), "it": ("mila", "mille")}
MARKS = {"en": (",", "."), "de": (".", ","), "fr": (" ", ","), "es": (".", ","), "it": (".", ","), "nl": (".", ","), "pt": (".", ",")}


def under_hundred(lang: str, n: int) -> list[str]:
    ones, tens = ONES[lang], TENS[lang]
    if n < len(ones):
        return [ones[n]]
    t, u = divmod(n, 10)
    if lang == "fr":
        if n in (17, 18, 19):
            return [f"dix {ones[u]}"]
        if t in (7, 9):
            head = "soixante" if t == 7 else "quatre vingt"
            return [f"{head} et onze" if n == 71 else f"{head} {under_hundred(lang, 10 + u)[0]}"]
        if t == 8:
            return ["quatre vingts", "quatre vingt"] if u == 0 else [f"quatre vingt {ones[u]}"]
    ten = tens[t - 2]
    if u == 0:
        return [ten]
    if lang == "fr":
        return [f"{ten} et un" if u == 1 else f"{ten} {ones[u]}"]
    if lang == "de":
        return [("ein" if u == 1 else ones[u]) + "und" + ten]
    if lang == "nl":
        return [ones[u] + "en" + ten]
    if lang == "it":
        return [(ten[:-1] if u in (1, 8) else ten) + ones[u]]
    if lang == "es":
        return ["veinti" + ones[u]] if t == 2 else [f"{ten} y {ones[u]}"]
    return [f"{ten} e {ones[u]}"] if lang == "pt" else [f"{ten} {ones[u]}"]


def under_thousand(lang: str, n: int) -> list[str]:
    """The ways to say a number under 1,000; in German and Dutch under 2,000, by hundreds."""
    h, rest = divmod(n, 100)
    if h == 0:
        return under_hundred(lang, n)
    tails = under_hundred(lang, rest) if rest else [""]
    if lang in ("de", "nl"):
        word = "hundert" if lang == "de" else "honderd"
        heads = ([word] if h == 1 else []) + [("ein" if lang == "de" and h == 1 else under_hundred(lang, h)[0]) + word]
        mids = ["", "und" if lang == "de" else "en"] if rest else [""]
        return [a + m + b for a, m, b in product(heads, mids, tails)]
    if lang == "it":
        head = ("" if h == 1 else ONES[lang][h]) + "cento"
        return [head + b for b in tails] + ([head[:-1] + b for b in tails] if 80 <= rest < 90 or rest == 8 else [])
    if lang in HUNDREDS:
        return [(HUNDREDS[lang][h - 1] + (" e " if lang == "pt" else " ") + b).strip().removesuffix(" e") for b in tails]
    if lang == "fr":
        return [f"{'' if h == 1 else ONES[lang][h] + ' '}cent{'s' if not rest and h > 1 else ''} {b}".strip() for b in tails] + ([f"{ONES[lang][h]} cent"] if h > 1 and not rest else [])
    return [f"{ONES[lang][h]} hundred {mid}{b}".strip() for b in tails for mid in (("", "and ") if rest else ("",))]


_FORMS: dict[str, tuple[dict[tuple[str, ...], int], int, re.Pattern | None]] = {}
_FIRSTS: dict[str, frozenset[str]] = {}


def firsts(lang: str) -> frozenset[str]:
    """The words that a number can begin with."""
    if lang not in _FIRSTS:
        _FIRSTS[lang] = frozenset({form[0] for form in forms(lang)[0]} | set(SCALES[lang]) | {"ein", "eine", "un"})
    return _FIRSTS[lang]


def forms(lang: str) -> tuple[dict[tuple[str, ...], int], int, re.Pattern | None]:
    """The spoken forms of a language's small numbers, the most words of one, and what parts a compound of thousands; made once."""
    if lang not in _FORMS:
        _FORMS[lang] = made_forms(lang)
    return _FORMS[lang]


def made_forms(lang: str) -> tuple[dict[tuple[str, ...], int], int, re.Pattern | None]:
    known = {tuple(form.split()): n for n in range(2000 if lang in ("de", "nl") else 1000) for form in under_thousand(lang, n)}
    known |= {(form,): n for form, n in OTHER_FORMS.get(lang, {}).items()}
    if lang == "es":  # veintiun mil
        known |= {(*form[:-1], form[-1].removesuffix("o")): n for form, n in known.items() if form[-1].endswith("uno") and form != ("uno",)}
    if lang in APART:
        # Ones and tens, and hundreds before them, may be said as words of their own.
        ones = {1: "ein"} if lang == "de" else {}
        apart = {(ones.get(n % 10, ONES[lang][n % 10]), APART[lang], TENS[lang][n // 10 - 2]): n for n in range(21, 100) if n % 10}
        hundreds = {(form,): 100 * h for h in range(1, 20) for form in under_thousand(lang, 100 * h) if h != 10}
        tails = apart | {(form,): n for n in range(1, 100) for form in under_hundred(lang, n)}
        known = apart | {(*a, *b): x + y for a, x in hundreds.items() for b, y in tails.items()} | known
    parts = "|".join(PARTS.get(lang, ()))
    return known, max(map(len, known)), re.compile(f"^(.*?)({parts})(.*)$") if parts else None


def whole(tokens: list[str], lang: str) -> list[str]:
    """tokens with compounds of thousands in their parts, where each part is a number."""
    known, _, parts = forms(lang)
    if parts is None:
        return tokens
    words = PARTS[lang]
    out = []
    for w in tokens:
        if not any(x in w for x in words):
            out.append(w)
            continue
        m = parts.match(w)
        pieces = [p for p in m.groups() if p] if m else [w]
        joint = "und" if lang == "de" else "en"
        pieces = [p.removeprefix(joint) if i and p.startswith(joint) and (p.removeprefix(joint),) in known else p for i, p in enumerate(pieces)]
        ok = m and all((p,) in known or p in SCALES[lang] or p in ("ein", "een") for p in pieces)
        out += pieces if ok else [w]
    return out


def spoken(tokens: list[str], i: int, lang: str) -> tuple[int, int]:
    """The number that is said from place i on, and the place behind it; the same place if none is.

    Parts come with falling scales. A scale that is larger than what was said before takes all of it: dos mil quinientos millones.
    """
    known, longest, _ = forms(lang)
    scales, total, last, at = SCALES[lang], 0, 99, i
    while True:
        k = at + (total > 0 and at < len(tokens) and tokens[at] in JOINTS[lang])
        n = next((n for n in range(min(longest, len(tokens) - k), 0, -1) if tuple(tokens[k : k + n]) in known), 0)
        value = known[tuple(tokens[k : k + n])] if n else 1
        if not n and k < len(tokens) and tokens[k] in ("ein", "eine", "un"):
            n = int(k + 1 < len(tokens) and tokens[k + 1] in scales)
        scale = scales.get(tokens[k + n], 0) if k + n < len(tokens) else 0
        if scale and 0 < total < 10**scale and scale > last and (n == 0 or value < 10**last):
            total, last, at = (total + (value if n else 0)) * 10**scale, scale, k + n + 1
            continue
        if scale and scale < last and (n or tokens[k] in BARE) and value:
            total, last, at = total + value * 10**scale, scale, k + n + 1
            continue
        if n and (total == 0 or 0 < value < 1000):
            if n == 1 and total == 0 and tokens[k] in ARTICLES[lang]:
                return 0, i
            return total + value, k + n
        return total, at


def joined(tokens: list[str], lang: str) -> list[str]:
    """tokens with groups of three digits in one, where a language parts them by a space."""
    if MARKS[lang][0] != " ":
        return tokens
    out: list[str] = []
    open_ = False
    for w in tokens:
        if not w[:1].isdigit():
            out.append(w)
            open_ = False
            continue
        goes_on = open_ and re.fullmatch(rf"[0-9]{{3}}(?:{MARKS[lang][1]}[0-9]+)?", w)
        if goes_on:
            out[-1] += w
        else:
            out.append(w)
        open_ = bool(re.fullmatch("[0-9]{3}" if goes_on else "[0-9]{1,3}", w))
    return out


def written(token: str, lang: str) -> str | None:
    """The value of digits with a language's marks; None for other tokens."""
    group, point = MARKS[lang]
    if not re.fullmatch(rf"[0-9]+|[0-9]{{1,3}}(?:[{group}][0-9]{{3}})+(?:[{point}][0-9]+)?|[0-9]+[{point}][0-9]+", token):
        return None
    return written_value(token.replace(group, "").replace(point, "."))


def said(tokens: list[str], lang: str) -> list[tuple[int | str, str]]:
    tokens, begins = joined(whole(tokens, lang), lang), firsts(lang)
    return said_at(tokens, [i for i, w in enumerate(tokens) if w in begins or w[:1].isdigit()], lang)


def said_at(tokens: list[str], places: list[int], lang: str) -> list[tuple[int | str, str]]:
    """The numbers of tokens, which are whole and joined, that begin at one of these places, in order, and not within another."""
    out: list[tuple[int | str, str]] = []
    free = 0
    for i in places:
        if i < free:
            continue
        value = written(tokens[i], lang) if tokens[i][:1].isdigit() else None
        if value is not None:
            out.append((value, "digits"))
            continue
        n, free = spoken(tokens, i, lang)
        if free > i:
            out.append((n, "words"))
    return out


#: What a word may be: the first of a number, digits, a compound of thousands.
BEGINS, DIGITS, COMPOUND = 1, 2, 4


def kinds(words: list[str], lang: str) -> np.ndarray:
    begins, parts = firsts(lang), PARTS.get(lang, ())
    return np.array([BEGINS * (w in begins) | DIGITS * w[:1].isdigit() | COMPOUND * any(x in w for x in parts) for w in words], np.int8)


# What a language says for one and for several thousands and millions, and between parts.
SPELLED = {
    "en": ("one thousand", "thousand", "one million", "million", " "),
    "de": ("tausend", "tausend", "eine million", "millionen", " "),
    "fr": ("mille", "mille", "un million", "millions", " "),
    "es": ("mil", "mil", "un millon", "millones", " "),
    "it": ("mille", "mila", "un milione", "milioni", " "),
    "nl": ("duizend", "duizend", "een miljoen", "miljoen", " "),
    "pt": ("mil", "mil", "um milhao", "milhoes", " e "),
}


def cardinal(n: Column, lang: str) -> Column:
    """A whole number from 0 to 999,999,999 in a language's words, by its forms under 1,000."""
    thousand, thousands, million, millions, between = SPELLED[lang]
    names = F.array(*[F.lit(under_thousand(lang, k)[0]) for k in range(1000)])
    part = lambda k: (F.floor(n / 1000**k) % 1000).cast("int")
    said = lambda k, one, many: F.when(part(k) == 1, one).when(part(k) > 1, F.concat(F.get(names, part(k)), F.lit(f" {many}")))
    rest = F.when((part(0) > 0) | (n == 0), F.get(names, part(0)))
    return F.concat_ws(between, said(2, million, millions), said(1, thousand, thousands), rest)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("value", T.DecimalType(38, 9)), T.StructField("form", T.StringType())])))
def read_in(tokens: pa.Array, lang: pa.Array) -> pa.Array:
    """The numbers of an array of lower-case words without accents, in order, by a row's language: array of (value, form), form words or digits.
    None for a language that isn't known."""
    # Each distinct word of a batch is looked at once; a row is gone through at the few places where a number can begin.
    coded, ends = tokens.flatten().dictionary_encode(), np.cumsum([0, *(n or 0 for n in pc.list_value_length(tokens).to_pylist())])
    words, codes = np.array(coded.dictionary.to_pylist(), object), coded.indices.to_numpy()
    names, of, found = lang.to_pylist(), {}, []
    for name in set(names) & set(ONES):
        of[name] = kinds(words, name)
    for name, a, b in zip(names, ends[:-1], ends[1:], strict=True):
        if name not in of or a == b:
            found.append([])
            continue
        kind = of[name][codes[a:b]]
        places = np.flatnonzero(kind)
        if not len(places):
            found.append([])
            continue
        row = words[codes[a:b]].tolist()
        again = COMPOUND | (DIGITS if MARKS[name][0] == " " else 0)
        found.append(said(row, name) if (kind[places] & again).any() else said_at(row, places.tolist(), name))
    values = pa.array([str(value) for row in found for value, _ in row], pa.string()).cast(ARABIC)
    marks = pa.array([form for row in found for _, form in row], pa.string())
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), pa.StructArray.from_arrays([values, marks], ["value", "form"]))
