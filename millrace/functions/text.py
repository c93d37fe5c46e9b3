"""Columns over text: words, frames, templates, shingles, keys and distances."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a frame masks like numbers.
CARDINALS = "zero oh o one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion point double triple".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth hundredth thousandth millionth".split()
DECADES = "twenties thirties forties fifties sixties seventies eighties nineties tens noughties hundreds thousands millions billions dozens".split()
FRACTIONS = "half halves quarter quarters thirds fourths fifths sixths sevenths eighths ninths tenths".split()
MONTHS = "january february march april may june july august september october november december".split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
UNITS = "am pm oclock noon midnight dollar dollars cent cents buck bucks percent grand k euro euros pound pounds".split()
MASKED = CARDINALS + ORDINALS + DECADES + FRACTIONS + MONTHS + DAYS + UNITS


def stable(key: Column | str) -> Column:
    """A number from 0 up to 2^32 that stands for a key; the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), 1, 8), 16, 10).cast("long")


def words(text: str) -> Column:
    """Runs of a-z and 0-9 of the lower-case text; none for a text without them."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def frame(tokens: str) -> Column:
    """An array column of words with number words, digits, ordinals, decades, fractions, months, days and units as `#`, runs of `#` as one."""
    mask = [F.lit(x) for x in MASKED]
    shown = F.transform(tokens, lambda w: F.when(w.rlike("^[0-9]+$") | w.isin(*mask), F.lit("#")).otherwise(w))
    return F.filter(shown, lambda w, i: (w != "#") | (i == 0) | (F.get(shown, i - 1) != "#"))


def grams(tokens: str, n: int) -> Column:
    """The n-grams of an array column of tokens, space-joined, in order."""
    at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(F.col(tokens), i, n), " "))).otherwise(F.array().cast("array<string>"))


def frame_shingles(tokens: str) -> Column:
    """Distinct 4-grams of a frame, 3-grams of one with seven words or fewer, a shorter frame whole; and the whole frame, marked."""
    short = F.when(F.size(tokens) < 3, F.array(F.array_join(tokens, " "))).otherwise(grams(tokens, 3))
    return F.array_distinct(F.concat(F.when(F.size(tokens) <= 7, short).otherwise(grams(tokens, 4)), F.array(F.concat(F.lit("= "), F.array_join(tokens, " ")))))


def template(text: str) -> Column:
    """The lower-case text with runs of digits as `#`; empty if it has under three words of letters, which no cap counts."""
    masked = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[0-9]+", "#"))
    return F.when(F.regexp_count(masked, F.lit(r"\p{L}+")) >= 3, masked).otherwise("")


def text_key(tokens: str) -> Column:
    """What tells equal texts: their words. Null under 20 characters or four words, which match nothing."""
    joined = F.array_join(tokens, " ")
    return F.when((F.length(joined) >= 20) & (F.size(tokens) >= 4), joined)


def digit_runs(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[0-9]+"), F.lit(0))


def character_error_rate(label: str, heard: str) -> Column:
    return F.levenshtein(label, heard) / F.greatest(F.lit(1), F.length(label))


def word_distance(a: str, b: str) -> Column:
    """Edit distance of two array columns in words."""
    from .align import distance

    return distance(a, b)


def _decompositions() -> tuple[dict[str, str], dict[str, str], str]:
    """Characters that Unicode decomposes (NFKD) into one other beside accents; into several, ASCII letters, digits or marks; and all accents."""
    one, several, accents = {}, {}, []
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]:
        c = chr(code)
        if unicodedata.combining(c):
            accents.append(c)
            continue
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if bare == c:
            continue
        if len(bare) == 1:
            one[c] = bare
        elif bare and bare.replace("⁄", "/").isascii():  # a half is 1⁄2
            several[c] = bare
    return one, several, "".join(accents)


_ONE, _SEVERAL, _ACCENTS = _decompositions()


def decomposed(text: Column) -> Column:
    """A text without accents, and with ligatures, wide letters, signs and such in plain letters: NFKD without combining characters.

    Characters that stand for several others beyond ASCII, such as Hangul syllables, stay as they are.
    """
    # Characters that translate has no other for go: the accents.
    bare = F.translate(text, "".join(_ONE) + _ACCENTS, "".join(_ONE.values()))
    names = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    # Few distinct characters are left beyond ASCII; a class of all that stand for several would be tried at every place of the text.
    odd = F.array_distinct(F.split(F.regexp_replace(bare, "[\\x00-\\x7f]+", ""), ""))
    return F.aggregate(odd, bare, lambda t, c: F.replace(t, c, F.coalesce(F.element_at(names, c), c)))


def unaccented(text: str) -> Column:
    """Lower-case letters without their accents; ß as ss."""
    return decomposed(F.replace(F.lower(F.col(text)), F.lit("ß"), F.lit("ss")))


def primitive_period(text: str) -> Column:
    """The shortest string whose repetition is the text: its length."""
    return F.length(F.regexp_extract(F.col(text), r"^(.+?)\1*$", 1))


def collapse_repeats(text: str) -> Column:
    """A text in which one to three words that follow on themselves are said once."""
    out = F.col(text)
    for n in (1, 2, 3):
        out = F.regexp_replace(out, r"\b(\w+(?: \w+){%d})(?: \1\b)+" % (n - 1), "$1")
    return out


def unit_norm(tokens: str, units: dict[str, str]) -> Column:
    """Words for units as one word each."""
    names = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])
    return F.transform(tokens, lambda w: F.coalesce(F.element_at(names, w), w))
