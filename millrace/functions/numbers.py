"""Numbers in words and digits: reading, spelling, candidates, comparison. English, as column expressions."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
ONES = {w: i for i, w in enumerate(UNITS)}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
SCALES = {"thousand": 1000, "million": 1_000_000, "billion": 1_000_000_000}
ROMANS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
#: Marks between groups of three digits, and before decimals.
SEPARATORS = {"en": (",", "."), "de": (".", ","), "fr": (" ", ","), "es": (".", ",")}

#: What reads a number as written.
DIGITS = re.compile(r"[0-9][0-9,]*(\.[0-9]+)?")
ARABIC = pa.decimal128(38, 9)


def lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def written_value(token: str) -> str | None:
    """The value of digits with commas and decimals, to nine places; None for other tokens and for what decimal(38,9) doesn't hold."""
    if not DIGITS.fullmatch(token):
        return None
    whole, _, rest = token.replace(",", "").partition(".")
    if len(whole.lstrip("0")) > 29:
        return None
    return whole if not rest else f"{whole}.{rest}" if len(rest) <= 9 else str(Decimal(f"{whole}.{rest}").quantize(Decimal(10) ** -9, ROUND_HALF_UP, Context(60)))


def said(tokens: list[str | None]) -> list[tuple[int | str, str]]:
    """The numbers of lower-case words, in order, as read() has them."""
    out: list[list] = []
    total = now = 0
    last, begun, idle = "", False, True
    for w in [*tokens, ""]:
        one, ten, scale = ONES.get(w), TENS.get(w), SCALES.get(w)
        if idle and one is None and ten is None:
            if w and w[0] in "0123456789" and (value := written_value(w)) is not None:
                out.append([value, "digits", False])
            continue
        after = last in ("hundred", "scale", "and")
        kind = ""
        if not idle:
            if w == "and" and last in ("hundred", "scale"):
                kind = "and"
            elif w == "hundred" and last == "one" and 1 <= now <= 99:
                kind, now = "hundred", now * 100
            elif scale is not None and now > 0:
                kind, total, now = "scale", total + now * scale, 0
            elif (one and (after or (one <= 9 and last == "ten"))) or (ten and after):
                kind, now = "ten" if ten else "one", now + (one or ten)
            else:
                out.append([total + now, "words", begun])
        if not kind:
            begun = not idle
            total, now = 0, one if one is not None else ten or 0
            kind = "ten" if ten else "one" if one is not None else ""
            if not kind and w and w[0] in "0123456789" and (value := written_value(w)) is not None:
                out.append([value, "digits", False])
        last, idle = kind, not kind
    # Two parts next to each other, 11 to 20 and 10 to 99, are a year.
    joined: list[tuple[int | str, str]] = []
    for value, form, next_to in out:
        if next_to and joined and joined[-1][1] == "words" and 11 <= joined[-1][0] <= 20 and 10 <= value <= 99:
            joined[-1] = (joined[-1][0] * 100 + value, "year")
        else:
            joined.append((value, form))
    return joined


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("value", T.DecimalType(38, 9)), T.StructField("form", T.StringType())])))
def read(tokens: pa.Array) -> pa.Array:
    """The numbers of an array of lower-case words, in order: array of (value, form). form: words, digits, or year for two parts.

    A number in words goes on while its parts fit each other: a unit after a ten, less after `hundred` and the scales, `and` between. Digits
    may have commas and decimals. Two numbers in words next to each other, 11 to 20 and 10 to 99, are a year. None for no words.
    """
    found = [said(x) if x else [] for x in tokens.to_pylist()]
    values = pa.array([str(value) for row in found for value, _ in row], pa.string()).cast(ARABIC)
    forms = pa.array([form for row in found for _, form in row], pa.string())
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), pa.StructArray.from_arrays([values, forms], ["value", "form"]))


def under_thousand(n: Column, use_and: bool = False) -> Column:
    ones = F.array(*[F.lit(w) for w in UNITS])
    tens = F.array(*[F.lit(w) for w in TENS])
    rest = n % 100
    small = F.when(rest < 20, F.get(ones, rest)).otherwise(F.concat_ws(" ", F.get(tens, F.floor(rest / 10).cast("int") - 2), F.when(rest % 10 > 0, F.get(ones, rest % 10))))
    head = F.when(n >= 100, F.concat(F.get(ones, F.floor(n / 100).cast("int")), F.lit(" hundred")))
    return F.concat_ws(" and " if use_and else " ", head, F.when((rest > 0) | (n == 0), small))


def cardinal(n: Column, use_and: bool = False) -> Column:
    """A whole number from 0 up to a million million, in words; null beyond."""
    n = n.cast("bigint")
    parts = []
    for name, scale in reversed([("", 1), *SCALES.items()]):
        group = (F.floor(n / scale) % 1000).cast("int")
        parts.append(F.when((group > 0) | ((n == 0) & (scale == 1)), F.concat_ws(" ", under_thousand(group, use_and), F.lit(name or None).cast("string"))))
    return F.when((n >= 0) & (n < 10**12), F.concat_ws(" ", *parts))


def spelled_digits(token: Column) -> Column:
    """A string of digits, digit by digit."""
    return F.array_join(F.transform(F.split(token, ""), lambda c: F.element_at(lookup({str(i): w for i, w in enumerate(UNITS[:10])}), c)), " ")


def candidates(token: Column, most: int = 64) -> Column:
    """Ways to say a string of digits: as a number, digit by digit, as a year in two parts; each once, most at most, the number first."""
    whole = F.when(F.length(token) <= 12, token.cast("bigint"))
    high, low = F.substring(token, 1, 2).cast("int"), F.substring(token, 3, 2).cast("int")
    tail = F.when(low == 0, F.lit("hundred")).when(low < 10, F.concat(F.lit("oh "), under_thousand(low))).otherwise(under_thousand(low))
    year = F.when(token.rlike("^1[1-9][0-9]{2}$|^20[0-9]{2}$") & ~((high == 20) & (low == 0)), F.concat_ws(" ", under_thousand(high), tail))
    ways = F.array_compact(F.array(cardinal(whole), F.when(F.length(token) > 1, spelled_digits(token)), year, F.when(whole >= 100, cardinal(whole, True))))
    return F.slice(F.array_distinct(F.when(token.rlike("^[0-9]+$"), ways).otherwise(F.array().cast("array<string>"))), 1, most)


def digit_values(token: Column) -> Column:
    """All values of a token of digits: `1.234` is 1234 and 1.234."""
    point = F.when(token.rlike(r"^[0-9]+[.,][0-9]+$"), F.regexp_replace(token, ",", ".").try_cast("decimal(38,9)"))
    groups = F.when(token.rlike(r"^[0-9]{1,3}(?:[.,' ][0-9]{3})+$") | token.rlike("^[0-9]+$"), F.regexp_replace(token, "[^0-9]", "").try_cast("decimal(38,9)"))
    return F.array_compact(F.array_distinct(F.array(groups, point)))


def without_separators(text: Column, lang: Column) -> Column:
    """A text in which marks between groups of three digits are gone, by its language."""
    out = text
    for name, (mark, _) in SEPARATORS.items():
        out = F.when(lang == name, F.regexp_replace(text, f"(?<=[0-9])[{mark}](?=[0-9]{{3}}(?![0-9]))", "")).otherwise(out)
    return out


def roman_value(token: Column) -> Column:
    """The value of a Roman number in its one proper form; null for other tokens."""
    proper = token.rlike("^(?=.)M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$")
    values = F.transform(F.reverse(F.split(token, "")), lambda c: F.element_at(lookup(ROMANS), c))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("most"))
    summed = F.aggregate(values, zero, lambda a, v: F.struct(F.when(v < a["most"], a["sum"] - v).otherwise(a["sum"] + v).alias("sum"), F.greatest(a["most"], v).alias("most")), lambda a: a["sum"])
    return F.when(proper, summed)


def digit_runs(tokens: Column, least: int = 3) -> Column:
    """Runs of least or more spoken digits, `double` and `triple` too, as strings of digits."""
    digit = lookup({w: str(i) for i, w in enumerate(UNITS[:10])} | {"oh": "0"})
    times = lookup({"double": 2, "triple": 3})
    kind = "struct<run: string, times: int, out: array<string>>"

    def step(acc: Column, w: Column) -> Column:
        d, t = F.element_at(digit, w), F.element_at(times, w)
        end = d.isNull() & t.isNull()
        out = F.when(end & (F.length(acc["run"]) >= least), F.concat(acc["out"], F.array(acc["run"]))).otherwise(acc["out"])
        return F.struct(F.when(end, "").when(d.isNotNull(), F.concat(acc["run"], F.repeat(d, acc["times"]))).otherwise(acc["run"]).alias("run"), F.coalesce(t, F.lit(1)).alias("times"), out.alias("out")).cast(kind)

    zero = F.struct(F.lit("").alias("run"), F.lit(1).alias("times"), F.array().cast("array<string>").alias("out")).cast(kind)
    return F.aggregate(F.concat(tokens, F.array(F.lit(""))), zero, step, lambda a: a["out"])


_OUTCOMES = T.StructType([T.StructField(n, T.IntegerType()) for n in ("kept", "changed", "lost", "invented")])


@F.pandas_udf(_OUTCOMES)
def outcomes(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """How the numbers of a reference fare: kept ones are the longest common sequence; of the rest, in each gap, pairs are changed ones."""

    def one(a: list, b: list) -> tuple[int, int, int, int]:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = kept = changed = lost = invented = 0
        gap = [0, 0]
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and a[i] == b[j]:
                kept, i, j = kept + 1, i + 1, j + 1
            elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
                gap[0], i = gap[0] + 1, i + 1
                continue
            else:
                gap[1], j = gap[1] + 1, j + 1
                continue
            both = min(gap)
            changed, lost, invented, gap = changed + both, lost + gap[0] - both, invented + gap[1] - both, [0, 0]
        both = min(gap)
        return kept, changed + both, lost + gap[0] - both, invented + gap[1] - both

    rows = [one(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(ref, hyp, strict=True)]
    return pd.DataFrame(rows, columns=["kept", "changed", "lost", "invented"])


def clock_readings(token: Column) -> Column:
    """Ways to say a time of day as written, `7:30`: each once, the plain one first. None for other tokens."""
    hour, minute = F.regexp_extract(token, "^([01]?[0-9]|2[0-3]):([0-5][0-9])$", 1).try_cast("int"), F.regexp_extract(token, "^([01]?[0-9]|2[0-3]):([0-5][0-9])$", 2).try_cast("int")
    of = lambda h: under_thousand(F.when(h % 12 == 0, 12).otherwise(h % 12))
    plain = F.when(minute == 0, F.concat(under_thousand(hour), F.lit(" o'clock"))).when(minute < 10, F.concat(under_thousand(hour), F.lit(" oh "), under_thousand(minute))).otherwise(F.concat_ws(" ", under_thousand(hour), under_thousand(minute)))
    near = F.when(minute == 15, F.concat(F.lit("quarter past "), of(hour))).when(minute == 30, F.concat(F.lit("half past "), of(hour))).when(minute == 45, F.concat(F.lit("quarter to "), of(hour + 1)))
    return F.when(hour.isNotNull() & minute.isNotNull(), F.array_distinct(F.array_compact(F.array(plain, near)))).otherwise(F.array().cast("array<string>"))


def money_reading(token: Column) -> Column:
    """An amount as written, `$12.50`, in words; null for other tokens."""
    pattern = r"^([$€£])([0-9]{1,12})(?:\.([0-9]{2}))?$"
    names = lookup({"$": "dollar", "€": "euro", "£": "pound"})
    mark, whole, cents = F.regexp_extract(token, pattern, 1), F.regexp_extract(token, pattern, 2).try_cast("bigint"), F.regexp_extract(token, pattern, 3).try_cast("int")
    unit = F.concat(F.element_at(names, mark), F.when(whole == 1, "").otherwise("s"))
    rest = F.when(cents > 0, F.concat(F.lit("and "), under_thousand(cents), F.when(mark == "£", " pence").when(cents == 1, " cent").otherwise(" cents")))
    return F.when(whole.isNotNull(), F.concat_ws(" ", cardinal(whole), unit, rest))
