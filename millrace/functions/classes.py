"""Classes of numbers as written. Censuses, gates and selections all take them from here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number as written: digits with separators inside.
SPAN = r"[0-9]+(?:[.,][0-9]+)*"

# Shapes of numbers that are counted in texts.
SHAPES = {
    "clock": r"\b[0-2]?[0-9]:[0-5][0-9]\b",
    "percent": r"[0-9] ?%",
    "money": r"[$€£] ?[0-9]|[0-9] ?[$€£]",
    "thousands": r"\b[0-9]{1,3}(?:,[0-9]{3})+\b",
    "decimal": r"\b[0-9]+\.[0-9]+\b",
    "year": r"\b(?:1[89]|20)[0-9]{2}\b",
    "digits_5": r"[0-9]{5,}",
}


def spans(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(SPAN), F.lit(0))


def span_class(token: Column) -> Column:
    """year and year_early by the written form of four digits; else int_small under 1000, int_big; int_other without digits alone."""
    bare = F.regexp_replace(token, r"[\s.,']", "")
    year = F.when(token.rlike("^[0-9]{4}$"), token.cast("int"))
    digits = bare.rlike("^[0-9]+$")
    # Ten digits or more are int_big whatever the number type holds.
    small = (F.length(F.regexp_replace(bare, "^0+(?=[0-9])", "")) <= 3) & digits
    return F.when(year.between(1800, 2099), "year").when(year.between(1100, 1799), "year_early").when(small, "int_small").when(digits, "int_big").otherwise("int_other")


def shape_counts(text: str) -> list[Column]:
    return [F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(p)).alias(k) for k, p in SHAPES.items()]


def risk_tags(value: Column) -> Column:
    """Reasons to look at a span twice."""
    return F.array_compact(F.array(F.when(value.rlike("^[0-9]{7,}$"), F.lit("long")), F.when(value.rlike(r"([0-9])\1\1"), F.lit("repeat")), F.when(value.rlike("^0[0-9]"), F.lit("code"))))


def first_reason(*reasons: tuple[str, Column]) -> Column:
    """The first reason that holds, null if none does."""
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in reasons])
