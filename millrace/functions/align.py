"""Alignment of two arrays of words, and what follows from it; folding of text beyond the western letters. Arrow batches, one small step a row."""

from __future__ import annotations

import unicodedata
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PAIRS = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))

#: Costs that are all kept.
WHOLE = 1 << 20


def aligned(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """Pairs of places of a best alignment: equal or changed words, (i, None) for a lost one, (None, j) for an added one. Changes go first.

    Of long arrays costs are kept for every so many rows, the root of all, and those between are found again on the way back: these take no
    memory of the lengths' product.
    """
    codes = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = [codes[w] for w in a], np.array([codes[w] for w in b], np.int64)
    steps = np.arange(len(b) + 1, dtype=np.int32)

    def after(row: np.ndarray, i: int) -> np.ndarray:
        row = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (y != x[i - 1])]))
        # The cheapest place further left, plus a step for each word between.
        return (np.minimum.accumulate(row - steps) + steps).astype(np.int32)

    small = len(a) * len(b) <= WHOLE
    block = max(1, len(a) if small else isqrt(len(a)))
    row, kept = steps, [steps]
    for i in range(1, len(a) + 1):
        row = after(row, i)
        if small or i % block == 0:
            kept.append(row)
    out, i, j = [], len(a), len(b)
    while i:
        first = (i - 1) // block * block
        cost = kept if small else [kept[first // block]]
        for k in range(first + len(cost), i + 1):
            cost.append(after(cost[-1], k))
        while i > first:
            here, above = cost[i - first], cost[i - first - 1]
            if j and here[j] == above[j - 1] + (x[i - 1] != y[j - 1]):
                i, j = i - 1, j - 1
                out.append((i, j))
            elif here[j] == above[j] + 1:
                i -= 1
                out.append((i, None))
            else:
                j -= 1
                out.append((None, j))
    out += [(None, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


@F.arrow_udf(_PAIRS)
def align(a: pa.Array, b: pa.Array) -> pa.Array:
    sizes, places = [0], []
    for x, y in zip(a, b, strict=True):
        pairs = aligned(x.as_py(), y.as_py()) if x.is_valid and y.is_valid else None
        sizes.append(None if pairs is None else len(pairs))
        places.append(np.array([[-1 if i is None else i, -1 if j is None else j] for i, j in pairs or ()], np.int32).reshape(-1, 2))
    both = np.concatenate([*places, np.zeros((0, 2), np.int32)])
    i, j = (pa.array(both[:, k], mask=both[:, k] < 0) for k in (0, 1))
    ends = np.cumsum([n or 0 for n in sizes])
    # A list is null whose offset is.
    missing = np.array([n is None for n in sizes[1:]] + [False])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=missing), pa.StructArray.from_arrays([i, j], ["i", "j"]))


def edit_distance(a: list, b: list) -> int:
    """Lost, added and changed items between two lists: a column of the table of costs at a time, as the bits of two whole numbers that say
    where it rises and falls."""
    n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[n:], b[n:]
    n = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    rises, falls = full, 0
    for w in b:
        same = places.get(w, 0)
        down = same | falls
        across = (((same & rises) + rises) ^ rises) | same
        more, less = falls | (full & ~(across | rises)), rises & across
        score += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, less << 1 & full
        rises, falls = less | (full & ~(down | more)), more & down
    return score


@F.arrow_udf(T.IntegerType())
def distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """edit_distance of two arrays of words, row by row."""
    return pa.array([edit_distance(x.as_py(), y.as_py()) if x.is_valid and y.is_valid else None for x, y in zip(a, b, strict=True)], pa.int32())


def edits(pairs: Column, a: Column, b: Column) -> Column:
    """Changed, lost and added words of an alignment."""
    return F.size(F.filter(pairs, lambda p: p["i"].isNull() | p["j"].isNull() | (F.get(a, p["i"]) != F.get(b, p["j"]))))


def lost_words(pairs: Column, a: Column, least: int = 4) -> Column:
    """Words of least letters or more that the second array lacks."""
    lost = F.filter(pairs, lambda p: p["j"].isNull())
    return F.filter(F.transform(lost, lambda p: F.get(a, p["i"])), lambda w: F.length(w) >= least)


def added_words(pairs: Column, b: Column, least: int = 4) -> Column:
    added = F.filter(pairs, lambda p: p["i"].isNull())
    return F.filter(F.transform(added, lambda p: F.get(b, p["j"])), lambda w: F.length(w) >= least)


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Lower case without accents, letters and digits alone: what tells equal texts in any script."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        plain = unicodedata.normalize("NFKD", t.lower().replace("ß", "ss"))
        return "".join(c for c in plain if not unicodedata.combining(c) and (c.isalnum()))

    return text.map(one)
