"""Rows cut into pieces at pauses, with their spans moved along: all as array columns, a row in one task."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

# Seconds of the longest piece, of the shortest cut and partial ones, and words of a partial piece.
MAX_ROW, MIN_CUT, MIN_PARTIAL, MIN_WORDS = 20.0, 1.0, 1.5, 3

PIECE = StructType().add("a", DoubleType()).add("b", DoubleType()).add("i0", IntegerType()).add("i1", IntegerType())
SAID = StructType().add("low", IntegerType()).add("high", IntegerType()).add("text", StringType())


#: Words are parted by the white space of Spark's expressions.
WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def lists(rows: list[list | None], values: pa.Array) -> pa.Array:
    """values, which are those of all rows end to end, as lists; None is null."""
    ends = np.cumsum([0, *(len(r or ()) for r in rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([r is None for r in rows], pa.bool_()))


@F.arrow_udf(ArrayType(IntegerType()))
def word_starts(text: pa.Array) -> pa.Array:
    """Where each word of a text starts, from 0, as an array: words are parted by white space."""
    return pa.array([None if t is None else [m.start() for m in WORD.finditer(t)] for t in text.to_pylist()], pa.list_(pa.int32()))


def planned(words: Column, duration: Column, cuts: Column, longest: float = MAX_ROW, shortest: float = MIN_CUT) -> Column:
    """Pieces (a, b, i0, i1) of a row, in seconds and words, each at most `longest`; null if some stretch has no cut that allows it.

    cuts: an array of (k, at), in order: the row may be cut at second `at` before word k. A piece ends at the last cut that keeps it within
    longest, and is `shortest` at least but for the last one. A row that is no longer than that is one piece.
    """

    def one(n: int | None, end: float | None, marks: list[dict] | None) -> list[tuple] | None:
        if end is not None and end <= longest:
            return [(0.0, end, 0, n)]
        if end is None or marks is None:
            return None
        a, i, at, out = 0.0, 0, None, []
        for m in [*(m for m in marks if m["at"] < end), {"k": None, "at": end}]:
            if m["at"] - a > longest and at is not None:
                out.append((a, at["at"], i, at["k"]))
                a, i, at = at["at"], at["k"], None
            # Behind a cut what comes next may be too far as well: then nothing allows it.
            if m["at"] - a > longest:
                return None
            if m["k"] is not None and m["at"] - a >= shortest and m["k"] > i:
                at = m
        return [*out, (a, end, i, n)]

    @F.arrow_udf(ArrayType(PIECE))
    def pieces(n: pa.Array, end: pa.Array, marks: pa.Array) -> pa.Array:
        rows = [one(*x) for x in zip(n.to_pylist(), end.to_pylist(), marks.to_pylist(), strict=True)]
        kinds = (("a", pa.float64()), ("b", pa.float64()), ("i0", pa.int32()), ("i1", pa.int32()))
        each = [p for r in rows if r for p in r]
        return lists(rows, pa.StructArray.from_arrays([pa.array([p[j] for p in each], t) for j, (_, t) in enumerate(kinds)], [k for k, _ in kinds]))

    return F.transform(pieces(words, duration, cuts), lambda p: F.struct(F.round(p["a"], 3).alias("a"), F.round(p["b"], 3).alias("b"), p["i0"].alias("i0"), p["i1"].alias("i1")))


@F.arrow_udf(ArrayType(SAID))
def said(text: pa.Array, pieces: pa.Array) -> pa.Array:
    """From which character to which the words of each piece reach, and what they say; nulls where a text has no such words."""

    def one(t: str | None, own: list[dict] | None) -> list[tuple] | None:
        if own is None:
            return None
        places = [m.span() for m in WORD.finditer(t or "")]
        ends = [(places[p["i0"]][0], places[p["i1"] - 1][1]) if p["i0"] < len(places) >= p["i1"] > 0 else None for p in own]
        return [(*e, t[slice(*e)]) if e else (None, None, None) for e in ends]

    rows = [one(*x) for x in zip(text.to_pylist(), pieces.to_pylist(), strict=True)]
    each = [p for r in rows if r for p in r]
    kinds = (("low", pa.int32()), ("high", pa.int32()), ("text", pa.string()))
    return lists(rows, pa.StructArray.from_arrays([pa.array([p[j] for p in each], t) for j, (_, t) in enumerate(kinds)], [k for k, _ in kinds]))


def cut(rows: DataFrame, pieces: Column, text: str = "text", spans: str = "spans", id_: str = "id") -> DataFrame:
    """A row for each piece of each row, with its own text and spans, id (`<id>_p<number>`), parent, piece and duration; other columns stay.

    text: words parted by white space; spans: an array of (start, end, ...), end exclusive. A piece has the exact characters from its first word
    to its last, and the spans that lie whole in it, moved, so that each has the text that it had. Rows without pieces have none.
    """
    # A piece takes its own text along, not the row's.
    found = rows.withColumn("__pieces", pieces).withColumn("__said", said(F.col(text), F.col("__pieces")))
    each = found.select(*(c for c in rows.columns if c != text), F.posexplode(F.arrays_zip("__pieces", "__said")).alias("__j", "__x"))
    each = each.select("*", F.col("__x.__pieces").alias("__p"), F.col("__x.__said.low").alias("__low"), F.col("__x.__said.high").alias("__high"), F.col("__x.__said.text").alias(text))
    inside = F.filter(spans, lambda s: (s["start"] >= F.col("__low")) & (s["end"] <= F.col("__high")))
    moved = F.transform(inside, lambda s: s.withField("start", s["start"] - F.col("__low")).withField("end", s["end"] - F.col("__low")))
    out = each.withColumn("parent", F.col(id_).cast("string")).withColumn(id_, F.concat(F.col(id_).cast("string"), F.lit("_p"), F.col("__j").cast("string"))).withColumn(spans, moved)
    out = out.withColumn("piece", F.array("__p.a", "__p.b")).withColumn("duration", F.round(F.col("__p.b") - F.col("__p.a"), 3))
    return out.select(*dict.fromkeys([*rows.columns, "parent", "piece", "duration"]))
