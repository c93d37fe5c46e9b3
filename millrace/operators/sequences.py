"""Rows in time: islands, windows, stitching, bounds and gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: list[str], order: list[str], value: Column) -> DataFrame:
    """df with island: a number that goes up where value differs from the row before; run-length encoding is a count by it."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = ~value.eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return df.withColumn("__new", new.cast("int")).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def chains(df: DataFrame, key: list[str], start: str, end: str, gap: float = 0.0) -> DataFrame:
    """df with island: ranges of one key that touch, or lie no more than a gap apart, are one."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col(start) > reach + gap, F.lit(True)).cast("int")
    return df.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def window_starts(duration: Column, size: float, stride: float) -> Column:
    """Starts of windows over [0, duration], a stride apart, until one reaches the end."""
    n = F.greatest(F.lit(0), F.ceil((duration - size) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.round(k * stride, 3))


def offsets(n: int, stride: float) -> list[float]:
    """n starts spread over a stride."""
    return [round(k * stride / n, 3) for k in range(n)]


def stitched(windows: DataFrame, words: DataFrame, key: str, size: float) -> DataFrame:
    """Words (key, start, word, t0, t1, times from the window's start) of overlapping windows (key, start, duration), each once, in time.

    Two windows part at the middle of their overlap; a word belongs where its middle lies.
    """
    w = Window.partitionBy(key).orderBy("start")
    ends = windows.withColumn("end", F.least(F.col("start") + size, F.col("duration")))
    mids = ends.withColumn("low", (F.col("start") + F.lag("end").over(w)) / 2).withColumn("high", (F.lead("start").over(w) + F.col("end")) / 2).select(key, "start", "low", "high")
    mid = F.col("start") + (F.col("t0") + F.col("t1")) / 2
    inside = F.coalesce(mid >= F.col("low"), F.lit(True)) & F.coalesce(mid < F.col("high"), F.lit(True))
    return words.join(mids, [key, "start"]).where(inside).select(key, "word", (F.col("start") + F.col("t0")).alias("t0"), (F.col("start") + F.col("t1")).alias("t1"))


def last_before(rows: DataFrame, key: str, value: str, width: float, name: str, back: bool = False) -> DataFrame:
    """rows (key, __at, __point, ...) with name: the last value that isn't null of the rows up to each, in order of (__at, __point); with back
    the first one from each on.

    Time is cut into buckets of a width; what the others have is carried over from their own last values, so a key is as many tasks as it has
    buckets.
    """
    bucket = rows.withColumn("__bucket", F.coalesce(F.floor(F.col("__at") / width), F.lit(-(1 << 63))))
    at = F.struct("__at", "__point")
    known = bucket.where(F.col(value).isNotNull()).groupBy(key, "__bucket").agg((F.min_by(value, at) if back else F.max_by(value, at)).alias("__edge"))
    ahead = Window.partitionBy("__of").orderBy(F.desc("__slot") if back else F.col("__slot")).rowsBetween(Window.unboundedPreceding, -1)
    every = bucket.select(F.col(key).alias("__of"), F.col("__bucket").alias("__slot")).distinct()
    edges = every.join(known, (F.col("__of") == F.col(key)) & (F.col("__slot") == F.col("__bucket")), "left").select("__of", "__slot", F.last("__edge", ignorenulls=True).over(ahead).alias("__carried"))
    w = Window.partitionBy(key, "__bucket").orderBy("__at", "__point")
    inside = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if back else F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    joined = bucket.withColumn("__inside", inside).join(edges, (F.col(key) == F.col("__of")) & (F.col("__bucket") == F.col("__slot")), "left")
    return joined.withColumn(name, F.coalesce("__inside", "__carried")).drop("__bucket", "__inside", "__carried", "__of", "__slot")


def assigned(points: DataFrame, spans: DataFrame, key: str, at: str, width: float = 3600.0) -> DataFrame:
    """points with the n of the span (key, n, s, e, in order) they belong to; the bound of two spans is the middle between them.

    Bounds and points are put in one order and the last bound carried on, so no pair is made. Points without a key or a time belong to no span.
    """
    w = Window.partitionBy(key).orderBy("s")
    marks = spans.withColumn("from", (F.lag("e").over(w) + F.col("s")) / 2).select(key, F.coalesce("from", F.lit(float("-inf"))).alias("__at"), F.col("n").alias("__n")).withColumn("__point", F.lit(0))
    all_ = points.withColumn("__at", F.col(at).cast("double")).withColumn("__point", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    return last_before(all_, key, "__n", width, "n").where("__point = 1").drop("__at", "__n", "__point")


def laid_out(df: DataFrame, key: list[str], order: list[str], duration: str, pause: float) -> DataFrame:
    """df with start: rows end to end, with a pause between."""
    before = F.sum(F.col(duration) + pause).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("start", F.coalesce(before, F.lit(0.0)))


def streams(df: DataFrame, key: list[str], order: list[str], most: int, least: int = 2) -> DataFrame:
    """df with stream: consecutive rows of a key in streams of most rows; streams under least rows go."""
    w = Window.partitionBy(*key).orderBy(*order)
    put = df.withColumn("stream", F.floor((F.row_number().over(w) - 1) / most))
    return put.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*key, "stream"))).where(F.col("__n") >= least).drop("__n")


def anchored(df: DataFrame, key: list[str], at: str, tolerance: float) -> DataFrame:
    """df with anchor: the first row of each group in time; a group has what lies within the tolerance of its first row, not of its last.

    Groups never reach over a gap larger than the tolerance. Times are gone through in order, part by part, with the last anchor carried on;
    nothing of a key is held but that.
    """
    t = F.col(at).cast("double")
    code = F.xxhash64(*key)
    times = df.select(code.alias("__k"), t.alias("__t")).where("__t is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor = None, 0.0
        for batch in batches:
            k, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = np.empty(len(x))
            i = 0
            while i < len(x):
                if k[i] != last or x[i] - anchor > tolerance:
                    last, anchor = k[i], x[i]
                own = i + int(np.searchsorted(k[i:], last, "right"))
                j = max(i + 1, i + int(np.searchsorted(x[i:own], anchor + tolerance, "right")))
                out[i:j] = anchor
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["__k", "__t", "anchor"])

    anchors = times.repartition("__k").sortWithinPartitions("__k", "__t").mapInArrow(run, "__k long, __t double, anchor double")
    return df.withColumn("__c", code).join(anchors, (F.col("__c") == F.col("__k")) & (t == F.col("__t"))).drop("__k", "__t", "__c")


def gaps(df: DataFrame, key: list[str], start: str, end: str, least: float) -> DataFrame:
    """(key, gap_start, gap_end) of a key's rows with nothing for least or more between."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.select(*key, reach.alias("gap_start"), F.col(start).alias("gap_end")).where(F.col("gap_end") - F.col("gap_start") >= least)


def nearest(points: DataFrame, marks: DataFrame, key: str, at: str, mark: str, width: float = 3600.0) -> DataFrame:
    """points with the nearest mark of their key, the earlier of two as near; null without one. No pairs are made."""
    p = points.withColumn("__at", F.col(at).cast("double")).withColumn("__point", F.lit(1))
    m = marks.select(key, F.col(mark).cast("double").alias("__at"), F.col(mark).cast("double").alias("__mark")).distinct().withColumn("__point", F.lit(0))
    both = p.unionByName(m, allowMissingColumns=True)
    seen = last_before(last_before(both, key, "__mark", width, "__b"), key, "__mark", width, "__a", back=True)
    closer = F.when(F.col("__b").isNull() | (F.col("__a") - F.col("__at") < F.col("__at") - F.col("__b")), F.col("__a")).otherwise(F.col("__b"))
    return seen.where("__point = 1").withColumn("nearest", closer).drop("__at", "__point", "__mark", "__a", "__b")


def long_targets(words: DataFrame, key: list[str], reading: str, start: str, end: str, least: int = 3) -> DataFrame:
    """(key, reading, start, end) of the readings with least words or more; words without a reading are none's."""
    own = words.where(F.col(reading).isNotNull()).groupBy(*key, reading).agg(F.count(F.lit(1)).alias("n"), F.min(start).alias("start"), F.max(end).alias("end"))
    return own.where(F.col("n") >= least).drop("n")
