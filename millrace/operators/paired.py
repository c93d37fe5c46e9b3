"""Two arms on the same items, thresholds on margins, and gates that fail on what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson

# The thresholds of a curve.
THRESHOLDS = (0, 0.25, 0.5, 1, 2, 3, 5, 8, 12)


def moves(base: DataFrame, arm: DataFrame, key: list[str], group: list[str]) -> DataFrame:
    """(group, n, base_ok, arm_ok, fixed, broken) over the items that both tables (key, ok) have."""
    both = base.withColumnRenamed("ok", "base_ok").join(arm.select(*key, F.col("ok").alias("arm_ok")), key)
    n = lambda c: F.sum(c.cast("int"))
    a, b = F.col("base_ok"), F.col("arm_ok")
    return both.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), n(a).alias("base_ok"), n(b).alias("arm_ok"), n(~a & b).alias("fixed"), n(a & ~b).alias("broken"))


def curve(rows: DataFrame, group: list[str], margin: str, tie: str, correct: str, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """(group, threshold, spans, coverage, correct, accuracy, wilson_low) at each threshold; ties count at threshold 0 only."""
    passed = [F.struct(F.lit(float(t)).alias("threshold"), ((F.col(margin) >= t) & ((F.lit(t) <= 0) | ~F.col(tie))).alias("in")) for t in thresholds]
    each = rows.select(*group, correct, F.explode(F.array(*passed)).alias("t"))
    counted = each.groupBy(*group, F.col("t.threshold").alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t.in").cast("int")).alias("spans"), F.sum((F.col("t.in") & F.col(correct)).cast("int")).alias("correct"))
    low, _ = wilson(F.col("correct"), F.col("spans"))
    return counted.select(*group, "threshold", "spans", (F.col("spans") / F.col("n")).alias("coverage"), "correct", F.when(F.col("spans") > 0, F.col("correct") / F.col("spans")).alias("accuracy"), low.alias("wilson_low"))


def picked(points: DataFrame, group: list[str], accuracy: float, low: float, coverage: float) -> DataFrame:
    """(group, threshold): the smallest one that meets all three bars; null where none does."""
    meets = (F.col("accuracy") >= accuracy) & (F.col("wilson_low") >= low) & (F.col("coverage") >= coverage)
    return points.groupBy(*group).agg(F.min(F.when(meets, F.col("threshold"))).alias("threshold"))


def decision(status: Column, margin: Column, tie: Column, changed: Column, threshold: Column) -> Column:
    """keep, relabel or unconfirmed. Nothing is dropped."""
    unsure = status.isin("error", "align_fail", "cer_high") | (F.coalesce(margin, F.lit(99.0)) < threshold) | F.coalesce(tie, F.lit(False))
    return F.when(unsure, "unconfirmed").when(changed, "relabel").otherwise("keep")


def no_damage(base: DataFrame, arm: DataFrame, key: str, points: float) -> DataFrame:
    """(key, base, arm, ok): the arm's rate of each key is no more than some points above the base's. A key that either lacks fails."""
    both = base.select(key, F.col("rate").alias("base")).join(arm.select(key, F.col("rate").alias("arm")), key, "full")
    return both.withColumn("ok", F.coalesce(100 * (F.col("arm") - F.col("base")) <= points, F.lit(False)))


def seam_counts(reads: DataFrame, group: list[str], slot: list[str], right: str) -> DataFrame:
    """(group, n, total, seam, always): wrong readings; those of slots that are right elsewhere; those of slots that never are."""
    own = reads.groupBy(*group, *slot).agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col(right)).cast("int")).alias("w"))
    seam, always = F.when((F.col("w") > 0) & (F.col("w") < F.col("n")), F.col("w")), F.when(F.col("w") == F.col("n"), F.col("w"))
    return own.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("w").alias("total"), F.coalesce(F.sum(seam), F.lit(0)).alias("seam"), F.coalesce(F.sum(always), F.lit(0)).alias("always"))


def incomplete_slots(reads: DataFrame, slot: list[str], offsets: int) -> DataFrame:
    """Slots without exactly so many readings, which are errors of the input."""
    return reads.groupBy(*slot).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != offsets)


def common_counts(a: DataFrame, b: DataFrame, key: list[str], group: list[str]) -> DataFrame:
    """(group, common, a, b): the multiset intersection of two tables' values, and the sizes of both."""
    x, y = (t.groupBy(*key).agg(F.count(F.lit(1)).alias(n)) for t, n in ((a, "x"), (b, "y")))
    both = x.join(y, key, "full").fillna(0, ["x", "y"])
    return both.groupBy(*group).agg(F.sum(F.least("x", "y")).alias("common"), F.sum("x").alias("a"), F.sum("y").alias("b"))


def spans_by_loss(losses: DataFrame, span: list[str], candidate: str, loss: str, current: Column) -> DataFrame:
    """(span, chosen, margin, tie, current_rank, candidates): the candidate with the least loss of each span, and how far the second is.

    One candidate alone has the margin 99. A margin under 0.25 is a tie.
    """
    nth = losses.withColumn("nth", F.row_number().over(Window.partitionBy(*span).orderBy(loss, candidate))).withColumn("own", current)
    out = nth.groupBy(*span).agg(
        F.max(F.when(F.col("nth") == 1, F.col(candidate))).alias("chosen"),
        (F.max(F.when(F.col("nth") == 2, F.col(loss))) - F.max(F.when(F.col("nth") == 1, F.col(loss)))).alias("gap"),
        F.min(F.when(F.col("own"), F.col("nth"))).alias("current_rank"),
        F.count(F.lit(1)).alias("candidates"),
    )
    margin = F.coalesce("gap", F.lit(99.0))
    return out.select(*span, "chosen", margin.alias("margin"), (margin < 0.25).alias("tie"), "current_rank", "candidates")


def replaced(text: Column, spans: Column) -> Column:
    """text with each of the spans (a, b, new), ordered by a and apart from each other, replaced by its new text; from the last one back."""
    return F.aggregate(F.reverse(spans), text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["a"]), s["new"], F.substring(t, s["b"] + 1, F.length(t))))
