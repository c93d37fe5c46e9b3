"""Trims of a mix under caps that hold for several classes at once: a row counts for every class that its spans have."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable
from .common import written

#: Parts that the order of a class's rows is cut into, so that a running sum needs no task with a whole class.
PARTS = 256
# The share of external spans in a class, the spans from which a class is looked at, the share of the most frequent value, and rounds.
EXTERNAL, LEAST, TOP, ROUNDS = Fraction(1, 4), 20, Fraction(3, 100), 6


def in_order(key: str) -> Column:
    """A row's place in the order in which rows leave, the same everywhere."""
    return stable(key)


def cut_ends(able: DataFrame, by: str) -> DataFrame:
    """(by, end): the least place of a group before which the steps of its rows add up to its excess; groups where none is are left out.

    able: (by, excess, step, part, place), a part for a stretch of the order of places. Steps may be below 0. Sums of parts tell in which parts that
    place can be, mostly one or two of a group, and only their rows are put in order.
    """
    sums = able.groupBy(by, "part").agg(F.first("excess").alias("excess"), F.sum("step").alias("sum"), F.sum(F.greatest("step", F.lit(0))).alias("most"))
    ahead = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    told = sums.withColumn("skip", F.coalesce(F.sum("sum").over(ahead), F.lit(0)))
    told = told.withColumn("sure", F.min(F.when(F.col("skip") >= F.col("excess"), F.col("part"))).over(Window.partitionBy(by)))
    near = told.where((F.col("skip") + F.col("most") >= F.col("excess")) & (F.col("part") <= F.coalesce("sure", "part")))
    near = written(near.select(F.col(by).alias("__by"), F.col("part").alias("__part"), "skip"))
    met = able.join(F.broadcast(near), (F.col(by) == F.col("__by")) & (F.col("part") == F.col("__part")))
    inside = Window.partitionBy(by, "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    reached = met.select(by, "excess", "place", (F.col("skip") + F.coalesce(F.sum("step").over(inside), F.lit(0))).alias("before"))
    return reached.where("excess <= before").groupBy(by).agg(F.min("place").alias("end"))


def counted(spans: DataFrame, flag: str) -> DataFrame:
    """(id, class, n, e, ...) of spans (id, class, value, flag): a row's spans of a class, and those for which flag holds."""
    return spans.groupBy("id", "class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(flag).cast("int")).alias("e"))


def capped_classes(spans: DataFrame, rows: DataFrame, share: Fraction = EXTERNAL, least: int = LEAST, rounds: int = ROUNDS, extra: DataFrame | None = None, real_floor: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows leave until no class has more than a share of external spans: (id, round) of those that left; (class, n, e, still_over) of what stays.

    spans: (id, class, external); rows: (id, last), where last marks rows that leave only after all others. extra: (class, n), spans that count
    beside these and never leave. In a round each class over the share lets go of rows with an external span of it, in hash order, until
    it is at the share by its own count; a row counts for all its classes, so shares are taken again between rounds. A class under `least`
    spans is left alone; with real_floor also one that has so many only through extra. No more than `rounds` rounds: what is still over then is
    told. Rows without spans stay. What leaves is a cut of an order, found from sums of its parts, so a class may have any share of the rows.
    """
    top, bottom = share.numerator, share.denominator
    each = counted(spans, "external").join(rows.select("id", F.col("last").cast("int").alias("last")), "id")
    # One row for all spans of an id: it leaves or stays whole, and rounds shuffle none of them.
    left = written(each.groupBy("id", "last").agg(F.collect_list(F.struct("class", "n", "e")).alias("spans")).withColumn("h", in_order("id")))
    beside = written(extra.select(F.col("class").alias("c"), F.col("n").alias("x"))) if extra is not None else None
    gone: DataFrame | None = None

    def of_classes(df: DataFrame) -> DataFrame:
        return df.select("id", "last", "h", F.explode("spans").alias("s")).select("id", "last", "h", "s.*")

    def classes_of(df: DataFrame) -> DataFrame:
        sums = of_classes(df).groupBy("class").agg(F.sum("n").alias("own"), F.sum("e").alias("e"))
        if beside is None:
            return sums.withColumn("n", F.col("own"))
        both = sums.join(beside, F.col("class") == F.col("c"), "full")
        return both.select(F.coalesce("class", "c").alias("class"), F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("e", F.lit(0)).alias("e"), (F.coalesce("own", F.lit(0)) + F.coalesce("x", F.lit(0))).alias("n"))

    asked = F.col("n") >= least
    over = lambda df: df.where(asked & (bottom * F.col("e") > top * F.col("n")) & ((F.col("own") >= least) if real_floor else F.lit(True)))
    for k in range(rounds):
        now = written(over(classes_of(left)).where("class is not null").select(F.col("class").alias("c"), (bottom * F.col("e") - top * F.col("n")).alias("excess")))
        if now.isEmpty():
            break
        # The excess falls by what each row takes with it; the first row before which it is gone ends the cut.
        able = of_classes(left).where("e > 0").join(F.broadcast(now), F.col("class") == F.col("c"))
        part = F.col("last") * PARTS + F.floor(F.col("h") / ((1 << 32) // PARTS)).cast("int")
        able = able.select("class", "excess", (bottom * F.col("e") - top * F.col("n")).alias("step"), part.alias("part"), F.struct("last", "h", "id").alias("place"))
        ends = now.join(cut_ends(able, "class"), F.col("c") == F.col("class"), "left")
        cuts = written(ends.agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("end")))).alias("cuts")))

        def leaves(s: Column) -> Column:
            """Whether a span's class lets go of its row: there is a cut of that class, without an end or with one behind the row."""
            at = F.try_element_at("cuts", s["class"])
            return (s["e"] > 0) & at.isNotNull() & F.coalesce(F.struct("last", "h", "id") < at["end"], F.lit(True))

        told = left.crossJoin(F.broadcast(cuts)).withColumn("out", F.exists("spans", leaves))
        left = written(told.drop("cuts"))
        out = left.where("out").select("id", F.lit(k).alias("round"))
        gone = out if gone is None else gone.unionByName(out)
        left = left.where("not out").drop("out")
    if gone is None:
        gone = rows.select("id", F.lit(0).alias("round")).limit(0)
    kept = classes_of(left)
    return gone, kept.select("class", "n", "e", (asked & (bottom * F.col("e") > top * F.col("n"))).alias("still_over"))


def trimmed_beside(made: DataFrame, real: DataFrame, share: Fraction = EXTERNAL, least: int = LEAST) -> DataFrame:
    """(id) of synthetic rows that leave so that they don't bring a class under a cap that its real spans alone are not under.

    made: (id, turn, class) spans of synthetic rows in the turn in which they were chosen; real: (class, n, e). A class of which real spans are
    under `least`, and with synthetic ones not, and over the share of external spans, loses synthetic rows, the last chosen first, until it is
    under `least`. Classes come in order of name; what leaves for one counts for the next. There are few classes, and a step for each.
    """
    bottom, top = share.denominator, share.numerator
    few = real.where(F.col("n") < least).orderBy("class").collect()
    # Spans of other classes decide nothing.
    left = written(made.where(F.col("class").isin([r["class"] for r in few])).groupBy("id", "turn", "class").agg(F.count(F.lit(1)).alias("n"))) if few else made
    gone = None
    for r in few:
        own = left.where(F.col("class") == r["class"])
        total = own.agg(F.sum("n").alias("n")).first().n or 0
        if r.n + total < least or bottom * r.e <= top * (r.n + total):
            continue
        # At most least - 1 spans stay, in as many rows at most.
        first = own.orderBy("turn", "id").limit(least)
        upto = F.sum("n").over(Window.orderBy("turn", "id").rowsBetween(Window.unboundedPreceding, 0))
        stays = first.withColumn("upto", upto).where(F.col("upto") <= least - 1 - r.n).select("id")
        out = written(own.select("id").join(stays, "id", "left_anti"))
        gone = out if gone is None else gone.unionByName(out)
        left = written(left.join(out, "id", "left_anti"))
    return gone.distinct() if gone is not None else made.select("id").limit(0)


def without_top(made: DataFrame, real: DataFrame, share: Fraction = TOP, rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """Synthetic rows leave while the most frequent value has over a share of all spans and they hold it: (id, round); (value, n) that stay over.

    made: (id, turn, value) spans of synthetic rows; real: (value, n). In a round the value with most spans (of equal ones the smallest) is cut
    to the share of what is then left: rows that hold only that value leave first, of these the last chosen first. A value that real spans alone
    put over the share stays over and isn't looked at again. No more than `rounds` values are looked at.
    """
    bottom, top = share.denominator, share.numerator
    each = made.groupBy("id", "turn", "value").agg(F.count(F.lit(1)).alias("n"))
    # One row for all spans of an id, which leaves or stays whole; rounds shuffle none of them.
    left = written(each.groupBy("id", "turn").agg(F.collect_list(F.struct("value", "n")).alias("spans"), F.sum("n").alias("all")))
    latest = left.agg(F.max("turn")).first()[0] or 0
    real = written(real.select("value", "n"))
    of_values = lambda df: df.select(F.explode("spans").alias("s")).select("s.*").unionByName(real).groupBy("value").agg(F.sum("n").alias("n"))
    spared: list = []
    gone = None
    for k in range(rounds):
        counts = written(of_values(left))
        total = counts.agg(F.sum("n").alias("n")).first().n or 0
        worst = counts.where(bottom * F.col("n") > top * total).where(~F.col("value").isin(spared) if spared else F.lit(True)).orderBy(F.desc("n"), "value").first()
        if worst is None:
            break
        own = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.when(s["value"] == worst.value, s["n"]).otherwise(0))
        mixed = (F.size("spans") > 1).cast("int")
        # Parts of the order: by whether there are other values, then by turn from the last on.
        part = mixed * 2 * PARTS - F.floor(F.col("turn") * PARTS / (latest + 1)).cast("int")
        place = F.struct(mixed.alias("mixed"), (-F.col("turn")).alias("turn"), "id")
        told = left.withColumn("own", own).withColumn("place", place)
        step = bottom * F.col("own") - top * F.col("all")
        able = told.where("own > 0").select(F.lit(1).alias("one"), F.lit(bottom * worst.n - top * total).cast("long").alias("excess"), step.alias("step"), part.alias("part"), "place")
        end = written(cut_ends(able, "one").agg(F.min("end").alias("end")))
        leaves = (F.col("own") > 0) & F.coalesce(F.col("place") < F.col("end"), F.lit(True))
        both = written(told.crossJoin(F.broadcast(end)).select("id", "turn", "spans", "all", leaves.alias("out")))
        out = both.where("out").select("id", F.lit(k).alias("round"))
        if out.isEmpty():
            spared.append(worst.value)
            continue
        gone = out if gone is None else gone.unionByName(out)
        left = both.where("not out").drop("out")
        spared += [worst.value] if left.where(F.exists("spans", lambda s: s["value"] == worst.value)).isEmpty() else []
    counts = of_values(left)
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    return gone if gone is not None else made.select("id", F.lit(0).alias("round")).limit(0), counts.where(bottom * F.col("n") > top * total)
