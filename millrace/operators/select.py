"""Selection under budgets, caps and quotas. Orders are stable hash orders, so that a selection can be repeated anywhere."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable
from .common import written

#: Parts that the hash order of a group is cut into, so that a running sum needs no task with a whole group.
PARTS = 256


def hashed(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """df with the order h, id by a hash of its key, and the part of it."""
    h = stable(key)
    return df.withColumn("__h", h).withColumn("__part", F.floor(h / ((1 << 32) // PARTS)).cast("int"))


def running_before(df: DataFrame, size: Column, key: str, by: list[str] = ()) -> DataFrame:
    """df with __before: the sum of size over all earlier rows of the group, in hash order of key. Sums of parts are added up first."""
    by = list(by)
    own = hashed(df.withColumn("__size", F.coalesce(size, F.lit(0))), key, by)
    sums = own.groupBy(*by, "__part").agg(F.sum("__size").alias("__sum"))
    ahead = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    skip = sums.select(*(F.col(b).alias(f"__{b}") for b in by), F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__skip"))
    inside = Window.partitionBy(*by, "__part").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__part") == F.col("__p")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"__{b}"))
    joined = own.withColumn("__in", F.coalesce(F.sum("__size").over(inside), F.lit(0))).join(F.broadcast(skip) if not by else skip, same)
    return joined.withColumn("__before", F.col("__skip") + F.col("__in")).drop("__p", "__skip", "__in", "__part", *(f"__{b}" for b in by))


def budget_take(df: DataFrame, budget: Column, size: Column, key: str, by: list[str] = ()) -> DataFrame:
    """Rows of each group until the budget is used; the row that crosses it is taken."""
    return running_before(df, size, key, by).where(F.col("__before") < budget).drop("__before", "__h", "__size")


def budget_take_in_two(df: DataFrame, budget: Column, size: Column, key: str, by: list[str], last: Column, share: float) -> DataFrame:
    """Other rows first, then those for which last holds, up to a share of the budget and to what is left of it."""
    first = budget_take(df.where(~last), budget, size, key, by)
    used = written(first).groupBy(*(F.col(b).alias(f"__{b}") for b in by)).agg(F.sum(size).alias("__used"))
    same = F.lit(True)
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"__{b}"))
    left = running_before(df.where(last), size, key, by).join(used, same, "left")
    room = F.least(budget - F.coalesce("__used", F.lit(0)), budget * share)
    return first.unionByName(left.where(F.col("__before") < room).select(*df.columns))


def capped(df: DataFrame, rare: Column, key: str, caps: list[tuple[str, int, Column]]) -> DataFrame:
    """Caps (group column, most rows, whether it applies) one after another: what one cap removes, the next doesn't count.

    Rare rows come first and count, but are never removed. Other rows follow in hash order.
    Only rows that a cap applies to go through its window, which lets a task send on most rows of a group at most, however many it has.
    """
    out = df.withColumn("__rare", F.coalesce(rare, F.lit(False)))
    for group, most, applies in caps:
        out = written(out.withColumn("__held", F.coalesce(applies, F.lit(False))))
        held = out.where("__held")
        before = held.where("__rare").groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("__before"))
        nth = F.row_number().over(Window.partitionBy(group).orderBy(stable(key), key))
        first = held.where("not __rare").withColumn("__n", nth).where(F.col("__n") <= most)
        first = first.join(before, F.col(group).eqNullSafe(F.col("__group")), "left").where(F.col("__n") + F.coalesce("__before", F.lit(0)) <= most)
        out = out.where("__rare or not __held").unionByName(first.select(*out.columns)).drop("__held")
    return out.drop("__rare")


def round_robin(df: DataFrame, cell: list[str], key: str, n: int) -> DataFrame:
    """n rows, dealt from the cells in turn: first one of each, then a second of each."""
    nth = F.row_number().over(Window.partitionBy(*cell).orderBy(stable(key), key))
    # A cell gives n rows at most, and only these come together.
    return df.withColumn("turn", nth).where(F.col("turn") <= n).orderBy("turn", *cell).limit(n)


def per_group(df: DataFrame, group: list[str], key: str, n: int) -> DataFrame:
    """The first n rows of each group in hash order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(stable(key), key))).where(F.col("__n") <= n).drop("__n")


def value_limit(counts: list[int] | dict[int, int], share: float, rounds: int = 5) -> int:
    """The most rows a value may have, so that none has more than a share of what is then left. counts: rows of each value, or how many
    values have so many rows."""
    values = counts if isinstance(counts, dict) else Counter(counts)
    limit = max(values, default=0)
    for _ in range(rounds):
        total = sum(min(c, limit) * n for c, n in values.items())
        lower = max(1, int(share * total))
        if lower >= limit:
            break
        limit = lower
    return limit


def top_limit(counts: dict[int, int], share: float, rounds: int = 5) -> float:
    """The most rows of each value that has over a share of all, so that these then have that share of what is left. counts: how many values
    have so many rows. Values under the share don't come into it."""
    total = sum(c * n for c, n in counts.items())
    over = {c: n for c, n in counts.items() if c > share * total}
    limit = share * total
    for _ in range(rounds):
        limit = share * (total - sum(n * max(0.0, c - limit) for c, n in over.items()))
    return limit


def cap_values(df: DataFrame, value: str, share: float, key: str) -> DataFrame:
    """df without the last rows, in hash order, of values that hold more than a share of all rows, so many that they hold it of those left.

    How many values have how many rows comes to the driver: k different counts take k * k / 2 rows at least, so of n rows sqrt(2 n) at most.
    Rows of other values, and those without a value, stay.
    """
    by_value = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    counts = {r["__c"]: r.n for r in by_value.groupBy("__c").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(c * n for c, n in counts.items())
    over = by_value.where(F.col("__c") > share * total).select(value)
    capped_ = per_group(df.join(over, value, "left_semi"), [value], key, int(top_limit(counts, share)))
    return df.join(over, value, "left_anti").unionByName(capped_.select(*df.columns))


def largest_n_per_group(df: DataFrame, group: str, inside: Column, target: float) -> DataFrame:
    """(n, inside, total): the most rows a group may keep so that the rows for which inside holds are a target share of all at most.

    Rows outside are always kept. Counted from the sizes of groups, without trying values one by one.
    """
    sizes = df.where(inside).groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    outside = df.where(~inside).agg(F.count(F.lit(1)).alias("outside"))
    levels = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
    # Between two sizes that follow on each other, groups of the larger one or more have n rows, others all of theirs. Different sizes are few.
    order = Window.orderBy("size")
    many = F.sum("groups").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    less = F.coalesce(F.sum(F.col("size") * F.col("groups")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = levels.select("size", F.coalesce(F.lag("size").over(order), F.lit(0)).alias("below"), many.alias("many"), less.alias("less")).join(F.broadcast(outside))
    room = F.floor(F.lit(target / (1 - target)) * F.col("outside") + 1e-9)
    fits = steps.withColumn("n", F.least("size", F.floor((room - F.col("less")) / F.col("many")))).where("n > below")
    inside_n = (F.col("n") * F.col("many") + F.col("less")).alias("inside")
    return fits.orderBy(F.desc("n")).limit(1).select("n", inside_n, (inside_n + F.col("outside")).alias("total"))


def quota_select(df: DataFrame, classes: str, quotas: dict[str, int], key: str) -> DataFrame:
    """Rows until each class has its quota, the rarest class first. A row counts for every class in its array, also for later ones.

    A class is a pass: the rows not yet chosen that have it, in hash order, as many as its quota lacks. There are as many passes as classes.
    """
    held = df.withColumn("__classes", F.col(classes))
    counts = {r.c: r.n for r in held.select(F.explode(F.array_distinct("__classes")).alias("c")).where(F.col("c").isin(*quotas)).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    left = written(held)
    for name in sorted(counts, key=lambda c: (counts[c], c)):
        have = chosen.where(F.array_contains("__classes", name)).count() if chosen is not None else 0
        room = quotas[name] - have
        if room <= 0:
            continue
        took = written(left.where(F.array_contains("__classes", name)).orderBy(stable(key), key).limit(room))
        chosen = took if chosen is None else chosen.unionByName(took)
        left = left.join(took.select(F.col(key).alias("__took")), F.col(key) == F.col("__took"), "left_anti")
    return (chosen if chosen is not None else held.limit(0)).drop("__classes")


def carve_groups(df: DataFrame, group: str, classes: str, targets: dict[str, int], most: float) -> DataFrame:
    """(group) for a held-out part: whole groups, for the rarest class first, smallest first, until each class has its target.

    No class loses more than a share of its rows. Groups in order of rows, then hash; counts by group and class are all that is looked at.
    """
    counts = written(df.select(group, F.explode(F.array_distinct(classes)).alias("c")).where(F.col("c").isin(*targets)).groupBy(group, "c").agg(F.count(F.lit(1)).alias("n")))
    total = {r.c: r.n for r in counts.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    took = None
    for name in sorted(total, key=lambda c: (total[c], c)):
        have = took.join(counts, group).where(F.col("c") == name).agg(F.sum("n")).first()[0] or 0 if took is not None else 0
        room = min(targets[name], int(most * total[name])) - have
        if room <= 0:
            continue
        mine = counts.where(F.col("c") == name)
        if took is not None:
            mine = mine.join(took, group, "left_anti")
        # Small groups first: their sizes are the order, so sums by size tell from where on nothing fits.
        before = running_before(mine.withColumn("__g", F.format_string("%012d %s", "n", F.col(group).cast("string"))), F.col("n"), "__g", ["n"])
        sizes = mine.groupBy("n").agg(F.sum("n").alias("all"))
        smaller = sizes.select(F.col("n").alias("__n"), F.coalesce(F.sum("all").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("smaller"))
        fits = before.join(smaller, F.col("n") == F.col("__n")).where(F.col("smaller") + F.col("__before") + F.col("n") <= room)
        new = written(fits.select(group).distinct())
        took = new if took is None else written(took.unionByName(new).distinct())
    return took if took is not None else df.select(group).limit(0)


def mixed(parts: list[tuple[DataFrame, int | None, str, int]], size: str, key: str) -> DataFrame:
    """Parts (rows, budget or None, tag, times) as one table with part and copy: each up to its budget in hash order, its rows so many times."""
    out = None
    for rows, budget, tag, times in parts:
        took = rows if budget is None else budget_take(rows, F.lit(budget), F.col(size), key)
        each = took.withColumn("part", F.lit(tag)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
        out = each if out is None else out.unionByName(each)
    return out


def filled_to_floor(rows: DataFrame, pool: DataFrame, values: str, key: str, floor: int) -> DataFrame:
    """rows and those of the pool that hold a value (of an array column) with under floor rows so far.

    Each round gives every short value as many rows of the pool, in hash order, as it lacks; a row that several values ask for comes once.
    Rounds go on until nothing is short that the pool can fill. Values met by other values' rows within one round may go over the floor.
    """
    out, left = rows, written(pool)
    counts = written(rows.select(F.explode(F.array_distinct(values)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    while True:
        each = left.select(F.col(key).alias("k"), F.explode(F.array_distinct(values)).alias("v")).join(counts, "v", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < floor)
        # A task sends on floor rows of a value at most.
        asked = each.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy(stable("k"), "k"))).where(F.col("nth") <= floor).where(F.col("nth") <= floor - F.col("n"))
        took = written(left.join(asked.select(F.col("k").alias("__took")).distinct(), F.col(key) == F.col("__took"), "left_semi"))
        if took.isEmpty():
            return out
        out = out.unionByName(took)
        left = written(left.join(took.select(F.col(key).alias("__took")), F.col(key) == F.col("__took"), "left_anti"))
        more = took.select(F.explode(F.array_distinct(values)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        counts = written(counts.unionByName(more).groupBy("v").agg(F.sum("n").alias("n")))
