"""Planned selections: what to make next, by the gain of one more; and rows by variety, under several capacities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable
from . import ordering
from .common import written


def allocated(values: DataFrame, limits: dict[str, int], totals: dict[str, int], share: float, most: int, error=lambda c: 1 / (1 + c)) -> DataFrame:
    """(class, value, new): how many rows of each value are made, where each goes to the value that gains most by one more.

    values: (class, value, weight, have), and made, if there is such a column, of the most that a value may get. The gain of one more is weight * (error(c) - error(c + 1)) with c rows there; error is a column
    expression that falls ever more slowly, so the gains of a value fall. limits: rows a class may get; totals: rows it has. A value that has `most`
    new rows, or would have over a share of the class's rows by then, gets no more. Of equal gains the smaller value is first.

    That is the rule of a queue that is asked again and again. Here all gains are put into one order: a row of it is taken if its class has
    room when those before it are. Those that a value's share forbids are taken out with all later ones of the value, which brings others
    forward, until none is forbidden: each round forbids only what the queue would, as rows before a place only become fewer.
    """
    # No value gets more than its class's room.
    room = F.coalesce(*[F.when(F.col("class") == c, F.lit(n)) for c, n in limits.items()], F.lit(0))
    total = F.coalesce(*[F.when(F.col("class") == c, F.lit(n)) for c, n in totals.items()], F.lit(0))
    free = F.least(room, F.lit(most) - (F.col("made") if "made" in values.columns else F.lit(0)))
    steps = values.where(free > 0).select("class", "value", "weight", "have", F.explode(F.sequence(F.lit(0), (free - 1).cast("int"))).alias("j"))
    c = F.col("have") + F.col("j")
    gain = F.col("weight") * (error(c.cast("double")) - error(c.cast("double") + 1))
    open_ = written(ordering.placed(steps.select("class", "value", "have", "j", gain.alias("gain")), [F.col("class"), F.desc("gain"), F.col("value"), F.col("j")]))
    while True:
        ranked = written(ordering.before(open_, ["class"], F.lit(1), "rank"))
        forbidden = (F.col("rank") < room) & (F.col("have") + F.col("j") + 1 > share * (total + F.col("rank") + 1))
        stops = written(ranked.where(forbidden).groupBy(F.col("class").alias("k"), F.col("value").alias("v")).agg(F.min("j").alias("stop")))
        if stops.isEmpty():
            return ranked.where(F.col("rank") < room).groupBy("class", "value").agg(F.count(F.lit(1)).alias("new"))
        open_ = open_.join(stops, (F.col("class") == F.col("k")) & (F.col("value") == F.col("v")), "left").where("stop is null or j < stop").select(*open_.columns)


def allocated_in_turn(values: DataFrame, budget: int, shares: dict[str, float], rooms: dict[str, int], totals: dict[str, int], share: float, most: int, rest: list[str]) -> DataFrame:
    """(class, value, new) for a budget: each class gets its share of it where its room and values allow; what is left goes to the classes of rest,
    one after another."""
    have = written(values.withColumn("new", F.lit(0).cast("long")))

    def run(limits: dict[str, int]) -> None:
        nonlocal have
        used = {r["class"]: r.n for r in have.groupBy("class").agg(F.sum("new").alias("n")).collect()}
        free = {c: max(0, min(n, rooms[c] - used.get(c, 0))) for c, n in limits.items()}
        now = have.select("class", "value", "weight", (F.col("have") + F.col("new")).alias("have"), F.col("new").alias("made"))
        got = allocated(now, free, {c: totals[c] + used.get(c, 0) for c in limits}, share, most).select(F.col("class").alias("k"), F.col("value").alias("v"), F.col("new").alias("more"))
        met = have.join(got, (F.col("class") == F.col("k")) & (F.col("value") == F.col("v")), "left")
        have = written(met.select("class", "value", "weight", "have", (F.col("new") + F.coalesce("more", F.lit(0))).alias("new")))

    run({c: int(budget * s) for c, s in shares.items()})
    for c in rest:
        left = budget - (have.agg(F.sum("new").alias("n")).first().n or 0)
        if left > 0:
            run({c: left})
    return have.where("new > 0").select("class", "value", "new")


#: Rows of an order that are first decided by themselves; what comes later is looked at four times as far each time.
HEAD = 1 << 14


def fitting(rows: DataFrame, order: list[Column], capacities: dict[str, tuple[Column, int]]) -> DataFrame:
    """(id, turn) of rows that are taken when rows are gone through in an order and each is taken for which all its groups have room.

    rows: id and any columns. capacities: a name, an array of the groups of that name that a row is in, as strings (null and empty: none), and the
    rows that each may have. In a round every row is taken that comes within the room that is left in all its groups, counting rows before it
    that aren't decided as if they were taken; rows of full groups go. So a row is only taken or dropped when the rule would do so, and the
    first of the undecided is always taken. A group may have any share of the rows. Rounds are gone through for the first HEAD rows, then for
    the next, of which rows of groups that are full by then have gone: what is decided never hangs on later rows.
    """

    def named(name: str, groups: Column) -> Column:
        own = F.array_distinct(F.coalesce(groups, F.array().cast("array<string>")))
        return F.transform(own, lambda x: F.concat(F.lit(f"{name}:"), x))

    keyed = rows.select("id", F.array_compact(F.flatten(F.array(*[named(k, g) for k, (g, _) in capacities.items()]))).alias("groups"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    later = written(ordering.placed(keyed, [F.col(f"o{i}") for i in range(len(order))]).select("id", "turn", "groups"))
    most = F.coalesce(*[F.when(F.col("g").startswith(f"{k}:"), F.lit(n)) for k, (_, n) in capacities.items()])
    taken = later.select("id", "turn").limit(0)
    used = written(later.select(F.explode("groups").alias("u"), F.lit(0).cast("long").alias("n")).limit(0))

    def without_full(rows: DataFrame) -> DataFrame:
        full = used.withColumn("g", F.col("u")).where(F.col("n") >= most).select("g")
        dropped = rows.select("id", F.explode("groups").alias("g")).join(full, "g", "left_semi").select("id").distinct()
        return written(rows.join(dropped, "id", "left_anti"))

    head = HEAD
    while (first := later.agg(F.min("turn")).first()[0]) is not None:
        upto = first + head
        open_ = written(later.where(F.col("turn") < upto))
        while not open_.isEmpty():
            each = open_.select("id", "turn", F.explode("groups").alias("g"))
            ranked = ordering.before(each, ["g"], F.lit(1), "rank").join(used, F.col("g") == F.col("u"), "left")
            waits = written(ranked.where(F.col("rank") >= most - F.coalesce("n", F.lit(0))).select("id").distinct())
            now = written(open_.join(waits, "id", "left_anti"))
            taken = taken.unionByName(now.select("id", "turn"))
            used = written(used.unionByName(now.select(F.explode("groups").alias("u"), F.lit(1).cast("long").alias("n"))).groupBy("u").agg(F.sum("n").alias("n")))
            open_ = without_full(open_.join(waits, "id", "left_semi"))
        later = without_full(later.where(F.col("turn") >= upto))
        head *= 4
    return taken


def varied(rows: DataFrame, n: int, shares: dict[str, float], per_video: int = 8, per_template: int = 3, per_year: int = 3, forward: int = 2025) -> DataFrame:
    """(id, turn) of up to n rows, variety first. rows: (id, class, video, template, text, years array<long>, values array<string>).

    Rows of years come first: those of years from `forward` on, then others, in the order of years, of each year first one row, then a second
    and so on. The other classes follow in turn, in the order of shares, in each first the rows that are the first to have a value, in
    hash order. A video, a template, a year, a class (its share of n) and all have a capacity; a text is taken once.
    """
    h = stable("id")
    none = [c for c, s in shares.items() if int(s * n) < 1]
    # Of a text only a digest goes on: texts go through no shuffle and are written nowhere.
    key = F.sha2(F.lower(F.trim(F.coalesce("text", F.lit("")))), 256)
    rows = rows.select("id", "class", "video", "template", "years", "values", key.alias("text"))
    own = written(rows.where(~F.col("class").isin(none) if none else F.lit(True)).withColumn("h", h).withColumn("dated", F.col("class") == "year"))
    years = own.where("dated").withColumn("y", F.array_min("years"))
    ahead = F.array_max("years") >= forward
    firsts = written(years.select("id", "h", "y", F.coalesce(ahead, F.lit(False)).alias("ahead")))
    nth = F.col("nth")
    firsts = ordering.before(ordering.placed(firsts, [F.col("h"), F.col("id")], "t"), ["y", "ahead"], F.lit(1), "nth", "t")
    dated = firsts.select("id", F.lit(0).alias("phase"), nth.cast("long").alias("a"), (~F.col("ahead")).cast("long").alias("b"), F.coalesce("y", F.lit(0)).cast("long").alias("c"))
    rest = own.where("not dated")
    first = rest.select("class", "id", "h", F.explode("values").alias("v")).groupBy("class", "v").agg(F.min(F.struct("h", "id")).alias("f")).select("f.id").distinct().withColumn("fresh", F.lit(0))
    queue = written(rest.select("id", "class", "h").join(first, "id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(1))))
    line = ordering.placed(queue, [F.col("class"), F.col("fresh"), F.col("h"), F.col("id")], "t")
    spot = ordering.before(line, ["class"], F.lit(1), "at", "t")
    number = F.coalesce(*[F.when(F.col("class") == c, F.lit(i)) for i, c in enumerate(shares)], F.lit(len(shares)))
    others = spot.select("id", F.lit(1).alias("phase"), F.col("at").cast("long").alias("a"), number.cast("long").alias("b"), F.lit(0).cast("long").alias("c"))
    ordered = own.join(dated.unionByName(others), "id")
    of_class = {f"class {c}": (F.when(F.col("class") == c, F.array(F.lit("all"))), int(s * n)) for c, s in shares.items()}
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string")))
    capacities = {"video": (one("video"), per_video), "template": (one("template"), per_template), "text": (F.array("text"), 1), "year": (F.transform("years", lambda y: y.cast("string")), per_year), **{k: v for k, v in of_class.items() if v[1] > 0}, "any": (F.array(F.lit("all")), n)}
    return fitting(ordered, [F.col(c) for c in ("phase", "a", "b", "c", "h", "id")], capacities)
