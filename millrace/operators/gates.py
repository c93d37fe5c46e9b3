"""The data gate: what a language's rows must hold before they are trained on, one row a check.

Demands are a table, and what there is another one, of (lang, class, statistic, got); a check is a row of the first joined to the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIERS = ("full", "next", "moderate", "light")

# What each tier demands. Columns: check | class | statistic | values | rows of each value, by tier | comparison | wanted, by tier |
# only where | or where. `-`: not in this tier. Class `*`: each class that is looked at; `+`: each but year_early and int_other.
# Statistic values: of the values given, those with so many rows. bar: the spans that the tier demands of the class. limit: synthetic share.
DEMANDS = """
year spans                                      | year      | spans         |                     |             | >= | 1500 825 375 -    |             |
year hours                                      | year      | hours         |                     |             | >= | 3 1.65 - -        |             |
years 1900-2030 seen                            | year      | values        | 1900-2030           | 1 1 - -     | >= | 110 110 - -       |             |
year values seen >=10x                          | year      | values        |                     | 10 10 - -   | >= | 60 60 - -         |             |
every 1990-2030 >= {rows}                       | year      | values        | 1990-2030           | 40 20 8 -   | >= | 41 41 41 -        |             |
every 1990-2030 >= {rows} (hard floor)          | year      | values        | 1990-2030           | 10 10 - -   | >= | 41 41 - -         |             |
every 2031-2060 >= {rows}                       | year      | values        | 2031-2060           | 10 5 - -    | >= | 30 30 - -         |             |
forward years present ({want:g}+ of 2031-2060)  | year      | values        | 2031-2060           | - - 1 -     | >= | - - 10 -          |             |
2030/2035/2040/2050 >= {rows}                   | year      | values        | 2030 2035 2040 2050 | 40 20 5 -   | >= | 4 4 4 -           |             |
year singleton share <= 20%                     | year      | single_share  |                     |             | <= | 0.2 0.2 - -       |             |
top year value <= 3%                            | year      | top_share     |                     |             | <= | 0.03 0.03 - -     |             |
top year value <= 5%                            | year      | top_share     |                     |             | <= | - - 0.05 -        |             |
int_small spans                                 | int_small | spans         |                     |             | >= | 2500 1375 625 -   |             |
each 0-100 >= {rows}x                           | int_small | values        | 0-100               | 10 6 - -    | >= | 101 101 - -       |             |
each hundred >= {rows}x                         | int_small | values        | 100 200 300 400 500 600 700 800 900 | 5 3 - - | >= | 9 9 - -   |             |
int_small top-5 <= 30%                          | int_small | top_5_share   |                     |             | <= | 0.3 0.3 - -       |             |
top int_small value <= 5%                       | int_small | top_share     |                     |             | <= | - - 0.05 -        |             |
int_small hours                                 | int_small | hours         |                     |             | >= | 3 1.65 - -        |             |
int_big spans                                   | int_big   | spans         |                     |             | >= | 400 220 100 -     |             |
int_big distinct                                | int_big   | distinct      |                     |             | >= | 200 110 - -       |             |
int_big each scale >= {want:g}                  | int_big   | least_scale   |                     |             | >= | 50 28 - -         |             |
top int_big value <= 5%                         | int_big   | top_share     |                     |             | <= | - - 0.05 -        |             |
dec spans                                       | dec       | spans         |                     |             | >= | 300 165 75 -      |             |
pct spans                                       | pct       | spans         |                     |             | >= | 300 165 75 -      |             |
cur spans                                       | cur       | spans         |                     |             | >= | 300 165 75 -      |             |
clock spans                                     | clock     | spans         |                     |             | >= | 300 165 75 -      |             |
phone spans                                     | phone     | spans         |                     |             | >= | 300 165 - -       |             |
ord spans                                       | ord       | spans         |                     |             | >= | 200 110 - -       |             |
date spans                                      | date      | spans         |                     |             | >= | 150 82 - -        |             |
range spans                                     | range     | spans         |                     |             | >= | 150 82 - -        |             |
decade spans                                    | decade    | spans         |                     |             | >= | 150 82 - -        |             |
unit spans                                      | unit      | spans         |                     |             | >= | 150 82 - -        |             |
decision-set year spans                         | year      | held          |                     |             | >= | 150 80 40 -       |             |
decision-set dec spans                          | dec       | held          |                     |             | >= | 30 16 10 -        | spans >= bar |
decision-set pct spans                          | pct       | held          |                     |             | >= | 30 16 10 -        | spans >= bar |
decision-set cur spans                          | cur       | held          |                     |             | >= | 30 16 10 -        | spans >= bar |
decision-set clock spans                        | clock     | held          |                     |             | >= | 30 16 10 -        | spans >= bar |
decision-set phone spans                        | phone     | held          |                     |             | >= | 30 16 - -         | spans >= bar |
decision-set ord spans                          | ord       | held          |                     |             | >= | 30 16 - -         | spans >= bar |
decision-set date spans                         | date      | held          |                     |             | >= | 30 16 - -         | spans >= bar |
decision-set range spans                        | range     | held          |                     |             | >= | 30 16 - -         | spans >= bar |
decision-set decade spans                       | decade    | held          |                     |             | >= | 30 16 - -         | spans >= bar |
decision-set unit spans                         | unit      | held          |                     |             | >= | 30 16 - -         | spans >= bar |
real number-row hours                           | rows      | real_hours    |                     |             | >= | 10 5.5 2.5 -      |             |
real window hours                               | rows      | window_hours  |                     |             | >= | 2 1.1 0.5 -       |             |
distinct videos/sessions                        | rows      | groups        |                     |             | >= | 500 275 125 -     |             |
rows with a known video/session id              | rows      | known         |                     |             | >= | 0.95 0.95 0.95 0.95 |           |
groups with > 13 rows                           | rows      | large_groups  |                     |             | <= | 0 0 0 0           |             |
rows over the 3-per-template cap                | rows      | over_template |                     |             | <= | 0 0 0 0           |             |
{cls} spans >= {want:g}                         | +         | spans         |                     |             | >= | - - - 20          | spans >= 1  |
{cls} distinct >= {want:g}                      | +         | distinct      |                     |             | >= | - - - 10          | spans >= 1  |
top {cls} value <= 10%                          | +         | top_share     |                     |             | <= | - - - 0.1         | spans >= 1  |
{cls} ext share <= 25%                          | *         | ext_share     |                     |             | <= | 0.25 0.25 0.25 -  | spans >= 20 |
{cls} synthetic share <= {want:.0%} or filled to bar | *    | syn_share     |                     |             | <= | limit limit limit limit | syn >= 1 | spans <= bar
"""
# The year spans of languages that have more years than others, as a multiple; synthetic shares; rows of a group; rows of a template.
YEARS_OF = {"de": 4 / 3, "it": 4 / 3, "nl": 4 / 3}
SYNTHETIC, SYNTHETIC_OF_CLASS, SYNTHETIC_OF_LANG = 0.30, {"clock": 0.5, "cur": 0.5, "phone": 0.5, "date": 0.5}, {"en": 0.5, "es": 0.5, "fr": 0.5}
GROUP_CAP, TEMPLATE_CAP = 13, 3
LEFT_OUT = ("year_early", "int_other")

COLUMNS = "lang string, check string, class string, stat string, low long, high long, listed array<long>, least double, how string, want double, given string, given_least double, spare string, spare_most double"


def demands(tiers: dict[str, str], classes: list[str]) -> list[tuple]:
    """The demands on each language of tiers, as rows of COLUMNS. classes: what `*` and `+` stand for."""
    table = [[x.strip() for x in line.split("|")] for line in DEMANDS.strip().splitlines()]
    out = []
    for lang, tier in tiers.items():
        at = TIERS.index(tier)

        def scaled(cls: str, stat: str, want: str, lang: str = lang) -> float:
            return float(round(float(want) * YEARS_OF.get(lang, 1))) if (cls, stat) == ("year", "spans") else float(want)

        bars = {cls: scaled(cls, stat, want) for _, cls, stat, _, _, _, wants, *_ in table if stat == "spans" and (want := wants.split()[at]) != "-"}
        for check, of, stat, values, rows, how, wants, given, *more in table:
            want = wants.split()[at]
            if want == "-":
                continue
            for cls in classes if of == "*" else [c for c in classes if c not in LEFT_OUT] if of == "+" else [of]:
                bar = lambda word, cls=cls: float(bars.get(cls, 0)) if word == "bar" else float(word)
                wanted = max(SYNTHETIC_OF_CLASS.get(cls, SYNTHETIC), SYNTHETIC_OF_LANG.get(lang, 0.0)) if want == "limit" else scaled(cls, stat, want)
                least = rows.split()[at] if rows else None
                low, high = map(int, values.split("-")) if "-" in values else (None, None)
                listed = [int(v) for v in values.split()] if values and "-" not in values else None
                only, spare = given.split(), (more[0] if more else "").split()
                name = check.format(cls=cls, rows=least, want=wanted)
                out.append((lang, name, cls, f"values of {name}" if stat == "values" else stat, low, high, listed, float(least) if least else None, how, wanted, only[0] if only else None, bar(only[2]) if only else None, spare[0] if spare else None, bar(spare[2]) if spare else None))
    return out


def scale(value: Column) -> Column:
    return F.when(value >= 10**9, "billion").when(value >= 10**6, "million").otherwise("thousand")


def long(df: DataFrame, cls: str | Column, **stats: Column) -> DataFrame:
    """(lang, class, stat, got) of df, a row for each of stats."""
    pairs = [F.struct(F.lit(name).alias("stat"), c.cast("double").alias("got")) for name, c in stats.items()]
    return df.select("lang", (F.lit(cls) if isinstance(cls, str) else cls).alias("class"), F.explode(F.array(*pairs)).alias("x")).select("lang", "class", "x.*")


def statistics(train: DataFrame, spans: DataFrame, windows: DataFrame, held: DataFrame, asked: DataFrame) -> DataFrame:
    """(lang, class, stat, got) of gate()'s tables. Rows are summed by value first; of the values only their counts go on, so a class with any
    number of values meets in no task."""
    n = F.col("n")
    said = F.when(F.col("class") == "int_big", F.coalesce("word", scale(F.col("value"))))
    by_value = spans.groupBy("lang", "class", "value", said.alias("scale")).agg(F.count(F.lit(1)).alias("n"), F.sum("hours").alias("hours"), F.sum(F.col("synthetic").cast("int")).alias("syn"), F.sum(F.col("external").cast("int")).alias("ext"))
    scales = by_value.groupBy("lang", "class", "value").agg(*(F.sum(x).alias(x) for x in ("n", "hours", "syn", "ext")), *(F.sum(F.when(F.col("scale") == k, n).otherwise(0)).alias(k) for k in ("thousand", "million", "billion")))
    # Values with as many rows are alike: there are few such counts, however many values there are.
    alike = scales.groupBy("lang", "class", "n").agg(F.count(F.lit(1)).alias("values"), *(F.sum(x).alias(x) for x in ("hours", "syn", "ext", "thousand", "million", "billion")))
    larger = F.coalesce(F.sum("values").over(Window.partitionBy("lang", "class").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    alike = alike.withColumn("of_5", F.least(F.greatest(5 - larger, F.lit(0)), F.col("values")) * n)
    classes = alike.groupBy("lang", "class").agg(
        F.sum(n * F.col("values")).alias("spans"), F.sum("values").alias("distinct"), F.max("n").alias("top"), F.sum("of_5").alias("top_5"), F.sum(F.when(n == 1, F.col("values")).otherwise(0)).alias("single"), *(F.sum(x).alias(x) for x in ("hours", "syn", "ext", "thousand", "million", "billion"))
    )
    share = lambda what, of="spans": F.col(what) / F.greatest(F.col(of), F.lit(1))
    found = long(classes, F.col("class"), spans=F.col("spans"), hours=F.col("hours"), distinct=F.col("distinct"), syn=F.col("syn"), single_share=share("single", "distinct"), top_share=share("top"), top_5_share=share("top_5"), ext_share=share("ext"), syn_share=share("syn"), least_scale=F.least("thousand", "million", "billion"))

    floors = asked.where("stat like 'values of %'").select(F.col("lang").alias("l"), F.col("class").alias("c"), "stat", "low", "high", "listed", "least")
    meets = (F.col("lang") == F.col("l")) & (F.col("class") == F.col("c")) & (n >= F.col("least"))
    among = F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(True)) & (F.col("listed").isNull() | F.array_contains("listed", F.col("value")))
    found = found.unionByName(scales.select("lang", "class", "value", "n").join(F.broadcast(floors), meets & among).groupBy("lang", "class", "stat").agg(F.count(F.lit(1)).cast("double").alias("got")))

    real, lone = train.where("not synthetic"), F.col("unit").startswith("id:")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    groups = real.groupBy("lang", "unit").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), F.sum(F.when(~lone, n).otherwise(0)).alias("known"), one(~lone & (n > GROUP_CAP)).alias("large"))
    over = real.where("template <> ''").groupBy("lang", "template").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.sum(F.greatest(n - TEMPLATE_CAP, F.lit(0))).alias("over"))
    for part in (
        long(groups, "rows", groups=F.col("groups"), known=share("known", "rows"), large_groups=F.col("large")),
        long(over, "rows", over_template=F.col("over")),
        long(real.groupBy("lang").agg(F.sum("hours").alias("h")), "rows", real_hours=F.col("h")),
        long(windows.where("not synthetic").groupBy("lang").agg(F.sum("hours").alias("h")), "rows", window_hours=F.col("h")),
        long(held.groupBy("lang", "class").agg(F.count(F.lit(1)).alias("n")), F.col("class"), held=n),
    ):
        found = found.unionByName(part)
    return found


def gate(train: DataFrame, spans: DataFrame, windows: DataFrame, held: DataFrame, tiers: dict[str, str], classes: list[str]) -> DataFrame:
    """(lang, check, got, want, ok) for each language of tiers and each demand of its tier.

    train (lang, unit, template, hours, synthetic) has the rows with spans; spans (lang, class, value, word, hours, synthetic, external) these
    spans, with a row's hours shared among them, and word, the scale that is said beside a number, or null; windows (lang, hours, synthetic);
    held (lang, class) the spans of the decision set. classes: those that shares of synthetic and external spans are looked at for. What isn't
    there counts as 0: values without a row fail their floor, and a language without rows fails what asks for some.
    """
    asked = train.sparkSession.createDataFrame(demands(tiers, classes), COLUMNS)
    # As many rows as languages times demands, whatever the tables are.
    found = statistics(train, spans, windows, held, asked).join(F.broadcast(asked.select("lang").distinct()), "lang", "left_semi")
    of = lambda stat, got: found.select("lang", "class", F.col("stat").alias(stat), F.col("got").alias(got))
    both = asked.join(of("stat", "found"), ["lang", "class", "stat"], "left").join(of("given", "given_got"), ["lang", "class", "given"], "left").join(of("spare", "spare_got"), ["lang", "class", "spare"], "left")
    got = F.coalesce("found", F.lit(0.0))
    meets = F.when(F.col("how") == ">=", got >= F.col("want")).otherwise(got <= F.col("want"))
    spared = F.coalesce(F.coalesce("spare_got", F.lit(0.0)) <= F.col("spare_most"), F.lit(False))
    asked_for = F.col("given").isNull() | (F.coalesce("given_got", F.lit(0.0)) >= F.col("given_least"))
    return both.where(asked_for).select("lang", "check", got.alias("got"), "want", (meets | spared).alias("ok"))
