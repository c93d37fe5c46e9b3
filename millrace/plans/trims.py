"""Queries over trims of a mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trims
from ..operators.common import dealt
from .registry import query, table
from .texts import MD5

#: Orders as rows and their items as spans, in Spark and in SQL: a class by state and place, external by discount.
CLASS = "concat(l_returnflag, l_linestatus, CASE WHEN l_linenumber = 7 THEN '7' ELSE '' END)"
OUTSIDE = "l_discount >= 0.07"
SPANS = f"SELECT l_orderkey AS id, {CLASS} AS class, count(*) AS n, sum(({OUTSIDE})::INT) AS e FROM lineitem GROUP BY ALL"


def _rounds(where: str, beside: str) -> str:
    """SQL of all rounds one after another. where: what classes are looked at; beside: spans of a class that never leave."""
    out = [f"l0 AS MATERIALIZED (SELECT s.*, o_orderpriority = '1-URGENT' AS last, {MD5.format('id')} AS h FROM s JOIN orders ON id = o_orderkey WHERE {where})"]
    for k in range(trims.ROUNDS):
        out.append(f"c{k} AS MATERIALIZED (SELECT class, coalesce(sum(n), 0) AS own, coalesce(sum(e), 0) AS e, coalesce(sum(n), 0) + coalesce(any_value(x), 0) AS n FROM l{k} FULL JOIN ({beside}) b USING (class) GROUP BY class)")
        out.append(f"x{k} AS MATERIALIZED (SELECT class, 4 * e - n AS excess FROM c{k} WHERE n >= 20 AND 4 * e > n)")
        out.append(f"a{k} AS MATERIALIZED (SELECT id, class, excess, coalesce(sum(4 * e - n) OVER (PARTITION BY class ORDER BY last, h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (PARTITION BY class ORDER BY last, h, id) AS rn FROM l{k} JOIN x{k} USING (class) WHERE e > 0)")
        out.append(f"g{k} AS MATERIALIZED (SELECT DISTINCT id FROM a{k} JOIN (SELECT class, min(rn) FILTER (excess <= b) AS stop FROM a{k} GROUP BY class) USING (class) WHERE stop IS NULL OR rn < stop)")
        out.append(f"l{k + 1} AS MATERIALIZED (SELECT * FROM l{k} WHERE id NOT IN (SELECT id FROM g{k}))")
    return f"s AS MATERIALIZED ({SPANS}), " + ", ".join(out)


NONE = "SELECT NULL::VARCHAR AS class, 0 AS x WHERE false"
BESIDE = "SELECT class, sum(n)::BIGINT AS x FROM s JOIN orders ON id = o_orderkey WHERE o_orderstatus = 'P' GROUP BY class"


def items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    spans = lines.select(F.col("l_orderkey").alias("id"), F.expr(CLASS).alias("class"), F.expr(OUTSIDE).alias("external"))
    rows = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderpriority") == "1-URGENT").alias("last"), "o_orderstatus")
    n = lines.count()
    return dealt(spans, "id", n), dealt(rows, "id", n)


@query(f"WITH {_rounds('true', NONE)} " + " UNION ALL ".join(f"SELECT id, {k} AS round FROM g{k}" for k in range(trims.ROUNDS)))
def capped_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that leave so that no class of items has over a quarter discounted ones, urgent orders last, and the round in which they leave."""
    spans, rows = items(spark, sf_dir)
    return trims.capped_classes(spans, rows)[0]


@query(f"WITH {_rounds('o_orderstatus <> ' + chr(39) + 'P' + chr(39), BESIDE)} SELECT class, n, e, n >= 20 AND 4 * e > n AS still_over FROM (SELECT class, coalesce(sum(e), 0) AS e, coalesce(sum(n), 0) + coalesce(any_value(x), 0) AS n FROM l{trims.ROUNDS} FULL JOIN ({BESIDE}) b USING (class) GROUP BY class)")
def capped_mix_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes after the same, where items of pending orders count beside, but never leave."""
    spans, rows = items(spark, sf_dir)
    stay = rows.where("o_orderstatus = 'P'").select("id")
    beside = spans.join(stay, "id").groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return trims.capped_classes(spans.join(stay, "id", "left_anti"), rows, extra=beside)[1]


def mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items of one order in two hundred as real spans, of all others as synthetic ones, chosen in order of date."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = lines.count()
    spans = lines.select(F.col("l_orderkey").alias("id"), F.expr(CLASS).alias("class"), F.expr(OUTSIDE).alias("external"), F.year("l_shipdate").cast("long").alias("value"), (F.col("l_orderkey") % 200 == 1).alias("real"))
    turns = orders.select(F.col("o_orderkey").alias("id"), F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long").alias("turn"))
    spans = dealt(spans, "id", n).join(dealt(turns, "id", n), "id").select("id", "turn", "class", "external", "value", "real")
    return spans.where("not real"), spans.where("real")


@query()
def trimmed_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic rows that would bring a class of few real spans under a cap, and leave."""
    made, real = mixed(spark, sf_dir)
    counts = real.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("external").cast("int")).alias("e"))
    return trims.trimmed_beside(made.select("id", "turn", "class"), counts)


@query()
def trimmed_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic rows that leave so that no year has over a sixth of all spans."""
    from fractions import Fraction

    made, real = mixed(spark, sf_dir)
    return trims.without_top(made.select("id", "turn", "value"), real.groupBy("value").agg(F.count(F.lit(1)).alias("n")), Fraction(1, 6))[0]
