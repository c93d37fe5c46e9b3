"""Planned rows: carriers with readings, pairs that differ in one reading, files of about a length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable
from .select import running_before


def filled(carriers: DataFrame, text: str, low: int, high: int, each: int) -> DataFrame:
    """Rows of each carrier, a text with a `{}`: with each of a hash order of the numbers from low to high. Deterministic."""
    rows = carriers.withColumn("n", F.explode(F.sequence(F.lit(low), F.lit(high))))
    nth = F.row_number().over(Window.partitionBy(text).orderBy(stable(F.concat_ws("|", F.col(text), F.col("n").cast("string"))), "n"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= each).drop("nth")


def pairs(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, a, b): each value of a group with the next larger one. Rows that differ in it alone."""
    return rows.select(group, F.col(value).alias("a"), F.lead(value).over(Window.partitionBy(group).orderBy(value)).alias("b")).where("b is not null")


def binned(df: DataFrame, length: Column, key: str, by: list[str], target: int) -> DataFrame:
    """df with bin: rows of each group in hash order, in bins of about a length."""
    return running_before(df, length, key, by).withColumn("bin", F.floor(F.col("__before") / target)).drop("__before", "__h", "__size")
