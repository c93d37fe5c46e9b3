"""Places and running sums in an order of a whole table, or of groups of any size, without a task that has them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Places of an order that one part of a running sum has.
PART = 4096


def placed(rows: DataFrame, keys: list[Column], name: str = "turn") -> DataFrame:
    """rows, written, with their place from 0 in the order of keys. Equal rows have places of their own.

    Rows go into ranges of the order and are numbered within; what a range begins at comes from the ranges' counts, which are as many as
    partitions.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tied = written(rows.withColumn("__tie", F.monotonically_increasing_id()))
    order = [*keys, F.col("__tie")]
    own = written(tied.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__pos", F.monotonically_increasing_id()))
    counts = own.groupBy("__part").agg(F.min("__pos").alias("__from"), F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select("__part", (before - F.col("__from")).alias("__shift")))
    return own.join(starts, "__part").withColumn(name, F.col("__pos") + F.col("__shift")).drop("__part", "__pos", "__shift", "__tie")


def before(rows: DataFrame, by: list[str], size: Column, name: str = "before", turn: str = "turn") -> DataFrame:
    """rows with the sum of size over all rows of the same group whose turn is smaller. Sums of parts of the order are added up first."""
    own = rows.withColumn("__size", size).withColumn("__part", F.floor(F.col(turn) / PART))
    ahead = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy(*by, "__part").agg(F.sum("__size").alias("__sum"))
    skip = sums.select(*(F.col(b).alias(f"__{b}") for b in by), F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__skip"))
    inside = F.coalesce(F.sum("__size").over(Window.partitionBy(*by, "__part").orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("__part") == F.col("__p")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"__{b}"))
    return own.withColumn("__in", inside).join(skip, same).select(*rows.columns, (F.col("__skip") + F.col("__in")).alias(name))


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each name of shares): exact percentiles of a group's values, between two of them by their distance; null without any.

    Values are counted, and counts added up in their order, so that no task has a group whole. Groups may be of any size, but are broadcast with theirs.
    """
    counts = written(rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("c")))
    known = counts.where(F.col(value).isNotNull())
    line = before(placed(known, [F.col(value)]), [by], F.col("c"))
    sizes = counts.groupBy(by).agg(F.sum(F.when(F.col(value).isNotNull(), F.col("c"))).alias("all")).select(F.col(by).alias("__by"), "all")
    sizes = written(sizes)
    met = line.join(F.broadcast(sizes), F.col(by).eqNullSafe(F.col("__by")))
    out = []
    for name, share in shares.items():
        place = (F.col("all") - 1) * F.lit(share)
        at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("c")), F.col(value)))
        low, high = at(F.floor(place)), at(F.ceil(place))
        # One value, or what lies between two.
        first, rest = F.ceil(F.max(place)) - F.max(place), F.max(place) - F.floor(F.max(place))
        out.append(F.when(low == high, low).otherwise(first * low + rest * high).alias(name))
    told = met.groupBy("__by").agg(*out).withColumnRenamed("__by", "__of")
    return sizes.join(told, F.col("__by").eqNullSafe(F.col("__of")), "left").select(F.col("__by").alias(by), *shares)
