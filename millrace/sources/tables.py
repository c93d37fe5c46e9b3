"""Tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions than half of these, as one small file does; large tables come as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents over all cores, since work on texts is heavy for the bytes that are read."""
    df = stored(spark, sf_dir, name)
    return spread(df) if name == "documents" else df
