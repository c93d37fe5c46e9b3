"""What several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a partition where a table is dealt out by a key, so that a task's sorts and maps are as large whatever the table.
ROWS = 1 << 19


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names. Where it is unset, one machine has a temporary folder; a cluster has none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, with a folder for each value of by: its lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that is a shuffle at every size. Spark sizes a table too low after an explode, or where its file holds repeats, and would
    send all of it through the driver."""
    return df.hint("merge")


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, a written one, for a join: broadcast if it has so many rows at most, else shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else shuffled(df)


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df dealt out by a key, over as many partitions as so many rows need. Joins and groups by the key use these."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    return df.repartition(parts, key)
