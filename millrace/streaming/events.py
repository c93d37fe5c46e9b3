"""Streams over files of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import scratch


def read(spark: SparkSession, sf_dir: str, name: str = "events", files: int = 8) -> DataFrame:
    """A stream of a table's files, whether the table is a folder or one file; so many files a batch at most."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    first = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("f")).limit(1).collect()
    if first and first[0].f == f"{name}.parquet":
        return reader.option("pathGlobFilter", first[0].f).parquet(sf_dir)
    return reader.parquet(path)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream writes until it has read all files that are there. Its state and output are in the shared folder, so it can go on later."""
    spark = stream.sparkSession
    out, state = scratch(spark), scratch(spark)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def store(batch: DataFrame, number: int) -> None:
        # A batch that is done again writes the same folder.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    return last.where(F.col("batch") == last.agg(F.max("batch")).first()[0]).drop("batch")


def by_window(spark: SparkSession, sf_dir: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, cents) of tumbling windows. Events that come later than the watermark are not counted.

    The complete mode gives windows that the watermark hasn't closed yet too.
    """
    hours = read(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    counted = hours.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return drained(counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents"), "complete")


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, draws, last): running totals."""
    return drained(read(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("draws"), F.max("event_id").alias("last")), "complete")


def seen(lines: DataFrame) -> DataFrame:
    """(step, h, d): a log of drawn rows, {"step", "h": [], "d": []} a line, one row a draw; lines that start an attempt have none."""
    schema = "start int, manifest string, step int, h array<string>, d array<int>"
    log = lines.select(F.from_json("value", schema).alias("x")).where("x.step is not null")
    return log.select("x.step", F.explode(F.arrays_zip("x.h", "x.d")).alias("r")).select("step", F.col("r.h").alias("h"), F.col("r.d").alias("d"))

