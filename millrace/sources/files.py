"""Files of rows, of texts and of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_rows(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines with the file they come from. Blank lines are none; columns that a line lacks are null."""
    return spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("file"))


def json_any(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a file of JSON lines, or of one JSON array, as its first character tells."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    array = bool(first) and first[0].value.lstrip().startswith("[")
    return spark.read.schema(schema).option("multiLine", array).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def first_of(spark: SparkSession, paths: list[str], schema: T.StructType | str) -> DataFrame:
    """JSON rows of the first path that exists; none if no path does. A path that exists but can't be read is an error."""
    for path in paths:
        if exists(spark, path):
            return spark.read.schema(schema).json(path)
    return spark.createDataFrame([], schema)


def texts(df: DataFrame, fields: tuple[str, ...] = ("said", "text")) -> DataFrame:
    """df with said: the first of some fields that is there and not empty."""
    have = [F.when(F.col(f) != "", F.col(f)) for f in fields if f in df.columns]
    return df.withColumn("said", F.coalesce(*have, F.lit("")))


def held_unit(id_: str) -> Column:
    """The unit of a row's id: the day of a session, or the video; null for other ids."""
    day = F.regexp_extract(id_, r"^([0-9]{8})-[0-9]{4}-[A-Z]", 1)
    video = F.regexp_extract(id_, r"^[a-z]{2}[0-9]+_[0-9]+_(.{11})_", 1)
    return F.when(day != "", F.concat(F.lit("day:"), day)).when(video != "", F.concat(F.lit("vid:"), video))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a list with one id a line; blank lines and comments after # are none."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> '' and not startswith(id, '#')").distinct()


def held_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id) and (unit) of a held-out list: its ids, and their units with those of its group lines."""
    line = spark.read.text(path).select(F.trim("value").alias("line"))
    ids = id_list(spark, path)
    kind, name = F.regexp_extract("line", r"^#\s*group\s+(vox|yodas):(\S+)", 1), F.regexp_extract("line", r"^#\s*group\s+(vox|yodas):(\S+)", 2)
    groups = line.where(kind != "").select(F.concat(F.when(kind == "vox", "day:").otherwise("vid:"), name).alias("unit"))
    return ids, ids.select(held_unit("id").alias("unit")).where("unit is not null").unionByName(groups).distinct()


def write_parts(df: DataFrame, path: str, part: str) -> None:
    """JSON lines, a folder for each part. Rows of a part are dealt over tasks, so that a part with most rows is many files."""
    df.write.partitionBy(part).json(path)


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, hash): tells two tables apart, whatever their order."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    parts = df.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("long").alias("a"), F.conv(F.substring(row, 16, 15), 16, 10).cast("long").alias("b"))
    return parts.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(":", F.sum(F.col("a").cast("decimal(38,0)")).cast("string"), F.sum(F.col("b").cast("decimal(38,0)")).cast("string"), F.bit_xor("a").cast("string")), 256).alias("hash"))
