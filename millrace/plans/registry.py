"""Queries over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def grams(tokens: str, n: int):
    """Hashes of the distinct n-grams of an array column of tokens."""
    at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    hashed = F.transform(at, lambda i: F.xxhash64(F.slice(F.col(tokens), i, n)))
    return F.when(F.size(tokens) >= n, F.array_distinct(hashed)).otherwise(F.array().cast("array<bigint>"))


@query(
    """
    WITH d AS (SELECT doc_id, source, regexp_split_to_array(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
    b AS (SELECT regexp_split_to_array(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM benchmark),
    dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
    bg AS (SELECT DISTINCT array_to_string(w[i:i+7], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 6)) AS i FROM b)),
    hit AS (SELECT DISTINCT doc_id FROM dg WHERE g IN (SELECT g FROM bg))
    SELECT source, count(*) AS docs, count(hit.doc_id) AS hit_docs, CASE WHEN count(hit.doc_id) > 0 THEN 0 ELSE count(*) END AS survivors
    FROM d LEFT JOIN hit USING (doc_id) GROUP BY source
    """
)
def contamination_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document that shares a word 8-gram with the benchmark costs its whole source."""
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words.alias("w"))
    bench = table(spark, sf_dir, "benchmark").select(words.alias("w")).select(F.explode(grams("w", 8)).alias("g")).distinct()
    hit = docs.select("doc_id", F.explode(grams("w", 8)).alias("g")).join(bench, "g", "left_semi").select("doc_id").distinct()
    flagged = docs.select("doc_id", "source").join(hit.withColumn("hit", F.lit(1)), "doc_id", "left")
    return flagged.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count("hit").alias("hit_docs")).withColumn("survivors", F.when(F.col("hit_docs") > 0, 0).otherwise(F.col("docs")))
