"""Queries that count: shares, floors, distances, quantiles, grouping sets, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import noise
from ..operators import census
from .registry import query, table
from .texts import SPANS, spans


@query(
    f"""
    WITH c AS (SELECT lang, class, v, count(*) AS n FROM ({SPANS}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang, class ORDER BY n DESC, v) AS k FROM c)
    SELECT lang, class, sum(n) AS rows, count(*) AS distinct, sum((n = 1)::INT) / count(*) AS singletons, sum(CASE WHEN k <= 1 THEN n ELSE 0 END) / sum(n) AS top_1, sum(CASE WHEN k <= 5 THEN n ELSE 0 END) / sum(n) AS top_5 FROM r GROUP BY ALL
    """
)
def value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How concentrated the values of each class of numbers are."""
    return census.top_shares(spans(spark, sf_dir), ["lang", "class"], "v")


@query(
    f"""
    WITH c AS (SELECT v::INT AS year, count(*) AS n FROM ({SPANS}) WHERE class = 'year' GROUP BY v)
    SELECT y::INT AS year, coalesce(n, 0) AS n, coalesce(n, 0) >= 1 AS ok FROM unnest(range(1990, 2031)) t(y) LEFT JOIN c ON c.year = y
    """
)
def year_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year from 1990 to 2030 occurs in a text; one that doesn't fails."""
    counts = spans(spark, sf_dir).where("class = 'year'").groupBy(F.col("v").cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return census.floors(counts, "year", 1990, 2030, 1)


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity * l_tax) / sum(l_quantity) AS weighted, count(*) AS n, grouping(l_returnflag)::INT + grouping(l_linestatus)::INT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def weighted_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share weighted by quantity, for flags, states, both and all."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_tax")
    got = items.cube("l_returnflag", "l_linestatus").agg((F.sum(F.col("l_quantity") * F.col("l_tax")) / F.sum("l_quantity")).alias("weighted"), F.count(F.lit(1)).alias("n"), (F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("int").alias("level"))
    return got


@query("SELECT lang, source, count(*) AS docs, sum(n_chars) AS chars, grouping(lang)::INT AS g FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def exposure_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass for several groupings."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("millrace_documents")
    return spark.sql("SELECT lang, source, count(*) AS docs, sum(n_chars) AS chars, cast(grouping(lang) AS int) AS g FROM millrace_documents GROUP BY GROUPING SETS ((lang), (source), ())")


@query(
    """
    WITH h AS (SELECT c_mktsegment AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY k), t AS (SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY k),
    b AS (SELECT coalesce(h.n, 0) / (SELECT sum(n) FROM h) AS x, coalesce(t.n, 0) / (SELECT sum(n) FROM t) AS y FROM h FULL JOIN t USING (k))
    SELECT round(sum(abs(x - y)) / 2, 12) AS distance FROM b
    """
)
def convention_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the segments of some customers are from those of all."""
    all_ = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    have = table(spark, sf_dir, "customer").where("c_acctbal < 0").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return census.distance(have, all_, "c_mktsegment").select(F.round("distance", 12).alias("distance"))


@query(
    """
    WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, any_value(n) AS n, min(CASE WHEN i = least(floor(0.1::DOUBLE * n), n - 1) THEN n_chars END) AS p10, min(CASE WHEN i = least(floor(0.5::DOUBLE * n), n - 1) THEN n_chars END) AS p50, min(CASE WHEN i = least(floor(0.9::DOUBLE * n), n - 1) THEN n_chars END) AS p90 FROM r GROUP BY lang
    """
)
def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths by language at int(q * n) of the sorted ones."""
    return census.order_statistic(table(spark, sf_dir, "documents"), ["lang"], "n_chars", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query(
    """
    WITH t AS (SELECT count(*) AS total FROM documents) SELECT source AS value, count(*) AS n, count(*) / any_value(total) AS share,
        count(*) / any_value(total) <= 0.055 + CASE WHEN any_value(total) >= 1000 THEN 0 ELSE 2 * sqrt(0.0475 / any_value(total)) END AS ok FROM documents, t GROUP BY source
    """
)
def source_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No source has more than 5.5 % of the documents, with a margin for few."""
    docs = table(spark, sf_dir, "documents")
    n = F.col("total")
    return census.share_bands(docs, "source", 0.055, noise(n))


@query(
    """
    WITH c AS (SELECT lang, source, count(*) AS n, sum(n_chars) AS chars, sum((n_chars < 200)::INT) AS short FROM documents GROUP BY ALL)
    SELECT lang, count(*) AS sources, max(n) AS most, sum((n >= 5)::INT) AS large, sum(CASE WHEN n >= 5 AND short > 0.2 * n THEN 1 ELSE 0 END) AS over FROM c GROUP BY lang
    """
)
def external_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with too many short documents; those with under five documents are exempt."""
    c = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("n_chars") < 200).cast("int")).alias("short"))
    return c.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("most"), F.sum((F.col("n") >= 5).cast("int")).alias("large"), F.sum(((F.col("n") >= 5) & (F.col("short") > 0.2 * F.col("n"))).cast("int")).alias("over"))


@query("SELECT lang, scenario, count(*) AS docs, round(sum(n_chars) / 1000 * any_value(price), 6) AS cost FROM documents, (VALUES ('all', 0, 0.5), ('long', 1000, 0.5), ('longest', 5000, 0.8)) s(scenario, least, price) WHERE n_chars >= least GROUP BY ALL")
def cost_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three scenarios cost; each row is dealt to the scenarios that take it."""
    scenarios = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(least).alias("least"), F.lit(price).alias("price")) for n, least, price in (("all", 0, 0.5), ("long", 1000, 0.5), ("longest", 5000, 0.8))])
    each = table(spark, sf_dir, "documents").select("lang", "n_chars", F.explode(scenarios).alias("s")).where(F.col("n_chars") >= F.col("s.least"))
    return each.groupBy("lang", F.col("s.scenario").alias("scenario")).agg(F.count(F.lit(1)).alias("docs"), F.round(F.sum("n_chars") / 1000 * F.max("s.price"), 6).alias("cost"))


@query("SELECT event_type, CASE WHEN value < 1 THEN '0-1' WHEN value < 5 THEN '1-5' WHEN value < 20 THEN '5-20' ELSE '20+' END AS bin, count(*) AS n FROM events GROUP BY ALL")
def uneven_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram with uneven bins."""
    v = F.col("value")
    bin_ = F.when(v < 1, "0-1").when(v < 5, "1-5").when(v < 20, "5-20").otherwise("20+")
    return table(spark, sf_dir, "events").groupBy("event_type", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by region and nation, with sums of regions and of all. Nations and regions are fixed small tables and go to every task."""
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    return orders.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
