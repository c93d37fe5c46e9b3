"""Queries that compare arms: thresholds, moves, bounds, gates, choices among candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import paired, vectors
from .registry import query, table

# Items as scored spans: the price is the margin, the flags tell what is right and what is a tie.
SCORED = "SELECT l_linestatus, l_extendedprice / 10000 AS margin, l_discount > 0.09 AS tie, l_returnflag <> 'R' AS correct FROM lineitem"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select("l_linestatus", (F.col("l_extendedprice") / 10000).alias("margin"), (F.col("l_discount") > 0.09).alias("tie"), (F.col("l_returnflag") != "R").alias("correct"))


CURVE = f"""
    WITH s AS ({SCORED}), t AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in paired.THRESHOLDS)}]) AS threshold),
    c AS (SELECT l_linestatus, threshold, count(*) AS n, sum((margin >= threshold AND (threshold <= 0 OR NOT tie))::INT) AS spans, sum((margin >= threshold AND (threshold <= 0 OR NOT tie) AND correct)::INT) AS correct FROM s, t GROUP BY ALL),
    p AS (SELECT *, correct / nullif(spans, 0) AS p FROM c)
    SELECT l_linestatus, threshold, spans, spans / n AS coverage, correct, p AS accuracy,
        coalesce(greatest(0, (p + 3.8416::DOUBLE / (2 * spans)) / (1 + 3.8416::DOUBLE / spans) - 1.96::DOUBLE * sqrt(p * (1 - p) / spans + 3.8416::DOUBLE / (4 * spans * spans)) / (1 + 3.8416::DOUBLE / spans)), 0) AS wilson_low FROM p
    """


@query(CURVE)
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, coverage and its lower bound at nine thresholds."""
    return paired.curve(scored(spark, sf_dir), ["l_linestatus"], "margin", "tie", "correct")


@query(f"SELECT l_linestatus, min(CASE WHEN accuracy >= 0.6 AND wilson_low >= 0.5 AND coverage >= 0.3 THEN threshold END) AS threshold FROM ({CURVE}) GROUP BY l_linestatus")
def picked_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest threshold that meets three bars."""
    return paired.picked(threshold_curve(spark, sf_dir), ["l_linestatus"], 0.6, 0.5, 0.3)


ARMS = "WITH a AS (SELECT o_orderkey, o_custkey % 100 AS cluster, o_orderstatus <> 'F' AS base_ok, o_totalprice > 150000 AS arm_ok FROM orders)"


@query(ARMS + "SELECT cluster, count(*) AS n, sum(base_ok::INT) AS base_ok, sum(arm_ok::INT) AS arm_ok, sum((NOT base_ok AND arm_ok)::INT) AS fixed, sum((base_ok AND NOT arm_ok)::INT) AS broken FROM a GROUP BY cluster")
def paired_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one arm fixes and breaks of the other, by cluster."""
    orders = table(spark, sf_dir, "orders")
    base = orders.select("o_orderkey", (F.col("o_custkey") % 100).alias("cluster"), (F.col("o_orderstatus") != "F").alias("ok"))
    return paired.moves(base, orders.select("o_orderkey", (F.col("o_totalprice") > 150_000).alias("ok")), ["o_orderkey"], ["cluster"])


@query(
    ARMS
    + """, m AS (SELECT cluster, count(*) AS n, sum(base_ok::INT) AS base_ok, sum(arm_ok::INT) AS arm_ok, sum((NOT base_ok AND arm_ok)::INT) AS fixed, sum((base_ok AND NOT arm_ok)::INT) AS broken FROM a GROUP BY cluster),
    p AS (SELECT cluster, sum(exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) - k * ln(2))) AS tail FROM (SELECT cluster, (fixed + broken)::DOUBLE AS k, unnest(range(0, least(fixed, broken)::BIGINT + 1))::DOUBLE AS i FROM m) GROUP BY cluster)
    SELECT m.*, round(least(1, 2 * tail), 6) AS p FROM m JOIN p USING (cluster)"""
)
def paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact tests of the moves of each cluster."""
    return paired_moves(spark, sf_dir).withColumn("p", F.round(stats.sign_p("fixed", "broken"), 6))


@query()
def paired_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of the arms with bounds from resampled clusters."""
    sums = paired_moves(spark, sf_dir).withColumn("diff", F.col("fixed") - F.col("broken"))
    got = stats.bootstrap_ratio(sums, [], "diff", "n", "cluster", reps=400)
    return got.select(*(F.round(c, 9).alias(c) for c in ("ratio", "low", "high")))


@query(
    """
    WITH b AS (SELECT n_nationkey AS k, avg((c_acctbal < 0)::INT) AS rate FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY k), a AS (SELECT s_nationkey AS k, avg((s_acctbal < 0)::INT) AS rate FROM supplier GROUP BY k)
    SELECT k, b.rate AS base, a.rate AS arm, coalesce(100 * (a.rate - b.rate) <= 2, false) AS ok FROM b FULL JOIN a USING (k)
    """
)
def no_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate is no more than two points above the other table's; a nation that either lacks fails."""
    base = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg((F.col("c_acctbal") < 0).cast("int")).alias("rate"))
    arm = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg((F.col("s_acctbal") < 0).cast("int")).alias("rate"))
    return paired.no_damage(base, arm, "k", 2)


@query(
    """
    WITH s AS (SELECT o_orderpriority, l_orderkey, count(*) AS n, sum((l_returnflag = 'R')::INT) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
    SELECT o_orderpriority, sum(n) AS n, sum(w) AS total, coalesce(sum(CASE WHEN w > 0 AND w < n THEN w END), 0) AS seam, coalesce(sum(CASE WHEN w = n THEN w END), 0) AS always FROM s GROUP BY o_orderpriority
    """
)
def seam_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong readings, told by whether their slot is ever right."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    reads = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") != "R").alias("right")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return paired.seam_counts(reads, ["o_orderpriority"], ["l_orderkey"], "right")


CHOICE = """
    WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS loss, l_returnflag = 'N' AS own, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice / 1000, l_linenumber) AS nth FROM lineitem),
    s AS (SELECT l_orderkey, max(CASE WHEN nth = 1 THEN l_linenumber END) AS chosen, coalesce(max(CASE WHEN nth = 2 THEN loss END) - max(CASE WHEN nth = 1 THEN loss END), 99.0) AS margin, min(CASE WHEN own THEN nth END) AS current_rank, count(*) AS candidates FROM r GROUP BY l_orderkey)
    """


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("loss"), "l_returnflag")
    return paired.spans_by_loss(items, ["l_orderkey"], "l_linenumber", "loss", F.col("l_returnflag") == "N")


@query(CHOICE + "SELECT l_orderkey, chosen, round(margin, 6) AS margin, margin < 0.25 AS tie, current_rank, candidates FROM s")
def chosen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate with the least loss, its margin and rank of the current one."""
    return choices(spark, sf_dir).withColumn("margin", F.round("margin", 6))


@query(CHOICE + "SELECT CASE WHEN margin < 2 OR margin < 0.25 THEN 'unconfirmed' WHEN coalesce(current_rank, 0) <> 1 THEN 'relabel' ELSE 'keep' END AS action, count(*) AS n FROM s GROUP BY action")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept, relabelled or left unconfirmed."""
    changed = F.coalesce("current_rank", F.lit(0)) != 1
    action = paired.decision(F.lit("ok"), F.col("margin"), F.col("tie"), changed, F.lit(2.0))
    return choices(spark, sf_dir).groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    WITH u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
    p AS (SELECT a.id, b.id AS other, list_dot_product(a.v, b.v) AS cosine FROM u a JOIN u b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS k FROM p)
    SELECT id, other, round(cosine, 6) AS cosine FROM r WHERE k = 1
    """
)
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest other one."""
    u = vectors.unit(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return vectors.best_matches(u, u).select("id", "other", F.round("cosine", 6).alias("cosine"))


@query(
    """
    WITH u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
    b AS (SELECT a.id, max(list_dot_product(a.v, b.v)) AS cosine FROM u a JOIN u b ON a.id <> b.id GROUP BY a.id)
    SELECT count(*) AS n, sum((cosine >= 0.8)::INT) AS over_80, sum((cosine >= 0.9)::INT) AS over_90, round(max(cosine), 6) AS most FROM b
    """
)
def semantic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors have a near one."""
    u = vectors.unit(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    c = F.col("cosine")
    return vectors.best_matches(u, u).agg(F.count(F.lit(1)).alias("n"), F.sum((c >= 0.8).cast("int")).alias("over_80"), F.sum((c >= 0.9).cast("int")).alias("over_90"), F.round(F.max(c), 6).alias("most"))
