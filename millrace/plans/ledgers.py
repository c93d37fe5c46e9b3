"""Queries over append-only tables: latest entries, exports, queues, attempts, exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from .registry import query, table

# Events as decisions: users are rows, event types are actions.
DECISIONS = "SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'drop' WHEN 'click' THEN 'relabel' ELSE 'keep' END AS action, 'new ' || event_id AS new_label FROM events"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "error", "drop").when(kind == "click", "relabel").otherwise("keep")
    return table(spark, sf_dir, "events").select("user_id", "event_id", action.alias("action"), F.concat(F.lit("new "), F.col("event_id").cast("string")).alias("new_label"))


@query(f"SELECT user_id, event_id, action FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM ({DECISIONS})) WHERE n = 1")
def latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last decision on each row."""
    return ledger.latest(decisions(spark, sf_dir), ["user_id"], ["event_id"]).select("user_id", "event_id", "action")


@query(
    f"""
    WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM ({DECISIONS})) WHERE n = 1)
    SELECT c_custkey, CASE WHEN action = 'relabel' THEN new_label ELSE c_name END AS c_name FROM customer LEFT JOIN l ON user_id = c_custkey WHERE action IS NULL OR action <> 'drop'
    """
)
def exported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their latest decision taken."""
    last = ledger.latest(decisions(spark, sf_dir), ["user_id"], ["event_id"]).withColumnRenamed("user_id", "c_custkey")
    return ledger.exported(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), last, "c_custkey", "c_name")


@query(
    """
    WITH v AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'WRONG' WHEN 'click' THEN 'CORRECT' WHEN 'view' THEN 'UNSURE' ELSE 'UNDO' END AS verdict, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events),
    s AS (SELECT c_mktsegment, verdict FROM customer LEFT JOIN (SELECT * FROM v WHERE n = 1) ON user_id = c_custkey)
    SELECT c_mktsegment AS queue, count(*) AS items, sum((verdict IS NULL OR verdict = 'UNDO')::INT) AS pending, sum(coalesce(verdict = 'CORRECT', false)::INT) AS correct, sum(coalesce(verdict = 'WRONG', false)::INT) AS wrong, sum(coalesce(verdict = 'UNSURE', false)::INT) AS unsure FROM s GROUP BY queue
    """
)
def queue_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answers of each queue."""
    items = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("queue"), F.col("c_custkey").alias("item"))
    kind = F.col("event_type")
    verdict = F.when(kind == "error", "WRONG").when(kind == "click", "CORRECT").when(kind == "view", "UNSURE").otherwise("UNDO")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), "event_id", verdict.alias("verdict"))
    last = ledger.latest(events, ["item"], ["event_id"])
    return ledger.queue_progress(items, items.select("queue", "item").join(last, "item").select("queue", "item", "verdict"), "queue", "item")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first, max(ts) AS last FROM events GROUP BY event_type")
def ledger_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of the ledger."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first"), F.max("ts").alias("last"))


# Attempts are blocks of 1,000 events; each starts again 40 steps before the end of the one before it.
STEPS = "SELECT event_id // 1000 AS attempt, event_id // 1000 * 60 + event_id % 1000 // 10 AS step, event_id, user_id FROM events"


@query(f"WITH s AS ({STEPS}), a AS (SELECT attempt, min(step) AS start FROM s GROUP BY attempt) SELECT attempt, count(*) AS rows, min(step) AS first, max(step) AS last FROM s WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.attempt > s.attempt AND s.step >= a.start) GROUP BY attempt")
def effective_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps without those that a later attempt did again."""
    e = F.col("event_id")
    steps = table(spark, sf_dir, "events").select(F.floor(e / 1000).alias("attempt"), (F.floor(e / 1000) * 60 + F.floor(e % 1000 / 10)).alias("step"), "event_id", "user_id")
    attempts = steps.groupBy("attempt").agg(F.min("step").alias("start"))
    return ledger.effective_steps(steps, attempts).groupBy("attempt").agg(F.count(F.lit(1)).alias("rows"), F.min("step").alias("first"), F.max("step").alias("last"))


@query(
    """
    WITH d AS (SELECT event_id AS draw, user_id % 500 AS h, round(value)::INT AS d2 FROM events), i AS (SELECT p_partkey AS i, p_partkey % 700 AS h, p_size AS d, p_brand AS part FROM part),
    f AS (SELECT draw, i, abs(d - d2) <= 2 AS near, max(abs(d - d2) <= 2) OVER (PARTITION BY draw) AS near_one FROM d JOIN i USING (h)),
    t AS (SELECT i, 1 / count(*) OVER (PARTITION BY draw) AS share FROM f WHERE near OR NOT near_one), n AS (SELECT i, sum(share) AS draws FROM t GROUP BY i),
    g AS (SELECT part, h, d, count(*) AS listed, sum(coalesce(draws, 0)) AS draws FROM i LEFT JOIN n USING (i) GROUP BY ALL)
    SELECT part, sum(listed) AS listed, round(sum(draws), 6) AS draws, round(sum(least(draws, 1)), 6) AS distinct FROM g GROUP BY part
    """
)
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often listed rows were drawn; an ambiguous draw is shared."""
    draws = table(spark, sf_dir, "events").select(F.col("event_id").alias("draw"), (F.col("user_id") % 500).alias("h"), F.round("value").cast("int").alias("d"))
    index = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), (F.col("p_partkey") % 700).alias("h"), F.col("p_size").alias("d"), F.col("p_brand").alias("part"))
    return ledger.exposure(draws, index, 2).select("part", "listed", F.round("draws", 6).alias("draws"), F.round("distinct", 6).alias("distinct"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def resumed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not done yet."""
    done = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ledger.resumed(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


# Events as decisions, a quarter of them on a span.
STATE = """SELECT c_custkey AS row_id, c_name AS label, coalesce(action, 'keep') AS action, reason, decided_by, new_label, CASE WHEN action = 'relabel' AND new_label IS NOT NULL THEN new_label ELSE c_name END AS final_label
    FROM customer LEFT JOIN (SELECT * FROM (SELECT user_id, CASE event_type WHEN 'error' THEN 'drop' WHEN 'click' THEN 'relabel' WHEN 'view' THEN 'unconfirmed' ELSE 'keep' END AS action, 'event ' || event_type AS reason, ['rule', 'referee', 'human'][event_id % 3 + 1] AS decided_by,
    CASE WHEN event_type = 'click' THEN 'new ' || event_id END AS new_label, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id % 4 <> 0) WHERE n = 1) ON user_id = c_custkey"""


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, e = F.col("event_type"), F.col("event_id")
    action = F.when(kind == "error", "drop").when(kind == "click", "relabel").when(kind == "view", "unconfirmed").otherwise("keep")
    by = F.get(F.array(*[F.lit(x) for x in ledger.DECIDERS]), (e % 3).cast("int"))
    made = table(spark, sf_dir, "events").select(e.alias("id"), F.col("user_id").alias("row_id"), F.when(e % 4 == 0, e % 3).alias("span_ord"), action.alias("action"), F.concat(F.lit("event "), kind).alias("reason"), by.alias("decided_by"), F.when(kind == "click", F.concat(F.lit("new "), e.cast("string"))).alias("new_label"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("label"))
    return ledger.row_state(rows, ledger.checked(made)).select("row_id", "label", "action", "reason", "decided_by", "new_label", "final_label")


@query(STATE)
def row_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with what was last decided on them as a whole."""
    return state(spark, sf_dir)


@query(f"SELECT row_id, label, reason, decided_by FROM ({STATE}) WHERE action = 'unconfirmed'")
def review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that wait for a look."""
    return ledger.review_page(state(spark, sf_dir)).select("row_id", "label", "reason", "decided_by")


@query("SELECT DISTINCT l_orderkey AS row_id, l_returnflag AS label, l_linestatus AS origin FROM lineitem WHERE l_linenumber > 2 EXCEPT SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber <= 2")
def added_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that a second pass adds to those of the first."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("origin"), "l_linenumber")
    return ledger.new_candidates(items.where("l_linenumber <= 2"), items.where("l_linenumber > 2"))


@query(
    """
    WITH a AS (SELECT event_id AS id, user_id AS item, CASE event_type WHEN 'error' THEN 'WRONG' WHEN 'click' THEN 'WRONG' WHEN 'view' THEN 'CORRECT' WHEN 'purchase' THEN 'UNSURE' ELSE 'UNDO' END AS verdict, CASE WHEN event_type = 'error' THEN ' the name , said' END AS heard FROM events),
    i AS (SELECT c_mktsegment AS queue, c_custkey AS item, c_name AS label, CASE c_mktsegment WHEN 'BUILDING' THEN 'span' WHEN 'MACHINERY' THEN 'gold_only' ELSE 'label' END AS scope, c_mktsegment = 'FURNITURE' AS bed, c_custkey % 9 = 0 AS changed FROM customer),
    j AS (SELECT *, verdict = 'WRONG' AND heard IS NOT NULL AND NOT changed AS relabel FROM a JOIN i USING (item) WHERE verdict <> 'UNDO' AND NOT bed AND scope <> 'gold_only')
    SELECT id, item AS row_id, CASE WHEN verdict = 'CORRECT' THEN 'keep' WHEN relabel THEN 'relabel' ELSE 'unconfirmed' END AS action, 'human listened (' || queue || '): ' || CASE WHEN verdict = 'CORRECT' THEN 'label is correct' WHEN verdict = 'UNSURE' THEN 'unsure'
        WHEN heard IS NULL THEN 'label is wrong, heard reading not typed' WHEN changed THEN 'label wrong (heard: the name said) but the row label changed since the queue was built' ELSE 'heard ' || chr(39) || 'the name said' || chr(39) END AS reason,
        CASE WHEN relabel AND scope = 'span' THEN left(label, 3) || 'the name said' || substr(label, 8) WHEN relabel THEN 'the name said' END AS new_label FROM j
    """
)
def recorded_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by the answers of listeners."""
    kind = F.col("event_type")
    verdict = F.when(kind.isin("error", "click"), "WRONG").when(kind == "view", "CORRECT").when(kind == "purchase", "UNSURE").otherwise("UNDO")
    people = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("queue"), F.col("c_custkey").alias("item"), F.col("c_name").alias("label"))
    scope = F.when(F.col("queue") == "BUILDING", "span").when(F.col("queue") == "MACHINERY", "gold_only").otherwise("label")
    items = people.select("queue", "item", F.col("item").alias("row_id"), "label", F.struct(F.lit(3).alias("a"), F.lit(7).alias("b")).alias("span"), scope.alias("scope"), (F.col("queue") == "FURNITURE").alias("test_bed"))
    answers = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("item"), verdict.alias("verdict"), F.when(kind == "error", " the name , said").alias("heard")).join(people.select("queue", "item"), "item")
    rows = people.select(F.col("item").alias("row_id"), F.when(F.col("item") % 9 == 0, "changed").otherwise(F.col("label")).alias("label"))
    return ledger.recorded(answers, items, rows)
