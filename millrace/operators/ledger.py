"""Append-only tables, and views of what counts in them: the latest decision, the last attempt, the draws that were made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a decision may be, and who may decide.
ACTIONS = ("keep", "relabel", "re-cut", "drop", "unconfirmed")
DECIDERS = ("rule", "referee", "human")


def latest(entries: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last entry of each key."""
    last = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return entries.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def latest_decision(decisions: DataFrame) -> DataFrame:
    """The last decision (id) on each whole row; decisions on a span (span_ord) of it neither count nor hide one."""
    return latest(decisions.where("span_ord is null"), ["row_id"], ["id"])


def row_state(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows (row_id, label, ...) with action, reason, decided_by, new_label and final_label; a row without a decision is kept as it is."""
    last = latest_decision(decisions).select(F.col("row_id"), "action", "reason", "decided_by", "new_label")
    final = F.when(F.col("action") == "relabel", F.coalesce("new_label", "label")).otherwise(F.col("label"))
    return rows.join(last, "row_id", "left").withColumn("action", F.coalesce("action", F.lit("keep"))).withColumn("final_label", final)


def review_page(state: DataFrame) -> DataFrame:
    """Rows that wait for someone to look at them."""
    return state.where("action = 'unconfirmed'")


def new_candidates(have: DataFrame, more: DataFrame) -> DataFrame:
    """Of more the candidates (row_id, label, origin) that aren't there yet, each once: adding the same again adds nothing."""
    key = ["row_id", "label", "origin"]
    return more.select(*key).distinct().join(have.select(*key), key, "left_anti")


def checked(decisions: DataFrame) -> DataFrame:
    """decisions as they are; one with another action or decider, or a relabelling without a label, fails the job that writes it."""
    right = F.col("action").isin(*ACTIONS) & F.col("decided_by").isin(*DECIDERS) & ((F.col("action") != "relabel") | (F.coalesce("new_label", F.lit("")) != ""))
    wrong = F.raise_error(F.concat(F.lit("not a decision: "), F.to_json(F.struct("row_id", "action", "decided_by", "new_label")))).cast("string")
    return decisions.withColumn("action", F.when(F.coalesce(right, F.lit(False)), F.col("action")).otherwise(wrong))


def append(rows: DataFrame, path: str) -> None:
    """rows added to an append-only table: new files beside the old ones. Nothing here changes or deletes a row."""
    rows.write.mode("append").parquet(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, sha256) of the files of a table, to be kept beside it after each append."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return parts.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def tampered(before: DataFrame, now: DataFrame) -> DataFrame:
    """(file) of those that were there before and are changed or gone: an append-only table has none."""
    return before.join(now, ["file", "length", "sha256"], "left_anti").select("file")


def recorded(answers: DataFrame, items: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, row_id, action, reason, new_label): decisions by a listener's answers (id, queue, item, verdict, heard) to items (queue, item,
    row_id, label, span, scope, test_bed) of rows (row_id, label).

    An answer UNDO, a test bed, a scope `gold_only` and an item without a row give none. A wrong label with a typed reading is replaced, its
    span alone where the scope is `span`, unless the row's label has changed since; a reading with digits fails the job.
    """
    asked = answers.join(items, ["queue", "item"]).where("verdict <> 'UNDO' and row_id is not null and not test_bed and scope <> 'gold_only'")
    now = rows.select("row_id", F.col("label").alias("now"))
    heard = F.trim(F.coalesce("heard", F.lit("")))
    typed = F.when(heard.rlike("[0-9]"), F.raise_error(F.lit("spoken-form labels have no digits")).cast("string")).otherwise(F.regexp_replace(heard, r"\s*,\s*", " "))
    a = asked.join(now, "row_id", "left").withColumn("typed", typed)
    same, said = F.coalesce(F.col("now") == F.col("label"), F.lit(False)), F.col("typed") != ""
    whole = F.when((F.col("scope") == "span") & F.col("span").isNotNull(), F.concat(F.expr("substring(label, 1, span.a)"), "typed", F.expr("substring(label, span.b + 1, length(label))"))).otherwise(F.col("typed"))
    heard_by = F.concat(F.lit("human listened ("), "queue", F.lit("): "))
    reason = F.when(F.col("verdict") == "CORRECT", "label is correct").when(F.col("verdict") == "UNSURE", "unsure").when(~said, "label is wrong, heard reading not typed")
    reason = reason.when(~same, F.concat(F.lit("label wrong (heard: "), "typed", F.lit(") but the row label changed since the queue was built"))).otherwise(F.concat(F.lit("heard '"), "typed", F.lit("'")))
    relabel = (F.col("verdict") == "WRONG") & said & same
    action = F.when(F.col("verdict") == "CORRECT", "keep").when(relabel, "relabel").otherwise("unconfirmed")
    return a.select("id", "row_id", action.alias("action"), F.concat(heard_by, reason).alias("reason"), F.when(relabel, whole).alias("new_label"))


def exported(rows: DataFrame, decisions: DataFrame, id_: str, text: str) -> DataFrame:
    """rows with the latest decision (id, action, new_label) taken: dropped, relabelled, or as they are."""
    d = decisions.select(F.col(id_).alias("__id"), "action", "new_label")
    joined = rows.join(d, F.col(id_) == F.col("__id"), "left").where("action is null or action <> 'drop'")
    return joined.withColumn(text, F.when(F.col("action") == "relabel", F.coalesce("new_label", text)).otherwise(F.col(text))).drop("__id", "action", "new_label")


def queue_progress(items: DataFrame, verdicts: DataFrame, queue: str, item: str) -> DataFrame:
    """(queue, items, pending, verdicts by name): the last answer of each item; `UNDO` makes it pending again."""
    state = items.join(verdicts, [queue, item], "left")
    pending = F.col("verdict").isNull() | (F.col("verdict") == "UNDO")
    count = lambda c: F.sum(c.cast("int"))
    names = ("CORRECT", "WRONG", "UNSURE")
    return state.groupBy(queue).agg(F.count(F.lit(1)).alias("items"), count(pending).alias("pending"), *(F.coalesce(count(F.col("verdict") == v), F.lit(0)).alias(v.lower()) for v in names))


def effective_steps(steps: DataFrame, attempts: DataFrame) -> DataFrame:
    """steps (attempt, step, ...) without those that a later attempt (attempt, start) did again from its start on."""
    later = attempts.select(F.col("attempt").alias("__attempt"), F.min("start").over(Window.orderBy(F.desc("attempt")).rowsBetween(Window.unboundedPreceding, -1)).alias("__least"))
    # For each attempt the least start of all after it; whether these go to all tasks is left to their size.
    joined = steps.join(later, F.col("attempt") == F.col("__attempt"), "left")
    return joined.where("__least is null or step < __least").drop("__attempt", "__least")


def exposure(draws: DataFrame, index: DataFrame, tolerance: int) -> DataFrame:
    """(part, listed, draws, distinct): how often the rows of an index (i, h, d, part) were drawn by (draw, h, d).

    A draw whose h several rows have goes to those with a d within the tolerance, if any, in equal shares. Equal (part, h, d) are one row
    for distinct, which counts one at most.
    Draws with one (h, d) fare alike, and so do rows with one: both are counted first, so a hot h joins its distinct d alone.
    """
    asked = draws.groupBy("h", F.col("d").alias("d2")).agg(F.count(F.lit(1)).alias("asked"))
    held = index.groupBy("h", "d").agg(F.count(F.lit(1)).alias("held"))
    by = Window.partitionBy("h", "d2")
    found = asked.join(held, "h").withColumn("near", F.abs(F.col("d") - F.col("d2")) <= tolerance)
    told = found.withColumn("any", F.max("near").over(by)).where("near or not any").withColumn("share", F.col("asked") / F.sum("held").over(by))
    drawn = told.groupBy("h", "d").agg(F.sum("share").alias("draws"))
    parts = index.groupBy("part", "h", "d").agg(F.count(F.lit(1)).alias("listed"))
    own = parts.join(drawn, ["h", "d"], "left").withColumn("draws", F.col("listed") * F.coalesce("draws", F.lit(0.0)))
    return own.groupBy("part").agg(F.sum("listed").alias("listed"), F.sum("draws").alias("draws"), F.sum(F.least("draws", F.lit(1.0))).alias("distinct"))


def last_line_wins(lines: DataFrame, id_: str, order: str) -> DataFrame:
    return latest(lines, [id_], [order])


def resumed(rows: DataFrame, done: DataFrame, id_: str) -> DataFrame:
    """Rows whose id isn't done yet."""
    return rows.join(done.select(id_).distinct(), id_, "left_anti")
