"""Queries over rows in time: islands, windows, stitching, bounds, gaps, streams of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe, sequences
from ..streaming import events as streaming
from .registry import query, table


@query(
    """
    WITH s AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT s.*, e.ts FROM s JOIN events e USING (event_id)))
    SELECT user_id, island, event_type, count(*) AS length FROM (SELECT user_id, event_type, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM i) GROUP BY ALL
    """
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type of each user."""
    got = sequences.islands(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return got.groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("length"))


def seconds() -> Column:
    """Seconds since 1970 of a time without a zone, whatever the session's zone."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp")) / F.lit(1_000_000.0)


SECONDS = "epoch_us(ts) / 1000000.0::DOUBLE"


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ranges of some hours from their time on."""
    start = seconds()
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), start.alias("s"), (start + 3600 * (1 + F.col("value") % 10)).alias("e"))


RANGES = f"SELECT user_id, event_id AS id, {SECONDS} AS s, {SECONDS} + 3600 * (1 + value % 10) AS e FROM events"


@query(f"WITH r AS ({RANGES}) SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.user_id = b.user_id AND a.id < b.id AND a.s < b.e AND b.s < a.e WHERE least(a.e, b.e) - greatest(a.s, b.s) > 0.5 * least(a.e - a.s, b.e - b.s)")
def overlapping_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a user that overlap by more than half of the shorter one."""
    r = ranges(spark, sf_dir)
    return dedupe.overlaps(r, r, "user_id", 0.5, 6 * 3600.0).where("a < b").select("a", "b")


@query(
    f"""
    WITH r AS ({RANGES}), n AS (SELECT *, CASE WHEN s > max(e) OVER w THEN 1 WHEN row_number() OVER (PARTITION BY user_id ORDER BY s, e) = 1 THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT user_id, island, count(*) AS n, round(max(e) - min(s), 3) AS seconds FROM i GROUP BY ALL
    """
)
def merged_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that touch, as one."""
    got = sequences.chains(ranges(spark, sf_dir), ["user_id"], "s", "e")
    return got.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("e") - F.min("s"), 3).alias("seconds"))


@query(
    """
    WITH d AS (SELECT conv_id, count(*) * 4.5::DOUBLE AS duration FROM conversations GROUP BY conv_id)
    SELECT conv_id, round(k * 10.0::DOUBLE, 3) AS start FROM (SELECT conv_id, unnest(range(0, greatest(0, ceil((duration - 15) / 10)::INT) + 1)) AS k FROM d)
    """
)
def sliding_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 15 seconds each 10 over conversations of 4.5 seconds a turn."""
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count(F.lit(1)) * 4.5).alias("duration"))
    return d.select("conv_id", F.explode(sequences.window_starts(F.col("duration"), 15.0, 10.0)).alias("start"))


WINDOWS = """
    t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) * 4.5::DOUBLE AS duration FROM conversations),
    x AS (SELECT DISTINCT conv_id, duration, unnest(range(0, greatest(0, ceil((duration - 15) / 10)::INT) + 1)) * 10.0::DOUBLE AS start FROM t),
    w AS (SELECT conv_id, start, turn, i * 4.5::DOUBLE - start AS t0, i * 4.5::DOUBLE + 4 - start AS t1 FROM x JOIN t USING (conv_id) WHERE i * 4.5::DOUBLE + 4 > start AND i * 4.5::DOUBLE < start + 15)
    """


@query(
    f"""
    WITH {WINDOWS}, m AS (SELECT conv_id, start, (start + lag(least(start + 15, duration)) OVER k) / 2 AS low, (lead(start) OVER k + least(start + 15, duration)) / 2 AS high FROM x WINDOW k AS (PARTITION BY conv_id ORDER BY start))
    SELECT conv_id, turn, count(*) AS times FROM w JOIN m USING (conv_id, start) WHERE coalesce(start + (t0 + t1) / 2 >= low, true) AND coalesce(start + (t0 + t1) / 2 < high, true) GROUP BY ALL
    """
)
def stitched_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of overlapping windows, each once."""
    from pyspark.sql import Window

    own = Window.partitionBy("conv_id")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.row_number().over(own.orderBy("turn")) - 1) * 4.5).alias("at"), (F.count(F.lit(1)).over(own) * 4.5).alias("duration"))
    windows = t.select("conv_id", "duration").distinct().select("conv_id", "duration", F.explode(sequences.window_starts(F.col("duration"), 15.0, 10.0)).alias("start"))
    # The windows that hold a turn are computed from its time, so the join is by equal starts.
    first, last = F.greatest(F.lit(0), F.floor((F.col("at") + 4 - 15) / 10)), F.floor((F.col("at") + 4) / 10)
    heard = t.select("conv_id", F.col("turn").alias("word"), "at", F.explode(F.sequence(first, last)).alias("k")).withColumn("start", F.round(F.col("k") * 10.0, 3))
    words = heard.join(windows.select("conv_id", "start"), ["conv_id", "start"]).where((F.col("at") + 4 > F.col("start")) & (F.col("at") < F.col("start") + 15))
    words = words.select("conv_id", "start", "word", (F.col("at") - F.col("start")).alias("t0"), (F.col("at") + 4 - F.col("start")).alias("t1"))
    got = sequences.stitched(windows, words, "conv_id", 15.0)
    return got.groupBy("conv_id", F.col("word").alias("turn")).agg(F.count(F.lit(1)).alias("times"))


@query(
    """
    WITH s AS (SELECT c_nationkey AS key, c_custkey AS n, c_custkey * 10.0::DOUBLE AS s, c_custkey * 10.0::DOUBLE + 4 AS e FROM customer), b AS (SELECT key, n, coalesce((lag(e) OVER (PARTITION BY key ORDER BY s) + s) / 2, '-inf'::DOUBLE) AS lo, coalesce((lead(s) OVER (PARTITION BY key ORDER BY s) + e) / 2, 'inf'::DOUBLE) AS hi FROM s),
    p AS (SELECT event_id, user_id % 25 AS key, value * 100 AS x FROM events) SELECT n, count(*) AS points FROM p JOIN b ON p.key = b.key AND x >= lo AND x < hi GROUP BY n
    """
)
def assigned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by the span they belong to; bounds lie in the middle between spans."""
    spans = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("n"), (F.col("c_custkey") * 10.0).alias("s"), (F.col("c_custkey") * 10.0 + 4).alias("e"))
    points = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 25).cast("int").alias("key"), (F.col("value") * 100).alias("at"))
    return sequences.assigned(points, spans, "key", "at").where("n is not null").groupBy("n").agg(F.count(F.lit(1)).alias("points"))


@query("SELECT conv_id, turn, coalesce(sum(len(coalesce(text, '')) / 16.0::DOUBLE + 0.5::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations")
def laid_out_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns end to end with a pause of half a second."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length(F.coalesce("text", F.lit(""))) / 16.0).alias("d"))
    return sequences.laid_out(turns, ["conv_id"], ["turn"], "d", 0.5).select("conv_id", "turn", "start")


@query(
    """
    WITH s AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 12 AS stream FROM events) SELECT user_id, stream, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 2
    """
)
def user_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in streams of twelve."""
    got = sequences.streams(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 12)
    return got.groupBy("user_id", "stream").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""
    WITH RECURSIVE e AS (SELECT user_id, {SECONDS} AS t FROM events), a AS (SELECT user_id, min(t) AS anchor FROM e GROUP BY user_id
        UNION ALL SELECT a.user_id, (SELECT min(t) FROM e WHERE e.user_id = a.user_id AND e.t - a.anchor > 36000) AS anchor FROM a WHERE (SELECT min(t) FROM e WHERE e.user_id = a.user_id AND e.t - a.anchor > 36000) IS NOT NULL)
    SELECT user_id, count(*) AS groups FROM a GROUP BY user_id
    """
)
def anchored_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of events within ten hours of their first one."""
    e = table(spark, sf_dir, "events").select("user_id", (seconds()).alias("t"))
    return sequences.anchored(e, ["user_id"], "t", 36000.0).groupBy("user_id").agg(F.count_distinct("anchor").alias("groups"))


@query(f"WITH r AS ({RANGES}), g AS (SELECT user_id, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, s AS b FROM r) SELECT user_id, count(*) AS gaps, round(max(b - a), 3) AS longest FROM g WHERE b - a >= 7200 GROUP BY user_id")
def quiet_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of two hours or more without a range."""
    got = sequences.gaps(ranges(spark, sf_dir), ["user_id"], "s", "e", 7200.0)
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("gaps"), F.round(F.max(F.col("gap_end") - F.col("gap_start")), 3).alias("longest"))


@query(
    f"""
    WITH p AS (SELECT event_id, user_id, {SECONDS} AS x FROM events WHERE event_type = 'error'), m AS (SELECT user_id, {SECONDS} AS mark FROM events WHERE event_type = 'click'),
    r AS (SELECT event_id, mark, row_number() OVER (PARTITION BY event_id ORDER BY abs(mark - x), mark) AS k, x FROM p LEFT JOIN m USING (user_id)) SELECT event_id, round(mark - x, 3) AS away FROM r WHERE k = 1
    """
)
def nearest_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click of the same user that is nearest to an error."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (seconds()).alias("at"))
    got = sequences.nearest(e.where("event_type = 'error'").select("event_id", "user_id", "at"), e.where("event_type = 'click'").select("user_id", F.col("at").alias("mark")), "user_id", "at", "mark")
    return got.select("event_id", F.round(F.col("nearest") - F.col("at"), 3).alias("away"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT) AS cents FROM events GROUP BY ALL")
def streamed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour, counted by a stream with a watermark that reads all there is."""
    return streaming.by_window(spark, sf_dir)


@query("SELECT event_type, count(*) AS draws, max(event_id) AS last FROM events GROUP BY event_type")
def streamed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws counted by a stream that keeps its state between batches."""
    return streaming.totals(spark, sf_dir)


@query("SELECT event_type, json_extract_string(props, '$.k')::INT % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON rows."""
    props = F.from_json("props", "k int")
    return table(spark, sf_dir, "events").select("event_type", (props["k"] % 10).alias("k")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))
