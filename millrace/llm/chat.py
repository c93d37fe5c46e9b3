"""Chat formatting: of conversations logged again and again as they grow, the longest are kept and rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Turn numbers that are counted together, and turns rendered into one row at most.
CHUNK, PART = 256, 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
NO_ID = -(1 << 63)


def placed(turns: DataFrame) -> DataFrame:
    """Distinct turns (conv, turn, role, text) with place (from 0), the conversation's n, and prefix hashes p1 and p2 up to and with the turn.

    A prefix hash is the exclusive or of hashes of each turn with its place. Places and hashes are counted within chunks of turn numbers
    first, and chunks added up then, so that a conversation with very many turns is dealt out over tasks.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    role = F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role")
    own = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.col("turn").cast("long"), role, text).distinct()
    own = written(own.withColumn("chunk", F.floor(F.col("turn") / CHUNK)).withColumn("chunk", F.coalesce("chunk", F.lit(NO_ID))))

    chunks = own.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("size"))
    before = "OVER (PARTITION BY conv ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = chunks.select("conv", "chunk", F.expr(f"coalesce(sum(size) {before}, 0L)").alias("skip"), F.expr("sum(size) OVER (PARTITION BY conv)").alias("n"))
    hashes = F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "text", "role").alias("t2")
    short = own.select("conv", "chunk", "turn", "role", *hashes, F.expr("row_number() OVER (PARTITION BY conv, chunk ORDER BY turn, role, text)").alias("nth"))
    ranked = written(short.join(starts, ["conv", "chunk"]).withColumn("place", F.col("skip") + F.col("nth") - 1).withColumn("h1", F.xxhash64("place", "t1", "t2")).withColumn("h2", F.xxhash64("t2", "t1", "place")))

    sums = ranked.groupBy("conv", "chunk").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    carried = sums.select("conv", "chunk", *(F.expr(f"coalesce(bit_xor(x{i}) {before}, 0L)").alias(f"c{i}") for i in (1, 2)))
    running = "OVER (PARTITION BY conv, chunk ORDER BY place)"
    prefixed = ranked.join(carried, ["conv", "chunk"]).select("conv", "chunk", "turn", "t1", "t2", "place", "n", *(F.col(f"c{i}").bitwiseXOR(F.expr(f"bit_xor(h{i}) {running}")).alias(f"p{i}") for i in (1, 2)))
    keyed = own.select("conv", "chunk", F.col("turn"), "role", "text", *hashes)
    same = (keyed.conv == prefixed.conv) & (keyed.chunk == prefixed.chunk) & keyed.turn.eqNullSafe(prefixed.turn) & (keyed.t1 == prefixed.t1) & (keyed.t2 == prefixed.t2)
    return keyed.join(prefixed, same).select(keyed.conv, keyed.turn, "role", "text", "place", "n", "p1", "p2")


def maximal(turns: DataFrame) -> DataFrame:
    """The conv of each placed conversation that is no beginning of a longer one; of equal ones the least."""
    key = ["k", "p1", "p2"]
    prefix = turns.select((F.col("place") + 1).alias("k"), "p1", "p2", "n", "conv")
    whole = prefix.where("k = n").groupBy(*key).agg(F.min("conv").alias("conv"))
    begun = prefix.where("k < n").select(*key).distinct()
    return whole.join(begun, key, "left_anti").select("conv")


def collapsed(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, rendered): the maximal conversations, rendered in parts of PART turns that follow on each other.

    Turns are ordered by turn, then role, then text; repeated rows count once. A null turn comes first; a null role or text is empty. Rows
    without a conv_id are one conversation. An empty table gives no rows. Further columns are not looked at.
    """
    turns = written(placed(conversations))
    keep = written(maximal(turns))
    shown = turns.join(keep, "conv", "left_semi").withColumn("part", F.floor(F.col("place") / PART).cast(T.LongType()))
    said = F.sort_array(F.collect_list(F.struct("place", "role", "text")))
    lines = F.transform("said", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n")))
    parts = shown.groupBy("conv", "part").agg(said.alias("said"))
    return parts.select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), "part", F.size("said").cast("long").alias("n_turns"), F.array_join(lines, "").alias("rendered"))


ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT *, string_agg(md5(role || chr(1) || text), ',') OVER (PARTITION BY conv_id ORDER BY place) AS path FROM o),
w AS (SELECT path, min(conv_id) AS conv_id FROM p WHERE place = n - 1 GROUP BY path),
k AS (SELECT conv_id FROM w WHERE path NOT IN (SELECT path FROM p WHERE place < n - 1))
SELECT conv_id, place // {PART} AS part, count(*) AS n_turns,
    string_agg('{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10), '' ORDER BY place) AS rendered
FROM o WHERE conv_id IN (SELECT conv_id FROM k) GROUP BY ALL
"""
