"""Queries over seams, runs, slots and voices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import seams
from .registry import query, table

# Items as readings of slots at offsets, by two arms; quantities as times, prices as merge points.
READS = "SELECT l_linestatus AS arm, l_orderkey // 4 AS slot, l_linenumber AS o, l_returnflag <> 'R' AS ok, l_quantity AS t, l_extendedprice / 2000 AS g FROM lineitem"


@query(
    f"""
    WITH r AS ({READS}), b AS (SELECT slot FROM r GROUP BY slot HAVING count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM r)),
    n AS (SELECT DISTINCT x.slot, x.o FROM r x JOIN r y ON x.slot = y.slot AND x.o = y.o AND abs(x.t - y.g) <= 1.5),
    t AS (SELECT arm, r.slot, ok, n.o IS NOT NULL AS near FROM r JOIN b USING (slot) LEFT JOIN n ON n.slot = r.slot AND n.o = r.o), m AS (SELECT slot, bool_or(near) AND NOT bool_and(near) AS mixed FROM t GROUP BY slot),
    p AS (SELECT arm, ok, CASE WHEN near THEN 'near' ELSE 'interior' END AS part FROM t UNION ALL SELECT arm, ok, 'within_slot_' || CASE WHEN near THEN 'near' ELSE 'interior' END FROM t JOIN m USING (slot) WHERE mixed)
    SELECT arm, part, sum((NOT ok)::INT) AS wrong, count(*) AS n FROM p GROUP BY ALL
    """
)
def near_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong readings near merge points and inside."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("arm"), F.floor(F.col("l_orderkey") / 4).alias("slot"), F.col("l_linenumber").alias("offset"), (F.col("l_returnflag") != "R").alias("right"), F.col("l_quantity").alias("t"), (F.col("l_extendedprice") / 2000).alias("g"))
    return seams.near_interior(items.select("arm", "slot", "offset", "right"), items.select("slot", "offset", "t"), items.select("slot", "offset", "g"))


@query(
    """
    WITH c AS (SELECT 'run' || (l_suppkey % 6) AS run, ['en', 'de', 'es', 'ru', 'pl'][l_partkey % 5 + 1] AS lang, sum((l_returnflag = 'R')::INT) AS merged, sum((l_returnflag = 'A')::INT) + sum((l_linestatus = 'O')::INT) AS single FROM lineitem WHERE NOT (l_suppkey % 6 = 5 AND l_partkey % 5 = 0) GROUP BY ALL),
    b AS (SELECT run, coalesce(sum(merged) FILTER (lang IN ('de', 'es')), 0) AS m, coalesce(sum(single) FILTER (lang IN ('de', 'es')), 0) AS s, coalesce(sum(merged) FILTER (lang = 'en'), 0) AS em, coalesce(sum(single) FILTER (lang = 'en'), 0) AS es, bool_or(lang = 'en') AS has FROM c GROUP BY run),
    x AS (SELECT a.*, o.m AS bm, o.s AS bs, o.em AS bem, o.es AS bes FROM b a, b o WHERE o.run = 'run0' AND a.run <> 'run0')
    SELECT run, 'wave-1 merge-made wrong' AS check, m::DOUBLE AS got, bm::DOUBLE AS base, m <= 0.5::DOUBLE * bm AND (bm > 0 OR m = 0) AS ok FROM x UNION ALL SELECT run, 'English merge-made wrong', em, bem, has AND em <= bem FROM x
    UNION ALL SELECT run, 'wave-1 single-decode wrong + dropped', s, bs, s <= bs FROM x UNION ALL SELECT run, 'English single-decode wrong + dropped', es, bes, NOT has OR es <= bes FROM x
    """
)
def seam_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs against a base, one row a check."""
    items = table(spark, sf_dir, "lineitem").where("not (l_suppkey % 6 = 5 and l_partkey % 5 = 0)")
    lang = F.get(F.array(*[F.lit(x) for x in ("en", "de", "es", "ru", "pl")]), (F.col("l_partkey") % 5).cast("int"))
    n = lambda c: F.sum(c.cast("int"))
    counts = items.groupBy(F.concat(F.lit("run"), (F.col("l_suppkey") % 6).cast("string")).alias("run"), lang.alias("lang")).agg(n(F.col("l_returnflag") == "R").alias("merge_wrong"), n(F.col("l_returnflag") == "A").alias("wrong"), n(F.col("l_linestatus") == "O").alias("dropped"))
    return seams.seam_gate(counts, "run0")


@query(
    """
    WITH s AS (SELECT o_orderkey AS r, l_partkey AS v, l_returnflag AS cell, CASE WHEN l_quantity > 10 THEN l_suppkey END AS scene FROM orders JOIN lineitem ON l_orderkey = o_orderkey), k AS (SELECT o_orderkey, count(r) AS k FROM orders LEFT JOIN s ON r = o_orderkey GROUP BY o_orderkey),
    n AS (SELECT avg((k = 1)::INT) AS one, avg((k >= 2)::INT) AS more, count(*) AS rows FROM k), v AS (SELECT v, count(*) AS c, bool_or(cell IN ('A', 'N')) AS closed FROM s GROUP BY v),
    w AS (SELECT coalesce(sum(c - 1) FILTER (NOT closed), 0) AS open, max(c) AS worst FROM v), t AS (SELECT sum(c) AS slots, max(c) AS top FROM (SELECT scene, count(*) AS c FROM s WHERE scene IS NOT NULL GROUP BY scene))
    SELECT 'N numbers per row' AS check, one AS got, one >= 0.55 AND more >= 0.1 AS ok FROM n UNION ALL SELECT 'V1 slot values', worst, open <= 0 AND worst <= 60 FROM w
    UNION ALL SELECT 'T13 topic repetition', top / slots, top / slots <= CASE WHEN rows >= 1000 THEN 0.02 ELSE 0.07 END FROM t, n WHERE slots >= 100
    """
)
def slot_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variety of what orders hold."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("value"), F.col("l_returnflag").alias("cell"), F.when(F.col("l_quantity") > 10, F.col("l_suppkey")).alias("scene"))
    return seams.slot_gates(rows, items.join(rows, "row", "left_semi"), ["A", "N"], 60, 0.02)


@query(
    """
    WITH a AS (SELECT 0.9 + c_custkey % 3 * 0.1 AS tempo, CASE WHEN c_custkey % 5 < 2 THEN 'f' ELSE 'm' END AS gender, c_nationkey AS voice, c_mktsegment AS seg FROM customer), n AS (SELECT count(*) AS n, min(tempo) AS low, max(tempo) AS high, avg((tempo = 1.0)::INT) AS exact, avg((seg = 'BUILDING')::INT) AS s0, avg((seg = 'NONE')::INT) AS s1 FROM a),
    g AS (SELECT count(*) AS k, min(c) AS low, max(c) AS high FROM (SELECT count(*) AS c FROM a GROUP BY gender)), v AS (SELECT max(c) AS c FROM (SELECT count(*) AS c FROM a GROUP BY voice))
    SELECT 'A1 tempo' AS check, exact AS got, low >= 0.9 AND high <= 1.1 AND exact >= 0.3 AS ok FROM n UNION ALL SELECT 'A2 gender share', g.low / n, k = 2 AND g.low / n >= 0.35 AND g.high / n <= 0.65 FROM g, n UNION ALL SELECT 'A3 rows of a voice', c, c <= 70 FROM v
    UNION ALL SELECT 'A seg=BUILDING share', s0, s0 >= 0.14 AND s0 <= 0.26 FROM n UNION ALL SELECT 'A seg=NONE share', s1, s1 >= 0.09 AND s1 <= 0.51 FROM n
    """
)
def audio_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variety of voices."""
    key = F.col("c_custkey")
    tempo = F.when(key % 3 == 0, 0.9).when(key % 3 == 1, 1.0).otherwise(1.1)
    rows = table(spark, sf_dir, "customer").select(tempo.alias("tempo"), F.when(key % 5 < 2, "f").otherwise("m").alias("gender"), F.col("c_nationkey").alias("voice"), F.col("c_mktsegment").alias("seg"))
    return seams.audio_gates(rows, (0.9, 1.1), 0.3, (0.35, 0.65), 70, [("seg", "BUILDING", 0.15, 0.25), ("seg", "NONE", 0.1, 0.5)], 0.01)


@query("WITH p AS (SELECT p_partkey, p_size = 1 AS first FROM part) SELECT p_partkey, first FROM p WHERE first UNION ALL SELECT p_partkey, first FROM p WHERE NOT first AND p_partkey NOT IN (SELECT unnest([p_partkey + 1, p_partkey + 2]) FROM p WHERE first)")
def synthetic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of size 1 first; each supersedes the two after it."""
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") == 1).alias("one"), F.array(F.col("p_partkey") + 1, F.col("p_partkey") + 2).alias("over"))
    return seams.synthetic_order(parts, F.col("one"), "over", "p_partkey").select("p_partkey", "first")
