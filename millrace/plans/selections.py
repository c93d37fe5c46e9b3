"""Queries that select: budgets, caps, quotas, splits, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes, text
from ..operators import census, dedupe, select
from .registry import query, table
from .texts import MD5, SPANS, TEMPLATE


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY {MD5.format('doc_id')}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 50000")
def budget_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language in hash order until 50,000 characters; the one that crosses is in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return select.budget_take(docs, F.lit(50_000), F.col("n_chars"), "doc_id", ["lang"]).select("doc_id", "lang")


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, coalesce(sum(round(o_totalprice * 100)::BIGINT) OVER (ORDER BY {MD5.format('o_orderkey')}, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders) WHERE before < 5000000000")
def budget_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in hash order until 50 million; one budget over all rows, without a task that has them all."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return select.budget_take(orders, F.lit(5_000_000_000), F.col("cents"), "o_orderkey").select("o_orderkey")


@query(
    f"""
    WITH d AS (SELECT doc_id, lang, n_chars, source IN ('src0', 'src1', 'src2', 'src3') AS late, {MD5.format('doc_id')} AS h FROM documents),
    f AS (SELECT * FROM (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d WHERE NOT late) WHERE before < 60000),
    u AS (SELECT lang, sum(n_chars) AS used FROM f GROUP BY lang),
    l AS (SELECT d.*, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d WHERE late)
    SELECT doc_id, lang FROM f UNION ALL SELECT doc_id, lang FROM l LEFT JOIN u USING (lang) WHERE before < least(60000 - coalesce(used, 0), 24000)
    """
)
def budget_in_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60,000 characters a language: other sources first, then some with 40 % at most of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    late = F.col("source").isin("src0", "src1", "src2", "src3")
    return select.budget_take_in_two(docs, F.lit(60_000), F.col("n_chars"), "doc_id", ["lang"], late, 0.4).select("doc_id", "lang")


@query(
    f"""
    WITH t AS (SELECT doc_id, source, n_chars > 5000 AS rare, {TEMPLATE} AS raw, {MD5.format('doc_id')} AS h FROM documents),
    k AS (SELECT doc_id, source, rare, h, CASE WHEN len(regexp_extract_all(raw, '\\p{{L}}+')) >= 3 THEN raw ELSE '' END AS t FROM t),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rare DESC, h, doc_id) AS n FROM k) WHERE rare OR t = '' OR n <= 1),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rare DESC, h, doc_id) AS m FROM a) WHERE rare OR m <= 13)
    SELECT doc_id, source FROM b
    """
)
def caps_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a template, then 13 a source; long ones count but always stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.when(text.template("text") != "", F.md5(text.template("text"))).otherwise("").alias("t"))
    return select.capped(docs, F.col("n_chars") > 5000, "doc_id", [("t", 1, F.col("t") != ""), ("source", 13, F.lit(True))]).select("doc_id", "source")


@query(f"SELECT o_orderkey, o_orderpriority, o_orderstatus, n AS turn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY {MD5.format('o_orderkey')}, o_orderkey) AS n FROM orders) ORDER BY n, o_orderpriority, o_orderstatus LIMIT 40")
def pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty orders dealt from priorities and states in turn."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return select.round_robin(orders, ["o_orderpriority", "o_orderstatus"], "o_orderkey", 40)


TOTAL = f"WITH c AS (SELECT v, count(*) AS n FROM ({SPANS}) GROUP BY v), t AS (SELECT sum(n)::DOUBLE AS total FROM c), l0 AS (SELECT 0.03::DOUBLE * total AS l, total FROM t)"
LIMITS = ", ".join(f"l{k + 1} AS (SELECT 0.03::DOUBLE * (any_value(total) - coalesce(sum(CASE WHEN n > 0.03::DOUBLE * total THEN greatest(0, n - l) END), 0)) AS l, any_value(total) AS total FROM c, l{k})" for k in range(5))


@query(f"{TOTAL}, {LIMITS} SELECT * FROM (SELECT v, CASE WHEN n > 0.03::DOUBLE * total THEN least(n, floor(l)::BIGINT) ELSE n END AS n FROM c, l5) WHERE n > 0")
def capped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of texts; a value with over 3 % of them has 3 % of those that are left."""
    spans = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(classes.spans("text")).alias("ord", "v"))
    keyed = spans.withColumn("key", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ord").cast("string")))
    return select.cap_values(keyed, "v", 0.03, "key").groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    WITH s AS (SELECT l_suppkey, count(*) AS size FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey), o AS (SELECT count(*) AS outside FROM lineitem WHERE l_returnflag <> 'R'),
    n AS (SELECT unnest(range(1, max(size) + 1)) AS n FROM s), t AS (SELECT n, sum(least(size, n)) AS inside FROM n, s GROUP BY n)
    SELECT n, inside, inside + outside AS total FROM t, o WHERE inside <= 0.15::DOUBLE * (inside + outside) ORDER BY n DESC LIMIT 1
    """
)
def rows_per_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most returned items a supplier may keep for these to be 15 % of all at most."""
    return select.largest_n_per_group(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag"), "l_suppkey", F.col("l_returnflag") == "R", 0.15)


SHAPED = "SELECT doc_id, " + MD5.format("doc_id") + " AS h, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{k}' END" for k, p in classes.SHAPES.items()) + "], lambda x: x IS NOT NULL) AS shapes FROM documents"


@query(
    f"""
    WITH RECURSIVE d AS ({SHAPED}), o AS (SELECT name, row_number() OVER (ORDER BY n, name) AS k FROM (SELECT unnest(shapes) AS name, count(*) AS n FROM d GROUP BY name)),
    g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS chosen UNION ALL SELECT i + 1, list_concat(chosen, (SELECT coalesce(list(doc_id ORDER BY h, doc_id), []) FROM d WHERE list_contains(shapes, name) AND NOT list_contains(chosen, doc_id))[1:greatest(0, 30 - (SELECT count(*) FROM d WHERE list_contains(shapes, name) AND list_contains(chosen, doc_id)))])
        FROM g JOIN o ON k = i + 1)
    SELECT doc_id, array_to_string(shapes, ',') AS shapes FROM d WHERE doc_id IN (SELECT unnest(chosen) FROM g WHERE i = (SELECT max(i) FROM g))
    """
)
def quota_by_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents until each shape of number has thirty, the rarest shape first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *classes.shape_counts("text"))
    shapes = F.array_compact(F.array(*[F.when(F.col(k) > 0, F.lit(k)) for k in classes.SHAPES]))
    return select.quota_select(docs.select("doc_id", shapes.alias("shapes")), "shapes", dict.fromkeys(classes.SHAPES, 30), "doc_id").select("doc_id", F.array_join("shapes", ",").alias("shapes"))


@query()
def carved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sources for a held-out part: ten documents of each language with a number shape, no more than a fifth of any."""
    docs = table(spark, sf_dir, "documents").select("source", *classes.shape_counts("text"))
    shapes = F.array_compact(F.array(*[F.when(F.col(k) > 0, F.lit(k)) for k in classes.SHAPES]))
    return select.carve_groups(docs.select("source", shapes.alias("shapes")), "source", "shapes", dict.fromkeys(classes.SHAPES, 10), 0.2)


@query(f"SELECT source, {MD5.format('source')} % 3 = 0 AS held_out, count(*) AS docs FROM documents GROUP BY ALL")
def split_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split by a hash of the source, so that a source is on one side."""
    return table(spark, sf_dir, "documents").groupBy("source", (text.stable("source") % 3 == 0).alias("held_out")).agg(F.count(F.lit(1)).alias("docs"))


@query(f"SELECT nation, side, count(*) AS n FROM (SELECT c_nationkey AS nation, (row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY {MD5.format('c_custkey')}, c_custkey) - 1) % 2 AS side FROM customer) GROUP BY ALL")
def dealt_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dealt into two halves, evenly within nation and segment."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy(text.stable("c_custkey"), "c_custkey"))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), ((nth - 1) % 2).cast("long").alias("side")).groupBy("nation", "side").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    """
)
def unused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without what is used already and without what is protected."""
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    protected = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(used, "o_orderkey", "left_anti").join(protected, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'returned' WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'in debt'
        WHEN o_orderpriority IN (SELECT '1-URGENT') THEN 'urgent' END AS reason FROM orders
    """
)
def protected_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several protected tables that an order meets."""
    tables = {
        "returned": table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")),
        "in debt": table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")),
        "urgent": spark.range(1).select(F.lit("1-URGENT").alias("o_orderpriority")),
    }
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return dedupe.without_protected(orders, tables, "o_orderkey").select("o_orderkey", "reason")


@query("SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_returnflag <> 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 40))")
def whole_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders all of whose items are good and of a chosen part."""
    parts = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("chosen"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(parts, "l_partkey", "left")
    good = (F.col("l_returnflag") != "R") & F.coalesce("chosen", F.lit(False))
    return items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"), F.bool_and(good).alias("all")).where("all").select("l_orderkey", "items")


@query(
    f"""
    WITH i AS (SELECT l_orderkey, l_linenumber, l_shipmode_key FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS l_shipmode_key FROM lineitem)),
    p AS (SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b, row_number() OVER (PARTITION BY a.l_orderkey ORDER BY a.l_linenumber, b.l_linenumber) AS n
        FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.l_shipmode_key = b.l_shipmode_key AND a.l_linenumber < b.l_linenumber)
    SELECT l_orderkey, a, b FROM p WHERE n <= 3
    """
)
def consistency_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items of one order with the same flags, three an order at most."""
    from pyspark.sql import Window

    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber"), F.concat("l_returnflag", "l_linestatus").alias("flags"))
    a, b = items.withColumnRenamed("l_linenumber", "a"), items.withColumnRenamed("l_linenumber", "b")
    pairs = a.join(b, ["l_orderkey", "flags"]).where("a < b")
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("a", "b"))).where("n <= 3").select("l_orderkey", "a", "b")


@query(
    """
    WITH r AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
    SELECT documents.doc_id, CASE WHEN quality = 1 THEN upper(lang) ELSE lang END AS lang FROM documents LEFT JOIN r USING (doc_id) WHERE coalesce(toxic, 0) = 0
    """
)
def keyed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed update: toxic documents go, good ones get a new value."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(marks, "doc_id", "left").where("coalesce(toxic, 0) = 0")
    return docs.select("doc_id", F.when(F.col("quality") == 1, F.upper("lang")).otherwise(F.col("lang")).alias("lang"))


@query(
    """
    WITH p AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), q AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)
    SELECT l_suppkey, sum(least(coalesce(p.n, 0), coalesce(q.n, 0))) AS common, sum(coalesce(p.n, 0)) AS a, sum(coalesce(q.n, 0)) AS b FROM p FULL JOIN q USING (l_suppkey, l_partkey) GROUP BY l_suppkey
    """
)
def common_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that two sets of a supplier's items have in common, counted as often as both have them."""
    from ..operators.paired import common_counts

    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    return common_counts(items.where("l_returnflag = 'A'"), items.where("l_returnflag = 'N'"), ["l_suppkey", "l_partkey"], ["l_suppkey"])


@query("SELECT lang, real, made, greatest(floor(real * 0.25::DOUBLE / 0.75::DOUBLE)::BIGINT, 120 - real + 4, 0) AS room, least(made, greatest(0, 80 - real)) AS fill FROM (SELECT lang, sum((n_chars >= 500)::INT)::BIGINT AS real, sum((n_chars < 500)::INT)::BIGINT AS made FROM documents GROUP BY lang)")
def synthetic_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Room for made rows beside real ones, by share and by bar."""
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum((F.col("n_chars") >= 500).cast("long")).alias("real"), F.sum((F.col("n_chars") < 500).cast("long")).alias("made"))
    return counts.select("lang", "real", "made", census.synthetic_room(F.col("real"), 120, 0.25).alias("room"), census.value_fill(F.col("real"), F.col("made"), 80).alias("fill"))
