"""Queries over ids, rules and labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes, ids, labels, text
from ..operators import ordering, select, sequences
from .registry import query, table
from .texts import MD5, WORDS

# Orders as rows of four kinds, with ids as such rows have.
IDS = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'en001_' || o_orderkey || '_abcdefgh' || (100 + o_custkey % 9) || '_' || o_orderkey % 600 || '_' || (10 + o_custkey % 80) || '_7_25' WHEN 1 THEN '2018061' || o_custkey % 9 || '-0900-PLENARY-' || o_custkey % 4 || '-en_x' || o_orderkey
    WHEN 2 THEN 'fleurs_' || o_custkey % 50 || '_' || o_orderkey WHEN 3 THEN 'en001_' || o_orderkey || '_abcdefgh' || (100 + o_custkey % 9) || '_5_10_2_0_p3' ELSE 'other_' || o_orderkey END AS id FROM orders"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    t = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    video = t("en001_", key, "_abcdefgh", 100 + c % 9)
    id_ = F.when(key % 5 == 0, t(video, "_", key % 600, "_", 10 + c % 80, "_7_25")).when(key % 5 == 1, t("2018061", c % 9, "-0900-PLENARY-", c % 4, "-en_x", key)).when(key % 5 == 2, t("fleurs_", c % 50, "_", key)).when(key % 5 == 3, t(video, "_5_10_2_0_p3")).otherwise(t("other_", key))
    return table(spark, sf_dir, "orders").select("o_orderkey", id_.alias("id"))


@query(
    f"""
    WITH r AS ({IDS}) SELECT CASE WHEN regexp_matches(id, '^[a-z]{{2}}[0-9]{{3}}_[0-9]+_.{{11}}_') THEN 'yt:' || regexp_extract(id, '^[a-z]{{2}}[0-9]{{3}}_[0-9]+_(.{{11}})_', 1) WHEN contains(id, 'PLENARY') THEN 'ep:' || split_part(id, '_', 1)
        WHEN id LIKE 'fleurs%' THEN 'fl:' || regexp_extract(id, '^fleurs_([0-9]+)_', 1) ELSE 'id:' || id END AS unit, count(*) AS n FROM r GROUP BY unit
    """
)
def variety_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by their unit of variety."""
    return rows(spark, sf_dir).groupBy(ids.group_unit(F.col("id")).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""
    WITH r AS (SELECT regexp_replace(id, '_p[0-9]+$', '') AS id FROM ({IDS})), p AS (SELECT id, regexp_extract(id, '[a-z]{{2}}[0-9]+_[0-9]+_([A-Za-z0-9_-]{{11}})_([0-9]+)_([0-9]+)_([0-9]+)_([0-9]+)$', ['v', 'a', 'b', 'c', 'd']) AS x,
        regexp_extract(id, '^([0-9]{{8}}-[0-9]{{4}}-[A-Z]+(?:-[A-Z0-9]+)*?)[-_][a-z]{{2}}(?:_|$)', 1) AS g FROM r),
    k AS (SELECT CASE WHEN x.v <> '' THEN 'yt' WHEN g <> '' THEN 'gv' ELSE 'id' END AS kind, CASE WHEN x.v <> '' THEN x.v WHEN g <> '' THEN g ELSE id END AS key, CASE WHEN x.v <> '' THEN TRY_CAST(x.a AS DOUBLE) + TRY_CAST(x.b AS DOUBLE) / 100 END AS s, CASE WHEN x.v <> '' THEN TRY_CAST(x.c AS DOUBLE) + TRY_CAST(x.d AS DOUBLE) / 100 END AS l FROM p)
    SELECT kind, key, count(*) AS n, round(min(s), 2) AS first, round(max(s + l), 2) AS last FROM k GROUP BY ALL
    """
)
def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings with their rows and the time these cover."""
    r = rows(spark, sf_dir).select(ids.recording(F.col("id")).alias("r"))
    return r.groupBy(F.col("r.kind").alias("kind"), F.col("r.key").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("r.s"), 2).alias("first"), F.round(F.max("r.e"), 2).alias("last"))


@query(
    """
    WITH p AS (SELECT o_orderkey, 'a/b/' || CASE WHEN o_orderkey % 3 = 0 THEN 'spd_' ELSE '' END || 'row' || o_orderkey // 2 || CASE WHEN o_orderkey % 3 = 1 THEN '__aug' ELSE '' END || '.wav' AS path, o_orderpriority AS said, CASE WHEN o_custkey % 2 = 0 THEN 'v' || o_custkey % 7 END AS video FROM orders),
    k AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'spd' WHEN o_orderkey % 3 = 1 THEN 'aug' ELSE 'clean' END AS variant, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN video IS NULL THEN 'tx:' || substr(sha1(said), 1, 16) ELSE 'vt:' || video || '|' || substr(sha1(said), 1, 16) END ELSE 'a:row' || o_orderkey // 2 END AS key FROM p)
    SELECT key, count(*) AS n, count(DISTINCT variant) AS variants FROM k GROUP BY key
    """
)
def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a row by a key that they share."""
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.lit("a/b/"), F.when(key % 3 == 0, "spd_").otherwise(""), F.lit("row"), F.floor(key / 2).cast("string"), F.when(key % 3 == 1, "__aug").otherwise(""), F.lit(".wav"))
    p = table(spark, sf_dir, "orders").select(name.alias("path"), F.col("o_orderpriority").alias("said"), F.when(c % 2 == 0, F.concat(F.lit("v"), (c % 7).cast("string"))).alias("video"))
    k = p.select(ids.variant(F.col("path")).alias("variant"), ids.stable_key(F.col("path"), F.col("said"), F.col("video")).alias("key"))
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("variant").alias("variants"))


@query(
    f"""
    WITH d AS (SELECT doc_id, n_chars, lang, {MD5.format('doc_id')} AS h FROM documents), e AS (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d WHERE lang = 'en')
    SELECT doc_id, 'en' AS part, 1 AS copy FROM e WHERE before < 100000 UNION ALL SELECT doc_id, 'de' AS part, unnest([1, 2]) AS copy FROM d WHERE lang = 'de'
    """
)
def mixed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix: English up to a budget, German twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    got = select.mixed([(docs.where("lang = 'en'"), 100_000, "en", 1), (docs.where("lang = 'de'"), None, "de", 2)], "n_chars", "doc_id")
    return got.select("doc_id", "part", "copy")


@query()
def filled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of some sources, and of the others those with numbers that fewer than three of them have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.array_distinct(classes.spans("text")).alias("v"))
    chosen = F.col("source").isin("src0", "src1")
    return select.filled_to_floor(docs.where(chosen), docs.where(~chosen), "v", "doc_id", 3).select("doc_id")


NEGATED = " ".join(f"WHEN '{lang}' THEN ['" + "', '".join(words) + "']" for lang, words in labels.NEGATIONS.items())
OFTEN = "flatten(list_transform(list_sort(list_distinct({0})), lambda w: list_transform(range(greatest(0, len(list_filter({0}, lambda z: z = w)) - len(list_filter({1}, lambda z: z = w)))), lambda i: w)))"


@query(
    f"""
    WITH t AS (SELECT conv_id, turn, text, ['de', 'es', 'fr', 'it', 'nl', 'pt', 'en'][conv_id % 7 + 1] AS lang, {WORDS} AS w FROM conversations),
    n AS (SELECT conv_id, turn, text, list_transform(list_filter(w, lambda x, i: list_contains(CASE lang {NEGATED} END, x) AND NOT (lang = 'fr' AND x = 'n' AND i > 1 AND w[i - 1] = 'on')), lambda x: CASE x WHEN 'n' THEN 'ne' WHEN 'niks' THEN 'niets' WHEN 'nix' THEN 'nichts' ELSE x END) AS a FROM t),
    p AS (SELECT conv_id, turn, a, lead(a) OVER (PARTITION BY conv_id ORDER BY turn, text) AS b FROM n), d AS (SELECT conv_id, turn, {OFTEN.format('b', 'a')} AS lost, {OFTEN.format('a', 'b')} AS extra FROM p WHERE b IS NOT NULL)
    SELECT conv_id, turn, CASE WHEN len(lost) > 0 THEN 'lost ' || array_to_string(lost, ' ') WHEN len(extra) > 0 THEN 'extra ' || array_to_string(extra, ' ') END AS mismatch FROM d
    """
)
def negation_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negations of each turn that the next lacks or has beside them, by seven languages in turn."""
    from pyspark.sql import Window

    lang = F.get(F.array(*[F.lit(x) for x in ("de", "es", "fr", "it", "nl", "pt", "en")]), (F.col("conv_id") % 7).cast("int"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", lang.alias("lang"), text.words("text").alias("w")).withColumn("a", labels.negations(F.col("w"), F.col("lang")))
    pairs = t.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn", "text"))).where("b is not null")
    return pairs.select("conv_id", "turn", labels.negation_mismatch(F.col("a"), F.col("b")).alias("mismatch"))


@query(
    """
    SELECT CASE WHEN l_shipmode = 'human_transcript' THEN 0 WHEN l_linestatus <> 'F' OR l_extendedprice / 10000 < 3 OR l_discount > 0.09 OR l_tax > 0.07 OR l_quantity > 45 THEN 2 ELSE 1 END AS tier, count(*) AS n
    FROM (SELECT *, CASE WHEN l_suppkey % 10 = 0 THEN 'human_transcript' ELSE 'caption' END AS l_shipmode FROM lineitem) GROUP BY tier
    """
)
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by how much they are to be trusted."""
    items = table(spark, sf_dir, "lineitem")
    source = F.when(F.col("l_suppkey") % 10 == 0, "human_transcript").otherwise("caption")
    status = F.when(F.col("l_linestatus") == "F", "scored").otherwise("error")
    t = labels.tier(source, status, F.col("l_extendedprice") / 10000, F.col("l_discount") > 0.09, F.col("l_tax") <= 0.07, F.col("l_quantity") > 45, 3.0)
    return items.select(t.alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN regexp_matches(url, '/(de|fr|es)/') THEN 'other' WHEN regexp_matches(url, '[?]') THEN 'query' WHEN regexp_matches(url, '^https') THEN 'plain' ELSE 'none' END AS class, count(*) AS n FROM pages GROUP BY class")
def rule_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the first of some patterns."""
    rules = [("/(de|fr|es)/", "other"), ("[?]", "query"), ("^https", "plain")]
    return table(spark, sf_dir, "pages").groupBy(labels.classified(F.coalesce("url", F.lit("")), rules, "none").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) * 4.5::DOUBLE AS duration FROM conversations),
    x AS (SELECT DISTINCT conv_id, unnest(range(0, greatest(0, ceil((duration - 15) / 10)::INT) + 1)) * 10.0::DOUBLE AS start FROM t),
    w AS (SELECT conv_id, start, turn, greatest(0, least(start + 15, i * 4.5::DOUBLE + 4) - greatest(start, i * 4.5::DOUBLE)) / 4 AS share FROM x JOIN t USING (conv_id))
    SELECT conv_id, start, sum((share >= 0.66)::INT) AS words, bool_or(share > 0.34 AND share < 0.66) AS cut FROM w WHERE share > 0 GROUP BY ALL
    """
)
def window_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each window: two thirds inside count, one third is left out, and between them the window is cut badly."""
    from pyspark.sql import Window

    own = Window.partitionBy("conv_id")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.row_number().over(own.orderBy("turn")) - 1) * 4.5).alias("at"), (F.count(F.lit(1)).over(own) * 4.5).alias("duration"))
    starts = t.select("conv_id", "duration").distinct().select("conv_id", F.explode(sequences.window_starts(F.col("duration"), 15.0, 10.0)).alias("start"))
    # The windows that a word may touch are told by its time: no pairs of all words and windows are made.
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("at") - 15) / 10)), F.floor((F.col("at") + 4) / 10))
    w = t.withColumn("k", F.explode(near)).withColumn("start", F.round(F.col("k") * 10.0, 3)).join(starts, ["conv_id", "start"])
    share = labels.inside_share(F.col("at"), F.col("at") + 4, F.col("start"), F.col("start") + 15)
    told = w.withColumn("share", share).where("share > 0")
    return told.groupBy("conv_id", "start").agg(F.sum((F.col("share") >= 0.66).cast("int")).alias("words"), F.bool_or((F.col("share") > 0.34) & (F.col("share") < 0.66)).alias("cut"))


@query("SELECT lang, count(*) AS rows, sum((NOT regexp_matches(coalesce(text, ''), '[0-9%$€£]') AND len(list_intersect(" + WORDS + ", ['" + "', '".join(text.CARDINALS) + "'])) = 0)::INT) AS free FROM documents GROUP BY lang")
def number_free_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without any number."""
    free = labels.number_free(F.col("w"), F.coalesce("text", F.lit("")), text.CARDINALS)
    return table(spark, sf_dir, "documents").select("lang", "text", text.words("text").alias("w")).groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum(free.cast("int")).alias("free"))


@query("SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS spans, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with its spans in order."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("s"))
    shown = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_returnflag"])), ",")
    return items.select("l_orderkey", shown.alias("spans"), F.size("s").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def both_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that two baselines miss."""
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return a.intersect(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")))


@query("SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS margin, quantile_cont(l_extendedprice, 0.5) AS middle FROM lineitem GROUP BY l_returnflag")
def margin_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles that margins are set by."""
    return ordering.percentiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"margin": 0.05, "middle": 0.5})


@query(
    """
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_discount > 0.09 THEN 'bad_reading' WHEN l_linestatus <> 'F' OR l_returnflag = 'X' OR l_quantity = 7 THEN 'no_judge' WHEN l_quantity = 9 THEN 'span_mismatch' WHEN l_linenumber = 5 THEN 'span_disagree' WHEN l_tax > 0.07 THEN 'negation'
        WHEN l_quantity / 50 > 0.25 AND l_linenumber >= 2 THEN 'wer' WHEN l_suppkey % 5 = 0 THEN 'lost_word' WHEN l_suppkey % 5 = 1 THEN 'extra_word' ELSE 'kept' END AS reason FROM lineitem) GROUP BY reason
    """
)
def judged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by the reason for which a second transcript rejects them."""
    items = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_linestatus") == "F", "completed").otherwise("failed")
    lost = F.when(F.col("l_suppkey") % 5 == 0, "lost_word").when(F.col("l_suppkey") % 5 == 1, "extra_word")
    reason = labels.judge_reason(F.col("l_discount") > 0.09, status, F.when(F.col("l_quantity") != 7, "x"), F.col("l_quantity") == 9, F.col("l_linenumber") != 5, F.col("l_tax") > 0.07, F.col("l_quantity") / 50, F.col("l_linenumber"), lost)
    return items.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    WITH w AS (SELECT l_orderkey // 8 AS s, l_suppkey % 3 AS k, l_quantity * 2 AS t0, l_quantity * 2 + 1 AS t1 FROM lineitem), r AS (SELECT s, k, min(t0) AS a, max(t1) AS b FROM w GROUP BY ALL HAVING count(*) >= 3), x AS (SELECT s, min(t0) AS a, max(t1) AS b FROM w GROUP BY s)
    SELECT CASE WHEN r.a - x.a <= 2 AND x.b - r.b <= 3 THEN 'both' WHEN r.a - x.a <= 2 THEN 'start' WHEN x.b - r.b <= 3 THEN 'end' ELSE 'middle' END AS place, count(*) AS n FROM r JOIN x USING (s) GROUP BY place
    """
)
def long_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of three words or more by where they sit in their stream."""
    w = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("s"), (F.col("l_suppkey") % 3).alias("k"), (F.col("l_quantity") * 2).alias("t0"), (F.col("l_quantity") * 2 + 1).alias("t1"))
    long = sequences.long_targets(w, ["s"], "k", "t0", "t1")
    ends = w.groupBy("s").agg(F.min("t0").alias("a"), F.max("t1").alias("b"))
    return long.join(ends, "s").groupBy(labels.edge_bucket(F.col("start") - F.col("a"), F.col("b") - F.col("end")).alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    WITH d AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)*')) AS v FROM documents WHERE doc_id % 3 = 0), p AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(url, ''), '[0-9]+')) AS v FROM pages),
    c AS (SELECT doc_id, TRY_CAST(regexp_replace(v, '[^0-9]', '', 'g') AS BIGINT) AS n, len(regexp_replace(v, '[^0-9]', '', 'g')) AS k FROM d), h AS (SELECT DISTINCT CASE WHEN len(v) = 4 AND v::BIGINT BETWEEN 1900 AND 2099 THEN 'year:' WHEN v::BIGINT >= 1000 THEN 'int_big:' ELSE 'int_small:' END || v::BIGINT AS h FROM p),
    x AS (SELECT doc_id, CASE WHEN k = 4 AND n BETWEEN 1900 AND 2099 THEN 'year:' WHEN n >= 1000 THEN 'int_big:' ELSE 'int_small:' END || n AS h FROM c WHERE n IS NOT NULL)
    SELECT doc_id, h AS value, count(*) AS n FROM x WHERE h IN (SELECT h FROM h) GROUP BY ALL
    """
)
def held_back_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made rows that hold a value which was to be held back."""
    held = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all(F.coalesce("url", F.lit("")), F.lit("[0-9]+"), F.lit(0))).alias("v")).select(labels.value_class(F.col("v")).alias("value")).distinct()
    spans = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", F.explode(classes.spans("text")).alias("v")).select("doc_id", labels.value_class(F.col("v")).alias("value"))
    return spans.join(held, "value", "left_semi").groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))
