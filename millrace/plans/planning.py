"""Queries over planned selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes
from ..operators import planning
from .registry import query, table
from .texts import MD5, SPANS

LIMITS = {"int_small": 60, "year": 40, "int_big": 40, "year_early": 20}
SHARE, MOST = 0.05, 4
COUNTED = f"SELECT class, TRY_CAST(regexp_replace(v, '[^0-9]', '', 'g') AS BIGINT) AS value, count(*) AS have FROM ({SPANS}) GROUP BY ALL"
ROOM = "CASE class " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in LIMITS.items()) + " ELSE 0 END"


@query(
    f"""
    WITH RECURSIVE v AS (SELECT *, (1 + value % 10)::DOUBLE AS weight FROM ({COUNTED}) WHERE value IS NOT NULL), t AS (SELECT class, sum(have)::BIGINT AS total FROM v GROUP BY class),
    g AS (SELECT class, total, 0 AS i, []::BIGINT[] AS took, []::BIGINT[] AS out FROM t WHERE {ROOM} > 0
        UNION ALL SELECT class, total, i + 1, CASE WHEN fits THEN list_append(took, v) ELSE took END, CASE WHEN fits THEN out ELSE list_append(out, v) END FROM (
            SELECT class, total, i, took, out, -m.v AS v, m.c + 1 <= {SHARE}::DOUBLE * (total + len(took) + 1) AND m.c - m.have < {MOST} AS fits FROM (
                SELECT g.class, any_value(total) AS total, any_value(i) AS i, any_value(took) AS took, any_value(out) AS out,
                    max({{'gain': weight * (1 / (1 + (have + len(list_filter(took, lambda x: x = value)))::DOUBLE) - 1 / (2 + (have + len(list_filter(took, lambda x: x = value)))::DOUBLE)), 'v': -value, 'c': have + len(list_filter(took, lambda x: x = value)), 'have': have}}) AS m
                FROM g JOIN v ON g.class = v.class WHERE len(took) < CASE g.class {ROOM.removeprefix('CASE class ')} AND NOT list_contains(out, value) GROUP BY g.class)))
    SELECT class, value, count(*) AS new FROM (SELECT class, unnest(took) AS value FROM (SELECT class, max_by(took, i) AS took FROM g GROUP BY class)) GROUP BY ALL
    """
)
def allocated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of texts that are said too rarely, and how many texts more each gets."""
    spans = table(spark, sf_dir, "documents").select(F.explode(classes.spans("text")).alias("v"))
    value = F.regexp_replace("v", "[^0-9]", "").try_cast("bigint")
    values = spans.select(classes.span_class(F.col("v")).alias("class"), value.alias("value")).where("value is not null").groupBy("class", "value").agg(F.count(F.lit(1)).alias("have"))
    totals = {r["class"]: r.n for r in values.groupBy("class").agg(F.sum("have").alias("n")).collect()}
    limits = {c: n for c, n in LIMITS.items() if c in totals}
    return planning.allocated(values.withColumn("weight", (1 + F.col("value") % 10).cast("double")), limits, totals, SHARE, MOST)


SHARES = {"en": 0.3, "de": 0.2, "fr": 0.2, "es": 0.15, "year": 0.25}
N, CAPS = 120, {"video": 8, "template": 3, "text": 1, "year": 3}
YEARS = r"\b(?:1[89]|20)[0-9]{2}\b"


@query(
    f"""
    WITH RECURSIVE d AS (SELECT doc_id AS id, {MD5.format('doc_id')} AS h, source AS video, (n_chars % 40)::VARCHAR AS template, trim(lower(coalesce(text, ''))) AS text, list_transform(list_distinct(regexp_extract_all(coalesce(text, ''), '{YEARS}')), lambda x: x::BIGINT) AS years, lang, n_chars // 300 AS value FROM documents),
    r AS (SELECT *, CASE WHEN len(years) > 0 THEN 'year' ELSE lang END AS class FROM d),
    y AS (SELECT id, 0 AS phase, row_number() OVER (PARTITION BY list_min(years), list_max(years) >= 2025 ORDER BY h, id) - 1 AS a, (list_max(years) < 2025)::INT AS b, list_min(years) AS c FROM r WHERE class = 'year'),
    f AS (SELECT *, row_number() OVER (PARTITION BY class, value ORDER BY h, id) > 1 AS fresh FROM r WHERE class <> 'year'),
    o AS (SELECT id, 1 AS phase, row_number() OVER (PARTITION BY class ORDER BY fresh, h, id) - 1 AS a, list_position({list(SHARES)}, class) - 1 AS b, 0 AS c FROM f),
    q AS (SELECT r.*, row_number() OVER (ORDER BY phase, a, b, c, h, id) AS rn, list_concat(['video:' || video, 'template:' || template, 'text:' || text, 'class ' || class || ':all', 'any:all'], list_transform(years, lambda x: 'year:' || x)) AS groups FROM r JOIN (SELECT * FROM y UNION ALL SELECT * FROM o) USING (id)),
    g AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used, []::BIGINT[] AS took
        UNION ALL SELECT i + 1, CASE WHEN fits THEN list_concat(used, groups) ELSE used END, CASE WHEN fits THEN list_append(took, id) ELSE took END FROM (SELECT i, used, took, id, groups,
            len(list_filter(groups, lambda x: len(list_filter(used, lambda z: z = x)) >= CASE {" ".join(f"WHEN starts_with(x, '{k}:') THEN {n}" for k, n in CAPS.items())} {" ".join(f"WHEN x = 'class {c}:all' THEN {int(s * N)}" for c, s in SHARES.items())} ELSE {N} END)) = 0 AS fits FROM g JOIN q ON rn = i + 1))
    SELECT id, class, rn - 1 AS turn FROM q WHERE id IN (SELECT unnest(took) FROM g WHERE i = (SELECT max(i) FROM g))
    """
)
def varied_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 documents by variety: years first, then languages in turn, with capacities of sources, shapes, texts and years."""
    years = F.transform(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(YEARS), F.lit(0))), lambda x: x.cast("long"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("video"), (F.col("n_chars") % 40).cast("string").alias("template"), "text", years.alias("years"), "lang", F.array(F.floor(F.col("n_chars") / 300).cast("string")).alias("values"))
    rows = docs.withColumn("class", F.when(F.size("years") > 0, "year").otherwise(F.col("lang")))
    got = planning.varied(rows, N, SHARES, CAPS["video"], CAPS["template"], CAPS["year"])
    return got.join(rows.select("id", "class"), "id").select("id", "class", "turn")
