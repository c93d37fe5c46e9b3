"""Queries over gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes, text
from ..operators import gates
from .registry import query, table
from .texts import SPANS, TEMPLATE

TIERS = {"en": "full", "de": "next", "fr": "moderate", "es": "light"}
#: Classes of the texts' numbers, and of the numbers of tables, which stand for what texts of other kinds hold.
CLASSES = ["year", "year_early", "int_small", "int_big", "int_other", "pct", "cur", "dec", "unit", "date", "ord", "decade", "clock", "phone"]
#: A number of a table counts as said in so many hours.
HOURS = 1 / 3600
#: Of lineitem, orders, events and customer: the key, and an integer by class, in Spark and in SQL.
TABLES = {
    "lineitem": ("l_orderkey", {"pct": "cast(round(l_discount * 100) as bigint)", "cur": "cast(round(l_extendedprice) as bigint)", "dec": "cast(round(l_tax * 100) as bigint)", "unit": "cast(l_quantity as bigint)", "date": "cast(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) as bigint)", "ord": "cast(l_linenumber as bigint)"}),
    "orders": ("o_orderkey", {"decade": "cast(year(o_orderdate) - year(o_orderdate) % 10 as bigint)", "int_big": "cast(round(o_totalprice * 100) as bigint)"}),
    "events": ("event_id", {"clock": "cast(hour(ts) * 100 + minute(ts) as bigint)"}),
    "customer": ("c_custkey", {"phone": "cast(c_custkey + 5550000 as bigint)"}),
}
#: Scales that texts and amounts say by a word: by the value's size.
WORD = "CASE WHEN class = 'int_big' AND value >= 20000000 THEN 'billion' END"


def _sql() -> str:
    def literal(x: object) -> str:
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)

    asked = ", ".join("(" + ", ".join(literal(x) for x in row) + ")" for row in gates.demands(TIERS, CLASSES))
    langs = "[" + ", ".join(f"'{x}'" for x in TIERS) + "]"
    numbers = " UNION ALL ".join(f"SELECT {key} AS key, {langs}[{key} % 4 + 1] AS lang, '{cls}' AS class, {value} AS value FROM {name}" for name, (key, values) in TABLES.items() for cls, value in values.items())
    stats = {"spans": "n", "hours": "h", "distinct": "d", "syn": "syn", "single_share": "single / greatest(d, 1)", "top_share": "top / greatest(n, 1)", "top_5_share": "top5 / greatest(n, 1)", "ext_share": "ext / greatest(n, 1)", "syn_share": "syn / greatest(n, 1)", "least_scale": "least(thousand, million, billion)"}
    scale = "coalesce(word, CASE WHEN value >= 1000000000 THEN 'billion' WHEN value >= 1000000 THEN 'million' ELSE 'thousand' END)"
    return f"""
    WITH q(lang, name, class, stat, low, high, listed, least_n, how, want, given, given_least, spare, spare_most) AS (VALUES {asked}),
    d AS (SELECT *, n_chars / 54000 AS hours, doc_id % 10 = 0 AS syn, doc_id % 6 = 1 AS ext FROM documents), x AS (SELECT doc_id, lang, class, TRY_CAST(regexp_replace(v, '[^0-9]', '', 'g') AS BIGINT) AS value FROM ({SPANS})),
    k AS (SELECT doc_id, count(*) AS spans FROM x GROUP BY doc_id),
    a AS (SELECT lang, class, value, hours / spans AS h, syn, ext, doc_id % 10 AS fold FROM x JOIN k USING (doc_id) JOIN (SELECT doc_id, hours, syn, ext FROM d) USING (doc_id) UNION ALL SELECT lang, class, value, {HOURS}::DOUBLE, key % 10 = 0, key % 6 = 1, key % 10 FROM ({numbers})),
    s AS (SELECT *, {WORD} AS word FROM a WHERE fold <> 2),
    v AS (SELECT lang, class, value, count(*) AS n, sum(h) AS h, sum(syn::INT) AS syn, sum(ext::INT) AS ext, row_number() OVER (PARTITION BY lang, class ORDER BY count(*) DESC, value) AS k FROM s GROUP BY lang, class, value),
    z AS (SELECT lang, class, {", ".join(f"sum((class = 'int_big' AND {scale} = '{k}')::INT) AS {k}" for k in ("thousand", "million", "billion"))} FROM s GROUP BY ALL),
    c AS (SELECT lang, class, sum(n) AS n, sum(h) AS h, count(*) AS d, sum(syn) AS syn, sum(ext) AS ext, sum((n = 1)::INT) AS single, max(n) AS top, sum(CASE WHEN k <= 5 THEN n ELSE 0 END) AS top5 FROM v GROUP BY ALL),
    r AS (SELECT d.*, CASE WHEN doc_id % 40 = 7 THEN 'id:' || doc_id ELSE 'yt:' || source END AS unit, {TEMPLATE} AS t FROM d JOIN k USING (doc_id) WHERE doc_id % 10 NOT IN (0, 2)),
    u AS (SELECT lang, count(*) AS groups, sum(CASE WHEN unit NOT LIKE 'id:%' THEN n ELSE 0 END) / sum(n) AS known, sum((unit NOT LIKE 'id:%' AND n > 13)::INT) AS large FROM (SELECT lang, unit, count(*) AS n FROM r GROUP BY ALL) GROUP BY lang),
    g AS ({" UNION ALL ".join(f"SELECT lang, class, '{stat}' AS stat, ({got})::DOUBLE AS got FROM c JOIN z USING (lang, class)" for stat, got in stats.items())}
        UNION ALL SELECT q.lang, q.class, stat, count(*) FROM v JOIN q ON v.lang = q.lang AND v.class = q.class AND stat LIKE 'values of %' AND n >= least_n AND (low IS NULL OR value BETWEEN low AND high) AND (listed IS NULL OR list_contains(listed, value)) GROUP BY ALL
        UNION ALL SELECT lang, 'rows', 'groups', groups FROM u UNION ALL SELECT lang, 'rows', 'known', known FROM u UNION ALL SELECT lang, 'rows', 'large_groups', large FROM u
        UNION ALL SELECT lang, 'rows', 'over_template', sum(greatest(n - 3, 0)) FROM (SELECT lang, t, count(*) AS n FROM r WHERE len(regexp_extract_all(t, '\\p{{L}}+')) >= 3 GROUP BY ALL) GROUP BY lang
        UNION ALL SELECT lang, 'rows', 'real_hours', sum(hours) FROM r GROUP BY lang UNION ALL SELECT lang, 'rows', 'window_hours', sum(hours) FROM d WHERE doc_id % 10 = 1 GROUP BY lang
        UNION ALL SELECT lang, class, 'held', count(*) FROM a WHERE fold = 2 GROUP BY ALL)
    SELECT lang, "check", round(got, 6) AS got, want, CASE how WHEN '>=' THEN got >= want ELSE got <= want END OR coalesce(spare_got <= spare_most, false) AS ok FROM (
        SELECT q.lang, name AS "check", coalesce(f.got, 0) AS got, want::DOUBLE AS want, how, given, given_least, coalesce(o.got, 0) AS given_got, spare_most, coalesce(p.got, 0) AS spare_got
        FROM q LEFT JOIN g f ON (q.lang, q.class, q.stat) = (f.lang, f.class, f.stat) LEFT JOIN g o ON (q.lang, q.class, q.given) = (o.lang, o.class, o.stat) LEFT JOIN g p ON (q.lang, q.class, q.spare) = (p.lang, p.class, p.stat))
    WHERE given IS NULL OR given_got >= given_least
    """


@query(_sql())
def data_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of four languages, and numbers of four tables, against four tiers of demands, one row a check."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", (F.col("n_chars") / 54000).alias("hours"), (F.col("doc_id") % 10 == 0).alias("synthetic"), (F.col("doc_id") % 6 == 1).alias("external"))
    fold = F.col("doc_id") % 10
    own = docs.select("*", classes.spans("text").alias("v")).where(F.size("v") > 0)
    unit = F.when(F.col("doc_id") % 40 == 7, F.concat(F.lit("id:"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("yt:"), "source"))
    train = own.where(fold != 2).select("lang", unit.alias("unit"), text.template("text").alias("template"), "hours", "synthetic")
    each = own.select("lang", fold.alias("fold"), (F.col("hours") / F.size("v")).alias("hours"), "synthetic", "external", F.explode("v").alias("v"))
    each = each.select("lang", "fold", classes.span_class(F.col("v")).alias("class"), F.regexp_replace("v", "[^0-9]", "").try_cast("bigint").alias("value"), "hours", "synthetic", "external")
    langs = F.array(*map(F.lit, TIERS))
    for name, (key, values) in TABLES.items():
        numbers = F.explode(F.array(*[F.struct(F.lit(cls).alias("class"), F.expr(value).alias("value")) for cls, value in values.items()])).alias("x")
        k = F.col("key")
        rows = table(spark, sf_dir, name).select(F.col(key).alias("key"), numbers)
        each = each.unionByName(rows.select(langs[(k % 4).cast("int")].alias("lang"), (k % 10).alias("fold"), "x.class", "x.value", F.lit(HOURS).alias("hours"), (k % 10 == 0).alias("synthetic"), (k % 6 == 1).alias("external")))
    each = each.withColumn("word", F.expr(WORD))
    got = gates.gate(train, each.where("fold <> 2"), docs.where(fold == 1), each.where("fold = 2"), TIERS, CLASSES)
    return got.select("lang", "check", F.round("got", 6).alias("got"), "want", "ok")
