"""Queries that read and write numbers, and plan rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classes, languages, numbers, text
from ..operators import generate
from .registry import query, table
from .texts import MD5


ONES = "['" + "', '".join(numbers.UNITS) + "']"
TENS = "['" + "', '".join(numbers.TENS) + "']"


def spelled(n: str, between: str = " ") -> str:
    """SQL that spells a whole number under 1,000,000,000."""
    small = "CASE WHEN {0} % 100 < 20 THEN " + ONES + "[{0} % 100 + 1] WHEN {0} % 10 = 0 THEN " + TENS + "[{0} % 100 // 10 - 1] ELSE " + TENS + "[{0} % 100 // 10 - 1] || ' ' || " + ONES + "[{0} % 10 + 1] END"
    under = "CASE WHEN {0} < 100 THEN " + small + " WHEN {0} % 100 = 0 THEN " + ONES + "[{0} // 100 + 1] || ' hundred' ELSE " + ONES + "[{0} // 100 + 1] || ' hundred" + between + "' || " + small + " END"
    parts = [f"CASE WHEN {part} > 0 THEN {under.format(part)} || '{name}' END" for part, name in ((f"({n} // 1000000)", " million"), (f"({n} // 1000 % 1000)", " thousand"), (f"({n} % 1000)", ""))]
    return f"CASE WHEN {n} = 0 THEN 'zero' ELSE concat_ws(' ', {', '.join(parts)}) END"


@query(f"SELECT o_orderkey, 'order ' || {spelled('o_orderkey')} || ' costs ' || {spelled('round(o_totalprice)::BIGINT', ' and ')} AS said, o_orderkey::DOUBLE AS value, round(o_totalprice)::BIGINT::DOUBLE AS price FROM orders")
def spelled_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers, put into words and read again."""
    said = F.concat_ws(" ", F.lit("order"), numbers.cardinal(F.col("o_orderkey")), F.lit("costs"), numbers.cardinal(F.round("o_totalprice").cast("long"), True))
    got = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said")).withColumn("n", numbers.read(F.split("said", " ")))
    return got.select("o_orderkey", "said", F.get("n", F.lit(0))["value"].cast("double").alias("value"), F.get("n", F.lit(1))["value"].cast("double").alias("price"))


@query(f"SELECT y AS year, CASE WHEN y BETWEEN 2000 AND 2009 THEN {spelled('y')} WHEN y % 100 = 0 THEN {spelled('(y // 100)')} || ' hundred' WHEN y % 100 < 10 THEN {spelled('(y // 100)')} || ' oh ' || {spelled('(y % 100)')} ELSE {spelled('(y // 100)')} || ' ' || {spelled('(y % 100)')} END AS said, CASE WHEN y BETWEEN 2000 AND 2009 OR y % 100 >= 10 OR y % 100 = 0 THEN y END::DOUBLE AS value, n FROM (SELECT 1910 + (year(o_orderdate) * 7 + o_orderkey) % 190 AS y, count(*) AS n FROM orders GROUP BY y)")
def spoken_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of orders, moved over two centuries by their keys, as they are said, and what is read of that; one said with an `oh` has no reading."""
    year, plain = F.col("year"), F.col("year").between(2000, 2009)
    words = numbers.candidates(year.cast("string"))
    said = F.when(plain, numbers.cardinal(year)).otherwise(F.element_at(words, 3))
    moved = 1910 + (F.year("o_orderdate") * 7 + F.col("o_orderkey")) % 190
    years = table(spark, sf_dir, "orders").groupBy(moved.cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    got = years.withColumnRenamed("n", "orders").withColumn("said", said).withColumn("n", numbers.read(F.split("said", " ")))
    return got.select("year", "said", F.when(F.size("n") == 1, F.get("n", F.lit(0))["value"].cast("double")).alias("value"), F.col("orders").alias("n"))


@query()
def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in texts by form."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^a-z0-9.,]+|[.,](?![0-9])", " ")), " +")
    got = table(spark, sf_dir, "documents").select("lang", tokens.alias("w")).select("lang", F.explode(numbers.read(F.col("w"))).alias("n"))
    return got.groupBy("lang", F.col("n.form").alias("form")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)*')) AS v FROM documents),
    g AS (SELECT v, CASE WHEN regexp_full_match(v, '[0-9]{1,3}([.,][0-9]{3})+|[0-9]+') THEN TRY_CAST(regexp_replace(v, '[.,]', '', 'g') AS DECIMAL(38, 9)) END AS whole, CASE WHEN regexp_full_match(v, '[0-9]+[.,][0-9]+') THEN TRY_CAST(replace(v, ',', '.') AS DECIMAL(38, 9)) END AS point FROM s)
    SELECT v, (whole IS NOT NULL)::INT + (point IS NOT NULL)::INT AS n, whole::DOUBLE AS whole, point::DOUBLE AS point FROM g
    """
)
def token_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that the tokens of digits in texts have; those that decimal(38, 9) doesn't hold have none."""
    tokens = table(spark, sf_dir, "documents").select(F.explode(classes.spans("text")).alias("v")).distinct()
    values = tokens.withColumn("x", numbers.digit_values(F.col("v")))
    pointed = F.col("v").rlike("^[0-9]+[.,][0-9]+$")
    whole, point = F.when(~pointed | (F.size("x") == 2), F.get("x", F.lit(0))), F.when(pointed, F.element_at("x", F.greatest(F.size("x"), F.lit(1))))
    return values.select("v", F.size("x").alias("n"), whole.cast("double").alias("whole"), point.cast("double").alias("point"))


@query()
def reading_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways to say the numbers of texts, one a row."""
    tokens = table(spark, sf_dir, "documents").select(F.explode(classes.spans("text")).alias("v")).distinct()
    return tokens.select("v", F.posexplode(numbers.candidates(F.col("v"))).alias("ord", "reading"))


def turn_pairs(spark: SparkSession, sf_dir: str, value: Column) -> DataFrame:
    """(conv_id, turn, a, b): a value of each turn, and of the next of its conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", value.alias("a"))
    return turns.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn", "text"))).where("b is not null").drop("text")


@query()
def turn_number_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the numbers of each turn of a conversation fare in the next."""
    both = turn_pairs(spark, sf_dir, F.transform(numbers.read(text.words("text")), lambda n: n["value"].cast("double")))
    o = both.select(numbers.outcomes("a", "b").alias("o"))
    return o.agg(*(F.sum(f"o.{k}").alias(k) for k in ("kept", "changed", "lost", "invented")))


@query("SELECT p_size, ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][p_size // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][p_size % 10 + 1] AS roman, p_size AS value FROM (SELECT DISTINCT p_size FROM part)")
def roman_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as Roman numbers, and what is read of these."""
    n = F.col("p_size")
    parts = []
    for scale, one, five, ten in ((10, "X", "L", "C"), (1, "I", "V", "X")):
        d = (F.floor(n / scale) % 10).cast("int")
        parts.append(F.when(d == 9, one + ten).when(d >= 5, F.concat(F.lit(five), F.repeat(F.lit(one), d - 5))).when(d == 4, one + five).otherwise(F.repeat(F.lit(one), d)))
    return table(spark, sf_dir, "part").select("p_size").distinct().withColumn("roman", F.concat(*parts)).withColumn("value", numbers.roman_value(F.col("roman")))


CARRIERS = "SELECT 'item ' || item_id || ' {}' AS carrier FROM benchmark"


@query(f"SELECT carrier, n FROM (SELECT carrier, n, row_number() OVER (PARTITION BY carrier ORDER BY {MD5.format(chr(40) + 'carrier || ' + chr(39) + '|' + chr(39) + ' || n' + chr(41))}, n) AS k FROM ({CARRIERS}), unnest(range(1, 51)) t(n)) WHERE k <= 5")
def filled_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five numbers for each carrier."""
    carriers = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item "), F.col("item_id").cast("string"), F.lit(" {}")).alias("carrier"))
    return generate.filled(carriers, "carrier", 1, 50, 5).select("carrier", "n")


@query("SELECT * FROM (SELECT p_brand, p_size AS a, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS b FROM (SELECT DISTINCT p_brand, p_size FROM part)) WHERE b IS NOT NULL")
def minimal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one brand that differ in the size alone, by one step."""
    return generate.pairs(table(spark, sf_dir, "part").select("p_brand", "p_size").distinct(), "p_brand", "p_size")


@query(f"SELECT lang, bin, count(*) AS docs FROM (SELECT lang, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY {MD5.format('doc_id')}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 20000 AS bin FROM documents) GROUP BY ALL")
def binned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a language in files of about 20,000 characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return generate.binned(docs, F.col("n_chars"), "doc_id", ["lang"], 20_000).groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("docs"))


@query(
    f"""
    WITH t AS (SELECT DISTINCT hour(ts) AS h, minute(ts) AS m FROM events), w AS (SELECT h, m, {spelled('h')} AS hh, {spelled('m')} AS mm, {spelled('((h + 11) % 12 + 1)')} AS here, {spelled('(h % 12 + 1)')} AS next FROM t)
    SELECT h, m, concat_ws(' / ', CASE WHEN m = 0 THEN hh || ' o' || chr(39) || 'clock' WHEN m < 10 THEN hh || ' oh ' || mm ELSE hh || ' ' || mm END, CASE m WHEN 15 THEN 'quarter past ' || here WHEN 30 THEN 'half past ' || here WHEN 45 THEN 'quarter to ' || next END) AS ways FROM w
    """
)
def clock_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways to say the times of events."""
    times = table(spark, sf_dir, "events").select(F.hour("ts").alias("h"), F.minute("ts").alias("m")).distinct()
    return times.select("h", "m", F.array_join(numbers.clock_readings(F.format_string("%d:%02d", "h", "m")), " / ").alias("ways"))


CENTS = "round(o_totalprice * 100)::BIGINT"


@query(
    f"""
    WITH c AS (SELECT o_orderkey, {CENTS} // 100 AS d, {CENTS} % 100 AS c FROM orders)
    SELECT o_orderkey, {spelled('d')} || ' dollar' || CASE WHEN d = 1 THEN '' ELSE 's' END || CASE WHEN c = 0 THEN '' ELSE ' and ' || {spelled('c')} || CASE WHEN c = 1 THEN ' cent' ELSE ' cents' END END AS said, d::DOUBLE AS whole FROM c
    """
)
def spoken_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in words, and the whole part as it is read of these."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    said = numbers.money_reading(F.format_string("$%d.%02d", F.floor(cents / 100), cents % 100))
    got = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))
    return got.withColumn("whole", F.get(numbers.read(F.split("said", " ")), F.lit(0))["value"].cast("double"))


@query()
def turn_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each turn of a conversation that the next lacks, and their edits."""
    from ..functions import align

    both = turn_pairs(spark, sf_dir, text.words("text")).withColumn("p", align.align("a", "b"))
    return both.select("conv_id", "turn", align.edits(F.col("p"), F.col("a"), F.col("b")).alias("edits"), F.size(align.lost_words(F.col("p"), F.col("a"))).alias("lost"), F.size(align.added_words(F.col("p"), F.col("b"))).alias("added"))


SPACED = "('" + "', '".join(lang for lang, (group, _) in languages.MARKS.items() if group == " ") + "')"
PATTERNS = " ".join(f"WHEN '{lang}' THEN '[0-9]+|[0-9]{{1,3}}([{group}][0-9]{{3}})+([{point}][0-9]+)?|[0-9]+[{point}][0-9]+'" for lang, (group, point) in languages.MARKS.items())
POINTS = " ".join(f"WHEN '{lang}' THEN '{point}'" for lang, (_, point) in languages.MARKS.items())


@query(
    f"""
    WITH d AS (SELECT lang, regexp_replace(regexp_replace(lower(coalesce(text, '')), '\\.([0-9])', chr(1) || '\\1', 'g'), ',([0-9])', chr(2) || '\\1', 'g') AS t FROM documents),
    w AS (SELECT lang, replace(unnest(regexp_extract_all(CASE WHEN lang IN {SPACED} THEN replace(s, ' ', '  ') || '  ' ELSE s END, CASE WHEN lang IN {SPACED} THEN '[0-9]{{1,3}}(?:  [0-9]{{3}})+(?:,[0-9]+)? |[^ ]+' ELSE '[^ ]+' END)), ' ', '') AS w FROM (SELECT lang, trim(translate(regexp_replace(translate(strip_accents(replace(t, 'ß', 'ss')), '.,', '  '), '[^a-z0-9' || chr(1) || chr(2) || ']+', ' ', 'g'), chr(1) || chr(2), '.,')) AS s FROM d)),
    n AS (SELECT lang, TRY_CAST(replace(replace(w, CASE WHEN CASE lang {POINTS} END = ',' THEN '.' ELSE ',' END, ''), ',', '.') AS DECIMAL(38, 9)) AS v FROM w WHERE regexp_full_match(w, CASE lang {PATTERNS} END))
    SELECT lang, count(*) AS n, round(log10(sum(v::DOUBLE)), 6) AS size FROM n WHERE v IS NOT NULL GROUP BY lang
    """
)
def language_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in digits with the marks of a text's own language: how many, and how large together."""
    tokens = F.split(F.trim(F.regexp_replace(text.unaccented("text"), r"[^a-z0-9.,]+|[.,](?![0-9])", " ")), " +")
    got = table(spark, sf_dir, "documents").select("lang", F.explode(languages.read_in(tokens, "lang")).alias("n")).where("n.form = 'digits'")
    return got.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.log10(F.sum(F.col("n.value").cast("double"))), 6).alias("size"))


def spelled_in(lang: str, n: str) -> str:
    """SQL that spells a whole number under 1,000,000,000 in a language."""
    names = "['" + "', '".join(languages.under_thousand(lang, k)[0] for k in range(1000)) + "']"
    one, many, million, millions, between = languages.SPELLED[lang]
    part = lambda k: f"({n} // {1000**k} % 1000)"
    words = lambda k, a, b: f"CASE WHEN {part(k)} = 1 THEN '{a}' WHEN {part(k)} > 1 THEN {names}[{part(k)} + 1] || ' {b}' END"
    return f"concat_ws('{between}', {words(2, million, millions)}, {words(1, one, many)}, CASE WHEN {n} = 0 OR {part(0)} > 0 THEN {names}[{part(0)} + 1] END)"


LANGS = list(languages.SPELLED)


@query(f"WITH o AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT + o_orderkey % 5 * 100000000 AS n, {LANGS}[o_orderkey % {len(LANGS)} + 1] AS lang FROM orders) SELECT o_orderkey, lang, CASE lang {' '.join(f"WHEN '{x}' THEN {spelled_in(x, 'n')}" for x in LANGS)} END AS said, CASE WHEN n <> 1 THEN n END::DOUBLE AS value FROM o")
def spelled_in_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of orders in the words of seven languages, and what is read of these."""
    n = (F.round(F.col("o_totalprice") * 100).cast("long") + F.col("o_orderkey") % 5 * 100_000_000).alias("n")
    lang = F.get(F.array(*map(F.lit, LANGS)), (F.col("o_orderkey") % len(LANGS)).cast("int")).alias("lang")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", n, lang)
    said = F.coalesce(*[F.when(F.col("lang") == x, languages.cardinal(F.col("n"), x)) for x in LANGS])
    got = orders.withColumn("said", said).withColumn("read", languages.read_in(F.split("said", " "), F.col("lang")))
    return got.select("o_orderkey", "lang", "said", F.when(F.size("read") == 1, F.get("read", F.lit(0))["value"].cast("double")).alias("value"))
