"""Queries over texts: flags, templates, frames, shapes, reasons, keys, near copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes, text
from ..operators import census, dedupe
from ..operators.common import written
from .registry import query, table

MD5 = "('0x' || substr(md5({}::VARCHAR), 1, 8))::BIGINT"
WORDS = "CASE WHEN trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) = '' THEN []::VARCHAR[] ELSE string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') END"
MASKED = "'" + "', '".join(text.MASKED) + "'"


@query(
    f"""
    WITH f AS (SELECT lang, regexp_matches(text, '[0-9]') AS digit, regexp_matches(text, '[$€£%]') AS symbol, contains(text, '?') AS question, {MD5.format('doc_id')} < 0.02 * 4294967296 AS drawn FROM documents)
    SELECT lang, count(*) AS rows, sum(digit::INT) AS digits, sum(symbol::INT) AS symbols, sum(question::INT) AS questions, sum((digit OR drawn)::INT) AS kept FROM f GROUP BY lang
    """
)
def scan_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a number, and of those without a replayable 2 %."""
    docs = table(spark, sf_dir, "documents").select("lang", F.col("text").rlike("[0-9]").alias("digit"), F.col("text").rlike("[$€£%]").alias("symbol"), F.contains("text", F.lit("?")).alias("question"), (text.stable("doc_id") < 0.02 * (1 << 32)).alias("drawn"))
    n = lambda c: F.sum(c.cast("int"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), n(F.col("digit")).alias("digits"), n(F.col("symbol")).alias("symbols"), n(F.col("question")).alias("questions"), n(F.col("digit") | F.col("drawn")).alias("kept"))


@query(f"SELECT lang, source FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY {MD5.format('source')}, source) AS n FROM (SELECT DISTINCT lang, source FROM documents)) WHERE n <= 5")
def pick_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sources of each language in hash order."""
    from ..operators.select import per_group

    return per_group(table(spark, sf_dir, "documents").select("lang", "source").distinct(), ["lang"], "source", 5)


TEMPLATE = "trim(regexp_replace(lower(coalesce(text, '')), '[0-9]+', '#', 'g'))"


@query(
    f"""
    WITH t AS (SELECT lang, {TEMPLATE} AS t FROM documents), k AS (SELECT lang, t FROM t WHERE len(regexp_extract_all(t, '\\p{{L}}+')) >= 3),
    c AS (SELECT lang, t, count(*) AS n FROM k GROUP BY ALL)
    SELECT lang, sum(n) AS rows, count(*) AS templates, sum((n > 1)::INT) AS repeated, max(n) AS most FROM c GROUP BY lang
    """
)
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit-masked templates of each language and how often they repeat."""
    docs = table(spark, sf_dir, "documents").select("lang", text.template("text").alias("t")).where("t <> ''")
    counts = docs.groupBy("lang", F.xxhash64("t").alias("a"), F.md5("t").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("lang").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("templates"), F.sum((F.col("n") > 1).cast("int")).alias("repeated"), F.max("n").alias("most"))


@query(
    "WITH s AS (SELECT lang, "
    + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}')) AS {k}" for k, p in classes.SHAPES.items())
    + " FROM documents) SELECT lang, "
    + ", ".join(f"sum({k}) AS {k}" for k in classes.SHAPES)
    + ", sum("
    + " + ".join(f"least({k}, 3)" for k in classes.SHAPES)
    + ") AS score FROM s GROUP BY lang"
)
def number_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of numbers by language, and a score in which a text's shape counts three times at most."""
    docs = table(spark, sf_dir, "documents").select("lang", *classes.shape_counts("text"))
    score = sum((F.least(F.col(k), F.lit(3)) for k in classes.SHAPES), F.lit(0))
    return docs.groupBy("lang").agg(*(F.sum(k).alias(k) for k in classes.SHAPES), F.sum(score).alias("score"))


@query(
    """
    WITH r AS (SELECT lang, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN n_chars < 100 THEN 'short' WHEN n_chars > 10000 THEN 'long' WHEN regexp_matches(text, '[0-9]{5,}') THEN 'digits'
        WHEN contains(text, '!!') THEN 'shouted' END AS reason FROM documents)
    SELECT lang, coalesce(reason, 'kept') AS reason, count(*) AS rows FROM r GROUP BY ALL
    """
)
def first_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cascade of filters: each document counts under the first reason that holds."""
    t = F.col("text")
    reason = classes.first_reason(("empty", t.isNull() | (F.trim(t) == "")), ("short", F.col("n_chars") < 100), ("long", F.col("n_chars") > 10000), ("digits", t.rlike("[0-9]{5,}")), ("shouted", F.contains(t, F.lit("!!"))))
    return table(spark, sf_dir, "documents").select("lang", F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("rows"))


CLASS = r"""CASE WHEN regexp_full_match(v, '[0-9]{4}') AND v::INT BETWEEN 1800 AND 2099 THEN 'year' WHEN regexp_full_match(v, '[0-9]{4}') AND v::INT BETWEEN 1100 AND 1799 THEN 'year_early'
    WHEN len(coalesce(nullif(ltrim(regexp_replace(v, '[.,]', '', 'g'), '0'), ''), '0')) <= 3 THEN 'int_small' ELSE 'int_big' END"""
SPANS = "SELECT doc_id, lang, source, n_chars, v, {} AS class FROM (SELECT doc_id, lang, source, n_chars, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)*')) AS v FROM documents)".format(CLASS)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.explode(classes.spans("text")).alias("v"))
    return docs.withColumn("class", classes.span_class(F.col("v")))


@query(f"WITH s AS ({SPANS}) SELECT lang, class, count(*) AS spans, count(DISTINCT v) AS values, count(DISTINCT source) AS sources FROM s GROUP BY ALL")
def span_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in texts by language and class: spans, distinct values, sources."""
    return spans(spark, sf_dir).groupBy("lang", "class").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("v").alias("values"), F.count_distinct("source").alias("sources"))


@query(f"WITH s AS ({SPANS}) SELECT risk, count(*) AS spans FROM (SELECT unnest(list_filter([CASE WHEN regexp_full_match(v, '[0-9]{{7,}}') THEN 'long' END, CASE WHEN regexp_matches(v, '000|111|222|333|444|555|666|777|888|999') THEN 'repeat' END, CASE WHEN regexp_matches(v, '^0[0-9]') THEN 'code' END], lambda x: x IS NOT NULL)) AS risk FROM s) GROUP BY risk")
def span_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with reasons to look twice."""
    return spans(spark, sf_dir).select(F.explode(classes.risk_tags(F.col("v"))).alias("risk")).groupBy("risk").agg(F.count(F.lit(1)).alias("spans"))


FRAME = f"list_transform({WORDS}, lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') OR w IN ({MASKED}) THEN '#' ELSE w END)"


@query(
    f"""
    WITH m AS (SELECT doc_id, lang, {FRAME} AS w FROM documents), f AS (SELECT lang, array_to_string(list_filter(w, lambda x, i: x <> '#' OR i = 1 OR w[i - 1] <> '#'), ' ') AS frame FROM m),
    c AS (SELECT lang, frame, count(*) AS n FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC) AS k FROM c)
    SELECT lang, sum(n) AS rows, count(*) / sum(n) AS patterns_per_row, sum(CASE WHEN k <= 50 THEN n ELSE 0 END) / sum(n) AS top_50 FROM r GROUP BY lang
    """
)
def frame_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number-masked frames: how many a row, and the share of the fifty commonest."""
    tokens = table(spark, sf_dir, "documents").select("lang", text.words("text").alias("w"))
    frames = tokens.select("lang", F.sha2(F.array_join(text.frame("w"), " "), 256).alias("frame"))
    got = census.top_shares(frames, ["lang"], "frame", (50,))
    return got.select("lang", "rows", (F.col("distinct") / F.col("rows")).alias("patterns_per_row"), "top_50")


@query(
    "WITH w AS (SELECT conv_id, role, " + WORDS + " AS w FROM conversations) "
    + "SELECT a.role, d1 AS distinct_1, d2 AS distinct_2, d3 AS distinct_3 FROM "
    + " JOIN ".join(
        f"(SELECT role, count(DISTINCT g) / count(*) AS d{k} FROM (SELECT role, unnest(list_transform(range(1, greatest(len(w) - {k - 2}, 1)), lambda i: array_to_string(w[i:i+{k - 1}], ' '))) AS g FROM w) GROUP BY role) {n}"
        + ("" if n == "a" else f" ON a.role = {n}.role")
        for n, k in zip("abc", (1, 2, 3), strict=True)
    )
)
def gram_variety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of distinct words, pairs and triples by role."""
    tokens = table(spark, sf_dir, "conversations").select("role", text.words("text").alias("w"))
    return census.distinct_grams(tokens, ["role"], "w")


@query(
    f"""
    WITH w AS (SELECT lang, {WORDS} AS w FROM documents), o AS (SELECT lang, array_to_string(w[1:3], ' ') AS opening FROM w WHERE len(w) >= 3),
    c AS (SELECT lang, opening, count(*) AS n FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, opening) AS k, sum(n) OVER (PARTITION BY lang) AS total FROM c)
    SELECT lang, opening, n, n / total AS share FROM r WHERE k = 1
    """
)
def top_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest first three words of each language and their share."""
    tokens = table(spark, sf_dir, "documents").select("lang", text.words("text").alias("w")).where(F.size("w") >= 3)
    counts = tokens.select("lang", F.array_join(F.slice("w", 1, 3), " ").alias("opening")).groupBy("lang", "opening").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "opening")).alias("b"))
    return best.select("lang", F.col("b.opening").alias("opening"), (-F.col("b.m")).alias("n"), (-F.col("b.m") / F.col("total")).alias("share"))


@query(
    f"""
    WITH k AS (SELECT doc_id, lang, n_chars, array_to_string({WORDS}, ' ') AS key, len({WORDS}) AS words FROM documents),
    r AS (SELECT *, CASE WHEN len(key) >= 20 AND words >= 4 THEN row_number() OVER (PARTITION BY key ORDER BY n_chars DESC, doc_id) ELSE 1 END AS n FROM k)
    SELECT doc_id, lang FROM r WHERE n = 1
    """
)
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of those with the same words, the longest; texts too short to tell all stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", text.words("text").alias("w"))
    keyed = docs.select("doc_id", "lang", "n_chars", F.sha2(text.text_key("w"), 256).alias("key"))
    return dedupe.best_copy(keyed, F.col("key"), [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "lang")


def shingled(spark: SparkSession, sf_dir: str, name: str, id_: str) -> DataFrame:
    """(id, n, sh): the hashed three-word shingles of each row that has any, and their number."""
    tokens = table(spark, sf_dir, name).select(F.col(id_).alias("id"), text.words("text").alias("w"))
    sets = written(tokens.select("id", F.array_distinct(F.transform(text.grams("w", 3), lambda s: F.xxhash64(s))).alias("shingles")))
    return sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("sh"))


SETS = "SELECT DISTINCT {0} AS id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS sh FROM (SELECT {0}, " + WORDS + " AS w FROM {1}) WHERE len(w) >= 3"


CLASSES = f"c AS (SELECT id, min(id) OVER (PARTITION BY l) AS first FROM (SELECT id, list_sort(list(sh)) AS l FROM ({SETS.format('doc_id', 'documents')}) GROUP BY id))"


def shingled_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tokens = table(spark, sf_dir, "documents").select("doc_id", text.words("text").alias("w"))
    return dedupe.set_classes(tokens, "doc_id", text.grams("w", 3))


@query(f"WITH {CLASSES} SELECT id AS doc_id, first FROM c")
def copy_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with three words or more, and the first one with the same set of three-word shingles."""
    return shingled_classes(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


@query(
    f"""
    WITH {CLASSES}, s AS (SELECT * FROM ({SETS.format('doc_id', 'documents')}) WHERE id IN (SELECT first FROM c)), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
    p AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY ALL)
    SELECT a, b, common, round(common / (x.n + y.n - common), 9) AS similarity FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 5 * common >= 4 * (x.n + y.n - common)
    """
)
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose sets of three-word shingles are 0.8 alike or more, among the first of each class of equal sets (copy_classes)."""
    _, firsts = shingled_classes(spark, sf_dir)
    return dedupe.similar_sets(firsts, (4, 5)).withColumn("similarity", F.round("similarity", 9))


@query(
    f"""
    WITH RECURSIVE m AS (SELECT doc_id, {FRAME} AS w FROM documents), f AS (SELECT doc_id, list_filter(w, lambda x, i: x <> '#' OR i = 1 OR w[i - 1] <> '#') AS f FROM m),
    t AS (SELECT DISTINCT doc_id, unnest(list_append(CASE WHEN len(f) < 3 THEN [array_to_string(f, ' ')] WHEN len(f) <= 7 THEN list_transform(range(1, len(f) - 1), lambda i: array_to_string(f[i:i+2], ' ')) ELSE list_transform(range(1, len(f) - 2), lambda i: array_to_string(f[i:i+3], ' ')) END, '= ' || array_to_string(f, ' '))) AS t FROM f), s AS (SELECT doc_id, hash(t) AS sh FROM t),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
    p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 3 * (x.n + y.n - c)), o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM n), q AS (SELECT rn, list(a) FILTER (a IS NOT NULL) AS before FROM o LEFT JOIN p ON b = doc_id GROUP BY rn),
    g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT i + 1, CASE WHEN before IS NOT NULL AND list_has_any(kept, before) THEN kept ELSE list_append(kept, doc_id) END FROM g JOIN q ON q.rn = i + 1 JOIN o ON o.rn = i + 1)
    SELECT unnest(kept) AS doc_id FROM g WHERE i = (SELECT max(i) FROM g)
    """
)
def greedy_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that stay when each drops later ones that are 0.6 like it by the shingles of their number-masked frames.

    Of equal sets the first alone can stay: what drops it drops the others, and if it stays it drops them.
    """
    tokens = table(spark, sf_dir, "documents").select("doc_id", text.words("text").alias("w")).select("doc_id", text.frame("w").alias("f"))
    _, firsts = dedupe.set_classes(tokens, "doc_id", text.frame_shingles("f"), in_waves=True)
    return dedupe.greedy_similar(firsts, (3, 5)).select(F.col("id").alias("doc_id"))


@query(
    f"""
    WITH q AS ({SETS.format('doc_id', 'documents')}), i AS ({SETS.format('item_id', 'benchmark')}), qn AS (SELECT id, count(*) AS n FROM q GROUP BY id), n AS (SELECT id, count(*) AS n FROM i GROUP BY id),
    c AS (SELECT q.id, i.id AS other, count(*) AS common FROM q JOIN i USING (sh) GROUP BY ALL),
    b AS (SELECT c.id, max(common / (qn.n + n.n - common)) AS best FROM c JOIN qn ON qn.id = c.id JOIN n ON n.id = other GROUP BY c.id)
    SELECT floor(coalesce(best, 0) * 10)::INT AS tenth, count(*) AS docs FROM qn LEFT JOIN b USING (id) GROUP BY tenth
    """
)
def benchmark_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near documents come to the benchmark's items, by tenths."""
    docs, bench = shingled(spark, sf_dir, "documents", "doc_id"), shingled(spark, sf_dir, "benchmark", "item_id")
    best = dedupe.greatest_similarity(docs, bench)
    return best.groupBy(F.floor(F.col("similarity") * 10).cast("int").alias("tenth")).agg(F.count(F.lit(1)).alias("docs"))


@query(
    """
    WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]{5,}')) AS digits FROM documents), p AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(url, ''), '[0-9]{5,}')) AS digits FROM pages
        UNION SELECT DISTINCT unnest(regexp_extract_all(coalesce(html, ''), '[0-9]{5,}')) FROM pages)
    SELECT doc_id, count(*) AS digits FROM d WHERE digits IN (SELECT digits FROM p) GROUP BY doc_id
    """
)
def leaked_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with digit strings of five or more that pages have too."""
    runs = lambda c: F.filter(text.digit_runs(c), lambda x: F.length(x) >= 5)
    pages = table(spark, sf_dir, "pages")
    known = pages.select(F.explode(F.concat(runs("url"), runs("html"))).alias("digits")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(runs("text"))).alias("digits"))
    return docs.join(known, "digits", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("digits"))


@query(
    """
    WITH s AS (SELECT supplier.s_suppkey, s_name, lower(s_name) AS a FROM supplier), c AS (SELECT c_custkey, lower(c_name) AS b FROM customer)
    SELECT c_custkey, levenshtein(b, a) AS edits, round(levenshtein(b, a) / greatest(1, len(b)), 9) AS cer FROM c JOIN s ON s_suppkey = c_custkey
    """
)
def name_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits, and edits a character, between names under one number."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.lower("s_name").alias("a"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("b"))
    return c.join(s, F.col("c_custkey") == F.col("s_suppkey")).select("c_custkey", F.levenshtein("b", "a").alias("edits"), F.round(text.character_error_rate("b", "a"), 9).alias("cer"))


@query()
def turn_word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word edits between each turn and the next of its conversation, over the words of the first: an error rate by role."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.words("text").alias("w"))
    pairs = turns.withColumn("next", F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    sums = pairs.groupBy("role").agg(F.sum(text.word_distance("w", "next")).alias("edits"), F.sum(F.size("w")).alias("words"))
    return sums.withColumn("wer", F.round(100 * F.col("edits") / F.col("words"), 2))
