"""Benchmark decontamination: windows as long as a benchmark item, found by SimHash fingerprints and told by their shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, shuffled, sized, written

#: Words of a shingle, and the least similarity of a window to an item, as a fraction.
SHINGLE, LEAST = 5, (4, 5)
#: Fingerprints with so many differing bits or fewer are candidates. At a similarity of 0.8 about 10 of 64 bits differ, with a deviation of 3.
RADIUS = 24
#: Rows of a table of item shingles or of blocks of items that is broadcast, at most; beyond them the join is a shuffle.
BROADCAST_ROWS = 500_000
#: Words that are hashed at a time, so that a long text is several rows.
PART = 4096
#: A counter of a fingerprint's bit has 32 bits of a long.
LANES = 0x0000000100000001


def words(text: str = "text") -> Column:
    """Runs of letters, marks and digits, in lower case."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def shingled(texts: DataFrame, *ids: str) -> DataFrame:
    """(ids, len words, pos, sh): a hash of each shingle with its place; texts under SHINGLE words have none."""
    hashed = texts.select(*ids, F.transform(words(), lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") >= SHINGLE)
    # Parts overlap by SHINGLE - 1 words; a long text is dealt out by them.
    starts = F.sequence(F.lit(0), F.size("w") - SHINGLE, F.lit(PART))
    parts = hashed.select(*ids, F.size("w").alias("len"), F.explode(F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice(F.col("w"), s + 1, PART + SHINGLE - 1).alias("w")))).alias("part"))
    each = F.sequence(F.lit(1), F.size("part.w") - (SHINGLE - 1))
    hashes = F.transform(each, lambda i: F.xxhash64(*(F.element_at("part.w", i + k) for k in range(SHINGLE))))
    return parts.select(*ids, "len", F.col("part.at").alias("at"), F.posexplode(hashes).alias("nth", "sh")).select(*ids, "len", (F.col("at") + F.col("nth")).alias("pos"), "sh")


def fingerprint(hashes: DataFrame, *ids: str) -> DataFrame:
    """(ids, n, fp): a bit of fp is 1 if over half of a group's hashes have it; repeats count. Bits are counted two to a long."""
    sums = [F.sum(F.shiftrightunsigned("sh", b).bitwiseAND(F.lit(LANES))).alias(f"s{b}") for b in range(32)]
    counted = hashes.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"), *sums)
    # Over an array: as one chain of 64 terms the driver would write code of a size that grows with the square of these.
    over = lambda count, at: f"shiftleft(cast(2 * ({count}) > n as bigint), {at})"
    each = f"{over('s & 4294967295', 'b')} | {over('shiftrightunsigned(s, 32)', 'b + 32')}"
    fp = F.expr(f"aggregate(transform(array({', '.join(f's{b}' for b in range(32))}), (s, b) -> {each}), 0L, (x, y) -> x | y)")
    return counted.select(*ids, "n", fp.alias("fp"))


def blocks(fp: str = "fp") -> Column:
    """RADIUS + 1 blocks of a fingerprint with their numbers: of two within the radius, at least one is equal."""
    n = RADIUS + 1
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).bitwiseOR(F.lit(i << 32)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc, doc_id, item_id, similarity) of each window of a document that is like an item; doc is a hash of the row's doc_id and text."""
    item = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().withColumn("item", F.xxhash64("item_id", "text"))
    item_shingles = written(shingled(item, "item", "item_id"))
    items = written(item_shingles.groupBy("item", "sh").agg(F.count(F.lit(1)).alias("weight"), F.first("len").alias("m")))
    bounded = items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = F.broadcast if bounded else shuffled

    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("doc", F.xxhash64("doc_id", "text"))
    hits = written(shingled(doc, "doc", "doc_id").join(met(items.select("sh").distinct()), "sh", "left_semi").distinct())

    # Windows that begin at one of the item's shingles and have enough of them; the need-th from there on tells. The last full window may begin elsewhere.
    both = F.least("len", "m") + F.col("m") - 2 * (SHINGLE - 1)
    need = F.ceil(both * LEAST[0] / (LEAST[0] + LEAST[1]) - 1e-9).cast("int").alias("need")
    placed = hits.join(met(items.select("item", "sh", "m")), "sh").select("doc", "doc_id", "item", "m", "pos", F.greatest(F.col("len") - F.col("m"), F.lit(0)).alias("last"), need, F.expr("row_number() OVER (PARTITION BY doc, item ORDER BY pos)").alias("nth"))
    placed = written(placed)
    other = placed.select(F.col("doc").alias("d"), F.col("item").alias("i"), F.col("nth").alias("k"), F.col("pos").alias("end"))
    begun = placed.join(shuffled(other), (F.col("doc") == F.col("d")) & (F.col("item") == F.col("i")) & (F.col("nth") + F.col("need") - 1 == F.col("k")))
    begun = begun.where((F.col("pos") <= F.col("last")) & (F.col("end") <= F.col("pos") + F.col("m") - SHINGLE)).select("doc", "doc_id", "item", "m", F.col("pos").alias("start"))
    final = placed.where("pos >= last").groupBy("doc", "doc_id", "item", "m", F.col("last").alias("start")).agg(F.count(F.lit(1)).alias("hits"), F.first("need").alias("need"))
    windows = written(begun.union(final.where("hits >= need").select("doc", "doc_id", "item", "m", "start")).distinct())

    # All shingles of these windows, from the documents that have any. These grow with the table: a shuffle at every size.
    mine = written(doc.join(windows.select("doc").distinct().hint("shuffle_hash"), "doc", "left_semi").distinct())
    shingles = shingled(mine, "doc").select("doc", "pos", "sh")
    places = windows.select("doc", "doc_id", "item", "m", "start", F.explode(F.sequence("start", F.col("start") + F.col("m") - SHINGLE)).alias("pos"))
    window = ["doc", "doc_id", "item", "m", "start"]
    filled = written(places.join(shuffled(shingles), ["doc", "pos"]).select(*window, "sh"))

    # Written, as Spark would else put the whole expression of a fingerprint into the conditions of what follows.
    prints = written(fingerprint(filled, *window)).select(*window, F.col("n").alias("window_n"), F.col("fp").alias("window_fp"), F.explode(blocks("fp")).alias("block"))
    tables = written(written(fingerprint(item_shingles, "item", "item_id")).select("item", "item_id", F.col("n").alias("item_n"), "fp", F.explode(blocks("fp")).alias("block")))
    near = F.bit_count(F.col("window_fp").bitwiseXOR(F.col("fp"))) <= RADIUS
    pairs = prints.join(sized(tables, BROADCAST_ROWS), ["item", "block"]).where(near).drop("block").distinct()

    weights = filled.groupBy(*window, "sh").agg(F.count(F.lit(1)).alias("here"))
    common = weights.join(met(items.select("item", "sh", "weight")), ["item", "sh"]).groupBy("doc", "item", "start").agg(F.sum(F.least("here", "weight")).alias("common"))
    told = pairs.join(shuffled(common), ["doc", "item", "start"])
    either = F.col("window_n") + F.col("item_n")
    alike = told.where((LEAST[0] + LEAST[1]) * F.col("common") >= LEAST[0] * either)
    return alike.select("doc", "doc_id", "item_id", (F.col("common") / (either - F.col("common"))).alias("similarity"))


def found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity): documents with a window that is like an item, and the greatest similarity of such windows.

    A window has as many words as the item; a shorter document is one window. Words are runs of letters, marks and digits in lower case.
    Similarity is that of the shingles of five words, weighted by their counts: common weight by the weight of either. Documents and items
    under five words have no shingle and match nothing, nor do null texts. Repeated rows are found once; a null doc_id or item_id comes out
    as null. Of rows with one id the most similar counts. An empty table on either side gives no rows. Further columns are not looked at.

    A similar window has 8 of 9 shingles in common with the item at least. So windows that begin at one of the item's shingles and hold
    enough of them, and each document's last window, are as similar as any. Their SimHash fingerprints meet the item's by blocks, which miss
    none within RADIUS differing bits, and the exact similarity decides.
    """
    return matches(docs, benchmark).groupBy("doc_id", "item_id").agg(F.round(F.max("similarity"), 9).alias("similarity"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that found() finds. Rows with a null doc_id are told by their text. Columns stay as they are."""
    bad = written(matches(docs, benchmark).select(F.col("doc").alias("bad"), F.col("doc_id").alias("bad_id")).distinct())
    rows = boxed(docs, id=F.col("doc_id").cast("long"), doc=F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return rows.join(bad.hint("shuffle_hash"), (F.col("doc") == F.col("bad")) & F.col("id").eqNullSafe(F.col("bad_id")), "left_anti").select("row.*")


ORACLE = f"""
WITH dw AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')) AS t FROM documents),
bw AS (SELECT DISTINCT item_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')) AS t FROM benchmark),
d AS (SELECT doc_id, row_number() OVER () AS doc, string_split(t, ' ') AS w FROM dw WHERE t <> '' AND len(string_split(t, ' ')) >= {SHINGLE}),
b AS (SELECT item_id, row_number() OVER () AS item, string_split(t, ' ') AS w FROM bw WHERE t <> '' AND len(string_split(t, ' ')) >= {SHINGLE}),
bs AS (SELECT item_id, item, len(w) AS m, array_to_string(w[i:i+{SHINGLE - 1}], ' ') AS sh FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM b)),
bc AS (SELECT item_id, item, m, sh, count(*) AS weight FROM bs GROUP BY ALL),
ds AS (SELECT doc_id, doc, len(w) AS l, i - 1 AS pos, array_to_string(w[i:i+{SHINGLE - 1}], ' ') AS sh FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d)),
c AS (SELECT DISTINCT doc_id, doc, l, item_id, item, m FROM ds JOIN bc USING (sh)),
s AS (SELECT *, unnest(range(0, greatest(l - m, 0) + 1)) AS start FROM c),
p AS (SELECT s.doc_id, s.item_id, s.doc, s.item, s.l, s.m, s.start, ds.sh, weight, count(*) AS here FROM s JOIN ds ON ds.doc = s.doc AND ds.pos BETWEEN s.start AND s.start + s.m - {SHINGLE}
    JOIN bc ON bc.item = s.item AND bc.sh = ds.sh GROUP BY ALL),
o AS (SELECT doc_id, item_id, least(l, m) + m - {2 * (SHINGLE - 1)} AS n, sum(least(here, weight)) AS common FROM p GROUP BY doc_id, item_id, doc, item, l, m, start)
SELECT doc_id, item_id, round(max(common / (n - common)), 9) AS similarity FROM o WHERE {LEAST[0] + LEAST[1]} * common >= {LEAST[0]} * n GROUP BY ALL
"""
