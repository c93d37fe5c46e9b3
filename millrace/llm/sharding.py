"""Sharding by a k-d tree: texts are split at weighted medians along their widest dimension until leaves have the target bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SHARDS = 24
#: Bytes that a row counts beside its text.
ROW_BYTES = 8
#: Equal texts that weigh this share of a shard or less are not split to make shards more equal.
TOLERANCE = 0.004
#: Bits of a sort key that are found at a time: the place along the dimension, the text's crc32 in two halves, a hash of the row.
PASSES = (15, 16, 16, 16)
#: Rows of one shard that are numbered in one task, about.
NUMBERED = 50_000


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + ROW_BYTES


def metadata(docs: DataFrame) -> DataFrame:
    """(row, doc_id, size, text_crc32, d0, d1, d2) of every document. Dimensions depend on the text only: log of its bytes, share of bytes
    beyond one a character, log of its lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size_of().alias("size"), F.crc32(text).alias("text_crc32"), F.length(text).alias("chars"), (F.length(text) - F.length(F.translate(text, "\n", ""))).alias("lines"))
    bytes_ = F.col("size") - ROW_BYTES
    return own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "size", "text_crc32", F.log2(bytes_ + 1.0).alias("d0"), F.when(bytes_ > 0, 1 - F.col("chars") / bytes_).otherwise(0.0).alias("d1"), F.log2(F.col("lines") + 1.0).alias("d2"))


DIMENSIONS = ("d0", "d1", "d2")


def by_node(values: dict[int, object], kind: str) -> Column:
    """The value for a row's node; null for other nodes. At most as many entries as there are shards."""
    if not values:
        return F.lit(None).cast(kind)
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("node")].cast(kind)


def key(dimension: Column, spans: dict[str, tuple[float, float]]) -> Column:
    """63 bits that rows are sorted by: the place along the dimension, then the text, then the row."""
    place = F.lit(0)
    for i, d in enumerate(DIMENSIONS):
        low, high = spans[d]
        place = F.when(dimension == i, F.floor((F.col(d) - low) / ((high - low) or 1.0) * ((1 << PASSES[0]) - 1))).otherwise(place)
    place = F.least(F.greatest(place, F.lit(0)), F.lit((1 << PASSES[0]) - 1)).cast("long")
    return F.shiftleft(place, 48).bitwiseOR(F.shiftleft("text_crc32", 16)).bitwiseOR(F.xxhash64("row").bitwiseAND(F.lit(0xFFFF)))


def medians(rows: DataFrame, wanted: dict[int, float], tolerance: float) -> dict[int, int]:
    """For each node a key before which about wanted bytes lie. Bytes are summed by the leading bits of the key, which tells in which of a
    bounded number of ranges it lies; then by further bits within it, until the range is light enough to go to one side."""
    cuts: dict[int, int] = {}
    prefix, before, shift = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0), sum(PASSES)
    for bits in PASSES:
        shift -= bits
        part = F.shiftright("key", shift)
        here = rows.where((F.shiftright(part, bits) == by_node(prefix, "long")) if prefix else F.lit(False))
        sums = here.groupBy("node", part.alias("part")).agg(F.sum("size").alias("bytes"))
        running = sums.withColumn("upto", F.expr("sum(bytes) OVER (PARTITION BY node ORDER BY part)")).withColumn("all", F.expr("sum(bytes) OVER (PARTITION BY node)"))
        goal = by_node({k: float(wanted[k] - before[k]) for k in prefix}, "double")
        hit = running.where((F.col("upto") >= goal) | (F.col("upto") == F.col("all"))).groupBy("node").agg(F.min(F.struct("part", "upto", "bytes")).alias("x")).collect()
        for node, (at, upto, weight) in ((r.node, r.x) for r in hit):
            left = before[node] + upto - weight
            if weight <= tolerance or shift == 0:
                nearer = at + 1 if wanted[node] - left > left + weight - wanted[node] else at
                cuts[node] = nearer << shift
                del prefix[node]
            else:
                prefix[node], before[node] = at, left
        if not prefix:
            break
    return cuts


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, with law `bytes`: sizes near equal.

    A node for s shards is split for s // 2 and the rest, at that share of its bytes along the dimension in which its rows spread most, as a
    share of the whole table's spread. Rows with equal texts lie side by side along every dimension; copies that weigh TOLERANCE of a shard
    or less are kept together, heavier groups may be cut, so that a group with a third of all rows is dealt out like others. Only sums by
    ranges of keys and one cut a node come to the driver. Shards differ by about the rows and groups at the cuts, so by less the more rows
    there are. Null texts count as empty (crc32 of no bytes: 0). Repeated rows are rows of their own; an empty table gives none.
    """
    rows = written(metadata(docs))
    whole = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), *(f(d).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max)))).first()
    spans = {d: (whole[f"{d}_low"] or 0.0, whole[f"{d}_high"] or 0.0) for d in DIMENSIONS}
    light = TOLERANCE * (whole.bytes or 0) / shards
    node, leaves, open_ = F.lit(0), {}, {0: (0, shards)}
    while open_:
        leaves |= {k: first for k, (first, n) in open_.items() if n == 1}
        open_ = {k: x for k, x in open_.items() if x[1] > 1}
        if not open_:
            break
        placed = rows.withColumn("node", node)
        spread = placed.groupBy("node").agg(F.sum("size").alias("bytes"), *((F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS)).collect()
        spread = {r.node: r for r in spread if r.node in open_}
        widest = {k: max(range(len(DIMENSIONS)), key=lambda i, r=r: (r[DIMENSIONS[i]] / ((spans[DIMENSIONS[i]][1] - spans[DIMENSIONS[i]][0]) or 1.0), -i)) for k, r in spread.items()}
        keyed = placed.where(F.col("node").isin(*open_)).withColumn("key", key(by_node(widest, "int"), spans)).select("node", "key", "size")
        cuts = medians(keyed, {k: r.bytes * (open_[k][1] // 2) / open_[k][1] for k, r in spread.items()}, light)
        split = rows.withColumn("node", node).withColumn("cut", by_node(cuts, "long")).withColumn("key", key(by_node(widest, "int"), spans))
        rows = written(split.select("row", "doc_id", "size", "text_crc32", *DIMENSIONS, F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(F.col("key") < F.col("cut"), 1).otherwise(2)).cast("int").alias("node")))
        node = F.col("node")
        open_ = {child: x for k, (first, n) in open_.items() for child, x in ((2 * k + 1, (first, n // 2)), (2 * k + 2, (first + n // 2, n - n // 2)))}
    if shards == 1 or "node" not in rows.columns:
        rows = rows.withColumn("node", F.lit(0))
    shard = by_node(leaves, "int")
    return slotted(rows.select("row", "doc_id", "size", "text_crc32", shard.alias("shard")), shards, whole.n)


def slotted(rows: DataFrame, shards: int, n: int) -> DataFrame:
    """Rows of each shard numbered from 0 without gaps: within hash buckets of bounded size, which are counted up before."""
    buckets = max(1, n // (shards * NUMBERED))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    sums = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    skip = sums.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.expr("coalesce(sum(rows) OVER (PARTITION BY shard ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("skip"))
    numbered = dealt.withColumn("nth", F.expr("row_number() OVER (PARTITION BY shard, bucket ORDER BY doc_id, row)"))
    placed = numbered.join(skip, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("skip") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
