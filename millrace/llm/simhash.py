"""SimHash near-duplicates: 64-bit fingerprints, linked through tables of their halves."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, blocks, boxed, components, shuffled, text_buffers, written
from .spans import BASE, K1, K2, K3, MIX, Hasher, mixed, words

SHINGLE = 3
RADIUS = 3
#: Words of a text that are hashed at a time.
BLOCK = 200_000


def fingerprint(text: bytes | None) -> int:
    """64 bits, each 1 if set in over half the hashes of the word shingles; 0 without a word. A-Z count as lower case."""
    words = (text or b"").lower().split()
    digest = partial(xxhash.xxh64_digest, seed=42)
    if not words:
        return 0
    if len(words) < SHINGLE:
        return int.from_bytes(digest(b" ".join(words)), "big")
    ones, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for start in range(0, n, BLOCK):
        part = words[start : start + BLOCK + SHINGLE - 1]
        hashes = b"".join(map(digest, map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)), strict=False))))
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return batched(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): all pairs a < b of the distinct longs fp with radius or fewer differing bits, for a radius of 3 at most.

    Of two halves of 32 bits, one then differs in one bit or none. A table holds every value under either half; each value looks up the
    33 halves within one bit of its own, and the full distance decides. 32 bits keep the lists short where 16 would not.
    """
    if radius > 3:
        raise ValueError("two halves with balls of one bit reach 3 differing bits")
    half = F.lit(0xFFFFFFFF)
    sides = F.array(F.col("fp").bitwiseAND(half), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)))
    ball = F.array(*[F.lit(x).cast("long") for x in [0, *(1 << i for i in range(32))]])
    held = fps.select(F.col("fp").alias("b"), F.explode(sides).alias("key"))
    asked = fps.select(F.col("fp").alias("a"), F.explode(sides).alias("side")).select("a", F.explode(ball).alias("flip"), "side").select("a", F.col("side").bitwiseXOR(F.col("flip")).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return asked.join(shuffled(held), "key").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): documents linked by fingerprints with 3 or fewer differing bits, directly or through others.

    component_id is the smallest doc_id of the group. Equal fingerprints are one node, so copies cost no pairs. A null text or one without
    words has the fingerprint 0. Repeated rows come back repeated. A null doc_id never names a group that has another one.
    """
    fps = written(fingerprints(docs))
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    label = written(components(nodes.select(F.col("fp").alias("node")), written(links(nodes.select("fp")))))
    named = label.join(shuffled(nodes), F.col("node") == F.col("fp")).groupBy("label").agg(F.min("first").alias("component_id"))
    member = label.join(shuffled(named), "label").select(F.col("node").alias("fp"), "component_id")
    return fps.join(shuffled(member), "fp").select("doc_id", "fp", "component_id")


def hexed(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: What near copies are: sets of shingles of so many words, as alike as this fraction or more.
WORDS, LEAST = 5, (4, 5)
#: Tables of least hashes, and least hashes that a key of a table is made of. Two sets as alike as LEAST share a key but for 2 in 10,000.
TABLES, MINIMA = 16, 4
#: Nodes of a list that are put into order in one task, about; orders in which lists are gone through.
PART, ORDERS = 1000, 3
BLOCK_BYTES = 1 << 20
UPPER = np.zeros(256, bool)
UPPER[[*range(ord("A"), ord("Z") + 1)]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, as longs, of the distinct shingles of each text in order, and how many a text has. A-Z count as lower case.

    A text with fewer words than a shingle has is one shingle; one without a word has none.
    """
    data = np.where(UPPER[data], data + 32, data).astype(np.uint8)
    starts, ends, text = words(data, offsets)
    h, n = Hasher(data)(starts, ends), np.bincount(text, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    hashes, texts = [], []
    for k in range(1, WORDS + 1):
        at = first[n == k] if k < WORDS else np.flatnonzero(text[k - 1 :] == text[: max(0, len(text) - k + 1)])
        hashes.append(mixed(sum((h[at + i] * m for i, m in zip(range(k), (K1, K2, K3, BASE, MIX))), np.full(len(at), k, np.uint64))))
        texts.append(text[at])
    value, owner = np.concatenate(hashes).view(np.int64), np.concatenate(texts)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(n))


def sketches(docs: DataFrame) -> DataFrame:
    """(id, version, node, fp, n, keys) of each row: node stands for its set of n shingles, fp is the set's fingerprint, version a hash of the
    text. keys: one a table, of MINIMA least hashes; none without a word."""
    draw = np.random.default_rng(5).integers(1 << 63, size=(2, TABLES * MINIMA), dtype=np.uint64)
    flip, factor = draw[0], draw[1] * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in blocks(batch.column(2), BLOCK_BYTES):
                part = batch.slice(start, rows)
                sh, n = shingle_sets(*text_buffers(part.column(2)))
                there, h = np.flatnonzero(n), sh.view(np.uint64)
                first = (np.cumsum(n) - n)[there]
                fp, node = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                keys = np.zeros((len(there), TABLES), np.uint64)
                if len(there):
                    bits = np.unpackbits(h.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
                    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
                    fp[there] = np.packbits(2 * ones > n[there, None], axis=1).view(">i8").ravel()
                    node[there] = mixed(np.add.reduceat(mixed(h), first) + mixed(n[there].astype(np.uint64))).view(np.int64)
                    for t in range(TABLES):
                        for i in range(t * MINIMA, (t + 1) * MINIMA):
                            keys[:, t] = mixed(keys[:, t] * K1 + np.minimum.reduceat((h ^ flip[i]) * factor[i], first))
                        keys[:, t] = mixed(keys[:, t] + np.uint64(t))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(TABLES * (n > 0))), pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node), pa.array(fp), pa.array(n, pa.int32()), lists], ["id", "version", "node", "fp", "n", "keys"])

    return batched(keyed(docs)).mapInArrow(run, "id long, version long, node long, fp long, n int, keys array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))


def sets(docs: DataFrame) -> DataFrame:
    """(id, version, sh) of each row: 32 bits of each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in blocks(batch.column(2), BLOCK_BYTES):
                part = batch.slice(start, rows)
                sh, n = shingle_sets(*text_buffers(part.column(2)))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array((sh >> 32).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["id", "version", "sh"])

    return batched(keyed(docs)).mapInArrow(run, "id long, version long, sh array<int>")


def alike(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets, held as (node, sh), are as alike as LEAST."""
    own = lambda node, sh: shuffled(held.select(F.col("node").alias(node), F.col("sh").alias(sh)))
    both = pairs.join(own("a", "x"), "a").join(own("b", "y"), "b")
    sized = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("common"))
    return sized.where((LEAST[0] + LEAST[1]) * F.col("common") >= LEAST[0] * F.col("n")).select("a", "b")


def contracted(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): label is the least node that edges reach from node.

    In a round each node is taken to the least of its neighbours, itself among them, and from there one step on; then edges are drawn anew
    between where their ends have come to, and those within one node go. So there are fewer edges each round, by half or more of their nodes,
    and the rounds together cost little more than the first. The ways of all rounds, from the last one back, give the labels.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct())
    ways = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")))
        again = step.select(F.col("a").alias("to"), F.col("to").alias("then"))
        ways.append(written(step.join(again, "to").select(F.col("a").alias("node"), F.col("then").alias("label"))))
        for side in ("a", "b"):
            edges = edges.join(ways[-1].withColumnRenamed("node", side), side).drop(side).withColumnRenamed("label", side)
        edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not ways:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    whole = ways.pop()
    while ways:
        on = whole.select(F.col("node").alias("label"), F.col("label").alias("end"))
        whole = written(ways.pop().join(on, "label", "left").select("node", F.coalesce("end", "label").alias("label")))
    return whole


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) where further edges (a, b) between nodes make labels one."""
    ends = edges
    for side in ("a", "b"):
        ends = ends.join(shuffled(labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))), side)
    into = contracted(ends.select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("into"))
    return written(labels.join(shuffled(into), "label", "left").select("node", F.coalesce("into", "label").alias("label")))


def several(listed: DataFrame) -> DataFrame:
    """The rows of those lists (key, label, ...) that have several labels."""
    both = listed.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key")
    return written(listed.join(shuffled(both), "key"))


def neighbours(listed: DataFrame, order: int) -> DataFrame:
    """(a, b): each node of a list (key, node, n, c) with the next in it that is of a size that can be alike, if their labels, where there are
    any, differ. One order, a hash with a number, holds for all lists, so that lists with the same nodes make the same pairs; c, a list's
    nodes, tells into how many ranges of it the list is cut."""
    h = f"xxhash64(node, {order})"
    part = F.expr(f"if(c <= {PART}, 0, shiftrightunsigned({h}, 64 - cast(ceil(log2(c / {PART})) as int)))")
    label = F.col("label") if "label" in listed.columns else F.lit(None).cast("long")
    own = listed.select("key", "node", "n", "c", label.alias("label"))
    following = F.lead(F.struct("node", "n", "label")).over(Window.partitionBy("key", part).orderBy(F.expr(h), "node"))
    sized = LEAST[1] * F.least(F.col("n"), F.col("other.n")) >= LEAST[0] * F.greatest(F.col("n"), F.col("other.n"))
    apart = F.coalesce(F.col("label") != F.col("other.label"), F.lit(True))
    return own.withColumn("other", following).where(sized & apart).select(F.col("node").alias("a"), F.col("other.node").alias("b"))


def links_of_parts(listed: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b): all pairs of nodes that are as alike as LEAST, of lists (key, node, n, label), whose labels differ. held: their sets (node, sh).

    Only lists with several labels are looked at. Sets of n and m shingles that are so alike have 4/9 (n + m) in common or more. So of their
    nodes only those go on that have so many shingles in common with nodes of other labels, all together, with m of the smallest node of
    their lists, or 4/5 n if that is more. Two of these meet if one of the rarest of the larger set's shared shingles is one of the rarest of the
    smaller's: all shared ones but as many as must be in common, and one more; for the smaller set these are 8/9 of its shingles. That loses no
    pair, and spares what many texts share, such as a licence, as that is rare for none of them. What is left of both sets behind a
    common shingle bounds what can be in common. Whole sets decide.
    """
    top, bottom = LEAST
    several = listed.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min("n").alias("low")).where("least < most").select("key", "low")
    open_ = listed.join(shuffled(several), "key").groupBy("node", "n", "label").agg(F.min("low").alias("low"))
    need = F.ceil(F.lit(top) * (F.col("n") + F.greatest("low", F.ceil(F.lit(top) * F.col("n") / bottom))) / (top + bottom))
    each = written(open_.withColumn("need", need).join(shuffled(held), "node").select("node", "n", "label", "need", F.explode("sh").alias("s")))
    spread = each.groupBy("s").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("often")).where("least < most")
    shared = written(each.join(shuffled(spread), "s").select("node", "n", "label", "need", "s", "often"))
    able = shared.groupBy("node", "need").agg(F.count(F.lit(1)).alias("c")).where("c >= need").select("node", "c")
    nth = F.row_number().over(Window.partitionBy("node").orderBy("often", "s"))
    rare = written(shared.join(shuffled(able), "node").withColumn("nth", nth).where("nth <= c - need + 1").select("node", "n", "label", "c", "s", "nth"))
    # As the smaller set it may need more of its shingles than as the larger, so these are among them.
    first = rare.where(f"nth <= c - ceil({2 * top} * n / {top + bottom}) + 1")
    a = rare.select("s", *(F.col(c).alias(f"a_{c}") for c in ("node", "n", "label", "c", "nth")))
    b = first.select("s", *(F.col(c).alias(f"b_{c}") for c in ("node", "n", "label", "c", "nth")))
    smaller = (F.col("b_n") < F.col("a_n")) | ((F.col("b_n") == F.col("a_n")) & (F.col("b_node") < F.col("a_node")))
    behind = 1 + F.least(F.col("a_c") - F.col("a_nth"), F.col("b_c") - F.col("b_nth"))
    fits = (bottom * F.col("b_n") >= top * F.col("a_n")) & ((top + bottom) * behind >= top * (F.col("a_n") + F.col("b_n")))
    met = a.join(shuffled(b), "s").where((F.col("a_label") != F.col("b_label")) & smaller & fits)
    return alike(met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct(), held)


def near(docs: DataFrame) -> DataFrame:
    """(id, version, label) of each row: rows have one label whose sets of shingles of WORDS words are as alike as LEAST, directly or through
    others. Rows with equal sets are one node. A set that only rows without an id have is like no other.

    Candidates come from the tables of fingerprints, and from tables of least hashes, as fingerprints of sets that are 0.8 alike differ in
    about 10 of 64 bits, which no small ball reaches; whole sets decide. A node is held against the next of each list that it is in, by one
    order for all lists, so that lists with the same nodes give the same pairs; then what is still apart in a list is compared in full
    (links_of_parts()). So a large group of near copies makes few pairs.
    """
    rows = written(sketches(docs))
    nodes = written(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.first("keys").alias("keys"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "version"))).alias("at")))
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    linked = links(prints.select("fp"))
    for side in ("a", "b"):
        linked = linked.join(shuffled(prints.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_node"))), side)
    pairs = linked.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    pairs = pairs.union(nodes.join(shuffled(prints), "fp").where("node <> first").select("first", "node"))

    listed = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = listed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    listed = written(listed.join(shuffled(shared), "key"))
    met = neighbours(listed, 0)
    pairs = written(pairs.union(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    large = listed.where("c > 2")
    wanted = wanted.union(large.select("node")).distinct().join(shuffled(nodes), "node").select("node", "at.*")
    # Texts are read again: their sets would take more room than they do.
    own = sets(docs).join(wanted.hint("shuffle_hash"), ["id", "version"]) if not wanted.isEmpty() else None
    if own is None:
        return rows.select("id", "version", F.col("node").alias("label"))
    held = written(own.groupBy("node").agg(F.first("sh").alias("sh")))
    first = contracted(alike(pairs, held)).select("node", "label")
    labels = written(nodes.select("node").join(shuffled(first), "node", "left").select("node", F.coalesce("label", "node").alias("label")))

    # Lists with several labels are gone through in other orders, which leaves less to compare in full.
    for order in range(1, ORDERS):
        apart = several(large.join(shuffled(labels), "node").select("key", "node", "n", "c", "label"))
        labels = relabelled(labels, alike(neighbours(apart, order).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), held))
    labels = relabelled(labels, links_of_parts(large.join(shuffled(labels), "node").select("key", "node", "n", "label"), held))
    return rows.select("id", "version", "node").join(shuffled(labels), "node").select("id", "version", "label")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies (near()): that with the smallest doc_id and, of several texts with that one, the
    smallest hash; of rows alike in both, the first by its columns as JSON.

    Rows without a doc_id stay, and are no group's row. Texts without a word are alike, null ones too. Of an empty table nothing stays. Very
    long texts are read whole, in one task each. Other columns come through as they are, whatever their names.
    """
    rows = written(near(docs).where("id is not null"))
    first = rows.groupBy("label").agg(F.min(F.struct("id", "version")).alias("at")).select("at.*")
    again = rows.groupBy("id", "version").agg(F.count(F.lit(1)).alias("n"))
    first = written(again.join(shuffled(first), ["id", "version"]))
    row = boxed(docs, id=F.col("doc_id").cast("long"), version=F.xxhash64(F.col("text").cast("string")))

    def having(n: str) -> DataFrame:
        # A shuffle at every size: the list of firsts grows with the table.
        return row.join(first.where(n).hint("shuffle_hash"), ["id", "version"], "left_semi")

    kept = having("n = 1").select("row").union(row.where("id is null").select("row"))
    if not first.where("n > 1").isEmpty():
        kept = kept.union(having("n > 1").groupBy("id", "version").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return kept.select("row.*")
