"""Copies and near copies: keys, similarity joins, and the greedy rule that an earlier kept row drops a later one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import shuffled, sized, written


def best_copy(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """One row for each key, the first by order; rows without a key all stay."""
    marked = df.withColumn("__k", key)
    first = marked.where("__k is not null").withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy(*order))).where("__n = 1")
    return first.drop("__n").unionByName(marked.where("__k is null")).drop("__k")


def shingle_sets(df: DataFrame, id_: str, shingles: Column) -> DataFrame:
    """(id, n, sh, nth): the hashed shingles of each row with their number n, the rarest of the table first."""
    each = df.select(F.col(id_).alias("id"), F.explode(F.transform(F.array_distinct(shingles), lambda s: F.xxhash64(s))).alias("sh"))
    each = written(each)
    often = each.groupBy("sh").agg(F.count(F.lit(1)).alias("often"))
    by = Window.partitionBy("id")
    return written(each.join(often, "sh").select("id", "sh", F.count(F.lit(1)).over(by).alias("n"), F.row_number().over(by.orderBy("often", "sh")).alias("nth")))


def set_classes(df: DataFrame, id_: str, shingles: Column, in_waves: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, first) of each row with shingles, where first is the least id with the same set; and (id, shingles), hashed, of these first rows.

    Pairs are then looked for among the first rows only, so that a group of copies costs no pairs; a row is like all that its first is like.
    in_waves: first rows have their wave, too (waves), and lie in a folder for each.
    """
    hashed = F.array_sort(F.array_distinct(F.transform(shingles, lambda s: F.xxhash64(s))))
    own = df.select(F.col(id_).alias("id"), hashed.alias("shingles"))
    # Written before anything filters it: a filter would be pushed down to the tokens and have them computed again for each shingle.
    own, by = (own.withColumn("wave", waves(own.select("id"))), ["wave"]) if in_waves else (own, [])
    own = written(own, *by)
    key = F.sha2(F.array_join(F.transform("shingles", lambda h: h.cast("string")), ","), 256)
    keyed = written(own.select("id", F.when(F.size("shingles") > 0, key).alias("key")))
    firsts = written(keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("first")))
    # Most rows are first ones, so that the others are picked out: the sets are neither shuffled nor written again where these are few.
    others = written(keyed.join(firsts.select(F.col("first").alias("id")), "id", "left_anti").select("id"))
    first = picked(own, others, "left_anti")
    return keyed.join(firsts, "key").select("id", "first"), first if others.count() <= BROADCAST_IDS else written(first, *by)


#: Buckets of hashes whose counts order the shingles of a set, a fixed number of whatever table.
COUNTED = 1 << 20
#: Counts that are added up at a time.
RUN = 1 << 12


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How often each bucket of hashes is met in sets (id, shingles). A task counts its own; counts of tasks are added up by runs of buckets."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(COUNTED, np.int64)
        for batch in batches:
            often += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False) & (COUNTED - 1), minlength=COUNTED)
        ends = pa.array(np.arange(0, COUNTED + 1, RUN), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(COUNTED // RUN)), pa.ListArray.from_arrays(ends, pa.array(often))], ["run", "often"])

    def added(key: tuple[pa.Scalar, ...], counts: pa.Table) -> pa.Table:
        total = counts["often"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, RUN).sum(axis=0)
        return pa.table({"run": pa.array([key[0].as_py()]), "often": pa.array([total], pa.list_(pa.int64()))})

    runs = sets.select("shingles").mapInArrow(counted, "run long, often array<long>").groupBy("run").applyInArrow(added, "run long, often array<long>")
    return runs.orderBy("run").toArrow()["often"].combine_chunks().flatten().to_numpy(zero_copy_only=False)


#: Two sets that are alike have one more of the shingles in front in common for each so many that the smaller one has.
EVERY = 16
NEVER = 1 << 30


def fronts(sets: DataFrame, share: tuple[int, int], every: int = NEVER) -> DataFrame:
    """sets (id, shingles, and other columns) with their number n in place of shingles, and front: the rarest of them, the rarest first.

    All but share * n are in front, and one more; with every also those that meetings takes beyond these. One order for the whole table: how often the
    bucket of a shingle's hash is met, then the hash. It parts rare from frequent shingles like counts of each would, and needs no shuffle of all
    shingles; the counts of buckets are as many whatever the table.
    """
    known, (top, bottom) = sets.sparkSession.sparkContext.broadcast(bucket_counts(sets)), share

    @F.arrow_udf(ArrayType(LongType()))
    def front(shingles: pa.Array) -> pa.Array:
        sh = shingles.flatten().to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(shingles).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((sh, known.value[sh & (COUNTED - 1)], row))
        starts = np.cumsum(sizes) - sizes
        taken = np.where(sizes > 0, sizes - -(-top * (every - 1) * sizes // (bottom * every)) + 1, 0)
        at = np.repeat(starts - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(taken)), pa.int32()), pa.array(sh[order[at]]))

    return sets.select(*(c for c in sets.columns if c != "shingles"), F.size("shingles").alias("n"), front("shingles").alias("front"))


def rarest_first(sets: DataFrame, share: tuple[int, int], every: int = NEVER) -> DataFrame:
    """fronts with a row for each shingle (id, n, sh, nth, and other columns)."""
    ahead = fronts(sets, share, every)
    return ahead.select(*(c for c in ahead.columns if c != "front"), F.posexplode("front").alias("nth", "sh"))


def met_again(share: tuple[int, int]) -> int:
    """EVERY, if sets of this similarity have that many shingles in common."""
    return EVERY if (EVERY - 1) * share[0] >= share[1] else NEVER


def shared_fronts(sets: DataFrame, share: tuple[int, int], *by: str) -> DataFrame:
    """rarest_first, written, without the shingles that one set alone has in front, which are most."""
    ahead = rarest_first(sets, share, met_again(share))
    often = F.count(F.lit(1)).over(Window.partitionBy("sh"))
    return written(ahead.withColumn("often", often).where("often > 1").drop("often"), *by)


def meetings(a: DataFrame, b: DataFrame, share: tuple[int, int], apart: Column) -> DataFrame:
    """(a, b), written: pairs of sets that can be alike by their shingles in front (id, n, sh, nth), without those that apart leaves out.

    Where two sets are alike, so much lies behind the first shingle that they share in both that they can still have enough in common, behind the
    second one less, and so on. So they meet in 1 + n / EVERY shingles with that many less behind them, where n is of the smaller set; sets
    that share a few shingles of many don't. No pair that is alike is lost.
    """
    (top, bottom), every = share, met_again(share)
    own = lambda df, x: df.select(F.col("id").alias(x), "sh", F.col("n").alias(f"n{x}"), (F.col("n") - F.col("nth")).alias(f"left{x}"))
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    more = F.floor(small / every)
    fits = (bottom * small >= top * large) & ((top + bottom) * (F.least("lefta", "leftb") + more) >= top * (small + large))
    met = own(a, "a").join(shuffled(own(b, "b")), "sh").where(apart & fits).groupBy("a", "b", more.alias("more")).agg(F.count(F.lit(1)).alias("met"))
    return written(met.where("met > more").select("a", "b"))


def meetings_within(ahead: DataFrame, share: tuple[int, int]) -> DataFrame:
    """meetings of sets of one table with each other, a < b."""
    (top, bottom), every = share, met_again(share)
    # The least part of both sizes that two sets of this similarity have in common: top / (top + bottom).
    small = ahead.where((F.col("n") - F.col("nth") + F.floor(F.col("n") / every)) * (top + bottom) >= 2 * top * F.col("n"))
    falls = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    return meetings(small, ahead, share, falls).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


#: Ids that are broadcast to pick rows, at most; more meet these in a shuffle.
BROADCAST_IDS = 500_000
#: Pairs of ids that are broadcast, at most.
BROADCAST_PAIRS = 100_000


def picked(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """df (id, ...) joined with ids (id), written ones, of which each is once."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", how)


def alike(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b, common, similarity) of the pairs (a, b) whose sets (id, shingles) are alike; the sets meet as arrays."""
    top, bottom = share
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    met = picked(sets, ids)
    own = lambda n: met.select(F.col("id").alias(n), F.col("shingles").alias(f"s{n}"))
    both = sized(pairs, BROADCAST_PAIRS).join(own("a"), "a").join(own("b"), "b")
    counted = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), common_values("sa", "sb").alias("common"))
    either = F.col("na") + F.col("nb") - F.col("common")
    return counted.where(bottom * F.col("common") >= top * either).select("a", "b", "common", (F.col("common") / either).alias("similarity"))


def similar_sets(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b, common, similarity): all pairs a < b of sets (id, shingles) whose Jaccard similarity is share, a fraction, or more.

    Two such sets have some of their rarest shingles in common (meetings), which loses no pair. Shuffled are these shingles, and the sets as
    arrays, against each other. Ids are distinct; sets are written, as they are read more than once.
    """
    return alike(meetings_within(shared_fronts(sets, share), share), sets, share)


@F.arrow_udf(LongType())
def common_values(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many values two arrays of distinct numbers have in common, row by row."""
    ends = lambda x: np.cumsum(np.append(0, pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False)))
    x, y, i, j = a.flatten().to_numpy(zero_copy_only=False), b.flatten().to_numpy(zero_copy_only=False), ends(a), ends(b)
    own = lambda k: len(np.intersect1d(x[i[k] : i[k + 1]], y[j[k] : j[k + 1]], assume_unique=True))
    return pa.array([own(k) for k in range(len(a))], pa.int64())


def similar_pairs(sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """similar_sets of sets (id, sh) with a row for each shingle."""
    return similar_sets(written(sets.groupBy("id").agg(F.collect_set("sh").alias("shingles"))), least)


#: Shingles of an index that are broadcast, at most; more meet the queries' in a shuffle.
BROADCAST_INDEX = 500_000


def greatest_similarity(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(id, similarity): for each set of shingles (id, sh, n) the greatest Jaccard similarity to one of the index; 0 without a common one."""
    own = written(index.select(F.col("id").alias("other"), "sh", F.col("n").alias("m")))
    own = F.broadcast(own) if own.count() <= BROADCAST_INDEX else own
    common = queries.join(own, "sh").groupBy("id", "n", "other", "m").agg(F.count(F.lit(1)).alias("common"))
    best = common.groupBy("id").agg(F.max(F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).alias("best"))
    return queries.select("id").distinct().join(best, "id", "left").select("id", F.coalesce("best", F.lit(0.0)).alias("similarity"))


def greedy_kept(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id) that stay when each pair (a, b) with a before b drops b, if a stays: a dropped row drops no other.

    Each round keeps the rows that no undecided row comes before, and drops what these come before. As many rounds as the longest chain.
    """
    open_ = written(pairs.select("a", "b").distinct())
    dropped = None
    while not open_.isEmpty():
        waiting = open_.select(F.col("b").alias("a")).distinct()
        safe = written(open_.select("a").distinct().join(waiting, "a", "left_anti"))
        gone = written(open_.join(safe, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        out = gone.select(F.col("id").alias("a"))
        rest = open_.join(safe, "a", "left_anti").join(out, "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti")
        open_ = written(rest.select("a", "b"))
    return ids if dropped is None else ids.join(dropped, "id", "left_anti")


#: Rows of the first wave, and how many times what came before the waves up to the next have.
FIRST_WAVE, GROWTH = 4096, 4


def waves(ids: DataFrame) -> Column:
    """The wave of an id, a number, by ranges of ids (id): about FIRST_WAVE rows first, then each GROWTH times as many as up to the last one."""
    n, sizes = ids.count(), []
    while FIRST_WAVE * GROWTH ** len(sizes) < n:
        sizes.append(FIRST_WAVE * GROWTH ** len(sizes) / n)
    ends = ids.select(F.percentile_approx("id", sizes)).first()[0] if sizes else []
    return sum(((F.col("id") > end).cast("int") for end in sorted({*ends})), F.lit(0))


def similar_to_any(ids: DataFrame, others: DataFrame, ahead: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(id) of ids whose set is, by share or more, like one of others (id), which are other ones. sets: (id, shingles) of all, ahead: their shared_fronts.

    Others come in waves, by a hash, and what one is found for meets no later one. So of a group of near copies few pairs are looked at.
    """
    hashed = others.select(F.col("id").alias("own"), F.xxhash64("id").alias("id"))
    dealt = written(hashed.select(F.col("own").alias("id"), waves(hashed.select("id")).alias("wave")))
    found: list[DataFrame] = []
    for wave in sorted(r.wave for r in dealt.select("wave").distinct().collect()):
        met = meetings(picked(ahead, dealt.where(F.col("wave") == wave).select("id")), picked(ahead, ids), share, F.lit(True))
        found.append(written(alike(met, sets, share).select(F.col("b").alias("id")).distinct()))
        ids = written(picked(ids, found[-1], "left_anti"))
    return reduce(DataFrame.union, found) if found else ids.limit(0)


def greedy_similar(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(id) of the sets (id, shingles, wave) that stay when each drops later ones whose similarity is share or more: a dropped one drops no other.

    Waves of ids are gone through in order. What stays of those before drops what it can of a wave, and only what is left there is looked
    through for pairs. So of a group of near copies the pairs with those that stay are looked at, not all pairs.
    """
    ahead = shared_fronts(sets, share, "wave")
    kept: list[DataFrame] = []
    before: list[DataFrame] = []
    numbers = sorted(r.wave for r in sets.select("wave").distinct().collect())
    for wave in numbers:
        ids, front = sets.where(F.col("wave") == wave).select("id"), ahead.where(F.col("wave") == wave)
        if before:
            met = meetings(reduce(DataFrame.union, before), front, share, F.lit(True))
            gone = written(alike(met, sets.where(F.col("wave") <= wave), share).select(F.col("b").alias("id")).distinct())
            ids, front = picked(ids, gone, "left_anti"), picked(front, gone, "left_anti")
        pairs = alike(meetings_within(front, share), sets.where(F.col("wave") == wave), share)
        kept.append(written(greedy_kept(ids, pairs)))
        if wave != numbers[-1]:
            before.append(written(picked(front, kept[-1])))
    return reduce(DataFrame.union, kept) if kept else sets.select("id")


def without_protected(rows: DataFrame, protected: dict[str, DataFrame], id_: str) -> DataFrame:
    """rows with reason: the first name of protected tables (one column, named like a column of rows) that holds the row's value; null if none."""
    out = rows.withColumn("reason", F.lit(None).cast("string"))
    for name, table in protected.items():
        key = table.columns[0]
        hit = table.select(F.col(key).alias(f"__{key}")).where(f"__{key} is not null").distinct().withColumn("__hit", F.lit(True))
        out = out.join(hit, F.col(key) == F.col(f"__{key}"), "left").withColumn("reason", F.coalesce("reason", F.when(F.col("__hit"), F.lit(name)))).drop("__hit", f"__{key}")
    return out


def overlaps(a: DataFrame, b: DataFrame, key: str, share: float, width: float) -> DataFrame:
    """Pairs of ranges (id, key, s, e) of one key that overlap by more than a share of the shorter one.

    Ranges are dealt to the buckets of a width that they touch, so a key with very many ranges is many small joins.
    """

    def dealt(df: DataFrame, n: str) -> DataFrame:
        touched = F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))
        return df.select(F.col(key).alias("key"), F.col("id").alias(n), F.col("s").alias(f"s{n}"), F.col("e").alias(f"e{n}"), F.explode(touched).alias("bucket"))

    pairs = dealt(a, "a").join(dealt(b, "b"), ["key", "bucket"])
    common = F.least("ea", "eb") - F.greatest("sa", "sb")
    shorter = F.least(F.col("ea") - F.col("sa"), F.col("eb") - F.col("sb"))
    # A pair that meets in several buckets counts in the first of them.
    once = F.col("bucket") == F.greatest(F.floor(F.col("sa") / width), F.floor(F.col("sb") / width))
    return pairs.where(once & (common > share * shorter)).select("key", "a", "b", common.alias("common"))
