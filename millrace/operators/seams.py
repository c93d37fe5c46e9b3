"""Readings beside merge points, gates between runs, and the variety of slots and voices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How near a merge point is, in seconds; how far a run may pass the base; languages by wave.
NEAR, FACTOR = 1.5, 0.5
FIRST_WAVE = ("de", "es", "fr", "it", "nl", "pt")


def near_points(times: DataFrame, points: DataFrame, key: list[str], within: float = NEAR) -> DataFrame:
    """(key) of rows with a time (key, t) that lies within so many seconds of a point (key, g). Times meet points by buckets of that width, so
    a key with very many of both makes few pairs."""
    own = points.select(*key, "g", F.explode(F.sequence(F.floor(F.col("g") / within) - 1, F.floor(F.col("g") / within) + 1)).alias("bucket"))
    return times.withColumn("bucket", F.floor(F.col("t") / within)).join(own, [*key, "bucket"]).where(F.abs(F.col("t") - F.col("g")) <= within).select(*key).distinct()


def near_interior(reads: DataFrame, times: DataFrame, points: DataFrame, within: float = NEAR) -> DataFrame:
    """(arm, part, wrong, n): wrong readings (arm, slot, offset, right) near merge points and inside; parts `within_slot_...` over slots that
    have readings of both kinds. times and points (slot, offset, ...) are those of all arms together, so that every arm is parted alike.
    Only slots that every arm has count."""
    arms = reads.select("arm").distinct().count()
    both = reads.groupBy("slot").agg(F.count_distinct("arm").alias("arms")).where(F.col("arms") == arms).select("slot")
    near = near_points(times, points, ["slot", "offset"], within).withColumn("near", F.lit(True))
    told = reads.join(both, "slot", "left_semi").join(near, ["slot", "offset"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    mixed = told.groupBy("slot").agg((F.bool_or("near") & ~F.bool_and("near")).alias("mixed"))
    kind = F.when(F.col("near"), "near").otherwise("interior")
    parts = told.join(mixed, "slot").select("arm", "right", F.explode(F.array_compact(F.array(kind, F.when(F.col("mixed"), F.concat(F.lit("within_slot_"), kind))))).alias("part"))
    return parts.groupBy("arm", "part").agg(F.sum((~F.col("right")).cast("int")).alias("wrong"), F.count(F.lit(1)).alias("n"))


def seam_gate(counts: DataFrame, base: str) -> DataFrame:
    """(run, check, got, base, ok) of every run but the base, of counts (run, lang, merge_wrong, wrong, dropped): what merging made wrong in the
    first wave, which English is not of, is no more than FACTOR times the base's, in English no more than the base's; nor is what single readings got wrong or dropped,
    in either. A run without English pairs, or a base without the first wave, fails."""
    wave = F.col("lang").isin(*FIRST_WAVE)
    known = counts.where((F.col("run") == base) & wave).select("lang")
    inside = counts.join(known, "lang", "left_semi")
    english = F.col("lang") == "en"
    single = F.col("wrong") + F.col("dropped")
    of = lambda c, what: F.coalesce(F.sum(F.when(c, what)), F.lit(0))
    sums = inside.groupBy("run").agg(F.sum("merge_wrong").alias("merged"), F.sum(single).alias("single"))
    by_run = counts.groupBy("run").agg(of(english, F.col("merge_wrong")).alias("en_merged"), of(english, single).alias("en_single"), F.bool_or(english).alias("has_en")).join(sums, "run", "left").fillna(0, ["merged", "single"])
    own = by_run.where(F.col("run") == base).select(F.lit(1).alias("one"), *(F.col(c).alias(f"b_{c}") for c in ("merged", "single", "en_merged", "en_single")))
    both = by_run.where(F.col("run") != base).withColumn("one", F.lit(1)).join(own, "one", "left")
    row = lambda name, got, at, ok: F.struct(F.lit(name).alias("check"), F.col(got).cast("double").alias("got"), F.coalesce(F.col(at), F.lit(0)).cast("double").alias("base"), F.coalesce(ok, F.lit(False)).alias("ok"))
    checks = [
        row("wave-1 merge-made wrong", "merged", "b_merged", (F.col("merged") <= FACTOR * F.col("b_merged")) & ((F.col("b_merged") > 0) | (F.col("merged") == 0))),
        row("English merge-made wrong", "en_merged", "b_en_merged", F.col("has_en") & (F.col("en_merged") <= F.col("b_en_merged"))),
        row("wave-1 single-decode wrong + dropped", "single", "b_single", F.col("single") <= F.col("b_single")),
        row("English single-decode wrong + dropped", "en_single", "b_en_single", ~F.col("has_en") | (F.col("en_single") <= F.col("b_en_single"))),
    ]
    return both.select("run", F.explode(F.array(*checks)).alias("x")).select("run", "x.*")


def slot_gates(rows: DataFrame, slots: DataFrame, closed: list[str], most: int, scene_share: float, strict: bool = True) -> DataFrame:
    """(check, got, ok): how many slots rows (row) have; slots (row, value, cell, scene) whose values repeat, those of closed cells up to most
    times, others never (strictly) or three times; and the share of the commonest scene, of 100 slots with one or more."""
    per_row = rows.select("row").join(slots.groupBy("row").agg(F.count(F.lit(1)).alias("k")), "row", "left").fillna(0, ["k"])
    share = lambda c: F.sum(c.cast("int")) / F.count(F.lit(1))
    numbers = per_row.agg(share(F.col("k") == 1).alias("one"), share(F.col("k") >= 2).alias("more"), F.count(F.lit(1)).alias("rows"))
    values = slots.groupBy(F.col("value").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("c"), F.bool_or(F.col("cell").isin(*closed)).alias("closed"))
    repeats = values.agg(F.coalesce(F.sum(F.when(~F.coalesce("closed", F.lit(False)), F.col("c") - 1)), F.lit(0)).alias("open"), F.max("c").alias("worst"))
    scenes = slots.where("scene is not null").groupBy("scene").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("slots"), F.coalesce(F.max("c"), F.lit(0)).alias("top"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    s = one(numbers).join(one(repeats), "__one").join(one(scenes), "__one")
    limit = F.when(F.col("rows") >= 1000, scene_share).otherwise(3.5 * scene_share)
    checks = [
        F.struct(F.lit("N numbers per row").alias("check"), F.col("one").alias("got"), ((F.col("one") >= 0.55) & (F.col("more") >= 0.10)).alias("ok")),
        F.struct(F.lit("V1 slot values").alias("check"), F.col("worst").cast("double").alias("got"), ((F.col("open") <= (0 if strict else 3)) & (F.col("worst") <= most)).alias("ok")),
        F.when(F.col("slots") >= 100, F.struct(F.lit("T13 topic repetition").alias("check"), (F.col("top") / F.col("slots")).alias("got"), (F.col("top") / F.col("slots") <= limit).alias("ok"))),
    ]
    return s.where("worst is not null").select(F.explode(F.array_compact(F.array(*checks))).alias("x")).select("x.*")


def audio_gates(audio: DataFrame, tempo: tuple[float, float], exact: float, gender: tuple[float, float], most: int, shares: list[tuple[str, str, float, float]], margin: float = 0.0) -> DataFrame:
    """(check, got, ok) of planned rows (tempo, gender, voice, ...): tempos in a range and enough of them 1; two genders, each in a band; rows of
    a voice; and for each (field, value, low, high) its share, with a margin."""
    n = F.count(F.lit(1))
    share = lambda c: F.sum(c.cast("int")) / n
    one = lambda df: df.withColumn("__one", F.lit(1))
    rows = audio.agg(n.alias("n"), F.min("tempo").alias("low"), F.max("tempo").alias("high"), share(F.col("tempo") == 1.0).alias("exact"), *(share(F.coalesce(F.col(f) == v, F.lit(False))).alias(f"s{i}") for i, (f, v, *_) in enumerate(shares)))
    of = lambda field, least, greatest: audio.groupBy(field).agg(n.alias("c")).agg(F.count(F.lit(1)).alias(f"{field}s"), F.min("c").alias(least), F.max("c").alias(greatest))
    s = reduce(lambda a, b: a.join(b, "__one"), map(one, (rows, of("gender", "fewest", "most_of"), of("voice", "__v", "voiced"))))
    check = lambda name, got, ok: F.struct(F.lit(name).alias("check"), got.cast("double").alias("got"), ok.alias("ok"))
    checks: list[Column] = [
        check("A1 tempo", F.col("exact"), (F.col("low") >= tempo[0]) & (F.col("high") <= tempo[1]) & (F.col("exact") >= exact)),
        check("A2 gender share", F.col("fewest") / F.col("n"), (F.col("genders") == 2) & (F.col("fewest") / F.col("n") >= gender[0]) & (F.col("most_of") / F.col("n") <= gender[1])),
        check("A3 rows of a voice", F.col("voiced"), F.col("voiced") <= most),
    ]
    checks += [check(f"A {f}={v} share", F.col(f"s{i}"), (F.col(f"s{i}") >= low - margin) & (F.col(f"s{i}") <= high + margin)) for i, (f, v, low, high) in enumerate(shares)]
    return s.where("n > 0").select(F.explode(F.array(*checks)).alias("x")).select("x.*")


def synthetic_order(pool: DataFrame, replacing: Column, superseded: str, key: str) -> DataFrame:
    """pool with first: rows that replace others come first, each part in hash order; rows whose key a replacing one supersedes (an array) go."""
    marked = pool.withColumn("first", F.coalesce(replacing, F.lit(False)))
    gone = marked.where("first").select(F.explode(superseded).alias("__gone")).distinct()
    rest = marked.where("not first").join(gone, F.col(key) == F.col("__gone"), "left_anti")
    return marked.where("first").unionByName(rest)
