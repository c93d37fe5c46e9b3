"""One row for each utterance: rows that repeat a protected one go, and of rows that repeat each other the best stays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from . import dedupe
from .common import shuffled, written

# The least text that tells an utterance, the least similarity of near copies, the share of two ranges or of two texts of one
# session, and the shingles a text of a session has at least.
KEY_CHARS, KEY_WORDS, NEAR, SHARE, LEAST = 20, 4, (4, 5), 0.5, 3
#: Seconds of a video that are joined at a time.
WIDTH = 60.0
#: The order in which reasons are looked for.
REASONS = ("audio_vox", "audio_yt", "session_text", "text", "near_text"), ("audio_vox", "audio_yt", "text", "session_text", "near_text")


def described(rows: DataFrame) -> DataFrame:
    """rows (id, caption, rank, and piece and src if there are such columns) with what tells an utterance: kind, key, s and e of its recording, its session, shingles, and keys of its text and numbers.

    rank is a column in whose order rows are gone through; it is unique. A caption read by many, of which the id or
    src says `fleurs`, has no text key of its own. piece: seconds of a video's range that the row is cut from.
    """
    name = F.col("id").cast("string")
    said = F.transform(F.split(F.coalesce("caption", F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9а-яієґ]", ""))
    folded = rows.withColumn("caption", text.unaccented("caption"))
    words = folded.withColumn("words", F.filter(said, lambda w: w != "")).withColumn("n_words", F.size(F.filter(F.split(F.coalesce("caption", F.lit("")), r"\s+"), lambda w: w != "")))
    letters = F.array_join("words", "")
    key = F.when((F.length(letters) >= KEY_CHARS) & (F.col("n_words") >= KEY_WORDS), F.sha2(letters, 256))
    numbers = F.sha2(F.array_join(F.array_sort(F.regexp_extract_all(F.coalesce("caption", F.lit("")), F.lit("[0-9]+"), F.lit(0))), " "), 256)
    base = F.regexp_replace(name, ids.PIECE, "")
    piece = F.col("piece") if "piece" in rows.columns else None
    many = name.startswith("fleurs") | (F.coalesce(F.col("src"), F.lit("")) == "fleurs" if "src" in rows.columns else F.lit(False))
    out = words.select("id", "rank", ids.recording(name, piece).alias("r"), ids.session(base).alias("session"), shingles("words").alias("shingles"), key.alias("text_key"), numbers.alias("numbers"), many.alias("many"))
    return out.select("id", "rank", "r.*", "session", "shingles", "text_key", "numbers", "many")


def shingles(words: str) -> Column:
    """Hashes of a text's three-word shingles; a shorter text is one."""
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1)))
    return F.when(F.size(words) > 0, F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice(F.col(words), i, 3))))).otherwise(F.array().cast("array<bigint>"))


def session_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b) of rows (id, session, shingles) of one session that have half the shingles of the shorter text, three at least, in common."""

    def own(df: DataFrame, n: str) -> DataFrame:
        each = df.where("session is not null").where(F.size("shingles") >= LEAST).select("session", F.col("id").alias(n), F.size("shingles").alias(f"n_{n}"), F.explode("shingles").alias("sh"))
        return each.select(F.xxhash64("session", "sh").alias("sh"), n, f"n_{n}")

    common = own(a, "a").join(shuffled(own(b, "b")), "sh").where("a <> b").groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("common"))
    return common.where(F.col("common") >= SHARE * F.least("n_a", "n_b")).select("a", "b")


def range_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    videos = lambda df: df.where("kind = 'yt'").select("key", "id", "s", "e")
    return dedupe.overlaps(videos(a), videos(b), "key", SHARE, WIDTH).where("a <> b").select("a", "b")


def near_pairs(rows: DataFrame, ahead: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), either way, of near copies among rows (id, text_key, numbers) that have equal numbers. Rows with one text key are left to it."""
    met = dedupe.meetings_within(dedupe.picked(ahead, rows.select("id")), NEAR)
    for n in ("a", "b"):
        met = met.join(shuffled(rows.select(F.col("id").alias(n), F.col("text_key").alias(f"{n}_key"), F.col("numbers").alias(f"{n}_numbers"))), n)
    near = written(dedupe.alike(written(met.where("a_numbers = b_numbers and a_key <> b_key").select("a", "b")), sets, NEAR).select("a", "b"))
    return near.union(near.select("b", "a"))


def first_of_each(rows: DataFrame, keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id) that stay when rows (id, rank) are gone through in order of rank, and one goes that shares a key (id, key) or makes a pair (a, b)
    with one that stayed before.

    Each round keeps all rows that come first in each of their keys and pairs, and drops what these cost. There are as many rounds as links
    in the longest chain; keys make no pairs.
    """
    keys = written(keys.join(rows, "id"))
    linked = pairs.join(rows.select(F.col("id").alias("a"), F.col("rank").alias("a_rank")), "a").join(rows.select(F.col("id").alias("b"), F.col("rank").alias("b_rank")), "b")
    pairs = written(linked.where("a_rank < b_rank").select("a", "b").distinct())
    dropped: list[DataFrame] = []
    while True:
        least = keys.groupBy("key").agg(F.min("rank").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        # Rows that are alone in a key are decided by their other keys.
        keys = written(keys.join(least, "key"))
        if keys.isEmpty() and pairs.isEmpty():
            break
        open_ = keys.select("id").union(pairs.select("a")).union(pairs.select("b")).distinct()
        late = keys.where("rank > least").select("id").union(pairs.select("b")).distinct()
        safe = written(open_.join(late, "id", "left_anti"))
        taken = keys.join(safe, "id", "left_semi").select("key").distinct()
        gone = keys.join(taken, "key", "left_semi").select("id").join(safe, "id", "left_anti")
        gone = written(gone.union(pairs.join(safe.select(F.col("id").alias("a")), "a", "left_semi").select("b")).distinct())
        dropped.append(gone)
        done = written(safe.union(gone))
        keys = keys.join(done, "id", "left_anti").select("id", "key", "rank")
        pairs = written(pairs.join(done.select(F.col("id").alias("a")), "a", "left_anti").join(done.select(F.col("id").alias("b")), "b", "left_anti"))
    return rows.select("id") if not dropped else rows.select("id").join(reduce(DataFrame.union, dropped), "id", "left_anti")


def deduped(train: DataFrame, protected: DataFrame) -> DataFrame:
    """(id, reason) of each row of train (id, caption, rank): null for one that stays, else the first of REASONS, with `heldout_` where a
    protected row (id, caption, rank) is the cause and `dup_` where a row of train is that stays and comes before.

    Protected rows always stay. ids are unique over both tables. A caption that several people read costs only protected copies.
    """
    train, protected = written(described(train)), written(described(protected))
    vox = lambda df: df.where("kind = 'vox'").select("id", "key")
    texts = lambda df: df.where("text_key is not null").select("id", F.col("text_key").alias("key"))
    cost = {"audio_vox": vox(train).join(vox(protected).select("key").distinct(), "key", "left_semi"), "text": texts(train).join(texts(protected).select("key").distinct(), "key", "left_semi")}
    cost |= {name: pairs(protected, train).select(F.col("b").alias("id")) for name, pairs in (("audio_yt", range_pairs), ("session_text", session_pairs))}
    *others, last = REASONS[0]
    hit = reduce(DataFrame.union, (cost[name].select("id", F.lit(i).alias("nth")) for i, name in enumerate(others)))
    hit = written(hit.groupBy("id").agg(F.min("nth").alias("nth")))

    # Near copies of protected rows are looked for among what no other reason takes, and near copies among each other among what is left then:
    # so of a large group of near copies few pairs are looked at.
    sets = train.union(protected).where("text_key is not null").select("id", "shingles")
    ahead = dedupe.shared_fronts(sets, NEAR)
    open_ = written(texts(train).select("id").join(hit, "id", "left_anti"))
    hit = written(hit.union(dedupe.similar_to_any(open_, texts(protected).select("id"), ahead, sets, NEAR).select("id", F.lit(REASONS[0].index(last)).alias("nth"))))
    left = written(train.drop("shingles").join(hit, "id", "left_anti"))

    named = {"audio_vox": vox(left), "text": texts(left.where("not many"))}
    keys = reduce(DataFrame.union, (df.select("id", F.concat(F.lit(f"{name} "), "key").alias("key")) for name, df in named.items()))
    said = dedupe.picked(train.where("session is not null").select("id", "session", "shingles"), left.select("id"))
    own = written(left.where("text_key is not null and not many").select("id", "text_key", "numbers"))
    second = {"audio_yt": written(range_pairs(left, left)), "session_text": written(session_pairs(said, said)), last: near_pairs(own, ahead, sets)}
    kept = written(first_of_each(left.select("id", "rank"), keys, reduce(DataFrame.union, second.values())).join(left.select("id", "rank"), "id"))
    gone = written(left.select("id", "rank").join(kept, "id", "left_anti"))
    causes = []
    for i, name in enumerate(REASONS[1]):
        if name in named:
            before = named[name].join(kept, "id").groupBy("key").agg(F.min("rank").alias("before"))
            found = named[name].join(gone, "id").join(before, "key").where("before < rank").select("id")
        else:
            before = kept.select(F.col("id").alias("a"), F.col("rank").alias("before"))
            found = second[name].join(before, "a").join(gone.withColumnRenamed("id", "b"), "b").where("before < rank").select(F.col("b").alias("id"))
        causes.append(found.select("id", F.lit(i).alias("nth")))
    dup = reduce(DataFrame.union, causes).groupBy("id").agg(F.min("nth").alias("nth"))
    name_of = lambda names, prefix: F.get(F.array(*[F.lit(f"{prefix}_{n}") for n in names]), F.col("nth"))
    reasons = hit.select("id", name_of(REASONS[0], "heldout").alias("reason")).union(dup.select("id", name_of(REASONS[1], "dup").alias("reason")))
    return train.select("id").join(reasons, "id", "left")
