"""Quality rules: plain counts of a text, and a likelihood ratio between trusted documents and the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordering
from .common import batched, blocks, text_buffers, written
from .spans import K1, K2, K3, Hasher, mixed, per_text, repeated, words

BITS = 16
#: Trusted ids that are broadcast, at most; more meet the texts in a shuffle.
BROADCAST_IDS = 400_000
#: The share of the trusted documents that the threshold may cost.
LOSS = 0.005
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*b"#*$%&|<>"]] = True
BLOCK_BYTES = 1 << 20


def counts(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, found: tuple) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    starts, ends, text = found
    n = len(offsets) - 1
    out = {"n_words": np.bincount(text, minlength=n)}
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    out["word_chars"] = per_text(np.cumsum(inside[:-1], dtype=np.int8).astype(bool) & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = per_text(SYMBOLS[data], offsets)

    feeds = np.flatnonzero(data == 0x0A)
    line_starts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_text = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offsets[line_text + 1])
    line_ends -= (line_ends > line_starts) & (data[np.maximum(line_ends - 1, 0)] == 0x0A)
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    a, b, line_text = line_starts[filled], line_ends[filled], line_text[filled]
    later, _ = repeated(mixed(hasher(a, b) + line_text.astype(np.uint64) * K1))
    out["n_dup_lines"] = np.bincount(line_text[later], minlength=n)

    covered = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        h = hasher(starts, ends)
        whole = text[2:] == text[:-2]
        key = mixed(h[:-2] * K1 + h[1:-1] * K2 + h[2:] * K3 + mixed(text[2:].astype(np.uint64)))[whole]
        _, twice = repeated(key)
        at = np.flatnonzero(whole)[twice]
        for i in range(3):
            covered[at + i] = True
    out["n_repeat_words"] = np.bincount(text[covered], minlength=n)
    return out


def buckets(hasher: Hasher, found: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the words and word pairs, and their text numbers."""
    starts, ends, text = found
    h = hasher(starts, ends)
    pair = text[1:] == text[:-1]
    both = mixed(h[:-1] * K1 + h[1:] * K2)[pair]
    return (np.concatenate([h, both]) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([text, text[1:][pair]])


def labelled(labels: DataFrame, quality: int, most: int | None = None) -> DataFrame:
    """The distinct ids of all documents with this label and no other, or of so many, the first by a hash. One toxic label makes it 0."""
    toxic = F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)))
    ids = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("a"), F.max("quality").alias("b"), toxic.alias("toxic"))
    same = (F.col("a") == quality) & (F.col("b") == quality)
    chosen = (same | F.col("toxic")) if quality == 0 else (same & ~F.col("toxic"))
    own = ids.where(chosen).select("label_id")
    return own if most is None else own.orderBy(F.xxhash64("label_id"), "label_id").limit(most)


def ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each bucket: trusted documents against all documents, each count raised by one."""
    met = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted.hint("shuffle_merge")
    marked = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(met, F.col("id") == F.col("label_id"), "left").select(F.col("label_id").isNotNull(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            target = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for start, rows in blocks(batch.column(1), BLOCK_BYTES):
                data, offsets = text_buffers(batch.column(1).slice(start, rows))
                bucket, text = buckets(Hasher(data), words(data, offsets))
                total[0] += np.bincount(bucket, minlength=1 << BITS)
                total[1] += np.bincount(bucket[target[start : start + rows][text]], minlength=1 << BITS)
        full = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[0][full]), pa.array(total[1][full])], ["bucket", "corpus", "target"])

    rows = batched(marked).mapInArrow(run, "bucket long, corpus long, target long").groupBy("bucket").agg(F.sum("corpus"), F.sum("target")).toPandas().to_numpy(np.int64)
    total = np.ones((2, 1 << BITS))
    total[:, rows[:, 0]] += rows[:, 1:].T
    if total[1].sum() == total.shape[1]:
        return np.zeros(1 << BITS)
    return np.log(total[1] / total[1].sum()) - np.log(total[0] / total[0].sum())


def measured(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, the counts, score): score is the mean ratio of a text's words and word pairs, null without one."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in blocks(batch.column(1), BLOCK_BYTES):
                part = batch.slice(start, rows)
                data, offsets = text_buffers(part.column(1))
                hasher, found = Hasher(data), words(data, offsets)
                got = counts(data, offsets, hasher, found)
                bucket, text = buckets(hasher, found)
                n = np.bincount(text, minlength=rows)
                score = np.bincount(text, ratio[bucket], minlength=rows) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[k], pa.int64()) for k in names), pa.array(score, mask=n == 0)], ["doc_id", *names, "score"])

    return batched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, f"doc_id long, {', '.join(f'{k} long' for k in names)}, score double")


def threshold(scores: DataFrame, loss: float = LOSS) -> float:
    """The score that parts trusted from rejected documents (good, score) best, of those under which a share of loss of the trusted ones fall
    at most. Ranks come from ranges of the scores' order; the driver gets one row."""
    n = scores.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).first()
    if not n.good:
        return -np.inf
    marks = scores.groupBy("score").agg(F.count_if("good").alias("t"), F.count_if(~F.col("good")).alias("r"))
    line = ordering.placed(marks, [F.col("score")])
    line = written(ordering.before(written(line), [], F.col("t"), "lost"))
    line = written(line.join(ordering.before(line, [], F.col("r"), "caught").select("turn", "caught"), "turn"))
    highest = line.where(F.col("lost") + F.col("t") > int(loss * n.good)).agg(F.min("score")).first()[0]
    if not n.bad:
        return float(highest)
    gain = F.col("caught") * n.good - F.col("lost") * n.bad
    best = line.where(F.col("score") <= highest).agg(F.max(F.struct(gain, -F.col("turn"), "score"))["score"]).first()[0]
    # As far below the best mark as above the next lower score.
    below = line.where(F.col("score") < best).agg(F.max("score")).first()[0]
    return float((best + (best if below is None else below)) / 2)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the five counts, base_failed, score, kept) of every document.

    base_failed: under 50 words, or more than half the words repeat. kept: not base_failed, and a score of the threshold or more. Corpus
    counts are taken over all documents, trusted counts over half of all trusted ones, the threshold over the other half and all rejected ones. A document with a
    toxic label is rejected, whatever its quality; others whose labels contradict each other count as unlabelled. A null or blank text has no words and fails the base. Without trusted labels the base
    alone decides. Repeated rows come back repeated.
    """
    good, bad = labelled(labels, 1), labelled(labels, 0)
    # The threshold comes from other trusted documents than the counts: those that were counted score higher than any new one.
    counted = F.pmod(F.xxhash64("label_id", F.lit("counted")), F.lit(2)) == 0
    rows = written(measured(docs, ratios(docs, written(good.where(counted)))))
    known = good.select("label_id", F.lit(True).alias("good"), counted.alias("counted")).union(bad.select("label_id", F.lit(False), F.lit(False)))
    scores = written(rows.where("n_words > 0").select("doc_id", "score").join(known, F.col("doc_id") == F.col("label_id")).select("good", "counted", "score"))
    fresh = scores.where("not good or not counted")
    least = threshold(scores if fresh.where("good").isEmpty() else fresh)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))
