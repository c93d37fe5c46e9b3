"""Language identification: a byte convolutional network, trained in numpy on labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batched, blocks, numbered, text_buffers

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 12, 6
OVERLAP = max(WIDTHS) - 1
#: What is learned from, at most: so many documents of a language, windows of each document, and windows in all, where that leaves each
#: language LEAST_DOCUMENTS.
PER_LANGUAGE, PER_DOCUMENT, WINDOWS, LEAST_DOCUMENTS = 500, 3, 20_000, 20
EPOCHS, BATCH, RATE = 10, 64, 0.01
UNKNOWN = "und"
#: The score under which a text's language counts as not told.
LEAST = 0.3
BLOCK_BYTES = 1 << 20
#: Windows that go through the network at a time.
AT_A_TIME = 96


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of WINDOW bytes, filled up with zeros."""
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < ends[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def cut(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of windows that cover every whole text; each holds the last bytes of the one before."""
    sizes, step = np.diff(offsets), WINDOW - OVERLAP
    n = np.maximum(1, -(-(sizes - OVERLAP) // step)) * (sizes > 0)
    text = np.repeat(np.arange(len(sizes)), n)
    starts = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step
    return starts, np.minimum(starts + WINDOW, offsets[text + 1]), text


@dataclass
class Network:
    """Bytes, embedded; filters of several widths; the maximum of each over the window; softmax over the languages."""

    languages: list[str]
    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str]) -> Network:
        rng = np.random.default_rng(0)
        n = FILTERS * len(WIDTHS)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        net = cls(languages, draw(0.5, 256, DIM), draw(0.25, max(WIDTHS) * DIM, n), np.zeros(n, np.float32), draw(0.2, n, len(languages)), np.zeros(len(languages), np.float32))
        net.embed[0] = 0
        net.kernel *= mask()
        return net

    def columns(self, x: np.ndarray) -> np.ndarray:
        padded = np.pad(x, ((0, 0), (0, OVERLAP)))
        e = self.embed[padded].reshape(len(x), -1)
        return np.lib.stride_tricks.sliding_window_view(e, max(WIDTHS) * DIM, axis=1)[:, ::DIM]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        columns = np.ascontiguousarray(self.columns(x)).reshape(-1, self.kernel.shape[0])
        return (columns @ self.kernel).reshape(len(x), x.shape[1], -1)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        return log_softmax(np.maximum(self.pooled(x).max(axis=1) + self.bias, 0) @ self.out + self.out_bias)

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        rng, parts = np.random.default_rng(1), [self.embed, self.kernel, self.bias, self.out, self.out_bias]
        first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for start in range(0, len(order), BATCH):
                i = order[start : start + BATCH]
                # Windows are cut to random lengths, that short texts are learned too.
                bx = np.where(np.arange(WINDOW) < rng.integers(16, 2 * WINDOW, len(i))[:, None], x[i], 0).astype(np.uint8)
                step += 1
                for p, g, m, v in zip(parts, self.gradients(bx, y[i]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        response = self.pooled(x)
        where = response.argmax(axis=1)
        hidden = np.maximum(np.take_along_axis(response, where[:, None], 1)[:, 0] + self.bias, 0)
        d = np.exp(log_softmax(hidden @ self.out + self.out_bias))
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        dh = (d @ self.out.T) * (hidden > 0)
        columns = self.columns(x)[np.arange(len(x))[:, None], where]
        embed, padded = np.zeros_like(self.embed), np.pad(x, ((0, 0), (0, OVERLAP)))
        back = dh[..., None] * self.kernel.T
        for k in range(max(WIDTHS)):
            np.add.at(embed, np.take_along_axis(padded, where + k, 1), back[..., k * DIM : (k + 1) * DIM])
        embed[0] = 0
        return [embed, np.einsum("bf,bfk->kf", dh, columns) * mask(), dh.sum(0), hidden.T @ d, d.sum(0)]


def mask() -> np.ndarray:
    """1 where a filter reaches: narrow ones see the first bytes of a column only."""
    return np.concatenate([np.repeat(np.arange(max(WIDTHS)) < w, DIM)[:, None] * np.ones(FILTERS) for w in WIDTHS], axis=1).astype(np.float32)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; documents of fold 0 are held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5))


def learned(docs: DataFrame) -> Network | None:
    """A network for the languages of docs (doc_id, text, lang), held-out documents aside; None if there is nothing to learn from.

    Of each language it takes the PER_LANGUAGE documents that a hash of the id puts first, fewer where there are so many languages that
    these would be more than WINDOWS windows, and of each document PER_DOCUMENT windows spread over it. There may be any number of languages.
    """
    eligible = docs.where((fold() != 0) & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"))
    sizes = eligible.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()
    if not sizes:
        return None
    each = min(PER_LANGUAGE, max(LEAST_DOCUMENTS, WINDOWS // (PER_DOCUMENT * len(sizes))))
    # Twice as many are drawn as are taken, that no task has all of a language. The network too has something for each language on the driver.
    shares = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, min(1.0, 2.0 * each / n))])
    drawn = eligible.withColumn("h", F.xxhash64("id")).where(F.pmod("h", F.lit(1 << 30)) < shares[F.col("lang")] * (1 << 30))
    best = F.expr("row_number() OVER (PARTITION BY lang ORDER BY h, id)")
    chosen = drawn.distinct().withColumn("n", best).where(F.col("n") <= each).select("id", F.col("lang").alias("is_lang"))
    own = docs.select("doc_id", "lang", "text")
    texts = own.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("is_lang"))).where(F.col("text").rlike(r"\p{L}")).select(F.col("text").cast("string"), "is_lang", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in blocks(batch.column(0), BLOCK_BYTES):
                part = batch.slice(start, rows)
                data, offsets = text_buffers(part.column(0))
                starts, ends, text = cut(offsets)
                rank = np.arange(len(text)) - np.searchsorted(text, text)
                last = np.searchsorted(text, text, "right") - 1 - np.searchsorted(text, text)
                taken = np.zeros(len(text), bool)
                for k in range(PER_DOCUMENT):
                    taken |= rank == last * k // max(1, PER_DOCUMENT - 1)
                got = windows(data, starts[taken], ends[taken])
                yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(text[taken])), pa.array([x.tobytes() for x in got], pa.binary()), part.column(2).take(pa.array(text[taken]))], ["lang", "bytes", "id"])

    rows = batched(texts).mapInArrow(run, "lang string, bytes binary, id long").orderBy(F.xxhash64("id"), "bytes").collect()
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    net = Network.fresh(languages)
    net.train(np.frombuffer(b"".join(bytes(r.bytes) for r in rows), np.uint8).reshape(-1, WINDOW), np.array([languages.index(r.lang) for r in rows]))
    return net


def told(net: Network, column: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a column the number of its language, or one beyond the last where it isn't known to have letters; and its score."""
    data, offsets = text_buffers(column)
    starts, ends, text = cut(offsets)
    total = np.zeros((len(column), len(net.languages)))
    for i in range(0, len(text), AT_A_TIME):
        at = slice(i, i + AT_A_TIME)
        logs = net.log_probabilities(windows(data, starts[at], ends[at])) * (ends[at] - starts[at])[:, None]
        np.add.at(total, text[at], logs)
    p = np.exp(log_softmax(total / np.maximum(np.diff(offsets), 1)[:, None]))
    return np.where(known, p.argmax(axis=1), len(net.languages)), np.where(known, p.max(axis=1), 0.0)


def letters(text: str = "text"):
    return F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language of every whole text.

    All windows of a text are read; their log-probabilities are averaged by their bytes and normalised, and score is the greatest. A text
    that is null or has no letter, and any text where nothing was learned, is `und` with score 0. Repeated rows come back repeated. held_out
    is false where doc_id is null. Only the text goes into a prediction. Of languages with equal scores the first by name is predicted. Very
    long texts are read window by window in one task each. An empty table gives no rows. Further columns are not looked at.
    """
    if net is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*net.languages, UNKNOWN])
        for batch in batches:
            for first, rows in blocks(batch.column(3), BLOCK_BYTES):
                part = batch.slice(first, rows)
                best, score = told(net, part.column(3), part.column(2).to_numpy(zero_copy_only=False).astype(bool))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), names.take(pa.array(best)), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return batched(docs.select(F.col("doc_id").cast("long"), held_out(), letters(), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without the rows whose language can't be told: those that predicted() calls `und`, or scores under least.

    The columns stay as they are, whatever their names. Where nothing can be learned, all texts with a letter stay.
    """
    net = learned(docs)
    if net is None:
        return docs.where(letters())
    at = docs.columns.index("text")
    plain = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in blocks(batch.column(at), BLOCK_BYTES):
                part = batch.slice(first, rows)
                known = part.column(-1).to_numpy(zero_copy_only=False).astype(bool)
                _, score = told(net, part.column(at), known)
                kept = part.filter(pa.array(known & (score >= least)))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], schema=pa.schema(list(part.schema)[:-1]))

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in plain.schema])
    return batched(plain.select("*", letters(f"c{at}").alias("known"))).mapInArrow(run, schema).toDF(*docs.columns)


def held_out():
    return F.coalesce(fold() == 0, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """predicted() of docs by a network that learns from them, those of fold 0 aside."""
    return predicted(docs, learned(docs))
