"""Byte-level BPE ids of whole texts: a text is cut where no merge reaches over, and each distinct unit is encoded once a worker."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, blocks, text_buffers
from .spans import Hasher, first_bytes

#: Bytes of text that are encoded at a time; of the longest unit that is remembered; units that a worker remembers.
BLOCK_BYTES, REMEMBERED_BYTES, REMEMBERED = 1 << 21, 64, 3_000_000
LETTER, PRINTED = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
PRINTED[0x21:0x7F] = True


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte ends a Latin-1 letter beyond ASCII or a sign among these; whether it ends a letter, ASCII or Latin-1."""
    before = np.zeros(len(data), np.uint8)
    before[1:] = data[:-1]
    latin = (before == 0xC3) & (data >= 0x80) & (data <= 0xBF)
    return latin, LETTER[data] | (latin & (data != 0x97) & (data != 0xB7))


def byte_names() -> dict[int, str]:
    """What a byte-level vocabulary calls each byte: printed characters by themselves, all others by the next letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units of UTF-8 texts begin: at each text, and at places that the pattern of a byte-level BPE never crosses.

    These are from a printed ASCII character or a Latin-1 letter to a space or line feed, as no part of the pattern has white space after
    anything else, and from such a letter to an ASCII mark or digit, as letters end there whatever follows.
    """
    latin, letter = letters(data)
    start = first_bytes(offsets, len(data))
    after = data[1:]
    start[1:] |= (PRINTED[data] | latin)[:-1] & ((after == 0x20) | (after == 0x0A))
    start[1:] |= letter[:-1] & PRINTED[after] & ~LETTER[after]
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts by a tokenizer of the library `tokenizers`, given as JSON. Units' ids stay in one array, found by their hashes."""

    def __init__(self, model: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        made = json.loads(model)
        before = made.get("pre_tokenizer") or {}
        #: Other kinds of tokenizers get whole texts.
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and made.get("normalizer") is None
        self.names = byte_names()
        self.special = [x["content"].encode() for x in made.get("added_tokens", ())]
        self.forget()

    @classmethod
    def of_worker(cls, kept: dict, model: str) -> Encoder:
        """One encoder for all tasks of a Python worker. kept: a dictionary of a broadcast value, of which each worker has its own copy."""
        if "encoder" not in kept:
            kept["encoder"] = cls(model)
        return kept["encoder"]

    def forget(self) -> None:
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def kept(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Puts ids at the end of the pool; where each list starts, and its length."""
        sizes = np.array([len(x) for x in ids], np.int64)
        total = int(sizes.sum())
        if self.used + total > len(self.pool):
            grown = np.zeros(2 * (self.used + total), np.uint32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        at = self.used + np.cumsum(sizes) - sizes
        self.used += total
        return at, sizes

    def words(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of units that are one word to the tokenizer's pattern: its model is asked at once."""
        names, tokenize = self.names, self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(x.decode("latin-1").translate(names))] for x in texts]

    def any(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]

    def units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, end to end, and how many each has."""
        hashes = Hasher(data)(starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        near = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        there = self.known[near] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        at, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        at[there], size[there] = self.at[near[there]], self.size[near[there]]
        new = np.flatnonzero(~there)
        used = self.used
        if len(new):
            raw, i = data.tobytes(), first[new]
            low = starts[i] + (data[starts[i]] == 0x20)
            _, letter = letters(data)
            lettered = np.append(0, np.cumsum(letter | (np.append(letter[1:], False) & (data == 0xC3))))
            word = self.cuts & (lettered[ends[i]] - lettered[low] == ends[i] - low) & (ends[i] > low)
            # Long ones stand last in the pool and are given up after this call.
            long = (ends - starts)[i] > REMEMBERED_BYTES
            for part, encode, remembered in ((new[word & ~long], self.words, True), (new[~word & ~long], self.any, True), (new[long], self.any, False)):
                if not len(part):
                    continue
                at[part], size[part] = self.kept(encode([raw[starts[k] : ends[k]] for k in first[part]]))
                if remembered:
                    place = np.searchsorted(self.known, distinct[part])
                    self.known, self.at, self.size = np.insert(self.known, place, distinct[part]), np.insert(self.at, place, at[part]), np.insert(self.size, place, size[part])
                    used = self.used
        sizes, sources = size[which], at[which]
        out = np.repeat(sources - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        ids = self.pool[out]
        self.used = used
        if len(self.known) > REMEMBERED:
            self.forget()
        return ids, sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each has. A null or empty text has none."""
        data, offsets = text_buffers(column)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        starts = unit_starts(data, offsets) if self.cuts else offsets[:-1][np.diff(offsets) > 0]
        raw = data.tobytes() if any(self.special) else b""
        whole = {int(t) for s in self.special if s and s in raw for t in self.holders(raw, s, offsets)}
        if whole:  # a special token's text may lie across units
            inner = np.isin(np.searchsorted(offsets, starts, "right") - 1, list(whole))
            starts = np.union1d(starts[~inner], offsets[sorted(whole)])
        ends = np.append(starts[1:], len(data))
        ids, sizes, begin = [], [], 0
        while begin < len(starts):
            stop = max(begin + 1, int(np.searchsorted(ends, starts[begin] + BLOCK_BYTES, "right")))
            low = starts[begin]
            a, b = self.units(data[low : ends[stop - 1]], starts[begin:stop] - low, ends[begin:stop] - low)
            ids.append(a)
            sizes.append(b)
            begin = stop
        owner = np.searchsorted(offsets, starts, "right") - 1
        return np.concatenate(ids), np.bincount(owner, np.concatenate(sizes), n).astype(np.int64)

    @staticmethod
    def holders(raw: bytes, token: bytes, offsets: np.ndarray) -> Iterator[int]:
        """Texts that hold a token's bytes, or share in them with the next, which does no harm."""
        at = raw.find(token)
        while at >= 0:
            yield int(np.searchsorted(offsets, at, "right")) - 1
            at = raw.find(token, at + 1)


def pieces(docs: DataFrame, model_file: str, end: int = 2, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids binary): every document's ids and the id `end`, cut into pieces of capacity ids if they are more.

    The first piece of a cut document has what is over, so that all others are full. start: the document's ids before the piece. ids are
    little-endian unsigned 32-bit numbers. A null or empty text is `end` alone. Repeated rows come back repeated; a null doc_id stays.
    Very long texts are encoded whole, some megabytes of units at a time. Other columns of docs are not looked at. The tokenizer's file is read on
    the driver and sent to the executors once; its size is the vocabulary's, whatever the corpus.
    """
    with open(model_file, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(({}, f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(*model.value)
        for batch in batches:
            for first, rows in blocks(batch.column(1), BLOCK_BYTES):
                part = batch.slice(first, rows)
                ids, sizes = encoder.encode(part.column(1))
                ids, sizes = np.insert(ids, np.cumsum(sizes), end), sizes + 1
                own = -(-sizes // capacity)
                text = np.repeat(np.arange(rows), own)
                nth = np.arange(len(text)) - np.repeat(np.cumsum(own) - own, own)
                over = (sizes - (own - 1) * capacity)[text]
                start = np.where(nth == 0, 0, over + (nth - 1) * capacity)
                length = np.where(nth == 0, over, capacity)
                bounds = np.append(0, np.cumsum(length) * 4)
                data = pa.py_buffer(ids.astype("<u4").tobytes())
                held = pa.Array.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), data]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), held], ["doc_id", "piece", "start", "length", "ids"])

    return batched(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")
