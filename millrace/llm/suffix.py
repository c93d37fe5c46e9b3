"""Removal of byte strings that repeat across documents, found in the sorted suffixes of collections that grow column by column.

Every window of SPAN bytes has a key, the least rank of its pieces of PIECE bytes, which is a hash with frequent pieces last, so equal windows have equal keys. Neighbouring windows with
one key make a segment. Segments are dealt out by key; of those that share a key, the suffixes are sorted column-wise: each round puts one
symbol of every segment, from its end on, before the suffix that the round before placed. Windows that stand together in the order and have
SPAN bytes in common are equal; the least doc_id of a run of equal windows owns it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, blocks, text_buffers, written
from .spans import MIX, mixed

SPAN, PIECE = 50, 16
REACH = SPAN - PIECE + 1
#: Windows of a segment, and bytes of the longest.
WINDOWS = 64
LONGEST = SPAN + WINDOWS - 1
WIDTH = -(-LONGEST // 8) * 8
#: Bytes of text that are cut into segments at a time; whose repeats a task settles by itself before it sends segments on; of one partition, about.
CUT_BYTES, COMBINED_BYTES, BUCKET_BYTES = 1 << 20, 12 << 20, 12 << 20
#: Buckets, and places of texts, for each partition: a partition gets several by a hash, so that none gets many times what others get.
FINE = 3
#: Pieces in a share of FREQUENT of the documents in a sample rank last: HOT_PIECES at most. The sample has about SAMPLE documents or
#: SAMPLE_BYTES, whichever is less, and is counted in SAMPLE_PARTS tasks.
SAMPLE, SAMPLE_BYTES, SAMPLE_PARTS, FREQUENT, HOT_PIECES = 2_000, 8 << 20, 4, 0.02, 200_000
#: How blocks of segments are compressed.
CODEC = ("zstd", 3)
#: Segments sorted at a time; compared at a time.
SORTED, AT_A_TIME = 1024, 1 << 14


@dataclass
class Segments:
    """Segments: key, doc_id, number of the text, place of the first window in it, number of windows, and where they start in pool.

    pool: bytes of text, with WIDTH zeros behind.
    """

    key: np.ndarray
    doc: np.ndarray
    row: np.ndarray
    at: np.ndarray
    n: np.ndarray
    start: np.ndarray
    pool: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.key, self.doc, self.row, self.at, self.n, self.start]

    def __len__(self) -> int:
        return len(self.key)

    def __getitem__(self, i) -> Segments:
        return Segments(*(x[i] for x in self.parts()), self.pool)

    def sizes(self) -> np.ndarray:
        return self.n.astype(np.int64) + SPAN - 1

    def bytes(self) -> np.ndarray:
        """The bytes of each segment as a row of WIDTH, zeros behind."""
        got = np.lib.stride_tricks.sliding_window_view(self.pool, WIDTH)[self.start]
        got[np.arange(WIDTH) >= self.sizes()[:, None]] = 0
        return got

    @classmethod
    def joined(cls, many: list[Segments]) -> Segments:
        shift = np.cumsum([0, *(len(s.pool) - WIDTH for s in many)])
        key, doc, row, at, n = (np.concatenate(x) for x in list(zip(*(s.parts() for s in many), strict=True))[:5])
        start = np.concatenate([s.start + x for s, x in zip(many, shift, strict=False)])
        return cls(key, doc, row, at, n, start, padded(*(s.pool[:-WIDTH] for s in many)))


def padded(*parts: np.ndarray) -> np.ndarray:
    return np.concatenate([*parts, np.zeros(WIDTH, np.uint8)])


class Hot:
    """Pieces of bytes that very many documents have. They rank behind all others, so that a window takes its key from one only if it has no other."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.sort(values.astype(np.uint64))
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.values >> np.uint64(43)).astype(np.int64)] = True

    def marked(self, h: np.ndarray) -> np.ndarray:
        h = h >> np.uint64(1)
        if len(self.values):
            at = np.flatnonzero(self.table[(h >> np.uint64(43)).view(np.int64)])
            there = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
            h[at[self.values[there] == h[at]]] |= np.uint64(1 << 63)
        return h


NONE = Hot(np.zeros(0, np.uint64))


def pieces(data: np.ndarray) -> np.ndarray:
    """A hash of the PIECE bytes from each place on."""
    n = len(data) - PIECE + 1
    data = np.ascontiguousarray(data)
    a, b = np.ndarray((n,), "<u8", data, 0, (1,)), np.ndarray((n,), "<u8", data, PIECE - 8, (1,))
    h = (a * np.uint64(0xA0761D6478BD642F)) ^ ((b ^ (b >> np.uint64(29))) * np.uint64(0xE7037ED1A0B428DB))
    return (h ^ (h >> np.uint64(32))) * MIX


def keys(data: np.ndarray, hot: Hot) -> np.ndarray:
    """The key of the window at each place of data that has one: the rank of its first piece in order of rank."""
    n = len(data) - PIECE + 1
    least, wide = hot.marked(pieces(data)), 1
    while 2 * wide <= REACH:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    return np.minimum(least[: n - REACH + 1], least[REACH - wide :]) if wide < REACH else least


def cut(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, row: np.ndarray, base: np.ndarray, hot: Hot) -> Segments | None:
    """The segments of pieces of text; base: where a piece begins in its text."""
    if len(data) < SPAN:
        return None
    key = keys(data, hot)
    n = len(key)
    valid = np.zeros(n + 1, np.int32)
    long = np.diff(offsets) >= SPAN
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, np.minimum(offsets[1:][long] - SPAN + 1, n), -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | ~valid[:-1]
    new[offsets[:-1][offsets[:-1] < n]] = True
    new[0] = True
    first = np.flatnonzero(new)
    size = np.add.reduceat(valid.astype(np.int64), first)
    keep = size > 0
    first, size = first[keep], size[keep]
    if not len(first):
        return None
    parts = -(-size // WINDOWS)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    at = np.repeat(first, parts) + nth * WINDOWS
    count = np.minimum(WINDOWS, np.repeat(size, parts) - nth * WINDOWS)
    text = np.searchsorted(offsets, at, "right") - 1
    return Segments(key[at], doc[text], row[text], at - offsets[text] + base[text], count.astype(np.uint8), at, padded(data))


def segments(docs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], hot: Hot = NONE) -> Iterator[Segments]:
    """Segments of (data, offsets, doc, row) texts; a text longer than CUT_BYTES is cut with SPAN - 1 bytes in common."""
    for data, offsets, doc, row in docs:
        size = np.diff(offsets)
        pieces = np.maximum(1, -(-(size - SPAN + 1) // CUT_BYTES))
        text = np.repeat(np.arange(len(size)), pieces)
        base = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * CUT_BYTES
        start = offsets[text] + base
        end = np.minimum(start + CUT_BYTES + SPAN - 1, offsets[text + 1])
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(start, start[i] + CUT_BYTES, "left")))
            if pieces[text[i]] > 1:
                j = i + 1
            elif (split := np.flatnonzero(pieces[text[i:j]] > 1)).size:
                j = i + int(split[0])
            part = cut(data[start[i] : end[j - 1]], np.append(start[i:j], end[j - 1]) - start[i], doc[text[i:j]], row[text[i:j]], base[i:j], hot)
            if part is not None:
                yield part
            i = j


def digests(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for x in np.ascontiguousarray(rows).view("<u8").T:
        h = (h ^ x) * MIX
        h ^= h >> np.uint64(29)
    return mixed(h)


def window_classes(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each segment and window a number; equal windows have equal numbers. Unused places have -1.

    The sorted suffixes are held as the inverse of their Burrows-Wheeler transform: for each, its first symbol and the rank of what follows
    it. Round r inserts the suffix of r symbols of every segment that has so many: its place is found by its symbol and the rank of the
    suffix of r - 1 symbols, and ranks behind a place move up. Segments end in marks of their own, smaller than any symbol.
    """
    order = np.argsort(-sizes, kind="stable")
    rows, sizes = rows[order], sizes[order]
    n, whole = len(rows), int(sizes.sum())
    kind, rank_bits = (np.int32, 22) if whole + n < 1 << 22 else (np.int64, 40)
    rank_mask = kind((1 << rank_bits) - 1)
    held, owner, rank = np.arange(n, dtype=kind), np.arange(n, dtype=kind) * kind(WIDTH + 1), np.arange(n, dtype=kind)
    every = np.arange(whole + n, dtype=kind)
    for r in range(1, int(sizes[0]) + 1):
        live = int(np.searchsorted(-sizes, -r, "right"))
        fresh = ((rows[every[:live], sizes[:live] - r].astype(kind) + kind(1)) << kind(rank_bits)) | rank[:live]
        by = np.argsort(fresh).astype(kind)
        fresh = fresh[by]
        place = np.searchsorted(held, fresh).astype(kind)
        moved = np.zeros(len(held) + 1, kind)
        step = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        moved[place[step]] = np.diff(np.append(step, live))
        np.cumsum(moved, out=moved)
        held += moved[held & rank_mask]
        fresh += moved[fresh & rank_mask]
        there = every[: len(held)] + moved[:-1]
        here = place + every[:live]
        merged, owners = np.empty(len(held) + live, kind), np.empty(len(held) + live, kind)
        merged[there], merged[here] = held, fresh
        owners[there], owners[here] = owner, by * kind(WIDTH + 1) + kind(r)
        held, owner = merged, owners
        rank[by] = here
    segment, left = owner // (WIDTH + 1), owner % (WIDTH + 1)
    long = left >= SPAN
    segment, at = segment[long].astype(np.int64), sizes[segment[long]] - left[long]
    new = np.ones(len(segment), bool)
    flat = np.ascontiguousarray(rows).reshape(-1)
    windows = np.lib.stride_tricks.sliding_window_view(flat, SPAN)
    for i in range(1, len(segment), 1 << 16):
        own = slice(i, min(i + (1 << 16), len(segment)))
        before = slice(own.start - 1, own.stop - 1)
        new[own] = (windows[segment[own] * rows.shape[1] + at[own]] != windows[segment[before] * rows.shape[1] + at[before]]).any(axis=1)
    out = np.full((n, WINDOWS), -1, np.int64)
    out[order[segment], at] = np.cumsum(new) - 1
    return out


def portions(u: np.ndarray, group: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Parts of u, which is in order of group, with about size members each, groups whole."""
    start = 0
    while start < len(u):
        stop = start + int(np.searchsorted(group[u[start:]], group[u[min(start + size, len(u)) - 1]], "right"))
        yield u[start:stop]
        start = stop


def likely(s: Segments, group: np.ndarray, hot: Hot) -> np.ndarray:
    """Which segments may have a window in common with another one of their group.

    Windows of one group all hold the piece with the least hash. Equal windows agree on half of the rest of a window before it or after it.
    Segments that agree with no other one in either half are let go; where the piece is in a segment twice, the whole group stays.
    """
    n, half, sizes = len(s), (SPAN - PIECE) // 2, s.sizes()
    flat = padded(s.bytes().reshape(-1))
    hashes = hot.marked(pieces(flat)[: n * WIDTH]).reshape(n, WIDTH)
    hashes[np.arange(WIDTH) > (sizes - PIECE)[:, None]] = ~np.uint64(0)
    at = hashes.argmin(axis=1)
    twice = (hashes == hashes[np.arange(n), at][:, None]).sum(axis=1) > 1
    keep = np.zeros(group.max() + 1, bool)
    keep[group[twice]] = True
    keep = keep[group]
    windows = np.lib.stride_tricks.sliding_window_view(flat, half)
    for start in (at - half, at + PIECE):
        there = np.flatnonzero((start >= 0) & (start + half <= sizes))
        if not len(there):
            continue
        row = np.zeros((len(there), -(-half // 8) * 8), np.uint8)
        row[:, :half] = windows[there * WIDTH + start[there]]
        key = mixed(digests(row) + group[there].astype(np.uint64) * MIX)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        shared = np.append(same, False) | np.append(False, same)
        keep[there[order[shared]]] = True
    return keep


def resolved(s: Segments, hot: Hot = NONE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of segments that share their key with another doc_id's, and for each of their windows the least doc_id that has it; in portions."""
    order = np.argsort(s.key, kind="stable")
    key, doc = s.key[order], s.doc[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    shared = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
    active = order[np.repeat(shared, np.diff(np.append(first, len(key))))]
    for part in portions(active, s.key, AT_A_TIME):
        yield owned(s, part, hot)


def owned(s: Segments, active: np.ndarray, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """These segments, in some order, and the owners of their windows."""
    # Equal segments enter the collection once, with their least doc_id.
    digest = np.concatenate([digests(s[active[i : i + AT_A_TIME]].bytes()) for i in range(0, len(active), AT_A_TIME)]) + s.n[active]
    by = np.lexsort((digest, s.key[active]))
    active, digest = active[by], digest[by]
    key = s.key[active]
    distinct = np.append(True, (digest[1:] != digest[:-1]) | (key[1:] != key[:-1]))
    heads = np.flatnonzero(distinct)
    own = np.minimum.reduceat(s.doc[active], heads)
    least = np.repeat(own[:, None], WINDOWS, axis=1)
    head_key = key[heads]
    group = np.cumsum(np.append(True, head_key[1:] != head_key[:-1])) - 1
    u = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(u):
        u = u[likely(s[active[heads[u]]], group[u], hot)]
    for v in portions(u, group, SORTED):
        chosen = s[active[heads[v]]]
        classes = window_classes(chosen.bytes(), chosen.sizes())
        used = classes >= 0
        best = np.full(classes.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, classes[used], np.broadcast_to(own[v][:, None], classes.shape)[used])
        least[v] = np.where(used, best[classes], least[v])
    return active, least[np.cumsum(distinct) - 1]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and end column of each run of set flags."""
    edge = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    edge[:, 1:-1] = flags
    step = np.diff(edge, axis=1)
    row, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return row, a, b


def settled(s: Segments, forward: bool, hot: Hot = NONE) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], Segments | None]:
    """(row, start, end) of bytes that another, smaller doc_id among these segments has too; with forward, the segments of all other windows."""
    found, rest, alone = [], [], np.ones(len(s), bool)
    for active, least in resolved(s, hot):
        used = np.arange(WINDOWS) < s.n[active][:, None]
        gone = used & (least < s.doc[active][:, None])
        i, a, b = runs(gone)
        at = s.at[active[i]]
        found.append((s.row[active[i]], at + a, at + b - 1 + SPAN))
        if forward and len(i):
            alone[active] = False
            i, a, b = runs(used & ~gone)
            x = s[active[i]]
            rest.append([x.key, x.doc, x.row, x.at + a, (b - a).astype(np.uint8), x.start + a])
    ranges = tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    if not forward:
        return ranges, None
    return ranges, Segments(*(np.concatenate(x) for x in zip([x[alone] for x in s.parts()], *rest, strict=True)), s.pool)


def grouped(group: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, its members) in an order in which groups are whole."""
    if len(order):
        heads = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
        for a, b in zip(heads, np.append(heads[1:], len(order)), strict=True):
            yield int(group[order[a]]), order[a:b]


def packed(s: Segments, version: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, block): the segments of each bucket, their columns end to end, compressed. version: of each text, tells texts of one doc_id apart."""
    codec = pa.Codec(CODEC[0], compression_level=CODEC[1])
    bucket = (s.key % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((s.at, s.row, bucket))
    for b, at in grouped(bucket, order):
        own = s[at]
        rows, number = np.unique(own.row, return_inverse=True)
        docs = np.zeros(len(rows), np.int64)
        docs[number] = own.doc
        inside = np.arange(WIDTH) < own.sizes()[:, None]
        head = np.array([len(own), len(rows)], np.int64)
        columns = [head, np.diff(docs, prepend=0), version[rows], np.diff(number, prepend=0).astype(np.int32), np.diff(own.at, prepend=0), own.n, own.bytes()[inside]]
        raw = b"".join(x.tobytes() for x in columns)
        yield b, codec.compress(raw, asbytes=True) + len(raw).to_bytes(8, "little")


def unpacked(block: bytes, hot: Hot) -> tuple[Segments, np.ndarray, np.ndarray]:
    """A block's segments, and doc_id and version of its texts. Keys are not sent but taken from the bytes again."""
    raw = pa.decompress(block[:-8], decompressed_size=int.from_bytes(block[-8:], "little"), codec=CODEC[0], asbytes=True)
    n, rows = np.frombuffer(raw, np.int64, 2)
    at = 16

    def take(kind, count) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(raw, kind, count, at)
        at += got.nbytes
        return got

    docs, version, number, step, count = take(np.int64, rows), take(np.int32, rows), take(np.int32, n), take(np.int64, n), take(np.uint8, n)
    pool = padded(take(np.uint8, len(raw) - at))
    docs, number = np.cumsum(docs), np.cumsum(number)
    sizes = count.astype(np.int64) + SPAN - 1
    ends = np.cumsum(sizes)
    rank = hot.marked(pieces(pool)[: ends[-1]])
    for i in range(PIECE - 1):
        rank[ends - 1 - i] = ~np.uint64(0)
    key = np.minimum.reduceat(rank, ends - sizes)
    return Segments(key, docs[number], number, np.cumsum(step), count.copy(), np.cumsum(sizes) - sizes, pool), docs, version.copy()


def by_place(row: np.ndarray, a: np.ndarray, b: np.ndarray, docs: np.ndarray, version: np.ndarray, places: int) -> Iterator[tuple[int, bytes]]:
    """(place, block): ranges of texts for each place that puts texts together again, compressed."""
    place = version[row] % places
    order = np.lexsort((a, row, place))
    for p, own in grouped(place, order):
        raw = b"".join(x.tobytes() for x in (docs[row[own]], a[own].astype(np.int64), b[own].astype(np.int64), version[row[own]]))
        yield p, pa.compress(raw, codec="zstd", asbytes=True) + len(raw).to_bytes(8, "little")


def placed_ranges(blocks_: list[bytes]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """The ranges of each text, by doc_id and version, united and in order."""
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for block in blocks_:
        raw = pa.decompress(block[:-8], decompressed_size=int.from_bytes(block[-8:], "little"), codec="zstd", asbytes=True)
        n = len(raw) // 28
        for k, x in enumerate((*np.frombuffer(raw, np.int64, 3 * n).reshape(3, n), np.frombuffer(raw, np.int32, n, 24 * n))):
            columns[k].append(x)
    if not columns[0]:
        return {}
    doc, a, b, version = (np.concatenate(c) for c in columns)
    order = np.lexsort((a, version, doc))
    doc, a, b, version = doc[order], a[order], b[order], version[order]
    text = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])))
    # Shifted by their text's number, ranges of different texts don't meet.
    shift = np.repeat(np.arange(len(text)), np.diff(np.append(text, len(doc)))) * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + shift)
    heads = np.flatnonzero(np.append(True, (a + shift)[1:] > reach[:-1]))
    ends = np.maximum.reduceat(b, heads)
    first = np.append(np.searchsorted(heads, text), len(heads))
    spans = list(zip(a[heads].tolist(), ends.tolist(), strict=True))
    return {(d, v): spans[x:y] for d, v, x, y in zip(doc[text].tolist(), version[text].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)}


def hot_pieces(docs: DataFrame, n: int, total: int) -> np.ndarray:
    """The pieces that FREQUENT of some documents have: of about SAMPLE of the n documents or SAMPLE_BYTES of the total, by a hash of the id.

    Which pieces these are changes no result, only where segments meet: without them, the texts around a passage that a third of all
    documents have would meet in one bucket.
    """
    share = min(1.0, SAMPLE / max(n, 1), SAMPLE_BYTES / max(total, 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = [], 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            found += [np.unique(pieces(data[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            rows += batch.num_rows
        if found:
            value, times = np.unique(np.concatenate(found) >> np.uint64(1), return_counts=True)
            often = times >= max(2, FREQUENT * rows)
            yield pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(times[often])], ["piece", "n"])

    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("text")
    # A piece that is frequent in the sample is so in one of its parts.
    counts = drawn.repartition(SAMPLE_PARTS).mapInArrow(count, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "piece").limit(HOT_PIECES).select("piece").toPandas()
    return rows["piece"].to_numpy(np.int64).view(np.uint64)


def ranges(docs: DataFrame, parts: int, n: int, total: int) -> DataFrame:
    """(place, block): the bytes to remove from n texts (doc_id, version, text), in blocks for the place of each text: its version modulo
    FINE * parts."""
    buckets = FINE * parts
    frequent = docs.sparkSession.sparkContext.broadcast(hot_pieces(docs, n, total))
    sent_names, block_names = ["bucket", "place", "block"], ["place", "block"]

    def found(row, a, b, ids, version) -> Iterator[pa.RecordBatch]:
        for place, block in by_place(row, a, b, ids, version, buckets):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.array([place], pa.int32()), pa.array([block], pa.binary())], sent_names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = Hot(frequent.value)
        held: list[Segments] = []
        texts: list[tuple[np.ndarray, np.ndarray]] = []
        rows = size = 0

        def out() -> Iterator[pa.RecordBatch]:
            ids, version = (np.concatenate(x) for x in zip(*texts, strict=True))
            gone, rest = settled(Segments.joined(held), True, hot)
            held.clear()
            yield from found(*gone, ids, version)
            for bucket, block in packed(rest, version, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.nulls(1, pa.int32()), pa.array([block], pa.binary())], sent_names)

        for batch in batches:
            for start, n in blocks(batch.column(2), CUT_BYTES):
                part = batch.slice(start, n)
                data, offsets = text_buffers(part.column(2))
                held += segments([(data, offsets, part.column(0).to_numpy(), np.arange(rows, rows + n))], hot)
                texts.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
                rows, size = rows + n, size + len(data)
                if size >= COMBINED_BYTES:
                    if held:
                        yield from out()
                    held, texts, rows, size = [], [], 0, 0
        if held:
            yield from out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = Hot(frequent.value)
        by: dict[int, list[bytes]] = {}
        for batch in batches:
            sent = batch.column(0).is_valid()
            ready = batch.filter(pa.compute.invert(sent))
            if ready.num_rows:
                yield ready.select(block_names)
            for bucket, block in zip(*(batch.filter(sent).column(i).to_pylist() for i in (0, 2)), strict=True):
                by.setdefault(bucket, []).append(block)
        for bucket in list(by):
            got, ids, version, rows = [], [], [], 0
            for block in by.pop(bucket):
                s, x, y = unpacked(block, hot)
                s.row += rows
                got.append(s)
                ids.append(x)
                version.append(y)
                rows += len(x)
            s = Segments.joined(got)
            got.clear()
            gone, _ = settled(s, False, hot)
            for batch in found(*gone, np.concatenate(ids), np.concatenate(version)):
                yield batch.select(block_names)

    sent = batched(docs).mapInArrow(send, "bucket int, place int, block binary")
    return sent.repartition(parts, F.coalesce("bucket", "place")).mapInArrow(meet, "place int, block binary")


def deduplicated(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every document: its text without the bytes that a string of SPAN bytes
    covers which also starts in a document with a smaller doc_id. kept is null without with_text.

    A null text counts as empty. A null doc_id is smaller than none, and its text keeps all and costs no other text anything. Rows with one
    doc_id cost each other nothing, so repeated rows come back repeated. An empty table gives no rows. Bytes, not characters, are removed,
    so kept may be no whole UTF-8. Further columns are not looked at.
    """
    # The version tells texts of one doc_id apart.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.hash("text", "doc_id").alias("version"), "text")
    total = own.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("text").alias("n")).first()
    parts = max(1, -(-(total.bytes or 0) // BUCKET_BYTES))
    gone = written(ranges(own.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= SPAN)), parts, total.n, total.bytes or 0))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] = []
        ranges_of: dict | None = None
        for batch in batches:
            texts = batch.column(0).is_null()
            waiting += batch.filter(pa.compute.invert(texts)).column(0).to_pylist()
            batch = batch.filter(texts)
            if not batch.num_rows:
                continue
            # Ranges come before texts.
            if ranges_of is None:
                ranges_of = placed_ranges(waiting)
                waiting.clear()
            for start, n in blocks(batch.column(3), CUT_BYTES):
                part = batch.slice(start, n)
                sizes, removed, counts, digest, kept = [], [], [], [], []
                for doc, version, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3), strict=True):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    spans = ranges_of.get((doc, version), ())
                    edges = [0, *(x for span in spans for x in span), len(raw)]
                    rest = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if spans else raw
                    sizes.append(len(raw))
                    removed.append(len(raw) - len(rest))
                    counts.append(len(spans))
                    digest.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest if with_text else None)
                yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    texts = own.select(F.pmod("version", F.lit(FINE * parts)).cast("int").alias("place"), F.lit(None).cast("binary").alias("block"), "doc_id", "version", "text")
    both = gone.select("place", "block", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("version"), F.lit(None).cast("string").alias("text")).unionByName(texts)
    together = both.repartition(parts, "place").sortWithinPartitions(F.col("block").isNull())
    return together.select("block", "doc_id", "version", "text").mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
