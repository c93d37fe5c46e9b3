"""Sum-of-squares packing of pieces into sequences of a capacity."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, written

#: Tokens of a sequence; pieces that are packed in one task, about.
CAPACITY, GROUP = 1024, 8192


class Bins:
    """Open bins by their gap, and what they hold, as items (number, size)."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)
        self.by_gap: list[list[int]] = [[] for _ in range(capacity)]
        self.held: list[list[tuple[int, int]]] = []

    def put(self, item: int, size: int, gap: int) -> None:
        """Into an open bin with this gap; capacity: into a new bin."""
        if gap == self.capacity:
            at = len(self.held)
            self.held.append([])
        else:
            at = self.by_gap[gap].pop()
            self.open[gap] -= 1
        self.held[at].append((item, size))
        if gap > size:
            self.by_gap[gap - size].append(at)
            self.open[gap - size] += 1

    def least_squares(self, size: int) -> int:
        """The gap to put an item into so that the sum over gaps of squared counts of open bins becomes least; of gaps as good the smallest.

        A bin of gap g that takes the item leaves g's count and joins that of g - size, which changes the sum by 2 (open[g - size] - open[g] + 1),
        or by 1 - 2 open[g] if it becomes full; a new bin changes it by 2 open[capacity - size] + 1.
        """
        have = self.open[size : self.capacity]
        if not len(have):
            return self.capacity
        change = 2 * (self.open[: len(have)] - have + 1)
        change[0] -= 1
        change[have == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        return size + best if change[best] <= 2 * self.open[self.capacity - size] + 1 else self.capacity

    def tightest(self, size: int) -> int:
        """The smallest gap that an item fits into; capacity if none."""
        fits = np.flatnonzero(self.open[size : self.capacity])
        return size + int(fits[0]) if len(fits) else self.capacity


def bins_of(sizes: list[int], capacity: int, last: bool) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """Items by number and size in bins, and the items of bins that are to be packed again: none if last.

    Items come in order of size, the largest first, and go where the squared counts become least. Bins that are open in the end are taken apart:
    their items are packed again by the next call or, if last, here by best fit.
    """
    packed = Bins(capacity)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    for i in order:
        packed.put(i, sizes[i], packed.least_squares(sizes[i]))
    loose = {b for own in packed.by_gap for b in own}
    full = [x for b, x in enumerate(packed.held) if b not in loose]
    rest = sorted((x for b in loose for x in packed.held[b]), key=lambda x: (-x[1], x[0]))
    if not last:
        return full, [i for i, _ in rest]
    tail = Bins(capacity)
    for i, size in rest:
        tail.put(i, size, tail.tightest(size))
    # Where this is no better, the bins stay as they were.
    return full + (tail.held if len(tail.held) < len(loose) else [packed.held[b] for b in sorted(loose)]), []


def packer(capacity: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Packs one group (key, length): (key, length, sequence_id, offset), of which the last two are null for what is to be packed again."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        keys, lengths = table.column("key").to_pylist(), table.column("length").to_pylist()
        bins, rest = bins_of(lengths, capacity, last)
        item, sequence, offset = [], [], []
        for own in bins:
            at = 0
            for i, size in own:
                item.append(i)
                sequence.append(keys[own[0][0]])
                offset.append(at)
                at += size
        item, missing = item + rest, [None] * len(rest)
        columns = [keys[i] for i in item], [lengths[i] for i in item], sequence + missing, offset + missing
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["key", "length", "sequence_id", "offset"])

    return pack


def packed(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces with sequence_id long and offset long: each is in one sequence, of capacity tokens at most, in gapless places from 0.

    pieces: any columns, of which length is 1 to capacity; a null, smaller or larger length is an error. Full pieces are sequences of their own. The
    others are dealt by a hash into groups of about `group`, in each of which sums of squares decide (bins_of()). What open bins hold is dealt
    again, into fewer groups, until there is one, or until over half of it stays open, as pieces of over half a sequence do whatever is beside
    them. So no task gets more than some thousand pieces at any size. Equal lengths go by the piece's number. Repeated rows are pieces of
    their own. An empty table gives no rows. sequence_id is a number of a piece of it. Further columns come through, whatever their names.
    """
    # Numbers are written before they are used: a task that runs again gives rows other numbers.
    length = F.col("length").cast("long")
    sound = F.when((length >= 1) & (length <= capacity), length).otherwise(F.raise_error(F.concat(F.lit("no length of a piece: "), F.coalesce(length.cast("string"), F.lit("null")))).cast("long"))
    held = written(boxed(pieces, length=sound, key=F.monotonically_increasing_id()))
    sizes = held.select("key", "length")
    done = sizes.where(F.col("length") == capacity).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = sizes.where(F.col("length") < capacity)
    left, last = open_.count(), False
    before = None
    while left and not last:
        groups = math.ceil(left / group)
        last = groups == 1 or (before is not None and 2 * left > before)

        dealt = open_.select("key", "length", F.pmod(F.xxhash64("key", F.lit(left)), F.lit(groups)).alias("g"))
        round_ = written(dealt.groupBy("g").applyInArrow(packer(capacity, last), "key long, length long, sequence_id long, offset long"))
        done = done.unionByName(round_.where("sequence_id is not null").select("key", "sequence_id", "offset"))
        open_ = round_.where("sequence_id is null").select("key", "length")
        before, left = left, open_.count()
    return held.join(done.hint("shuffle_hash"), "key").select("row.*", "sequence_id", "offset")
