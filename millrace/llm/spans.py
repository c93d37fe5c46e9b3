"""Words, lines and hashes of many texts at a time, as numpy arrays over their UTF-8 bytes end to end."""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers. BASE has an inverse modulo 2^64.
BASE, MIX, K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i up to n at least; kept for the next call."""
    have = next(iter(_powers), 0)
    if have < n + 1:
        _powers.clear()
        size = max(n + 1, 1 << 20)
        ones = np.ones(size, np.uint64)
        up, down = ones * BASE, ones * INVERSE
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return next(iter(_powers.values()))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(32))


class Hasher:
    """64-bit hashes of any spans of data: equal bytes have equal hashes, wherever they stand."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * K3)


def first_bytes(offsets: np.ndarray, n: int) -> np.ndarray:
    """Whether a byte is the first of its text."""
    out = np.zeros(n + 1, bool)
    out[offsets] = True
    return out[:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words, which are runs of other bytes than white space and don't cross texts."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    letter, first = ~SPACES[data], first_bytes(offsets, len(data))
    start = letter.copy()
    start[1:] &= ~letter[:-1] | first[1:]
    end = letter.copy()
    end[:-1] &= ~letter[1:] | first[1:]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Set bytes of each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items have a key that an earlier one has; which have a key that any other has."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    return later, any_
