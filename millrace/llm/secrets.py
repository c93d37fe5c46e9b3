"""Secret scans: three fixed patterns, and a linear-chain conditional random field over tokens that finds what they miss."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase, digits

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batched, blocks, numbered, text_buffers
from .spans import Hasher, first_bytes, per_text

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)".replace(b"(password|passwd|secret|token|api_?key)", b"((?i:password|passwd|secret|token|api_?key))"))
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

OUTSIDE, BEGIN, INSIDE = range(3)
#: Learned from, at most: documents drawn by a hash of the id; pieces of REACH tokens to either side of a pattern's match, and of other tokens.
DOCUMENTS, MATCHES, OTHERS, REACH = 6_000, 300, 800, 8
STEPS, RATE, DECAY = 100, 0.15, 3e-4
BLOCK_BYTES = 1 << 20

LOWER, UPPER, DIGIT, HEX, TOKEN = (np.zeros(256, bool) for _ in range(5))
LOWER[[*range(ord("a"), ord("z") + 1)]] = True
UPPER[[*range(ord("A"), ord("Z") + 1)]] = True
DIGIT[[*range(ord("0"), ord("9") + 1)]] = True
HEX[[*b"0123456789abcdef"]] = True
TOKEN[:] = LOWER | UPPER | DIGIT
TOKEN[[*b"_+/.-"]] = True
TOKEN[128:] = True
#: Kinds of bytes: lower, upper, digit, other; places where they change tell a made-up string from a word.
KIND = (LOWER + 2 * UPPER + 3 * DIGIT).astype(np.uint8)
SHAPES, MIXES, CONTEXTS, FILES = 8 * 8 * 2 * 4, 8 * 7, 2 * 2 * 2 * 2 * 2, 3 * 2
#: Words of letters are told apart by a hash; beside these numbers, one for other tokens and one for none.
WORDS, WORD_BYTES = 1 << 11, 14
#: What a token is part of: @ before or behind, a colon before, // in front, four numbers with dots, dots or slashes inside.
BESIDE = 2**5 * 3
SIZES = (SHAPES, MIXES, CONTEXTS, FILES, SHAPES + 1, SHAPES + 1, WORDS + 2, WORDS + 2, WORDS + 2, WORDS + 2, BESIDE)


@dataclass
class Tokens:
    """Tokens of many texts: bytes from start to end, text number, and the numbers of their features.

    Features, in order: the token's shape and mix of kinds, its neighbourhood, its file's; the shapes before and after; the token as a word,
    the two words before and the one after; what it is part of, such as an address.
    """

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    features: list[np.ndarray]

    def __len__(self) -> int:
        return len(self.start)


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    n = len(data)
    inside, first = TOKEN[data], first_bytes(offsets, n)
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:]
    ends[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    text = np.searchsorted(offsets, start, "right") - 1

    def count(flags: np.ndarray, a: np.ndarray = start, b: np.ndarray = end) -> np.ndarray:
        sums = np.zeros(n + 1, np.int32)
        np.cumsum(flags, out=sums[1:], dtype=np.int32)
        return sums[b] - sums[a]

    def shifted(x: np.ndarray, by: int, none: int) -> np.ndarray:
        out = np.full(len(x), none, np.int64)
        if by > 0:
            out[by:] = np.where(text[by:] == text[:-by], x[:-by], none)
        else:
            out[:by] = np.where(text[:by] == text[-by:], x[-by:], none)
        return out

    size, lower, upper, digit, hexed = end - start, count(LOWER[data]), count(UPPER[data]), count(DIGIT[data]), count(HEX[data])
    length = np.searchsorted([4, 8, 12, 16, 20, 32, 40], size, "right")
    letters = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0)
    share = np.minimum(3, 4 * digit // np.maximum(size, 1))
    shape = ((length * 8 + letters) * 2 + (hexed == size)) * 4 + share
    kind, turn = KIND[data], np.zeros(n, bool)
    turn[1:] = kind[1:] != kind[:-1]
    mix = length * 7 + np.searchsorted([1, 2, 3, 4, 6, 10], count(turn, np.minimum(start + 1, end)), "right")

    key = Hasher(np.where(UPPER[data], data + 32, data))(start, end)
    named = np.isin(key, Hasher(np.frombuffer(b"".join(NAMES), np.uint8))(*name_spans())).astype(np.int64)
    word = np.where((lower + upper == size) & (size <= WORD_BYTES), (key >> np.uint64(53)).astype(np.int64), WORDS)
    same = shifted(np.ones(len(start), np.int64), 1, 0).astype(bool)
    gap_start = np.where(same, np.concatenate([[0], end[:-1]]), offsets[text]).astype(np.int64)
    mark = count((data == 0x3D) | (data == 0x3A) | (data == 0x3E), gap_start, start) > 0
    broken = count(data == 0x0A, gap_start, start) > 0
    named_before = shifted(named, 1, 0)
    named_near = named_before | shifted(named, 2, 0)
    quote = np.zeros(len(start), bool)
    has = start > offsets[text]
    quote[has] = np.isin(data[start[has] - 1], [0x22, 0x27])
    context = (((named_before * 2 + named_near) * 2 + mark) * 2 + quote) * 2 + broken

    before, behind = np.zeros(len(start), np.uint8), np.zeros(len(start), np.uint8)
    before[has] = data[start[has] - 1]
    goes_on = end < offsets[text + 1]
    behind[goes_on] = data[end[goes_on]]
    dots, slashes = count(data == 0x2E), count(data == 0x2F)
    rooted = (size > 1) & (data[start] == 0x2F) & (data[np.minimum(start + 1, max(0, n - 1))] == 0x2F)
    beside = np.zeros(len(start), np.int64)
    for flag in (behind == 0x40, before == 0x40, before == 0x3A, rooted, (dots == 3) & (digit + dots == size)):
        beside = beside * 2 + flag
    beside = beside * 3 + np.where(slashes > 0, 2, np.minimum(dots, 1))

    n_named = per_text(named, np.searchsorted(start, offsets))
    n_digits, sizes = per_text(DIGIT[data], offsets), np.diff(offsets)
    file = np.minimum(2, n_named) * 2 + (100 * n_digits > 5 * np.maximum(sizes, 1))
    none = WORDS + 1
    return Tokens(start, end, text, [shape, mix, context, file[text] if len(text) else text, shifted(shape, 1, SHAPES), shifted(shape, -1, SHAPES), word, shifted(word, 1, none), shifted(word, 2, none), shifted(word, -1, none), beside])


def name_spans() -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(x) for x in NAMES])
    return ends - [len(x) for x in NAMES], ends


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, kind, start, end) in bytes of data, of the fixed patterns: leftmost, not overlapping for each kind."""
    found = []
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = HEX[data]
    edges = np.diff(flags)
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    cuts = cuts[(flags[cuts] == 1) & (flags[cuts + 1] == 1)]
    a = np.union1d(np.flatnonzero(edges == 1), cuts)
    b = np.union1d(np.flatnonzero(edges == -1), cuts)
    long = b - a >= LEAST_HEX
    found += [(int(np.searchsorted(offsets, x, "right")) - 1, 2, int(x), int(y)) for x, y in zip(a[long], b[long], strict=True)]
    whole = data.tobytes()
    for text, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        part = whole[x:y]
        low = part.lower()
        if any(name in low for name in NAMES):
            found += [(text, 0, x + m.start(), x + m.end()) for m in ASSIGN.finditer(part) if len(m[2]) >= LEAST_ASSIGN]
        if b"AKIA" in part:
            found += [(text, 1, x + m.start(), x + m.end()) for m in ACCESS.finditer(part) if len(m[0]) >= LEAST_ACCESS]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


@dataclass
class Field:
    """Weights of a linear chain: for each tag those of a token's features, and those of one tag after another."""

    weights: list[np.ndarray]
    steps: np.ndarray

    @classmethod
    def blank(cls) -> Field:
        return cls([np.zeros((n, 3)) for n in SIZES], np.zeros((3, 3)))

    def parts(self) -> list[np.ndarray]:
        return [*self.weights, self.steps]

    def scores(self, f: list[np.ndarray]) -> np.ndarray:
        total = np.take(self.weights[0], f[0], axis=0)
        for w, x in zip(self.weights[1:], f[1:], strict=True):
            total += np.take(w, x, axis=0)
        return total

    def train(self, f: list[np.ndarray], tags: np.ndarray, there: np.ndarray) -> None:
        """f: features of chains of tokens, one chain a row; there: which places of a row have a token, its first ones. Full-batch Adam on
        the likelihood."""
        order = np.argsort(-there.sum(axis=1), kind="stable")
        tags, there = tags[order], there[order]
        flat = [x[order][there] for x in f]
        first, second = [np.zeros_like(p) for p in self.parts()], [np.zeros_like(p) for p in self.parts()]
        for step in range(1, STEPS + 1):
            for p, g, m, v in zip(self.parts(), self.gradients(flat, tags, there), first, second, strict=True):
                g = g / len(tags) + DECAY * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def gradients(self, flat: list[np.ndarray], tags: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
        """Of the negative log-likelihood, by the forward and backward sums. Chains come in order of length, longest first; flat: features of
        the places that there marks, row by row."""
        n, length = there.shape
        em = np.zeros((n, length, 3))
        em[there] = self.scores(flat)
        live = there.sum(axis=0)
        alpha, beta = np.zeros((length, n, 3)), np.zeros((length, n, 3))
        alpha[0], total = em[:, 0], np.zeros((n, 1))
        for t in range(1, length):
            alpha[t, : live[t]] = log_sum(alpha[t - 1, : live[t], :, None] + self.steps, 1) + em[: live[t], t]
        for t in range(length - 2, -1, -1):
            k = live[t + 1]
            beta[t, :k] = log_sum(self.steps + (em[:k, t + 1] + beta[t + 1, :k])[:, None, :], 2)
        last = there.sum(axis=1) - 1
        total[:, 0] = log_sum(alpha[last, np.arange(n)], 1)
        step_grad, delta = np.zeros((3, 3)), np.zeros_like(em)
        for t in range(length):
            k = live[t]
            p = np.exp(alpha[t, :k] + beta[t, :k] - total[:k])
            p[np.arange(k), tags[:k, t]] -= 1
            delta[:k, t] = p
            if t:
                step_grad += np.exp(alpha[t - 1, :k, :, None] + self.steps + (em[:k, t] + beta[t, :k])[:, None, :] - total[:k, :, None]).sum(0)
                np.add.at(step_grad, (tags[:k, t - 1], tags[:k, t]), -1)
        d = delta[there]
        return [np.stack([np.bincount(x, d[:, k], minlength=len(w)) for k in range(3)], axis=1) for w, x in zip(self.weights, flat, strict=True)] + [step_grad]

    def viterbi(self, tok: Tokens) -> np.ndarray:
        """The best tags of each text's chain of tokens.

        A token whose score outside exceeds its others by more than all that its neighbours' tags can add or take is outside on the best
        path, whatever stands beside it: chains are cut there, which changes no result, and the rest is decoded, all pieces side by side.
        """
        tags = np.zeros(len(tok), np.int8)
        if not len(tok):
            return tags
        em = self.scores(tok.features)
        s = np.zeros((4, 4))
        s[:3, :3] = self.steps
        into, out_of = s[:, :3], s[:3, :]
        gain = max((into[:, x][:, None] + out_of[x][None, :] - into[:, OUTSIDE][:, None] - out_of[OUTSIDE][None, :]).max() for x in (BEGIN, INSIDE))
        open_ = np.flatnonzero(em[:, OUTSIDE] - em[:, 1:].max(axis=1) <= gain)
        if not len(open_):
            return tags
        head = np.ones(len(open_), bool)
        head[1:] = (np.diff(open_) > 1) | (tok.text[open_[1:]] != tok.text[open_[:-1]])
        heads = np.flatnonzero(head)
        sizes = np.diff(np.append(heads, len(open_)))
        order = np.argsort(-sizes, kind="stable")
        heads, sizes = open_[heads[order]], sizes[order]
        chained = lambda i, j: (i >= 0) & (j < len(tok)) & (tok.text[np.maximum(i, 0)] == tok.text[np.minimum(j, len(tok) - 1)])
        best = em[heads] + np.where(chained(heads - 1, heads)[:, None], self.steps[OUTSIDE], 0)
        backs = [np.zeros((len(heads), 3), np.int8)]
        final = best.copy()
        for t in range(1, sizes[0]):
            n = int(np.searchsorted(-sizes, -t, "left"))
            reached = best[:n, :, None] + self.steps
            backs.append(reached.argmax(axis=1).astype(np.int8))
            best = reached.max(axis=1) + em[heads[:n] + t]
            final[:n] = best
        last = heads + sizes - 1
        tag = (final + np.where(chained(last, last + 1)[:, None], self.steps[:, OUTSIDE], 0)).argmax(axis=1).astype(np.int8)
        for t in range(sizes[0] - 1, -1, -1):
            n = int(np.searchsorted(-sizes, -t, "left"))
            tags[heads[:n] + t] = tag[:n]
            tag[:n] = backs[t][np.arange(n), tag[:n]]
        return tags


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)


def gold(tok: Tokens, spans: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Tags by spans: tokens of eight bytes or more that end in a span begin a secret or go on with one."""
    tags = np.zeros(len(tok), np.int8)
    for _, _, a, b in spans:
        i, j = np.searchsorted(tok.end, a, "right"), np.searchsorted(tok.start, b, "left")
        secret = [k for k in range(i, j) if min(tok.end[k], b) - max(tok.start[k], a) >= LEAST_ASSIGN]
        for k in secret:
            tags[k] = INSIDE if k - 1 in secret else BEGIN
    return tags


# Fixed values, from which examples are made: words that name a secret, what stands between it and the name, and words that go on otherwise.
NAMED = "password passwd passphrase pwd pass secret token key apikey api_key auth authorization bearer credential login code".split()
BETWEEN = (" is ", ": ", " = ", "=", ":", " -> ", " => ", " ", " was ", ": '", ' = "', ' "', " is: ", " will be ")
OTHERWISE = "required expired reset missing invalid garden economy ring service policy manager holder strength field length value name user account".split()


def made_secret(r: random.Random) -> tuple[str, bool]:
    """A made-up secret, and whether it shows as one wherever it stands."""
    any_ = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low, up, dig = ascii_lowercase, ascii_uppercase, digits
    kind = r.randrange(7)
    if kind == 0:
        return any_(low, r.randrange(4, 9)) + any_(dig, r.randrange(1, 5)) + any_(low, r.randrange(0, 6)), False
    if kind == 1:
        return any_(low, 3) + any_(low + dig, r.randrange(6, 20)) + any_(dig, 1), False
    if kind == 2:
        n = r.randrange(10, 44)
        return any_(low + up + dig, n), n >= 20
    if kind == 3:
        n, chars = r.randrange(16, 48), r.choice(("0123456789abcdef", "0123456789ABCDEF"))
        return any_(chars, n), n >= 20
    if kind == 4:
        return any_(low, r.randrange(2, 5)) + r.choice("_-") + any_(low + up + dig, r.randrange(16, 40)), True
    if kind == 5:
        n = r.randrange(16, 48)
        return any_(low + up + dig + "+/", n), n >= 24
    return any_(up, 1) + any_(low, r.randrange(3, 7)) + any_(dig, r.randrange(2, 5)) + any_(low + up, r.randrange(1, 5)), False


def made_other(r: random.Random) -> str:
    """What looks a little like a secret, or like what stands beside one, and is none."""
    any_ = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    name, low, dig = r.choice(NAMED), ascii_lowercase, digits
    kind = r.randrange(19)
    if kind == 14:
        return f"{r.choice(('http', 'https', 'ftp'))}://{any_(low, 6)}.{any_(low, 3)}/{any_(low + dig, r.randrange(6, 16))}/{any_(low, 4)}{any_(dig, 2)}"
    if kind == 15:
        return "-".join(any_("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))
    if kind == 16:
        return f"{r.choice(('postgres', 'redis', 'http', 'ssh'))}://{any_(low, 5)}@{any_(low, 6)}{r.randrange(10)}.{any_(low, 4)}:{any_(dig, 4)}/{any_(low, 5)}"
    if kind in (12, 17, 18):
        return f"{r.choice(('', '', 'is ', 'be, ', 'mail '))}{any_(low, r.randrange(3, 9))}{r.choice(('', '.', '_'))}{r.randrange(1000)}@{any_(low, 5)}{r.choice(('', r.choice(dig)))}.{any_(low, 7)}.com"
    if kind == 13:
        return ".".join(str(r.randrange(256)) for _ in range(4))
    if kind < 3:
        return name + r.choice((" ", " is ", ": ", " = ", " was ")) + r.choice(OTHERWISE)
    if kind == 3:
        return name + r.choice(BETWEEN) + any_(low, r.randrange(2, 12))
    number = r.choice((any_(dig, r.randrange(1, 17)), f"{r.randrange(1900, 2100)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}", f"+{any_(dig, 2)} {any_(dig, 3)} {any_(dig, 7)}", f"{r.randrange(99)}.{r.randrange(99)}.{r.randrange(99)}"))
    if kind == 4:
        return number
    if kind == 5:
        return r.choice(OTHERWISE) + r.choice((": ", " = ", " is ", " ")) + r.choice((number, any_(low, 5) + any_(dig, r.randrange(1, 5))))
    word = any_(low, r.randrange(3, 9))
    if kind == 6:
        return word + any_(dig, r.randrange(1, 5))
    if kind == 7:
        return word.capitalize() + any_(low, 4).capitalize() + r.choice(("", any_(low, 5).capitalize()))
    if kind == 8:
        return r.choice(("http://", "https://", "/", "")) + word + "." + any_(low, 3) + "/" + any_(low, 6) + "/" + any_(dig, r.randrange(0, 8))
    if kind == 9:
        return word + "_" + any_(low, 6) + r.choice((".txt", ".json", "_" + any_(dig, 4), "-" + any_(dig, 2)))
    if kind == 10:
        return any_(low, r.randrange(12, 40)) if r.random() < 0.5 else any_(ascii_uppercase, r.randrange(4, 24))
    return any_("0123456789abcdef", r.randrange(4, 10))


def examples(matches: list[tuple[str, int]], others: list[tuple[str, int]]) -> Iterator[tuple[bytes, list[tuple[int, int]], int]]:
    """(text, where secrets are or None for where the patterns match, number of the file's features).

    Pieces of the corpus as they are, and pieces without a match into which a made-up secret is put, or what is none.
    """
    r = random.Random(0)
    for text, file in [*matches, *others]:
        yield text.encode(), None, file
    for text, file in others or [("", 0)] * 300:
        for secret in (True, True, False):
            words = text.split(" ")
            at = r.randrange(len(words) + 1)
            left = " ".join(words[:at])
            if secret:
                value, shows = made_secret(r)
                name, between = (r.choice(NAMED), r.choice(BETWEEN)) if not shows or r.random() < 0.7 else ("", "")
                name = r.choice((name, name.upper(), name.capitalize()))
                prefix = f"{left} {r.choice(('', 'my ', 'the ', 'your '))}{name}{between}" if name else f"{left} "
                end = between.strip()[-1:] if between.strip()[-1:] in ("'", '"') else ""
                if r.random() < 0.08:  # the password of an address
                    prefix = f"{left} {r.choice(('postgres', 'mysql', 'redis', 'https', 'amqp'))}://{''.join(r.choice(ascii_lowercase) for _ in range(r.randrange(3, 9)))}:"
                    end = f"@{''.join(r.choice(ascii_lowercase + digits) for _ in range(7))}.{r.choice(('com', 'local', 'net'))}{r.choice(('', ':5432', '/data', ':6379/0'))}"
                whole = prefix + value + end + r.choice((" ", ". ", ", ", "\n", "; ")) + " ".join(words[at:])
                yield whole.encode(), [(len(prefix.encode()), len((prefix + value).encode()))], file
            else:
                yield f"{left} {made_other(r)}{r.choice((' ', '. ', ', '))}{' '.join(words[at:])}".encode(), [], file


def learned(docs: DataFrame) -> Field:
    """A chain that learns from pieces of DOCUMENTS documents, those whose ids a hash puts in the sample: matches of the fixed patterns, and
    made-up secrets of further shapes and names put into other pieces. Of an empty table nothing is learned, and the chain finds nothing."""
    n = docs.count()
    share = min(1.0, DOCUMENTS / max(n, 1))
    thinned = 1000 * min(1.0, 2 * OTHERS / max(1, min(n, DOCUMENTS)))
    h = F.xxhash64(F.col("doc_id").cast("string"))
    drawn = docs.where(F.pmod(h, F.lit(1 << 30)) < share * (1 << 30)).select(h, F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in blocks(batch.column(1), BLOCK_BYTES):
                data, offsets = text_buffers(batch.column(1).slice(first, rows))
                tok = tokens(data, offsets)
                if not len(tok):
                    continue
                tags = gold(tok, base_spans(data, offsets))
                ids = batch.column(0).slice(first, rows).to_numpy()
                there, begin = np.unique(tok.text, return_index=True)
                sizes = np.diff(np.append(begin, len(tok)))
                # Of other pieces one for so many documents, by a hash, as give twice those that are taken.
                chosen = (ids[there] >> 32) % 1000 < thinned
                centres = np.concatenate([np.flatnonzero(tags == BEGIN), (begin + ids[there] % sizes)[chosen]])
                a = np.maximum(centres - REACH, np.repeat(begin, sizes)[centres])
                b = np.minimum(centres + REACH, np.repeat(begin + sizes - 1, sizes)[centres])
                secret = [bool(tags[i : j + 1].any()) for i, j in zip(a, b, strict=True)]
                # A quote after the last token belongs to it.
                texts = [data[tok.start[i] : min(tok.end[j] + 1, offsets[tok.text[j] + 1])].tobytes().decode("utf-8", "ignore") for i, j in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(secret), pa.array(texts, pa.string()), pa.array(tok.features[3][centres], pa.int32())], ["secret", "piece", "file"])

    order = Window.partitionBy("secret").orderBy(F.xxhash64("piece"), "piece", "file")
    pieces = batched(drawn).mapInArrow(run, "secret boolean, piece string, file int").withColumn("nth", F.row_number().over(order))
    got = pieces.where(F.col("nth") <= F.when(F.col("secret"), MATCHES).otherwise(OTHERS)).orderBy("secret", "nth").collect()
    field = Field.blank()
    if not got:
        field.weights[3][:, OUTSIDE] = 10
        return field
    made = list(examples(*([(r.piece, r.file) for r in got if r.secret == secret] for secret in (True, False))))
    lengths = [len(text) for text, _, _ in made]
    data, offsets = np.frombuffer(b"".join(text for text, _, _ in made), np.uint8), np.append(0, np.cumsum(lengths))
    tok = tokens(data, offsets)
    base: dict[int, list] = {}
    for span in base_spans(data, offsets):
        base.setdefault(span[0], []).append(span)
    spans = [s for i, (_, secrets, _) in enumerate(made) for s in (base.get(i, []) if secrets is None else [(i, 3, offsets[i] + a, offsets[i] + b) for a, b in secrets])]
    tok.features[3] = np.array([file for _, _, file in made])[tok.text]
    # One example a row, filled up behind.
    n = np.bincount(tok.text, minlength=len(made))
    there = np.arange(n.max()) < n[:, None]
    rows = []
    for x in [*tok.features, gold(tok, spans)]:
        rows.append(np.zeros(there.shape, np.int32))
        rows[-1][there] = x
    filled = n > 0
    field.train([x[filled] for x in rows[:-1]], rows[-1][filled], there[filled])
    return field


def found(column: pa.Array, field: Field) -> Iterator[tuple[int, list[tuple[str, int, int]]]]:
    """(row, spans) of rows that have any; spans (kind, start, end) in code points by start, then kind. Base spans stay; others overlap none."""
    for first, rows in blocks(column, BLOCK_BYTES):
        data, offsets = text_buffers(column.slice(first, rows))
        spans = base_spans(data, offsets)
        tok = tokens(data, offsets)
        tags = field.viterbi(tok)
        begins = np.flatnonzero((tags == BEGIN) | ((tags == INSIDE) & np.append(True, (tags[:-1] == OUTSIDE) | (tok.text[1:] != tok.text[:-1]))[: len(tags)]))
        taken = {}
        for s in spans:
            taken.setdefault(s[0], []).append(s[2:])
        for i in begins:
            j = i
            while j + 1 < len(tags) and tags[j + 1] == INSIDE and tok.text[j + 1] == tok.text[i]:
                j += 1
            a, b, text = int(tok.start[i]), int(tok.end[j]), int(tok.text[i])
            if b - a >= LEAST_ASSIGN and not any(x < b and a < y for x, y in taken.get(text, ())):
                spans.append((text, 3, a, b))
        by: dict[int, list] = {}
        for text, kind, a, b in sorted(spans, key=lambda s: (s[0], s[2], s[1])):
            by.setdefault(text, []).append((kind, a, b))
        for text, own in by.items():
            points = np.cumsum((data[offsets[text] : offsets[text + 1]] & 0xC0) != 0x80)
            at = lambda x, o=offsets[text], p=points: int(p[x - o - 1]) if x > o else 0
            yield first + text, [(KINDS[kind], at(a), at(b)) for kind, a, b in own]


def scanned(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every document.

    Kinds assign, access and hex are the fixed patterns'; crf are further spans that the chain finds, of eight bytes or more, which overlap
    none of these. Places are code points of the whole text, end exclusive. Spans that start together stand in the order of KINDS. A null or
    empty text has none, and an empty table gives no rows. Very long texts are gone through whole, in one task each. Repeated rows come back
    repeated. Further columns are not looked at.
    """
    field = field or learned(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans: list = [[] for _ in range(batch.num_rows)]
            for row, own in found(batch.column(1), field):
                spans[row] = [{"kind": k, "start": a, "end": b} for k, a, b in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return batched(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, spans array<struct<kind string, start int, end int>>")


def redacted(docs: DataFrame, mark: str = "[SECRET]", field: Field | None = None) -> DataFrame:
    """docs with each secret in text replaced by mark; overlapping ones together by one. n_chars follows where docs has it.

    Rows and other columns stay as they are. The mark is none of the patterns' matches, so a second run finds nothing more by them.
    """
    field = field or learned(docs)
    columns, counted, plain = docs.columns, "n_chars" in docs.columns, numbered(docs)
    name = f"c{columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = columns.index("text")
            column = batch.column(k)
            changed = {}
            for row, own in found(column, field):
                text, out, done = column[row].as_py(), [], 0
                for _, a, b in own:
                    if a >= done:
                        out += [text[done:a], mark]
                    done = max(done, b)
                changed[row] = "".join([*out, text[done:]])
            if changed:
                texts = column.to_pylist()
                for row, text in changed.items():
                    texts[row] = text
                batch = batch.set_column(k, batch.schema.field(k), pa.array(texts, column.type))
                if counted:
                    j = columns.index("n_chars")
                    sizes = batch.column(j).to_pylist()
                    for row, text in changed.items():
                        sizes[row] = len(text)
                    batch = batch.set_column(j, batch.schema.field(j), pa.array(sizes, batch.column(j).type))
            yield batch

    kept = plain.withColumn(name, F.col(name).cast("string"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in kept.schema])
    return batched(kept).mapInArrow(run, schema).toDF(*columns)


def digest(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = joined(F.filter("spans", lambda s: s["kind"] != "crf"))
    return spans.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
