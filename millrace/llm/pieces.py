"""SentencePiece encoding by streaming Viterbi over a model's pieces and scores, and decoding."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

SPACE = "▁"
UNKNOWN_PENALTY = 10
#: Units of text whose ids a worker remembers, and the longest such unit.
REMEMBERED, REMEMBERED_LENGTH = 600_000, 48
NEVER = float("-inf")


@dataclass
class Vocabulary:
    """Pieces with ids and whole-number scores. Bytes stand for characters that no piece has."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    surface: list[bytes]
    longest: int = field(init=False)
    unknown: float = field(init=False)
    splits: re.Pattern = field(init=False)
    prefixes: dict[str, float] = field(init=False)

    def __post_init__(self) -> None:
        self.prefixes = {piece[:n]: NEVER for piece in self.ids for n in range(1, len(piece))} | self.scores
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        alone = "".join(c for c in "\n\r\t" if not any(c in piece for piece in self.ids))
        # No piece has a space mark after another character: every path has a boundary there, and beside characters that no piece has.
        inner = any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        lone = f"[{alone}]|" if alone else ""
        self.splits = re.compile(f"{lone}[^{alone}]+" if inner else f"{lone}{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        names = [model.id_to_piece(i) for i in range(n)]
        surface = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        return cls({names[i]: i for i in plain}, {names[i]: model.get_score(i) for i in plain}, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], surface)


class Viterbi:
    """The best-scored division of a text into pieces, given out as it is settled.

    feed() takes text bit by bit. A position's best score is final once all positions before it have offered the pieces that start there, for
    which as many characters as the longest piece has are awaited. Scores and backpointers are kept since the last settled boundary only:
    the paths back from all positions where a further piece can start are followed, and what lies before the boundary on which they all meet
    is settled. Of equal scores the longer last piece wins.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.text, self.best, self.back, self.at = vocabulary, "", [0.0], [0], 0

    def feed(self, text: str) -> Iterator[int]:
        step = 4 * self.vocabulary.longest
        for i in range(0, len(text), step):
            self.text += text[i : i + step]
            self.advance(len(self.text) - self.vocabulary.longest)
            if self.at > 0:
                yield from self.settle(self.meeting(range(self.at, min(self.at + self.vocabulary.longest, len(self.text) + 1))))

    def finish(self) -> Iterator[int]:
        self.advance(len(self.text))
        yield from self.settle(len(self.text))

    def whole(self, text: str) -> Iterator[int]:
        """The ids of a text that fits into the window."""
        self.text = text
        return self.finish()

    def advance(self, stop: int) -> None:
        """Offers the pieces that start before stop."""
        text, best, back, n, longest, unknown = self.text, self.best, self.back, len(self.text), self.vocabulary.longest, self.vocabulary.unknown
        get = self.vocabulary.prefixes.get
        best.extend([NEVER] * (n + 1 - len(best)))
        back.extend([0] * (n + 1 - len(back)))
        for start in range(self.at, stop):
            base = best[start]
            score = get(text[start])
            if score is None or score == NEVER:
                if base + unknown > best[start + 1]:
                    best[start + 1], back[start + 1] = base + unknown, start
                if score is None:
                    continue
            elif base + score > best[start + 1]:
                best[start + 1], back[start + 1] = base + score, start
            for end in range(start + 2, min(start + longest, n) + 1):
                score = get(text[start:end])
                if score is None:
                    break
                if base + score > best[end]:
                    best[end], back[end] = base + score, start
        self.at = max(self.at, stop)

    def meeting(self, alive) -> int:
        """Where the paths back from these positions meet; positions that no piece has reached yet have none."""
        paths = {x for x in alive if self.best[x] != NEVER}
        while len(paths) > 1:
            last = max(paths)
            paths.remove(last)
            paths.add(self.back[last])
        return paths.pop()

    def settle(self, boundary: int) -> Iterator[int]:
        if boundary == 0:
            return
        cuts = [boundary]
        while cuts[-1]:
            cuts.append(self.back[cuts[-1]])
        v = self.vocabulary
        for start, end in zip(cuts[:0:-1], cuts[-2::-1]):
            piece = self.text[start:end]
            if piece in v.ids:
                yield v.ids[piece]
            else:
                yield from (v.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))
        base = self.best[boundary]
        self.text, self.best, self.back = self.text[boundary:], [x - base for x in self.best[boundary:]], [max(0, x - boundary) for x in self.back[boundary:]]
        self.at -= boundary


class Encoder(dict):
    """Encodes texts; remembers the ids of short units between boundaries that every path has."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    @staticmethod
    def of_worker(kept: dict, *parts) -> Encoder:
        """One encoder for all tasks of a Python worker. kept: a dictionary of a broadcast value, of which each worker has its own copy."""
        if "encoder" not in kept:
            kept["encoder"] = Encoder(Vocabulary(*parts))
        return kept["encoder"]

    def __missing__(self, unit: str) -> bytes:
        viterbi = Viterbi(self.vocabulary)
        ids = array("i", [*viterbi.feed(unit), *viterbi.finish()] if len(unit) > self.vocabulary.longest else viterbi.whole(unit)).tobytes()
        if len(unit) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[unit] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids as int32. A null or empty text has none."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.vocabulary.splits.findall(SPACE + text.replace(" ", SPACE))))

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.vocabulary.surface.__getitem__, ids.tolist()))
        return text.removeprefix(b" ").decode("utf-8", "replace")


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the ids of every whole text, and the text that they decode to.

    decoded is the text again, but for the model's space mark (U+2581) in a text, which it reads as a space. A null text counts as empty: no
    ids, decoded empty. Repeated rows come back repeated. Other columns of docs are not looked at. The vocabulary is read on the driver and
    sent to the executors once; its size is the model's, whatever the corpus.
    """
    loaded = Vocabulary.load(model_file)
    parts = docs.sparkSession.sparkContext.broadcast(({}, loaded.ids, loaded.scores, loaded.byte_ids, loaded.surface))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(*parts.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = [np.frombuffer(encoder.encode(x), np.int32) for x in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                decoded = pa.array([encoder.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))), decoded], ["doc_id", "ids", "decoded"])
        # What is remembered pays within a task; between tasks it would only take the worker's memory.
        encoder.clear()

    return batched(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
