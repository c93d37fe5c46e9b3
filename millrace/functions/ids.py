"""What a row's id and path tell, by tables of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of ids. Each rule: a tag, and a pattern whose first group is what the tag names.
UNITS = [("yt", r"^[a-z]{2}[0-9]{3}_[0-9]+_(.{11})_"), ("ep", r"^([^_]*PLENARY[^_]*|[0-9]{8}-[^_]*)"), ("ep", r"^([^_]*)_.*PLENARY"), ("fl", r"^fleurs\w*?_([0-9]+)_")]
RECORDINGS = [("vox", r"_([0-9]{8}-[0-9]{2}:[0-9]{2}:[0-9]{2}_[0-9]+)$"), ("yt", r"[a-z]{2}[0-9]+_[0-9]+_([A-Za-z0-9_-]{11})_[0-9]+_[0-9]+_[0-9]+_[0-9]+$"), ("gv", r"^([0-9]{8}-[0-9]{4}-[A-Z]+(?:-[A-Z0-9]+)*?)[-_][a-z]{2}(?:_|$)")]
PIECE = r"_p([0-9]+)$"
#: Start and length in a video, in seconds and hundredths, at the end of an id.
TIMES = r"_([0-9]+)_([0-9]+)_([0-9]+)_([0-9]+)$"
PLAIN, READ_BY_MANY, AUGMENTED, SPEED, FOLDER = "id", "cv22_", "__aug", "spd_", "/aug/"


def ruled(id_: Column, rules: list[tuple[str, str]]) -> Column:
    """(tag, key) of the first rule that an id fits; null if it fits none."""
    found = [(tag, F.regexp_extract(id_, pattern, 1)) for tag, pattern in rules]
    return F.coalesce(*[F.when(key != "", F.struct(F.lit(tag).alias("tag"), key.alias("key"))) for tag, key in found])


def tagged(rule: Column) -> Column:
    return F.concat_ws(":", rule["tag"], rule["key"])


def spoken_words(caption: Column) -> Column:
    """Runs of letters and digits of a lower-case caption, space-joined."""
    return F.array_join(F.regexp_extract_all(F.lower(caption), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def group_unit(id_: Column, caption: Column | None = None) -> Column:
    """The unit of variety: a video, a session, a sentence that several people read, else the row alone (`id:`), which no cap counts."""
    said = F.when(id_.startswith(READ_BY_MANY), F.concat(F.lit("cv:"), spoken_words(F.coalesce(caption, F.lit("")) if caption is not None else F.lit(""))))
    rule = ruled(id_, UNITS)
    return F.when(rule.isNotNull(), tagged(rule)).otherwise(F.coalesce(said, F.concat(F.lit(f"{PLAIN}:"), id_)))


def session(id_: Column) -> Column:
    """A session's event without the language; null for other ids."""
    return ruled(id_, RECORDINGS[-1:])["key"]


def recording(id_: Column, piece: Column | None = None) -> Column:
    """(kind, key, s, e): the recording that a row comes from, and its time in it where the id tells. A piece is of the recording it is cut from;
    piece: its seconds from the start of what the id tells, as an array of two, or null."""
    base = F.regexp_replace(id_, PIECE, "")
    rule = ruled(base, RECORDINGS)
    whole, part, seconds, rest = (F.regexp_extract(base, TIMES, k).try_cast("double") for k in range(1, 5))
    start = F.when(rule["tag"] == "yt", whole + part / 100)
    first, last = start, start + seconds + rest / 100
    if piece is not None:
        first, last = (F.when(F.size(piece) == 2, start + F.get(piece, F.lit(i))).otherwise(x) for i, x in enumerate((first, last)))
    return F.struct(F.coalesce(rule["tag"], F.lit(PLAIN)).alias("kind"), F.coalesce(rule["key"], base).alias("key"), F.round(first, 2).alias("s"), F.round(last, 2).alias("e"))


def stem(path: Column) -> Column:
    """The name of a file without its last ending."""
    return reduce(lambda c, p: F.regexp_replace(c, p, ""), ("^.*/", r"\.[^.]*$"), path)


def variant(path: Column, suffix: str = AUGMENTED, prefix: str = SPEED) -> Column:
    """clean, aug or spd, by the name's beginning and end and by the folder."""
    return F.when(stem(path).startswith(prefix), "spd").when(stem(path).endswith(suffix) | path.contains(FOLDER), "aug").otherwise("clean")


def stable_key(path: Column, words: Column, video: Column, suffix: str = AUGMENTED, prefix: str = SPEED) -> Column:
    """What copies of a row share: its name without the suffix (`a:`). The names of speed copies tell nothing: their words (`tx:`), with the
    video if there is one (`vt:`)."""
    said = F.substring(F.sha1(words), 1, 16)
    of_video = F.when(F.coalesce(video, F.lit("")) != "", F.concat(F.lit("vt:"), video, F.lit("|"), said))
    named = F.concat(F.lit("a:"), F.regexp_replace(stem(path), f"{suffix}$", ""))
    return F.when(stem(path).startswith(prefix), F.coalesce(of_video, F.concat(F.lit("tx:"), said))).otherwise(named)
