from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from millrace.operators import dedupe, utterances

VOX, YT, GV = re.compile(r"_(\d{8}-\d{2}:\d{2}:\d{2}_\d+)$"), re.compile(r"[a-z]{2}\d+_\d+_([\w-]{11})_(\d+)_(\d+)_(\d+)_(\d+)$"), re.compile(r"^(\d{8}-\d{4}-[A-Z]+(?:-[A-Z0-9]+)*?)[-_][a-z]{2}(?:_|$)")


def facts(row):
    id_, caption, _ = row
    words = [w for w in (re.sub("[^a-z0-9]", "", x) for x in caption.lower().split()) if w]
    key = "".join(words)
    out = {"vox": None, "yt": None, "gv": None, "text": key if len(key) >= 20 and len(caption.split()) >= 4 else None}
    out["sh"] = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
    out["numbers"] = sorted(re.findall(r"\d+", caption))
    if m := VOX.search(id_):
        out["vox"] = m[1]
    elif m := YT.search(id_):
        s = int(m[2]) + int(m[3]) / 100
        out["yt"] = (m[1], s, s + int(m[4]) + int(m[5]) / 100)
    if m := GV.search(id_):
        out["gv"] = m[1]
    return out


def related(name, x, y):
    both = min(len(x["sh"]), len(y["sh"]))
    if name == "audio_vox":
        return x["vox"] is not None and x["vox"] == y["vox"]
    if name == "audio_yt":
        if not x["yt"] or not y["yt"] or x["yt"][0] != y["yt"][0]:
            return False
        return min(x["yt"][2], y["yt"][2]) - max(x["yt"][1], y["yt"][1]) > 0.5 * min(x["yt"][2] - x["yt"][1], y["yt"][2] - y["yt"][1])
    if name == "session_text":
        return x["gv"] is not None and x["gv"] == y["gv"] and both >= 3 and len(x["sh"] & y["sh"]) >= 0.5 * both
    if name == "text":
        return x["text"] is not None and x["text"] == y["text"]
    return x["text"] is not None and y["text"] is not None and 5 * len(x["sh"] & y["sh"]) >= 4 * len(x["sh"] | y["sh"])


def plain(train, protected):
    held, out, kept = [facts(p) for p in protected], {}, []
    for row in sorted(train, key=lambda r: r[2]):
        x = facts(row)
        reason = next((f"heldout_{n}" for n in utterances.REASONS[0] if any(related(n, x, y) for y in held)), None)
        many = row[0].startswith("fleurs")
        for n in utterances.REASONS[1]:
            if reason is None and not (many and n in ("text", "near_text")):
                others = [y for y, m in kept if not (m and n in ("text", "near_text")) and (n != "near_text" or y["numbers"] == x["numbers"])]
                reason = f"dup_{n}" if any(related(n, x, y) for y in others) else None
        out[row[0]] = reason
        if reason is None:
            kept.append((x, many))
    return out


def test_one_row_for_each_utterance(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["2030", "17"]
    bases = [[r.choice(words) for _ in range(30)] for _ in range(25)]

    def caption():
        w = list(r.choice(bases))
        for _ in range(r.choice((0, 0, 0, 1, 1, 2, 8))):
            w[r.randrange(len(w))] = r.choice([*words, "2050"])
        return " ".join(w if r.random() < 0.9 else w[:3])

    rows = []
    for i in range(260):
        kind = i % 5
        id_ = (f"en001_{i}_video00000{r.randrange(3)}_{r.randrange(90)}_50_{r.randrange(2, 9)}_0", f"en_{i}_20180618-09:00:00_{r.randrange(40)}", f"2018061{r.randrange(3)}-0900-PLENARY-{r.randrange(2)}-en_{i}", f"fleurs_{i}_1", f"row{i}")[kind]
        rows.append((id_, caption(), r.random()))
    protected, train = rows[:40], rows[40:]
    want = plain(train, protected)
    frame = lambda x: spark.createDataFrame(x, "id string, caption string, rank double")
    got = {x.id: x.reason for x in utterances.deduped(frame(train), frame(protected)).collect()}
    assert got == want
    assert len(set(want.values())) >= 8
    assert utterances.deduped(frame(train).limit(0), frame(protected)).count() == 0
    assert utterances.deduped(frame(train), frame(protected).limit(0)).where(F.col("reason").startswith("heldout")).count() == 0


def test_a_group_of_near_copies_costs_few_pairs(spark, monkeypatch):
    """What a protected row takes meets no further one, and is not held against the rest of its group."""
    r, compared, alike = random.Random(4), [], dedupe.alike
    base = [f"w{r.randrange(500)}" for _ in range(100)]
    texts = [" ".join([*base[:i], f"new{i}", *base[i + 1 :]]) for i in range(60)]
    rows = [(f"row{i}", t, float(i)) for i, t in enumerate(texts)] + [(f"row{i}", " ".join(f"v{r.randrange(500)}" for _ in range(100)), float(i)) for i in range(60, 64)]
    monkeypatch.setattr(dedupe, "alike", lambda pairs, *xs: compared.append(pairs.count()) or alike(pairs, *xs))
    monkeypatch.setattr(dedupe, "FIRST_WAVE", 1, raising=False)
    frame = lambda x: spark.createDataFrame(x, "id string, caption string, rank double")
    got = {x.id: x.reason for x in utterances.deduped(frame(rows[10:]), frame(rows[:10])).collect()}
    assert got == {id_: "heldout_near_text" if i < 60 else None for i, (id_, _, _) in enumerate(rows) if i >= 10}
    assert 50 <= sum(compared) <= 300
