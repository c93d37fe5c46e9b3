"""Queries that SQL can't express well, against plain versions over the same tables."""

from __future__ import annotations

import hashlib
import itertools
import re

import duckdb
import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from millrace.functions import classes
from millrace.plans import registry

ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()


def spell(n, mid=" "):
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10] + (f" {ONES[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{ONES[n // 100]} hundred" + (f"{mid}{spell(n % 100)}" if n % 100 else "")
    for scale, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand")):
        if n >= scale:
            return f"{spell(n // scale, mid)} {name}" + (f" {spell(n % scale, mid)}" if n % scale else "")


@pytest.fixture(scope="module")
def rows(small):
    return lambda sql: duckdb.sql(re.sub(r"FROM (\w+)", rf"FROM '{small}/\1.parquet'", sql)).fetchall()


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def turn_pairs(rows):
    turns = sorted(rows("SELECT conv_id, turn, role, text FROM conversations"), key=lambda r: (r[0], r[1], r[3] or ""))
    return [(a, b) for a, b in itertools.pairwise(turns) if a[0] == b[0]]


def table(a, b):
    cost = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, cost[0] = cost[0], i
        for j, y in enumerate(b, 1):
            last, cost[j] = cost[j], min(cost[j] + 1, cost[j - 1] + 1, last + (x != y))
    return cost[-1]


def run(spark, small, name):
    return registry.QUERIES[name](spark, small).collect()


def test_turns(spark, small, rows):
    pairs = turn_pairs(rows)
    edits = {(a[0], a[1]): table(words(a[3]), words(b[3])) for a, b in pairs}
    got = {(r.conv_id, r.turn): r for r in run(spark, small, "turn_alignment")}
    assert {k: r.edits for k, r in got.items()} == edits
    for a, b in pairs:
        r = got[a[0], a[1]]
        # Only words that weigh something count as lost or added.
        assert r.lost + r.added <= 2 * r.edits and r.added >= sum(len(w) >= 4 for w in words(b[3])) - len(words(a[3]))
    for r in run(spark, small, "turn_word_errors"):
        mine = [(a, b) for a, b in pairs if a[2] == r.role]
        assert r.edits == sum(edits[a[0], a[1]] for a, b in mine) and r.words == sum(len(words(a[3])) for a, b in mine)
    (r,) = run(spark, small, "turn_number_outcomes")
    read = {text: numbers(words(text)) for pair in pairs for *_, text in pair}
    sizes = [(len(read[a[3]]), len(read[b[3]]), common([v for v, _ in read[a[3]]], [v for v, _ in read[b[3]]])) for a, b in pairs]
    assert r.kept == sum(c for *_, c in sizes)
    assert r.kept + r.changed + r.lost == sum(n for n, *_ in sizes) and r.kept + r.changed + r.invented == sum(n for _, n, _ in sizes)


def common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


SPELLED = {tuple(spell(n, mid).split()): n for n in range(10_000) for mid in (" ", " and ")}


def numbers(tokens):
    """Numbers by the longest spelling of one under 10,000 from each place on; two next to each other may be a year."""
    out, i, end = [], 0, -1
    while i < len(tokens):
        if re.fullmatch(r"[0-9][0-9,]*(\.[0-9]+)?", tokens[i]):
            out.append((float(tokens[i].replace(",", "")), "digits"))
            i += 1
            continue
        n = next((n for n in range(min(9, len(tokens) - i), 0, -1) if tuple(tokens[i : i + n]) in SPELLED), 0)
        if n:
            value = SPELLED[tuple(tokens[i : i + n])]
            if end == i and out[-1][1] == "words" and 11 <= out[-1][0] <= 20 and 10 <= value <= 99:
                out[-1] = (out[-1][0] * 100 + value, "year")
            else:
                out.append((value, "words"))
            end = i + n
        i += n or 1
    return out


def test_numbers_of_texts(spark, small, rows):
    want = {}
    for lang, text in rows("SELECT lang, text FROM documents"):
        for _, form in numbers([w for w in re.sub(r"[^a-z0-9.,]+|[.,](?![0-9])", " ", (text or "").lower()).split(" ") if w]):
            want[lang, form] = want.get((lang, form), 0) + 1
    assert {(r.lang, r.form): r.n for r in run(spark, small, "text_numbers")} == want


def test_ways_to_say_numbers(spark, small, rows):
    tokens = {v for (text,) in rows("SELECT text FROM documents") for v in re.findall(classes.SPAN, text or "")}
    want = set()
    for v in tokens:
        if v.isdigit():
            n, ways = int(v), []
            ways += [spell(n)] if len(v) <= 12 and n < 10**12 else []
            ways += [" ".join(ONES[int(c)] for c in v)] if len(v) > 1 else []
            if re.fullmatch("1[1-9][0-9]{2}|20[0-9]{2}", v) and v != "2000":
                low = n % 100
                ways.append(f"{spell(n // 100)} " + ("hundred" if low == 0 else f"oh {spell(low)}" if low < 10 else spell(low)))
            ways += [spell(n, " and ")] if len(v) <= 12 and n >= 100 else []
            want |= {(v, i, w) for i, w in enumerate(dict.fromkeys(ways))}
    assert {(r.v, r.ord, r.reading) for r in run(spark, small, "reading_candidates")} == want


def md5(x):
    return int(hashlib.md5(str(x).encode()).hexdigest()[:8], 16), x


def test_values_are_filled(spark, small, rows):
    docs = {i: (source, set(re.findall(classes.SPAN, text or ""))) for i, source, text in rows("SELECT doc_id, source, text FROM documents")}
    out = {i for i, (source, _) in docs.items() if source in ("src0", "src1")}
    left = set(docs) - out
    while True:
        count = {}
        for i in out:
            for v in docs[i][1]:
                count[v] = count.get(v, 0) + 1
        took = set()
        for v in {v for i in left for v in docs[i][1]}:
            took |= set(sorted((i for i in left if v in docs[i][1]), key=md5)[: max(0, 3 - count.get(v, 0))])
        if not took:
            break
        out, left = out | took, left - took
    assert {r.doc_id for r in run(spark, small, "filled_values")} == out


def test_sources_are_carved(spark, small, rows):
    held = {}
    for source, text in rows("SELECT source, text FROM documents"):
        for name, pattern in classes.SHAPES.items():
            if re.search(pattern, text or "", re.ASCII):
                held.setdefault(name, {}).setdefault(source, 0)
                held[name][source] += 1
    took = set()
    for name in sorted(held, key=lambda n: (sum(held[n].values()), n)):
        total = sum(held[name].values())
        room = min(10, int(0.2 * total)) - sum(n for s, n in held[name].items() if s in took)
        used = 0
        for source in sorted((s for s in held[name] if s not in took), key=lambda s: (held[name][s], md5(f"{held[name][s]:012d} {s}"))):
            used += held[name][source]
            if used <= room:
                took.add(source)
    assert {r.source for r in run(spark, small, "carved_sources")} == took


def test_bounds_hold_the_ratio(spark, small):
    (r,) = run(spark, small, "paired_bounds")
    moves = run(spark, small, "paired_moves")
    assert r.ratio == pytest.approx(sum(m.fixed - m.broken for m in moves) / sum(m.n for m in moves))
    assert r.low <= r.ratio <= r.high and run(spark, small, "paired_bounds") == [r]
