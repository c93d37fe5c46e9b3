"""Trims under coupled caps, held against rules that take one row at a time."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from fractions import Fraction

from millrace.operators import trims


def order(i):
    return int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), i


def plain_capped(rows, last, share, least, rounds, extra, real_floor):
    """rows: {id: [(class, external)]}."""
    def tally(ids):
        n, e, own = Counter(extra), Counter(), Counter()
        for i in ids:
            for c, x in rows[i]:
                n[c] += 1
                own[c] += 1
                e[c] += x
        return n, e, own

    left, gone = set(rows), {}
    for k in range(rounds):
        n, e, own = tally(left)
        over = [c for c in n if n[c] >= least and e[c] > share * n[c] and (not real_floor or own[c] >= least)]
        if not over:
            break
        out = set()
        for c in over:
            ec, nc = e[c], n[c]
            for i in sorted((i for i in left if (c, True) in rows[i]), key=lambda i: (last[i], *order(i))):
                if ec <= share * nc:
                    break
                ec -= sum(x for d, x in rows[i] if d == c)
                nc -= sum(d == c for d, _ in rows[i])
                out.add(i)
        gone |= dict.fromkeys(out, k)
        left -= out
    n, e, _ = tally(left)
    return gone, {c: (n[c], e[c], n[c] >= least and e[c] > share * n[c]) for c in n}


def test_capped_classes(spark):
    r = random.Random(2)
    rows = {i: [(r.choice("aaaabbbccd"), r.random() < p) for _ in range(r.randrange(6))] for i in range(600) for p in [r.choice((0.1, 0.3, 0.6))]}
    rows[1000] = [("e", True)] * 30
    rows[1001] = [("f", True)] * 5
    last = {i: r.random() < 0.3 for i in rows}
    spans = spark.createDataFrame([(i, c, x) for i, own in rows.items() for c, x in own], "id long, class string, external boolean")
    frame = spark.createDataFrame(list(last.items()), "id long, last boolean")
    for share, extra, real_floor in ((Fraction(1, 4), {}, False), (Fraction(1, 5), {"c": 90, "f": 40, "g": 7}, False), (Fraction(1, 5), {"c": 90, "f": 40}, True)):
        beside = spark.createDataFrame(list(extra.items()), "class string, n long") if extra else None
        for rounds in (6, 1):
            gone, classes = trims.capped_classes(spans, frame, share, 20, rounds, beside, real_floor)
            want = plain_capped(rows, last, share, 20, rounds, extra, real_floor)
            assert {x.id: x.round for x in gone.collect()} == want[0]
            assert {x["class"]: (x.n, x.e, x.still_over) for x in classes.collect() if x.n} == {c: v for c, v in want[1].items() if v[0]}
    gone, classes = trims.capped_classes(spans.limit(0), frame)
    assert gone.count() == 0 == classes.count()


def test_trimmed_beside(spark):
    r = random.Random(4)
    real = {"a": (10, 6), "b": (15, 9), "c": (30, 20), "d": (5, 0), "e": (0, 0), "f": (19, 12)}
    made = [(i, i // 2, [r.choice("abcdf") for _ in range(r.randrange(1, 4))]) for i in range(40)]
    left, sums = {i: own for i, _, own in made}, Counter(c for *_, own in made for c in own)
    for c in sorted(real):
        n, e = real[c]
        if n < 20 <= n + sums[c] and e > Fraction(1, 4) * (n + sums[c]):
            for i, *_ in sorted(made, key=lambda x: (-x[1], -x[0])):
                if n + sums[c] < 20:
                    break
                if i in left and c in left[i]:
                    sums.subtract(left.pop(i))
    spans = spark.createDataFrame([(i, t, c) for i, t, own in made for c in own], "id long, turn long, class string")
    counts = spark.createDataFrame([(c, *v) for c, v in real.items()], "class string, n long, e long")
    assert {x.id for x in trims.trimmed_beside(spans, counts).collect()} == {i for i, *_ in made} - set(left)
    assert trims.trimmed_beside(spans.limit(0), counts).count() == 0


def test_without_top(spark):
    r = random.Random(5)
    made = [(i, i % 50, [r.choice([2000, 2000, 2001, 2005, 2010 + r.randrange(9)]) for _ in range(r.randrange(1, 4))]) for i in range(300)]
    real = Counter({2001: 30, 2002: 400, 2003: 20})
    left, spared, share = {i: own for i, _, own in made}, set(), Fraction(1, 10)
    gone = {}
    for k in range(40):
        counts = real + Counter(v for own in left.values() for v in own)
        total = sum(counts.values())
        over = sorted((-c, v) for v, c in counts.items() if c > share * total and v not in spared)
        if not over:
            break
        value, out = over[0][1], []
        c = counts[value]
        for i, t, own in sorted(((i, t, own) for i, t, own in made if i in left and value in own), key=lambda x: (len(set(x[2])) > 1, -x[1], x[0])):
            if c <= share * total:
                break
            c, total = c - own.count(value), total - len(own)
            out.append(i)
        for i in out:
            gone[i] = k
            del left[i]
        if not out or not any(value in own for own in left.values()):
            spared.add(value)
    spans = spark.createDataFrame([(i, t, v) for i, t, own in made for v in own], "id long, turn long, value long")
    counts = spark.createDataFrame(list(real.items()), "value long, n long")
    got, over = trims.without_top(spans, counts, share)
    assert {x.id: x.round for x in got.collect()} == gone and len(set(gone.values())) > 1
    assert [x.value for x in over.collect()] == [2002]


def test_cut_ends(spark):
    """The first place before which the steps add up to the excess, steps below 0 too, from few rows."""
    from pyspark.sql import functions as F

    r = random.Random(11)
    rows = [(g, place, r.choice((3, 2, 1, -1, -2) if g < 6 else (1, -3))) for g in range(8) for place in r.sample(range(5000), 700)]
    excess = {g: r.randrange(1, 500) for g in range(8)}
    able = spark.createDataFrame([(g, excess[g], s, p // 100, p) for g, p, s in rows], "g int, excess long, step long, part int, place int")
    want = {}
    for g in range(8):
        total = 0
        for _, p, s in sorted(x for x in rows if x[0] == g):
            if total >= excess[g]:
                want[g] = p
                break
            total += s
    assert {x.g: x.end for x in trims.cut_ends(able, "g").collect()} == want and 0 < len(want) < 8
    assert trims.cut_ends(able.where(F.lit(False)), "g").count() == 0


def test_partitions_follow_rows(spark, small, monkeypatch):
    """Tables of trims are dealt out by rows, so that a task has as much whatever their size."""
    from millrace.operators import common
    from millrace.plans import trims as plans

    monkeypatch.setattr(common, "ROWS", 500)
    n = spark.read.parquet(f"{small}/lineitem.parquet").count()
    want = -(-n // 500)
    assert want > 4
    assert {x.rdd.getNumPartitions() for x in plans.items(spark, small)} == {want}
    assert {x.rdd.getNumPartitions() for x in plans.mixed(spark, small)} == {want}
