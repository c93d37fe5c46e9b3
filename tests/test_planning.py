"""Allocation and variety, held against rules that go step by step."""

from __future__ import annotations

import heapq
import random
from collections import Counter

from pyspark.sql import functions as F

from millrace.operators import ordering, planning


def plain_run(values, new, cls, n, room, total, share, most):
    """values: {(class, value): (weight, have)}; new is added to."""
    def gain(v):
        w, c = values[cls, v][0], values[cls, v][1] + new[cls, v]
        return w * (1 / (1 + float(c)) - 1 / (1 + (float(c) + 1)))

    heap = [(-gain(v), v) for c, v in values if c == cls]
    heapq.heapify(heap)
    used, spent = sum(k for (c, _), k in new.items() if c == cls), 0
    while heap and spent < n and used < room:
        _, v = heapq.heappop(heap)
        if new[cls, v] >= most or values[cls, v][1] + new[cls, v] + 1 > share * (total + used + 1):
            continue
        new[cls, v] += 1
        spent, used = spent + 1, used + 1
        heapq.heappush(heap, (-gain(v), v))
    return spent


def frame(spark, values):
    return spark.createDataFrame([(c, v, float(w), h) for (c, v), (w, h) in values.items()], "class string, value long, weight double, have long")


def test_allocation_is_the_queues(spark):
    r = random.Random(7)
    values = {("a", v): (r.choice([0.5, 1, 2, 5]), r.choice([0, 0, 0, 1, 2, 9, 40])) for v in range(10_000)} | {("b", v): (r.random(), r.randrange(4)) for v in range(60)}
    totals = {c: sum(h for (k, _), (_, h) in values.items() if k == c) for c in "ab"}
    for limits, share, most in (({"a": 4000, "b": 100}, 0.0002, 5), ({"a": 500, "b": 200}, 0.02, 3)):
        want = Counter()
        for c, n in limits.items():
            plain_run(values, want, c, n, n, totals[c], share, most)
        got = planning.allocated(frame(spark, values), limits, totals, share, most)
        assert {(x["class"], x.value): x.new for x in got.collect()} == {k: n for k, n in want.items() if n}
    assert planning.allocated(frame(spark, values).limit(0), {"a": 5}, totals, 0.5, 3).count() == 0


def test_what_a_class_leaves_goes_to_others(spark):
    r = random.Random(8)
    values = {(c, v): (r.random() + 0.5, r.randrange(3)) for c, k in (("a", 300), ("b", 5), ("c", 80)) for v in range(k)}
    totals = {c: sum(h for (k, _), (_, h) in values.items() if k == c) for c in "abc"}
    rooms, shares, want = {"a": 90, "b": 30, "c": 100}, {"a": 0.2, "b": 0.5, "c": 0.3}, Counter()
    left = 150 - sum(plain_run(values, want, c, int(150 * shares[c]), rooms[c], totals[c], 0.1, 2) for c in "abc")
    for c in "ca":
        if left > 0:
            left -= plain_run(values, want, c, left, rooms[c], totals[c], 0.1, 2)
    got = planning.allocated_in_turn(frame(spark, values), 150, shares, rooms, totals, 0.1, 2, ["c", "a"])
    assert {(x["class"], x.value): x.new for x in got.collect()} == {k: n for k, n in want.items() if n}


def test_rows_are_taken_as_one_after_another(spark, monkeypatch):
    monkeypatch.setattr(ordering, "PART", 16)
    r = random.Random(9)
    for hot in (0.0, 0.5):
        rows = [(i, r.random(), "x" if r.random() < hot else r.choice("abcdef"), [str(r.randrange(12)) for _ in range(r.randrange(3))], r.choice([None, "t"])) for i in range(400)]
        caps, used, want = {"v": 20, "y": 9, "t": 30}, Counter(), set()
        for i, _, v, ys, t in sorted(rows, key=lambda x: (x[1], x[0])):
            groups = {f"v:{v}", *(f"y:{y}" for y in ys), *([f"t:{t}"] if t else [])}
            if all(used[g] < caps[g[0]] for g in groups):
                used.update(groups)
                want.add(i)
        df = spark.createDataFrame(rows, "id long, o double, v string, y array<string>, t string")
        got = planning.fitting(df, [F.col("o"), F.col("id")], {"v": (F.array("v"), 20), "y": (F.col("y"), 9), "t": (F.array("t"), 30)})
        assert {x.id for x in got.collect()} == want and 30 < len(want) < 300
    assert planning.fitting(df.limit(0), [F.col("o")], {"v": (F.array("v"), 20)}).count() == 0


def test_places_and_sums(spark):
    rows = [(i % 3, i * 7 % 20, 1 + i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, k int, n int")
    got = ordering.before(ordering.placed(df, [F.col("k"), F.desc("n")]), ["g"], F.col("n")).collect()
    assert sorted(x.turn for x in got) == list(range(200))
    order = sorted(got, key=lambda x: x.turn)
    assert [(x.k, -x.n) for x in order] == sorted((k, -n) for _, k, n in rows)
    sums = Counter()
    for x in order:
        assert x.before == sums[x.g]
        sums[x.g] += x.n


def test_fitting_from_the_head(spark, monkeypatch):
    """Rows are decided from the front on; those behind, of full groups, are never put through rounds. The same rows are taken."""
    r = random.Random(8)
    rows = [(i, r.choice("aaaab"), r.randrange(40)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v string, t int")
    groups = {"v": (F.array("v"), 25), "t": (F.array(F.col("t").cast("string")), 3)}
    monkeypatch.setattr(planning, "HEAD", 30)
    want, v, t = [], {}, {}
    for i, a, b in sorted(rows):
        if v.get(a, 0) < 25 and t.get(b, 0) < 3:
            v[a], t[b] = v.get(a, 0) + 1, t.get(b, 0) + 1
            want.append(i)
    sizes, ranked = [], planning.ordering.before
    monkeypatch.setattr(planning.ordering, "before", lambda each, *a, **k: sizes.append(each.select("id").distinct().count()) or ranked(each, *a, **k))
    assert sorted(x.id for x in planning.fitting(df, [F.col("id")], groups).collect()) == want
    assert sizes[0] == 30 and max(sizes) < 200
