"""Operators against plain versions on small tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import unicodedata
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import classes, numbers, stats, text
from millrace.operators import census, dedupe, ledger, paired, select, sequences, vectors
from millrace.sources import files
from millrace.streaming import events


def one(spark, column, **values):
    """A column's value over one row of these values."""
    kinds = {str: "string", int: "long", float: "double", list: "array<string>", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_budget_takes_the_row_that_crosses(spark):
    df = spark.createDataFrame([(i, "x", 10) for i in range(100)] + [(1000 + i, None, 3) for i in range(5)], "id long, g string, size long")
    got = select.budget_take(df, F.lit(25), F.col("size"), "id", ["g"]).collect()
    assert sum(r.g == "x" for r in got) == 3 and sum(r.g is None for r in got) == 5
    assert select.budget_take(df, F.lit(0), F.col("size"), "id", ["g"]).count() == 0
    assert select.budget_take(df.limit(0), F.lit(5), F.col("size"), "id").count() == 0


def test_caps_follow_on_each_other(spark):
    rows = [(1, "t", "g", True), (2, "t", "g", False), (3, "t", "g", False), (4, "u", "g", False), (5, "u", "g", False), (6, "", "h", False), (7, "", "h", False), (8, "", "h", False)]
    df = spark.createDataFrame(rows, "id long, t string, g string, rare boolean")
    got = {r.id for r in select.capped(df, F.col("rare"), "id", [("t", 1, F.col("t") != ""), ("g", 2, F.lit(True))]).collect()}
    assert 1 in got and not got & {2, 3} and len(got & {4, 5}) == 1 and len(got & {6, 7, 8}) == 2


def test_rare_rows_stay_over_both_caps(spark):
    df = spark.createDataFrame([(i, "t", True) for i in range(5)], "id long, t string, rare boolean")
    assert select.capped(df, F.col("rare"), "id", [("t", 2, F.lit(True))]).count() == 5


def test_value_limit_holds():
    r = random.Random(0)
    for _ in range(50):
        counts = [r.randrange(1, 200) for _ in range(r.randrange(40, 80))]
        limit = select.value_limit(counts, 0.05, rounds=50)
        total = sum(min(c, limit) for c in counts)
        assert limit == 1 or limit <= 0.05 * total + 1


def test_largest_n_per_group(spark):
    r = random.Random(1)
    rows = [(r.randrange(12), r.random() < 0.6) for _ in range(400)]
    df = spark.createDataFrame(rows, "g long, inside boolean")
    sizes = [sum(1 for g, i in rows if g == k and i) for k in range(12)]
    outside = sum(1 for _, i in rows if not i)
    for target in (0.2, 0.35, 0.5, 0.9):
        fits = [n for n in range(1, max(sizes) + 1) if sum(min(s, n) for s in sizes) <= target * (sum(min(s, n) for s in sizes) + outside)]
        got = select.largest_n_per_group(df, "g", F.col("inside"), target).collect()
        assert [x.n for x in got] == [max(fits)]


def test_quotas_are_met_rarest_first(spark):
    r = random.Random(2)
    rows = [(i, [c for c, p in (("a", 0.5), ("b", 0.1), ("c", 0.03)) if r.random() < p]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, c array<string>")
    got = select.quota_select(df, "c", {"a": 30, "b": 20, "c": 100}, "id").collect()
    assert len({x.id for x in got}) == len(got)
    n = lambda k, some: sum(k in x[1] for x in some)
    assert n("c", got) == n("c", rows) and n("b", got) >= min(20, n("b", rows)) and n("a", got) >= 30


def test_carve_takes_whole_groups_within_the_share(spark):
    r = random.Random(3)
    rows = [(r.randrange(30), ["k"] if r.random() < 0.5 else []) for _ in range(400)]
    df = spark.createDataFrame(rows, "g long, c array<string>")
    took = {x.g for x in select.carve_groups(df, "g", "c", {"k": 40}, 0.2).collect()}
    held = sum(bool(c) for g, c in rows if g in took)
    assert took and held <= min(40, 0.2 * sum(bool(c) for _, c in rows))


def test_round_robin(spark):
    df = spark.createDataFrame([(i, "ab"[i % 7 == 0]) for i in range(70)], "id long, c string")
    got = select.round_robin(df, ["c"], "id", 7).collect()
    assert sorted(x.c for x in got) == ["a"] * 4 + ["b"] * 3


def plain_greedy(n, pairs):
    kept = []
    for i in range(n):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    return kept


def test_greedy_rule_is_not_components(spark):
    ids = spark.createDataFrame([(i,) for i in range(3)], "id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    assert sorted(r.id for r in dedupe.greedy_kept(ids, pairs).collect()) == [0, 2]


def test_greedy_equals_plain(spark):
    r = random.Random(4)
    for _ in range(3):
        pairs = {(a, b) for a in range(25) for b in range(a + 1, 25) if r.random() < 0.12}
        ids = spark.createDataFrame([(i,) for i in range(25)], "id long")
        got = dedupe.greedy_kept(ids, spark.createDataFrame(sorted(pairs), "a long, b long"))
        assert sorted(x.id for x in got.collect()) == plain_greedy(25, pairs)


def test_similar_pairs_equal_plain(spark):
    r = random.Random(5)
    sets = [sorted(r.sample("abcdefghijkl", r.randrange(1, 8))) for _ in range(30)] + [["q"], ["q"]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, s array<string>")
    for least in ((3, 5), (4, 5), (1, 1)):
        got = {(x.a, x.b) for x in dedupe.similar_pairs(dedupe.shingle_sets(df, "id", F.col("s")), least).collect()}
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and Fraction(len({*a} & {*b}), len({*a} | {*b})) >= Fraction(*least)}
        assert got == want


def test_greatest_similarity_shuffles_no_shingles_for_a_small_index(spark, monkeypatch):
    rows = lambda sets: spark.createDataFrame([(i, len(s), x) for i, s in sets.items() for x in s], "id long, n int, sh long")
    got = []
    for most in (dedupe.BROADCAST_INDEX, 0):
        monkeypatch.setattr(dedupe, "BROADCAST_INDEX", most)
        best = dedupe.greatest_similarity(rows({1: [1, 2, 3], 2: [4, 5], 3: [9]}), rows({7: [1, 2, 6], 8: [3], 9: [4, 5]}))
        got.append({x.id: x.similarity for x in best.collect()})
        if most:
            assert "BroadcastHashJoin [sh" in best._jdf.queryExecution().sparkPlan().toString()
    assert got == [{1: 0.5, 2: 1.0, 3: 0.0}] * 2


def test_similar_sets_send_few_shingles_on_and_lose_no_pair(spark):
    r = random.Random(8)
    sets = []
    for _ in range(60):
        own = [*range(3), *(r.randrange(10**6) - 10**5 for _ in range(r.randrange(30)))]
        sets += [sorted({*own}), sorted({*own, *(r.randrange(10**6) for _ in range(r.randrange(1, 6)))})]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, shingles array<bigint>")
    ahead = dedupe.rarest_first(df, (4, 5)).collect()
    assert len(ahead) == sum(len(s) - -(-4 * len(s) // 5) + 1 for s in sets)
    assert not any(x.sh in range(3) and x.nth == 0 and x.n > 8 for x in ahead)
    for least in ((3, 5), (4, 5)):
        got = {(x.a, x.b): x.common for x in dedupe.similar_sets(df, least).collect()}
        both = {(i, j): len({*a} & {*b}) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j}
        assert got == {p: c for p, c in both.items() if Fraction(c, len({*sets[p[0]]} | {*sets[p[1]]})) >= Fraction(*least)}


def are_alike(a, b, least):
    return Fraction(len({*a} & {*b}), len({*a} | {*b})) >= Fraction(*least)


def looked_at(monkeypatch):
    """The numbers of pairs whose sets are compared from now on."""
    seen, alike = [], dedupe.alike
    monkeypatch.setattr(dedupe, "alike", lambda pairs, *more: seen.append(pairs.count()) or alike(pairs, *more))
    return seen


@pytest.mark.parametrize("every", [3, 16])
def test_similar_sets_that_must_meet_again_lose_no_pair(spark, monkeypatch, every):
    monkeypatch.setattr(dedupe, "EVERY", every)
    r = random.Random(10)
    sets = []
    for _ in range(25):
        own = [*range(r.randrange(40)), *(r.randrange(200) for _ in range(r.randrange(1, 90)))]
        sets += [[x for x in {*own} if r.random() < share] + [r.randrange(10**6)] for share in (1, 0.95, 0.8, 0.7)]
    df = spark.createDataFrame([(i, sorted({*s})) for i, s in enumerate(sets)], "id long, shingles array<bigint>")
    for least in ((3, 5), (4, 5), (1, 30)):
        got = {(x.a, x.b) for x in dedupe.similar_sets(df, least).collect()}
        assert got == {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and are_alike(a, b, least)}


def test_similar_sets_compare_no_sets_that_share_one_rare_shingle_of_many(spark, monkeypatch):
    seen = looked_at(monkeypatch)
    df = spark.createDataFrame([(i, [0, *range(1000 * i + 1, 1000 * i + 100)]) for i in range(20)], "id long, shingles array<bigint>")
    monkeypatch.setattr(dedupe, "COUNTED", 1)  # the shared shingle, the least, then comes first
    monkeypatch.setattr(dedupe, "RUN", 1)
    assert dedupe.similar_sets(df, (3, 5)).isEmpty() and seen == [0]


def test_greedy_similar_equals_plain_and_looks_at_few_pairs_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "FIRST_WAVE", 8)
    r, seen = random.Random(9), looked_at(monkeypatch)
    group = [[*range(40), 1000 + i] for i in range(200)]
    chain = [[*range(100 + 3 * i, 120 + 3 * i)] for i in range(40)]
    sets = group + chain + [r.sample(range(3000, 3030), r.randrange(1, 12)) for _ in range(40)]
    r.shuffle(sets)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, shingles array<bigint>")
    df = df.withColumn("wave", dedupe.waves(df))
    assert [x["count"] for x in df.groupBy("wave").count().orderBy("wave").collect()] == [8, 24, 96, 152]
    kept = []
    for i, s in enumerate(sets):
        if not any(are_alike(s, sets[k], (3, 5)) for k in kept):
            kept.append(i)
    assert sorted(x.id for x in dedupe.greedy_similar(df, (3, 5)).collect()) == kept
    assert sum(seen) < 5 * len(sets)


def test_overlaps_equal_plain(spark):
    r = random.Random(6)
    rows = [(i, "k" if r.random() < 0.7 else "l", s := r.uniform(0, 50), s + r.uniform(0.1, 12)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k string, s double, e double")
    got = {(x.a, x.b) for x in dedupe.overlaps(df, df, "k", 0.5, 4.0).where("a < b").collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and min(a[3], b[3]) - max(a[2], b[2]) > 0.5 * min(a[3] - a[2], b[3] - b[2])}
    assert got == want


def test_floors_fail_for_missing_values(spark):
    got = {r.y: r.ok for r in census.floors(spark.createDataFrame([(2001, 5), (2003, 1)], "y int, n long"), "y", 2001, 2003, 2).collect()}
    assert got == {2001: True, 2002: False, 2003: False}


def test_order_statistics(spark):
    r = random.Random(7)
    rows = [("g", r.randrange(20)) for _ in range(37)] + [("h", 4)]
    got = {x.g: x for x in census.order_statistic(spark.createDataFrame(rows, "g string, v long"), ["g"], "v", {"p10": 0.1, "p99": 0.99, "p100": 1.0}).collect()}
    v = sorted(v for g, v in rows if g == "g")
    assert (got["g"].p10, got["g"].p99, got["g"].p100) == (v[3], v[int(0.99 * 37)], v[-1]) and got["h"].p10 == 4


def test_exact_tests_of_many_moves():
    import pandas as pd

    a, b = pd.Series([2_000_000, 20_000_000, 700, 1450]), pd.Series([2_003_000, 20_001_000, 5, 1551])
    got = list(stats.sign_p.func(a, b))
    # With a correction for steps the normal approximation holds to six digits here.
    near = [math.erfc((y - x - 1) / math.sqrt(2 * (x + y))) for x, y in ((2_000_000, 2_003_000), (20_000_000, 20_001_000))]
    whole = [float(Fraction(2 * sum(comb(x + y, i) for i in range(min(x, y) + 1)), 2 ** (x + y))) for x, y in ((700, 5), (1450, 1551))]
    assert got[:2] == pytest.approx(near, abs=1e-6) and got[2:] == pytest.approx(whole, rel=1e-9)


def test_exact_tests_and_intervals(spark):
    df = spark.createDataFrame([(0, 0), (1, 5), (10, 10), (300, 200)], "a long, b long")
    for x in df.select("a", "b", stats.sign_p("a", "b").alias("p")).collect():
        n = x.a + x.b
        assert x.p == pytest.approx(min(1, float(Fraction(2 * sum(comb(n, i) for i in range(min(x.a, x.b) + 1)), 2**n))) if n else 1)
    low, high = stats.wilson(F.lit(8), F.lit(10))
    got = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert got.l == pytest.approx(0.4902, abs=1e-3) and got.h == pytest.approx(0.9433, abs=1e-3)


def test_bootstrap_brackets_the_ratio(spark):
    r = random.Random(8)
    rows = [(i, r.randrange(5), 5) for i in range(300)]
    df = spark.createDataFrame(rows, "c long, x long, n long")
    got = stats.bootstrap_ratio(df, [], "x", "n", "c", reps=300).first()
    again = stats.bootstrap_ratio(df.repartition(7), [], "x", "n", "c", reps=300).first()
    assert got.low < got.ratio < got.high and got.high - got.low < 0.15
    assert (got.low, got.high) == pytest.approx((again.low, again.high))


def test_seams(spark):
    reads = [("l", 1, True), ("l", 1, False), ("l", 1, False), ("l", 1, True), ("l", 1, False)] + [("l", 2, False)] * 5 + [("l", 3, True)] * 4
    df = spark.createDataFrame(reads, "lang string, slot long, ok boolean")
    got = paired.seam_counts(df, ["lang"], ["slot"], "ok").first()
    assert (got.n, got.total, got.seam, got.always) == (14, 8, 3, 5)
    assert [x.slot for x in paired.incomplete_slots(df, ["slot"], 5).collect()] == [3]


def test_no_damage_fails_on_a_missing_key(spark):
    base = spark.createDataFrame([("a", 0.10), ("b", 0.10), ("c", 0.1)], "k string, rate double")
    arm = spark.createDataFrame([("a", 0.11), ("b", 0.13)], "k string, rate double")
    assert {r.k: r.ok for r in paired.no_damage(base, arm, "k", 2).collect()} == {"a": True, "b": False, "c": False}


def test_labels_are_built_from_spans(spark):
    df = spark.createDataFrame([("at 10 or 20 now", [(3, 5, "ten"), (9, 11, "twenty")]), ("none", [])], "t string, s array<struct<a:int,b:int,new:string>>")
    assert [r[0] for r in df.select(paired.replaced(F.col("t"), F.col("s"))).collect()] == ["at ten or twenty now", "none"]


def test_later_attempts_supersede(spark):
    steps = spark.createDataFrame([(1, s) for s in range(1, 6)] + [(2, s) for s in range(3, 5)], "attempt long, step long")
    got = ledger.effective_steps(steps, spark.createDataFrame([(1, 0), (2, 3)], "attempt long, start long")).collect()
    assert sorted((r.attempt, r.step) for r in got) == [(1, 1), (1, 2), (2, 3), (2, 4)]


def test_last_decision_wins_and_exports(spark):
    d = spark.createDataFrame([(1, 1, "drop", None), (1, 2, "relabel", "new"), (2, 3, "drop", None), (3, 4, "keep", "x")], "row long, n long, action string, new_label string")
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "row long, t string")
    got = {r.row: r.t for r in ledger.exported(rows, ledger.latest(d, ["row"], ["n"]), "row", "t").collect()}
    assert got == {0: "t0", 1: "new", 3: "t3", 4: "t4"}


def test_windows_and_offsets(spark):
    at = lambda d: one(spark, sequences.window_starts(F.col("d"), 15.0, 10.0), d=d)
    assert at(3.0) == [0.0] and at(15.0) == [0.0] and at(15.5) == [0.0, 10.0] and at(36.0) == [0.0, 10.0, 20.0, 30.0]
    assert sequences.offsets(5, 10.0) == [0.0, 2.0, 4.0, 6.0, 8.0]


def test_groups_start_at_an_anchor(spark):
    df = spark.createDataFrame([("u", t) for t in (0.0, 1.5, 2.5, 3.9, 4.6, 9.0, 9.0)], "u string, t double")
    got = sorted((r.t, r.anchor) for r in sequences.anchored(df, ["u"], "t", 2.0).collect())
    assert got == [(0.0, 0.0), (1.5, 0.0), (2.5, 2.5), (3.9, 2.5), (4.6, 4.6), (9.0, 9.0), (9.0, 9.0)]


def test_nearest_takes_the_earlier_of_two(spark):
    p = spark.createDataFrame([("u", 1, 5.0), ("u", 2, 6.0), ("v", 3, 1.0)], "u string, id long, x double")
    m = spark.createDataFrame([("u", 4.0), ("u", 6.0), ("u", 9.0)], "u string, m double")
    assert {r.id: r.nearest for r in sequences.nearest(p, m, "u", "x", "m").collect()} == {1: 4.0, 2: 6.0, 3: None}


def test_best_match_is_not_itself(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, e array<float>")
    u = vectors.unit(df, "id", "e")
    assert {r.id: r.other for r in vectors.best_matches(u, u).collect()} == {1: 2, 2: 1, 3: 2}
    assert vectors.best_matches(u.where("id = 1"), u.where("id = 1")).count() == 0


def test_frames(spark):
    f = lambda t: one(spark, text.frame("w"), w=t.split())
    assert f("call me at twenty past three on may 5") == ["call", "me", "at", "#", "past", "#", "on", "#"]
    assert f("one two three") == ["#"]
    assert one(spark, text.template("t"), t="Pay 12 euros by 2030") == "pay # euros by #" and one(spark, text.template("t"), t="12 euros") == ""
    assert one(spark, text.template("t"), t=None) == ""


def test_words_are_compared(spark):
    d = lambda a, b: one(spark, text.word_distance("a", "b"), a=a.split(), b=b.split())
    assert d("the cat sat on the mat", "the bat sat the mat mat") == 3 and d("", "a b") == 2
    assert one(spark, text.collapse_repeats("t"), t="go go to the the shop to the shop") == "go to the shop"
    assert one(spark, text.primitive_period("t"), t="ababab") == 2 and one(spark, text.primitive_period("t"), t="abc") == 3
    assert one(spark, text.unaccented("t"), t="Straße été") == "strasse ete"
    for odd in ("Zażółć gęślą jaźń", "Příliš žluťoučký kůň", "Árvíztűrő tükörfúrógép", "Ĳssel ﬁn ½ ™ Ⅷ ｗｉｄｅ", "й ї е\u0301", "日本 한글", "", "𝐀𝐛"):
        folded = "".join(c for c in unicodedata.normalize("NFKD", odd.lower()) if not unicodedata.combining(c))
        want = folded if "한" not in odd else "日本 한글"
        assert one(spark, text.unaccented("t"), t=odd).replace("⁄", "/") == want.replace("⁄", "/"), odd
    assert one(spark, text.unaccented("t"), t=None) is None


def test_span_classes(spark):
    c = lambda v: one(spark, classes.span_class(F.col("v")), v=v)
    assert [c(v) for v in ("1999", "2100", "1492", "999", "1,000", "0,999", "12345678901234567890")] == ["year", "int_big", "year_early", "int_small", "int_big", "int_small", "int_big"]


READS = [
    ("twenty one", [21]),
    ("one hundred and five", [105]),
    ("two thousand three hundred forty", [2340]),
    ("nineteen eighty four", [1984]),
    ("twenty twenty", [2020]),
    ("nineteen hundred", [1900]),
    ("one million two", [1000002]),
    ("five six seven", [5, 6, 7]),
    ("it is 1,234 or 5.5", [1234, 5.5]),
    ("zero", [0]),
    ("hundred things and more", []),
    ("three and four", [3, 4]),
    ("a hundred thousand", []),
    ("thirty eleven", [30, 11]),
    ("", []),
]


@pytest.mark.parametrize(("said", "values"), READS)
def test_numbers_are_read(spark, said, values):
    got = one(spark, numbers.read(F.col("w")), w=said.split())
    assert [float(n.value) for n in got] == values


def test_numbers_are_spelled(spark):
    c = lambda n: one(spark, numbers.cardinal(F.col("n")), n=n)
    assert c(0) == "zero" and c(115) == "one hundred fifteen" and c(1_000_001) == "one million one" and c(-1) is None and c(10**12) is None
    assert one(spark, numbers.candidates(F.col("v")), v="1905") == ["one thousand nine hundred five", "one nine zero five", "nineteen oh five", "one thousand nine hundred and five"]
    assert one(spark, numbers.candidates(F.col("v")), v="x1") == []


def test_tokens_have_several_values(spark):
    v = lambda t: [float(x) for x in one(spark, numbers.digit_values(F.col("v")), v=t)]
    assert v("1.234") == [1234, 1.234] and v("1.23") == [1.23] and v("77") == [77] and v("1,234,567") == [1234567] and v("x") == []
    assert [one(spark, numbers.roman_value(F.col("v")), v=t) for t in ("XIV", "MCMXC", "IIX", "")] == [14, 1990, None, None]
    assert one(spark, numbers.digit_runs(F.col("w")), w="call double five oh triple two now one two".split()) == ["550222"]
    assert one(spark, numbers.without_separators(F.col("t"), F.lit("de")), t="1.234.567,5 und 1.23") == "1234567,5 und 1.23"


def test_number_outcomes(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 9.0, 3.0, 4.0]), ([5.0], []), (None, [1.0])], "a array<double>, b array<double>")
    got = [tuple(r.o) for r in df.select(numbers.outcomes("a", "b").alias("o")).collect()]
    assert got == [(2, 1, 0, 1), (0, 0, 1, 0), (0, 0, 0, 1)]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"said": "", "text": "x"}\n\n{"text": null}\n')
    (tmp_path / "b.json").write_text('[{"text": "y"}, {"text": "z"}]')
    (tmp_path / "held.txt").write_text("# group vox:20180618\n# a note\n20190101-0900-PLENARY-1\n\nen001_2_abcdefghijk_5\nplain\n")
    schema = "said string, text string"
    rows = files.texts(files.json_rows(spark, str(tmp_path / "a.jsonl"), schema)).collect()
    assert sorted(r.said for r in rows) == ["", "x"] and all(r.file.endswith("a.jsonl") for r in rows)
    assert files.json_any(spark, str(tmp_path / "b.json"), schema).count() == 2 and files.json_any(spark, str(tmp_path / "a.jsonl"), schema).count() == 2
    assert files.first_of(spark, [str(tmp_path / "none"), str(tmp_path / "a.jsonl")], schema).count() == 2
    assert files.first_of(spark, [str(tmp_path / "none")], schema).count() == 0
    ids, units = files.held_list(spark, str(tmp_path / "held.txt"))
    assert {r.id for r in ids.collect()} == {"20190101-0900-PLENARY-1", "en001_2_abcdefghijk_5", "plain"}
    assert {r.unit for r in units.collect()} == {"day:20180618", "day:20190101", "vid:abcdefghijk"}
    a = spark.createDataFrame([(1, "x"), (2, None)], "i long, t string")
    assert files.content_hash(a, ["i", "t"]).first() == files.content_hash(a.orderBy(F.desc("i")), ["i", "t"]).first()
    files.write_parts(a, str(tmp_path / "out"), "i")
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_seen_log(spark):
    lines = spark.createDataFrame([('{"start": 0, "manifest": "m"}',), ('{"step": 1, "h": ["a", "b"], "d": [10, 20]}',)], "value string")
    assert sorted(tuple(r) for r in events.seen(lines).collect()) == [(1, "a", 10), (1, "b", 20)]


def test_bounds_are_carried_over_buckets(spark):
    r = random.Random(4)
    spans = [(k, n, 100.0 * n + r.randrange(40), 100.0 * n + 50 + r.randrange(40)) for k in (1, 2) for n in range(40)]
    points = [(i, r.choice([1, 2, 3, None]), r.choice([None, *(r.uniform(-50, 4500) for _ in range(20))])) for i in range(300)]
    df = spark.createDataFrame(points, "id long, k long, at double")
    own = spark.createDataFrame(spans, "k long, n long, s double, e double")
    got = {x.id: x.n for x in sequences.assigned(df, own, "k", "at", width=37.0).collect()}
    for i, k, at in points:
        mine = sorted((s, e, n) for kk, n, s, e in spans if kk == k)
        bounds = [-float("inf"), *((a[1] + b[0]) / 2 for a, b in itertools.pairwise(mine))] if mine else []
        want = None if at is None or not mine else mine[sum(b <= at for b in bounds) - 1][2]
        assert got[i] == want
    marks = [(r.choice([1, 2]), r.uniform(0, 4000)) for _ in range(60)]
    near = {x.id: x.nearest for x in sequences.nearest(df.where("at is not null"), spark.createDataFrame(marks, "k long, m double"), "k", "at", "m", width=11.0).collect()}
    for i, k, at in points:
        if at is not None:
            mine = sorted((abs(m - at), m) for kk, m in marks if kk == k)
            assert near[i] == (mine[0][1] if mine else None)


def test_anchors_over_batches(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), float(r.randrange(4000))) for _ in range(3000)] + [("a", None)]
    df = spark.createDataFrame(rows, "u string, t double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = {(x.u, x.t): x.anchor for x in sequences.anchored(df, ["u"], "t", 9.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for u in ("a", "b", None):
        anchor = None
        for t in sorted({t for k, t in rows if k == u and t is not None}):
            anchor = t if anchor is None or t - anchor > 9.0 else anchor
            assert got[u, t] == anchor
    assert len(got) == len({x for x in rows if x[1] is not None})


def test_exposure_of_a_hot_key(spark):
    r = random.Random(6)
    draws = [(i, r.choice([1, 1, 1, 2, 9]), r.randrange(30)) for i in range(400)]
    index = [(i, r.choice([1, 1, 2, 3]), r.randrange(30), r.choice("xy")) for i in range(60)]
    d, i = spark.createDataFrame(draws, "draw long, h long, d long"), spark.createDataFrame(index, "i long, h long, d long, part string")
    times = dict.fromkeys(range(60), 0.0)
    for _, h, at in draws:
        own = [x for x in index if x[1] == h]
        own = [x for x in own if abs(x[2] - at) <= 2] or own
        for x in own:
            times[x[0]] += 1 / len(own)
    got = {x.part: (x.listed, x.draws, x.distinct) for x in ledger.exposure(d, i, 2).collect()}
    for part in "xy":
        groups = {}
        for k, h, at, p in index:
            if p == part:
                groups.setdefault((h, at), []).append(times[k])
        assert got[part] == pytest.approx((sum(map(len, groups.values())), sum(map(sum, groups.values())), sum(min(sum(v), 1.0) for v in groups.values())))


def test_caps_beside_a_hot_group(spark):
    rows = [(i, "" if i % 3 else f"t{i % 7}", i % 5, i % 11 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, t string, g long, rare boolean")
    got = {x.id for x in select.capped(df, F.col("rare"), "id", [("t", 4, F.col("t") != ""), ("g", 30, F.lit(True))]).collect()}
    h = lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), i)
    left = rows
    for group, most, applies in ((1, 4, lambda x: x[1] != ""), (2, 30, lambda x: True)):
        seen, kept = {}, []
        for x in sorted(left, key=lambda x: (not x[3], h(x[0]))):
            if not applies(x):
                kept.append(x)
                continue
            seen[x[group]] = seen.get(x[group], 0) + 1
            if x[3] or seen[x[group]] <= most:
                kept.append(x)
        left = kept
    assert got == {x[0] for x in left}
    assert select.value_limit([5, 5, 90], 0.5) == select.value_limit({5: 2, 90: 1}, 0.5)


def test_blocks_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 20)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((90, 5))
    x[7] = x[3]
    u = vectors.unit(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = y @ y.T
    np.fill_diagonal(cosine, -2)
    got = {r.id: (r.other, r.cosine) for r in vectors.best_matches(u, u).collect()}
    assert len(got) == 90
    for i, (other, value) in got.items():
        assert other == cosine[i].argmax() and abs(value - cosine[i].max()) < 1e-9
