from __future__ import annotations

import random

from pyspark.sql import functions as F

from millrace.functions import align, numbers, text

from .test_operators import one


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignments_are_best_and_whole():
    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(9))] for _ in range(2))
        pairs = align.aligned(a, b)
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
        assert sum(i is None or j is None or a[i] != b[j] for i, j in pairs) == plain_distance(a, b)


def test_alignment_agrees_with_word_distance(spark):
    r = random.Random(1)
    rows = [([r.choice("abcde") * 4 for _ in range(r.randrange(12))], [r.choice("abcde") * 4 for _ in range(r.randrange(12))]) for _ in range(60)] + [(None, ["x"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").withColumn("p", align.align("a", "b"))
    got = df.select(align.edits(F.col("p"), F.col("a"), F.col("b")).alias("e"), text.word_distance("a", "b").alias("d"), align.lost_words(F.col("p"), F.col("a")).alias("l"), align.added_words(F.col("p"), F.col("b")).alias("n"), "a", "b").where("a is not null").collect()
    assert all(x.e == x.d and len(x.a) - len(x.l) == len(x.b) - len(x.n) for x in got)


def test_word_distance_of_many_distinct_words(spark):
    a = [f"w{k}" for k in range(8300)]
    b = [*a[:8250], *a[:8249:-1]]
    assert one(spark, text.word_distance("a", "b"), a=a, b=b) == plain_distance(a[8250:], b[8250:]) == 50


def test_folding(spark):
    assert [one(spark, align.folded("t"), t=t) for t in ("Straße, Éa 21!", "Ёлка", "", None)] == ["strasseea21", "елка", "", None]


def test_clocks_and_money(spark):
    c = lambda t: one(spark, numbers.clock_readings(F.col("t")), t=t)
    assert c("7:30") == ["seven thirty", "half past seven"] and c("12:45") == ["twelve forty five", "quarter to one"] and c("9:05") == ["nine oh five"] and c("8:00") == ["eight o'clock"] and c("25:00") == [] and c("x") == []
    m = lambda t: one(spark, numbers.money_reading(F.col("t")), t=t)
    assert m("$1.01") == "one dollar and one cent" and m("£20") == "twenty pounds" and m("€3.50") == "three euros and fifty cents" and m("12") is None


def test_long_arrays_take_little_memory_and_time():
    import random
    import time
    import tracemalloc

    r = random.Random(2)
    a = [r.choice("abcdefgh") for _ in range(3000)]
    b = [w for w in a if r.random() < 0.95]
    tracemalloc.start()
    pairs = align.aligned(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    start = time.time()
    assert align.edit_distance(a, b) == sum(i is None or j is None or a[i] != b[j] for i, j in pairs)
    # The table of all costs has 34 MB; a loop over it takes seconds.
    assert peak < 8 << 20 and time.time() - start < 1


def test_edit_distance_equals_plain():
    import random

    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.choice("abc") for _ in range(r.randrange(9))] for _ in range(2))
        assert align.edit_distance(a, b) == plain_distance(a, b)


def test_alignment_of_missing_arrays(spark):
    df = spark.createDataFrame([(1, None, ["x"]), (2, ["x"], ["x", "y"]), (3, ["y"], None), (4, [], []), (5, ["p", "q"], ["q"])], "k long, a array<string>, b array<string>").coalesce(1)
    got = {r.k: None if r.p is None else [(x.i, x.j) for x in r.p] for r in df.select("k", align.align("a", "b").alias("p")).collect()}
    assert got == {1: None, 2: [(0, 0), (None, 1)], 3: None, 4: [], 5: [(0, None), (1, 0)]}
