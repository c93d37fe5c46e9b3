"""Ids, label rules and mixes against plain versions."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import ids, labels
from millrace.operators import generate, ledger, select

from .test_operators import one


def test_units(spark):
    u = lambda i: one(spark, ids.group_unit(F.col("i"), F.lit("a b")), i=i)
    assert [u(x) for x in ("en001_22_abcdefghijk_1", "20180618-0900-PLENARY-3_x", "fleurs_17_2", "cv22_9", "x1")] == ["yt:abcdefghijk", "ep:20180618-0900-PLENARY-3", "fl:17", "cv:a b", "id:x1"]
    assert [u(x) for x in ("20180618-1500-COMMITTEE-2_en_9", "x_PLENARY_2", "fleursdev_8_1")] == ["ep:20180618-1500-COMMITTEE-2", "ep:x", "fl:8"]


def test_recordings(spark):
    r = lambda i: tuple(one(spark, ids.recording(F.col("i")), i=i))
    assert r("en001_22_abcdefghijk_7_25_3_50_p2") == ("yt", "abcdefghijk", 7.25, 10.75)
    assert r("20090113-0900-PLENARY-12-de_5") == ("gv", "20090113-0900-PLENARY-12", None, None)
    assert r("plain_p3") == ("id", "plain", None, None)
    assert r("20090113-0900-PLENARY-12-de_20090113-09:12:04_3") == ("vox", "20090113-09:12:04_3", None, None)


def test_copies_share_a_key(spark):
    k = lambda p, v: one(spark, ids.stable_key(F.col("p"), F.lit("said"), F.col("v")), p=p, v=v)
    assert k("a/b/row1.wav", "v") == k("c/row1__aug.wav", "w") == "a:row1"
    assert k("spd_1.wav", "v") == k("spd_2.wav", "v") != k("spd_2.wav", "w") and k("spd_1.wav", None).startswith("tx:")
    said = hashlib.sha1(b"said").hexdigest()[:16]
    assert k("spd_1.wav", "v") == f"vt:v|{said}" and k("spd_1.wav", "") == f"tx:{said}"
    assert [one(spark, ids.variant(F.col("p")), p=p) for p in ("x/spd_1.wav", "x/aug/1.wav", "x/1__aug.wav", "x/1.wav")] == ["spd", "aug", "aug", "clean"]


def test_rules(spark):
    assert one(spark, labels.fits(F.col("a"), F.col("b")), a="two three", b="one two three four") and not one(spark, labels.fits(F.col("a"), F.col("b")), a="wo three", b="one two three")
    edges = lambda a, b: one(spark, labels.edges_agree(F.col("a"), F.col("b")), a=a.split(), b=b.split())
    assert edges("1 2 9 4 5", "1 2 3 4 5") and not edges("1 2 3 5", "1 2 3 4") and edges("1", "1")
    share = lambda t0, t1: one(spark, labels.inside_share(F.col("x"), F.col("y"), F.lit(0.0), F.lit(10.0)), x=t0, y=t1)
    assert share(-1.0, 1.0) == 0.5 and share(2.0, 3.0) == 1 and share(11.0, 12.0) == 0 and share(3.0, 3.0) == 0
    assert one(spark, labels.negations(F.col("w"), F.lit("en")), w="it is not no not".split()) == ["no", "not", "not"]
    mismatch = lambda lang, a, b: one(spark, labels.negation_mismatch(labels.negations(F.col("a"), F.lit(lang)), labels.negations(F.col("b"), F.lit(lang))), a=a.split(), b=b.split())
    assert mismatch("fr", "on a dit ne pas", "on n a dit pas pas") == "lost pas" and mismatch("nl", "niks niet", "niets") == "extra niet" and mismatch("de", "nicht", "nicht") is None
    assert one(spark, labels.classified(F.col("t"), [("b", "x"), ("a", "y")], "z"), t="ab") == "x"


def test_mix_repeats_parts(spark):
    a = spark.createDataFrame([(i, 10) for i in range(10)], "id long, n long")
    got = select.mixed([(a, 25, "a", 1), (a, None, "b", 3)], "n", "id")
    assert {(r.part, r["count"]) for r in got.groupBy("part").count().collect()} == {("a", 3), ("b", 30)}


def test_fill_stops_at_the_floor_or_the_pool(spark):
    rows = spark.createDataFrame([(0, ["a"])], "id long, v array<string>")
    pool = spark.createDataFrame([(i, ["a", "b"][: i % 2 + 1]) for i in range(1, 20)] + [(50, ["c"])], "id long, v array<string>")
    got = select.filled_to_floor(rows, pool, "v", "id", 4)
    assert got.count() == got.select("id").distinct().count()
    n = {r.v: r.n for r in got.select(F.explode("v").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n["a"] >= 4 and n["b"] >= 4 and n["c"] == 1


def test_bins_and_pairs(spark):
    df = spark.createDataFrame([(i, 10) for i in range(30)], "id long, n long")
    assert generate.binned(df, F.col("n"), "id", [], 100).groupBy("bin").count().collect() and {r["count"] for r in generate.binned(df, F.col("n"), "id", [], 100).groupBy("bin").count().collect()} == {10}
    assert {tuple(r) for r in generate.pairs(spark.createDataFrame([("g", 1), ("g", 5), ("g", 3), ("h", 1)], "g string, v int"), "g", "v").collect()} == {("g", 1, 3), ("g", 3, 5)}


def test_a_ledger_only_grows(spark, tmp_path):
    path = str(tmp_path / "decisions")
    made = lambda *rows: spark.createDataFrame(rows, "id long, row_id long, span_ord int, action string, reason string, decided_by string, new_label string")
    ledger.append(ledger.checked(made((1, 7, None, "drop", "r", "rule", None), (2, 7, 0, "keep", "r", "human", None))), path)
    before = ledger.files(spark, path).collect()
    ledger.append(ledger.checked(made((3, 8, None, "relabel", "r", "human", "x"))), path)
    known = spark.createDataFrame(before)
    assert ledger.tampered(known, ledger.files(spark, path)).isEmpty()
    rows = spark.createDataFrame([(7, "a"), (8, "b"), (9, "c")], "row_id long, label string")
    got = {r.row_id: (r.action, r.final_label) for r in ledger.row_state(rows, spark.read.parquet(path)).collect()}
    assert got == {7: ("drop", "a"), 8: ("relabel", "x"), 9: ("keep", "c")}
    for bad in ((4, 7, None, "relabel", "r", "human", ""), (4, 7, None, "lose", "r", "human", None), (4, 7, None, "keep", "r", "nobody", None)):
        with pytest.raises(Exception, match="not a decision"):
            ledger.append(ledger.checked(made(bad)), path)
    assert spark.read.parquet(path).count() == 3
    next(f for f in (tmp_path / "decisions").iterdir() if f.name == before[0].file).unlink()
    assert [r.file for r in ledger.tampered(known, ledger.files(spark, path)).collect()] == [before[0].file]
    have = spark.createDataFrame([(1, "a", "x")], "row_id long, label string, origin string")
    more = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "b", "x")], "row_id long, label string, origin string")
    assert [tuple(r) for r in ledger.new_candidates(have, more).collect()] == [(1, "b", "x")]
