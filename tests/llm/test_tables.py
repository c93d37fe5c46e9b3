"""Sharding, URL filters, chat formatting and the pipeline."""

from __future__ import annotations

import random
import zlib

from pyspark.sql import functions as F

from millrace.llm import chat, sharding, urlfilter

from .helpers import CLASHES, docs, prose, with_extra


def check_shards(rows, n):
    assert len(rows) == n
    by = {}
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r.size for r in by.get(k, [])) for k in range(24)]


def test_shards_are_whole_and_near_equal(spark):
    r = random.Random(0)
    hot = prose(1, 100)
    texts = [hot] * 800 + [prose(i, r.randrange(1, 300)) for i in range(1600)] + [None, ""]
    d = docs(spark, texts, **CLASHES)
    rows = sharding.sharded(d).collect()
    bytes_ = check_shards(rows, len(texts))
    for x in rows:
        t = (texts[x.doc_id] or "").encode()
        assert (x.size, x.text_crc32) == (len(t) + 8, zlib.crc32(t))
    mean = sum(bytes_) / 24
    assert max(bytes_) < 1.1 * mean and min(bytes_) > 0.9 * mean


def test_shards_of_odd_tables(spark):
    d = docs(spark, ["same"] * 300)
    assert max(check_shards(sharding.sharded(d).collect(), 300)) > 0
    assert sharding.sharded(d.limit(0)).count() == 0
    check_shards(sharding.sharded(docs(spark, ["one", None]).unionByName(docs(spark, ["one"]))).collect(), 3)
    check_shards(sharding.sharded(docs(spark, [None] * 5).withColumn("doc_id", F.lit(None).cast("long"))).collect(), 5)


def test_urls_and_rules(spark):
    urls = {
        "https://Example.COM/de/x?q": ("example.com", "/de/x", "example.com/de/", "block"),
        "http://a.b.example.net/en/": ("a.b.example.net", "/en/", "example.net/en/", "allow"),
        "http://a.example.net/fr/1": ("a.example.net", "/fr/1", "net/", "block"),
        "http://badexample.com/de/": ("badexample.com", "/de/", None, None),
        "x://w.org/fr/#f": ("w.org", "/fr/", "org/fr/", "allow"),
        "http://org?a": ("org", "", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        "http://net": ("net", "", None, None),
        "http://net/": ("net", "/", "net/", "block"),
        "http://ÄB.com/": ("Äb.com", "/", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "http://x.net\n/a\nb": ("x.net\n", "/a\nb", None, None),
    }
    rows = [(i, u, "") for i, u in enumerate(urls)] + [(99, None, "")]
    p = with_extra(spark.createDataFrame(rows, "page_id long, url string, html string"), {"host": 1, "path": 2, "n": 3, "bad": 4})
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urlfilter.judged(p, labels).collect()}
    for i, (u, (host, path, rule, verdict)) in enumerate(urls.items()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or "allow")
    assert (got[99].host, got[99].path, got[99].verdict) == ("", "", "allow")
    assert urlfilter.judged(p.limit(0), labels).count() == 0
    assert urlfilter.judged(p, labels.limit(0)).count() == len(rows)


def test_sql_of_url_templates_at_any_depth_and_width(spark):
    import duckdb

    r = random.Random(6)
    rows, marks = [], []
    for i in range(500):
        bad = r.random() < 0.5
        deep = "/".join(["a", "b", "c", "d", "e", "f", "g"][: r.randrange(8)])
        section = r.choice(("spam", "ads")) if bad else r.choice(("docs", "wiki"))
        wide = f"sec{chr(97 + r.randrange(26))}{'x' * r.randrange(3)}"
        rows.append((i, f"http://h{r.randrange(3)}.com/{deep}/{wide if r.random() < 0.4 else section}/{chr(97 + r.randrange(20))}/{i if r.random() < 0.8 else 'x'}", ""))
        if r.random() < 0.7:
            marks.append((i, int(not bad), 0))
    p, labels = spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    c = duckdb.connect()
    c.register("pages", p.toPandas())
    c.register("labels", labels.toPandas())
    want = sorted(map(tuple, c.sql(urlfilter.ORACLE).fetchall()), key=str)
    assert sorted(map(tuple, urlfilter.judged(p, labels).collect()), key=str) == want
    assert max(x[5].count("/") for x in want) > 8 and {x[4] for x in want} == {"block", "allow"}


def test_url_templates_learn_from_labels(spark):
    rows, marks = [], []
    for i in range(200):
        bad = i % 2
        rows.append((i, f"http://h.com/{'spam' if bad else 'docs'}/{'abc'[i % 3]}/{i}", ""))
        if i < 120:
            marks.append((i, 1 - bad, bad))
    p, labels = spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urlfilter.judged(p, labels).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(200))
    assert len({r.template for r in got.values()}) == 2


def test_url_branches_stay_apart_among_many_siblings(spark):
    sections = [f"{a}{b}" for a in "abcde" for b in "vwxyz"]
    rows = [(i, f"http://h.com/{sections[i % 25]}/{i}", "") for i in range(1000)]
    marks = [(i, int(i % 25 != 7), int(i % 25 == 7)) for i in range(1000)]
    p, labels = spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urlfilter.judged(p, labels).collect()}
    assert {i for i in got if got[i].verdict == "block"} == set(range(7, 1000, 25))
    assert {r.template for r in got.values()} == {f"/{sections[7]}/#", "/*/#"}


def test_url_branches_at_any_depth(spark):
    deep = "/a/b/c/d/e/f/g/h"
    rows = [(i, f"http://h.com{deep}/{'spam' if i % 2 else 'docs'}/x/y/{i}", "") for i in range(100)] + [(200 + i, f"http://h.com{deep}", "") for i in range(2)]
    marks = [(i, 1 - i % 2, i % 2) for i in range(60)]
    p, labels = spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urlfilter.judged(p, labels).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(100))
    assert {r.template for r in got.values()} == {deep, f"{deep}/spam/x/y/#", f"{deep}/docs/x/y/#"}


def plain_chats(rows):
    conv = {}
    for c, t, role, text in set(rows):
        conv.setdefault(c, set()).add((t, role or "", text or ""))
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    paths = {c: [x[1:] for x in sorted(v, key=order)] for c, v in conv.items()}
    key = lambda c: (c is not None, c or 0)
    keep = [c for c, p in paths.items() if not any(q[: len(p)] == p and (len(q) > len(p) or key(o) < key(c)) for o, q in paths.items() if o != c)]
    return {c: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in paths[c]) for c in keep}


def test_chats_equal_plain(spark):
    r = random.Random(1)
    rows = []
    for base in range(6):
        turns = [(i, "user" if i % 2 == 0 else "assistant", f"{base} turn {r.randrange(3)}") for i in range(8)]
        for k in range(1, 9, 2):
            rows += [(base * 10 + k, *t) for t in turns[:k]]
    rows += rows[:5] + [(200, None, None, None), (200, 1, "user", None), (None, 0, "user", "x"), (201, 5, "b", "tie"), (201, 5, "a", "tie"), *[(300, i, "user", "same") for i in range(700)]]
    c = with_extra(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"conv": 1, "place": 2, "n": 3, "p1": 4})
    got = {}
    for x in sorted(chat.collapsed(c).collect(), key=lambda x: x.part):
        got[x.conv_id] = got.get(x.conv_id, "") + x.rendered
    assert got == plain_chats(rows)
    assert chat.collapsed(c.limit(0)).count() == 0


def test_pipeline_stages(spark, small):
    import corpus_pipeline
    from millrace.llm import decontam, langid

    from .test_copies import plain_near

    docs_ = spark.read.parquet(f"{small}/documents.parquet")
    now, seen = docs_, {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, now, small).cache()
        seen[name] = (before, now)
        if name != "pieces":
            assert now.columns == docs_.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = seen["near_duplicates"]
    rows = sorted((r.doc_id, r.text) for r in before.select("doc_id", "text").collect())
    assert ids(after) == sorted({rows[k][0] for k in plain_near([t for _, t in rows])})
    before, after = seen["benchmark"]
    hit = {r.doc_id for r in decontam.found(before, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert ids(after) == sorted(set(ids(before)) - hit)
    before, after = seen["language"]
    low = {r.doc_id for r in langid.identified(before).where(f"lang_pred = 'und' or score < {langid.LEAST}").collect()}
    assert ids(after) == sorted(set(ids(before)) - low)
    before, after = seen["pieces"]
    joined = after.join(before.select("doc_id", "text"), "doc_id")
    assert joined.count() == before.count() == joined.where("decoded = text").count()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, small).collect()) == ids(after)


def test_pipeline_takes_odd_tables(spark, small):
    import corpus_pipeline

    plain = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    long = prose(5, 120_000)
    odd = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, "12 34", None, None, 5), (9004, long, None, None, len(long)), (None, prose(6, 40), None, None, 0), (9005, "short one", "en", "s", 9), (9005, "short one", "en", "s", 9)], plain.schema)
    named = with_extra(plain.unionByName(odd), CLASHES)
    for docs_ in (named, named.limit(0)):
        empty, now = docs_ is not named, docs_
        for name, stage in corpus_pipeline.STAGES:
            before = now.count()
            now = corpus_pipeline.written(stage(spark, now, small))
            if name != "pieces":
                assert now.columns == docs_.columns
            if name in ("secrets", "pieces"):
                assert now.count() == before
        ids = [r.doc_id for r in now.select("doc_id").collect()]
        assert empty == (not ids)
        if not empty:
            assert not {9001, 9002, 9003} & set(ids) and ids.count(9005) == 1 and None in ids and 9004 in ids
            assert now.where("doc_id = 9004").first().decoded == long
