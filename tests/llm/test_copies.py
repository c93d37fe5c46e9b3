"""SimHash groups, repeated byte strings and decontamination against plain versions."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import decontam, simhash, suffix

from .helpers import CLASHES, broadcast_rows, docs, prose


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower() if text and text.isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(texts):
    prints = [plain_fingerprint(t) for t in texts]
    group = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                    low = min(group[i], group[j])
                    group = [low if g in (group[i], group[j]) else g for g in group]
                    changed = True
    return prints, group


def texts_with_copies():
    base = [prose(i, 200) for i in range(6)]
    near = [b.replace(b.split()[50], "changed1", 1) for b in base[:3]]
    return [*base, None, "", "  \n", "one", "One", "two words", *near, base[0], base[0].upper(), "É é À", "é é à", near[1] + " end", "!!! ###", prose(99, 5000)]


def test_simhash_equals_plain(spark):
    texts = texts_with_copies()
    prints, group = plain_groups(texts)
    got = {r.doc_id: r for r in simhash.groups(docs(spark, texts, **CLASHES)).collect()}
    assert [got[i].fp % (1 << 64) for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == group
    assert len(set(group)) < len(texts)


def test_simhash_links_within_radius(spark):
    r = random.Random(3)
    values = {r.getrandbits(64) for _ in range(40)}
    for v in list(values)[:20]:
        for k in range(1, 6):
            values.add(v ^ sum(1 << b for b in r.sample(range(64), k)))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    got = {(x.a % (1 << 64), x.b % (1 << 64)) for x in simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    want = {(a, b) for a in values for b in values if a != b and (a ^ b).bit_count() <= 3}
    assert got | {(b, a) for a, b in got} == want


def test_simhash_broadcasts_no_fingerprints(spark):
    """Spark would size the values within one bit of each half as if there were one a fingerprint."""
    d = docs(spark, [prose(i, 20) for i in range(50)])
    assert broadcast_rows(spark, lambda: simhash.groups(d).collect()) == []


def test_near_copies_broadcast_no_lists(spark):
    """Rounds of contracted() may broadcast what edges there are; no table of rows, keys or shingles is broadcast."""
    texts = [prose(i, 60) for i in range(30)] + [prose(i, 60) + " end" for i in range(10)]
    assert max(broadcast_rows(spark, lambda: simhash.dedup(docs(spark, texts)).collect()), default=0) <= 20


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def plain_near(texts):
    """The least index of each text's group, of texts whose sets of five-word shingles are 0.8 alike or more."""
    sets, group = [plain_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) and group[i] != group[j]:
                low = min(group[i], group[j])
                group = [low if g in (group[i], group[j]) else g for g in group]
    return group


def varied(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"new{r.randrange(999)}" if r.random() < share else w for w in text.split())


def test_dedup_keeps_one_of_each_group(spark):
    texts = texts_with_copies()
    group = plain_near(texts)
    d = docs(spark, texts, **CLASHES)
    kept = simhash.dedup(d.unionByName(d.where("doc_id = 0")))
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group))
    assert simhash.dedup(d.limit(0)).count() == 0
    nulls = d.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars")
    assert simhash.dedup(nulls).count() == len(texts)


def test_dedup_loses_no_text_of_a_repeated_id(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(7, a, "x"), (7, b, "x"), (8, b, "x"), (9, a, "x"), (7, a, "y"), (7, a, "x"), (None, a, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, more string")
    assert sorted((r.doc_id, r.text, r.more) for r in simhash.dedup(d).collect() if r.doc_id) == sorted([(7, a, "x"), (7, b, "x")])
    assert simhash.dedup(d).where("doc_id is null").count() == 1
    near = a.replace(a.split()[30], "other", 1)
    d = spark.createDataFrame([(None, a), (1, a), (2, near), (3, b), (None, b)], "doc_id long, text string")
    assert plain_set(a) != plain_set(near) and sorted(str(r.doc_id) for r in simhash.dedup(d).collect()) == ["1", "3", "None", "None"]


def test_near_copies_at_every_similarity(spark):
    texts = []
    for k in range(30):
        base = prose(500 + k, 60 + 20 * (k % 5))
        texts += [base, *(varied(base, k * 10 + i, share) for i, share in enumerate((0.005, 0.01, 0.02, 0.03, 0.04)))]
    texts += [prose(900, 50) + " " + prose(901 + i, 60) for i in range(20)] + ["a b c d", "A b c d", "a b c e", "x " * 30, "x x x x x x"]
    group = plain_near(texts)
    got = {r.id: r.label for r in simhash.near(docs(spark, texts, **CLASHES)).collect()}
    members = lambda label: sorted(sorted(i for i in range(len(texts)) if label[i] == x) for x in {label[i] for i in range(len(texts))})
    assert members(got) == members(group)
    assert 30 < len(set(group)) < len(texts) - 60


def test_large_groups_of_near_copies_make_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)
    base = prose(77, 120)
    texts = [base, *(varied(base, i, 0.012) for i in range(150)), *(prose(3000 + i, 80) for i in range(20))]
    pairs = []
    alike = simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda p, held: (pairs.append(p.count()), alike(p, held))[1])
    got = {r.id: r.label for r in simhash.near(docs(spark, texts)).collect()}
    group = plain_near(texts)
    assert len(set(got.values())) == len(set(group)) and all((got[i] == got[0]) == (group[i] == 0) for i in got)
    assert sum(pairs) < 151 * 150 / 2 * 0.6


def test_texts_with_a_common_passage_make_few_pairs(spark, monkeypatch):
    """Texts of which two thirds are one passage, and some near copies among them: candidates follow the number of texts, not its square."""
    passage = prose(5, 40)
    pairs = []
    alike = simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda p, held: (pairs.append(p.count()), alike(p, held))[1])
    for n in (400, 5000):
        texts = [passage + " " + prose(100_000 + i, 16) for i in range(n)]
        texts += [t + " end" for t in texts[:: n // 20]]
        pairs.clear()
        got = {r.id: r.label for r in simhash.near(docs(spark, texts)).collect()}
        assert all(got[n + k] == got[k * (n // 20)] for k in range(20)) and len(set(got.values())) == n
        assert sum(pairs) < 20 * n
    sets = [plain_set(t) for t in texts[:50]]
    assert min(len(a & b) / len(a | b) for a in sets for b in sets) > 0.5


def plain_removed(rows):
    owner = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            w = t[k : k + 50]
            owner[w] = min(owner.get(w, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if owner[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_equals_plain(spark):
    a, b = prose(1, 60), prose(2, 40)
    texts = [a, b + a[100:250], None, "", a, a[:49], a[:50], a[7:80] + b[3:90] + a[7:80], "x" * 300, "x" * 120, "ab" * 400, "é" * 60, prose(5, 30) + "é" * 60, b, "\0" * 80, "\0" * 60]
    d = docs(spark, texts, **CLASHES)
    d = d.unionByName(d.where("doc_id = 4"))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.deduplicated(d).collect())
    rows = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    assert got == plain_removed([*rows, rows[4]])
    assert suffix.deduplicated(d.limit(0)).count() == 0


def test_suffix_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 700)
    monkeypatch.setattr(suffix, "COMBINED_BYTES", 900)
    monkeypatch.setattr(suffix, "CUT_BYTES", 256)
    monkeypatch.setattr(suffix, "SORTED", 16)
    r = random.Random(4)
    pool = [prose(i, 30) for i in range(6)]
    texts = ["".join(r.choice(pool)[r.randrange(40) :] for _ in range(r.randrange(4))) for _ in range(40)]
    rows = [(r.randrange(30), t.encode()) for t in texts]
    d = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix.deduplicated(d).collect())
    assert got == plain_removed(rows)


def test_suffix_with_frequent_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 2000)
    shared = prose(8, 30)
    texts = [prose(200 + i, 10) + shared + prose(300 + i, 10) for i in range(60)]
    d = docs(spark, texts)
    own = d.select("doc_id", "doc_id", "text")
    hot = suffix.hot_pieces(own.toDF("doc_id", "version", "text"), 60, 1)
    ranks = suffix.pieces(np.frombuffer(shared.encode(), np.uint8)) >> np.uint64(1)
    assert set(ranks.tolist()) <= set(hot.tolist())
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.deduplicated(d).collect())
    assert got == plain_removed([(i, t.encode()) for i, t in enumerate(texts)])


def test_suffix_null_ids(spark):
    t = prose(7, 40)
    d = spark.createDataFrame([(None, t), (1, t), (0, "short")], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in suffix.deduplicated(d).collect()} == {(None, 0), (1, 0), (0, 0)}


def plain_found(texts, items):
    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)], len(w)

    out = {}
    for i, t in enumerate(texts):
        s, n = shingles(t)
        for j, x in enumerate(items):
            q, m = shingles(x)
            if not s or not q:
                continue
            for start in range(max(n - m, 0) + 1):
                here = s[start : start + m - 4]
                common = sum(min(here.count(g), q.count(g)) for g in set(here))
                similarity = common / (len(here) + len(q) - common)
                if similarity >= 0.8:
                    out[i, j] = max(out.get((i, j), 0), round(similarity, 9))
    return out


def test_decontamination_equals_plain(spark):
    items = [prose(i, 20 + i) for i in range(5)] + ["too few words", None, "", "a b c d e", "a b a b a b a b a b a b", prose(1, 21)]
    one = items[1].split()
    texts = [prose(100, 50) + " " + items[0].upper() + ". " + prose(101, 20), " ".join([*one[:10], "changed", *one[11:]]), items[2], " ".join(items[3].split()[:-1]), " ".join([*items[4].split()[:12], "new", *items[4].split()[12:]]), None, "", prose(102, 400), "a b c d e", "a b " * 40, prose(103, 30) + " " + items[1], " ".join(items[2].split()[:10])]
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    d = docs(spark, texts, **CLASHES)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.found(d.unionByName(d.where("doc_id = 2")), b).collect()}
    want = plain_found(texts, items)
    assert got == pytest.approx(want)
    assert len(want) >= 5
    clean = decontam.decontaminated(d, b)
    assert clean.columns == d.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(range(len(texts))) - {i for i, _ in want})
    assert decontam.found(d.limit(0), b).count() == decontam.found(d, b.limit(0)).count() == 0
    assert decontam.decontaminated(d, b.limit(0)).count() == len(texts)


def test_decontamination_broadcasts_items_only(spark, monkeypatch):
    """What is broadcast grows with the benchmark alone; where that is large, nothing is."""
    items = spark.createDataFrame([(i, prose(i, 20)) for i in range(3)], "item_id long, text string")
    d = docs(spark, [f"{prose(100 + i, 20)} {prose(i % 3, 20)}" for i in range(60)])
    shingles, blocks = 3 * 16, 3 * (decontam.RADIUS + 1)
    found = lambda: sorted(map(tuple, decontam.found(d, items).collect()))
    assert broadcast_rows(spark, lambda: decontam.found(d, items).collect()) == [blocks, shingles, shingles, shingles]
    want = found()
    assert len(want) == 60
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert broadcast_rows(spark, lambda: decontam.found(d, items).collect()) == []
    assert found() == want


def test_fingerprints_are_bitwise_majorities(spark):
    r = random.Random(6)
    groups = [[r.choice((-1, 0, r.getrandbits(64) - (1 << 63))) for _ in range(n)] for n in (1, 2, 3, 7, 40)]
    rows = spark.createDataFrame([(i, h) for i, g in enumerate(groups) for h in g], "id long, sh long")
    got = {x.id: (x.n, x.fp % (1 << 64)) for x in decontam.fingerprint(rows, "id").collect()}
    assert got == {i: (len(g), sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in g) > len(g))) for i, g in enumerate(groups)}


def test_no_later_condition_holds_a_fingerprint_expression(spark):
    """The driver would write the code of the whole expression again for each."""
    b = spark.createDataFrame([(0, prose(0, 20))], "item_id long, text string")
    plan = decontam.matches(docs(spark, [prose(0, 20)]), b)._jdf.queryExecution().toString()
    assert "bit_count" in plan and "shiftleft" not in plan


def test_blocks_guarantee_the_radius(spark):
    from pyspark.sql import functions as F

    r = random.Random(5)
    pairs = []
    for _ in range(200):
        v = r.getrandbits(64)
        pairs.append((v, v ^ sum(1 << b for b in r.sample(range(64), decontam.RADIUS))))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long")
    assert df.where(F.arrays_overlap(decontam.blocks("a"), decontam.blocks("b"))).count() == 200
