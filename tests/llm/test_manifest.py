"""The Merkle manifest: forests that merge in any order, and whole manifests held against a plain one."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import merkle, queries

from .helpers import CLASHES, docs, prose, with_extra


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The root, and each leaf's path of (siblings to the left, siblings to the right)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, a in enumerate(at):
            first = a - a % 2
            paths[k].append((level[first:a], level[a + 1 : first + 2]))
        level, at = [h(*level[i : i + 2]) for i in range(0, len(level), 2)], [a // 2 for a in at]
    return level[0], paths


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    def forged(r):
        return r[4] + 1 if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else r[4]

    own = [(r[2], r[0], plain_leaf(r[0], r[3], r[2], r[4], r[1]), plain_leaf(r[0], r[3], r[2], forged(r), r[1])) for r in rows]
    first = lambda x: (x is not None, x if x is not None else 0)
    langs = sorted({x[0] for x in own}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: sorted((x[1:] for x in own if x[0] == g), key=lambda x: (first(x[0]), x[1])) for g in langs}
    built = {g: plain_tree([leaf for _, leaf, _ in t]) for g, t in trees.items()}
    root, tops = plain_tree([built[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops):
        for (doc, leaf, claimed), path in zip(trees[g], built[g][1]):
            node = claimed
            for left, right in path + top:
                node = h(*left, node, *right)
            proof = h(*(x for left, right in path + top for x in left + right))
            out.append((doc, leaf, built[g][0], root, proof, node, node == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def checked(df, **parameters):
    forged = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    claimed = merkle.leaf([forged if c == "n_chars" else F.col(c) for c in merkle.COLUMNS])
    got = merkle.tampered(merkle.manifest(df, {"claimed": claimed}, **parameters), "claimed")
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(2, 4), st.randoms(use_true_random=False))
def test_forests_merge_in_any_order(n, arity, r):
    leaves = [h(str(i)) for i in range(n)]
    nodes = [((0, 0, i), leaf) for i, leaf in enumerate(leaves)]
    whole = merkle.Forest({0: n}, nodes, arity)
    r.shuffle(nodes)
    forests = [merkle.Forest({0: n}, nodes[i::5], arity) for i in range(5)]
    left = forests[0].merged(forests[1]).merged(forests[2]).merged(forests[3].merged(forests[4]))
    right = forests[4].merged(forests[3].merged(forests[2].merged(forests[1].merged(merkle.Forest().merged(forests[0])) if arity == 2 else forests[1].merged(forests[0]))))
    assert left.parts() == whole.parts() == right.parts()
    assert list(whole.open.values()) == [whole.root(0)]
    at = r.randrange(n)
    siblings = list(whole.siblings((0, 0, at)))
    assert merkle.folded(leaves[at], at, n, siblings, arity) == (whole.root(0), [])


@pytest.mark.parametrize("levels, merged", [(1, 4), (2, 1000), (8, 1 << 16)])
def test_manifest_equals_plain(spark, levels, merged):
    r = random.Random(levels)
    rows = [(i, prose(i, r.randrange(6)), r.choice(["en"] * 6 + ["de", "fr", "Å", None]), r.choice(["s", "", None]), r.choice([None, 5, 100])) for i in r.sample(range(1000), 90)]
    rows += [rows[0], rows[0], (None, None, None, None, None), (7000, "same", "it", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert checked(df, levels=levels, merged=merged) == plain_manifest(rows)


def test_odd_tables(spark):
    d = docs(spark, ["one", None, "", "word " * 120_000], **CLASHES)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in d.collect()]
    assert checked(d) == plain_manifest(rows)
    assert checked(d.where("doc_id = 1")) == plain_manifest(rows[1:2])
    assert checked(with_extra(d.limit(0), {})) == []


def test_query_equals_plain(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    got = queries.QUERIES["op11_merkle_manifest"](spark, small)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_manifest([tuple(r) for r in d.collect()])
