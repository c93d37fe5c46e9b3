"""Whitening held against numpy over all rows at once."""

from __future__ import annotations

import math

import numpy as np
import pytest

from millrace.llm import queries, whitening

from .helpers import with_extra

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors):
    """n, deviations, centred rows, eigenvalues and the trace of V."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    far = [[n * a - b for a, b in zip(row, s)] for row in x]
    centred = np.array(far, np.float64) / n
    v = centred.T @ centred / n
    return n, [sum(a * a for a in row) for row in far], centred, v, np.trace(v)


def check(got, ids, vectors, count=32):
    n, deviations, centred, v, trace = plain(vectors)
    values, own = np.linalg.eigh(v)
    values, own = values[::-1][:count], own[:, ::-1][:, :count]
    assert {(r.vec_id, r.deviation) for r in got} == set(zip(ids, deviations)) and {r.n for r in got} == {n}
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == len(ids) * len(values)
    w = np.array([[by[i, k + 1].whitened for k in range(len(values))] for i in ids])
    flat = values <= 1e-12 * max(values[0], 1e-300)
    assert not w[:, flat].any()
    want = centred @ (own / np.sqrt(np.where(flat, 1, values)))
    for k in np.flatnonzero(~flat):
        sign = np.sign(w[:, k] @ want[:, k])
        assert np.allclose(w[:, k], sign * want[:, k], atol=1e-6)
        assert by[ids[0], k + 1].explained == pytest.approx(values[k] / trace, rel=1e-9)
    middle = w[:, ~flat] - w[:, ~flat].mean(axis=0)
    error = np.abs(middle.T @ middle / n - np.eye((~flat).sum())).max() if (~flat).any() else 0
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error == pytest.approx(error, abs=1e-9) and error < 1e-4


def test_whitening_equals_plain(spark):
    r = np.random.default_rng(3)
    scale = np.linspace(0.2, 3, 40)
    vectors = (r.normal(size=(300, 40)) * scale + r.normal(size=40)).astype(np.float32).tolist()
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    odd = [None, [None, *vectors[0][1:]], [float("nan"), *vectors[0][1:]], [float("inf"), *vectors[0][1:]], [-float("inf"), *vectors[0][1:]], [], vectors[0][:7]]
    df = with_extra(spark.createDataFrame(rows + [(1000 + i, v, None) for i, v in enumerate(odd)], SCHEMA), {"v": 1, "x": 2, "n": 3, "far": 4, "component": 5})
    check(whitening.components(df).collect(), list(range(300)), vectors)


def test_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], SCHEMA)
    assert whitening.components(frame([[1.0, 2.0]]).limit(0)).count() == 0
    assert whitening.components(frame([None, [None]])).count() == 0
    one = whitening.components(frame([[1.0, 2.0]])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    same = whitening.components(frame([[1.0, 2.0]] * 5)).collect()
    assert len(same) == 10 and not any(r.whitened or r.deviation for r in same)
    line = [[float(i), 2.0 * i] for i in range(6)]
    check(whitening.components(frame(line)).collect(), list(range(6)), line)


def test_query_equals_plain(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    sound = [r for r in rows if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    check(queries.QUERIES["op12_embedding_whitening"](spark, small).collect(), [r.vec_id for r in sound], [r.embedding for r in sound])
