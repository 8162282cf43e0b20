"""Embedding whitening against numpy's singular value decomposition of the whole table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollframe.llm.whitening import component_rows, fit_whitening, whiten

SCHEMA = "vec_id bigint, embedding array<double>"


def brute(vectors):
    x = [tuple(math.floor(256 * c) for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array([[c - s / n for c, s in zip(v, sums)] for v in fit])
    _, value, vector = np.linalg.svd(a, full_matrices=False)  # of the table itself, not of its Gram matrix
    value, vector = value ** 2 / n, vector.T
    rows = np.array([[c - s / n for c, s in zip(v, sums)] for v in x])
    return n, [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x], value, rows @ vector


def check(spark, vectors, k=4, rel=1e-8):
    out = component_rows(whiten(spark.createDataFrame(list(enumerate(vectors)), SCHEMA), components=k)).collect()
    n, deviation, value, turned = brute(vectors)
    assert len(out) == k * len(vectors)
    by = {(r["vec_id"], r["component"]): r for r in out}
    for c in range(k):
        want = turned[:, c] / np.sqrt(value[c])
        got = np.array([by[i, c + 1]["whitened"] for i in range(len(vectors))])
        sign = 1.0 if want @ got > 0 else -1.0
        assert np.abs(want * sign - got).max() < rel * max(1.0, np.abs(want).max())
        assert by[0, c + 1]["explained"] == pytest.approx(value[c] / value.sum(), rel=1e-8)
    for i in range(len(vectors)):
        assert by[i, 1]["n"] == n and by[i, 1]["deviation"] == deviation[i]
    assert len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-9


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) + 5
    check(spark, [*base.tolist(), *base[:40].tolist(), *[base[0].tolist()] * 150])


def test_nearly_dependent_entries(spark):
    """Condition of the centred table over 1e5: the plain Gram matrix has lost those digits."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(200, 3)) * 4000
    v = np.hstack([a, a[:, :1] + a[:, 1:2] + rng.integers(-2, 3, size=(200, 1)) / 256])
    check(spark, v.tolist(), rel=1e-6)
    x = np.floor(v * 256).astype(np.int64)
    m = fit_whitening(spark.createDataFrame([(r,) for r in np.unique(x, axis=0).tolist()], "x array<bigint>"))
    assert m.orthogonality < 1e-12 and np.allclose(m.r.T @ m.r / m.n, np.cov(np.unique(x, axis=0).T, bias=True), rtol=1e-9)
    assert np.allclose(m.r, np.triu(m.r), atol=1e-9 * np.abs(m.r).max())


def test_dependent_and_constant_entries_have_fewer_components(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(-500, 500, size=(60, 2)) / 256.0
    v = np.hstack([a, a[:, :1] + a[:, 1:], np.full((60, 1), 3.0)])
    out = whiten(spark.createDataFrame(list(enumerate(v.tolist())), SCHEMA)).collect()
    n, _, value, turned = brute(v.tolist())
    assert {len(r["whitened"]) for r in out} == {2}
    assert out[0]["identity_error"] < 1e-9 and sum(out[0]["explained"]) == pytest.approx(1.0)
    few = whiten(spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [2.0, 2.0, 5.0])], SCHEMA)).collect()
    assert {len(r["whitened"]) for r in few} == {1} and sorted(round(r["whitened"][0], 9) for r in few) == [-1.0, 1.0]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 1.0]), (1, None), (2, [0.5, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [-inf, 0.0]), (6, [0.25, -1.0]),
            (None, [0.5, 1.0]), (6, [0.1, 0.1]), (7, [-0.001, 0.0])]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("x", "n", "whitened", "id", "component")})
    out = component_rows(whiten(d)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in out) == sorted((i, c) for i in ("0", "6", "None", "6", "7") for c in (1, 2))
    assert {r["n"] for r in out} == {4}
    assert component_rows(whiten(d.limit(0))).count() == 0
    alone = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA))
    assert component_rows(alone).count() == 0 and [(r["deviation"], r["whitened"], r["identity_error"]) for r in alone.collect()] == [(0, [], None)] * 2
    empty = whiten(spark.createDataFrame([(1, [])], SCHEMA)).collect()
    assert [(r["deviation"], r["whitened"]) for r in empty] == [(0, [])]


def test_shorter_vectors_and_large_entries(spark):
    d = spark.createDataFrame([(0, [1.0]), (1, [0.0, 2.0]), (2, [1.0, 0.0])], SCHEMA)
    assert sorted((r["vec_id"], r["n"]) for r in whiten(d).collect()) == [(0, 3), (1, 3), (2, 3)]
    big = spark.createDataFrame([(0, [1e12, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], SCHEMA)
    got = {r["vec_id"]: r["deviation"] for r in whiten(big).collect()}
    assert got[0] is None and len(got) == 3
