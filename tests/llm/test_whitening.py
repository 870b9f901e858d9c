"""Whitening against exact rational arithmetic, on the given table and on awkward rows."""

from fractions import Fraction

import numpy as np
import pytest

from vigilark.llm import whitening
from vigilark.llm.common import table

SF = "/root/testdata/sf0.01"


def exact(vectors):
    """(n, S, covariance as fractions) of the distinct integer vectors."""
    fit = sorted(set(vectors))
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    y = [[n * x[i] - s[i] for i in range(d)] for x in fit]
    v = [[Fraction(sum(r[i] * r[j] for r in y), n ** 3) for j in range(d)] for i in range(d)]
    return n, s, v


def check(got, ids, vectors, components=4):
    n, s, v = exact(vectors)
    d = len(s)
    e, u = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    top = [i for i in np.argsort(-e) if e[i] > d * 2.3e-16 * e.max()][:components]
    assert len(got) == len(ids) * len(top)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    trace = float(sum(v[i][i] for i in range(d)))
    for k, i in enumerate(top, 1):
        want = {}
        for vec_id, x in zip(ids, vectors):
            y = np.array([n * a - b for a, b in zip(x, s)], float) / n
            want.setdefault(vec_id, []).append((float(y @ u[:, i] / np.sqrt(e[i])), sum((n * a - b) ** 2 for a, b in zip(x, s))))
        signs = [np.sign(sorted(r["whitened"] for r in by[j, k])[0] * sorted(w for w, _ in want[j])[0]) for j in want if len(want[j]) == 1]
        sign = 1 if sum(signs) >= 0 else -1
        for j in want:
            rows = by[j, k]
            assert np.allclose(sorted(sign * r["whitened"] for r in rows), sorted(w for w, _ in want[j]), rtol=1e-9, atol=1e-9)
            assert sorted(r["deviation"] for r in rows) == sorted(dev for _, dev in want[j])
            assert all(r["n"] == n and r["explained"] == pytest.approx(e[i] / trace, rel=1e-9) for r in rows)
    assert {r["identity_error"] for r in got} and all(r["identity_error"] < 1e-9 for r in got)


def test_whole_table_against_fractions(spark):
    emb = table(spark, SF, "embeddings")
    rows = [r for r in emb.collect() if r["embedding"]]
    vectors = [tuple(int(np.floor(256 * float(c))) for c in r["embedding"]) for r in rows]
    check(whitening.whiten(emb).collect(), [r["vec_id"] for r in rows], vectors)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.5, -0.0, 0.25]), (2, [0.5, 0.0, 0.25]), (2, [0.75, 1.5, -2.0]), (None, [3.0, 0.001, -0.001]), (4, None),
            (5, []), (6, [1.0, None, 1.0]), (7, [nan, 1.0, 1.0]), (8, [1.0, -inf, 1.0]), (9, [1.0, 2.0]), (10, [9.0, 9.0, 9.5])]
    df = spark.createDataFrame([(i, v, 7, "k") for i, v in data], "vec_id long, embedding array<double>, n long, component string")
    keep = [(i, v) for i, v in data if v and len(v) == 3 and all(c is not None and np.isfinite(c) for c in v)]
    got = whitening.whiten(df).collect()
    assert {r["n"] for r in got} == {4}          # the first two are one vector of the fit list
    check(got, [i for i, _ in keep], [tuple(int(np.floor(256 * c)) for c in v) for _, v in keep])


def test_no_spread_gives_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0


def test_values_past_64_bits_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.integers(-2 ** 50, 2 ** 50, 3)]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    vectors = [tuple(int(c) * 256 for c in v) for _, v in rows]
    n, s, v = exact(vectors)
    e, _ = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    assert {r["deviation"] for r in got} == {None}
    assert sorted({r["explained"] for r in got}, reverse=True) == pytest.approx(sorted(e / e.sum(), reverse=True), rel=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_square_sums_of_every_range():
    rng = np.random.default_rng(4)
    for bits in (5, 30, 46, 60):
        p = rng.integers(-2 ** bits, 2 ** bits, (300, 4))
        assert whitening.square_sum(p) == [sum(int(v) ** 2 for v in p[:, j]) for j in range(4)]
