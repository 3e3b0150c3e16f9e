import math

import numpy as np
import pytest

from quarry.llm import whitening
from quarry.llm.queries import QUERIES
from tests.conftest import SF_MID
from tests.llm.helpers import unit_rows

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, most=4):
    """{length: (n, sums, values, vectors)} by numpy's eigenvectors of the covariance."""
    good = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fits = {}
    for d in {len(x) for _, x in good}:
        x = np.array(sorted({x for _, x in good if len(x) == d}))
        y = x - x.mean(axis=0)
        e, w = np.linalg.eigh(y.T @ y / len(x))
        fits[d] = (len(x), x.sum(axis=0), e[::-1], w[:, ::-1])
    return good, fits


def check(got, rows, tight=1e-9):
    good, fits = plain(rows)
    left = {}
    for r in got:
        left.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for i, x in good:
        n, sums, e, w = fits[len(x)]
        m = min(4, int((e > 1e-9 * max(e[0], 1e-300)).sum()))
        dev = sum((n * int(c) - int(s)) ** 2 for c, s in zip(x, sums))
        dev = dev if dev < 2**63 else None
        for k in range(m):
            want = float((np.array(x) - sums / n) @ w[:, k] / math.sqrt(e[k]))
            some = left[(i, k + 1)]
            r = next((r for r in some if r["deviation"] == dev and abs(abs(r["whitened"]) - abs(want)) < tight), None)
            assert r is not None, (i, k, want, some)
            some.remove(r)
            if abs(want) > 1e-6:
                assert signs.setdefault((len(x), k), np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
            assert r["n"] == n and abs(r["explained"] - e[k] / e.sum()) < 1e-10 and r["identity_error"] < 1e-9
    assert not any(left.values())


def test_query_against_numpy(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op11_cholesky_whitening"](spark, SF_MID).collect(), rows)


def test_edge_cases(spark):
    rng = np.random.default_rng(0)
    x = (unit_rows(rng, 200, 6).astype(float) * [8, 5, 3, 2, 1, 0.5]).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(5, x[5]), (900, x[5]), (None, x[7]), (901, None), (902, []), (903, [math.nan] * 6), (904, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
                                                (905, [math.inf] * 6), (906, [-0.0] * 6)]
    rows += [(1000 + i, rng.normal(size=3).tolist()) for i in range(50)]          # another length
    rows += [(2000, [1.0, 2.0, 3.0, 4.0]), (2001, [1.0, 2.0, 3.0, 4.0])]           # one distinct vector: no variance
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS x", "3 AS n", "4 AS component", "5 AS whitened")
    check(whitening.whiten(df).collect(), rows)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("kind", ["dependent", "graded", "few rows", "narrow"])
def test_hard_matrices(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "dependent":     # rank 5 of 12
        x = rng.integers(-4, 5, (300, 5)).astype(float) @ rng.integers(-3, 4, (5, 12))
        x = np.hstack([x, np.full((300, 1), 7.0)])
    elif kind == "graded":      # deviations from 1 to 10^7, large means
        x = rng.normal(size=(400, 8)) * 10.0 ** -np.arange(8) * 1e5 + 1e6
    elif kind == "few rows":    # fewer rows than dimensions
        x = rng.normal(size=(5, 20)) * 10
    else:
        x = rng.normal(size=(100, 2)) * 10
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    check(whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), rows, tight=1e-6 if kind == "graded" else 1e-8)


def test_deviations_beyond_a_long(spark):
    x = [[1e12, 0.0], [-1e12, 1.0], [3.0, 2.0], [2.0, 5.0]]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(x)), SCHEMA)).collect()
    assert {r["vec_id"] for r in got if r["deviation"] is None} == {0, 1} and len(got) == 8


def test_solve_and_cholesky():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(50, 7))
    r = whitening.cholesky(a.T @ a, 0.0)
    assert np.allclose(r.T @ r, a.T @ a) and np.allclose(np.tril(r, -1), 0) and np.allclose(whitening.solve(a, r) @ r, a)
