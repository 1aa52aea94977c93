"""Whitening against exact integers and numpy's eigenvalues."""

import math

import numpy as np
import pytest

from distkpi.llm import cholesky_whitening as w

SCHEMA = "vec_id bigint, embedding array<double>, label int, x string, n bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


def expected(rows):
    """Rows that take part, exact sums and the covariance of the distinct vectors."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in enumerate(r for _, r in rows)}
    distinct = sorted(set(map(tuple, x.values())))
    n, d = len(distinct), len(distinct[0])
    sums = [sum(v[k] for v in distinct) for k in range(d)]
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in x.items()}
    c = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in distinct])
    return x, n, sums, deviation, c, c.T @ c / n


def check(got, rows, components):
    x, n, sums, deviation, c, v = expected(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == len(rows) * components
    signs = None
    for i, (vec_id, _) in enumerate(rows):
        own = [by[vec_id][k + 1] for k in range(components)]
        assert [r["n"] for r in own] == [n] * components
        assert [r["deviation"] for r in own] == [deviation[i]] * components
        assert np.allclose([r["explained"] for r in own], values / np.trace(v), rtol=1e-10)
        assert all(r["identity_error"] < 1e-9 for r in own)
        want = np.array([(n * a - s) / n for a, s in zip(x[i], sums)]) @ vectors / np.sqrt(values)
        mine = np.array([r["whitened"] for r in own])
        if signs is None:
            signs = np.zeros(components)
        signs = np.where((signs == 0) & (np.abs(want) > 1e-3), np.sign(want) * np.sign(mine), signs)
        assert np.allclose(mine, want * np.where(signs == 0, 1, signs), rtol=1e-7, atol=1e-7)


def test_against_numpy(spark):
    rng = np.random.default_rng(4)
    basis = rng.standard_normal((20, 20)) * np.linspace(0.2, 3, 20)[:, None]
    rows = [(i, v) for i, v in enumerate((rng.standard_normal((300, 20)) @ basis).tolist())]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]                 # copies count once in the fit
    check(w.whiten(frame(spark, rows)).collect(), rows, 16)


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(5)
    good = [(i, v) for i, v in enumerate(rng.standard_normal((50, 3)).tolist())]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [0.0, float("-inf"), 1.0]),
           (104, []), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    check(w.whiten(frame(spark, good + bad)).collect(), good, 3)


def test_few_and_dependent_vectors(spark):
    assert w.whiten(frame(spark, [])).collect() == []
    assert w.whiten(frame(spark, [(1, None)])).collect() == []
    assert w.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    flat = [(i, [float(i), 5.0, -2.0 * i]) for i in range(9)]           # rank 1
    got = w.whiten(frame(spark, flat + [(None, [3.0, 5.0, -6.0])])).collect()
    assert len(got) == 10 and {r["component"] for r in got} == {1}
    assert all(abs(r["explained"] - 1) < 1e-12 for r in got)
    assert sorted(r["vec_id"] for r in got if r["vec_id"] is not None) == list(range(9))


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2 ** 40 * (i - 3) + i), float(-i * i), 0.5 * i]) for i in range(8)]
    got = w.whiten(frame(spark, rows)).collect()
    x, n, sums, deviation, _, _ = expected(rows)
    for r in got:
        exact = deviation[r["vec_id"]]
        assert r["deviation"] == (exact if exact < 2 ** 63 else None)
        assert r["identity_error"] < 1e-4


@pytest.mark.parametrize("d", [1, 2, 5, 16, 33])
def test_decomposition(d):
    rng = np.random.default_rng(d)
    for scale in (1.0, 1e-6):
        b = rng.standard_normal((d, d + 3)) * np.geomspace(1, scale, d)[:, None]
        a = b @ b.T
        l, order = w.pivoted_cholesky(a)
        assert np.allclose(l @ l.T, a[order][:, order], atol=1e-12 * np.abs(a).max())
        g = w.orthogonal_columns(l)
        norms = np.sqrt((g * g).sum(0))
        u = g / norms
        assert np.allclose(u.T @ u, np.eye(l.shape[1]), atol=1e-13 * d)
        assert np.allclose(np.sort(norms ** 2), np.linalg.eigvalsh(a)[-l.shape[1]:], rtol=1e-9, atol=1e-13 * np.trace(a))


def test_query(spark, sf):
    from distkpi.llm.queries import op12_cholesky_whitening
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op12_cholesky_whitening(spark, sf).collect(), rows, 16)
