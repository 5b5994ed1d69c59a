import numpy as np
import pytest
from pyspark.sql import functions as F

from farspark.llm import jacobi_davidson as J, whitening as W


@pytest.mark.parametrize("shape", [(300, 1), (300, 3), (400, 30), (5, 40), (2000, 120)])
def test_pairs_equal_a_dense_solver(shape):
    x = np.random.default_rng(shape[1]).normal(size=shape) * np.linspace(1, 2, shape[1])
    c = x - x.mean(axis=0)
    v = c.T @ c / len(x)
    got = J.leading_pairs(lambda u: v @ u, shape[1], 4)
    values, vectors = np.linalg.eigh(v)
    k = min(4, shape[1])
    assert got.values == pytest.approx(values[::-1][:k], rel=1e-13)
    assert np.abs((vectors[:, ::-1][:, :k] * got.vectors).sum(axis=0)) == pytest.approx(np.ones(k), abs=1e-12)
    assert (got.residuals < 1e-13 * values[-1]).all()


def test_repeated_values_and_zero():
    v = np.diag([3.0, 3.0, 3.0, 3.0, 3.0, 1.0, 1.0, 0.0])
    got = J.leading_pairs(lambda u: v @ u, 8, 4)
    assert got.values == pytest.approx([3.0] * 4) and np.allclose(got.vectors.T @ got.vectors, np.eye(4))
    assert J.leading_pairs(lambda u: 0 * u, 6, 4).values == pytest.approx([0.0] * 4)


def test_minres_solves_symmetric_systems():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(12, 12))
    a = a + a.T
    b = rng.normal(size=(12, 3))
    got = J.minres(lambda v, columns: a @ v, b, 40, 1e-13)
    assert np.allclose(a @ got, b, atol=1e-8)


def plain(vectors, scale=256, k=4):
    x = np.array([[int(np.floor(scale * float(c))) for c in v] for v in vectors], dtype=object)
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    c = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in fit])
    values, directions = np.linalg.eigh(c.T @ c / n)
    values, directions = values[::-1][:k], directions[:, ::-1][:, :k]
    out = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in x]) @ directions / np.sqrt(values)
    return n, [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x], out, values / np.trace(c.T @ c / n)


def test_whitened_rows_equal_plain_numpy(spark):
    rng = np.random.default_rng(8)
    good = (rng.normal(size=(200, 7)) @ rng.normal(size=(7, 7))).astype(np.float32)
    good[150:] = good[3]  # a quarter of the rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(good)]
    bad = [(900, None), (901, [1.0] * 6 + [None]), (902, [float("nan")] * 7), (903, [float("inf")] + [0.0] * 6), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows + [(None, good[5].tolist())] + bad, "vec_id long, embedding array<float>").withColumns(
        {"x": F.lit("clash"), "whitened": F.lit(1), "n": F.lit(2), "component": F.lit(3)}).repartition(3)
    got = W.whitened_rows(df).collect()
    n, deviations, white, explained = plain(list(good) + [good[5]])
    ids = [*range(200), None]
    assert len(got) == 4 * len(ids) and {r["vec_id"] for r in got} == set(ids)
    by = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(4):
        sign = np.sign(by[0, k + 1]["whitened"] * white[0, k])
        for i, key in enumerate(ids):
            r = by[key, k + 1]
            assert (r["n"], r["deviation"]) == (n, deviations[i])
            assert r["whitened"] == pytest.approx(sign * white[i, k], rel=1e-9, abs=1e-11) and r["explained"] == pytest.approx(explained[k], rel=1e-11)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_no_variance_no_components(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert W.whitened_rows(df).count() == 0 and W.whitened_rows(df.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    got = W.whitened_rows(line).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1.0)
    assert sum(r["whitened"] ** 2 for r in got) / 9 == pytest.approx(1.0)
