"""Models by summed statistics against single fits and a plain loop."""

import math

import numpy as np
import pytest

from petriflow.functions.lineage import checkpointed
from petriflow.operators import models as M


def rows(spark, x, y, g):
    return checkpointed(spark.createDataFrame([([float(a) for a in v], float(t), int(k)) for v, t, k in zip(x, y, g, strict=True)], "x array<double>, y double, g int").repartition(3))


def single(x, y, ridge, steps=60):
    """One regression by plain Newton steps; weights of raw features, intercept last."""
    sd = x.std(0, ddof=1)
    z, w = np.c_[(x - x.mean(0)) / sd, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    pen = np.r_[np.full(x.shape[1], ridge), 0]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(z) + np.diag(pen), z.T @ (p - y) / len(z) + pen * w)
    return np.r_[w[:-1] / sd, w[-1] - (w[:-1] / sd * x.mean(0)).sum()]


@pytest.mark.parametrize("groups", [3, 12])
def test_held_out_fits_equal_single_fits(spark, groups):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(600, 3)) * [1, 50, 0.01] + [0, 1000, 5]
    g = draw.integers(0, groups, 600)
    y = (draw.random(600) < 1 / (1 + np.exp(-(x[:, 0] * 2 - (x[:, 1] - 1000) / 40 + g % 2)))).astype(int)
    passes = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"fits-{groups}", "")
    model = M.held_out_logistic(rows(spark, x, y, g), groups, 3, lambda n: np.full(len(n), 1e-3))
    jobs = len(passes.getJobIdsForGroup(f"fits-{groups}"))
    for k in range(groups):
        want = single(x[g != k], y[g != k], 1e-3)
        assert model.weights[k] == pytest.approx(want, rel=1e-6, abs=1e-7)
    assert model.steps < 15 and jobs <= 4 * (model.steps + 3)  # the same for any number of groups


def test_one_class_and_one_group(spark):
    x = np.arange(20.0)[:, None]
    model = M.held_out_logistic(rows(spark, x, np.ones(20), np.arange(20) % 2), 2, 1, lambda n: np.full(len(n), 1e-3))
    assert np.isfinite(model.weights).all() and (model.score(x, np.zeros(20, int)) > 0.9).all()
    model = M.held_out_logistic(rows(spark, x, np.arange(20) % 2, np.zeros(20)), 1, 1, lambda n: np.full(len(n), 1e-3))
    assert np.isfinite(model.weights).all()


def test_digamma():
    euler = 0.5772156649015329
    assert M.digamma(np.array([1.0, 2.0, 0.5, 100.0])) == pytest.approx([-euler, 1 - euler, -euler - 2 * math.log(2), math.log(100) - 1 / 200 - 1 / 120000], abs=1e-10)


def plain_mixture(x, start, prior, steps):
    """The same posterior written out component by component."""
    n, d = x.shape
    k = len(start)
    mean, var = x.mean(0), x.var(0, ddof=1)
    r = np.eye(k)[((x[:, None] - start[None]) ** 2).sum(2).argmin(1)]
    for step in range(steps):
        size = r.sum(0) + 1e-15
        parts = np.empty((n, k))
        a, b = 1 + size, np.array([prior + size[j + 1 :].sum() for j in range(k)])
        for j in range(k):
            centre = r[:, j] @ x / size[j]
            spread = r[:, j] @ (x - centre) ** 2 / size[j] + 1e-6
            m, dof = (mean + size[j] * centre) / (1 + size[j]), d + size[j]
            v = (var + size[j] * (spread + (centre - mean) ** 2 / (1 + size[j]))) / dof
            share = M.digamma(a[j]) - M.digamma(a[j] + b[j]) + sum(M.digamma(b[i]) - M.digamma(a[i] + b[i]) for i in range(j))
            inner = d * math.log(2) - d * math.log(dof) + sum(float(M.digamma((dof - i) / 2)) for i in range(d))
            parts[:, j] = share + 0.5 * (inner - d / (1 + size[j]) - d * math.log(2 * math.pi) - np.log(v).sum() - ((x - m) ** 2 / v).sum(1))
        total = np.logaddexp.reduce(parts, axis=1)
        r = np.exp(parts - total[:, None])
    stick = a / (a + b)
    w = stick * np.cumprod(np.r_[1, 1 - stick[:-1]])
    return total, w / w.sum()


def test_mixture_against_a_plain_loop(spark):
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal([0, 0, 0], [1, 0.3, 2], (300, 3)), draw.normal([6, -4, 1], 0.5, (150, 3))])
    start = x[draw.choice(len(x), 8, False)]
    d = checkpointed(spark.createDataFrame([([float(a) for a in v],) for v in x], "x array<double>").repartition(4))
    model = M.dirichlet_mixture(d, start, tol=1e-4)
    total, weights = plain_mixture(x, start, 1e-2, model.steps)
    assert model.log_likelihood(x) == pytest.approx(total, rel=1e-6)
    assert model.weights == pytest.approx(weights, abs=1e-8)
    assert 2 <= (model.weights > 0.01).sum() < 8
