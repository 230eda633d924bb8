"""Nested choices against a plain loop over folds and candidates."""

import numpy as np
import pytest

from corpusloom.operators import models


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = (x[:, 0] + 0.4 * x[:, 4] + 0.2 * rng.normal(size=120) > 0).astype(int)
    return x, y, np.arange(120) // 3 % 4


def apart(x, y, f, kind, c):
    """Probabilities of each fold by a model, and a sigmoid, of the others."""
    p, m = np.zeros(len(y)), np.zeros(len(y))
    for k in sorted(set(f.tolist())):
        rest = f != k
        inner = np.zeros(rest.sum())
        for j in sorted(set(f[rest].tolist())):
            w = models.TRAINERS[kind](x[rest][f[rest] != j], y[rest][f[rest] != j], c)
            inner[f[rest] == j] = x[rest][f[rest] == j] @ w[:-1] + w[-1]
        a, b = models.platt(inner, y[rest])
        w = models.TRAINERS[kind](x[rest], y[rest], c)
        m[~rest] = x[~rest] @ w[:-1] + w[-1]
        p[~rest] = 1 / (1 + np.exp(-(a * m[~rest] + b)))
    return m, p


def table(spark, x, y, f):
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i]), int(f[i])) for i in range(len(y))], "id bigint, x array<double>, label int, fold int")


@pytest.mark.parametrize("kind", ["logistic", "svm"])
def test_cross_fit(spark, sample, kind):
    x, y, f = sample
    m, p = apart(x, y.astype(float), f, kind, 0.7)
    out = {r.id: r for r in models.cross_fit(table(spark, x, y, f), kind=kind, c=0.7, folds=4).collect()}
    assert len(out) == 120 and max(abs(out[i].margin - m[i]) for i in out) < 1e-9 and max(abs(out[i].p - p[i]) for i in out) < 1e-9


def test_nested_search(spark, sample):
    x, y, f = sample
    candidates = [("logistic", 1.0, 2), ("logistic", 1.0, 6), ("svm", 0.5, 6)]
    want, scores = {}, {}
    for own in range(4):
        rest, tried = f != own, []
        for k, (kind, c, dims) in enumerate(candidates):
            z = x[:, :dims] / np.linalg.norm(x[:, :dims], axis=1, keepdims=True)
            _, p = apart(z[rest], y[rest].astype(float), f[rest], kind, c)
            loss = np.mean(np.where(y[rest] == 1, -np.log(p), -np.log(1 - p)))
            tried.append(((p[y[rest] == 0] >= 0.5).mean(), loss, k))
        safe = [t for t in tried if t[0] <= tried[0][0] + 1e-15]
        want[own] = min(safe, key=lambda t: (t[1], t[2]))
        kind, c, dims = candidates[want[own][2]]
        z = x[:, :dims] / np.linalg.norm(x[:, :dims], axis=1, keepdims=True)
        scores |= {int(i): apart(z, y.astype(float), f, kind, c)[1][i] for i in np.flatnonzero(f == own)}
    best, out = models.nested_search(table(spark, x, y, f), candidates, folds=4)
    assert {r.fold: (round(r.false_positive_rate, 9), round(r.log_loss, 9), r.candidate) for r in best.collect()} == {k: (round(a, 9), round(b, 9), c) for k, (a, b, c) in want.items()}
    got = {r.id: r.p for r in out.collect()}
    assert len(got) == 120 and max(abs(got[i] - scores[i]) for i in got) < 1e-9


def test_orient():
    assert models.orient(2.0, "b", ("a", "b")) == 2.0 and models.orient(2.0, "a", ("a", "b")) == -2.0
    with pytest.raises(ValueError):
        models.orient(2.0, "c", ("a", "b"))


def test_fusion_safe(spark):
    rows = [(i, int(i % 2), 0.9 if i % 2 else 0.2, 0.95 if i % 2 else (0.6 if i % 8 else 0.1), i % 4) for i in range(80)]
    best, out = models.nested_fusion(spark.createDataFrame(rows, "id int, label int, pa double, pb double, fold int"), [0.0, 0.5, 1.0])
    assert all(r.weight < 1 and r.false_positive == 0 for r in best.collect()) and out.count() == 80
