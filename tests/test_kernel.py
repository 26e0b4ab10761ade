"""The radial support vector machine against a plain solver on the whole kernel matrix."""

import itertools

import numpy as np
import pytest

from facetmill.operators import evaluation, kernel


def force(x, y, t, gamma, c=1.0):
    """Votes of pairwise machines, each solved on all its rows by the most violating pair (first order); and their objectives."""
    votes, values = np.zeros((len(t), y.max() + 1), int), []
    for a, b in itertools.combinations(range(y.max() + 1), 2):
        own = (y == a) | (y == b)
        s, k = np.where(y[own] == a, 1.0, -1.0), np.exp(-gamma * ((x[own][:, None] - x[own][None]) ** 2).sum(axis=2))
        alpha = np.zeros(len(s))
        for _ in range(100_000):
            e = s - k @ (alpha * s)
            up, low = (s > 0) & (alpha < c) | (s < 0) & (alpha > 0), (s > 0) & (alpha > 0) | (s < 0) & (alpha < c)
            i, j = np.argmax(np.where(up, e, -np.inf)), np.argmin(np.where(low, e, np.inf))
            if e[i] - e[j] < 1e-5:
                break
            step = min((e[i] - e[j]) / (2 - 2 * k[i, j]), c - alpha[i] if s[i] > 0 else alpha[i], alpha[j] if s[j] > 0 else c - alpha[j])
            alpha[i] += s[i] * step
            alpha[j] -= s[j] * step
        kt = np.exp(-gamma * ((t[:, None] - x[own][None]) ** 2).sum(axis=2))
        first = kt @ (alpha * s) + (e[i] + e[j]) / 2 > 0
        votes[np.arange(len(t)), np.where(first, a, b)] += 1
        values.append(alpha.sum() - (alpha * s) @ k @ (alpha * s) / 2)
    return votes.argmax(axis=1), values


def frame(spark, x, y, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "row_id long, x array<double>, y int")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 180)
    angle = rng.uniform(0, 2 * np.pi, 180)
    x = np.stack([(1 + y) * np.cos(angle), (1 + y) * np.sin(angle), rng.normal(size=180)], axis=1) + 0.25 * rng.normal(size=(180, 3))
    return x, y


@pytest.mark.parametrize("working", [256, 12])
def test_rings(spark, data, working):
    """Classes that no line divides; small working sets need many rounds and end at the same optimum."""
    x, y = data
    train, test = frame(spark, x[:120], y[:120]).repartition(3), frame(spark, x[120:], y[120:], 120)
    got = kernel.fit(train, test, [0, 1], kernel.KernelConfig(working=working))
    gamma = 1 / (2 * x[:120, :2].var())
    want, values = force(x[:120, :2], y[:120], x[120:, :2], gamma)
    assert max(got.violation) < 1e-3 and (got.rounds > 3) == (working == 12)
    said = {r["row_id"]: r["pred"] for r in got.predictions().collect()}
    assert np.mean([said[120 + i] == w for i, w in enumerate(want)]) >= 0.98 and np.mean(want == y[120:]) > 0.8
    alpha = {(r["pair"], r["row_id"]): r["alpha"] for r in got.support().collect()}
    for p, (a, b) in enumerate(got.pairs):
        own = np.flatnonzero((y[:120] == a) | (y[:120] == b))
        s, w = np.where(y[own] == a, 1.0, -1.0), np.array([alpha.get((p, i), 0.0) for i in own])
        k = np.exp(-gamma * ((x[own][:, None, :2] - x[own][None, :, :2]) ** 2).sum(axis=2))
        assert 0 <= w.min() and w.max() <= 1 and abs(w @ s) < 1e-9
        value = w.sum() - (w * s) @ k @ (w * s) / 2
        hinge = np.maximum(0, 1 - s * (k @ (w * s) + got.bias[p])).sum() + (w * s) @ k @ (w * s) / 2
        assert value == pytest.approx(values[p], rel=1e-3) and hinge - value < 1e-3 * len(own)  # gap of primal and dual


def test_as_a_classifier(spark, data):
    x, y = data
    e = evaluation.evaluate(frame(spark, x[:120], y[:120]), frame(spark, x[120:], y[120:], 120), [0, 1], "svm")
    assert e["error"] is None and e["accuracy"] > 0.8 and "svm" in evaluation.CLASSIFIERS


def test_one_class_and_equal_rows(spark):
    one = frame(spark, np.ones((4, 2)), [0, 0, 0, 0])
    with pytest.raises(ValueError, match="two classes"):
        kernel.fit(one, one, [0])
    both = frame(spark, np.ones((6, 2)), [0, 0, 0, 0, 1, 1])
    assert {r["pred"] for r in kernel.predict(both, both, [0, 1]).collect()} <= {0, 1}
    with pytest.raises(RuntimeError, match="converged"):
        kernel.fit(frame(spark, [[0.0], [1.0], [2.0], [3.0]], [0, 1, 0, 1]), one, [0], kernel.KernelConfig(rounds=0))
