"""Nearest rows by tiles of large blocks against brute force, and how many copies of rows the tiles exchange."""

import numpy as np
import pytest

from facetmill.operators import discretize, evaluation, information, screening


def frame(spark, x, y, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "row_id long, x array<double>, y int")


def test_blocks_grow_slower_than_rows():
    """Copies of rows: what the tiles exchange is bounded by the work of a task, not by blocks of 1,024 rows."""
    for n in (10_000, 100_000, 250_000):
        a, b = evaluation.blocks_of(n, n, 64)
        assert n * 64 / a <= evaluation.VALUES and n * 64 / b <= evaluation.VALUES and a + b <= 27 and a * b >= 10


@pytest.mark.parametrize("metric", ["square", "gap"])
@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_best_with_ties(metric, offset):
    """Small whole numbers, so that many distances are equal and ids decide; a common offset costs no pair."""
    rng = np.random.default_rng(4)
    v, w = rng.integers(0, 3, (70, 6)) + offset, rng.integers(0, 3, (310, 6)) + offset
    ids, n_ids = np.arange(70), rng.permutation(310)
    for itself in (True, False):
        i, j, far = evaluation.best(v, ids, w, n_ids, 7, metric, itself, rows=32, chunk=50)
        gap = v[:, None] - w[None]
        full = (gap * gap if metric == "square" else np.abs(gap)).sum(axis=2)
        if not itself:
            full[ids[:, None] == n_ids[None]] = np.inf
        for r in range(70):
            want = np.lexsort((n_ids, full[r]))[:7]
            assert j[i == r].tolist() == want.tolist() and np.allclose(far[i == r], full[r][want])


@pytest.mark.parametrize("by_class", [False, True])
def test_closest_over_many_tiles(spark, monkeypatch, by_class):
    monkeypatch.setattr(evaluation, "VALUES", 120)
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(size=(150, 4)), 1), rng.integers(0, 3, 150)
    df = frame(spark, x, y)
    assert min(evaluation.blocks_of(150, 150, 4)) >= 5
    got = {}
    for r in evaluation.closest(df, df, [0, 1, 2, 3], 3, by_class, "gap" if by_class else "square").collect():
        got.setdefault((r["row_id"], r["n_y"] if by_class else None), set()).add((r["n_id"], r["n_y"], r["far"]))
    full = np.round(np.abs(x[:, None] - x[None]).sum(axis=2) if by_class else ((x[:, None] - x[None]) ** 2).sum(axis=2), 9)
    for r in range(150):
        for c in range(3) if by_class else [None]:
            rows = [i for i in range(150) if not by_class or (y[i] == c and i != r)]
            want = sorted(rows, key=lambda i: (full[r, i], i))[:3]
            assert {n for n, _, _ in got[r, c]} == set(want)


def test_relieff_over_many_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(120, 3)), rng.integers(0, 3, 120)
    one = {r["feature_id"]: r["score"] for r in screening.relieff_scores(frame(spark, x, y), 3).collect()}
    monkeypatch.setattr(evaluation, "VALUES", 90)
    monkeypatch.setattr(screening, "VALUES", 90)
    many = {r["feature_id"]: r["score"] for r in screening.relieff_scores(frame(spark, x, y), 3).collect()}
    u = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))
    share, want = np.bincount(y) / 120, np.zeros(3)
    for i in range(120):
        for c in range(3):
            own = [j for j in range(120) if y[j] == c and j != i]
            near = sorted(own, key=lambda j: (round(np.abs(u[i] - u[j]).sum(), 9), j))[:10]
            want += (-1 if c == y[i] else share[c] / (1 - share[y[i]])) * np.abs(u[i] - u[near]).mean(axis=0) / 120
    assert one == {j: pytest.approx(want[j]) for j in range(3)} and many == {j: pytest.approx(want[j]) for j in range(3)}


def test_marginal_associations_fit_once(spark, monkeypatch):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, 200)
    df, calls, fit = frame(spark, np.stack([y + rng.normal(size=200), rng.normal(size=200), np.ones(200)], axis=1), y), [], discretize.fit
    want = {j: pytest.approx(information.marginal_association(df, j)) for j in range(3)}
    monkeypatch.setattr(discretize, "fit", lambda *a, **k: calls.append(a) or fit(*a, **k))
    assert information.marginal_associations(df, 3) == want and len(calls) == 1
