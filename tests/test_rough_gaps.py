"""Gaps of levels in bytes: a bounded stand-in for sums of gaps, with few pairs left to compute in full."""

import numpy as np
import pytest

from facetmill.operators import evaluation


@pytest.mark.parametrize("f", [3, 64, 1100])
def test_bound_holds(f):
    rng = np.random.default_rng(f)
    v, w = rng.normal(size=(20, f)), rng.normal(size=(30, f)) + 0.5
    low = np.minimum(v.min(axis=0), w.min(axis=0))
    step = (np.maximum(v.max(axis=0), w.max(axis=0)) - low).max() / evaluation._LEVELS
    (a, a_off), (b, b_off) = evaluation._levels(v, low, step), evaluation._levels(w, low, step)
    assert a.dtype == np.int8 and a.min() >= 0 and max(a.max(), b.max()) <= evaluation._LEVELS
    rough, full = evaluation._rough_gaps(a, b), np.abs(v[:, None] - w[None]).sum(axis=2)
    assert np.array_equal(rough, np.abs(a[:, :, None].astype(int) - b[:, None]).sum(axis=0))
    assert (np.abs(rough * step - full) <= a_off[:, None] + b_off + 1e-9).all()


def test_few_pairs_in_full(monkeypatch):
    """Random rows of 64 features; each pair is looked at once."""
    rng, pairs, gaps = np.random.default_rng(1), [], evaluation._gaps
    v, w = rng.normal(size=(128, 64)), rng.normal(size=(9000, 64))
    monkeypatch.setattr(evaluation, "_gaps", lambda v, p, w, q, m: pairs.append(p * len(w) + q) or gaps(v, p, w, q, m))
    i, j, far = evaluation.best(v, np.arange(128), w, np.arange(9000), 10, "gap")
    full = np.round(np.abs(v[:, None] - w[None]).sum(axis=2), 9)
    assert np.array_equal(j.reshape(128, 10), np.argsort(full, axis=1, kind="stable")[:, :10])
    seen = np.concatenate(pairs)
    assert len(seen) == len(np.unique(seen)) < 0.05 * 128 * 9000
