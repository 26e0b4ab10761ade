"""The radial machine's start from blocks: few rounds are left where most rows are support vectors, and sums over many tiles are those of the whole matrix."""

import numpy as np
import pytest

from facetmill.operators import evaluation, kernel


@pytest.mark.parametrize("cfg", [kernel.KernelConfig(), kernel.KernelConfig(working=512, settle=2)])
def test_few_rounds_from_blocks(spark, monkeypatch, cfg):
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(700, 6)), rng.integers(0, 2, 700)
    frame = lambda at: spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in at], "row_id long, x array<double>, y int")
    monkeypatch.setattr(evaluation, "VALUES", 1200)
    assert min(evaluation.blocks_of(600, 600, 6)) >= 3
    got = kernel.fit(frame(range(600)), frame(range(600, 700)), list(range(6)), cfg)
    assert got.rounds <= 3 and max(got.violation) < 1e-3
    alpha, s, gamma = np.zeros(600), np.where(y[:600] == 0, 1.0, -1.0), 1 / (6 * x[:600].var())
    for r in got.support().collect():
        alpha[r["row_id"]] = r["alpha"]
    assert (alpha > 0).sum() > 300 and abs(alpha @ s) < 1e-9
    k = np.exp(-gamma * ((x[:, None] - x[None, :600]) ** 2).sum(axis=2)) @ (alpha * s)
    totals = {r["row_id"]: r["total"][0] for df in (got.rows, got.scores) for r in df.select("row_id", "total").collect()}
    assert len(totals) == 700 and np.allclose([totals[i] for i in range(700)], k, atol=1e-9)
