"""Conditional permutation tests: what a label depends on, the same on any partitioning, against plain counting."""

import collections
import math

import numpy as np
import pytest

from facetmill.operators import blanket, discretize
from facetmill.plans import workflows


@pytest.fixture(scope="module")
def data():
    """The label follows features 0 and 3; 1 is a blurred copy of 0, 5 is constant, the rest is noise."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 7))
    y = ((x[:, 0] > 0).astype(int) + (x[:, 3] > 0.3) + (rng.random(500) < 0.05)) % 3
    x[:, 1] = x[:, 0] + 0.8 * rng.normal(size=500)
    x[:, 5] = 2.0
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "row_id long, x array<double>, y int")


@pytest.mark.parametrize("parts", [1, 5])
def test_support_is_recovered(spark, data, parts):
    assert blanket.select(frame(spark, *data).repartition(parts), 7) == [0, 3]


def test_noise_gives_nothing(spark):
    rng = np.random.default_rng(1)
    assert blanket.select(frame(spark, rng.normal(size=(200, 6)), rng.integers(0, 2, 200)), 6) == []


def test_sums_and_margins(spark, data):
    """Unpermuted sums by counting; permutations keep the labels of each stratum, in blocks, on any partitioning."""
    df = frame(spark, *data)
    edges = discretize.fit(df, 7, 4)
    codes = discretize.encode(df, edges)
    cfg = blanket.BlanketConfig(permutations=5, block=100)
    got = {(r["b"], r["j"]): r["t"] for r in blanket.excesses(codes, [0], [1, 3], 4, 500, cfg).collect()}
    rows = codes.collect()
    for j in (1, 3):
        cells = collections.Counter((r["codes"][0], r["codes"][j], r["y"]) for r in rows)
        assert got[-1, j] == pytest.approx(sum(c * math.log(c) for c in cells.values()))
    again = {(r["b"], r["j"]): r["t"] for r in blanket.excesses(codes.repartition(7), [0], [1, 3], 4, 500, cfg).collect()}
    assert set(again) == set(got) and all(again[k] == pytest.approx(got[k]) for k in got)
    # A candidate that is itself given has the table of strata and labels, which no permutation changes.
    fixed = [r["t"] for r in blanket.excesses(codes, [0], [0], 4, 500, cfg).collect()]
    assert len(fixed) == 6 and max(fixed) - min(fixed) < 1e-9
    assert len({round(v, 6) for (b, j), v in got.items() if j == 3}) == 6


def test_strata_in_one_task_or_in_blocks(spark, data):
    """Sums of every permutation by plain counting, with strata that fit a task, that do not, and both; what is exchanged stays small."""
    df = frame(spark, *data)
    codes = discretize.encode(df, discretize.fit(df, 7, 4)).cache()
    rows = sorted(codes.selectExpr("row_id", "y", "codes", "xxhash64(row_id) AS h").collect(), key=lambda r: r["row_id"])
    for block, given in ((30, [0, 2]), (100, [0]), (124, [0]), (600, [0, 2, 4]), (100, [])):
        cfg = blanket.BlanketConfig(permutations=2, block=block)
        got = {(r["b"], r["j"]): r["t"] for r in blanket.excesses(codes, given, [1, 3], 4, 500, cfg).collect()}
        blocks = -(-500 // block)
        for b in range(-1, 2):
            homes = collections.defaultdict(list)
            for r in rows:
                homes[tuple(r["codes"][j] for j in given), r["h"] % blocks].append(r)
            label = {}
            for own in homes.values():
                ids = np.array([r["row_id"] for r in own])
                order = np.argsort(blanket.mixed(ids, (cfg.seed << 20) + b)) if b >= 0 else np.arange(len(own))
                label |= {r["row_id"]: own[o]["y"] for r, o in zip(own, order)}
            for j in (1, 3):
                cells = collections.Counter((*(r["codes"][g] for g in given), r["codes"][j], label[r["row_id"]]) for r in rows)
                assert got[b, j] == pytest.approx(sum(c * math.log(c) for c in cells.values())), (block, given, b, j)
    plan = blanket.excesses(codes, [0, 2, 4], [1, 3], 4, 500, blanket.BlanketConfig(permutations=2))._jdf.queryExecution().optimizedPlan().toString()
    assert " k#" not in plan and " times#" in plan  # no cell leaves a task


def test_in_a_study(spark, data, tmp_path):
    study = workflows.Study(spark, str(tmp_path), {"d": (frame(spark, *data), 7)}, runs=1, classifier="nearest")
    r = study.native_cardinality(("blanket",)).collect()
    assert len(r) == 1 and set(r[0]["selected"]) == {0, 3} and r[0]["error"] is None
