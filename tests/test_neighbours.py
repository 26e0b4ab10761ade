"""Information by nearest neighbours, against brute force on all pairs of rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetmill.operators import neighbours
from facetmill.plans import workflows


def psi(x):
    return sum(1 / i for i in range(1, x)) - 0.57721566490153286


def force(x, y, k):
    """x: rows by features."""
    far = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)) if x.shape[1] > 1 else np.abs(x - x.T)
    np.fill_diagonal(far, np.inf)
    n, total = len(x), 0.0
    for i in range(n):
        d = np.sort(far[i][y == y[i]])[k - 1]
        total += psi(int((y == y[i]).sum())) + psi(int((far[i] <= d).sum()))
    return psi(n) + psi(k) - total / n


def frame(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "row_id long, x array<double>, y int")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 150)
    x = rng.normal(size=(150, 5)) + y[:, None] * np.array([1.5, 0.0, 0.5, 0.0, 0.0])
    x[:, 2] = np.round(x[:, 2])  # ties
    x[:, 3] = 4.0  # constant
    x[:, 4] = np.where(rng.random(150) < 0.6, 0.0, x[:, 4])  # one value for most rows
    return x, y


def test_digamma(spark):
    got = spark.range(1, 200).select("id", neighbours.digamma(F.col("id").cast("double")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(psi(r["id"]), abs=1e-11) for r in got)


@pytest.mark.parametrize(("k", "block"), [(None, 50_000), (3, 11), (2, 4)])
def test_one_feature(spark, data, k, block):
    """Blocks of a few cells give what one block gives; constant columns have no row; k follows from the smallest class."""
    x, y = data
    got = {r["feature_id"]: r["mi"] for r in neighbours.information(frame(spark, x, y).repartition(3), list(range(5)), k, block).collect()}
    assert got == {j: pytest.approx(force(x[:, [j]], y, k or 5), abs=1e-9) for j in (0, 1, 2, 4)}


def test_running_sums(spark):
    df = spark.range(500).select((F.col("id") % 3).cast("int").alias("g"), (F.col("id") * 7 % 101).alias("o"), "id", F.col("id").alias("w"))
    got = {r["id"]: r["before"] for r in neighbours.running(df.repartition(5), ["g"], ["o", "id"], "w").collect()}
    rows = [(i % 3, i * 7 % 101, i) for i in range(500)]
    assert got == {i: sum(c for a, b, c in rows if a == g and (b, c) < (o, i)) for g, o, i in rows}


def test_two_features(spark, data):
    x, y = data
    got = {r["feature_id"]: r["mi"] for r in neighbours.joint_information(frame(spark, x, y), 0, [1, 2, 4], 4, block=40).collect()}
    assert got == {j: pytest.approx(force(x[:, [0, j]], y, 4), abs=1e-9) for j in (1, 2, 4)}


def test_greedy_order(spark, data):
    x, y = data
    k, left = 5, [0, 1, 2, 4]
    order = [max(left, key=lambda j: force(x[:, [j]], y, k))]
    while len(order) < 3:
        rest = [j for j in left if j not in order]
        order.append(max(rest, key=lambda j: min(force(x[:, [c, j]], y, k) for c in order)))
    assert neighbours.by_joint_information(frame(spark, x, y), list(range(5)), 3) == order


def test_small_classes_are_an_error(spark, tmp_path):
    y = [0] * 10 + [1] * 2
    df = frame(spark, np.arange(24.0).reshape(12, 2), y)
    with pytest.raises(ValueError, match="smallest has 2"):
        neighbours.neighbours_for(df)
    study = workflows.Study(spark, str(tmp_path), {"d": (df, 2)})
    with pytest.raises(ValueError, match="smallest has 2"):
        study.order("jmim", df, 2, 2)


def test_rankings_have_a_tail(spark, data, tmp_path):
    """A method that ranks a pool only, or leaves constant features out, is followed by the other ids in order."""
    x, y = data
    study = workflows.Study(spark, str(tmp_path), {}, pool=3)
    order = study.order("jmim", frame(spark, x, y), 5, 5)
    assert sorted(order) == list(range(5)) and order[-2:] == sorted(order[-2:]) and order[0] == 0 and 3 in order[-2:]
    assert study.order("jmim", frame(spark, x, y), 5, 1) == [0] and math.isfinite(force(x[:, [0]], y, 5))
