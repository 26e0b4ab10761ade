"""How often the rows are read, and by how many Python workers of a task, on the way to entropies."""

import numpy as np

from facetmill.operators import discretize, information
from facetmill.sources import tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_values_need_few_passes(spark, monkeypatch):
    """Few different values of many rows are known as soon as their cells hold one value each, without all bits of their keys."""
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(1, 51, 3000), rng.integers(0, 11, 3000) / 100, rng.choice([-0.0, 0.0, -7.5], 3000), np.round(rng.uniform(900, 105000, 3000), 2)], axis=1)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    ranks = [0, 1, 299, 300, 1500, 2700, 2999]
    calls, read = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: calls.append(1) or read(self, *a, **k))
    np.testing.assert_array_equal(discretize.order_statistics(df, [0, 1, 2, 3], ranks, few=1), np.sort(x + 0.0, axis=0)[ranks].T)
    assert len(calls) <= 4, len(calls)
    calls.clear()
    np.testing.assert_array_equal(discretize.order_statistics(df, [2, 0], ranks, few=1, ends=[(-7.5, 0.0), (1.0, 50.0)]), np.sort(x + 0.0, axis=0)[ranks].T[[2, 0]])
    assert len(calls) <= 2, len(calls)


def test_cells_are_bounded_for_many_features(spark, monkeypatch):
    """With few cells a pass decides fewer bits, and the values are the same."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)) * 10.0 ** rng.integers(-9, 9, (1, 6))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(2)
    monkeypatch.setattr(discretize, "CELLS", 256)
    np.testing.assert_array_equal(discretize.order_statistics(df, [0, 1, 2, 3, 4, 5], [0, 7, 200, 399], few=3), np.sort(x, axis=0)[[0, 7, 200, 399]].T)


def test_coded_and_counted_by_one_worker(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist(), int(i % 3)) for i in range(300)], "row_id long, x array<double>, y int")
    edges, subsets = discretize.fit(df, 3, 4), [(0,), (1,), (2,), (0, 2), (0, 1, 2)]
    one = information.joint_entropies(df, subsets, discretize.width(edges), edges=edges)
    assert plan(one).count("MapInArrow") == 1
    two = information.joint_entropies(discretize.encode(df, edges).select("codes", "y"), subsets, discretize.width(edges))
    key = lambda r: r["subset_id"]
    assert sorted(one.collect(), key=key) == sorted(two.collect(), key=key)


def test_labels_are_counted_once(spark):
    """Plans on prepared rows do not count the labels again."""
    df = spark.range(40).selectExpr("id", "if(id < 3, null, if(id = 3, 'z', if(id % 2 = 0, 'b', 'a'))) AS label")
    got = tables.prepared(df)
    assert "Aggregate" not in plan(got)
    assert sorted({(r["label"], r["y"]) for r in got.collect()}) == [("a", 1), ("b", 2)] and got.count() == 36  # null has the first code
