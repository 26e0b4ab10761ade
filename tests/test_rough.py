"""Fuzzy-rough selection against brute force, and what stages of a run cost."""

import numpy as np
import pytest

from facetmill.config import Settings
from facetmill.operators import rough
from facetmill.plans import audit, selector, workflows


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 90)
    x = rng.normal(size=(90, 5))
    x[:, 1] += 2 * (y == 1)
    x[:, 3] += 2 * (y == 2)
    x[:, 4] = 1.0
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "row_id long, x array<double>, y int")


def force(x, y, features):
    s = x.std(axis=0)
    u = np.where(s > 0, x / np.where(s > 0, s, 1), 0.0)[:, features]
    like = np.maximum(0, 1 - np.abs(u[:, None] - u[None])).min(axis=2)
    return np.mean([1 - like[i][y != y[i]].max() for i in range(len(y))])


def test_dependencies(spark, data):
    x, y = data
    rows = rough.unit(frame(spark, x, y), list(range(5)))
    for chosen in ([], [1], [1, 3]):
        rest = [j for j in range(5) if j not in chosen]
        got = rough.dependencies(rows, chosen, rest, 90, block=25)
        assert got == {j: pytest.approx(force(x, y, [*chosen, j])) for j in rest}


@pytest.mark.parametrize("parts", [1, 9])
def test_single_features_by_their_order(spark, parts):
    """Ties over classes, a class of one row and a table of one class, over more partitions than values; no pair of rows is made."""
    rng = np.random.default_rng(3)
    x, y = np.round(rng.normal(size=(140, 3)), 1), rng.integers(0, 2, 140)
    x[:, 1] = np.sort(rng.normal(size=140))
    y[7] = 2
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = rough.dependencies(rough.unit(frame(spark, x, y), [0, 1, 2]), [], [0, 1, 2], 140)
        by_class = rough.alone(rough.unit(frame(spark, x, np.sort(y)), [0, 1, 2]), [1])
        same = rough.alone(rough.unit(frame(spark, x, 0 * y), [0, 1, 2]), [2])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {j: pytest.approx(force(x, y, [j])) for j in range(3)}
    assert by_class == {1: pytest.approx(force(x, np.sort(y), [1]))} and same == {2: 1.0}


def test_selection_reaches_the_dependency_of_all(spark, data):
    x, y = data
    order, chosen = rough.select(frame(spark, x, y), list(range(5))), []
    for pick in order:
        rest = [j for j in range(5) if j not in chosen]
        assert pick == max(rest, key=lambda j: (round(force(x, y, [*chosen, j]), 9), -j))
        chosen.append(pick)
    assert force(x, y, chosen) == pytest.approx(force(x, y, list(range(5)))) and 4 not in chosen


def test_guard(spark, data, tmp_path):
    x, y = data
    with pytest.raises(rough.TooLarge, match="infeasible"):
        rough.select(frame(spark, x, y), [0, 1], most=1000)
    rough.guard(1000, 100)
    study = workflows.Study(spark, str(tmp_path), {"d": (frame(spark, x, y), 5)}, runs=1, classifier="nearest")
    t = study.native_cardinality(("fuzzy_rough",)).collect()
    assert len(t) == 1 and 0 < t[0]["n_selected"] <= 5 and t[0]["error"] is None


def test_stages_are_recorded(spark, data, tmp_path):
    x, y = data
    cost = audit.Audit(spark, "one")
    got = selector.fit(frame(spark, x, y), 5, Settings().but(screen={"keep": 3}), audit=cost)
    assert got.selected == selector.fit(frame(spark, x, y), 5, Settings().but(screen={"keep": 3})).selected
    t = {r["stage"]: r for r in cost.table().collect()}
    assert list(t) == ["screen", "code", "count", "select"]
    assert all(r["run"] == "one" and r["seconds"] > 0 and r["jobs"] > 0 and r["tasks"] >= r["jobs"] and r["failed_tasks"] == 0 and r["peak_worker_mb"] > 10 for r in t.values())
    assert t["code"]["rows"] == 90 and t["count"]["rows"] == 3 + 3 + 1
    with pytest.raises(ValueError), cost.stage("fails"):
        raise ValueError
    assert cost.found[-1][1] == "fails"


def test_runtime_sweep(spark, tmp_path):
    study = workflows.Study(spark, str(tmp_path), {})
    rows = study.runtime((8,), (2,), (10, 100), n=60, keeps=(5, None)).collect()
    assert {(r["keep"], r["most"], r["n_groups"], r["all_groups"]) for r in rows} == {(5, 10, 10, 10), (5, 100, 10, 10), (8, 10, 10, 28), (8, 100, 28, 28)}
    assert all(r["status"] == "OK" and r["peak_worker_mb"] > 10 for r in rows)
    manifest = {r["section"]: r["rows"] for r in study.export(str(tmp_path / "out")).collect()}
    assert manifest == {"runtime": 4, "stages": 16}
    back = spark.read.option("header", True).csv(str(tmp_path / "out/csv/runtime"))
    assert {int(r["keep"]) for r in back.collect()} == {5, 8} and spark.read.json(str(tmp_path / "out/json/stages")).count() == 16
    assert spark.read.json(str(tmp_path / "out/manifest")).count() == 2
    assert study.table("stages").count() == 16 and study.runtime((8,), (2,), (10, 100), n=60, keeps=(5, None)).count() == 4
