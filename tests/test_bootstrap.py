"""Bootstrap replicates by weights, rank association, consensus, and features that are not numbers, against plain NumPy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetmill.config import Settings
from facetmill.operators import bootstrap, discretize, evaluation, information, screening, statistics
from facetmill.plans import selector, workflows
from facetmill.sources import tables


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 6))
    y = (x[:, 0] + x[:, 1] + 0.3 * rng.normal(size=240) > 0).astype(int)
    return spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "row_id long, x array<double>, y int").cache()


def counts_by_force(key, seed, n):
    digits = "".join(hashlib.md5(f"{seed}|{key}|{b}".encode()).hexdigest() for b in range(-(-n // 8)))
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    return [sum(int(digits[4 * i : 4 * i + 4], 16) >= math.floor(65536 * c) for c in cdf) for i in range(n)]


def test_poisson_counts(spark):
    rows = spark.range(3000).select("id", bootstrap.poisson_counts(F.col("id"), 7, 20).alias("w")).collect()
    assert all(r["w"] == counts_by_force(r["id"], 7, 20) for r in rows[:50])
    w = np.array([r["w"] for r in rows])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs(np.corrcoef(w.T) - np.eye(20)).max() < 0.08


def test_one_pass_equals_separate_counts(data):
    """Cells of every replicate are those of the rows repeated by their counts, on any partitioning; only wanted ones are counted."""
    n, edges = 5, discretize.fit(data, 6, 4)
    rows = discretize.encode(bootstrap.weighted(data, n, 3), edges)
    subsets = [(0,), (2, 4), (0, 1, 5)]
    want = {}
    for r in rows.collect():
        for s, m in enumerate(subsets):
            k = 0
            for j in m:
                k = 4 * k + r["codes"][j]
            for b, w in enumerate(r["w"]):
                if w:
                    want[b, s, k, r["y"]] = want.get((b, s, k, r["y"]), 0) + w
    for parts in (1, 7):
        got = bootstrap.joint_counts(rows.repartition(parts), subsets, 4, n, rows=50).collect()
        assert {tuple(r)[:4]: r["c"] for r in got} == want
    some = bootstrap.joint_counts(rows, subsets, 4, n, wanted=[[0], [1, 4], [3]]).collect()
    assert {tuple(r)[:4]: r["c"] for r in some} == {k: c for k, c in want.items() if k[0] in ([0], [1, 4], [3])[k[1]]}


def test_replicates_select_like_repeated_rows(data):
    s = Settings().but(screen={"keep": 4}, groups={"largest": 3}, goal={"select": 3})
    got = selector.replicated(data, 6, s, replicates=3, seed=9)
    edges = discretize.fit(data, 6)
    width = discretize.width(edges)
    rows = discretize.encode(bootstrap.weighted(data, 3, 9), edges)
    assert sorted(got) == [0, 1, 2]
    for r in got:
        again = rows.select("y", "codes", F.explode(F.array_repeat(F.lit(1), F.col("w")[r])))
        keep = sorted(x["feature_id"] for x in screening.top(screening.mi_scores(again, 6, width), 4).collect())
        own = again.select("y", F.transform(F.array(*map(F.lit, keep)), lambda j: F.get("codes", j)).alias("codes"))
        sets, every = selector.subsets(4, s)
        want = selector.chosen(information.joint_entropies(own, every, width), keep, 6, s, sets)
        assert (got[r].screened, got[r].selected) == (keep, want.selected)
        assert got[r].path.values == pytest.approx(want.path.values)


def test_replicates_need_two_classes(spark):
    one = spark.createDataFrame([(i, [float(i), float(-i)], 0) for i in range(9)], "row_id long, x array<double>, y int")
    assert selector.replicated(one, 2, Settings(), 3) == {}
    with pytest.raises(ValueError):
        selector.replicated(one, 2, Settings().but(screen={"by": "relieff"}), 3)


def test_consensus(spark, data, tmp_path, monkeypatch):
    monkeypatch.setitem(workflows.PROFILES, "smoke", workflows.PROFILES["smoke"] | {"splits": 2, "group_seeds": 0, "bootstrap": 3})
    s = Settings().but(screen={"keep": 5}, groups={"largest": 2}, goal={"select": 3})
    study = workflows.Study(spark, str(tmp_path), {"d": (data, 6)}, s, classifier="nearest", runs=1)
    kinds = {r["kind"]: r["count"] for r in study.stability().groupBy("kind").count().collect()}
    assert kinds == {"splits": 2, "screened": 2, "both": 2, "same": 2, "bootstrap": 3}
    assert {r["kind"] for r in study.stability_summary().collect()} == set(kinds)
    c = study.consensus().collect()
    assert len(c) == 1 and c[0]["n_bootstrap"] == 3 and {0, 1} <= set(c[0]["selected"]) and 0 < c[0]["stability"] <= 1 and c[0]["accuracy"] > 0.6
    assert study.consensus().count() == 1  # recorded once
    picked = [set(r["selected"]) for r in study.table("stability").filter("kind = 'bootstrap'").collect()]
    assert c[0]["mean_frequency"] == pytest.approx(np.mean([np.mean([f in p for p in picked]) for f in c[0]["selected"]]))


def test_association_points(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 12))
    y = (x[:, :4].sum(axis=1) > 0).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "row_id long, x array<double>, y int")
    monkeypatch.setattr(workflows, "budgets", lambda d: [2, 4, 8, 12])
    study = workflows.Study(spark, str(tmp_path), {"d": (df, 12)}, Settings().but(screen={"keep": 12}, groups={"largest": 2}), classifier="nearest", runs=1)
    one = study.association().collect()
    points = study.table("association_points").orderBy("budget").collect()
    assert [p["budget"] for p in points] == [2, 4, 8, 12] and len(one) == 1 and one[0]["n_points"] == 4
    values = [p["objective"] for p in points]
    assert values == sorted(values) and all(len(p["random"]) == p["budget"] for p in points)
    rank = lambda v: np.array([sum(a < b for a in v) + (sum(a == b for a in v) + 1) / 2 for b in v])
    for name, column in (("accuracy", "accuracy"), ("random", "random_accuracy"), ("information", "information")):
        other = [p[column] for p in points]
        want = np.corrcoef(rank(values), rank(other))[0, 1] if len(set(other)) > 1 else None
        assert one[0][f"rho_{name}"] == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize(("rho", "n"), [(0.5, 10), (-0.5, 10), (0.8, 5), (0.9, 8), (0.0, 20), (0.3, 100), (0.1, 1000), (0.5, 3), (0.999, 4)])
def test_p_of_a_correlation(rho, n):
    """The tails of Student's density by the trapezoidal rule."""
    df = n - 2
    t = np.linspace(0, abs(rho) * math.sqrt(df / (1 - rho * rho)), 1_000_001)
    density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + t * t / df) ** (-(df + 1) / 2)
    assert statistics.correlation_p(rho, n) == pytest.approx(1 - 2 * np.trapezoid(density, t), abs=1e-8)


def test_p_at_the_ends():
    assert statistics.correlation_p(1.0, 6) == 0.0 and statistics.correlation_p(0.5, 2) is None and statistics.correlation_p(None, 9) is None
    assert statistics.correlation_p(0.5, 3) == pytest.approx(2 / 3)


def test_constant_columns_have_no_association(spark):
    t = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert tuple(statistics.rank_association(t, "a", "b").first()) == (None, 3, None)


@pytest.mark.parametrize("bad", [float("nan"), None])
def test_missing_features_are_an_error(spark, bad):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [bad, 1.0], 1), (2, [3.0, 0.0], 0), (3, [5.0, 0.5], 1)], "row_id long, x array<double>, y int")
    for call in (lambda: discretize.fit(df, 2), lambda: selector.fit(df, 2), lambda: screening.anova_scores(df, 2).collect(), lambda: screening.relieff_scores(df, 2).collect()):
        with pytest.raises(Exception, match="null or NaN"):
            call()
    assert "null or NaN" in evaluation.evaluate(df, df, [0], "nearest")["error"]


def test_anova_of_shifted_features(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 400)
    x = rng.normal(size=(400, 4)) + y[:, None] * np.array([2.0, 2.0, 0.0, 0.0])
    x[:, 1] = x[:, 0] + 1e8
    x[:, 3] = 7.0
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "row_id long, x array<double>, y int").repartition(5)
    got = {r["feature_id"]: r["score"] for r in screening.anova_scores(df, 4).collect()}

    def force(v):
        between = sum((y == c).sum() * (v[y == c].mean() - v.mean()) ** 2 for c in range(3)) / 2
        return between / (sum(((v[y == c] - v[y == c].mean()) ** 2).sum() for c in range(3)) / 397)

    assert got[0] == pytest.approx(force(x[:, 0])) and got[1] == pytest.approx(got[0], rel=1e-6) and got[2] == pytest.approx(force(x[:, 2])) and got[3] == 0.0


def test_first_of_repeats_stays(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([(1, "first"), (2, "only"), (1, "second")], "k int, v string").coalesce(1)
    assert tables.append_rows(batch, path, ["k"]) == 2
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "first"), (2, "only")}
