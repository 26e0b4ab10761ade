import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetmill import config
from facetmill.operators import discretize, evaluation, groups, information, objective, reporting, screening, selectors, stability, statistics
from facetmill.plans import selector, workflows
from facetmill.sources import synthetic, tables


def rows(df):
    return [r.asDict() for r in df.collect()]


def coded(spark, x, y):
    return spark.createDataFrame([(list(map(int, a)), int(b)) for a, b in zip(x, y)], "codes array<int>, y int")


def entropy(*columns):
    _, n = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log(p)).sum())


def test_sizes():
    assert config.budgets(2000) == [10, 25, 45, 50, 100] and config.budgets(50) == [10, 25, 50] and config.budgets(10) == [10]
    assert config.sqrt_cardinality(2000) == 45 and config.sqrt_cardinality(100) == 10
    assert config.run_seed(42, "colon", 0) == 826790802
    assert config.screening_size(2000) == 300 and config.screening_size(60) == 50 and config.screening_size(30) == 30 and config.screening_size(100, config.Screen(keep=7)) == 7
    assert config.cardinality(64, 50) == 10 and config.cardinality(64, 5) == 5 and config.cardinality(64, 50, config.Goal(rule="all")) == 50 and config.cardinality(2000, 100, config.Goal(rule="efficiency")) == 10
    assert config.ablation("screen_low", d=2000).screen.keep == 150 and config.ablation("vertex_only").goal.groups == 0 and config.ablation("up_to_fours").groups.largest == 4
    assert {n.split("=")[0] for n, _ in config.one_factor_grid()} == {"penalty", "weights", "largest", "most", "screen", "method", "bins", "slope"}
    with pytest.raises(ValueError):
        config.ablation("no_such_part")


def test_entropies_against_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 4, (250, 5)), rng.integers(0, 3, 250)
    subsets = [s for k in (1, 2, 3) for s in itertools.combinations(range(5), k)]
    for many in (subsets, subsets * 3):  # within and beyond the plan's own list
        for r in rows(information.joint_entropies(coded(spark, x, y), many, 4)):
            c = [x[:, j] for j in r["members"]]
            assert r["h_x"] == pytest.approx(entropy(*c)) and r["h_xy"] == pytest.approx(entropy(*c, y)) and r["h_y"] == pytest.approx(entropy(y))


def test_redundancy_of_copies_functions_and_constants(spark):
    x = np.random.default_rng(1).integers(0, 4, 1000)
    for columns, want in (([x, x], 1.0), ([x, x, x], 1.0), ([x, 2 * x], 1.0), ([x, x // 2], 1.0), ([x * 0, x * 0], 0.0)):
        m = np.stack(columns, 1)
        h = information.joint_entropies(coded(spark, m, x % 2), information.singles(len(columns)) + [tuple(range(len(columns)))], 8)
        r = rows(information.group_evidence(h))[0]
        assert r["redundancy"] == pytest.approx(want, abs=1e-9)
        if len(columns) == 2 and want:
            assert 0 <= r["legacy"] <= 0.5 + 1e-9
    with pytest.raises(ValueError):
        information.joint_entropies(coded(spark, m, x % 2), [(0,)], 8, "guess")


def test_discretizer_against_searchsorted(spark):
    rng = np.random.default_rng(2)
    x = np.stack([rng.normal(size=300), rng.integers(0, 3, 300).astype(float), np.full(300, 2.5)], 1)
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "row_id long, x array<double>, y int")
    for method in ("quantile", "uniform"):
        edges = discretize.fit(df, 3, 7, method)
        assert edges[2] == [2.5]
        got = np.array([r["codes"] for r in rows(discretize.encode(df, edges).orderBy("row_id"))])
        assert (got == np.stack([discretize.searchsorted(x[:, j], edges[j]) for j in range(3)], 1)).all() and (got[:, 2] == 1).all()
    assert edges[0] == pytest.approx(list(np.linspace(x[:, 0].min(), x[:, 0].max(), 8)[1:-1]))
    with pytest.raises(ValueError):
        discretize.fit(df, 3, 7, "other")
    with pytest.raises(ValueError, match="features"):
        discretize.fit(df, 4, 7)
    with pytest.raises(Exception, match="features"):
        discretize.encode(df, edges[:2]).collect()


@pytest.mark.parametrize("few", [0, 50, 10**6])
def test_order_statistics_are_exact(spark, few):
    """By refinement to the last bit, and with the last values fetched: ties, zeros of both signs, infinities, subnormals."""
    rng = np.random.default_rng(8)
    x = np.stack([rng.normal(size=400) * 10.0 ** rng.integers(-300, 300, 400), rng.integers(-3, 3, 400).astype(float), rng.choice([0.0, -0.0, 5e-324, -5e-324, 1e308, -np.inf, np.inf], 400)], 1)
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>").repartition(3)
    ranks = [0, 1, 57, 199, 200, 398, 399]
    got = discretize.order_statistics(df, [0, 1, 2], ranks, few)
    assert (got == np.sort(x, axis=0)[ranks].T).all()
    quart = discretize.fit(spark.createDataFrame([(i, [float(r[0])]) for i, r in enumerate(x)], "row_id long, x array<double>"), 1, 4)[0]
    assert quart == pytest.approx(sorted(set(np.percentile(x[:, 0], [25, 50, 75]).tolist())), rel=1e-12)


def test_groups():
    assert len(groups.groups(10, 3, 5000)) == 165
    a, b = groups.groups(60, 3, 500, 7), groups.groups(60, 3, 500, 7)
    assert a == b and len(a) == len(set(a)) == 500 and all(tuple(sorted(g)) == g for g in a)
    assert groups.groups(5, 1, 100) == groups.groups(1, 3, 100) == groups.groups(5, 3, 0) == []
    assert {len(g) for g in groups.groups(6, 3, 100, only_largest=True)} == {3}


@pytest.mark.parametrize("kind", ["binary", "soft", "fraction"])
def test_objective_is_monotone_and_submodular(kind):
    rng = np.random.default_rng(3)
    c = objective.Coverage({i: float(rng.random()) for i in range(8)}, {g: float(rng.random()) for g in groups.groups(8, 3, 20, 1)}, config.Settings().but(goal={"coverage": kind}))
    for _ in range(200):
        a = set(rng.choice(8, 3, replace=False).tolist())
        b = a | set(rng.choice(8, 2, replace=False).tolist())
        for v in set(range(8)) - b:
            assert c.value(a | {v}) >= c.value(a) - 1e-9
            assert c.value(a | {v}) - c.value(a) >= c.value(b | {v}) - c.value(b) - 1e-9
    p = objective.greedy(c, 3)
    assert p.values[-1] == pytest.approx(c.value(p.order)) and p.values[-1] <= objective.best_subset(c, 3)[1] + 1e-9
    assert p.values[-1] >= (1 - 1 / math.e) * objective.best_subset(c, 3)[1]
    assert objective.is_monotone(c) and objective.is_submodular(c) and 1 - 1 / math.e <= objective.greedy_ratio(c, 3) <= 1 + 1e-9
    c.mu[0] = -100.0
    assert not objective.is_monotone(c)


def test_greedy_first_pick_and_errors():
    c = objective.Coverage({0: 0.4, 1: 0.6, 2: 0.5}, {(0, 1): 1.0, (1, 2): 0.5})
    assert objective.greedy(c, 1).order == [1]
    with pytest.raises(ValueError):
        objective.gain_of("other")
    with pytest.raises(ValueError):
        objective.Coverage({0: 1.0}, {(0,): -1.0})


def test_strong_degrees_always_pass(spark):
    rng = np.random.default_rng(4)
    mu, nu = rng.random(12) / 2, rng.random(12) / 2
    v = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(mu, nu))], "feature_id int, mu double, nu double")
    e = spark.createDataFrame([(i, len(g), list(g)) for i, g in enumerate(groups.groups(12, 3, 80, 5))], "subset_id int, order int, members array<int>")
    s = rows(groups.audit_summary(groups.strong_audit(e.join(groups.strong_degrees(e, v), "subset_id"), v)))[0]
    assert s["pct_both"] == 100.0 and s["n_groups"] == 80
    # Degrees that are merely on the allowed side are not those of the members.
    lower = e.join(groups.strong_degrees(e, v), "subset_id").withColumn("mu", F.col("mu") - 0.01)
    s = rows(groups.audit_summary(groups.strong_audit(lower, v)))[0]
    assert s["pct_mu"] == 0.0 and s["pct_both"] == 0.0
    ok = rows(groups.valid_degrees(v.withColumn("pi", 1 - F.col("mu") - F.col("nu"))))[0]
    assert all(ok.values()) and not rows(groups.valid_degrees(v.withColumn("pi", F.lit(0.7))))[0]["sum_eq_1"]


def test_selection_finds_what_matters(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 12))
    y = (x[:, 3] + x[:, 7] > 0).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "row_id long, x array<double>, y int")
    s = config.Settings().but(goal={"select": 4}, groups={"most": 60})
    r = selector.fit(df, 12, s)
    assert {3, 7} & set(r.selected[:2]) and len(r.selected) == 4 and all(g["w"] >= 0 for g in r.groups)
    assert selector.fit(df, 12, s).selected == r.selected
    for name in ("strong_groups", "correlation_redundancy", "no_groups", "vertex_only", "miller_madow"):
        assert len(selector.fit(df, 12, config.ablation(name, s)).selected) == 4
    with pytest.raises(ValueError):
        selector.fit(df, 12, s.but(screen={"by": "other", "keep": 3}))


def test_screen_union_and_selectors(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, (400, 6))
    y = (x[:, 0] + (x[:, 1] > 1)) % 3
    df = coded(spark, x, y)
    best = rows(screening.top(screening.mi_scores(df, 6, 3), 2).orderBy("rank"))
    assert best[0]["feature_id"] == 0
    h = selectors.pair_table(df, 6, 3).cache()
    for name in ("mrmr", "cmim", "jmi_least", "fcbf"):
        out = selectors.run(name, h, 3)
        assert out.status == "OK" and out.selected[0] == 0
    assert selectors.run("sparse_autoencoder", h, 3).status == "UNAVAILABLE"


def test_stability_by_hand(spark):
    s = spark.createDataFrame([(0, [0, 1]), (1, [0, 2]), (2, [0, 1])], "run int, selected array<int>")
    got = {(r["run_a"], r["run_b"]): (r["jaccard"], r["kuncheva"]) for r in rows(stability.pairwise(s, 5))}
    assert got[0, 2] == (1.0, pytest.approx(1.0)) and got[0, 1] == (pytest.approx(1 / 3), pytest.approx((1 - 0.8) / (2 - 0.8)))
    p = np.array([1, 2 / 3, 1 / 3, 0, 0])
    assert rows(stability.nogueira(s, 5))[0]["nogueira"] == pytest.approx(1 - (p * (1 - p)).mean() / (0.4 * 0.6))
    assert [r["feature_id"] for r in rows(stability.consensus(s, 5, 2).orderBy("rank"))] == [0, 1]


def test_statistics(spark):
    assert statistics.signed_rank_p(0, 6) == pytest.approx(2 / 64) and statistics.signed_rank_p(10, 6) > 0.5 and statistics.signed_rank_p(0, 0) is None
    assert statistics.signed_rank_p(0, 1) is None and statistics.signed_rank_p(None, 0, 4) == 1.0
    assert statistics.signed_rank_p(1.5, 5, 5, 6) == pytest.approx(math.erfc(6 / math.sqrt((5 * 6 * 11 - 3) / 24) / math.sqrt(2)))
    assert statistics.chi2_tail(5.991, 2) == pytest.approx(0.05, abs=1e-4) and statistics.chi2_tail(0, 3) == 1.0
    m = spark.createDataFrame([("d1", "a", 0.9), ("d1", "b", 0.8), ("d2", "a", 0.7), ("d2", "b", None), ("d3", "a", 0.6), ("d3", "b", float("nan"))], "dataset string, method string, score double")
    r = rows(statistics.descriptives(statistics.mean_scores(m), "a"))[0]
    assert r["n_pairs"] == 1 and r["paired_datasets"] == "d1" and r["mean_difference"] == pytest.approx(0.1)
    p = spark.createDataFrame([("a", 0.01), ("b", None), ("c", 0.5)], "method string, p double")
    assert {r["method"]: r["p_holm"] for r in rows(statistics.holm(p))} == {"a": 0.02, "b": None, "c": 0.5}


def test_run_statistics(spark):
    rng = np.random.default_rng(1)
    score = {(d, m): float(rng.random()) for d in range(7) for m in "abc"}
    runs = [(f"d{d}", r, f"ours_{m}" if m == "a" else m, v + 0.01 * r) for (d, m), v in score.items() for r in range(2)] + [("d0", 0, "once", 0.5), ("d9", 0, "apart", 0.5)]
    t = statistics.run_statistics(spark.createDataFrame(runs, "dataset string, run int, method string, score double").filter("dataset <> 'd9'"), "ours_canonical")
    paired = {r["method"]: r for r in rows(t["paired"])}
    assert set(paired) == {"b", "c", "once"} and paired["once"]["n_pairs"] == 1 and paired["once"]["p_raw"] is None and paired["once"]["statistic"] is None and not paired["once"]["significant"]
    for m in "bc":
        diff = [score[d, "a"] - score[d, m] for d in range(7)]
        rank = {d: sum(abs(x) <= abs(diff[d]) + 1e-12 for x in diff) for d in range(7)}
        plus = sum(rank[d] for d in range(7) if diff[d] > 0)
        stat = min(plus, 28 - plus)
        p = min(1.0, 2 * sum(sum(i + 1 for i in range(7) if k >> i & 1) <= stat for k in range(128)) / 128)
        assert paired[m]["statistic"] == stat and paired[m]["p_raw"] == pytest.approx(p) and paired[m]["rank_biserial"] == pytest.approx((2 * plus - 28) / 28)
    ps = sorted(paired[m]["p_raw"] for m in "bc")
    assert sorted(paired[m]["p_holm"] for m in "bc") == pytest.approx([min(1, 2 * ps[0]), max(min(1, 2 * ps[0]), ps[1])])
    assert [r["complete_case_methods"] for r in rows(t["friedman"])] == ["b;c;ours_a"] and 0 <= rows(t["friedman"])[0]["p_value"] <= 1
    assert sum(r["average_rank"] for r in rows(t["ranks"])) == pytest.approx(6)
    with pytest.raises(ValueError):
        statistics.run_statistics(spark.createDataFrame(runs, "dataset string, run int, method string, score double"), "theirs")


def test_validations(spark):
    raw = spark.createDataFrame([("d", "m", 0.9, 5, 10, 0.5), ("d", "m", 0.7, 5, 10, 0.5)], "dataset string, method string, accuracy double, n_selected int, d int, feature_reduction double")
    good = reporting.run_validations(raw, reporting.summarize(raw, ["dataset", "method"], ["accuracy"]))
    assert {r["status"] for r in rows(good)} == {"PASS"} and good.count() == 6
    reporting.assert_ok(good)
    bad = raw.withColumn("accuracy", F.col("accuracy") * 100).withColumn("percent_mean", F.lit(95.45)).withColumn("percent_sd", F.lit(0.0552))
    with pytest.raises(AssertionError, match="accuracy_in_range, no_mixed_units"):
        reporting.assert_ok(reporting.run_validations(bad))
    with pytest.raises(AssertionError):
        reporting.assert_ok(reporting.run_validations(raw.drop("accuracy")))
    one = spark.range(1).select(reporting.percent_units(F.lit(95.0), F.lit(5.0), F.lit(0.95), F.lit(0.05)).alias("a"), reporting.percent_units(F.lit(95.0), F.lit(0.05), F.lit(0.95), F.lit(0.05)).alias("b"), reporting.rounds_fairly(F.lit(99.999), F.lit(0.001)).alias("c"), reporting.rounds_fairly(F.lit(99.9), F.lit(0.1)).alias("d"), reporting.mean_sd(F.lit(0.5), F.lit(0.001)).alias("e"), reporting.mean_sd(F.lit(0.5), F.lit(0.25)).alias("f")).first()
    assert tuple(one) == (True, False, False, True, "0.5000 ± 0.0010", "0.50 ± 0.25")
    per_seed = spark.createDataFrame([("x", 400, s, 1.0, 0.5) for s in range(5)] + [("y", 300, s, 0.0, 0.25) for s in range(4)], "scenario string, n int, seed int, recall double, f1 double")
    summary = reporting.scenario_summary(per_seed, ["scenario", "n"], "seed", ["recall", "f1"])
    assert {(r["scenario"], r["n"], r["n_seeds"]) for r in rows(summary)} == {("x", 400, 5), ("y", 300, 4)}
    check = lambda t: {r["name"]: r["ok"] for r in rows(reporting.check_seeds(per_seed, t, ["scenario", "n"], "seed", ["recall", "f1"]))}
    assert all(check(summary).values())
    assert not check(summary.unionByName(summary))["keys_unique"] and not check(summary.filter("n = 300"))["keys_match"] and not check(summary.withColumn("recall_mean", F.lit(0.3)))["recall_reproduces"]
    front = spark.createDataFrame([("d", 5, 0.9), ("d", 5, 0.8), ("d", 3, 0.9), ("d", 2, 0.5), ("d", 1, 0.5), ("e", 9, 0.1), ("e", 9, 0.1)], "k string, n int, a double")
    assert sorted((r["k"], r["n"], r["a"]) for r in rows(reporting.pareto(front, "k", "n", "a")) if r["is_frontier"]) == [("d", 1, 0.5), ("d", 3, 0.9), ("e", 9, 0.1), ("e", 9, 0.1)]


def test_synthetic_data(spark):
    for name in synthetic.NAMES:
        s = synthetic.generate(spark, name, 2000, 3, noise=5)
        again = synthetic.generate(spark, name, 2000, 3, noise=5).rows.repartition(7)
        got = {r["row_id"]: (tuple(r["x"]), r["y"]) for r in s.rows.collect()}
        assert got == {r["row_id"]: (tuple(r["x"]), r["y"]) for r in again.collect()} and {len(x) for x, _ in got.values()} == {s.d}
        x, y = np.array([v[0] for v in got.values()]), np.array([v[1] for v in got.values()])
        assert 0.3 < y.mean() < 0.7 and set(s.interaction) <= set(s.support)
        if name in ("xor2", "parity3"):
            assert (np.bitwise_xor.reduce(np.round(x[:, list(s.support)]).astype(int), axis=1) == y).all()
            assert all(information.marginal_association(s.rows, j) < 0.02 for j in s.support)
        elif name == "correlated_noise":
            assert np.corrcoef(x[:, 4], x[:, 5])[0, 1] == pytest.approx(0.8, abs=0.05)
        elif name == "main_effect":
            assert all(np.corrcoef(x[:, j], y)[0, 1] > 0.2 for j in s.support) and abs(np.corrcoef(x[:, 6], y)[0, 1]) < 0.1
    t = rows(synthetic.interaction_example(spark.range(40).withColumnRenamed("id", "row_id")))
    assert len(t) == 40 and all(r["y_xor"] == r["x1_binary"] ^ r["x2_binary"] and r["x3_noisy_sum"] in (0, 1) for r in t)
    with pytest.raises(ValueError):
        synthetic.generate(spark, "other", 10, 0)


def test_relieff_sees_interactions(spark):
    s = synthetic.generate(spark, "xor2", 240, 1, noise=4)
    best = [r["feature_id"] for r in rows(screening.top(screening.relieff_scores(s.rows, s.d), 2))]
    assert sorted(best) == [0, 1]
    picked = rows(screening.union(screening.mi_scores(discretize.encode(s.rows, discretize.fit(s.rows, s.d)), s.d, 11), screening.relieff_scores(s.rows, s.d), 4))
    assert {0, 1} <= {r["feature_id"] for r in picked}


def test_study(spark, tmp_path):
    data = synthetic.generate(spark, "main_effect", 160, 2, noise=8)
    study = workflows.Study(spark, f"file://{tmp_path}/study", {"one": (data.rows, data.d)}, config.Settings().but(screen={"keep": 5}, groups={"largest": 2}), runs=1, classifier="nearest")
    t = study.equal_budget(("canonical", "mrmr", "no_such_method"))
    assert {(r["method"], r["budget"]) for r in rows(t)} == {("canonical", 10), ("mrmr", 10)}
    assert [(r["section"], r["where"]) for r in rows(study.table("failures"))] == [("equal_budget", "one/0/no_such_method")]
    before = sorted(map(str, t.collect()))
    assert sorted(map(str, study.equal_budget(("canonical", "mrmr")).collect())) == before  # nothing is done twice
    assert study.budget_rows().count() == 2 and study.accuracy_by_cardinality().filter("is_frontier").count() >= 1
    assert {r["status"] for v in study.validate().values() for r in rows(v)} == {"PASS"}
    assert {r["variant"] for r in rows(study.ablation(("full", "vertex_only")))} == {"full", "vertex_only"}
    assert [r["method"] for r in rows(study.native_cardinality())] == ["fcbf"]
    study.synthetic(("main_effect",), (80,), (4,), ("canonical",), 2)
    summary, checks = study.synthetic_summary()
    assert rows(summary)[0]["n_seeds"] == 2 and all(r["ok"] for r in rows(checks))
    assert {r["status"] for r in rows(study.runtime((12,), (2,)))} == {"OK"}
    big = workflows.Study(spark, f"file://{tmp_path}/big", {"wide": (data.rows, 1300)}, runs=1)
    assert "INFEASIBLE" in rows(big.ablation(("screen_none",)))[0]["error"]


def test_evaluation_records(spark):
    data = synthetic.generate(spark, "main_effect", 120, 5, noise=2)
    v = tables.stratified(data.rows, 1)
    train, test = v.filter("not is_test"), v.filter("is_test")
    got = {r["classifier"]: r for r in evaluation.evaluate_all(train, test, [0, 1, 2, 3], ("nearest", "logistic"))}
    assert set(got) == {"nearest", "logistic"} and all(r["error"] is None and r["accuracy"] > 0.6 for r in got.values()), got
    assert evaluation.evaluate(train, test, [])["accuracy"] == 0.0
    assert evaluation.evaluate(train, test, [0], "other")["accuracy"] is None and "unknown classifier" in evaluation.evaluate(train, test, [0], "other")["error"]


def test_reports(spark):
    ok = spark.createDataFrame([("x", 0.9, 5, 10, 0.5), ("y", 0.8, 2, 10, 0.8)], "method string, accuracy double, n_selected int, d int, feature_reduction double")
    assert all(r["ok"] for r in rows(reporting.checks(ok)))
    bad = ok.unionByName(spark.createDataFrame([("z", 90.0, 5, 10, 0.4)], ok.schema))
    assert {r["name"] for r in rows(reporting.checks(bad)) if not r["ok"]} == {"accuracy_in_range", "reduction_adds_up"}
    assert reporting.gate(True, 0) == "READY" and reporting.gate(True, 1) == reporting.gate(False, 0) == "BLOCKED"
    r = rows(reporting.recovery(spark.createDataFrame([([0, 5, 6], [0, 1])], "s array<int>, t array<int>"), "s", "t"))[0]
    assert r["precision"] == pytest.approx(1 / 3) and r["recall"] == 0.5 and not r["all_selected"]
    log = spark.createDataFrame([(1, "resolved"), (2, None), (3, None)], "id int, status string")
    assert {r["id"]: r["status"] for r in rows(reporting.failure_status(log, log["id"] == 3))} == {1: "resolved", 2: "active", 3: "resolved"}


def test_sources(spark, tmp_path):
    (tmp_path / "t_X.csv").write_text("1,2\n3,4\n5,6\n")
    (tmp_path / "t_Y.csv").write_text("b\na\nb\n")
    got = rows(tables.matrix_csv(spark, str(tmp_path / "t"), 2))
    assert sorted((r["row_id"], tuple(r["x"]), r["y"]) for r in got) == [(0, (1.0, 2.0), 0), (2, (5.0, 6.0), 0)]
    assert tables.read_or_none(spark, str(tmp_path / "none")) is None
    (tmp_path / "long_X.csv").write_text("".join(f"{i},{-i}\n" for i in range(5000)))
    (tmp_path / "long_Y.csv").write_text("".join(f"{i % 2}\n" for i in range(5000)))
    assert all(r["x"] == [r["row_id"], -r["row_id"]] and r["y"] == r["row_id"] % 2 for r in rows(tables.matrix_csv(spark, str(tmp_path / "long"))))
    for name, x, y in (("short", "1,2\n3\n", "a\na\n"), ("text", "1,2\n3,b\n", "a\na\n"), ("more", "1,2\n", "a\na\n")):
        (tmp_path / f"{name}_X.csv").write_text(x)
        (tmp_path / f"{name}_Y.csv").write_text(y)
        with pytest.raises(Exception, match="values|CAST|cast|different numbers"):
            tables.matrix_csv(spark, str(tmp_path / name), 2).collect()
    assert tables.datasets(spark, str(tmp_path)) == ["long", "more", "short", "t", "text"] and tables.datasets(spark, str(tmp_path), "t, long") == ["t", "long"]
    with pytest.raises(ValueError):
        tables.datasets(spark, str(tmp_path), "none")
    df, facts = tables.dataset(spark, str(tmp_path), "t")
    assert {k: v for k, v in rows(facts)[0].items() if k != "dataset"} == {"original_rows": 3, "original_labels": {"a": 1, "b": 2}, "rows": 2, "features": 2, "labels": {0: 2}, "removed_rows": 1}
    record = tables.split_record(tables.stratified(tables.matrix_csv(spark, str(tmp_path / "long")), 5), "long", 0, 5)
    tables.save_splits(record, str(tmp_path / "splits"))
    back = rows(tables.load_splits(spark, str(tmp_path / "splits")))
    assert back == rows(record) and len(back[0]["test"]) == 1250 and back[0]["test"] == sorted(back[0]["test"])
    table = str(tmp_path / "results")
    first = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string")
    assert tables.append_rows(first, table, ["k"], F.col("v")) == 2 and tables.append_rows(first.withColumn("k", F.col("k") + 1), table, ["k"], F.col("v")) == 1
    assert tables.existing_keys(spark, table, ["k"]) == {("1",), ("2",), ("3",)}
    frozen = tmp_path / "frozen"
    frozen.mkdir()
    (frozen / "a.txt").write_text("one")
    assert tables.create_freeze(spark, str(frozen), str(tmp_path / "store")) == 1 and rows(tables.verify_freeze(spark, str(frozen), str(tmp_path / "store"))) == [{"status": "UNCHANGED", "n": 1}]
    (frozen / "a.txt").write_text("two")
    (frozen / "b.txt").write_text("new")
    with pytest.raises(ValueError, match="1 ADDED, 1 CHANGED"):
        tables.verify_freeze(spark, str(frozen), str(tmp_path / "store"))
    stored = spark.createDataFrame([("1", "x")], "k string, v string")
    batch = spark.createDataFrame([(1, "y", 0), (2, "z", 1), (2, "w", 2)], "k int, v string, at int")
    assert [(r["k"], r["v"]) for r in rows(tables.append_new(stored, batch, ["k"], batch["at"]))] == [(2, "z")]
    with pytest.raises(Exception, match="NaN"):
        tables.no_nan(spark.createDataFrame([([1.0, float("nan")],)], "x array<double>")).collect()


def test_nearest_takes_any_number_of_training_rows(spark):
    train = spark.range(100_001).selectExpr("id AS row_id", "CAST(id % 3 AS INT) AS y", "array(CAST(id AS DOUBLE)) AS x")
    test = spark.createDataFrame([(1, 0, [50_000.0]), (2, 1, [100_000.0])], "row_id long, y int, x array<double>")
    want = {i: sorted(collections.Counter(j % 3 for j in sorted(range(100_001), key=lambda j: (abs(j - v), j))[:5]).items(), key=lambda c: (-c[1], c[0]))[0][0] for i, v in ((1, 50_000), (2, 100_000))}
    assert {r["row_id"]: r["pred"] for r in rows(evaluation.nearest(train, test, [0]))} == want
