"""The strong relation over datasets and sizes of groups, classes of files, framed phrases, split records in parts."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetmill import config
from facetmill.operators import groups
from facetmill.plans import selector, workflows
from facetmill.sources import synthetic, tables


def rows(df):
    return [r.asDict() for r in df.collect()]


def degrees(seed, n=20):
    rng = np.random.default_rng(seed)
    mu, nu = rng.random(n), rng.random(n)
    scale = np.maximum(1.0, mu + nu)
    edges = sorted({tuple(sorted(int(v) for v in rng.choice(n, size=int(rng.integers(2, 6)), replace=False))) for _ in range(60)})
    return mu / scale, nu / scale, edges


def test_induced_degrees_are_strong_and_others_raise(spark):
    for seed in (0, 1):
        mu, nu, edges = degrees(seed)
        vertices = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(mu, nu))], "feature_id int, mu double, nu double")
        members = spark.createDataFrame([(i, list(e), len(e)) for i, e in enumerate(edges)], "subset_id long, members array<int>, order int")
        own = groups.strong_degrees(members, vertices).join(members, "subset_id")
        audit = groups.strong_audit(own, vertices, 1e-12)
        assert groups.assert_strong(audit) == len(edges)
        off = own.withColumn("mu", F.when(F.col("subset_id") == 3, F.col("mu") + 0.01).otherwise(F.col("mu")))
        with pytest.raises(ValueError, match="1 of .* strong relation"):
            groups.assert_strong(groups.strong_audit(off, vertices, 1e-12))
        # Each bound counts the groups within it.
        got = {r["largest"]: r for r in rows(groups.audit_summary(groups.audit_by_largest(audit, [2, 4, 9]), ("largest",)))}
        assert {k: r["n_groups"] for k, r in got.items()} == {k: sum(len(e) <= k for e in edges) for k in (2, 4, 9)} and all(r["pct_both"] == 100.0 for r in got.values())
    assert groups.assert_strong(audit.limit(0)) == 0


def test_a_study_audits_every_dataset_and_size(spark, tmp_path):
    one, two = (synthetic.generate(spark, "main_effect", 150, seed, noise=6) for seed in (1, 2))
    settings = config.Settings().but(screen={"keep": 6})
    study = workflows.Study(spark, f"file://{tmp_path}/study", {"one": (one.rows, one.d), "two": (two.rows, two.d), "broken": (one.rows.withColumn("x", F.lit(None).cast("array<double>")), one.d)}, settings, runs=1)
    got = {(r["dataset"], r["largest"]): r for r in rows(study.strong_relation((2, 3), 20))}
    assert set(got) == {(n, k) for n in ("one", "two") for k in (2, 3)}
    assert {(k, r["n_groups"], r["sampled"]) for (_, k), r in got.items()} == {(2, 15, False), (3, 20, True)}
    assert {r["where"] for r in rows(study.table("failures"))} == {"broken/2", "broken/3"}
    single = rows(study.table("strong_groups"))
    assert len(single) == 70
    # By force from the degrees of a selection on the same rows.
    r = selector.fit(study.split("two", 0)[0], two.d, settings.but(groups={"largest": 3, "most": 20}))
    mu, nu = {v["feature_id"]: v["mu"] for v in r.vertices}, {v["feature_id"]: v["nu"] for v in r.vertices}
    want = {";".join(str(r.screened[v]) for v in g["members"]): (abs(g["mu"] - min(mu[v] for v in g["members"])), abs(g["nu"] - max(nu[v] for v in g["members"]))) for g in r.groups}
    own = {x["members"]: (x["abs_mu"], x["abs_nu"]) for x in single if x["dataset"] == "two" and x["largest"] == 3}
    assert set(own) == set(want) and all(np.allclose(own[m], want[m], atol=1e-12) for m in want)
    assert got["two", 3]["mean_abs_mu"] == pytest.approx(np.mean([v[0] for v in want.values()])) and got["two", 3]["max_abs_nu"] == pytest.approx(max(v[1] for v in want.values()))
    assert got["two", 3]["pct_both"] == pytest.approx(100 * np.mean([max(v) <= 1e-9 for v in want.values()]))
    strict = workflows.Study(spark, f"file://{tmp_path}/strict", {"one": (one.rows, one.d)}, settings.but(groups={"degrees": "strict_strong"}), runs=1)
    assert [r["pct_both"] for r in rows(strict.strong_relation((3,), 20))] == [100.0]


def test_lineage_takes_the_first_rule_for_each_column(spark):
    names = ["s3://b/Out/01_main/a.csv", "s3://b/Out/00_config/p.csv", "s3://b/Out/top.md", "s3://b/Out/02_tests/x/run.py", None, ""]
    rules = [("^00_config/", {"status": "metadata", "origin": "configuration"}), ("[.]py$", {"origin": "code"}), ("^0[1-9]", {"status": "unverified", "origin": "derived"})]
    got = rows(tables.lineage(spark.createDataFrame([(n,) for n in names], "path string"), rules, ("status", "origin"), root="s3://b/Out/"))
    want = []
    for n in names:
        below = re.sub("^s3://b/Out/", "", n or "")
        says = {c: next((r[c] for p, r in rules if c in r and n is not None and re.search(p, below)), "unknown") for c in ("status", "origin")}
        want.append({"path": n, "artifact_group": below.split("/")[0] if "/" in below else "", **says})
    assert got == want


def test_framed_phrases_are_no_hits(spark):
    docs = spark.createDataFrame([
        (1, "report", "took 0.1 s\nthe legacy 0.1 s claim\nfailed tables: 3"),
        (2, "failure_log_1", "failed tables: 3\nran 0.1 s"),
        (3, None, "failed tables: 4\n"),
        (4, "report", None),
        (5, "report", ""),
    ], "id int, name string, text string")
    patterns = {"runtime": r"0\.1\s*s\b", "failure": "failed tables:\\s*[1-9]"}
    log = F.col("name").startswith("failure_log")
    got = {(r["id"], r["pattern"], r["line"]) for r in rows(tables.scan_text(docs, "id", "text", patterns, unless={"runtime": "(?i)legacy|supersed"}, history={"failure": log}))}
    assert got == {(1, "runtime", 1), (1, "failure", 3), (2, "runtime", 2), (3, "failure", 1)}
    assert tables.scan_text(docs, "id", "text", patterns).count() == 6


def test_split_records_grow_in_rows_not_in_their_size(spark, tmp_path):
    v = tables.stratified(spark.range(1000).selectExpr("id AS row_id", "CAST(id % 3 AS INT) AS y"), 7).cache()
    record = tables.split_record(v, "d", 2, 7, per_row=100)
    tables.save_splits(record, str(tmp_path / "s"))
    back = tables.load_splits(spark, str(tmp_path / "s"))
    assert back.count() == 10 and max(len(r["train"]) + len(r["test"]) for r in back.collect()) < 200
    again = tables.apply_split(v.drop("is_test"), back, "d", 2)
    assert sorted((r["row_id"], r["is_test"]) for r in again.collect()) == sorted((r["row_id"], r["is_test"]) for r in v.collect())
    assert tables.apply_split(v.drop("is_test"), back, "d", 3).count() == 0 and tables.split_record(v.limit(0), "d", 2, 7).count() == 0
