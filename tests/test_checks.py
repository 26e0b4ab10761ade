"""Sampled checks of the objective, complete cases, digests of files of any size."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from facetmill.config import Settings
from facetmill.operators import objective, statistics
from facetmill.sources import tables


def big(kind="binary"):
    rng = random.Random(3)
    mu = {v: rng.random() for v in range(300)}
    groups = {tuple(sorted(rng.sample(range(300), k))): rng.random() for k in (2, 3) for _ in range(400)}
    return objective.Coverage(mu, groups, Settings().but(goal={"coverage": kind}))


@pytest.mark.parametrize("kind", ["binary", "soft", "fraction"])
def test_large_objectives_pass(spark, kind):
    r = objective.sampled_checks(spark, big(kind), 300).first()
    assert r["trials"] > 280 and (r["not_monotone"], r["not_submodular"]) == (0, 0) and r["excess"] < 1e-9


def test_planted_faults_are_found(spark):
    c = big()
    c.mu[17] = -5.0
    r = objective.sampled_checks(spark, c, 4000).first()
    assert r["not_monotone"] > 0 and r["not_submodular"] == 0 and r["excess"] > 1
    c = big()
    c.groups |= {e: -9.0 for e in itertools.islice(itertools.combinations(range(0, 300, 3), 2), 4000)}  # set after the check of weights
    r = objective.sampled_checks(spark, c, 300).first()
    assert r["not_submodular"] > 0
    assert tuple(objective.sampled_checks(spark, c, 300).first()) == tuple(r)  # seeded


def test_trials_by_force(spark):
    """Counts of small cases agree with the objective's own values on every nested pair of sets."""
    mu = {0: 0.2, 1: 0.4, 2: 0.1, 3: -0.3}
    c = objective.Coverage(mu, {(0, 1): 0.5, (1, 2, 3): 0.7})
    r = objective.sampled_checks(spark, c, 3000).first()
    worst = max(c.value(b) - c.value((*b, v)) for k in range(4) for b in itertools.combinations(range(4), k) for v in range(4) if v not in b)
    assert r["excess"] == pytest.approx(worst) and r["not_submodular"] == 0


def test_complete_cases(spark):
    rows = [("d1", "a", 1.0), ("d1", "b", 2.0), ("d1", "c", None), ("d2", "a", 3.0), ("d2", "b", float("nan")), ("d2", "c", None), ("d3", "a", 5.0), ("d3", "b", 6.0), ("d3", "x.y", 1.0), ("d1", "x.y", 2.0), ("d2", "x.y", 3.0)]
    w = statistics.wide(spark.createDataFrame(rows, "dataset string, method string, score double"))
    assert w.columns == ["dataset", "a", "b", "x.y"] and {tuple(r) for r in w.collect()} == {("d1", 1.0, 2.0, 2.0), ("d3", 5.0, 6.0, 1.0)}
    assert statistics.wide(spark.createDataFrame([("d", "a", None)], "dataset string, method string, score double")).columns == ["dataset"]


def test_files_are_streamed(spark, tmp_path):
    rng = np.random.default_rng(0)
    files = {f"a b{i}.bin": rng.bytes(n) for i, n in enumerate([0, 1, 999, 5000])}
    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1].replace("%20", " "): (r["sha256"], r["size"]) for r in tables.file_manifest(spark, str(tmp_path), chunk=100).collect()}
    assert got == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in files.items()}


def test_file_above_two_gigabytes(spark, tmp_path):
    path = tmp_path / "large.bin"
    with open(path, "wb") as f:
        f.truncate(2_200_000_000)  # no blocks on disk
    r = tables.file_manifest(spark, str(tmp_path)).first()
    digest = hashlib.sha256()
    for _ in range(2200):
        digest.update(bytes(1_000_000))
    assert (r["sha256"], r["size"]) == (digest.hexdigest(), 2_200_000_000)
