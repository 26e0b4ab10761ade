"""Feature groups (hyperedges), their degrees and weights."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.expressions import EPS, fuzzy, mapped


def group_counts(f: int, largest: int) -> dict[int, int]:
    return {k: math.comb(f, k) if k <= f else 0 for k in range(2, max(2, largest) + 1)}


def _draws(f: int, k: int, n: int, rng: np.random.Generator, tries: int) -> list[tuple[int, ...]]:
    """Up to n different groups of k out of f features, in order."""
    found: dict[tuple[int, ...], None] = {}
    while tries and len(found) < n:
        found[tuple(sorted(int(v) for v in rng.choice(f, size=k, replace=False)))] = None
        tries -= 1
    return sorted(found)


def groups(f: int, largest: int, most: int, seed: int = 42, only_largest: bool = False) -> list[tuple[int, ...]]:
    """All groups of an order if its share of the budget holds them, else a seeded sample without repeats."""
    orders = range(largest if only_largest else 2, min(largest, f) + 1) if largest >= 2 and most > 0 else ()
    share, rng = max(1, most // max(1, len(orders))), np.random.default_rng(seed)
    every = (list(itertools.combinations(range(f), k)) if math.comb(f, k) <= share else _draws(f, k, share, rng, 20 * share) for k in orders)
    return list(itertools.islice(itertools.chain.from_iterable(every), most))


def vertex_degrees(relevance: DataFrame, redundancy: DataFrame, s: Settings = Settings()) -> DataFrame:
    """feature_id, relevance, redundancy, mu, nu, pi. relevance, redundancy: feature_id and the value."""
    v = relevance.join(redundancy, "feature_id")
    against = F.col("redundancy") if s.maps.against else F.lit(0.0)
    mu, nu, pi = fuzzy(mapped(F.col("relevance"), s.maps.kind, *s.maps.feature[0]), mapped(against, s.maps.kind, *s.maps.feature[1]))
    return v.withColumn("mu", mu).withColumn("nu", nu).withColumn("pi", pi)


def independent_degrees(evidence: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds mu, nu, pi from a group's own nmi and redundancy."""
    against = F.col("redundancy") if s.maps.against else F.lit(0.0)
    mu, nu, pi = fuzzy(mapped(F.col("nmi"), s.maps.kind, *s.maps.group[0]), mapped(against, s.maps.kind, *s.maps.group[1]))
    return evidence.withColumn("mu", mu).withColumn("nu", nu).withColumn("pi", pi)


def strong_degrees(members: DataFrame, vertices: DataFrame) -> DataFrame:
    """subset_id, mu, nu, pi: the least membership and the largest non-membership of the members, cut to sum 1."""
    e = members.select("subset_id", F.explode("members").alias("feature_id")).join(vertices.select("feature_id", "mu", "nu"), "feature_id").groupBy("subset_id").agg(F.min("mu").alias("mu"), F.max("nu").alias("nu"))
    nu = F.when(F.col("mu") + F.col("nu") > 1, F.greatest(F.lit(0.0), 1 - F.col("mu"))).otherwise(F.col("nu"))
    return e.withColumn("nu", nu).withColumn("pi", 1 - F.col("mu") - F.col("nu"))


def strong_audit(own: DataFrame, vertices: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """For each group how far its own degrees are from those its members give; ok: equal within the tolerance."""
    e = own.select("subset_id", F.explode("members").alias("feature_id")).join(vertices.select("feature_id", F.col("mu").alias("vm"), F.col("nu").alias("vn")), "feature_id")
    e = e.groupBy("subset_id").agg(F.min("vm").alias("mu_strong"), F.max("vn").alias("nu_strong"))
    a = own.select("subset_id", "members", "order", F.col("mu").alias("mu_own"), F.col("nu").alias("nu_own"), F.col("pi").alias("pi_own")).join(e, "subset_id")
    a = a.withColumn("pi_strong", 1 - F.col("mu_strong") - F.col("nu_strong")).withColumn("abs_mu", F.abs(F.col("mu_own") - F.col("mu_strong"))).withColumn("abs_nu", F.abs(F.col("nu_own") - F.col("nu_strong")))
    a = a.withColumn("rel_mu", F.col("abs_mu") / (F.abs("mu_strong") + EPS)).withColumn("rel_nu", F.col("abs_nu") / (F.abs("nu_strong") + EPS))
    return a.withColumn("ok_mu", F.col("abs_mu") <= tolerance).withColumn("ok_nu", F.col("abs_nu") <= tolerance).withColumn("ok", F.col("ok_mu") & F.col("ok_nu"))


def audit_by_largest(audit: DataFrame, largest: list[int]) -> DataFrame:
    """The rows of an audit for each bound on the size of groups: adds largest; a group counts for every bound that it keeps."""
    bounds = F.array(*[F.lit(k) for k in largest])
    return audit.withColumn("largest", F.explode(F.filter(bounds, lambda k: F.col("order") <= k)))


def assert_strong(audit: DataFrame) -> int:
    """How many groups were audited; raises if any does not have the degrees that its members give."""
    r = audit.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("bad"), F.min(F.when(~F.coalesce("ok", F.lit(False)), F.col("members"))).alias("one")).first()
    if r["bad"]:
        raise ValueError(f"{r['bad']} of {r['n']} groups do not satisfy the strong relation, {list(r['one'])} among them")
    return r["n"]


def audit_summary(audit: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    share = lambda c: (100.0 * F.sum(F.col(c).cast("int")) / F.count(F.lit(1)))
    return audit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_groups"), share("ok_mu").alias("pct_mu"), share("ok_nu").alias("pct_nu"), share("ok").alias("pct_both"), *[f(c).alias(f"{n}_{c}") for n, f in (("mean", F.avg), ("max", F.max)) for c in ("abs_mu", "abs_nu")], *[F.avg(c).alias(f"mean_{c}") for c in ("rel_mu", "rel_nu")])


def weights(degrees: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds w: membership less the penalty times non-membership, not below 0, lowered by hesitation."""
    w = F.greatest(F.lit(0.0), F.col("mu") - s.groups.penalty * F.col("nu"))
    return degrees.withColumn("w", w * (1 - F.col("pi")) if s.groups.hesitation else w)


def valid_degrees(degrees: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row: whether mu, nu and pi are non-negative, mu + nu is at most 1, and all three add up to 1, in every row."""
    mu, nu, pi = F.col("mu"), F.col("nu"), F.col("pi")
    rules = {"mu_ge_0": mu >= -tolerance, "nu_ge_0": nu >= -tolerance, "pi_ge_0": pi >= -tolerance, "mu_nu_le_1": mu + nu <= 1 + tolerance, "sum_eq_1": F.abs(mu + nu + pi - 1) <= tolerance}
    return degrees.agg(*[F.coalesce(F.bool_and(F.coalesce(rule, F.lit(False))), F.lit(True)).alias(name) for name, rule in rules.items()])
