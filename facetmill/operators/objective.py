"""The coverage objective F(S) = alpha * sum of mu + beta * sum of w * g(|S and group|, |group|), and greedy selection.

Its state is metadata: at most screen_most features and max_groups groups, whatever the number of rows.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.expressions import coverage


def gain_of(kind: str, rho: float = 0.5):
    """g(k, size) as a Python function."""
    if kind == "binary" or (kind == "soft" and rho <= 0):
        return lambda k, size: 1.0 if k >= 1 else 0.0
    if kind == "soft":
        return lambda k, size: 1 - (1 - rho) ** k
    if kind == "fraction":
        return lambda k, size: min(k / size, 1.0)
    raise ValueError(f"unknown coverage {kind!r}")


@dataclass
class Coverage:
    mu: dict[int, float]
    groups: dict[tuple[int, ...], float]
    settings: Settings = field(default_factory=Settings)

    def __post_init__(self):
        if any(w < 0 for w in self.groups.values()):
            raise ValueError("group weights must not be negative")
        self.g = gain_of(self.settings.goal.coverage, self.settings.goal.rho)
        self.positive = [(e, w) for e, w in self.groups.items() if w > 0]
        self.touching: dict[int, list[int]] = {v: [] for v in self.mu}
        for i, (e, _) in enumerate(self.positive):
            for v in e:
                self.touching[v].append(i)

    def value(self, chosen) -> float:
        s = set(chosen)
        return self.settings.goal.features * sum(self.mu[v] for v in s) + self.settings.goal.groups * sum(w * self.g(len(s.intersection(e)), len(e)) for e, w in self.positive)

    def gain(self, v: int, covered: list[int]) -> float:
        add = sum(self.positive[i][1] * (self.g(covered[i] + 1, len(self.positive[i][0])) - self.g(covered[i], len(self.positive[i][0]))) for i in self.touching[v])
        return self.settings.goal.features * self.mu[v] + self.settings.goal.groups * add


@dataclass
class Path:
    order: list[int]
    gains: list[float]
    values: list[float]

    @property
    def efficiency(self) -> list[float]:
        return [v / (i + 1) for i, v in enumerate(self.values)]


def greedy(c: Coverage, budget: int, stop: bool = True, digits: int = 12) -> Path:
    """Largest marginal gain first (ties by id); ends where no gain is positive."""
    left, covered, path, total = set(c.mu), [0] * len(c.positive), Path([], [], []), 0.0
    while left and len(path.order) < budget:
        gain, v = max(((round(c.gain(v, covered), digits), -v) for v in left))
        v = -v
        if stop and gain <= 0:
            break
        gain = c.gain(v, covered)
        for i in c.touching[v]:
            covered[i] += 1
        left.remove(v)
        total += gain
        path.order.append(v)
        path.gains.append(gain)
        path.values.append(total)
    return path


def sampled_checks(spark: SparkSession, c: Coverage, trials: int = 1000, seed: int = 42, tolerance: float = 1e-9) -> DataFrame:
    """One row: trials, and of random nested sets A in B and a feature v outside B how often the gain of v is negative
    (not_monotone), or larger for B than for A (not_submodular); with the largest such excess.

    For any number of features: a feature is in B, and then in A, by hashes of seed, trial and feature; v is the feature with
    the smallest hash of those outside. One aggregation over trials and groups counts how far sets cover each group.
    """
    goal, features = c.settings.goal, sorted(c.mu)
    draw = lambda what: F.pmod(F.xxhash64(F.lit(f"{seed}|{what}"), "trial", "f"), F.lit(1 << 20)) / float(1 << 20)
    vertices = spark.createDataFrame([(v, float(c.mu[v])) for v in features], "f long, mu double")
    rows = spark.range(trials).withColumnRenamed("id", "trial").crossJoin(F.broadcast(vertices))  # features of the screen
    share = F.pmod(F.xxhash64(F.lit(f"{seed}|share"), "trial"), F.lit(100)) / 100.0  # sets of all sizes
    rows = rows.withColumn("in_b", draw("b") < share).withColumn("in_a", F.col("in_b") & (draw("a") < 0.5))
    outside = rows.filter("not in_b").groupBy("trial").agg(F.min_by("f", draw("v")).alias("v"), F.min_by("mu", draw("v")).alias("v_mu"))
    rows = rows.join(outside, "trial")
    members = spark.createDataFrame([(g, float(w), len(e), v) for g, (e, w) in enumerate(c.groups.items()) for v in e] or [(None, 0.0, 1, None)], "g int, w double, size int, f long")
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    met = rows.join(members, "f").groupBy("trial", "g", "w", "size").agg(count(F.col("in_a")).alias("a"), count(F.col("in_b")).alias("b"), count(F.col("f") == F.col("v")).alias("hit")).filter("hit > 0")
    step = lambda k: F.col("w") * (coverage(F.col(k) + 1, F.col("size"), goal.coverage, goal.rho) - coverage(F.col(k), F.col("size"), goal.coverage, goal.rho))
    add = met.groupBy("trial").agg(F.sum(step("a")).alias("ga"), F.sum(step("b")).alias("gb"))
    gain = lambda k: goal.features * F.col("v_mu") + goal.groups * F.coalesce(F.col(k), F.lit(0.0))
    g = outside.join(add, "trial", "left").select(gain("ga").alias("a"), gain("gb").alias("b"))
    low, high = -F.least("a", "b"), F.col("b") - F.col("a")
    return g.agg(F.count(F.lit(1)).alias("trials"), F.count_if(low > tolerance).alias("not_monotone"), F.count_if(high > tolerance).alias("not_submodular"), F.greatest(F.lit(0.0), F.max(low), F.max(high)).alias("excess"))


def by_efficiency(path: Path, least: int) -> list[int]:
    """The prefix (of `least` or more) with the largest value for each feature; the first of equals."""
    e = path.efficiency
    if len(e) <= least:
        return path.order
    best = max(range(least - 1, len(e)), key=lambda i: (e[i], -i))
    return path.order[: best + 1]


def best_subset(c: Coverage, m: int) -> tuple[tuple[int, ...], float]:
    """By trying all subsets of m features (for a few features only); the first of equals."""
    if len(c.mu) > 20:
        raise ValueError("too many features to try all subsets")
    return max(((s, c.value(s)) for s in itertools.combinations(sorted(c.mu), m)), key=lambda x: x[1])


def is_monotone(c: Coverage, tolerance: float = 1e-9) -> bool:
    """No feature lowers the value of any set (tries all sets: for a few features only)."""
    return all(c.value({*s, v}) >= c.value(s) - tolerance for s in _sets(c) for v in c.mu if v not in s)


def is_submodular(c: Coverage, tolerance: float = 1e-9) -> bool:
    """A feature adds no more to a set than to the set without one of its members."""
    return all(c.value({*s, v}) - c.value(s) <= c.value({*s, v} - {u}) - c.value(s - {u}) + tolerance for s in _sets(c) for u in s for v in c.mu if v not in s)


def _sets(c: Coverage):
    if len(c.mu) > 12:
        raise ValueError("too many features to try all subsets")
    return [frozenset(s) for k in range(len(c.mu) + 1) for s in itertools.combinations(sorted(c.mu), k)]


def greedy_ratio(c: Coverage, m: int) -> float:
    """Value of the greedy selection over that of the best one (1 where both are 0)."""
    best = best_subset(c, m)[1]
    return c.value(greedy(c, m, stop=False).order) / best if best > 0 else 1.0


def value_of(vertices: DataFrame, groups: DataFrame, chosen: list[int], kind: str, s: Settings = Settings()) -> DataFrame:
    """One row: value of a fixed selection, by aggregation of the tables of vertices (feature_id, mu) and groups (members, w)."""
    k = F.size(F.array_intersect("members", F.array(*[F.lit(v) for v in chosen])))
    cover = groups.filter("w > 0").agg(F.coalesce(F.sum(F.col("w") * coverage(k, F.size("members"), kind, s.goal.rho)), F.lit(0.0)).alias("c"))
    own = vertices.filter(F.col("feature_id").isin(chosen)).agg(F.coalesce(F.sum("mu"), F.lit(0.0)).alias("m"))
    return own.crossJoin(cover).select((s.goal.features * F.col("m") + s.goal.groups * F.col("c")).alias("value"))  # one row each


def gains_of(vertices: DataFrame, groups: DataFrame, chosen: list[int], kind: str, s: Settings = Settings()) -> DataFrame:
    """feature_id, gain of every feature outside the selection."""
    k = F.size(F.array_intersect("members", F.array(*[F.lit(v) for v in chosen]))) if chosen else F.lit(0)
    n = F.size("members")
    add = groups.filter("w > 0").select(F.explode("members").alias("feature_id"), (F.col("w") * (coverage(k + 1, n, kind, s.goal.rho) - coverage(k, n, kind, s.goal.rho))).alias("a")).groupBy("feature_id").agg(F.sum("a").alias("a"))
    out = vertices.filter(~F.col("feature_id").isin(chosen)) if chosen else vertices
    return out.join(add, "feature_id", "left").select("feature_id", (s.goal.features * F.col("mu") + s.goal.groups * F.coalesce("a", F.lit(0.0))).alias("gain"))
