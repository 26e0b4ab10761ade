"""The whole selection: screen, discretize, degrees, groups, weights, greedy path."""

from __future__ import annotations

import contextlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings, cardinality, screening_size
from ..operators import bootstrap, discretize, groups, information, screening
from ..operators.objective import Coverage, Path, by_efficiency, greedy
from .audit import Audit


@dataclass
class Selection:
    selected: list[int]
    path: Path
    screened: list[int]
    vertices: list[dict]
    groups: list[dict]


def prepare(df: DataFrame, d: int, s: Settings = Settings()) -> tuple[DataFrame, list[int], int]:
    """Codes of the screened features (cached for the counts that follow), their ids, the number of codes."""
    edges = discretize.fit(df, d, s.coding.bins, s.coding.method)
    width = discretize.width(edges)
    f = screening_size(d, s.screen)
    relevance = lambda: screening.mi_scores(discretize.encode(df, edges), d, width)
    if s.screen.by == "none" or f >= d:
        keep = list(range(d))
    else:
        if s.screen.by == "mi":
            scores = relevance()
        elif s.screen.by == "anova_f":
            scores = screening.anova_scores(df, d)
        elif s.screen.by == "relieff":
            scores = screening.relieff_scores(df, d)
        elif s.screen.by == "interaction_union":
            scores = screening.union(relevance(), screening.relieff_scores(df, d), f, s.screen.share)
        else:
            raise ValueError(f"unknown screening {s.screen.by!r}")
        keep = sorted(r["feature_id"] for r in screening.top(scores, f).collect())  # at most f rows
    return discretize.encode(df, edges, keep).select("codes", "y"), keep, width


def fit(df: DataFrame, d: int, s: Settings = Settings(), budget: int | None = None, audit: Audit | None = None) -> Selection:
    """df: row_id, x (array of d doubles), y (0, 1, ...). Only tables of features and groups reach the driver.

    audit: collects what the stages cost; they are then run one after the other.
    """
    stage = audit.stage if audit else lambda name: contextlib.nullcontext()
    with stage("screen"):
        codes, keep, width = prepare(df, d, s)
    sets, every = subsets(len(keep), s)
    with stage("code"):
        codes = codes.cache()
        if audit:
            audit.observed(codes, "code").write.format("noop").mode("overwrite").save()
    with stage("count"):
        h = information.joint_entropies(codes, every, width, s.coding.estimator).cache()
        if audit:
            audit.observed(h, "count").write.format("noop").mode("overwrite").save()
    with stage("select"):
        out = chosen(h, keep, d, s, sets, budget, codes)
    codes.unpersist()
    h.unpersist()
    return out


def subsets(f: int, s: Settings) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
    """The groups of f features, and all subsets that are counted."""
    sets = groups.groups(f, s.groups.largest, s.groups.most, s.groups.seed, s.groups.only_largest)
    return sets, information.singles(f) + sorted(set(information.pairs(f)) | set(sets), key=lambda g: (len(g), g))


def chosen(h: DataFrame, keep: list[int], d: int, s: Settings, sets: list[tuple[int, ...]], budget: int | None = None, codes: DataFrame | None = None) -> Selection:
    """The selection that follows from the entropies of single features, pairs and groups (codes: for mean correlations)."""
    f = len(keep)
    relevance = information.with_nmi(h.filter("order = 1")).selectExpr("members[0] AS feature_id", "nmi AS relevance")
    redundancy = information.pairwise_nmi_mean(h, f) if s.maps.redundancy == "nmi_mean" else information.mean_correlation(codes, f)
    vertices = groups.vertex_degrees(relevance, redundancy, s).cache()
    mu = {r["feature_id"]: r["mu"] for r in vertices.collect()}
    wanted = set(sets)
    if s.groups.degrees == "strict_strong":
        degrees = h.filter("order > 1").select("subset_id", "members").join(groups.strong_degrees(h.filter("order > 1"), vertices), "subset_id")
    else:
        degrees = groups.independent_degrees(information.group_evidence(h), s)
    edge = [r.asDict() for r in groups.weights(degrees, s).select("members", "mu", "nu", "pi", "w").collect() if tuple(r["members"]) in wanted] if sets else []
    c = Coverage(mu, {tuple(r["members"]): r["w"] for r in edge}, s)
    m = cardinality(d, f, s.goal)
    best_value = s.goal.rule == "efficiency" and s.goal.select is None
    path = greedy(c, f if best_value else max(m, budget or 0))
    picked = by_efficiency(path, m) if best_value else path.order[:m]
    out = Selection([keep[v] for v in picked], path, keep, [r.asDict() for r in vertices.collect()], edge)
    vertices.unpersist()
    return out


def replicated(df: DataFrame, d: int, s: Settings = Settings(), replicates: int = 20, seed: int = 42, budget: int | None = None) -> dict[int, Selection]:
    """The selection of every bootstrap replicate with two classes or more, by its number; df as for fit.

    Codes are those of the rows as they are; screen, groups and weights are each replicate's own. All replicates share two
    passes over the rows: one counts single features, the other the pairs and groups of the screened ones, each for the
    replicates that look at it.
    """
    if s.screen.by not in ("mi", "none") or s.maps.redundancy != "nmi_mean":
        raise ValueError("replicates are screened by mutual information and weighed by mean NMI")
    edges = discretize.fit(df, d, s.coding.bins, s.coding.method)
    width = discretize.width(edges)
    rows = discretize.encode(bootstrap.weighted(df.select("row_id", "x", "y"), replicates, seed), edges).cache()
    one = bootstrap.joint_entropies(rows, information.singles(d), width, replicates, s.coding.estimator).cache()
    f = d if s.screen.by == "none" else screening_size(d, s.screen)
    best = Window.partitionBy("replicate").orderBy(F.round("nmi", 9).desc(), "subset_id")
    screened = information.with_nmi(one).withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= f) & (F.col("h_y") > 0))
    kept: dict[int, list[int]] = {}
    for r in screened.select("replicate", "subset_id").collect():  # f rows for each replicate
        kept.setdefault(r["replicate"], []).append(r["subset_id"])
    kept = {r: sorted(v) for r, v in sorted(kept.items())}
    if not kept:
        return {}
    sets, every = subsets(f, s)
    wanted: dict[tuple[int, ...], list[int]] = {}
    for r, keep in kept.items():
        for g in every[f:]:
            wanted.setdefault(tuple(keep[v] for v in g), []).append(r)
    more = bootstrap.joint_entropies(rows, list(wanted), width, replicates, s.coding.estimator, list(wanted.values())).cache()
    both = one.unionByName(more)
    out = {}
    for r, keep in kept.items():
        place = F.create_map(*[F.lit(x) for j, v in enumerate(keep) for x in (v, j)])
        own = both.filter((F.col("replicate") == r) & F.forall("members", lambda v: v.isin(keep))).drop("replicate")
        own = own.withColumn("members", F.transform("members", lambda v: place[v])).withColumn("subset_id", F.xxhash64("members")).cache()
        out[r] = chosen(own, keep, d, s, sets, budget)
        own.unpersist()
    for t in (rows, one, more):
        t.unpersist()
    return out
