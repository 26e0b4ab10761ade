"""Settings of a selection run by stage, the sizes that follow from them, and named variations."""

from __future__ import annotations

import functools
import math
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class Coding:
    """How values become codes, and how entropies of codes are estimated."""

    method: str = "quantile"
    bins: int = 10
    estimator: str = "plugin"


@dataclass(frozen=True)
class Screen:
    """Which features are looked at: by what score, and how many (a number, or between least and most by a rule)."""

    by: str = "mi"
    keep: int | None = None
    least: int = 50
    most: int = 300
    share: float = 0.5


@dataclass(frozen=True)
class Maps:
    """From evidence to degrees: slope and intercept for relevance and for redundancy, of features and of groups."""

    kind: str = "sigmoid"
    feature: tuple[tuple[float, float], tuple[float, float]] = ((5.0, -2.5), (5.0, -2.5))
    group: tuple[tuple[float, float], tuple[float, float]] = ((5.0, -2.5), (5.0, -2.5))
    against: bool = True
    redundancy: str = "nmi_mean"


@dataclass(frozen=True)
class Groups:
    """Which groups of features are weighed, and how."""

    largest: int = 3
    only_largest: bool = False
    most: int = 5000
    seed: int = 42
    degrees: str = "independent"
    penalty: float = 0.5
    hesitation: bool = True


@dataclass(frozen=True)
class Goal:
    """The objective (weights of features and of groups, coverage) and how many features are selected."""

    features: float = 1.0
    groups: float = 1.0
    coverage: str = "binary"
    rho: float = 0.5
    select: int | None = None
    rule: str = "sqrt"


@dataclass(frozen=True)
class Settings:
    coding: Coding = field(default_factory=Coding)
    screen: Screen = field(default_factory=Screen)
    maps: Maps = field(default_factory=Maps)
    groups: Groups = field(default_factory=Groups)
    goal: Goal = field(default_factory=Goal)

    def but(self, **stages: dict[str, object]) -> Settings:
        """A copy in which stages differ: but(groups={"largest": 2}, goal={"select": 4})."""
        return replace(self, **{name: replace(getattr(self, name), **changes) for name, changes in stages.items()})

    def as_dict(self) -> dict[str, object]:
        return asdict(self)


def _within(value: float, low: int, high: int) -> int:
    return int(max(low, min(value, high)))


def screening_size(d: int, s: Screen = Screen()) -> int:
    """How many of d features the screen keeps."""
    rule = math.floor(math.sqrt(max(d, 2)) * math.log(max(d, 3)))
    return _within(s.keep if s.keep is not None else _within(rule, s.least, max(s.least, s.most)), 1, d)


#: How many features are selected, of d and of f screened ones.
RULES = {"sqrt": lambda d, f: max(10, round(math.sqrt(max(d, 1)))), "efficiency": lambda d, f: max(5, math.isqrt(f)), "all": lambda d, f: f}


def sqrt_cardinality(d: int) -> int:
    return RULES["sqrt"](d, d)


def cardinality(d: int, screened: int, goal: Goal = Goal()) -> int:
    wanted = goal.select if goal.select is not None else RULES.get(goal.rule, RULES["sqrt"])(d, screened)
    return _within(wanted, 1, min(screened, d))


def budgets(d: int) -> list[int]:
    """Common budgets up to d."""
    return sorted(b for b in {10, 25, 50, 100, sqrt_cardinality(d)} if b <= d)


def run_seed(base: int, dataset: str, run: int) -> int:
    """A polynomial hash of the run's name modulo 2^31 - 1."""
    return functools.reduce(lambda h, c: (131 * h + ord(c)) % (2**31 - 1), f"{base}|{dataset}|{run}", 0)


def one_factor_grid(s: Settings = Settings(), d: int = 1000, grid: str = "core") -> list[tuple[str, Settings]]:
    """Settings that differ from s in one factor."""
    g = PROFILES[grid]
    slope = lambda v: ((v, -v / 2), (v, -v / 2))
    out = [(f"penalty={v}", s.but(groups={"penalty": v})) for v in g["penalty"]]
    out += [(f"weights={a},{b}", s.but(goal={"features": a, "groups": b})) for a, b in g["weights"]]
    out += [(f"largest={v}", s.but(groups={"largest": v})) for v in g["largest"]]
    out += [(f"most={v}", s.but(groups={"most": v})) for v in g["most"]]
    out += [(f"screen={v}", s.but(screen={"keep": _within(v * screening_size(d, s.screen), 1, d)})) for v in g["screen"]]
    out += [(f"method={v}", s.but(coding={"method": v})) for v in g["method"]]
    out += [(f"bins={v}", s.but(coding={"bins": v})) for v in g["bins"]]
    return out + [(f"slope={v}", s.but(maps={"feature": slope(v), "group": slope(v)})) for v in g["slope"]]


#: The grids of each profile.
PROFILES: dict[str, dict[str, object]] = {
    "smoke": {"runs": 2, "seeds": 10, "penalty": (0.0, 0.5, 2.0), "weights": ((1.0, 0.0), (1.0, 1.0)), "largest": (2, 3), "most": (1000, 5000), "bins": (5, 10), "method": ("quantile", "uniform"), "slope": (2.5, 10.0), "screen": (0.5, 1.0, 2.0), "scaling": (500, 1000), "splits": 4, "group_seeds": 3, "bootstrap": 5},
    "core": {"runs": 10, "seeds": 20, "penalty": (0.0, 0.25, 0.5, 1.0, 2.0), "weights": ((1.0, 0.0), (1.0, 0.5), (1.0, 1.0), (0.5, 1.0), (0.0, 1.0)), "largest": (2, 3, 4), "most": (1000, 5000, 10000), "bins": (5, 7, 10, 15), "method": ("quantile", "uniform"), "slope": (2.5, 5.0, 10.0), "screen": (0.5, 1.0, 2.0), "scaling": (500, 1000, 2000), "splits": 6, "group_seeds": 4, "bootstrap": 10},
}
PROFILES["full"] = PROFILES["core"] | {"scaling": (500, 1000, 2000, 5000, 10000, 20000), "splits": 8, "group_seeds": 5, "bootstrap": 20}

#: Named variations, each of one part.
ABLATIONS: dict[str, dict[str, dict[str, object]]] = {
    "full": {}, "vertex_only": {"goal": {"groups": 0.0}}, "no_groups": {"groups": {"largest": 1}}, "pairs_only": {"groups": {"largest": 2}}, "up_to_triples": {"groups": {"largest": 3}}, "up_to_fours": {"groups": {"largest": 4}},
    "triples_only": {"groups": {"only_largest": True}}, "no_redundancy_penalty": {"groups": {"penalty": 0.0}}, "no_hesitation": {"groups": {"hesitation": False}}, "no_nonmembership": {"maps": {"against": False}},
    "strong_groups": {"groups": {"degrees": "strict_strong"}}, "independent_groups": {"groups": {"degrees": "independent"}}, "other_groups": {"groups": {"seed": 1042}}, "correlation_redundancy": {"maps": {"redundancy": "corr_mean"}},
    "direct_evidence": {"maps": {"kind": "direct"}}, "miller_madow": {"coding": {"estimator": "miller_madow"}}, "uniform_bins": {"coding": {"method": "uniform"}},
    "binary_coverage": {"goal": {"coverage": "binary"}}, "soft_coverage": {"goal": {"coverage": "soft"}}, "fraction_coverage": {"goal": {"coverage": "fraction"}},
    "screen_anova": {"screen": {"by": "anova_f"}}, "screen_relieff": {"screen": {"by": "relieff"}}, "screen_union": {"screen": {"by": "interaction_union"}}, "screen_none": {"screen": {"by": "none"}},
}


def ablation(name: str, s: Settings = Settings(), d: int = 1000) -> Settings:
    """screen_low and screen_high halve and double the screen of d features; all_groups weighs every group of the largest order that a screen of 30 has."""
    if name in ("screen_low", "screen_high"):
        return s.but(screen={"keep": _within(screening_size(d, s.screen) * (0.5 if name == "screen_low" else 2), 1, d)})
    if name == "all_groups":
        f = min(30, screening_size(d, s.screen))
        return s.but(screen={"keep": f}, groups={"most": sum(math.comb(f, k) for k in range(2, s.groups.largest + 1)) * s.groups.largest})
    if name not in ABLATIONS:
        raise ValueError(f"unknown ablation {name!r}")
    return s.but(**ABLATIONS[name])
