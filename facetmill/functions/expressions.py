"""Column expressions of the engine: fuzzy degrees, coverage, set similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def sigmoid(z: Column, slope: float, intercept: float) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), slope * z + intercept))))


def mapped(evidence: Column, kind: str, slope: float, intercept: float) -> Column:
    e = F.greatest(F.lit(0.0), evidence)
    if kind == "direct":
        return e
    if kind == "sigmoid":
        return sigmoid(e, slope, intercept)
    raise ValueError(f"unknown evidence map {kind!r}")


def fuzzy(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Membership, non-membership and hesitation of two evidences; they add up to 1."""
    a, b = F.greatest(F.lit(0.0), a), F.greatest(F.lit(0.0), b)
    whole = 1 + a + b
    return a / whole, b / whole, 1 / whole


def coverage(k: Column, size: Column, kind: str, rho: float = 0.5) -> Column:
    if kind == "binary" or (kind == "soft" and rho <= 0):
        return F.when(k >= 1, 1.0).otherwise(0.0)
    if kind == "soft":
        return 1 - F.pow(F.lit(1 - rho), k)
    if kind == "fraction":
        return F.least(k / size, F.lit(1.0))
    raise ValueError(f"unknown coverage {kind!r}")


def normalized(mi: Column, ha: Column, hb: Column) -> Column:
    low = F.least(ha, hb)
    return F.when(low <= EPS, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mi) / low))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def kuncheva(a: Column, b: Column, d: int) -> Column:
    """Consistency corrected for chance; null where it is not defined."""
    k, n = F.size(a), F.size(b)
    by_chance = k * n / F.lit(float(d))
    room = F.least(k, n) - by_chance
    return F.when((k > 0) & (n > 0) & (F.lit(d) > 1) & (F.abs(room) >= EPS), (F.size(F.array_intersect(a, b)) - by_chance) / room)


def hashed_seed(text: Column) -> Column:
    """The run_seed hash of a string column."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).otherwise((h * 131 + F.ascii(c)) % 2147483647))
