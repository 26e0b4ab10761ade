"""Other selectors from their papers, on tables of counts; and the record of what is not available."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import EPS
from .information import joint_entropies, pairs, singles


def pair_table(codes: DataFrame, d: int, width: int) -> DataFrame:
    """subset_id, order, members, h_x, h_xy, h_y of all single features and pairs."""
    return joint_entropies(codes, singles(d) + pairs(d), width)


def uncertainty(h: DataFrame) -> DataFrame:
    """a, b (null: the label), su: symmetrical uncertainty 2 I / (H + H)."""
    m = h.filter("order = 1").select(F.col("members")[0].alias("f"), "h_x", "h_xy", "h_y")
    label = m.select(F.col("f").alias("a"), F.lit(None).cast("int").alias("b"), F.when(F.col("h_x") + F.col("h_y") > EPS, 2 * F.greatest(F.lit(0.0), F.col("h_x") + F.col("h_y") - F.col("h_xy")) / (F.col("h_x") + F.col("h_y"))).otherwise(0.0).alias("su"))
    p = h.filter("order = 2").select(F.col("members")[0].alias("a"), F.col("members")[1].alias("b"), F.col("h_x").alias("hab"))
    p = p.join(m.select(F.col("f").alias("a"), F.col("h_x").alias("ha")), "a").join(m.select(F.col("f").alias("b"), F.col("h_x").alias("hb")), "b")
    return label.unionByName(p.select("a", "b", F.when(F.col("ha") + F.col("hb") > EPS, 2 * F.greatest(F.lit(0.0), F.col("ha") + F.col("hb") - F.col("hab")) / (F.col("ha") + F.col("hb"))).otherwise(0.0).alias("su")))


def fcbf(h: DataFrame, threshold: float = 0.01) -> list[int]:
    """Fast correlation-based filter: features by uncertainty with the label, each removes later ones it predicts better. Rows are pairs of screened features."""
    rows = uncertainty(h).collect()
    own = {r["a"]: r["su"] for r in rows if r["b"] is None}
    su = {(r["a"], r["b"]): r["su"] for r in rows if r["b"] is not None}
    left, kept = sorted((f for f, v in own.items() if v > threshold), key=lambda f: (-round(own[f], 12), f)), []
    while left:
        f, *left = left
        kept.append(f)
        left = [g for g in left if su[min(f, g), max(f, g)] < own[g]]
    return kept


def _information(h: DataFrame):
    rows = h.select("members", "h_x", "h_xy", "h_y").collect()  # pairs of screened features
    hx = {tuple(r["members"]): r["h_x"] for r in rows}
    hxy = {tuple(r["members"]): r["h_xy"] for r in rows}
    return hx, hxy, rows[0]["h_y"] if rows else 0.0


def mrmr(h: DataFrame, m: int) -> list[int]:
    """Greedy by I(f; y) - mean I(f; chosen)."""
    hx, hxy, hy = _information(h)
    rel = {j: hx[j,] + hy - hxy[j,] for (j, *more) in hx if not more}
    red = lambda a, b: hx[a,] + hx[b,] - hx[min(a, b), max(a, b)]
    chosen: list[int] = []
    while len(chosen) < min(m, len(rel)):
        chosen.append(max((j for j in rel if j not in chosen), key=lambda j: (round(rel[j] - (sum(red(j, c) for c in chosen) / len(chosen) if chosen else 0), 12), -j)))
    return chosen


def cmim(h: DataFrame, m: int) -> list[int]:
    """Greedy by the least I(f; y | chosen)."""
    hx, hxy, hy = _information(h)
    rel = {j: hx[j,] + hy - hxy[j,] for (j, *more) in hx if not more}
    given = lambda j, c: hx[min(j, c), max(j, c)] + hxy[c,] - hxy[min(j, c), max(j, c)] - hx[c,]
    chosen: list[int] = []
    while len(chosen) < min(m, len(rel)):
        chosen.append(max((j for j in rel if j not in chosen), key=lambda j: (round(min([rel[j], *[given(j, c) for c in chosen]]), 12), -j)))
    return chosen


def jmi_least(h: DataFrame, m: int) -> list[int]:
    """Greedy by the least joint I(f, chosen; y) (discrete estimate)."""
    hx, hxy, hy = _information(h)
    rel = {j: hx[j,] + hy - hxy[j,] for (j, *more) in hx if not more}
    joint = lambda j, c: hx[min(j, c), max(j, c)] + hy - hxy[min(j, c), max(j, c)]
    chosen: list[int] = []
    while len(chosen) < min(m, len(rel)):
        chosen.append(max((j for j in rel if j not in chosen), key=lambda j: (round(min([joint(j, c) for c in chosen]) if chosen else rel[j], 12), -j)))
    return chosen


@dataclass
class Outcome:
    method: str
    status: str
    selected: list[int] = field(default_factory=list)
    message: str = ""


METHODS = {"mrmr": mrmr, "cmim": cmim, "jmi_least": jmi_least}


def run(method: str, h: DataFrame, m: int) -> Outcome:
    """OK with a selection, UNAVAILABLE for methods that are not here, FAILED with the error's text."""
    if method not in METHODS and method != "fcbf":
        return Outcome(method, "UNAVAILABLE", message=f"{method} is not part of this package")
    try:
        return Outcome(method, "OK", fcbf(h) if method == "fcbf" else METHODS[method](h, m))
    except Exception as e:  # noqa: BLE001  the record says what happened
        return Outcome(method, "FAILED", message=f"{type(e).__name__}: {e}")
