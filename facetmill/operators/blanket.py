"""The features that a label depends on given the others, by conditional permutation tests (growth, then shrinkage).

A feature's information on the label given the features taken so far is compared with what it is after labels have changed
places among rows that agree in these. One permutation serves all candidates, and leaves every table of a feature, or of
the label, with the features taken as it is, so the sum of c ln c over the cells of feature, taken ones and label ranks as
the information does. Rows are dealt to blocks by a hash of their id, and labels change places within a block, in the order
of a hash of seed, permutation and id: the same on any partitioning and for a repeated task, and no class or stratum is
held in one task: rows of strata that fit a task are dealt by stratum, so that their cells are counted to the end there and
only how often each count occurs is exchanged; cells of larger strata, few for their rows, are added up over blocks. A feature counts if its excess over the permutations, in deviations, is larger than the largest of any
candidate in all but a share `alpha` of them, which bounds false features whatever the number of candidates.

Features that matter in company only (parity) show nothing alone, so growth from nothing does not find them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import discretize
from .information import matrix


@dataclass(frozen=True)
class BlanketConfig:
    bins: int = 4
    permutations: int = 99
    alpha: float = 0.05
    seed: int = 42
    #: Features taken at most; more strata than rows tell nothing.
    most: int = 8
    block: int = 20_000


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A hash of 64-bit numbers (two multiplications and shifts)."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) ^ np.uint64(salt)) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def excesses(codes: DataFrame, given: list[int], candidates: list[int], width: int, n: int, cfg: BlanketConfig = BlanketConfig()) -> DataFrame:
    """b (-1: as it is, else the permutation), j, t: the sum of c ln c over cells of candidate, given features and label."""
    if width ** (len(given) + 1) >= 1 << 62:
        raise ValueError(f"tuples of {len(given) + 1} codes below {width} have more values than 62 bits")
    import pyarrow as pa

    blocks = max(1, -(-n // cfg.block))

    def run(t, whole):
        """Cells of a task's rows; whole: its strata are nowhere else, so how often a count occurs says all."""
        t = t.combine_chunks().sort_by("row_id").combine_chunks()
        ids, y, x = t.column("row_id").to_numpy(), t.column("y").to_numpy(), matrix(t.column("codes").combine_chunks(), np.int64)
        stratum, home_block = t.column("stratum").to_numpy(), t.column("block").to_numpy()
        labels, y = np.unique(y, return_inverse=True)
        seen, place = zip(*(np.unique(stratum * width + x[:, j], return_inverse=True) for j in candidates))
        home = np.lexsort((home_block, stratum))
        for b in range(-1, cfg.permutations):
            own = y
            if b >= 0:
                own = np.empty_like(y)
                own[home] = y[np.lexsort((mixed(ids, (cfg.seed << 20) + b), home_block, stratum))]
            out = []
            for i, j in enumerate(candidates):
                c = np.bincount(place[i] * len(labels) + own)
                if whole:
                    many = np.bincount(c)
                    at = np.flatnonzero(many[1:]) + 1
                    out.append((np.full(len(at), b, np.int32), np.full(len(at), j, np.int32), at, many[at]))
                else:
                    at = np.flatnonzero(c)
                    out.append((np.full(len(at), b, np.int32), np.full(len(at), j, np.int32), seen[i][at // len(labels)], labels[at % len(labels)].astype(np.int32), c[at]))
            yield [np.concatenate(a) for a in zip(*out)]

    def table(kinds, names, whole):
        def build(t):
            cols = [np.concatenate(a) for a in zip(*run(t, whole))]
            return pa.table([pa.array(a, k) for a, k in zip(cols, kinds)], names=names)

        return build

    number = F.lit(0).cast("long")
    for j in given:
        number = number * width + F.col("codes")[j]
    dealt = codes.select(F.col("row_id").cast("long").alias("row_id"), F.col("y").cast("int").alias("y"), "codes", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("long").alias("block"), number.alias("stratum"))
    # Strata that more rows share than a task takes: at most n / block, each of few cells.
    large = [r["stratum"] for r in dealt.groupBy("stratum").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > cfg.block).collect()] if given and n > cfg.block else []
    split = F.lit(n > cfg.block) if not given else F.col("stratum").isin(large) if large else F.lit(False)
    parts = max(min(32, -(-n // 500)), -(-n // cfg.block))
    full = table((pa.int32(), pa.int32(), pa.int64(), pa.int64()), ["b", "j", "c", "times"], True)
    counts = dealt.filter(~split).groupBy(F.pmod(F.xxhash64("stratum"), F.lit(parts))).applyInArrow(full, "b int, j int, c long, times long")
    if large or (not given and n > cfg.block):
        some = table((pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), ["b", "j", "k", "y", "c"], False)
        cells = dealt.filter(split).groupBy("block").applyInArrow(some, "b int, j int, k long, y int, c long").groupBy("b", "j", "k", "y").agg(F.sum("c").alias("c"))
        counts = counts.unionByName(cells.select("b", "j", "c", F.lit(1).cast("long").alias("times")))
    return counts.groupBy("b", "j").agg(F.sum(F.col("times") * F.col("c") * F.ln("c")).alias("t"))


def tested(codes: DataFrame, given: list[int], candidates: list[int], width: int, n: int, cfg: BlanketConfig = BlanketConfig()) -> dict[int, tuple[float, float]]:
    """feature -> (excess in deviations, p against the largest excess of any candidate)."""
    t = np.full((cfg.permutations + 1, len(candidates)), np.nan)
    spot = {j: i for i, j in enumerate(candidates)}
    for r in excesses(codes, given, candidates, width, n, cfg).collect():  # permutations times candidates
        t[r["b"] + 1, spot[r["j"]]] = r["t"]
    t = np.round(t, 9)
    sd = t[1:].std(axis=0)
    z = np.where(sd > 0, (t - t[1:].mean(axis=0)) / np.where(sd > 0, sd, 1.0), 0.0)
    top = z[1:].max(axis=1)
    return {j: (float(z[0, i]), float((1 + (top >= z[0, i]).sum()) / (cfg.permutations + 1))) for j, i in spot.items()}


def select(df: DataFrame, d: int, cfg: BlanketConfig = BlanketConfig()) -> list[int]:
    """The features found, sorted (row_id, x, y); none is a result."""
    edges = discretize.fit(df, d, cfg.bins)
    width, n = discretize.width(edges), df.count()
    codes = discretize.encode(df.select("row_id", "x", "y"), edges).cache()
    taken: list[int] = []
    left = [j for j in range(d) if len(edges[j]) > 1]
    while left and len(taken) < cfg.most:
        found = tested(codes, taken, left, width, n, cfg)
        good = [j for j in left if found[j][1] <= cfg.alpha]
        if not good:
            break
        pick = max(good, key=lambda j: (round(found[j][0], 9), -j))
        taken.append(pick)
        left.remove(pick)
    for j in list(taken):
        rest = [v for v in taken if v != j]
        if rest and tested(codes, rest, [j], width, n, cfg)[j][1] > cfg.alpha:
            taken = rest
    codes.unpersist()
    return sorted(taken)
