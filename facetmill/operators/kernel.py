"""Support vector machine with a radial kernel: one against one, its dual solved by working sets over distributed rows.

Every row carries, for each pair of classes, its dual weight and the sum of kernels with the weighted rows so far. First the
rows of each pair are dealt to blocks that solve their own problem; their weights together are a start from which few rounds
are left. In a round each task names, for each pair, how far its rows violate the optimality conditions; the rows up to the
worst `working` of all go to one task a pair, which solves their problem by pairwise steps; the changed weights go to all
tasks, which add their kernels. No kernel matrix is held: the start, the test rows and a round compute rows times rows tile
by tile, the first two once for all pairs.

A pair has converged when the largest violation is below the tolerance. Class ids are 0, 1, ...; the state of a row grows
with the number of pairs of classes.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import VALUES, blocks_of, dealt, every, place
from .information import matrix
from .neighbours import settled

_TINY = 1e-12
#: Partitions of the state at least, rows and columns of a tile of kernels (16 MB).
_PARTS, _ROWS, _COLUMNS = 24, 1024, 2048


@dataclass(frozen=True)
class KernelConfig:
    #: Upper bound of weights, and the kernel's rate; none: 1 / (features * variance of all values).
    c: float = 1.0
    gamma: float | None = None
    tolerance: float = 1e-3
    #: Rows of a pair whose weights change in a round (less where all pairs would send more than 128 MB of vectors; the kernels
    #: of so many rows are 134 MB in one task), rounds until that is an error, rounds between written states.
    working: int = 4096
    rounds: int = 2000
    settle: int = 8


@dataclass
class Fitted:
    """rows: row_id, y, v, alpha and total of each pair; scores: row_id, y, total of the test rows; pairs: classes, bias and violation of each pair."""

    rows: DataFrame
    scores: DataFrame
    pairs: list[tuple[int, int]]
    bias: list[float]
    violation: list[float]
    rounds: int

    def support(self) -> DataFrame:
        """pair, row_id, y, alpha of every support vector."""
        return self.rows.select("row_id", "y", F.posexplode("alpha").alias("pair", "alpha")).filter("alpha > 0")

    def predictions(self) -> DataFrame:
        """row_id, y, pred of the test rows: most votes, ties to the smaller class."""
        classes = sorted({c for p in self.pairs for c in p})
        wins = [F.when(F.get("total", F.lit(i)) + F.lit(b) > 0, F.lit(p)).otherwise(F.lit(q)) for i, ((p, q), b) in enumerate(zip(self.pairs, self.bias))]
        voted = self.scores.select("row_id", "y", F.array(*wins).alias("w"))
        count = lambda c: F.size(F.filter("w", lambda v: v == c))
        votes = F.array(*[F.struct(count(c).alias("n"), F.lit(-c).alias("c")) for c in classes])
        return voted.select("row_id", "y", (-F.array_max(votes)["c"]).alias("pred"))


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    far = a @ b.T
    far *= 2
    far -= (a * a).sum(axis=1)[:, None]
    far -= (b * b).sum(axis=1)
    far *= gamma
    return np.exp(np.minimum(far, 0.0, out=far), out=far)


def summed(x: np.ndarray, vectors: np.ndarray, add: np.ndarray, gamma: float) -> np.ndarray:
    """Sums of the kernels of x with vectors by their weights (one column or more), tile by tile."""
    total = np.zeros((len(x), *add.shape[1:]))
    for at in range(0, len(x), _ROWS):
        for start in range(0, len(vectors), _COLUMNS):
            total[at : at + _ROWS] += kernel(x[at : at + _ROWS], vectors[start : start + _COLUMNS], gamma) @ add[start : start + _COLUMNS]
    return total


def solve(k: np.ndarray, s: np.ndarray, alpha: np.ndarray, e: np.ndarray, c: float, tolerance: float, steps: int = 200_000) -> np.ndarray:
    """Weights of a few rows by steps on the pair that violates most (the second of it by the gain); others stay as they are.

    s: signs, e: sign less the sum of kernels with weighted rows.
    """
    alpha, e, own = alpha.copy(), e.copy(), np.diag(k).copy()
    up, low = _movable(s, alpha, c)
    for _ in range(steps):
        i = int(np.argmax(np.where(up, e, -np.inf)))
        gap = np.where(low, e[i] - e, -np.inf)
        if not up[i] or gap.max() < tolerance:
            break
        gain = np.where(gap > 0, gap * np.abs(gap) / np.maximum(k[i, i] + own - 2 * k[i], _TINY), -1.0)
        j = int(np.argmax(gain))
        step = (e[i] - e[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], _TINY)
        room_i = c - alpha[i] if s[i] > 0 else alpha[i]
        room_j = alpha[j] if s[j] > 0 else c - alpha[j]
        step = min(step, room_i, room_j)
        alpha[i] += s[i] * step
        alpha[j] -= s[j] * step
        if step == room_i:
            alpha[i] = c if s[i] > 0 else 0.0
        if step == room_j:
            alpha[j] = 0.0 if s[j] > 0 else c
        e -= step * (k[i] - k[j])
        for r in (i, j):
            up[r], low[r] = (alpha[r] < c, alpha[r] > 0) if s[r] > 0 else (alpha[r] > 0, alpha[r] < c)
    return alpha


def _movable(s, alpha, c):
    """Which rows could rise, and which could fall."""
    return np.where(s > 0, alpha < c, alpha > 0), np.where(s > 0, alpha > 0, alpha < c)


def _lists(a: np.ndarray):
    """The rows of a as lists."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], pa.array(a.ravel()))


def _sums(rows: DataFrame, support: DataFrame, sizes: tuple[int, int], f: int, pairs: list[tuple[int, int]], gamma: float) -> DataFrame:
    """row_id, total: of each row (row_id, v) the sums, pair by pair, of its kernels with the support (row_id, y, v, alpha).

    Blocks of rows meet blocks of support in one task; a kernel serves all pairs.
    """
    n = len(pairs)
    left = dealt(rows.select(place("row_id", sizes[0]).alias("a"), every(sizes[1]).alias("b"), "row_id", "v"), sizes)
    right = dealt(support.select(every(sizes[0]).alias("a"), place("row_id", sizes[1]).alias("b"), F.col("row_id").alias("n_id"), F.col("y").alias("n_y"), F.col("v").alias("w"), F.col("alpha").alias("n_alpha")), sizes)

    def run(t, o):
        import pyarrow as pa

        ids, total = t.column("row_id").to_numpy() if len(t) else np.empty(0, np.int64), np.zeros((len(t), n))
        if len(t) and len(o):
            o = o.combine_chunks().sort_by("n_id").combine_chunks()  # sums of a task have one order
            y = o.column("n_y").to_numpy()[:, None]
            sign = (y == [p for p, _ in pairs]) * 1.0 - (y == [q for _, q in pairs])
            total = summed(matrix(t.column("v").combine_chunks(), np.float64), matrix(o.column("w").combine_chunks(), np.float64), matrix(o.column("n_alpha").combine_chunks(), np.float64) * sign, gamma)
        return pa.table([pa.array(ids, pa.int64()), _lists(total)], names=["row_id", "total"])

    def merge(t):
        import pyarrow as pa

        t = t.combine_chunks()
        ids, at = np.unique(t.column("row_id").to_numpy(), return_inverse=True)
        total = np.zeros((len(ids), n))
        np.add.at(total, at, matrix(t.column("total").combine_chunks(), np.float64))
        return pa.table([pa.array(ids), _lists(total)], names=["row_id", "total"])

    parts = left.cogroup(right).applyInArrow(run, "row_id long, total array<double>")
    if sizes[1] == 1:
        return parts
    # A group of rows for merging: few enough that their sums of all blocks are some ten megabytes.
    return parts.groupBy(F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(sizes[0] * 16))).applyInArrow(merge, "row_id long, total array<double>")


def fit(train: DataFrame, test: DataFrame, features: list[int], cfg: KernelConfig = KernelConfig()) -> Fitted:
    """Train on (row_id, x, y); the sums of the test rows follow from the weights."""
    v, d, c = F.array(*[F.col("x")[j].cast("double") for j in features]), len(features), cfg.c
    side = lambda df: df.select(F.col("row_id").cast("long").alias("row_id"), F.col("y").cast("int").alias("y"), v.alias("v"))
    sizes = {r["y"]: r["n"] for r in side(train).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each class
    classes, rows_of_all = sorted(sizes), sum(sizes.values())
    pairs = list(itertools.combinations(classes, 2))
    spread = side(train).select(F.explode("v").alias("v")).agg(F.var_pop("v").alias("s")).first()["s"]  # one row
    gamma = cfg.gamma if cfg.gamma is not None else 1 / (d * spread) if spread else 1.0
    if not pairs:
        raise ValueError("two classes at least")
    working = max(2, min(cfg.working, max(128, 4 * VALUES // (len(pairs) * d))))
    half, zeros = max(1, working // 2), F.array_repeat(F.lit(0.0), len(pairs))
    parts = max(_PARTS, -(-rows_of_all * (d + 2 * len(pairs)) // VALUES))
    # A checkpoint: a repeated task sees the same rows in the same order.
    own = settled(side(train).repartition(parts, "row_id"))
    rows = own.withColumn("alpha", zeros).withColumn("total", zeros)
    at_first, at_second = (np.array(p) for p in zip(*pairs))

    def state(b):
        return b.column("row_id").to_numpy(), b.column("y").to_numpy(), *(matrix(b.column(n), np.float64) for n in ("v", "alpha", "total"))

    def of_pairs(b):
        """place of a pair, places of its rows in a batch, their signs, weights and gaps."""
        _, y, _, alpha, total = state(b)
        for p, (first, second) in enumerate(pairs):
            at = np.flatnonzero((y == first) | (y == second))
            s = np.where(y[at] == first, 1.0, -1.0)
            yield p, at, s, alpha[at, p], s - total[at, p]

    def ends(batches):
        """Of each pair the gaps of the task's rows that could rise or fall and gain most; those that fall with their signs changed."""
        import pyarrow as pa

        best = {}
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("row_id").to_numpy()
            for p, at, s, alpha, e in of_pairs(b):
                for side_of, (could, gap) in enumerate(zip(_movable(s, alpha, c), (e, -e))):
                    if could.any():
                        best[p, side_of] = _first(half, *(np.concatenate(z) for z in zip(best.get((p, side_of), (np.empty(0), np.empty(0, np.int64))), (gap[could], ids[at][could]))))
        for (p, side_of), (gap, i) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([side_of], pa.int32()), pa.array([gap.tolist()], pa.list_(pa.float64())), pa.array([i.tolist()], pa.list_(pa.int64()))], ["pair", "side", "gap", "row_id"])

    def end(t):
        """The largest gap of a pair's side, and the gap and id up to which its rows are in the working set."""
        import pyarrow as pa

        flat = lambda name: t.column(name).combine_chunks().flatten().to_numpy()
        gap, ids = _first(half, flat("gap"), flat("row_id"))
        return pa.table([t.column("pair")[:1], t.column("side")[:1], pa.array([gap[0]]), pa.array([gap[-1]]), pa.array([ids[-1]])], names=["pair", "side", "most", "gap", "row_id"])

    def worst(limits):
        """The rows of a task that are in the working sets of pairs: limits, (gap, id) of both sides."""

        def run(batches):
            import pyarrow as pa

            for b in batches:
                if not b.num_rows:
                    continue
                ids, x = b.column("row_id").to_numpy(), matrix(b.column("v"), np.float64)
                for p, at, s, alpha, e in of_pairs(b):
                    if p not in limits:
                        continue
                    within = np.zeros(len(at), bool)
                    for could, gap, (least, last) in zip(_movable(s, alpha, c), (e, -e), limits[p]):
                        within |= could & ((gap > least) | (gap == least) & (ids[at] <= last))
                    pick = np.flatnonzero(within)
                    if len(pick):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), p, np.int32)), pa.array(ids[at[pick]]), pa.array(s[pick]), pa.array(alpha[pick]), pa.array(e[pick]), _lists(x[at[pick]])], ["pair", "row_id", "s", "alpha", "e", "v"])

        return run

    def improve(t):
        """New weights of the working set of a pair; in early rounds not to the end, as other rows change what is best."""
        import pyarrow as pa

        t = t.combine_chunks().sort_by("row_id").combine_chunks()
        s, alpha, e = (t.column(n).to_numpy() for n in ("s", "alpha", "e"))
        x = matrix(t.column("v").combine_chunks(), np.float64)
        up, low = _movable(s, alpha, c)
        violation = e[up].max(initial=-np.inf) - e[low].min(initial=np.inf)
        new = solve(kernel(x, x, gamma), s, alpha, e, c, max(cfg.tolerance / 2, violation / 100))
        at = np.flatnonzero(new != alpha)
        return pa.table([t.column("pair").take(at), t.column("row_id").take(at), pa.array(new[at]), pa.array(s[at] * (new[at] - alpha[at])), t.column("v").take(at)], names=["pair", "row_id", "alpha", "add", "v"])

    def start(t):
        """Weights of a block of a pair's rows on their own."""
        import pyarrow as pa

        t = t.combine_chunks().sort_by("row_id").combine_chunks()
        x, s = matrix(t.column("v").combine_chunks(), np.float64), np.where(t.column("first").to_numpy(zero_copy_only=False), 1.0, -1.0)
        found = solve(kernel(x, x, gamma), s, np.zeros(len(s)), s, c, 0.05)
        return pa.table([t.column("row_id"), t.column("pair"), pa.array(found)], names=["row_id", "pair", "alpha"])

    def changed(moves):
        """The state after moves: pair -> (row ids, weights, signed changes, vectors)."""

        def run(batches):
            import pyarrow as pa

            for b in batches:
                if not b.num_rows:
                    continue
                ids, y, x, alpha, total = state(b)
                alpha, total = alpha.copy(), total.copy()
                for p, (at, new, add, vectors) in moves.value.items():
                    mine = np.flatnonzero((y == at_first[p]) | (y == at_second[p]))
                    total[mine, p] += summed(x[mine], vectors, add, gamma)
                    spot = np.minimum(np.searchsorted(at, ids), len(at) - 1)
                    hit = at[spot] == ids
                    alpha[hit, p] = new[spot[hit]]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], _lists(alpha), _lists(total)], ["row_id", "y", "v", "alpha", "total"])

        return run

    def started():
        """The state after each block of each pair has solved its own problem."""
        count = lambda p, q: -(-(sizes[p] + sizes[q]) // working)
        with_class = [F.when(F.col("y").isin(p, q), F.struct(F.lit(i).alias("pair"), (F.col("y") == p).alias("first"), F.pmod(F.xxhash64("row_id", F.lit(2)), F.lit(count(p, q))).alias("block"))) for i, (p, q) in enumerate(pairs)]
        dealt = own.select("row_id", "v", F.explode(F.filter(F.array(*with_class), lambda z: z.isNotNull())).alias("z")).select("row_id", "v", "z.*")
        weights = dealt.groupBy("pair", "block").applyInArrow(start, "row_id long, pair int, alpha double").filter("alpha > 0")
        weights = weights.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("pair", "alpha"))).alias("w"))  # a pair once a row
        alpha = F.transform(F.sequence(F.lit(0), F.lit(len(pairs) - 1)), lambda p: F.coalesce(F.try_element_at("w", p), F.lit(0.0)))
        given = settled(own.join(weights, "row_id", "left").select("row_id", "y", "v", alpha.alias("alpha")).repartition(parts, "row_id"))
        total = _sums(own, given.filter(F.exists("alpha", lambda z: z > 0)), blocks_of(rows_of_all, rows_of_all, d), d, pairs, gamma)
        return given.join(total, "row_id").select("row_id", "y", "v", "alpha", "total").repartition(parts, "row_id")

    for done in range(cfg.rounds + 1):
        by_side = rows.mapInArrow(ends, "pair int, side int, gap array<double>, row_id array<long>").groupBy("pair", "side")
        limits: dict[int, list] = {p: [(-np.inf, -np.inf, 0)] * 2 for p in range(len(pairs))}
        for r in by_side.applyInArrow(end, "pair int, side int, most double, gap double, row_id long").collect():  # two rows for each pair
            limits[r["pair"]][r["side"]] = r["most"], r["gap"], r["row_id"]
        violation = [up[0] + low[0] for up, low in limits.values()]
        if max(violation) < cfg.tolerance:
            support = rows.filter(F.exists("alpha", lambda z: z > 0))
            tested = settled(side(test).repartition(parts, "row_id"))
            total = _sums(tested, support, blocks_of(tested.count(), rows_of_all, d), d, pairs, gamma)
            return Fitted(rows, tested.select("row_id", "y").join(total, "row_id"), pairs, [(up[0] - low[0]) / 2 for up, low in limits.values()], violation, done)
        if done == cfg.rounds:
            break
        before = rows
        if done == 0:
            rows = settled(started())
        else:
            within = {p: [(up[1], up[2]), (low[1], low[2])] for p, (up, low) in limits.items() if violation[p] >= cfg.tolerance}
            sets = rows.mapInArrow(worst(within), "pair int, row_id long, s double, alpha double, e double, v array<double>")
            got = sets.groupBy("pair").applyInArrow(improve, "pair int, row_id long, alpha double, add double, v array<double>").toArrow()  # `working` rows for each pair
            rows = rows.mapInArrow(changed(train.sparkSession.sparkContext.broadcast(_by_pair(got))), rows.schema)
            rows = settled(rows) if done % cfg.settle == 0 else rows.cache()
            rows.count()
        before.unpersist()
    raise RuntimeError(f"weights have not converged after {cfg.rounds} rounds")


def _first(most: int, gap: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest gaps (ties by id) with their ids."""
    order = np.lexsort((ids, -gap))[:most]
    return gap[order], ids[order]


def _by_pair(t) -> dict[int, tuple[np.ndarray, ...]]:
    """pair -> row ids (in order), weights, signed changes, vectors."""
    t = t.sort_by([("pair", "ascending"), ("row_id", "ascending")]).combine_chunks()
    if not len(t):
        return {}
    pair, x = t.column("pair").to_numpy(), matrix(t.column("v").combine_chunks(), np.float64)
    ids, new, add = (t.column(n).to_numpy() for n in ("row_id", "alpha", "add"))
    return {int(p): tuple(a[pair == p] for a in (ids, new, add, x)) for p in np.unique(pair)}


def predict(train: DataFrame, test: DataFrame, features: list[int], cfg: KernelConfig = KernelConfig()) -> DataFrame:
    """row_id, y, pred of the test rows."""
    return fit(train, test, features, cfg).predictions()
