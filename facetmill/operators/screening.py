"""Feature screens: a score for each feature, the best f in order of their ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import no_nan
from .evaluation import VALUES, blocks_of, every, near_lists, place
from .information import joint_entropies, matrix, singles, with_nmi


def mi_scores(codes: DataFrame, d: int, width: int) -> DataFrame:
    """feature_id, score: NMI with the label (plug-in)."""
    return with_nmi(joint_entropies(codes, singles(d), width)).select(F.col("members")[0].alias("feature_id"), F.col("nmi").alias("score"))


def anova_scores(df: DataFrame, d: int) -> DataFrame:
    """feature_id, score: F statistic of the classes; 0 where it is not defined (one class, or no variance inside classes).

    Every task gives size, mean and squared deviations of each class in its rows; these are merged by their distances from
    the means of classes and of all rows, so a large common offset of a feature costs no digits.
    """

    def run(batches):
        import pyarrow as pa

        state: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, y = matrix(b.column(0), np.float64), b.column(1).to_numpy()
            for c in np.unique(y):
                own = x[y == c]
                n, mean = len(own), own.mean(axis=0)
                spread = ((own - mean) ** 2).sum(axis=0)
                if c in state:
                    m, before, gone = state[c]
                    gap = mean - before
                    n, mean, spread = m + n, before + gap * (n / (m + n)), gone + spread + gap * gap * (m * n / (m + n))
                state[c] = n, mean, spread
        for c, (n, mean, spread) in state.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, c, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n, np.int64)), pa.array(mean), pa.array(spread)], ["y", "feature_id", "n", "mean", "spread"])

    parts = no_nan(df).select("x", F.col("y").cast("int")).mapInArrow(run, "y int, feature_id int, n long, mean double, spread double")
    own, every = Window.partitionBy("feature_id", "y"), Window.partitionBy("feature_id")  # a row for each task and class
    mean_of = lambda w: F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    e = parts.select("*", mean_of(own).alias("m"), mean_of(every).alias("g"))
    e = e.groupBy("feature_id", "y").agg(F.sum("n").alias("n"), F.sum(F.col("spread") + F.col("n") * (F.col("mean") - F.col("m")) ** 2).alias("w"), F.first("m").alias("m"), F.first("g").alias("g"))
    f = e.groupBy("feature_id").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("b"))
    score = (F.col("b") / (F.col("c") - 1)) / (F.col("w") / (F.col("n") - F.col("c")))
    return f.select("feature_id", F.when((F.col("c") > 1) & (F.col("n") > F.col("c")) & (F.col("w") > 0), score).otherwise(0.0).alias("score"))


def relieff_scores(df: DataFrame, d: int, k: int | None = None) -> DataFrame:
    """feature_id, score: ReliefF over all rows. k nearest hits and k nearest misses of every other class by the sum of scaled gaps.

    A feature gains by its gaps to misses (each class by its share among the other classes) and loses by its gaps to hits,
    averaged over neighbours and rows; gaps are scaled by the feature's range. k: min(10, max(2, rows // 10)).
    """
    df = no_nan(df)
    n = df.count()
    k = k or min(10, max(2, n // 10))
    ends = df.select(F.posexplode("x")).groupBy("pos").agg(F.min("col").alias("low"), F.max("col").alias("high")).orderBy("pos").collect()  # a row for each feature
    unit = F.array(*[(F.col("x")[r["pos"]] - F.lit(r["low"])) / F.lit((r["high"] - r["low"]) or 1.0) for r in ends])
    scaled = df.select("row_id", "y", unit.alias("x"))
    share = {r["y"]: r["c"] / n for r in df.groupBy("y").agg(F.count(F.lit(1)).alias("c")).collect()}  # a row for each class
    sizes = blocks_of(n, n, d)
    near = near_lists(scaled, scaled, list(range(d)), k, sizes, by_class=True, metric="gap").drop("y", "far")
    parts = max(-(-n * d // VALUES), min(sizes[0], -(-12 // sizes[1])))  # tiles of far less work: fewer copies of rows
    left = near.join(scaled, "row_id").select(place("row_id", parts).alias("a"), "b", "y", "x", "n_id", "n_y", "many").groupBy("a", "b")
    right = scaled.select(every(parts).alias("a"), place("row_id", sizes[1]).alias("b"), F.col("row_id").cast("long").alias("n_id"), "x").groupBy("a", "b")

    def run(t, o):
        """The weighted gaps of rows of a block to those of their nearest that lie in another."""
        import pyarrow as pa

        total = np.zeros(d)
        if len(t) and len(o):
            x, w, ids = matrix(t.column("x").combine_chunks(), np.float64), matrix(o.column("x").combine_chunks(), np.float64), o.column("n_id").to_numpy()
            flat = lambda name: t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            i = np.repeat(np.arange(len(t)), np.diff(t.column("n_id").combine_chunks().offsets.to_numpy()))
            order = np.argsort(ids)
            j = order[np.searchsorted(ids[order], flat("n_id"))]
            y, n_y = t.column("y").to_numpy()[i], flat("n_y")
            part = lambda classes: np.array([share[c] for c in np.unique(classes)])[np.unique(classes, return_inverse=True)[1]]
            weight = np.where(n_y == y, -1.0, part(n_y) / np.maximum(1 - part(y), 1e-300)) / flat("many") / n
            for at in range(0, len(i), 16_384):
                total += weight[at : at + 16_384] @ np.abs(x[i[at : at + 16_384]] - w[j[at : at + 16_384]])
        return pa.table([pa.array(range(d), pa.int32()), pa.array(total)], names=["feature_id", "s"])

    return left.cogroup(right).applyInArrow(run, "feature_id int, s double").groupBy("feature_id").agg(F.sum("s").alias("score"))


def top(scores: DataFrame, f: int, digits: int = 9) -> DataFrame:
    """The f best features (ties by id) with their rank; scores are compared rounded so that sums in another order don't matter."""
    order = Window.orderBy(F.round("score", digits).desc(), "feature_id")  # one row a feature
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= f)


def union(first: DataFrame, second: DataFrame, f: int, share: float = 0.5) -> DataFrame:
    """feature_id, score: the best share of f by the first score and the best rest by the second; 2 d - smallest rank. At least one of each."""
    k = max(1, round(f * share))
    a, b = top(first, k).select("feature_id", F.col("rank").alias("a")), top(second, max(1, f - k)).select("feature_id", F.col("rank").alias("b"))
    d = first.count()
    return a.join(b, "feature_id", "full_outer").select("feature_id", (2.0 * d - F.least(F.coalesce("a", F.lit(2 * d)), F.coalesce("b", F.lit(2 * d)))).alias("score"))
