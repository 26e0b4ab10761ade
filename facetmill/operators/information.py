"""Entropies and what follows from them, by counting packed code tuples of many feature subsets in one aggregation."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import EPS, normalized

def joint_counts(df: DataFrame, subsets: list[tuple[int, ...]], width: int, rows: int = 200_000, edges: list[list[float]] | None = None) -> DataFrame:
    """s, k, y, c: how often each tuple of codes (packed to k) of each subset s meets each label.

    df: codes and y, or x and y with the edges of x, which the same worker then codes: one Python worker for a task, not two.
    Every task keeps the codes of some `rows` rows as one matrix and counts them subset by subset with a histogram; only
    cells that occur leave the task, and equal cells of several tasks are added up.
    """
    if subsets and max(width, 1) ** max(map(len, subsets)) >= 1 << 62:
        raise ValueError(f"tuples of {max(map(len, subsets))} codes below {width} have more values than 62 bits")

    def coded(column):
        from . import discretize

        return matrix(column, np.int32) if edges is None else discretize.coded(matrix(column, np.float64), edges, list(range(len(edges))))

    def run(batches):
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray]] = []

        def told():
            codes, y = (np.concatenate(x) for x in zip(*held))
            held.clear()
            labels, y = np.unique(y, return_inverse=True)
            for s, members in enumerate(subsets):
                k = np.zeros(len(codes), np.int64)
                for j in members:
                    k = k * width + codes[:, j]
                cells = width ** len(members) * len(labels)
                if cells <= 4 * len(k) + 65_536:
                    c = np.bincount(k * len(labels) + y, minlength=cells)
                    at = np.flatnonzero(c)
                    c = c[at]
                else:
                    seen, number = np.unique(k, return_inverse=True)
                    at, c = np.unique(number * len(labels) + y, return_counts=True)
                    at = seen[at // len(labels)] * len(labels) + at % len(labels)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int32)), pa.array(at // len(labels)), pa.array(labels[at % len(labels)].astype(np.int32)), pa.array(c.astype(np.int64))], ["s", "k", "y", "c"])

        n = 0
        for b in batches:
            if b.num_rows:
                held.append((coded(b.column(0)), b.column(1).to_numpy()))
                n += b.num_rows
            if n >= rows:
                yield from told()
                n = 0
        if n:
            yield from told()

    cells = df.select("codes" if edges is None else "x", F.col("y").cast("int")).mapInArrow(run, "s int, k long, y int, c long")
    return cells.groupBy("s", "k", "y").agg(F.sum("c").alias("c"))


def matrix(column, kind) -> np.ndarray:
    """The rows of an Arrow column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def joint_entropies(df: DataFrame, subsets: list[tuple[int, ...]], width: int, estimator: str = "plugin", edges: list[list[float]] | None = None) -> DataFrame:
    """subset_id, order, members, n, h_x, h_xy, h_y, k_x of every subset of codes and the label y; edges: as for joint_counts.

    One tree of aggregations carries counts and sums of c ln c from tuples with label to tuples to subsets.
    """
    return entropies(joint_counts(df, subsets, width, edges=edges), df.groupBy("y").agg(F.count(F.lit(1)).alias("c")), subsets, estimator)


def entropies(cells: DataFrame, labels: DataFrame, subsets: list[tuple[int, ...]], estimator: str = "plugin", by: tuple[str, ...] = ()) -> DataFrame:
    """The entropies of cells (s, k, y, c) and labels (y, c); by: columns of both that tell several such tables apart."""
    spark = cells.sparkSession
    by_key = cells.groupBy(*by, "s", "k").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.ln("c")).alias("t"), F.count(F.lit(1)).alias("q"))
    per = by_key.groupBy(*by, "s").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("a"), F.sum("t").alias("b"), F.count(F.lit(1)).alias("k_x"), F.sum("q").alias("k_xy"))
    label = labels.groupBy(*by).agg(F.sum("c").alias("ny"), F.sum(F.col("c") * F.ln("c")).alias("ty"), F.count(F.lit(1)).alias("k_y"))
    more = lambda k: (F.col(k) - 1) / (2 * F.col("n")) if estimator == "miller_madow" else F.lit(0.0)
    if estimator not in ("plugin", "miller_madow"):
        raise ValueError(f"unknown estimator {estimator!r}")
    log = F.ln("n")
    names = spark.createDataFrame([(i, len(m), list(m)) for i, m in enumerate(subsets)], "s int, order int, members array<int>")
    both = per.join(F.broadcast(label), list(by)) if by else per.crossJoin(F.broadcast(label))  # a row for each table of cells
    out = both.join(F.broadcast(names), "s")  # the plan's own list
    return out.select(*by, F.col("s").alias("subset_id"), "order", "members", "n", (log - F.col("a") / F.col("n") + more("k_x")).alias("h_x"), (log - F.col("b") / F.col("n") + more("k_xy")).alias("h_xy"), (log - F.col("ty") / F.col("n") + more("k_y")).alias("h_y"), "k_x")


def with_nmi(h: DataFrame) -> DataFrame:
    """Adds mi and nmi with the label."""
    mi = F.greatest(F.lit(0.0), F.col("h_x") + F.col("h_y") - F.col("h_xy"))
    return h.withColumn("mi", mi).withColumn("nmi", normalized(mi, F.col("h_x"), F.col("h_y")))


def singles(d: int) -> list[tuple[int, ...]]:
    return [(j,) for j in range(d)]


def pairs(d: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(d), 2))


def marginals(h: DataFrame) -> DataFrame:
    return h.filter("order = 1").select(F.col("members")[0].alias("feature_id"), F.col("h_x").alias("h"))


def pairwise_nmi_mean(h: DataFrame, d: int) -> DataFrame:
    """feature_id, redundancy: mean NMI with the other features; each unordered pair is counted once and mirrored."""
    m = marginals(h)
    p = h.filter("order = 2").select(F.col("members")[0].alias("a"), F.col("members")[1].alias("b"), "h_x")
    p = p.join(m.select(F.col("feature_id").alias("a"), F.col("h").alias("ha")), "a").join(m.select(F.col("feature_id").alias("b"), F.col("h").alias("hb")), "b")
    v = normalized(F.col("ha") + F.col("hb") - F.col("h_x"), F.col("ha"), F.col("hb"))
    both = p.select(F.explode(F.array(F.struct(F.col("a").alias("feature_id"), v.alias("v")), F.struct(F.col("b").alias("feature_id"), v.alias("v")))).alias("e")).select("e.*")
    mean = both.groupBy("feature_id").agg((F.sum("v") / max(1, d - 1)).alias("redundancy"))
    return m.select("feature_id").join(mean, "feature_id", "left").withColumn("redundancy", F.coalesce("redundancy", F.lit(0.0)))


def mean_correlation(df: DataFrame, d: int) -> DataFrame:
    """feature_id, redundancy: mean over all d features of |Pearson| of codes, the feature itself counting as 0."""

    def run(batches):
        import pyarrow as pa

        n, sums, products = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            x = matrix(b.column(0), np.float64) if b.num_rows else np.zeros((0, d))
            n, sums, products = n + len(x), sums + x.sum(axis=0), products + x.T @ x
        i, j = (a.ravel() for a in np.indices((d, d)))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.full(d * d, n)), pa.array(sums[i]), pa.array(sums[j]), pa.array(products.ravel()), pa.array(np.diag(products)[i]), pa.array(np.diag(products)[j])], ["i", "j", "n", "a", "b", "ab", "aa", "bb"])

    # Sums of integer codes: exact, whatever the order.
    t = df.select("codes").mapInArrow(run, "i long, j long, n long, a double, b double, ab double, aa double, bb double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "ab", "aa", "bb")])
    room = (F.col("n") * F.col("aa") - F.col("a") * F.col("a")) * (F.col("n") * F.col("bb") - F.col("b") * F.col("b"))
    v = F.when((F.col("i") != F.col("j")) & (room > 0), F.abs(F.col("n") * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt(room)).otherwise(0.0)
    return t.groupBy(F.col("i").cast("int").alias("feature_id")).agg((F.sum(v) / d).alias("redundancy"))


def marginal_association(df: DataFrame, feature: int, bins: int = 5) -> float:
    """NMI of one feature's quantile codes with the label (row_id, x, y): near 0 where a feature matters in company only."""
    from . import discretize

    one = df.select("row_id", F.array(F.col("x")[feature]).alias("x"), "y")
    edges = discretize.fit(one, 1, bins)
    return with_nmi(joint_entropies(discretize.encode(one, edges), [(0,)], discretize.width(edges))).first()["nmi"]  # one row


def marginal_associations(df: DataFrame, d: int, bins: int = 5) -> dict[int, float]:
    """feature -> marginal_association of each of d features, by one fit and one count of all."""
    from . import discretize

    edges = discretize.fit(df, d, bins)
    h = with_nmi(joint_entropies(df, singles(d), discretize.width(edges), edges=edges))
    return {r["subset_id"]: r["nmi"] for r in h.select("subset_id", "nmi").collect()}  # a row for each feature


def group_evidence(h: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Of subsets of two and more: nmi, tc (total correlation), redundancy (tc over its largest possible value), legacy.

    A redundancy outside [0, 1] by more than the tolerance is an error.
    """
    m = marginals(h)
    parts = h.filter("order > 1").select("subset_id", F.explode("members").alias("feature_id")).join(m, "feature_id").groupBy("subset_id").agg(F.sum("h").alias("h_sum"), F.max("h").alias("h_max"))
    g = with_nmi(h.filter("order > 1")).join(parts, "subset_id")
    tc = F.greatest(F.lit(0.0), F.col("h_sum") - F.col("h_x"))
    room = F.col("h_sum") - F.col("h_max")
    raw = F.when(room > EPS, tc / room).otherwise(F.lit(0.0))
    checked = F.when((raw < -tolerance) | (raw > 1 + tolerance), F.raise_error(F.lit("redundancy outside [0, 1]")).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
    legacy = F.least(F.lit(1.0), F.greatest(F.lit(0.0), tc / (F.col("h_sum") + EPS)))
    return g.withColumn("tc", tc).withColumn("room", room).withColumn("clipped", (raw < 0) | (raw > 1)).withColumn("redundancy", checked).withColumn("legacy", legacy)
