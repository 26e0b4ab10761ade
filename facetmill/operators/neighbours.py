"""Mutual information of continuous features with a label by nearest neighbours, and greedy selection by joint information.

With d the distance of a row to its k-th nearest of its own class and m the number of other rows within d,
I = psi(n) - mean psi(size of the class) + psi(k) - mean psi(m).

One feature: equal values of a class are one cell with a count. Cells sorted by feature, class and value get their rank
from counts by partition; blocks of ranks, with k cells of the next blocks on either side, hold all k-th neighbours. The
counts within a distance are differences of running sums over the values of a feature, sorted together with the ends of
the intervals. No column, class or value is held in one task.

Two features: blocks of rows meet blocks of rows, once for the k nearest distances and once for the counts, for all
candidates beside a chosen feature at a time. That is n * n / block pairs of rows, meant for pools of features after a
screen and tables of up to some hundred thousand rows.
"""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import no_nan
from .information import matrix


def digamma(x: Column) -> Column:
    """For x of 1 and more: the asymptotic series ten places on."""
    z = x + 10.0
    return F.ln(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8) - sum((1 / (x + float(i)) for i in range(1, 10)), 1 / x)


def neighbours_for(df: DataFrame, most: int = 5) -> int:
    """k: at most `most`, below the size of the smallest class; an error where that leaves less than two."""
    least = df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n")).first()["n"]  # one row
    k = min(most, (least or 0) - 1)
    if k < 2:
        raise ValueError(f"nearest neighbours need three rows of every class; the smallest has {least or 0}")
    return k


def settled(df: DataFrame) -> DataFrame:
    """df as written to the folder that driver and executors share: a repeated task sees the same order and partitions."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="sorted-"))
    return df.checkpoint()


def running(df: DataFrame, by: list[str], order: list[str], weight: str) -> DataFrame:
    """Adds before: the sum of a weight (long) over the rows of the same `by` (ints) that stand earlier by `order`.

    Rows are sorted over partitions of ranges; tasks add up their own, and sums by partition say what stands before.
    """
    names = df.columns
    places, w = [names.index(c) for c in by], names.index(weight)

    def run(batches):
        import pyarrow as pa

        part, last, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy() for i in places], axis=1)
            add = b.column(w).to_numpy()
            new = np.append(last is None or (keys[0] != last).any(), (keys[1:] != keys[:-1]).any(axis=1))
            first = np.flatnonzero(new)
            sums = np.cumsum(add) - add
            base = np.zeros(len(add), np.int64)
            base[first] = np.diff(sums[first], prepend=0)
            inside = sums - np.cumsum(base)
            if not new[0]:
                inside[: first[0] if len(first) else len(add)] += total
            total, last = int(inside[-1] + add[-1]), keys[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(inside), pa.array(np.full(len(add), part, np.int32))], [*names, "_in", "_p"])

    spark = df.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by, *order).sortWithinPartitions(*by, *order)
    rows = settled(dealt.mapInArrow(run, f"{kinds}, _in long, _p int"))
    of = rows.groupBy(*by, "_p").agg(F.sum(weight).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    of = of.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return rows.join(of, [*by, "_p"]).withColumn("before", F.col("_in") + F.col("_off")).select(*names, "before")


def information(df: DataFrame, features: list[int], k: int | None = None, block: int = 50_000) -> DataFrame:
    """feature_id, mi of each feature with the label (x, y); constant features have no row."""
    df = no_nan(df)
    k = k or neighbours_for(df)
    n = df.count()
    picked = df.select(F.col("y").cast("int"), F.explode(F.arrays_zip(F.array(*map(F.lit, features)).alias("j"), F.array(*[F.col("x")[j] + 0.0 for j in features]).alias("v"))).alias("e"))
    cells = picked.groupBy(F.col("e.j").alias("j"), "y", F.col("e.v").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranked = running(cells.withColumn("one", F.lit(1).cast("long")), ["j", "y"], ["v"], "one").withColumnRenamed("before", "r")
    at, inside = F.floor(F.col("r") / block), F.col("r") % block
    spots = F.filter(F.array(at, F.when(inside < k, at - 1), F.when(inside >= block - k, at + 1)), lambda b: b.isNotNull() & (b >= 0))
    held = ranked.select("j", "y", "v", "c", at.alias("own"), F.explode(spots).alias("b"))

    def radius(t):
        import pyarrow as pa

        t = t.sort_by("v")
        v, c = t.column("v").to_numpy(), t.column("c").to_numpy()
        far, many = [np.zeros(len(v))], [c - 1]
        for o in range(1, k + 1):
            gap = np.full(len(v), np.inf)
            gap[o:] = v[o:] - v[:-o]
            other = np.zeros(len(v), np.int64)
            other[o:] = c[:-o]
            far.append(gap)
            many.append(other)
            back, other = np.full(len(v), np.inf), np.zeros(len(v), np.int64)
            back[: max(0, len(v) - o)] = gap[o:]
            other[: max(0, len(v) - o)] = c[o:]
            far.append(back)
            many.append(other)
        far, many = np.stack(far, axis=1), np.stack(many, axis=1)
        by = np.argsort(far, axis=1, kind="stable")
        far, sums = np.take_along_axis(far, by, axis=1), np.cumsum(np.take_along_axis(many, by, axis=1), axis=1)
        d = far[np.arange(len(v)), np.argmax(sums >= k, axis=1)]
        slack = np.where(d > 0, 2 * np.spacing(np.maximum(np.abs(v), d)), 0.0)  # a difference and a sum are rounded
        down, up = v - d - slack, v + d + slack
        mine = t.column("own").to_numpy() == t.column("b").to_numpy()
        one = t.filter(pa.array(mine)).select(["j", "y", "v", "c"])
        return one.append_column("low", pa.array(down[mine])).append_column("high", pa.array(up[mine]))

    reach = held.groupBy("j", "y", "b").applyInArrow(radius, "j int, y int, v double, c long, low double, high double")
    ends = reach.select("j", "y", "v", "c", F.explode(F.array(F.struct(F.col("low").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("high").alias("at"), F.lit(2).alias("kind")))).alias("e"))
    none = F.lit(None)
    events = cells.groupBy("j", "v").agg(F.sum("c").alias("w")).select("j", F.col("v").alias("at"), F.lit(1).alias("kind"), "w", none.cast("int").alias("y"), none.cast("double").alias("v"), none.cast("long").alias("c"))
    events = events.unionByName(ends.select("j", "e.at", "e.kind", F.lit(0).cast("long").alias("w"), "y", "v", "c"))
    sums = running(events, ["j"], ["at", "kind"], "w").filter("kind <> 1")
    m = sums.groupBy("j", "y", "v", "c").agg((F.sum(F.when(F.col("kind") == 2, F.col("before")).otherwise(-F.col("before"))) - 1).alias("m"))
    within = m.groupBy("j").agg(F.sum(F.col("c") * digamma(F.col("m").cast("double"))).alias("s"), F.min("v").alias("low"), F.max("v").alias("high"))
    sizes = df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * digamma(F.col("n").cast("double"))).alias("own"))
    number = lambda v: digamma(F.lit(float(v)))
    return within.filter("low < high").crossJoin(sizes).select(F.col("j").alias("feature_id"), (number(n) - F.col("own") / n + number(k) - F.col("s") / n).alias("mi"))  # one row


def joint_information(df: DataFrame, chosen: int, candidates: list[int], k: int, block: int = 512) -> DataFrame:
    """feature_id, mi of each candidate together with a chosen feature, by Euclidean distances (row_id, x, y)."""
    n, f = df.count(), len(candidates)
    blocks = max(1, -(-n // block))
    row = lambda: df.select(F.pmod(F.xxhash64("row_id"), F.lit(blocks)).alias("a"), F.col("row_id").cast("long").alias("row_id"), F.col("y").cast("int").alias("y"), F.array(*[F.col("x")[j] for j in (chosen, *candidates)]).alias("v"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    right = lambda: row().select(every.alias("a"), "row_id", "y", "v", F.col("a").alias("b")).groupBy("a", "b")

    def gaps(t, o):
        """Squared distances of the rows of two blocks, candidate by candidate, infinite for a row and itself."""
        v, w = matrix(t.column("v").combine_chunks(), np.float64), matrix(o.column("v").combine_chunks(), np.float64)
        base = (v[:, :1] - w[:, 0]) ** 2
        base[t.column("row_id").to_numpy()[:, None] == o.column("row_id").to_numpy()] = np.inf
        for j in range(f):
            yield base + (v[:, j + 1, None] - w[:, j + 1]) ** 2

    def lists(values: np.ndarray):
        import pyarrow as pa

        return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel()))

    def best(t, o):
        import pyarrow as pa

        out = np.full((len(t), f, k), np.inf)
        if len(t) and len(o):
            other = t.column("y").to_numpy()[:, None] != o.column("y").to_numpy()
            for j, far in enumerate(gaps(t, o)):
                far[other] = np.inf
                least = np.partition(far, min(k, far.shape[1]) - 1, axis=1)[:, :k]
                out[:, j, : least.shape[1]] = least
        return pa.table([t.column("row_id").combine_chunks(), lists(out.reshape(len(t), f * k))], names=["row_id", "near"])

    def merged(t):
        import pyarrow as pa

        near = matrix(t.column("near").combine_chunks(), np.float64).reshape(len(t), f, k)
        least = np.sort(near.transpose(1, 0, 2).reshape(f, -1), axis=1)[:, k - 1]
        return pa.table([t.column("row_id").combine_chunks().slice(0, 1), lists(least[None, :])], names=["row_id", "far"])

    def within(t, o):
        import pyarrow as pa

        out = np.zeros((len(t), f), np.int64)
        if len(t) and len(o):
            reach = matrix(t.column("far").combine_chunks(), np.float64)
            for j, far in enumerate(gaps(t, o)):
                out[:, j] = (far <= reach[:, j, None]).sum(axis=1)
        return pa.table([t.column("row_id").combine_chunks(), lists(out)], names=["row_id", "m"])

    left = row().select("*", every.alias("b")).groupBy("a", "b")
    near = left.cogroup(right()).applyInArrow(best, "row_id long, near array<double>")
    far = settled(near.groupBy("row_id").applyInArrow(merged, "row_id long, far array<double>"))
    reach = row().join(far, "row_id").select("a", "row_id", "y", "v", "far", every.alias("b")).groupBy("a", "b")
    counts = reach.cogroup(right()).applyInArrow(within, "row_id long, m array<long>")
    m = counts.select("row_id", F.posexplode("m").alias("i", "m")).groupBy("row_id", "i").agg(F.sum("m").alias("m"))
    mean = m.groupBy("i").agg(F.avg(digamma(F.col("m").cast("double"))).alias("s"))
    sizes = df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).agg((F.sum(F.col("n") * digamma(F.col("n").cast("double"))) / n).alias("own"))
    number = lambda v: digamma(F.lit(float(v)))
    names = F.array(*map(F.lit, candidates))
    return mean.crossJoin(sizes).select(F.get(names, F.col("i")).alias("feature_id"), (number(n) - F.col("own") + number(k) - F.col("s")).alias("mi"))  # one row


def by_joint_information(df: DataFrame, features: list[int], m: int, k: int | None = None, digits: int = 9) -> list[int]:
    """Greedy: first the most informative feature, then the one whose least joint information with a chosen one is largest
    (ties by id). Constant features are left out."""
    df = no_nan(df)
    k = k or neighbours_for(df)
    alone = {r["feature_id"]: r["mi"] for r in information(df, features, k).collect()}  # a row for each feature
    left, order = sorted(alone), []
    least = dict.fromkeys(left, float("inf"))
    while left and len(order) < m:
        score = least if order else alone
        pick = max(left, key=lambda j: (round(score[j], digits), -j))
        order.append(pick)
        left.remove(pick)
        if left and len(order) < m:
            for r in joint_information(df, pick, left, k).collect():  # a row for each feature that is left
                least[r["feature_id"]] = min(least[r["feature_id"]], r["mi"])
    return order
