"""Bootstrap replicates as weights: every row stands in each replicate as often as a Poisson count of mean 1 says, and one
pass over the rows counts the cells of all replicates.

The counts come from a hash of seed and row id: the same on any number of partitions, for a repeated task, and in SQL. One
digest holds the draws of eight replicates, 16 bits each. What leaves a task is a vector of counts for each cell that
occurs; entropies follow for all replicates at once.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .information import entropies, matrix

#: Draws of 16 bits below these have counts below 1, 2, ...: the distribution function of a Poisson variable of mean 1.
STEPS = [math.floor(65536 * p) for p in itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(8))]


def poisson_counts(key: Column, seed: int, replicates: int) -> Column:
    """An array with the count of each replicate."""
    digests = [F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"), F.lit(f"|{b}"))) for b in range(-(-replicates // 8))]
    digits = F.concat(*digests)
    draw = lambda i: F.conv(F.substr(digits, 4 * i + 1, F.lit(4)), 16, 10).cast("int")
    count = lambda u: sum((F.when(u >= s, 1).otherwise(0) for s in STEPS), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda i: count(draw(i)))


def weighted(df: DataFrame, replicates: int, seed: int, key: str = "row_id") -> DataFrame:
    return df.withColumn("w", poisson_counts(F.col(key), seed, replicates))


def joint_counts(df: DataFrame, subsets: list[tuple[int, ...]], width: int, replicates: int, wanted: list[list[int]] | None = None, rows: int = 100_000) -> DataFrame:
    """replicate, s, k, y, c of rows with codes, y and w; wanted: the replicates that need each subset (all, if not given)."""
    if subsets and max(width, 1) ** max(map(len, subsets)) >= 1 << 62:
        raise ValueError(f"tuples of {max(map(len, subsets))} codes below {width} have more values than 62 bits")

    def run(batches):
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def told():
            codes, y, w = (np.concatenate(x) for x in zip(*held))
            held.clear()
            labels, y = np.unique(y, return_inverse=True)
            for s, members in enumerate(subsets):
                k = np.zeros(len(codes), np.int64)
                for j in members:
                    k = k * width + codes[:, j]
                order = np.lexsort((y, k))
                k, of = k[order], y[order]
                first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (of[1:] != of[:-1])))
                pick = list(range(replicates)) if wanted is None else wanted[s]
                sums = np.add.reduceat(w[order][:, pick], first, axis=0, dtype=np.int64)
                cell, at = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(pick, np.int32)[at]), pa.array(np.full(len(at), s, np.int32)), pa.array(k[first][cell]), pa.array(labels[of[first][cell]].astype(np.int32)), pa.array(sums[cell, at])], ["replicate", "s", "k", "y", "c"])

        n = 0
        for b in batches:
            if b.num_rows:
                held.append((matrix(b.column(0), np.int32), b.column(1).to_numpy(), matrix(b.column(2), np.int32)))
                n += b.num_rows
            if n >= rows:
                yield from told()
                n = 0
        if n:
            yield from told()

    cells = df.select("codes", F.col("y").cast("int"), "w").mapInArrow(run, "replicate int, s int, k long, y int, c long")
    return cells.groupBy("replicate", "s", "k", "y").agg(F.sum("c").alias("c"))


def label_counts(df: DataFrame) -> DataFrame:
    """replicate, y, c."""
    return df.select("y", F.posexplode("w").alias("replicate", "c")).groupBy("replicate", "y").agg(F.sum("c").alias("c")).filter("c > 0")


def joint_entropies(df: DataFrame, subsets: list[tuple[int, ...]], width: int, replicates: int, estimator: str = "plugin", wanted: list[list[int]] | None = None) -> DataFrame:
    """replicate, and the columns of information.joint_entropies, of every subset that a replicate needs."""
    cells = joint_counts(df, subsets, width, replicates, wanted)
    return entropies(cells, label_counts(df), subsets, estimator, ("replicate",))
