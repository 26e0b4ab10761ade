"""Stability of selections over runs: tables of (run, selected array)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import jaccard, kuncheva


def pairwise(selections: DataFrame, d: int) -> DataFrame:
    """run_a, run_b, jaccard, kuncheva of every pair of runs."""
    a, b = selections.select(F.col("run").alias("run_a"), F.col("selected").alias("a")), selections.select(F.col("run").alias("run_b"), F.col("selected").alias("b"))
    return a.join(b, F.col("run_a") < F.col("run_b")).select("run_a", "run_b", jaccard(F.col("a"), F.col("b")).alias("jaccard"), kuncheva(F.col("a"), F.col("b"), d).alias("kuncheva"))


def frequency(selections: DataFrame, d: int) -> DataFrame:
    """feature_id, count, runs; ids outside [0, d) are ignored."""
    m = selections.agg(F.count(F.lit(1)).alias("runs"))
    f = selections.select("run", F.explode(F.array_distinct("selected")).alias("feature_id")).filter(f"feature_id >= 0 and feature_id < {d}").groupBy("feature_id").agg(F.count(F.lit(1)).alias("count"))
    return f.crossJoin(F.broadcast(m))  # one row


def nogueira(selections: DataFrame, d: int) -> DataFrame:
    """One row: 1 - mean variance of the selection indicators over that of a random selection of the same mean size; null at the ends."""
    p = F.col("count") / F.col("runs")
    s = frequency(selections, d).agg(F.sum(p).alias("k"), F.sum(p * (1 - p)).alias("v"))
    k = F.col("k") / d
    return s.select(F.when((F.col("k") > 0) & (F.col("k") < d), 1 - (F.col("v") / d) / (k * (1 - k))).alias("nogueira"))


def summary(selections: DataFrame, d: int) -> DataFrame:
    std = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    p = pairwise(selections, d).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("jaccard").alias("jaccard_mean"), std("jaccard").alias("jaccard_std"), F.avg("kuncheva").alias("kuncheva_mean"), std("kuncheva").alias("kuncheva_std"))
    return p.crossJoin(nogueira(selections, d))  # one row each


def consensus(selections: DataFrame, d: int, m: int) -> DataFrame:
    """The m features that most runs select (ties by id)."""
    f = frequency(selections, d).withColumn("frequency", F.col("count") / F.col("runs"))
    return f.withColumn("rank", F.row_number().over(Window.orderBy(F.col("count").desc(), "feature_id"))).filter(F.col("rank") <= m).select("rank", "feature_id", "frequency")
