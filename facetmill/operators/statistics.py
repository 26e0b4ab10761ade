"""Paired comparisons of methods over datasets: long tables (dataset, method, score); a missing score is null."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def average_rank(order: Column, by: list[str]) -> Column:
    """Ranks with the mean for ties."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(w.partitionBy(*by, order)) - 1) / 2.0


def mean_scores(runs: DataFrame) -> DataFrame:
    return runs.withColumn("score", finite(F.col("score"))).groupBy("dataset", "method").agg(F.avg("score").alias("score"))


def pairs(means: DataFrame, reference: str) -> DataFrame:
    """dataset, method, a (reference), b, diff where both have a score."""
    ref = means.filter(F.col("method") == reference).select("dataset", F.col("score").alias("a"))
    return means.filter(F.col("method") != reference).join(ref, "dataset").withColumnRenamed("score", "b").filter("a is not null and b is not null").withColumn("diff", F.col("a") - F.col("b"))


def descriptives(means: DataFrame, reference: str) -> DataFrame:
    return pairs(means, reference).groupBy("method").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("a").alias("reference_mean"), F.avg("b").alias("method_mean"), F.avg("diff").alias("mean_difference"), F.percentile("diff", F.lit(0.5)).alias("median_difference"), F.array_join(F.array_sort(F.collect_list("dataset")), ";").alias("paired_datasets"))


def signed_ranks(means: DataFrame, reference: str, digits: int = 12) -> DataFrame:
    """method, r_plus, r_minus, statistic (the smaller), n (non-zero differences), rank_biserial, ties (sum of t^3 - t over tied differences)."""
    d = pairs(means, reference).withColumn("m", F.round(F.abs("diff"), digits)).filter("m > 0")
    r = d.withColumn("r", average_rank(F.col("m"), ["method"]))
    s = r.groupBy("method").agg(F.sum(F.when(F.col("diff") > 0, F.col("r")).otherwise(0.0)).alias("r_plus"), F.sum(F.when(F.col("diff") < 0, F.col("r")).otherwise(0.0)).alias("r_minus"), F.count(F.lit(1)).alias("n"))
    t = d.groupBy("method", "m").agg(F.count(F.lit(1)).alias("t")).groupBy("method").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    s = s.join(t, "method")
    return s.withColumn("statistic", F.least("r_plus", "r_minus")).withColumn("rank_biserial", (F.col("r_plus") - F.col("r_minus")) / (F.col("r_plus") + F.col("r_minus")))


@lru_cache(maxsize=64)
def _sums(n: int) -> tuple[int, ...]:
    """Number of sign patterns of ranks 1..n by the sum of the positive ones."""
    ways = [1]
    for r in range(1, n + 1):
        ways = [(ways[i] if i < len(ways) else 0) + (ways[i - r] if 0 <= i - r < len(ways) else 0) for i in range(len(ways) + r)]
    return tuple(ways)


def signed_rank_p(statistic: float | None, n: int, pairs: int | None = None, ties: int = 0) -> float | None:
    """Two-sided p of the smaller rank sum of n non-zero differences of `pairs` pairs.

    None below two pairs, 1 if all differences are zero; exact up to 50 differences without ties and zeros, else by the
    normal curve with the correction for ties.
    """
    pairs = n if pairs is None else pairs
    if pairs < 2:
        return None
    if n < 1 or statistic is None:
        return 1.0
    if not ties and pairs == n and n <= 50:
        return min(1.0, 2 * sum(_sums(n)[: int(statistic) + 1]) / 2**n)
    mean, sd = n * (n + 1) / 4, math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return math.erfc(abs(statistic - mean) / sd / math.sqrt(2)) if sd else 1.0


def paired_tests(means: DataFrame, reference: str, alpha: float = 0.05, digits: int = 12) -> DataFrame:
    """The paired comparison of every other method with the reference: descriptives, signed-rank test, effect, Holm's correction.

    Tests and means use the datasets where both have a score; a method without such a dataset keeps its row, without values.
    """
    spark = means.sparkSession
    every = means.filter(F.col("method") != reference).select("method").distinct()
    t = every.join(descriptives(means, reference), "method", "left").join(signed_ranks(means, reference, digits).select("method", "statistic", "n", "rank_biserial", "ties"), "method", "left")
    rows = t.select("method", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "statistic", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ties", F.lit(0)).alias("ties")).collect()  # a row for each method
    p = spark.createDataFrame([(r["method"], signed_rank_p(r["statistic"], r["n"], r["n_pairs"], r["ties"])) for r in rows], "method string, p_raw double")
    p = holm(p, "p_raw").withColumn("significant", F.coalesce(F.col("p_holm") < alpha, F.lit(False)))
    effect = F.when(F.col("n_pairs") > 0, F.coalesce("rank_biserial", F.lit(0.0)))
    tested = F.when(F.col("n_pairs") >= 2, F.col("statistic"))
    out = t.drop("n", "ties").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0).cast("long"))).withColumn("paired_datasets", F.coalesce("paired_datasets", F.lit(""))).withColumn("rank_biserial", effect).withColumn("statistic", tested)
    return out.join(p, "method").withColumn("reference", F.lit(reference)).withColumn("alpha", F.lit(alpha))


def run_statistics(runs: DataFrame, reference: str, digits: int = 12) -> dict[str, DataFrame]:
    """The four tables of a comparison of methods over datasets: paired, friedman, ranks, means (dataset, method, score).

    Without the named reference the first method (in order) whose name contains it stands in; without any: an error.
    """
    means = mean_scores(runs)
    names = sorted(r["method"] for r in means.select("method").distinct().collect())  # a row for each method
    if reference not in names:
        near = [n for n in names if reference.split("_")[0] in n]
        if not near:
            raise ValueError(f"method {reference!r} has no scores")
        reference = near[0]
    one = friedman(means, digits)
    at = one.first()
    p = None if at["chi2"] is None else chi2_tail(at["chi2"], at["df"])
    full = F.array_join(F.array_sort(F.collect_set("method")), ";")
    inside = complete(means).agg(full.alias("complete_case_methods"))
    return {"paired": paired_tests(means, reference, digits=digits), "friedman": one.filter("chi2 is not null").crossJoin(inside).withColumn("p_value", F.lit(p).cast("double")), "ranks": average_ranks(means, digits), "means": means}  # one row


def holm(p: DataFrame, value: str = "p", key: str = "method") -> DataFrame:
    """Adds p_holm; a null p counts for nothing and stays null."""
    w = Window.orderBy(value, key)  # one row a comparison
    known = p.filter(F.col(value).isNotNull())
    n = known.agg(F.count(F.lit(1)).alias("_n"))
    step = known.crossJoin(n).withColumn("_a", (F.col("_n") - F.row_number().over(w) + 1) * F.col(value))  # one row
    out = step.withColumn("p_holm", F.least(F.lit(1.0), F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("_a", "_n")
    return out.unionByName(p.filter(F.col(value).isNull()).withColumn("p_holm", F.lit(None).cast("double")))


def complete(means: DataFrame) -> DataFrame:
    """Methods that have a score on every dataset."""
    n = means.select("dataset").distinct().count()
    full = means.filter("score is not null").groupBy("method").agg(F.count_distinct("dataset").alias("n")).filter(F.col("n") == n).select("method")
    return means.join(full, "method", "left_semi")


def wide(means: DataFrame) -> DataFrame:
    """dataset and a column for each method, on complete cases: first methods without any score go, then datasets where one
    of the others has none. One aggregation counts what is missing; the columns are in order of the methods' names."""
    scores = means.withColumn("score", finite(F.col("score")))
    names = sorted(r["method"] for r in scores.groupBy("method").agg(F.count("score").alias("n")).filter("n > 0").collect())  # a row for each method
    if not names:
        return means.select("dataset").limit(0)
    return scores.groupBy("dataset").pivot("method", names).agg(F.avg("score")).dropna(subset=[f"`{n}`" for n in names])


def average_ranks(means: DataFrame, digits: int = 12) -> DataFrame:
    """method, average_rank (1 is best) over the complete cases."""
    r = complete(means).withColumn("_s", -F.round("score", digits)).withColumn("r", average_rank(F.col("_s"), ["dataset"]))
    return r.groupBy("method").agg(F.avg("r").alias("average_rank"), F.count(F.lit(1)).alias("n_datasets"))


def friedman(means: DataFrame, digits: int = 12) -> DataFrame:
    """One row: chi2 with tie correction, df, n, k over the complete cases; null with fewer than three of either."""
    r = complete(means).withColumn("_s", -F.round("score", digits)).withColumn("r", average_rank(F.col("_s"), ["dataset"]))
    sums = r.groupBy("method").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    ties = r.groupBy("dataset", "_s").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    k, n = F.col("k"), F.col("n")
    chi = (12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)) / (1 - F.col("ties") / (n * k * (k * k - 1)))
    return sums.crossJoin(ties).select(F.when((k >= 3) & (n >= 3), chi).alias("chi2"), (k - 1).alias("df"), n.alias("n_datasets"), k.alias("n_methods"))  # one row each


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with df degrees of freedom > x), by the series of the incomplete gamma function."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    term = total = 1 / a
    for i in range(1, 10_000):
        term *= z / (a + i)
        total += term
        if term < 1e-16 * total:
            break
    return max(0.0, 1 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rank correlation of two columns (null with fewer than three rows, or where one is constant)."""
    one = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_g", F.lit(0))
    r = one.withColumn("_x", average_rank(F.col(x), ["_g"])).withColumn("_y", average_rank(F.col(y), ["_g"]))
    rho = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))
    return r.agg(F.when((F.count(F.lit(1)) >= 3) & rho.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("spearman"), F.count(F.lit(1)).alias("n"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d, c = 1 / ((1 + term * d) or tiny), (1 + term / c) or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def correlation_p(rho: float | None, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs by Student's t with n - 2 degrees of freedom; None below three pairs."""
    if rho is None or math.isnan(rho) or n < 3:
        return None
    left = 1 - rho * rho
    return 0.0 if left < 1e-15 else incomplete_beta((n - 2) / 2, 0.5, left)


def rank_association(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho, n and p of the rank correlation of two columns (rho and p null where one column is constant)."""
    one = spearman(points, x, y).first()  # one row
    rho = one["spearman"]
    rho = None if rho is None or math.isnan(rho) else rho
    return points.sparkSession.createDataFrame([(rho, one["n"], correlation_p(rho, one["n"]))], "rho double, n long, p double")
