"""Summaries and checks of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarize(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """<value>_mean, _std (null for one row), _min, _max by keys; values that df does not have are left out."""
    aggs = []
    for v in (v for v in values if v in df.columns):
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    return df.groupBy(*keys).agg(*aggs)


def pareto(df: DataFrame, key: str, less: str, more: str) -> DataFrame:
    """Adds is_frontier: no row of the same key is as good in both and better in one (less of `less`, more of `more`).

    The best `more` at each value of `less` is compared with the best at all smaller ones: windows run over one row for
    each key and value, in place of a join of all pairs of rows.
    """
    from pyspark.sql import Window

    smaller = Window.partitionBy(key).orderBy(less).rowsBetween(Window.unboundedPreceding, -1)
    best = df.groupBy(key, less).agg(F.max(more).alias("_best")).withColumn("_before", F.max("_best").over(smaller))
    best = best.select(F.col(key).alias("_key"), F.col(less).alias("_less"), "_best", "_before")
    flag = (F.col(more) >= F.col("_best")) & (F.col(more) > F.coalesce("_before", F.lit(float("-inf"))))
    return df.join(best, F.col(key).eqNullSafe(F.col("_key")) & F.col(less).eqNullSafe(F.col("_less"))).select(*df.columns, flag.alias("is_frontier"))


def finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def checks(df: DataFrame, accuracy: str = "accuracy", k: str = "n_selected", d: str = "d", reduction: str = "feature_reduction") -> DataFrame:
    """name, ok of every check of a result table."""
    rows = finite(k) & finite(d) & finite(reduction)
    all_of = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    one = df.agg(
        all_of(finite(accuracy) & F.col(accuracy).between(0, 1)).alias("accuracy_in_range"),
        all_of(finite(k) & (F.abs(F.col(k) - F.round(F.col(k).cast("double"))) <= 1e-8 + 1e-5 * F.abs(F.col(k)))).alias("cardinality_is_integer"),
        all_of(F.when(rows, F.abs(1 - F.col(k) / F.col(d) - F.col(reduction)) <= 1e-9 + 1e-5 * F.abs(F.col(reduction)))).alias("reduction_adds_up"),
    )
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("ok")) for c in one.columns])).alias("e")).select("e.*")


def recomputes(raw: DataFrame, summary: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: n_matched groups, ok if mean and std of the summary follow from the raw rows."""
    again = raw.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    close = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= tolerance + 1e-5 * F.abs(F.col(b)), F.lit(True))
    j = summary.join(again, keys)
    return j.agg(F.count(F.lit(1)).alias("n_matched"), ((F.count(F.lit(1)) > 0) & F.coalesce(F.bool_and(close(f"{value}_mean", "_m") & close(f"{value}_std", "_s")), F.lit(True))).alias("ok"))


def reconciled(summary: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side (both, summary_only, raw_only) of the full outer match."""
    s, r = summary.select(*keys).distinct().withColumn("_s", F.lit(True)), raw.select(*keys).distinct().withColumn("_r", F.lit(True))
    return s.join(r, keys, "full_outer").select(*keys, F.when(F.col("_s").isNull(), "raw_only").when(F.col("_r").isNull(), "summary_only").otherwise("both").alias("side"))


def scenario_summary(df: DataFrame, keys: list[str], seed: str, values: list[str]) -> DataFrame:
    """n_seeds (rows with a seed, each of which is one run), and the mean of every value, by scenario keys."""
    return df.groupBy(*keys).agg(F.count(seed).alias("n_seeds"), *[F.avg(v).alias(f"{v}_mean") for v in values])


def check_seeds(raw: DataFrame, summary: DataFrame, keys: list[str], seed: str, values: list[str]) -> DataFrame:
    """name, ok: a summary by keys (n_seeds, <value>_mean) against the rows it was made of.

    Keys are unique and those of the rows, n_seeds is the number of different seeds, seeds add up to the rows, and means
    are those of the rows within 1e-12 (relative 1e-5).
    """
    again = raw.groupBy(*keys).agg(F.count_distinct(seed).alias("_seeds"), F.count(seed).alias("_rows"), *[F.avg(v).alias(f"_{v}") for v in values], F.lit(True).alias("_r"))
    both = summary.withColumn("_s", F.lit(True)).join(again, keys, "full_outer")
    close = lambda v: F.coalesce(F.abs(F.col(f"{v}_mean") - F.col(f"_{v}")) <= 1e-12 + 1e-5 * F.abs(F.col(f"_{v}")), F.lit(True))
    one = both.agg(
        (F.count("_s") == F.count_distinct(F.when(F.col("_s"), F.struct(*keys)))).alias("keys_unique"),
        F.coalesce(F.bool_and(F.col("_s").isNotNull() & F.col("_r").isNotNull()), F.lit(True)).alias("keys_match"),
        F.coalesce(F.bool_and(F.col("n_seeds") == F.col("_seeds")), F.lit(True)).alias("seeds_match"),
        (F.coalesce(F.sum("n_seeds"), F.lit(0)) == F.coalesce(F.sum("_rows"), F.lit(0))).alias("rows_add_up"),
        *[F.coalesce(F.bool_and(close(v)), F.lit(True)).alias(f"{v}_reproduces") for v in values],
    )
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("ok")) for c in one.columns])).alias("e")).select("e.*")


def run_validations(raw: DataFrame, summary: DataFrame | None = None, keys: tuple[str, ...] = ("dataset", "method"), value: str = "accuracy") -> DataFrame:
    """check, status (PASS or FAIL) of every check that the tables have columns for; nothing to check is a failure too."""
    have, found = set(raw.columns), []
    names = {"accuracy_in_range": {value}, "cardinality_is_integer": {"n_selected"}, "reduction_adds_up": {"n_selected", "d", "feature_reduction"}}
    full = raw
    for c in {value, "n_selected", "d", "feature_reduction"} - have:
        full = full.withColumn(c, F.lit(None).cast("double"))
    found.append(checks(full, accuracy=value).filter(F.col("name").isin([n for n, c in names.items() if c <= have or n == "accuracy_in_range"])))
    if value in have:  # a table without any finite value passes no check of its range
        some = raw.agg(F.coalesce(F.bool_or(finite(value)), F.lit(False)).alias("ok")).select(F.lit("has_values").alias("name"), "ok")
        found.append(some)
    if summary is not None:
        found.append(recomputes(raw, summary, list(keys), value).select(F.lit("summary_recomputes").alias("name"), "ok"))
        if f"{value}_mean" in summary.columns:
            found.append(summary.agg(F.coalesce(F.max(f"{value}_mean") <= 1, F.lit(True)).alias("ok")).select(F.lit("summary_is_a_fraction").alias("name"), "ok"))
    if {"percent_mean", "percent_sd"} <= have:
        found.append(raw.agg((~F.coalesce(F.bool_or(mixed_units(F.col("percent_mean"), F.col("percent_sd"))), F.lit(False))).alias("ok")).select(F.lit("no_mixed_units").alias("name"), "ok"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.col("name").alias("check"), F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("status"))


def assert_ok(validations: DataFrame) -> None:
    """Raise if any check of run_validations failed."""
    failed = sorted(r["check"] for r in validations.filter("status <> 'PASS'").collect())  # a row for each check
    if failed:
        raise AssertionError("validation failed: " + ", ".join(failed))


def mixed_units(mean: Column, sd: Column) -> Column:
    """Whether a mean reads as a percentage while its deviation reads as a fraction."""
    return (mean > 1) & (mean <= 100) & (sd > 0) & (sd < 1)


def percent_units(mean: Column, sd: Column, raw_mean: Column, raw_sd: Column) -> Column:
    """Whether both are 100 times their fractions."""
    return (F.abs(mean - 100 * raw_mean) <= 1e-6) & (F.abs(sd - 100 * raw_sd) <= 1e-6)


def rounds_fairly(mean: Column, sd: Column, decimals: int = 2) -> Column:
    """False where a percentage reads as 100 with a deviation of 0 although it has one."""
    return ~((F.round(mean, decimals) == 100) & (sd > 0) & (F.round(sd, decimals) == 0))


def failure_status(log: DataFrame, resolved: Column) -> DataFrame:
    """Adds or updates status: what was resolved stays so, `resolved` resolves more."""
    old = F.col("status") == "resolved" if "status" in log.columns else F.lit(False)
    return log.withColumn("status", F.when(F.coalesce(old, F.lit(False)) | F.coalesce(resolved, F.lit(False)), "resolved").otherwise("active"))


def gate(checks_ok: bool, active: int) -> str:
    return "READY" if checks_ok and not active else "BLOCKED"


def mean_sd(mean: Column, sd: Column) -> Column:
    """Text of both with two decimals, or four where the deviation would read as 0."""
    fine = (sd > 0) & (F.round(sd, 2) == 0)
    return F.when(fine, F.format_string("%.4f ± %.4f", mean, sd)).otherwise(F.format_string("%.2f ± %.2f", mean, sd))


def recovery(df: DataFrame, selected: str, truth: str) -> DataFrame:
    """Adds precision, recall, f1, jaccard, all_selected."""
    hit = F.size(F.array_intersect(selected, truth))
    p = F.when(F.size(selected) > 0, hit / F.size(selected)).otherwise(0.0)
    r = F.when(F.size(truth) > 0, hit / F.size(truth)).otherwise(0.0)
    union = F.size(F.array_union(selected, truth))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).withColumn("jaccard", F.when(union > 0, hit / union).otherwise(1.0)).withColumn("all_selected", hit == F.size(F.array_distinct(truth)))
