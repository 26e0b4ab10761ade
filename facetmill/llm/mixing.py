"""Mixing sources to target weights along a time-varying curriculum.

Sources in order of code points (null last) weigh 1, 2, 3, repeating, and share the words of all documents; a source
gets at most `limit` times its own words and the excess is shared again by weight. Over training time t in [0, 1] the
weight of a source moves linearly from `start` to `end` times its share; its cumulative demand is the integral of this
schedule. The documents of a source stand in a random but fixed order (MD5 of id, source and text), are repeated in whole
passes of the source until its target is met, and each copy gets the time at which the demand reaches the copy's
middle in the source's cumulative words. The plan is sorted by this position over ranges.

Cumulative words are summed in two levels (hash buckets, then bucket totals), so a source with a third of all rows is
spread over all tasks; sums over sources are in two levels too. Null text has size 0; documents of size 0 take nothing. Equal rows are told apart by a number,
so the same input gives the same mix. Rows equal in id, source and text are documents of their own, whose further columns
are carried along, each with its copies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved, word_count


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    limit: float = 3.0
    #: Relative weight of the sources of each of the `weights` at the start and at the end of training.
    start: tuple[float, ...] = (1.5, 1.0, 0.5)
    end: tuple[float, ...] = (0.5, 1.0, 1.5)
    rows_per_bucket: int = 20_000
    least_buckets: int = 1024


def _running(df: DataFrame, order: list[Column], name: str, **sums: Column) -> DataFrame:
    """Adds for each of `sums` its sum over the rows before this one in an order without ties.

    In two levels: rows are dealt to ranges of the order and written with the number of their range; the sums of whole ranges
    are one row for each range, and only rows of one range are in a window together.
    """
    dealt = saved(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()), name)
    # One row for each range: as many as there are shuffle partitions.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(*[F.sum(v).alias(f"_{c}") for c, v in sums.items()])
    starts = starts.select("_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(c) for c, v in sums.items()])
    whole = dealt.join(F.broadcast(starts), "_range")
    return whole.withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums}).drop("_range", *[f"_{c}" for c in sums])


def targets(sources: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """source, source_size (long) -> also rank, target (double): the fill level is found from sorted ratios in closed form.

    A source is at its limit if the level exceeds limit * size / weight. Sources are sorted by this ratio; with the
    first j at their limits, the level is (total - their limits) / weight of the others, and j is the first for which
    that level is within the next ratio. Sources may be as many as web hosts: ranks and sums before a source are running
    sums in two levels, and the totals and the level are one row.
    """
    ranked = _running(sources, [F.col("source").asc_nulls_last()], "mix-names", rank=F.lit(1)).withColumn("rank", F.col("rank").cast("int"))
    ranked = ranked.withColumn("weight", _pick(cfg.weights, F.col("rank"))).withColumn("most", cfg.limit * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    filled = _running(ranked, [F.col("ratio"), F.col("rank")], "mix-ratios", most_before=F.col("most"), weight_before=F.col("weight"))
    total = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(total["size"]) - F.col("most_before")) / (F.lit(total["weight"]) - F.col("weight_before"))
    first = filled.withColumn("level", level).agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level")))["level"].alias("level")).first()["level"]
    return filled.select("source", "source_size", "rank", F.least(F.col("most"), F.col("weight") * F.lit(first).cast("double")).alias("target"))


def _pick(values: tuple[float, ...], rank: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), rank % len(values))


def time_of(done: Column, rank: Column, cfg: MixConfig) -> Column:
    """Invert the integrated schedule: t with (a t + (b - a) t^2 / 2) / ((a + b) / 2) = done."""
    a, b = _pick(cfg.start, rank), _pick(cfg.end, rank)
    need = F.least(F.greatest(done, F.lit(0.0)), F.lit(1.0)) * (a + b) / 2
    return 2 * need / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * (b - a) * need)))


def _order_key() -> Column:
    """60 bits of the MD5 of id, source and text: equal on every engine and in every run."""
    part = lambda c: F.coalesce(F.concat(F.col(c).cast("string"), F.lit("|")), F.lit("-|"))
    return F.conv(F.substring(F.md5(F.concat(part("doc_id"), part("source"), F.coalesce("text", F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def mix_plan(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken, positions (a time for each copy) and _h, a hash of id, source and text."""
    # The order key makes equal rows neighbours; which of them is first does not change the rows of the result.
    sized = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _order_key().alias("_h")), "mix-sizes")
    rows = sized.count()
    buckets = max(cfg.least_buckets, rows // cfg.rows_per_bucket)
    want = saved(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cfg), "mix-targets")
    # Buckets in the order of the hash, so that bucket by bucket is that order.
    sized = sized.withColumn("_b", F.floor(F.col("_h") / float(1 << 60) * buckets).cast("int"))
    sums = sized.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    upto = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).join(want, sums["source"].eqNullSafe(want["source"])).select(sums["source"].alias("_s"), F.col("_b").alias("_b2"), "_before", "source_size", "rank", "target")
    sums = saved(sums, "mix-buckets")
    order = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_in", F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_b2")))
    middle = F.col("_before") + F.col("_in") + F.col("size") / 2
    # Copies c = 0, 1, ... of a document are taken while the middle of the copy lies within the target.
    copies = F.when((F.col("size") > 0) & (F.col("target") > middle), F.least(F.ceil((F.col("target") - middle) / F.col("source_size")), F.lit(int(cfg.limit)))).otherwise(0).cast("int")
    placed = placed.withColumn("_middle", middle).withColumn("copies", copies)
    times = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda c: time_of((F.col("_middle") + c * F.col("source_size")) / F.col("target"), F.col("rank"), cfg))).otherwise(F.array().cast("array<double>"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"), times.alias("positions"), "_h")


def mixed_order(plan: DataFrame) -> DataFrame:
    """The plan sorted over ranges by first position; documents that the mix leaves out come last."""
    first = F.get("positions", F.lit(0)).alias("position")
    return plan.withColumn("position", first).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix_documents(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The mixed training sequence: docs with a row for each taken copy, sorted by position; its columns stay as they are.

    Rows are found again by the order key; rows that share it are numbered, in docs by a hash of all their columns.
    """
    names = docs.columns
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("_i")
    plan = mix_plan(docs, cfg).filter(F.size("positions") > 0).groupBy(own, "_h").agg(F.array_sort(F.collect_list("positions")).alias("_at"))
    texts = docs.select(own, _order_key().alias("_h"), F.struct(*names).alias("_doc"), F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t]).alias("_all"))
    equal = Window.partitionBy("_i", "_h").orderBy("_all")  # a group is dealt like the join before it
    taken = texts.join(saved(plan, "mix-plan"), ["_i", "_h"]).withColumn("_k", F.row_number().over(equal) - 1)
    taken = taken.withColumn("_at", F.explode(F.get("_at", F.col("_k"))))
    return taken.orderBy("_at", "_h").select(*[F.col("_doc")[c].alias(c) for c in names])
