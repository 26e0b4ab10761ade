"""Best-fit decreasing packing of token sequences into sequences of a fixed capacity.

A document is its ids and one end id. A longer one is cut so that all pieces but the first are full. Best-fit decreasing
depends on lengths alone, and there are at most `capacity` of them, so the packing is decided on the counts of pieces
by length: lengths fall, equal open sequences form groups, and a segment tree over remaining capacities finds the
tightest group for the next length in logarithmic time. The plan says for each length which ranks go to which run of
sequences, and every piece looks itself up by its rank among the pieces of its length. Ranks are counted in two levels
(hash buckets, then bucket totals), so one frequent length is spread over many tasks, and only counts by length reach
the driver.

Null text is empty: one piece that holds the end id. Repeated rows are packed once each; a row number among equal
pieces makes no difference to the result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import saved, small_batches


@dataclass(frozen=True)
class PackConfig:
    capacity: int = 2048
    end_id: int = 0
    path: str | None = None
    rows_per_bucket: int = 20_000
    least_buckets: int = 1024
    #: Plans of more rows than this are joined by shuffle.
    broadcast_rows: int = 100_000


class FreeTree:
    """Counts of open groups by remaining capacity in a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.count = [0] * (2 * self.size)

    def add(self, free: int, n: int) -> None:
        i = self.size + free
        while i:
            self.count[i] += n
            i //= 2

    def tightest(self, need: int) -> int:
        """The smallest remaining capacity of at least `need` that is open; -1 if there is none."""
        i = self.size + need
        if self.count[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces in each sequence, offset of the first piece)."""
    tree, groups, plan, opened = FreeTree(capacity), {}, [], 0

    def put(free: int, first: int, n: int) -> None:
        if n and free:
            groups.setdefault(free, []).append((first, n))
            tree.add(free, 1)

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            free = tree.tightest(length)
            if free < 0:
                free, first = capacity, opened
                n = -(-(end - rank) // (capacity // length))
                opened += n
            else:
                first, n = groups[free].pop()
                tree.add(free, -1)
            each = free // length
            full = min(n, (end - rank) // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - free))
                put(free - each * length, first, full)
                rank += full * each
                first, n = first + full, n - full
            if n and rank < end:
                rest = end - rank
                plan.append((length, rank, end, first, rest, capacity - free))
                put(free - rest * length, first, 1)
                rank, first, n = end, first + 1, n - 1
            put(free, first, n)
    return plan


def pieces(docs: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    path = cfg.path or bpe.default_path()
    small_batches(docs.sparkSession)
    capacity, end = cfg.capacity, cfg.end_id.to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa

        ids = bpe.load(path).ids
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                data = (ids(text) if text else b"") + end
                n = len(data) // 4
                cut = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, z) in enumerate(zip(cut, cut[1:])):
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * z]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """The pieces with sequence_id and offset: no two overlap, none leaves a gap, no sequence exceeds the capacity."""
    spark = docs.sparkSession
    cut = saved(pieces(docs, cfg), "pack-pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    plan = best_fit_plan(counts, cfg.capacity)
    to = spark.createDataFrame(plan or [(0, 0, 0, 0, 1, 0)], "_len long, _from long, _to long, _first long, _each long, _at long")
    if len(plan) <= cfg.broadcast_rows:
        to = F.broadcast(to)
    buckets = max(cfg.least_buckets, sum(counts.values()) // cfg.rows_per_bucket)
    cut = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    below = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0))).drop("_n")
    own = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("_r", F.row_number().over(own) - 1).join(before, ["length", "_b"]).withColumn("_rank", F.col("_before") + F.col("_r"))
    out = ranked.join(to, (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    rel = F.col("_rank") - F.col("_from")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.floor(rel / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_at") + rel % F.col("_each") * F.col("length")).cast("long").alias("offset"))
