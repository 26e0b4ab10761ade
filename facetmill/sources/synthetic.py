"""Seeded datasets whose relevant features are known, computed row by row from hashes: the same on any number of partitions."""

from __future__ import annotations

import functools
import math
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Synthetic:
    """rows: row_id, x, y. support: the relevant features; interaction: those of them that matter in company only."""

    name: str
    rows: DataFrame
    d: int
    support: tuple[int, ...]
    interaction: tuple[int, ...] = ()


class _Draws:
    """Independent numbers for each row, one stream after the other."""

    def __init__(self, seed: int):
        self.seed, self.stream = seed, 0

    def uniform(self) -> Column:
        """In (0, 1)."""
        self.stream += 1
        return (F.shiftrightunsigned(F.xxhash64("row_id", F.lit(self.seed), F.lit(self.stream)), 12).cast("double") + 0.5) / float(1 << 52)

    def normal(self) -> Column:
        """By the polar form of two uniform numbers."""
        return F.sqrt(-2 * F.ln(self.uniform())) * F.cos(2 * math.pi * self.uniform())

    def bit(self) -> Column:
        return (self.uniform() < 0.5).cast("int")


def _xor(bits: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a.bitwiseXOR(b), bits)


def _sign(signal: list[Column], slope: float, noise: Column) -> Column:
    """1 where the sum of the signal, scaled to one deviation, and some noise are positive."""
    return (slope / math.sqrt(max(1, len(signal))) * functools.reduce(operator.add, signal) + 0.5 * noise > 0).cast("int")


def generate(spark: SparkSession, name: str, n: int, seed: int, signal: int = 4, noise: int = 20, copies: int = 4, rho: float = 0.8, ids: DataFrame | None = None) -> Synthetic:
    """One of NAMES with n rows, or with a row for each row_id (long, no repeats) of ids. signal: features of main effects; bits of an interaction are given as bit + 0.05 of noise.

    main_effect, redundant_copy (noisy copies follow the signal), xor2, parity3, mixed (main effects and two bits whose
    exclusive or flips the label), interaction_noise (the same with two main effects), correlated_noise (each noise feature
    follows the one before by rho).
    """
    if name not in NAMES:
        raise ValueError(f"unknown dataset {name!r}")
    draw = _Draws(seed)
    blurred = lambda bits: [b + 0.05 * draw.normal() for b in bits]
    base = spark.range(n).withColumnRenamed("id", "row_id") if ids is None else ids.select("row_id")
    interaction: tuple[int, ...] = ()
    if name in ("xor2", "parity3"):
        names = [f"_b{i}" for i in range(2 if name == "xor2" else 3)]
        base = base.select("row_id", *[draw.bit().alias(b) for b in names])
        bits = [F.col(b) for b in names]
        y, columns, support = _xor(bits), blurred(bits), tuple(range(len(bits)))
        interaction = support
    else:
        k = 2 if name == "interaction_noise" else signal
        base = base.select("row_id", *[draw.normal().alias(f"_s{i}") for i in range(k)], draw.bit().alias("_p"), draw.bit().alias("_q"))
        main, support = [F.col(f"_s{i}") for i in range(k)], tuple(range(k))
        columns = list(main)
        if name in ("mixed", "interaction_noise"):
            y = _xor([_sign(main, 1.2, draw.normal()), F.col("_p"), F.col("_q")])
            columns += blurred([F.col("_p"), F.col("_q")])
            interaction, support = (k, k + 1), tuple(range(k + 2))
        else:
            y = _sign(main, 1.5, draw.normal())
        if name == "redundant_copy":
            columns += [0.9 * main[(seed + 7 * i) % k] + 0.35 * draw.normal() for i in range(copies)]
    if name == "correlated_noise" and noise:
        follow = lambda a, e: F.concat(a, F.array(F.when(F.size(a) == 0, e).otherwise(rho * F.coalesce(F.element_at(a, -1), F.lit(0.0)) + math.sqrt(1 - rho**2) * e)))
        extra = F.aggregate(F.array(*[draw.normal() for _ in range(noise)]), F.array().cast("array<double>"), lambda a, e: F.when(F.size(a) == 0, F.array(e)).otherwise(follow(a, e)))
    else:
        extra = F.array(*[draw.normal() for _ in range(noise)]).cast("array<double>")
    x = F.concat(F.array(*[c.cast("double") for c in columns]), extra)
    return Synthetic(name, base.select("row_id", x.alias("x"), y.cast("int").alias("y")), len(columns) + noise, support, interaction)


NAMES = ("main_effect", "redundant_copy", "xor2", "parity3", "mixed", "interaction_noise", "correlated_noise")


def interaction_example(ids: DataFrame, seed: int = 0) -> DataFrame:
    """row, x1_binary, x2_binary, y_xor, x3_noisy_sum for each row_id of ids: a table in which neither bit tells the label alone.

    The bits are those of the first hexadecimal digit of the MD5 of "seed|row_id".
    """
    digit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("row_id").cast("string"))), 1, 1), 16, 10).cast("int")
    bit = lambda k: F.shiftright("_d", k).bitwiseAND(F.lit(1))
    x1, x2 = F.col("x1_binary"), F.col("x2_binary")
    t = ids.select(F.col("row_id").alias("row"), digit.alias("_d")).withColumns({"x1_binary": bit(0), "x2_binary": bit(1), "_e": bit(2)})
    return t.select("row", "x1_binary", "x2_binary", _xor([x1, x2]).alias("y_xor"), ((x1 + x2 + F.col("_e")) % 2).alias("x3_noisy_sum"))
