"""Exact quantile and uniform bins of feature arrays, without a place where all values of a feature meet."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .information import matrix

#: Bits of a value that one pass over the data decides at most, and cells that a task counts, about.
STEP = 12
CELLS = 1 << 21


def _keys(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order."""
    bits = (x + 0.0).view(np.uint64)
    return bits ^ np.where(bits >> np.uint64(63), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1 << 63))


def _values(keys: np.ndarray) -> np.ndarray:
    return (keys ^ np.where(keys >> np.uint64(63), np.uint64(1 << 63), np.uint64(0xFFFFFFFFFFFFFFFF))).view(np.float64)


def order_statistics(df: DataFrame, features: list[int], ranks: list[int], few: int = 200_000, ends: list[tuple[float, float]] | None = None) -> np.ndarray:
    """[feature, rank]: the values at these ranks (from 0) of each feature of x, exactly.

    A pass splits the intervals of keys that hold wanted ranks into cells and tells how many values fall into each cell, and
    the least and the greatest of them; what is wanted of a cell is then looked for between these two. A cell of one value is
    known, so that few different values of many rows need no further pass. Once the others hold `few` values together, they are
    fetched. What reaches the driver is bounded by features, ranks and cells. ends: least and greatest value of each feature.
    """
    d = len(features)
    low, high = (np.repeat(_keys(np.array(e, float))[:, None], len(ranks), axis=1) for e in zip(*ends)) if ends else (np.zeros((d, len(ranks)), np.uint64), np.full((d, len(ranks)), 0xFFFFFFFFFFFFFFFF, np.uint64))
    left = np.tile(np.array(ranks, np.int64), (d, 1))  # ranks within their interval
    held = few + 1
    while (low < high).any():
        wanted = [np.unique(np.stack((a[a < b], b[a < b]), axis=1), axis=0) for a, b in zip(low, high)]  # disjoint intervals, in order
        if held <= few:
            for i, j, key in _fetched(df, features, wanted):
                for r in np.flatnonzero((low[i] == wanted[i][j, 0]) & (low[i] < high[i])):
                    low[i, r] = high[i, r] = key[left[i, r]]
            break
        bits = min(STEP, max(4, CELLS.bit_length() - 1 - sum(map(len, wanted)).bit_length()))
        shift = [np.array([max(0, int(b - a).bit_length() - bits) for a, b in w], np.uint64) for w in wanted]

        def run(batches, wanted=wanted, shift=shift, bits=bits):
            import pyarrow as pa

            count = [np.zeros(len(w) << bits, np.int64) for w in wanted]
            least = [np.full(len(w) << bits, 0xFFFFFFFFFFFFFFFF, np.uint64) for w in wanted]
            most = [np.zeros(len(w) << bits, np.uint64) for w in wanted]
            for i, slot, key in _inside(batches, features, wanted):
                at = (slot << bits) + (key - wanted[i][slot, 0] >> shift[i][slot]).astype(np.int64)
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))  # keys are in order
                last = np.append(first[1:], len(at))
                at = at[first]
                count[i][at] += last - first
                least[i][at] = np.minimum(least[i][at], key[first])
                most[i][at] = np.maximum(most[i][at], key[last - 1])
            for i, c in enumerate(count):
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(c[at]), pa.array(_signed(least[i][at])), pa.array(_signed(most[i][at]))], ["i", "at", "c", "low", "high"])

        cells = df.select("x").mapInArrow(run, "i int, at long, c long, low long, high long").groupBy("i", "at")
        got = cells.agg(F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
        held, found = 0, set()
        for i, rows in got.sort_values(["i", "at"]).groupby("i"):
            at, c, a, b = (rows[n].to_numpy() for n in ("at", "c", "low", "high"))
            for r in np.flatnonzero(low[i] < high[i]):
                own = np.flatnonzero(at >> bits == np.searchsorted(wanted[i][:, 0], low[i, r]))
                below = np.cumsum(c[own])
                k = own[np.searchsorted(below, left[i, r], side="right")]
                left[i, r] -= below[k - own[0]] - c[k]
                low[i, r], high[i, r] = _unsigned(a[k]), _unsigned(b[k])
                if a[k] < b[k] and (i, k) not in found:
                    found.add((i, k))
                    held += int(c[k])
    return _values(low)


def _signed(key: np.ndarray) -> np.ndarray:
    """Keys as signed integers of the same order."""
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def _unsigned(key: np.int64) -> np.uint64:
    return np.uint64(int(key) + (1 << 63))


def _blocks(batches, rows: int = 20_000):
    """The x of some `rows` rows at a time, one array for each feature."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(matrix(b.column(0), np.float64))
            n += b.num_rows
        if n >= rows:
            yield np.concatenate(held).T.copy()
            held, n = [], 0
    if held:
        yield np.concatenate(held).T.copy()


def _inside(batches, features: list[int], wanted: list[np.ndarray]):
    """(feature, interval, key) of all values in an interval that is looked at; keys in order."""
    for x in _blocks(batches):
        for i, w in enumerate(wanted):
            if len(w):
                key = np.sort(_keys(x[features[i]]))
                slot = np.searchsorted(w[:, 0], key, side="right") - 1
                hit = (slot >= 0) & (key <= w[slot, 1])
                if hit.any():
                    yield i, slot[hit], key[hit]


def _fetched(df: DataFrame, features: list[int], wanted: list[np.ndarray]):
    """(feature, interval, its values' keys in order), for intervals that hold few values."""

    def fetch(batches):
        import pyarrow as pa

        for i, slot, key in _inside(batches, features, wanted):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int32)), pa.array(slot), pa.array(_signed(key))], ["i", "slot", "key"])

    rows = df.select("x").mapInArrow(fetch, "i int, slot long, key long").toArrow()
    i, slot, key = (rows.column(n).to_numpy() for n in ("i", "slot", "key"))
    order = np.lexsort((key, slot, i))
    i, slot, key = i[order], slot[order], key[order].view(np.uint64) ^ np.uint64(1 << 63)
    first = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (slot[1:] != slot[:-1]))) if len(i) else []
    for a, z in zip(first, np.append(first[1:], len(i))):
        yield int(i[a]), int(slot[a]), key[a:z]


def ends(df: DataFrame, d: int) -> list[tuple[float, float, int]]:
    """Least and greatest value of each of d features of x, and how many are null or NaN."""

    def run(batches):
        import pyarrow as pa

        low, high, bad = np.full(d, np.inf), np.full(d, -np.inf), np.zeros(d, np.int64)
        for x in _blocks(batches):
            missing = np.isnan(x)
            bad += missing.sum(axis=1)
            low, high = np.minimum(low, np.where(missing, np.inf, x).min(axis=1)), np.maximum(high, np.where(missing, -np.inf, x).max(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(low), pa.array(high), pa.array(bad)], ["pos", "low", "high", "bad"])

    got = df.select("x").mapInArrow(run, "pos long, low double, high double, bad long").groupBy("pos").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("bad").alias("bad"))
    return [(r["low"], r["high"], r["bad"]) for r in sorted(got.collect(), key=lambda r: r["pos"])]  # a row for each feature


def fit(df: DataFrame, d: int, bins: int = 10, method: str = "quantile", row: str = "row_id", chunk: int = 256) -> list[list[float]]:
    """Inner edges of each of d features; a feature that is constant (by the first row's value) has this value as its edge."""
    if method not in ("quantile", "uniform"):
        raise ValueError(f"unknown discretizer {method!r}")
    bins = max(2, bins)
    inner = [i / bins for i in range(1, bins)]
    one = df.agg(F.min_by("x", row).alias("first"), F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()  # one row
    if not one["n"]:
        raise ValueError("no rows to fit")
    if (one["least"], one["most"]) != (d, d):
        raise ValueError(f"rows have {one['least']} to {one['most']} features in place of {d}")
    span = ends(df, d)
    missing = [j for j in range(d) if span[j][2]]
    if missing:
        raise ValueError(f"features must not be null or NaN: {len(missing)} are, of which the first is {missing[0]}")
    constant = [max(abs(span[j][0] - a), abs(span[j][1] - a)) <= 1e-8 + 1e-5 * abs(a) for j, a in enumerate(one["first"])]
    out = [[float(one["first"][j])] if constant[j] else sorted({span[j][0] + q * (span[j][1] - span[j][0]) for q in inner}) for j in range(d)]
    vary = [j for j in range(d) if not constant[j]]
    if method == "quantile" and vary:
        spots = [(one["n"] - 1) * q for q in inner]
        ranks = sorted({r for s in spots for r in (math.floor(s), math.ceil(s))})
        for a in range(0, len(vary), chunk):
            for j, values in zip(vary[a : a + chunk], order_statistics(df, vary[a : a + chunk], ranks, ends=[span[j][:2] for j in vary[a : a + chunk]])):
                v = dict(zip(ranks, values.tolist()))
                out[j] = sorted({v[math.floor(s)] if v[math.floor(s)] == v[math.ceil(s)] else (math.ceil(s) - s) * v[math.floor(s)] + (s - math.floor(s)) * v[math.ceil(s)] for s in spots})
    return out


def encode(df: DataFrame, edges: list[list[float]], keep: list[int] | None = None) -> DataFrame:
    """codes (array of int: the number of edges that are not above a value) in place of x; keep: which features, in this order."""
    keep = list(range(len(edges))) if keep is None else keep
    others = [f for f in df.schema.fields if f.name != "x"]
    d = len(edges)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = matrix(b.column(len(others)), np.float64) if b.num_rows else np.zeros((0, d))
            if x.shape[1] != d:
                raise ValueError(f"rows have {x.shape[1]} features in place of {d}")
            codes = coded(x, edges, keep)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(keep), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], lists], [*[f.name for f in others], "codes"])

    return df.select(*[f.name for f in others], "x").mapInArrow(run, StructType([*others, StructField("codes", ArrayType(IntegerType()))]))


def coded(x: np.ndarray, edges: list[list[float]], keep: list[int]) -> np.ndarray:
    """The codes of rows x, one column for each kept feature."""
    return np.stack([searchsorted(x[:, j], edges[j]) for j in keep], axis=1).astype(np.int32) if keep else np.zeros((len(x), 0), np.int32)


def width(edges: list[list[float]]) -> int:
    """One more than the largest code."""
    return 1 + max((len(e) for e in edges), default=0)


def searchsorted(x: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.asarray(edges), x, side="right")
