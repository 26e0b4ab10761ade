"""Classifiers on selected features, and their metrics. Nearest neighbours compare test rows with the training table in blocks."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import no_nan
from .information import matrix

#: Fixed classifiers, by the names of evaluate; linear_svm is there beside them.
CLASSIFIERS = ("forest", "svm", "nearest", "logistic")


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("y", "pred").agg(F.count(F.lit(1)).alias("c"))


def metrics(predicted: DataFrame) -> DataFrame:
    """One row: accuracy, balanced_accuracy (mean recall of the true classes), macro_f1 (over true and predicted classes)."""
    c = confusion(predicted)
    true = c.groupBy(F.col("y").alias("k")).agg(F.sum("c").alias("t"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("c")).otherwise(0)).alias("hit"))
    said = c.groupBy(F.col("pred").alias("k")).agg(F.sum("c").alias("p"))
    each = true.join(said, "k", "full_outer").na.fill(0, ["t", "p", "hit"])
    f1 = F.when(F.col("t") + F.col("p") > 0, 2 * F.col("hit") / (F.col("t") + F.col("p"))).otherwise(0.0)
    return each.agg((F.sum("hit") / F.sum("t")).alias("accuracy"), F.avg(F.when(F.col("t") > 0, F.col("hit") / F.col("t"))).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))


#: Values of a block of rows that a task holds at a time (32 MB), and tiles that keep a cluster busy.
VALUES, _TILES = 1 << 22, 24


def blocks_of(n_test: int, n_train: int, f: int, block: int = 1024) -> tuple[int, int]:
    """Blocks of test rows and of training rows. Few of the second, as what a row finds in each of them is exchanged."""
    train = max(1, -(-n_train * f // VALUES))
    return max(1, -(-n_test * f // VALUES), min(-(-n_test // block), -(-_TILES // train))), train


def place(key: str, blocks: int):
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def every(blocks: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))


def dealt(df: DataFrame, sizes: tuple[int, int]):
    """Rows with a and b grouped by tiles, of which hardly any two share a task."""
    return df.repartition(4 * sizes[0] * sizes[1], "a", "b").groupBy("a", "b")


def _gaps(v: np.ndarray, p: np.ndarray, w: np.ndarray, q: np.ndarray, metric: str, piece: int = 1024) -> np.ndarray:
    """Distances of the rows p of v from the rows q of w, summed feature by feature, to 9 digits."""
    far = np.zeros(len(p))
    for at in range(0, len(p), piece):
        gap = np.ascontiguousarray((v[p[at : at + piece]] - w[q[at : at + piece]]).T)
        np.multiply(gap, gap, out=gap) if metric == "square" else np.abs(gap, out=gap)
        for g in gap:
            far[at : at + piece] += g
    return np.round(far, 9)


#: Levels of a value where gaps are summed roughly: four gaps fit a byte.
_LEVELS = 63


def _levels(v: np.ndarray, low: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Levels of the values of each feature in bytes (a row for each feature), and how far each row's are from its values in sum."""
    q = np.rint((v - low) / step)
    return np.ascontiguousarray(q.astype(np.int8).T), np.abs((v - low) - q * step).sum(axis=1)


def _rough_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of gaps of levels of all pairs, in bytes as far as they fit."""
    f, shape = len(a), (a.shape[1], b.shape[1])
    total = np.zeros(shape, np.uint16 if f * _LEVELS < 1 << 16 else np.uint32)
    gap, four = np.empty(shape, np.int8), np.empty(shape, np.uint8)
    for start in range(0, f, 4):
        for c in range(start, min(start + 4, f)):
            np.subtract(a[c, :, None], b[c], out=gap)
            np.abs(gap, out=four.view(np.int8) if c == start else gap)
            if c > start:
                np.add(four, gap.view(np.uint8), out=four)
        np.add(total, four, out=total)
    return total


def best(v: np.ndarray, ids: np.ndarray, w: np.ndarray, n_ids: np.ndarray, k: int, metric: str, itself: bool = True, rows: int | None = None, chunk: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in v, place in w, distance) of the k nearest w (ties by n_ids) of each v, by place and distance.

    Chunk by chunk a matrix product, or a sum of gaps of 64 levels, tells which pairs may be among the nearest; its
    error is bounded, and the distances of these few pairs are computed in full.
    """
    f, found = v.shape[1], []
    if not len(v) or not len(w):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    rows, chunk = rows or (256 if metric == "square" else 64), chunk or (1024 if metric == "square" else 4096)
    if metric == "square":
        middle = w.mean(axis=0)
        a, b = v - middle, w - middle
        size = max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)))
        slack, unit = np.full(len(v), 1e-9 + 1e-14 * (f + 4) * 4 * f * size * size), 1.0
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    else:
        low, high = np.minimum(v.min(axis=0), w.min(axis=0)), np.maximum(v.max(axis=0), w.max(axis=0))
        unit = float((high - low).max(initial=0.0)) / _LEVELS or 1.0
        (a, a_off), (b, b_off) = _levels(v, low, unit), _levels(w, low, unit)
        off = 1e-9 + 1e-12 * f * (_LEVELS * unit + float(np.abs([low, high]).max())) + a_off
        slack = off + b_off.max()
    for at in range(0, len(v), rows):
        stop = min(at + rows, len(v))
        limit, near = np.full(stop - at, np.inf), slack[at:stop]
        i, j, far = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for start in range(0, len(w), chunk):
            end = min(start + chunk, len(w))
            if metric == "square":
                rough = (aa[at:stop, None] + bb[start:end]) - 2 * (a[at:stop] @ b[start:end].T)
            else:
                rough = _rough_gaps(a[:, at:stop], b[:, start:end])
            first, taken = min(k + (not itself), end - start) - 1, None
            if first + 1 >= k + (not itself) and np.isinf(limit).any():
                taken = np.partition(rough, first, axis=1)[:, first]  # these first, so that few others may be nearer
            for most in (None,) if taken is None else (taken, None):
                if most is None:
                    most = (limit + near) / unit
                    if metric != "square":
                        most = np.minimum(np.floor(most), np.iinfo(rough.dtype).max).astype(rough.dtype)
                    maybe = rough <= most[:, None]
                    if taken is not None:
                        maybe &= rough > taken[:, None]
                else:
                    maybe = rough <= most[:, None]
                p, q = np.divmod(np.flatnonzero(maybe), end - start)
                if metric != "square":
                    sure = rough[p, q] * unit <= limit[p] + off[at + p] + b_off[start + q]
                    p, q = p[sure], q[sure]
                p, q = p + at, q + start
                if not itself:
                    other = ids[p] != n_ids[q]
                    p, q = p[other], q[other]
                if not len(p):
                    continue
                i, j, far = np.concatenate([i, p]), np.concatenate([j, q]), np.concatenate([far, _gaps(v, p, w, q, metric)])
                order = np.lexsort((n_ids[j], far, i))
                i, j, far = i[order], j[order], far[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, far, rank = i[rank < k], j[rank < k], far[rank < k], rank[rank < k]
                last = rank == k - 1
                limit[i[last] - at] = far[last]
        found.append((i, j, far))
    return tuple(np.concatenate(x) for x in zip(*found))


def near_lists(train: DataFrame, test: DataFrame, features: list[int], k: int, sizes: tuple[int, int], by_class: bool = False, metric: str = "square") -> DataFrame:
    """row_id, y, b, n_id, n_y, far, many (arrays): of the k nearest of each test row those that lie in block b of the training
    rows, with how many nearest of that class (by_class; else of all) the row has.

    Blocks of test rows meet blocks of training rows in one task, which keeps the k best of each row; the best of all
    blocks are the nearest. sizes: blocks of both.
    """
    import pyarrow as pa

    f, row = len(features), lambda df: df.select(F.col("row_id").cast("long").alias("row_id"), F.col("y").cast("int").alias("y"), F.array(*[F.col("x")[j] for j in features]).alias("v"))
    left = dealt(row(test).select(place("row_id", sizes[0]).alias("a"), every(sizes[1]).alias("b"), "row_id", "y", "v"), sizes)
    right = dealt(row(train).select(every(sizes[0]).alias("a"), place("row_id", sizes[1]).alias("b"), "row_id", "y", "v"), sizes)
    kinds = (pa.int64(), pa.int32(), pa.float64())

    def lists(rows: int, i: np.ndarray, *columns):
        """Columns as lists by the places i (sorted) of their rows."""
        ends = pa.array(np.searchsorted(i, np.arange(rows + 1)).astype(np.int32))
        return [pa.ListArray.from_arrays(ends, pa.array(c, kind)) for c, kind in columns]

    def run(t, n):
        n_part = n.column("b")[0].as_py() if len(n) else 0
        if len(t):
            ids, v = t.column("row_id").to_numpy(), matrix(t.column("v").combine_chunks(), np.float64)
        else:
            ids, v = np.empty(0, np.int64), np.zeros((0, f))
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        n_ids, n_y = n.column("row_id").to_numpy(), n.column("y").to_numpy()
        if len(t) and len(n):
            w = matrix(n.column("v").combine_chunks(), np.float64)
            for c in np.unique(n_y) if by_class else [None]:
                pick = np.flatnonzero(n_y == c) if by_class else np.arange(len(n_y))
                i, j, far = best(v, ids, w[pick], n_ids[pick], k, metric, itself=not by_class)
                out.append((i, pick[j], far))
        i, j, far = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(i, kind="stable")
        i, j, far = i[order], j[order], far[order]
        return pa.table([pa.array(ids), t.column("y"), pa.array(np.full(len(ids), n_part), pa.int64()), *lists(len(ids), i, (n_ids[j], kinds[0]), (n_y[j], kinds[1]), (far, kinds[2]))], names=["row_id", "y", "b", "n_id", "n_y", "far"])

    found = left.cogroup(right).applyInArrow(run, "row_id long, y int, b long, n_id array<long>, n_y array<int>, far array<double>")

    def merge(t):
        """Of some test rows the k best of all blocks; a line for each row and block that has some of them."""
        t = t.combine_chunks()
        flat = lambda name: t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        sizes_of = np.diff(t.column("n_id").combine_chunks().offsets.to_numpy())
        many = lambda name: np.repeat(t.column(name).to_numpy(), sizes_of)
        ids, y, b, n_ids, n_y, far = many("row_id"), many("y"), many("b"), flat("n_id"), flat("n_y"), flat("far")
        group = n_y if by_class else np.zeros(len(ids), np.int32)
        order = np.lexsort((n_ids, far, group, ids))
        ids, y, b, n_ids, n_y, far, group = (c[order] for c in (ids, y, b, n_ids, n_y, far, group))
        first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (group[1:] != group[:-1]))) if len(ids) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(ids)))
        kept = np.flatnonzero(np.arange(len(ids)) - np.repeat(first, size) < k)
        held = np.repeat(np.minimum(size, k), size)
        kept = kept[np.lexsort((b[kept], ids[kept]))]
        ids, y, b, n_ids, n_y, far, held = (c[kept] for c in (ids, y, b, n_ids, n_y, far, held))
        new = np.append(True, (ids[1:] != ids[:-1]) | (b[1:] != b[:-1])) if len(ids) else np.empty(0, bool)
        line = np.cumsum(new) - 1
        return pa.table([pa.array(ids[new]), pa.array(y[new], pa.int32()), pa.array(b[new]), *lists(int(new.sum()), line, (n_ids, kinds[0]), (n_y, kinds[1]), (far, kinds[2]), (held.astype(np.int32), kinds[1]))], names=["row_id", "y", "b", "n_id", "n_y", "far", "many"])

    # A group of rows for merging: few enough that their candidates of all blocks are some ten megabytes.
    groups = sizes[0] * 16
    return found.groupBy(F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(groups))).applyInArrow(merge, "row_id long, y int, b long, n_id array<long>, n_y array<int>, far array<double>, many array<int>")


def closest(train: DataFrame, test: DataFrame, features: list[int], k: int, by_class: bool = False, metric: str = "square", block: int = 1024) -> DataFrame:
    """row_id, y, n_id, n_y, far: the k nearest training rows of each test row (ties by id); by_class: k of each class, itself left out.

    Distances are rounded to 9 digits.
    """
    lists = near_lists(train, test, features, k, blocks_of(test.count(), train.count(), len(features), block), by_class, metric)
    return lists.select("row_id", "y", F.explode(F.arrays_zip("n_id", "n_y", "far")).alias("e")).select("row_id", "y", "e.n_id", "e.n_y", "e.far")


def nearest(train: DataFrame, test: DataFrame, features: list[int], k: int = 5) -> DataFrame:
    """row_id, y, pred: majority of the k nearest training rows (ties: smaller id, smaller class)."""
    votes = closest(train, test, features, k).groupBy("row_id", "y", "n_y").agg(F.count(F.lit(1)).alias("v"))
    return votes.groupBy("row_id", "y").agg(F.max_by("n_y", F.struct("v", -F.col("n_y"))).alias("pred"))


def fitted(train: DataFrame, test: DataFrame, features: list[int], kind: str, seed: int = 42) -> DataFrame:
    """row_id, y, pred of a Spark ML classifier: forest (100 trees), logistic (scaled by the population deviation, C = 1) or linear_svm."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    pick = [F.col("x")[j] for j in features]
    if kind != "forest":
        row = train.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(pick)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(pick)]).first()
        pick = [(v - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, v in enumerate(pick)]
    shape = lambda df: df.select("row_id", "y", F.col("y").cast("double").alias("label"), array_to_vector(F.array(*pick)).alias("features"))
    if kind == "forest":
        model = RandomForestClassifier(numTrees=100, seed=seed)
    elif kind == "logistic":
        model = LogisticRegression(regParam=1 / max(1, train.count()), standardization=False, maxIter=2000)
    elif kind == "linear_svm":
        model = OneVsRest(classifier=LinearSVC(regParam=1 / max(1, train.count())))
    else:
        raise ValueError(f"unknown classifier {kind!r}")
    return model.fit(shape(train)).transform(shape(test)).select("row_id", "y", F.col("prediction").cast("int").alias("pred"))


def scaled(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """x of both by mean and population deviation of the training rows."""
    by = train.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()  # a row for each feature
    mean, sd = F.array(*[F.lit(float(r["m"])) for r in by]), F.array(*[F.lit(float(r["s"] or 1.0)) for r in by])
    scale = F.transform(F.arrays_zip(F.col("x").alias("v"), mean.alias("m"), sd.alias("s")), lambda z: (z["v"] - z["m"]) / z["s"])
    return train.withColumn("x", scale), test.withColumn("x", scale)


def evaluate(train: DataFrame, test: DataFrame, features: list[int], kind: str = "forest", seed: int = 42) -> dict[str, object]:
    """classifier, accuracy, balanced_accuracy, macro_f1, eval_seconds, n_selected, error. Nothing selected: zeros; an error: no scores and its text."""
    out: dict[str, object] = {"classifier": kind, "accuracy": 0.0, "balanced_accuracy": 0.0, "macro_f1": 0.0, "eval_seconds": 0.0, "n_selected": len(features), "error": None}
    if not features:
        return out
    began = time.perf_counter()
    train, test = no_nan(train), no_nan(test)
    try:
        if kind == "nearest":
            a, b = scaled(train, test)
            got = metrics(nearest(a, b, features)).first()
        elif kind == "svm":
            from . import kernel

            a, b = scaled(train, test)
            got = metrics(kernel.predict(a, b, features)).first()
        else:
            got = metrics(fitted(train, test, features, kind, seed)).first()
    except Exception as e:  # noqa: BLE001  the record says what happened
        return out | {"accuracy": None, "balanced_accuracy": None, "macro_f1": None, "error": f"{type(e).__name__}: {e}"[:4000]}
    return out | got.asDict() | {"eval_seconds": time.perf_counter() - began}


def evaluate_all(train: DataFrame, test: DataFrame, features: list[int], kinds: tuple[str, ...] = CLASSIFIERS, seed: int = 42) -> list[dict[str, object]]:
    return [evaluate(train, test, features, kind, seed) for kind in kinds]
