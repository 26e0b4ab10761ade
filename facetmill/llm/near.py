"""Near-duplicate documents by bottom-k sketches: every pair of shingle sets with a Jaccard similarity of 80 % is linked.

A document's set holds 64-bit hashes of its distinct shingles. From this one hash function the sketch keeps the k
smallest values. Texts with equal sets are one class from the start and stand for themselves by their smallest doc_id.

Inverted lists are kept of runs of three neighbouring retained values. Two sets of similarity 0.8 agree on each of the
first k places of their union with probability 0.8 or more, so that k = 64 places hold no common run with probability
1.3e-10; sets of at most k values keep all of them, and then a common run always exists (a fifth of the places cannot
cut the rest into shorter runs; sets of up to five values also list runs of two). Lists are worked off in two rounds:

1. Stars: each list gives the pairs of its smallest document with the others. Pairs whose union sketch estimates a
   similarity of 0.4 or more are verified on full sets; links join components.
2. The rest: what is left to decide are pairs of one list in different components. Lists of up to `wide` documents give
   these pairs directly. Of wider lists, a document needs none if it has `enough` narrow ones (a pair of it that has no
   narrow list in common has a probability of 4e-8); the others are compared on full sets in blocks against blocks of
   their cluster of lists, with no cap, except blocks within one component. Blocks multiply 0/1 matrices of the values.

Null and empty texts have no shingles, n_shingles 0 and are linked with nothing. Rows with a null doc_id are kept and have
no component. Repeated doc_ids are one node: what any of their rows is linked with, all of them are.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, saved, small_batches
from .components import components
from .suffixes import _pack, _unpack

_U = np.uint64
#: Odd multipliers of the hashes.
_P, _K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xFF51AFD7ED558CCD)


@dataclass(frozen=True)
class NearConfig:
    shingle: int = 5
    #: Links have 100 * intersection >= percent * union.
    percent: int = 80
    k: int = 64
    wide: int = 32
    enough: int = 48
    block: int = 256
    estimate: float = 0.4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _K3
    x = (x ^ (x >> _U(29))) * _K1
    return x ^ (x >> _U(32))


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * _K2)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = []
        for base in (int(_P), pow(int(_P), -1, 1 << 64)):
            x = np.full(max(n, 1 << 19), base, np.uint64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS[0], _POWERS[1]


def word_hashes(data: bytes, offsets: np.ndarray, piece: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts that lie one after the other in data, and the number of the text of each word.

    Works on pieces of some 2 MB that end at white space, so a very long text needs no more memory than others.
    """
    hashes, at, start = [], [], 0
    while start < len(data):
        end = min(len(data), start + piece)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        own = offsets[(offsets > start) & (offsets < end)] - start
        h, where = _piece_hashes(data[start:end], np.concatenate(([0], own, [end - start])))
        hashes.append(h)
        at.append(np.searchsorted(offsets, where + start, side="right") - 1)
        start = end
    return (np.concatenate(hashes), np.concatenate(at)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _piece_hashes(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words."""
    low = np.frombuffer(data.lower(), np.uint8)  # bytes.lower changes A-Z alone
    n = len(low)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = word & (np.concatenate(([True], ~word[:-1])) | first[:n])
    end = word & (np.concatenate((~word[1:], [True])) | first[1:])
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_letters()[low] * power[:n], out=sums[1:])
    h = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _K1)
    return h, starts


def shingle_sets(column, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow string column (nulls: none)."""
    import pyarrow.compute as pc

    column = column if column.type == "large_binary" else pc.fill_null(column, "").cast("large_binary")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2].to_pybytes()[at[0] : at[-1]] if at[-1] > at[0] else b""
    words, doc = word_hashes(data, at - at[0])
    bounds = np.searchsorted(doc, np.arange(len(column) + 1))
    h = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        h = _mix(h * _P + words[j : j + len(h)])
    sets = []
    for a, z in zip(bounds[:-1], bounds[1:]):
        if z - a >= size:
            sets.append(np.unique(h[a : z - size + 1]))
        elif z > a:
            s = np.zeros(1, np.uint64)
            for w in words[a:z]:
                s = _mix(s * _P + w)
            sets.append(_mix(s + _U(z - a) * _K2))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def sketch_table(docs: DataFrame, cfg: NearConfig) -> DataFrame:
    """doc_id, n_shingles, sig (of the full set), sketch (the k smallest values)."""
    size, k = cfg.shingle, cfg.k

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sets = shingle_sets(b.column(1), size)
            sig = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.array([s[:k].tobytes() for s in sets], pa.binary())], ["doc_id", "n_shingles", "sig", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, sig binary, sketch binary")


def run_keys(sketch: np.ndarray) -> np.ndarray:
    """The distinct keys of a sketch's runs."""
    v = sketch
    if 4 <= len(v) <= 5:
        return np.unique(np.concatenate((_mix(v[:-2] * _P + v[1:-1] * _K2 + v[2:] * _K3), _mix(v[:-1] * _K2 + v[1:] * _K1 + _U(2)))))
    return np.unique(_mix(v[:-2] * _P + v[1:-1] * _K2 + v[2:] * _K3)) if len(v) > 2 else np.empty(0, np.uint64)


def _run_blocks(classes: DataFrame, buckets: int, cfg: NearConfig) -> DataFrame:
    """(bucket, block): keys with documents; a key that more than `crowd` documents of a block have goes to bucket -1, and one line for it to its own bucket."""
    crowd = 2 * cfg.wide

    def run(batches):
        import pyarrow as pa

        held: list[tuple[np.ndarray, int]] = []
        n = 0

        def out():
            key = np.concatenate([k for k, _ in held])
            doc = np.repeat(np.array([d for _, d in held], np.int64), [len(k) for k, _ in held])
            many = np.repeat(np.array([len(k) for k, _ in held], np.int32), [len(k) for k, _ in held])
            held.clear()
            _, number, count = np.unique(key, return_inverse=True, return_counts=True)
            hot = count[number] > crowd
            where, blocks = [], []
            if hot.any():
                where.append(-1)
                blocks.append(_pack(key[hot], doc[hot], many[hot], np.zeros(0, np.int64)))
                order = np.lexsort((doc[hot], key[hot]))
                k, d = key[hot][order], doc[hot][order]
                first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                key, doc, many = np.concatenate((key[~hot], k[first])), np.concatenate((doc[~hot], d[first])), np.concatenate((many[~hot], np.zeros(len(first), np.int32)))
                extra = np.concatenate((np.zeros((~hot).sum(), np.int64), np.diff(np.append(first, len(k)))))
            else:
                extra = np.zeros(len(key), np.int64)
            bucket = ((key >> _U(24)) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                i = order[bounds[b] : bounds[b + 1]]
                if len(i):
                    where.append(b)
                    blocks.append(_pack(key[i], doc[i], many[i], extra[i]))
            return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])

        for b in batches:
            for d, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append((run_keys(np.frombuffer(s, np.uint64)), d))
                n += len(held[-1][0])
            if n >= 400_000:
                yield out()
                n = 0
        if n:
            yield out()

    return classes.select("doc_id", "sketch").mapInArrow(run, "bucket int, block binary")


def _common_keys(t):
    """Per bucket: rows (key, doc, keys, n, pivot) of keys that several documents have; rows with hot set stand for keys of bucket -1."""
    import pyarrow as pa

    key, doc, many, extra = (np.concatenate(x) for x in zip(*[_unpack(b, "<u8", "<i8", "<i4", "<i8") for b in t.column("block").to_pylist()]))
    order = np.lexsort((doc, key))
    key, doc, many, extra = key[order], doc[order], many[order], extra[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    n = np.repeat(np.add.reduceat(np.maximum(extra, 1), first), size)
    pivot = np.repeat(doc[first], size)
    keep = n > 1
    # One hot row for a key is enough.
    again = np.concatenate(([False], (key[1:] == key[:-1]) & (extra[1:] > 0) & (np.maximum.accumulate(np.where(extra > 0, np.arange(len(key)), -1))[:-1] >= np.repeat(first, size)[1:])))
    keep &= ~again
    return pa.table({"key": pa.array(key[keep].view(np.int64)), "doc": pa.array(doc[keep]), "keys": pa.array(many[keep]), "n": pa.array(n[keep]), "pivot": pa.array(pivot[keep]), "hot": pa.array(extra[keep] > 0)})


def _lists(classes: DataFrame, cfg: NearConfig) -> DataFrame:
    """(key, doc, keys, n, pivot), written: the inverted lists of keys that several documents have; keys is the document's number of keys."""
    buckets = max(48, classes.count() * cfg.k // 500_000)
    blocks = saved(_run_blocks(classes, buckets, cfg), "near-keys")
    found = saved(blocks.filter("bucket >= 0").groupBy("bucket").applyInArrow(_common_keys, "key long, doc long, keys int, n long, pivot long, hot boolean"), "near-found")

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            for block in b.column(0).to_pylist():
                key, doc, many, _ = _unpack(block, "<u8", "<i8", "<i4", "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(many)], ["key", "doc", "keys"])

    cold = found.filter("not hot").drop("hot")
    crowded = blocks.filter("bucket < 0").select("block").mapInArrow(rows, "key long, doc long, keys int")
    lists = saved(cold.unionByName(crowded.join(found.filter("hot").select("key", "n", "pivot"), "key").select("key", "doc", "keys", "n", "pivot")), "near-lists")
    discard(blocks, found)
    return lists


def _estimated(pairs: DataFrame, sketches: DataFrame, cfg: NearConfig) -> DataFrame:
    """The pairs (a, b) whose union sketch estimates cfg.estimate or more."""
    k, least = cfg.k, cfg.estimate

    def run(batches):
        import pyarrow as pa

        none = _U(0xFFFFFFFFFFFFFFFF)
        for b in batches:
            if not b.num_rows:
                continue
            both = np.full((b.num_rows, 2 * k), none, np.uint64)
            for side in (2, 3):
                for i, s in enumerate(b.column(side).to_pylist()):
                    v = np.frombuffer(s, np.uint64)
                    both[i, (side - 2) * k : (side - 2) * k + len(v)] = v
            both.sort(axis=1)
            twice = both[:, 1:] == both[:, :-1]
            real = both[:, 1:] != none
            place = 1 + np.cumsum(~twice & real, axis=1)  # of the values of the union, counted from 1
            shared = (twice & real & (place <= k)).sum(axis=1)
            union = np.minimum(place[:, -1], k)
            keep = pa.array(np.flatnonzero(shared >= least * union))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])

    s = sketches.select(F.col("doc_id").alias("_i"), "sketch")
    both = pairs.join(s.withColumnRenamed("sketch", "sa"), F.col("a") == F.col("_i")).drop("_i").join(s.withColumnRenamed("sketch", "sb"), F.col("b") == F.col("_i")).select("a", "b", "sa", "sb")
    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                n = int((both[1:] == both[:-1]).sum())
                if 100 * n >= percent * (len(x) + len(y) - n):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])

    s = sets.select(F.col("doc_id").alias("_i"), "values")
    both = pairs.join(s.withColumnRenamed("values", "va"), F.col("a") == F.col("_i")).drop("_i").join(s.withColumnRenamed("values", "vb"), F.col("b") == F.col("_i")).select("a", "b", "va", "vb")
    return both.mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, cfg: NearConfig) -> DataFrame:
    """doc_id, values (sorted hashes) of the documents in ids."""
    size = cfg.shingle

    def press(batches):
        import pyarrow as pa
        import zstandard

        for b in batches:
            z = zstandard.ZstdCompressor(level=6)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress((t or "").encode()) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "text"])

    def run(batches):
        import pyarrow as pa
        import zstandard

        for b in batches:
            z = zstandard.ZstdDecompressor()
            for a in range(0, b.num_rows, 200):  # compressed rows grow
                part = b.slice(a, 200)
                texts = pa.array([z.decompress(t) for t in part.column(1).to_pylist()], pa.large_binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(texts, size)], pa.binary())], ["doc_id", "values"])

    # Compressed texts make the shuffle of the join a third of what it would be.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(press, "doc_id long, text binary")
    return texts.join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, values binary")


def block_links(ids: list[np.ndarray], sets: list[list[np.ndarray]], comps: list[np.ndarray], percent: int, columns: int = 4096) -> list[tuple[int, int]]:
    """Links between two blocks (or within one, if both are the same) across components: enough of them to connect what all of them connect."""
    sizes = [np.array([len(s) for s in block], np.int64) for block in sets]
    values = [np.concatenate(block) if block else np.empty(0, np.uint64) for block in sets]
    owner = [np.repeat(np.arange(len(block)), n) for block, n in zip(sets, sizes)]
    common = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
    shared = np.zeros((len(sets[0]), len(sets[1])), np.float32)
    at = []
    for v, o in zip(values, owner):
        i = np.searchsorted(common, v)
        hit = (i < len(common)) & (common[np.minimum(i, max(0, len(common) - 1))] == v) if len(common) else np.zeros(len(v), bool)
        order = np.argsort(i[hit], kind="stable")
        at.append((i[hit][order], o[hit][order]))
    for c in range(0, len(common), columns):
        parts = []
        for (i, o), block in zip(at, sets):
            a, z = np.searchsorted(i, (c, c + columns))
            m = np.zeros((len(block), min(columns, len(common) - c)), np.float32)
            m[o[a:z], i[a:z] - c] = 1
            parts.append(m)
        shared += parts[0] @ parts[1].T
    n = np.rint(shared).astype(np.int64)
    linked = (100 * n >= percent * (sizes[0][:, None] + sizes[1][None, :] - n)) & (comps[0][:, None] != comps[1][None, :])
    found, seen = [], (np.zeros(len(ids[0]), bool), np.zeros(len(ids[1]), bool))
    for root in np.flatnonzero(linked.any(axis=1)):
        todo = [(0, int(root))] if not seen[0][root] else []
        seen[0][root] = True
        while todo:
            side, i = todo.pop()
            new = np.flatnonzero((linked[i] if side == 0 else linked[:, i]) & ~seen[1 - side])
            seen[1 - side][new] = True
            found += [(int(ids[side][i]), int(ids[1 - side][j])) for j in new]
            todo += [(1 - side, int(j)) for j in new]
    return found


def _wide_links(rest: DataFrame, comps: DataFrame, sets: DataFrame, cfg: NearConfig) -> DataFrame:
    """Links across components among the documents of wide lists (key, doc, pivot, comp), in blocks against blocks."""
    percent = cfg.percent
    cluster = components(rest.select(F.col("doc").alias("a"), F.col("pivot").alias("b")))
    member = rest.select("doc", "comp").distinct().join(cluster.select(F.col("node").alias("doc"), F.col("root").alias("cluster")), "doc")
    member = saved(member, "near-members")
    big = member.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cfg.block // 2).select("cluster", "comp", F.lit(True).alias("big"))
    member = member.join(big, ["cluster", "comp"], "left").withColumn("kind", F.when(F.col("big"), F.col("comp")).otherwise(F.lit(-1).cast("long"))).drop("big")
    sizes = member.groupBy("cluster", "kind").agg(F.ceil(F.count(F.lit(1)) / cfg.block).cast("int").alias("blocks"))
    member = saved(member.join(sizes, ["cluster", "kind"]).withColumn("blk", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).select("cluster", "kind", "blk", "doc", "comp"), "near-blocks")
    blocks = sizes.select("cluster", "kind", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
    x, y = blocks.select("cluster", F.struct("kind", "blk").alias("x")), blocks.select("cluster", F.struct("kind", "blk").alias("y"))
    couples = x.join(y, "cluster").filter((F.col("x") <= F.col("y")) & ((F.col("x.kind") != F.col("y.kind")) | (F.col("x.kind") == -1)))
    couples = couples.withColumn("task", F.xxhash64("cluster", "x", "y"))
    sides = couples.select("cluster", "task", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("b")), F.struct(F.lit(1).alias("side"), F.col("y").alias("b")))).alias("s")).select("cluster", "task", "s.side", F.col("s.b.kind").alias("kind"), F.col("s.b.blk").alias("blk"))
    rows = member.join(sides, ["cluster", "kind", "blk"]).join(sets.withColumnRenamed("doc_id", "doc"), "doc").select("task", "side", "doc", "comp", "values")

    def run(t):
        import pyarrow as pa

        side, doc, comp = (t.column(c).to_numpy() for c in ("side", "doc", "comp"))
        values = [np.frombuffer(v, np.uint64) for v in t.column("values").to_pylist()]
        at = [np.flatnonzero(side == s) for s in (0, 1)]
        links = block_links([doc[i] for i in at], [[values[j] for j in i] for i in at], [comp[i] for i in at], percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return rows.groupBy("task").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, cfg: NearConfig = NearConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that is reachable), kept: a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    all_docs = saved(sketch_table(docs, cfg).withColumn("uid", F.monotonically_increasing_id()), "near-sketches")
    known = all_docs.filter("n_shingles > 0 and doc_id is not null")
    # Equal sets: their table is written, so that the join with it is a plain one whose crowded classes are dealt to many tasks.
    first = saved(known.groupBy("sig").agg(F.min(F.struct("doc_id", "uid")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("sig"), F.col("f.doc_id").alias("rep"), F.col("f.uid").alias("first")), "near-copies")
    sketch = F.when(F.col("uid") == F.col("first"), F.col("sketch"))
    same = known.join(first, "sig", "left").withColumn("first", F.coalesce("first", "uid")).select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), sketch.alias("sketch"), "sig")
    other = all_docs.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("binary").alias("sketch"), "sig")
    members = saved(same.unionByName(other), "near-classes")
    discard(all_docs, first)
    twice = _one_node(members)
    classes = members.filter("sketch is not null").select("doc_id", "sketch")
    lists = rows = _lists(classes, cfg)
    release(spark)
    wide = F.col("n") > cfg.wide
    spare = rows.filter(wide).groupBy("doc").agg(F.count(F.lit(1)).alias("w"), F.max("keys").alias("keys")).filter(F.col("keys") - F.col("w") >= cfg.enough).select("doc")
    narrow, spared = rows.filter(~wide).join(spare.withColumn("off", F.lit(True)), "doc", "left"), rows.filter(wide).join(spare, "doc", "left_anti")
    rows = saved(narrow.withColumn("off", F.coalesce("off", F.lit(False))).unionByName(spared.withColumn("off", F.lit(False))), "near-kept-lists")
    discard(lists)
    sets = saved(full_sets(docs, rows.select(F.col("doc").alias("doc_id")).unionByName(rows.select(F.col("pivot").alias("doc_id"))).distinct(), cfg), "near-sets")
    release(spark)

    stars = rows.filter("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    links = _verified(_estimated(stars, classes, cfg), sets, cfg.percent)
    if twice is not None:  # the sets of one doc_id are one node
        links = links.unionByName(twice.filter("rep is not null").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    comps = saved(components(saved(links, "near-links")), "near-components")
    release(spark)

    placed = rows.join(comps, F.col("doc") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "doc")).drop("node", "root")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    rest = saved(placed.join(mixed, "key", "left_semi"), "near-rest")
    narrow = rest.filter(~wide)
    x, y = narrow.select("key", F.col("doc").alias("a"), F.col("comp").alias("ca"), F.col("keys").alias("ka"), F.col("off").alias("oa")), narrow.select("key", F.col("doc").alias("b"), F.col("comp").alias("cb"), F.col("keys").alias("kb"), F.col("off").alias("ob"))
    pairs = x.join(y, "key").filter("a < b and ca <> cb").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.least("ka", "kb")).alias("keys"), F.max(F.col("oa") | F.col("ob")).alias("off"))
    # Pairs with full sketches have fewer than three runs in common with a probability of 1.4e-8; documents off their wide lists have more often.
    pairs = pairs.filter((F.col("n") >= 3) | (F.col("keys") < cfg.k - 2) | F.col("off")).select("a", "b")
    more = saved(_verified(_estimated(pairs, classes, cfg), sets, cfg.percent), "near-links")
    if rest.filter(wide).limit(1).count():
        more = more.unionByName(saved(_wide_links(rest.filter(wide), comps, sets, cfg), "near-links"))
    if more.limit(1).count():
        # Components of the first round are single nodes now.
        c = comps.select("node", "root")
        over = more.join(c.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(c.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        over = components(over.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
        every = c.unionByName(over.select(F.col("root").alias("node"), "root").join(c, "node", "left_anti")).join(over, "root", "left")
        comps = saved(every.select("node", F.coalesce("top", "root").alias("root")), "near-components")
    discard(sets, rows)
    comps = comps.select(F.col("node").alias("rep"), "root")
    if twice is not None:  # rows without words are the node of the doc_id's other rows
        have = twice.filter("least is not null").select("doc_id", "least").distinct()
        members = members.join(have, "doc_id", "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "least")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    out = members.join(comps, "rep", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _one_node(members: DataFrame) -> DataFrame | None:
    """doc_id, rep, least of the doc_ids whose rows have different sets: each class's rep and the least of them; None if there are none."""
    several = members.filter("doc_id is not null").groupBy("doc_id").agg(F.min("sig").alias("x"), F.max("sig").alias("y"), F.min("rep").alias("least")).filter("x <> y").select("doc_id", "least")
    several = saved(several, "near-repeated")
    return saved(members.join(several, "doc_id").select("doc_id", "rep", "least").distinct(), "near-repeated") if several.limit(1).count() else None


def keep_one(docs: DataFrame, cfg: NearConfig = NearConfig()) -> DataFrame:
    """docs with one document of each component (the smallest doc_id); its columns stay as they are, whatever their names.

    Rows of one doc_id are one document: if it stays, every different text of it stays once, with the least row (as JSON).
    """
    found = saved(near_duplicates(docs, cfg), "near-result")
    row = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct("*").alias("_doc"))
    left = row.join(found.filter("not kept").select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_anti")
    again = found.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).count().filter("count > 1").select("_id")
    again = saved(again, "near-again")
    if again.limit(1).count():
        least = left.join(again, "_id", "left_semi").groupBy("_id", F.col("_doc.text").alias("_t")).agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc"))
        left = left.join(again, "_id", "left_anti").unionByName(least.select("_id", "_doc"))
    return left.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
