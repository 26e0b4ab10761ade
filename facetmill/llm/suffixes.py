"""Removal of repeated byte strings by a distributed merge sort of suffixes that keeps track of common prefixes.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id. Every string of
50 bytes has an anchor: the place of the smallest hash among its 27 strings of 24 bytes. Equal strings have equal
anchors, so it is enough to sort the suffixes that start at anchors (about 7 in 100), and of them those whose 24
bytes occur in two different texts:

1. Anchors. Every task sends its anchors' hashes, by buckets of the hash; a bucket finds the hashes that two different
   texts hold, and sends their places back to the documents, by shards of the doc_id. Of equal texts only the one
   with the smallest doc_id is looked at further; the others go as a whole (if they have `length` bytes).
2. Runs. Each shard cuts the surviving suffixes (the first 50 bytes, which is all that can matter) out of its texts,
   sorts them, and sends them as front-coded runs: only what differs from the run's previous suffix is written.
3. Merge. A bucket combines its runs with a loser tree. Every contender carries the length of its prefix in common with
   the last winner; contenders of different lengths are decided without reading a byte, those of equal length are
   compared from that length on. Out come the suffixes in order with their common prefix lengths.
4. Spans. A string at offset o before its anchor is equal for neighbours in that order with a common prefix of at least
   50 - o, if the o bytes before the anchor are equal as well (grouped by hash, then compared). The smallest doc_id of each such group decides, and the
   covered bytes go back to the documents as intervals.

Matches never cross documents, all strings are judged on the input. Null text is empty; a null doc_id counts as the
largest; rows of one doc_id never remove each other's bytes. Row columns are carried as they are.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import discard, release, saved, small_batches

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xFF51AFD7ED558CCD)
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class SuffixConfig:
    length: int = 50
    #: Bytes of an anchor; a multiple of 8.
    anchor: int = 24
    bytes_per_shard: int = 8_000_000
    least_shards: int = 48
    flush: int = 3_000_000

    @property
    def reach(self) -> int:
        """How far before its anchor a string can start."""
        return self.length - self.anchor


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _C
    x = (x ^ (x >> _U(29))) * _A
    return x ^ (x >> _U(32))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number."""
    n = len(data) - 7
    v = np.empty(n, np.uint64)
    raw = data.tobytes()
    for o in range(8):
        m = len(range(o, n, 8))
        v[o::8] = np.frombuffer(raw, "<u8", m, o)
    return v


def gram_hashes(v: np.ndarray, n: int, anchor: int) -> np.ndarray:
    """The hash of the `anchor` bytes at each of n places, from _words; never 0."""
    h = v[:n] * _A
    for o in range(8, anchor, 8):
        h = (h ^ (h >> _U(31))) * _B + v[o : o + n]
    return _mix(h) | _U(1)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each window of width values."""
    s = 1
    while 2 * s <= width:
        x = pick(x[:-s], x[s:])
        s *= 2
    return pick(x[: len(x) - (width - s)], x[width - s :]) if s < width else x


def anchors(data: np.ndarray, offsets: np.ndarray, cfg: SuffixConfig, piece: int = 1_500_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, place in its text) of the anchors of texts that lie one after the other in data.

    Works on pieces that overlap by less than a string, so that each string lies in a piece, whatever a text's length.
    """
    found = []
    for start in range(0, max(1, len(data) - cfg.length + 1), piece):
        end = min(len(data), start + piece + cfg.length - 1)
        own = offsets[(offsets > start) & (offsets < end)] - start
        h, at = _piece_anchors(data[start:end], np.concatenate(([0], own, [end - start])), cfg)
        found.append((h, at + start))
    h, at = (np.concatenate(x) for x in zip(*found))
    if len(found) > 1:
        at, first = np.unique(at, return_index=True)
        h = h[first]
    doc = np.searchsorted(offsets, at, side="right") - 1
    return h, doc, at - offsets[doc]


def _piece_anchors(data: np.ndarray, offsets: np.ndarray, cfg: SuffixConfig) -> tuple[np.ndarray, np.ndarray]:
    w = cfg.reach + 1
    m = len(data) - cfg.anchor + 1
    if len(data) < cfg.length:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = gram_hashes(_words(data), m, cfg.anchor)
    least = _slide(h, w, np.minimum)
    # Strings must lie in one text: blank those that start less than `length` bytes before a text's end.
    inside = np.zeros(len(least) + 1, np.int32)
    a, z = offsets[:-1], offsets[1:] - cfg.length + 1
    np.add.at(inside, a[z > a], 1)
    np.add.at(inside, z[z > a], -1)
    least[np.cumsum(inside[:-1]) == 0] = 0
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate((pad, least, pad)), w, np.maximum)[:m] == h)
    return h[at], at


def _shard(ids: np.ndarray, n: int) -> np.ndarray:
    return (_mix(ids.astype(np.int64).view(np.uint64) * _B + _A) % _U(n)).astype(np.int64)


def _texts(column) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast("large_binary")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    return data, at - at[0]


def _ids(column) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(column.cast("int64"), LAST).to_numpy(zero_copy_only=False)


def _tags(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits of each text's SHA-256 as two numbers."""
    raw = data.tobytes()
    return np.frombuffer(b"".join(hashlib.sha256(raw[a:z]).digest()[:16] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())), "<u8").reshape(-1, 2)


def _pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    import zstandard

    parts = [np.array([len(arrays), *[a.nbytes for a in arrays]], "<i8").tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def _unpack(block: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    (n,) = np.frombuffer(raw, "<i8", 1)
    sizes, at, out = np.frombuffer(raw, "<i8", n, 8), 8 + 8 * int(n), []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def _rows(where: list[int], blocks: list[bytes], name: str):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blocks, pa.binary())], [name, "block"])


def _anchor_blocks(docs: DataFrame, buckets: int, cfg: SuffixConfig) -> DataFrame:
    """(bucket, block): blocks hold hashes, text numbers, places, and each text's doc_id and tag."""

    def run(batches):
        held, texts = [], []

        def flush():
            h, doc, at = (np.concatenate(x) for x in zip(*held))
            ids, tags = np.concatenate([t[0] for t in texts]), np.concatenate([t[1] for t in texts])
            held.clear()
            texts.clear()
            bucket = ((h >> _U(24)) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            where, blocks = [], []
            for k in range(buckets):
                i = order[bounds[k] : bounds[k + 1]]
                if len(i):
                    used, number = np.unique(doc[i], return_inverse=True)
                    where.append(k)
                    low = h[i] & _U(0xFFFFFFFFFFFF)  # 48 bits: a chance meeting only costs a comparison
                    blocks.append(_pack(low.astype("<u4"), (low >> _U(32)).astype("<u2"), number.astype("<u4"), at[i].astype("<u4"), ids[used], tags[used]))
            return _rows(where, blocks, "bucket")

        n = seen = 0
        for b in batches:
            data, offsets = _texts(b.column(1))
            h, doc, at = anchors(data, offsets, cfg)
            held.append((h, doc + seen, at))
            texts.append((_ids(b.column(0)), _tags(data, offsets)))
            seen += b.num_rows
            n += len(h)
            if n >= cfg.flush:
                yield flush()
                n = seen = 0
        if n:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, block binary")


def _number(tags: np.ndarray) -> np.ndarray:
    """Numbers of equal rows of two columns."""
    order = np.lexsort((tags[:, 1], tags[:, 0]))
    t = tags[order]
    new = np.concatenate(([0], np.cumsum((t[1:] != t[:-1]).any(axis=1)))) if len(t) else np.empty(0, np.int64)
    out = np.empty(len(tags), np.int64)
    out[order] = new
    return out


def _shared(shards: int):
    """Per bucket: the anchors whose hash occurs in two different texts, addressed to the smallest doc_id of each text."""

    def run(t):
        import pyarrow as pa

        parts, base = [], 0
        for block in t.column("block").to_pylist():
            low, high, number, at, ids, tags = _unpack(block, "<u4", "<u2", "<u4", "<u4", "<i8", "<u8")
            parts.append((low.astype(np.uint64) | high.astype(np.uint64) << _U(32), number.astype(np.int64) + base, at, ids, tags.reshape(-1, 2)))
            base += len(ids)
        h, number, at, ids, tags = (np.concatenate(x) for x in zip(*parts))
        text = _number(tags)
        content = text[number]
        order = np.lexsort((ids[number], content, h))
        h, number, content, at = h[order], number[order], content[order], at[order]
        new_hash = np.concatenate(([True], h[1:] != h[:-1]))
        new_text = new_hash | np.concatenate(([True], content[1:] != content[:-1]))
        group = np.cumsum(new_hash) - 1
        several = np.bincount(group, weights=new_text)[group] > 1
        # Of equal texts, the first in this order has the smallest doc_id; all its places are kept.
        start = np.maximum.accumulate(np.where(new_text, np.arange(len(h)), 0))
        keep = several & (ids[number] == ids[number[start]])
        number, at = number[keep], at[keep]
        where = _shard(ids[number], shards)
        order = np.argsort(where, kind="stable")
        bounds = np.searchsorted(where[order], np.arange(shards + 1))
        out, blocks = [], []
        for k in range(shards):
            i = order[bounds[k] : bounds[k + 1]]
            if len(i):
                out.append(k)
                blocks.append(_pack(ids[number[i]], tags[number[i], 0], at[i]))
        return pa.table({"shard": pa.array(out, pa.int32()), "block": pa.array(blocks, pa.binary())})

    return run


def _sharded(docs: DataFrame, shards: int) -> DataFrame:
    """docs with shard, a compressed text, tag and size in place of text."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = StructType([*others, StructField("_shard", IntegerType()), StructField("_id", LongType()), StructField("_tag", LongType()), StructField("_text", BinaryType())])
    names = [f.name for f in others]

    def run(batches):
        import pyarrow as pa
        import zstandard

        for b in batches:
            data, offsets = _texts(b.column(len(names)))
            ids = _ids(b.column(len(names) + 1))
            press, raw = zstandard.ZstdCompressor(level=6), data.tobytes()
            blobs = [press.compress(raw[a:z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            tags = np.ascontiguousarray(_tags(data, offsets)[:, 0]).view(np.int64)
            more = [pa.array(_shard(ids, shards).astype(np.int32)), pa.array(ids), pa.array(tags), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], *more], [*names, "_shard", "_id", "_tag", "_text"])

    return docs.select(*names, "text", F.col("doc_id").cast("long").alias("_id")).mapInArrow(run, schema)


def front_code(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rows of bytes -> (common prefix with the row before, the bytes after it one after the other)."""
    same = np.zeros(len(suffixes), np.int64)
    if len(suffixes) > 1:
        differ = suffixes[1:] != suffixes[:-1]
        same[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), suffixes.shape[1])
    return same.astype(np.uint8), suffixes[np.arange(suffixes.shape[1])[None, :] >= same[:, None]]


def front_decode(same: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    """The rows of front_code."""
    out = np.zeros((len(same), width), np.uint8)
    out[np.arange(width)[None, :] >= same[:, None].astype(np.int64)] = rest
    # Column by column, a row takes the byte of the last row that wrote this column.
    rows = np.arange(len(same))
    for c in range(width):
        out[:, c] = out[np.maximum.accumulate(np.where(same <= c, rows, 0)), c]
    return out


def _cut_runs(buckets: int, cfg: SuffixConfig):
    """Per shard: front-coded runs of the surviving suffixes, by bucket."""

    def run(places, texts):
        import pyarrow as pa
        import zstandard

        empty = pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.binary())})
        if not places.num_rows or not texts.num_rows:
            return empty
        ids, tags, at = (np.concatenate(x) for x in zip(*[_unpack(b, "<i8", "<u8", "<u4") for b in places.column("block").to_pylist()]))
        order = np.lexsort((at, tags, ids))
        ids, tags, at = ids[order], tags[order], at[order].astype(np.int64)
        bounds = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]), [True])))
        wanted = {(int(ids[a]), int(tags[a])): (a, z) for a, z in zip(bounds[:-1], bounds[1:])}
        before, length = cfg.reach, cfg.length
        left, right, rows, room = [], [], [], []
        for i, t, blob in zip(texts.column("_id").to_pylist(), texts.column("_tag").to_numpy().view(np.uint64).tolist(), texts.column("_text").to_pylist()):
            a, z = wanted.pop((i, t), (0, 0))  # one of equal rows
            if z == a:
                continue
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
            wide = np.zeros(before + len(data) + length, np.uint8)
            wide[before : before + len(data)] = data
            p = at[a:z]
            window = np.lib.stride_tricks.sliding_window_view(wide, before + length)[p]
            left.append(window[:, :before][:, ::-1])
            right.append(window[:, before:])
            rows.append(np.arange(a, z))
            room.append(np.stack((np.minimum(p, before), np.minimum(len(data) - p, length)), axis=1))
        if not rows:
            return empty
        left, right, rows, room = (np.concatenate(x) for x in (left, right, rows, room))
        gram = _row_hashes(right, cfg.anchor)
        bucket = ((gram >> _U(24)) % _U(buckets)).astype(np.int64)
        order = _order(right, bucket)
        left, right, rows, room, bucket = left[order], right[order], rows[order], room[order], bucket[order]
        bounds = np.searchsorted(bucket, np.arange(buckets + 1))
        where, blocks = [], []
        for k in range(buckets):
            a, z = int(bounds[k]), int(bounds[k + 1])
            if z > a:
                same, rest = front_code(right[a:z])
                where.append(k)
                blocks.append(_pack(same, rest, left[a:z], room[a:z].astype(np.uint8), ids[rows[a:z]], tags[rows[a:z]], at[rows[a:z]].astype("<u4"), level=5))
        return pa.table({"bucket": pa.array(where, pa.int32()), "block": pa.array(blocks, pa.binary())})

    return run


def _row_hashes(rows: np.ndarray, anchor: int) -> np.ndarray:
    """gram_hashes of the first bytes of each row."""
    v = np.ascontiguousarray(rows[:, :anchor]).view("<u8")
    h = v[:, 0] * _A
    for o in range(1, anchor // 8):
        h = (h ^ (h >> _U(31))) * _B + v[:, o]
    return _mix(h) | _U(1)


def _order(rows: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The order of rows of bytes within their buckets."""
    n = -(-rows.shape[1] // 8)
    wide = np.zeros((len(rows), 8 * n), np.uint8)
    wide[:, : rows.shape[1]] = rows
    v = wide.view(">u8")
    return np.lexsort((*[v[:, c] for c in range(n - 1, -1, -1)], bucket))


class LoserTree:
    """Merges sorted runs of (suffix, common prefix with the run's previous suffix).

    Each inner node holds the loser of its match with the length of its prefix in common with the winner that passed it,
    which is the last winner over all once it has won. So all contenders on a leaf's way up know their common prefix
    with the same string.
    """

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs, n = runs, len(runs)
        self.size = 1
        while self.size < n:
            self.size *= 2
        self.at = [0] * n
        self.node: list[tuple[int, int]] = [(-1, 0)] * self.size
        self.best = self._build(1)

    def _head(self, r: int) -> bytes:
        return self.runs[r][0][self.at[r]]

    def _match(self, x: tuple[int, int], y: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """(winner, loser) of two (run, common prefix with the last winner); run -1 has ended."""
        if x[0] < 0:
            return y, x
        if y[0] < 0 or x[1] > y[1]:
            return x, y
        if x[1] < y[1]:
            return y, x
        a, b, h = self._head(x[0]), self._head(y[0]), x[1]
        if a == b:
            return (x, (y[0], len(a))) if x[0] < y[0] else (y, (x[0], len(a)))
        p, q = a[h:], b[h:]
        h += len(p) - ((int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_length() + 7) // 8
        return (x, (y[0], h)) if p < q else (y, (x[0], h))

    def _build(self, i: int) -> tuple[int, int]:
        if i >= self.size:
            r = i - self.size
            return (r, 0) if r < len(self.runs) and self.runs[r][0] else (-1, 0)
        win, self.node[i] = self._match(self._build(2 * i), self._build(2 * i + 1))
        return win

    def __iter__(self):
        """(run, index in it, common prefix with what came before) in order."""
        best, node, at, size, match = self.best, self.node, self.at, self.size, self._match
        while best[0] >= 0:
            r, h = best
            yield r, at[r], h
            at[r] += 1
            best = (r, self.runs[r][1][at[r]]) if at[r] < len(self.runs[r][0]) else (-1, 0)
            i = (size + r) // 2
            while i:
                best, node[i] = match(best, node[i])
                i //= 2


def _merged(blocks: list[bytes], cfg: SuffixConfig):
    """Runs -> (rows of all runs in order of suffixes, common prefix lengths, run arrays one after the other)."""
    runs, parts, starts, base = [], [], [], 0
    for block in blocks:
        same, rest, left, room, ids, tags, at = _unpack(block, np.uint8, np.uint8, np.uint8, np.uint8, "<i8", "<u8", "<u4")
        suffixes = front_decode(same, rest, cfg.length)
        # Equal suffixes of a run are one contender.
        first = np.flatnonzero(same < cfg.length)
        raw = suffixes[first].tobytes()
        runs.append(([raw[i * cfg.length : (i + 1) * cfg.length] for i in range(len(first))], same[first].tolist()))
        starts.append((base + first, np.diff(np.append(first, len(same)))))
        parts.append((left.reshape(-1, cfg.reach), room.reshape(-1, 2), ids, tags, at))
        base += len(same)
    run, index, common = [], [], []
    for r, i, h in LoserTree(runs):
        run.append(r)
        index.append(i)
        common.append(h)
    shift = np.cumsum([0, *[len(s[0]) for s in starts]])
    pick = shift[np.array(run, np.int64)] + np.array(index, np.int64)
    begin, many = np.concatenate([s[0] for s in starts])[pick], np.concatenate([s[1] for s in starts])[pick]
    order = np.repeat(begin - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    lcp = np.full(len(order), cfg.length, np.int64)
    lcp[np.concatenate(([0], np.cumsum(many)[:-1])).astype(np.int64)] = common
    return order, lcp, [np.concatenate(x) for x in zip(*parts)]


def _masks(width: int) -> np.ndarray:
    """masks[o]: of rows of bytes as big-endian numbers, the first o bytes."""
    n = -(-width // 8)
    keep = np.arange(8 * n)[None, :] < np.arange(width + 1)[:, None]
    return (keep * np.uint8(255)).astype(np.uint8).view(">u8")


def _exact(left: np.ndarray, o: int) -> np.ndarray:
    """Numbers of the first o bytes of each row."""
    return np.unique(left[:, :o], axis=0, return_inverse=True)[1].reshape(-1).astype(np.uint64)


def _spans(shards: int, cfg: SuffixConfig):
    """Per bucket: merge the runs and find the covered bytes, addressed to their documents' shards."""

    def run(t):
        import pyarrow as pa

        order, lcp, (left, room, ids, tags, at) = _merged(t.column("block").to_pylist(), cfg)
        left, room, ids, tags, at = left[order], room[order].astype(np.int64), ids[order], tags[order], at[order].astype(np.int64)
        n = len(order)
        wide = np.zeros((n, 8 * (-(-cfg.reach // 8))), np.uint8)
        wide[:, : cfg.reach] = left
        wide, masks = wide.view(">u8"), _masks(cfg.reach)
        far, near = np.full(n, -1, np.int64), np.full(n, cfg.reach + 1, np.int64)  # largest and smallest offset of a covered string
        prefix = np.zeros(n, np.uint64)
        found = []
        for o in range(cfg.reach + 1):
            if o:
                prefix = _mix(prefix * _A + left[:, o - 1].astype(np.uint64) + _U(1))
            ok = np.flatnonzero((room[:, 0] >= o) & (room[:, 1] >= cfg.length - o))
            if not len(ok):
                continue
            group = np.cumsum(lcp < cfg.length - o)[ok]
            key = prefix[ok]
            by = np.lexsort((ids[ok], key, group))
            g, k, i = group[by], key[by], ok[by]
            new = np.concatenate(([True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])))
            if o and (((wide[i][1:] ^ wide[i][:-1]) & masks[o]).any(axis=1) & ~new[1:]).any():  # different bytes of one hash: number them instead
                key = _exact(left[ok], o)
                by = np.lexsort((ids[ok], key, group))
                g, k, i = group[by], key[by], ok[by]
                new = np.concatenate(([True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])))
            least = ids[i][np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))]
            hit = i[least < ids[i]]
            # Offsets come in runs; a run that ends is a span of its own.
            over = hit[(far[hit] >= 0) & (far[hit] < o - 1)]
            if len(over):
                found.append((over, at[over] - far[over], at[over] - near[over] + cfg.length))
                near[over] = o
            near[hit] = np.minimum(near[hit], o)
            far[hit] = o
        rows = np.flatnonzero(far >= 0)
        found.append((rows, at[rows] - far[rows], at[rows] - near[rows] + cfg.length))
        rows, start, end = (np.concatenate(x) for x in zip(*found))
        where = _shard(ids[rows], shards)
        order = np.lexsort((start, ids[rows], where))
        bounds = np.searchsorted(where[order], np.arange(shards + 1))
        out, blocks = [], []
        for k in range(shards):
            i = order[bounds[k] : bounds[k + 1]]
            if len(i):
                out.append(k)
                blocks.append(_pack(ids[rows[i]], tags[rows[i]], start[i].astype("<u4"), end[i].astype("<u4")))
        return pa.table({"shard": pa.array(out, pa.int32()), "block": pa.array(blocks, pa.binary())})

    return run


def _copies(facts: DataFrame, shards: int, cfg: SuffixConfig) -> DataFrame:
    """(shard, block) of spans over the whole of texts that a smaller doc_id has as well."""
    first = facts.groupBy("sig").agg(F.min("_id").alias("_first"))
    copies = facts.filter(F.col("n_bytes") >= cfg.length).join(first, "sig").filter("_id > _first").select("_id", "sig", "n_bytes")

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            tags = np.frombuffer(b"".join(s[:8] for s in b.column(1).to_pylist()), "<u8")
            size = b.column(2).to_numpy()
            where = _shard(ids, shards)
            order = np.argsort(where, kind="stable")
            used, at = np.unique(where[order], return_index=True)
            parts = [order[a:z] for a, z in zip(at, [*at[1:], len(order)])]
            if len(used):
                yield _rows(used.tolist(), [_pack(ids[i], tags[i], np.zeros(len(i), "<u4"), size[i].astype("<u4")) for i in parts], "shard")

    return copies.mapInArrow(run, "shard int, block binary")


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by start: overlapping and touching spans become one."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return start[at], reach[np.append(at[1:] - 1, len(end) - 1)]


def remove_repeats(docs: DataFrame, cfg: SuffixConfig = SuffixConfig(), as_text: bool = False) -> DataFrame:
    """docs with _kept (the remaining bytes, or the characters that are whole in them), _n_bytes, _n_removed and _spans (removed runs as [start, end]) in place of text."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    oid = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    facts = saved(docs.select(oid.alias("_id"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("sig"), F.octet_length(text).cast("long").alias("n_bytes")), "suffix-facts")
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(cfg.least_shards, -(-total // cfg.bytes_per_shard))
    near = saved(_anchor_blocks(docs, shards, cfg).groupBy("bucket").applyInArrow(_shared(shards), "shard int, block binary"), "suffix-places")
    release(spark)
    runs = near.groupBy("shard").cogroup(_sharded(docs.select("doc_id", "text"), shards).groupBy("_shard")).applyInArrow(_cut_runs(shards, cfg), "bucket int, block binary")
    spans = saved(runs.groupBy("bucket").applyInArrow(_spans(shards, cfg), "shard int, block binary").unionByName(_copies(facts, shards, cfg)), "suffix-spans")
    discard(near, facts)
    release(spark)
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = StructType([*others, StructField("_n_bytes", LongType()), StructField("_n_removed", LongType())])
    schema = schema.add("_spans", ArrayType(ArrayType(LongType()))).add("_kept", StringType() if as_text else BinaryType())
    names = [f.name for f in others]

    def cut(spans, texts):
        import pyarrow as pa
        import zstandard

        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if spans.num_rows:
            ids, tags, start, end = (np.concatenate(x) for x in zip(*[_unpack(b, "<i8", "<u8", "<u4", "<u4") for b in spans.column("block").to_pylist()]))
            order = np.lexsort((start, tags, ids))
            ids, tags, start, end = ids[order], tags[order], start[order].astype(np.int64), end[order].astype(np.int64)
            bounds = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]), [True])))
            found = {(int(ids[a]), int(tags[a])): merge_spans(start[a:z], end[a:z]) for a, z in zip(bounds[:-1], bounds[1:])}
        size, gone, where, kept = [], [], [], []
        for i, t, blob in zip(texts.column("_id").to_pylist(), texts.column("_tag").to_numpy().view(np.uint64).tolist(), texts.column("_text").to_pylist()):
            data = zstandard.ZstdDecompressor().decompress(blob)
            start, end = found.get((i, t), (np.empty(0, np.int64), np.empty(0, np.int64)))
            edges = [0, *np.stack((start, end), axis=1).ravel().tolist(), len(data)]
            kept.append(b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2])))
            size.append(len(data))
            gone.append(len(data) - len(kept[-1]))
            where.append(np.stack((start, end), axis=1).tolist())
        more = {"_n_bytes": pa.array(size, pa.int64()), "_n_removed": pa.array(gone, pa.int64()), "_spans": pa.array(where, pa.list_(pa.list_(pa.int64()))), "_kept": pa.array([x.decode(errors="ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())}
        return pa.table({**{n: texts.column(n) for n in names}, **more})

    return spans.groupBy("shard").cogroup(_sharded(docs, shards).groupBy("_shard")).applyInArrow(cut, schema)


def repeat_report(docs: DataFrame, cfg: SuffixConfig = SuffixConfig()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans."""
    out = remove_repeats(docs.select("doc_id", "text"), cfg)
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"), F.col("_spans").alias("spans"))


def strip_repeats(docs: DataFrame, cfg: SuffixConfig = SuffixConfig()) -> DataFrame:
    """docs with the remaining text (bytes of cut characters go too); n_chars follows the text; texts of which nothing remains go."""
    out = remove_repeats(docs, cfg, True).filter("_n_removed = 0 or _n_removed < _n_bytes").withColumnRenamed("_kept", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
