"""Vector bin packing of training examples under limits on tokens, segments and loss-bearing tokens.

Examples have ids and stretches of ids that bear loss. Whole sequences of a long example are cut off its front where the
limits allow; what is left of each example is dealt to buckets of bounded tokens and items. A bucket opens one sequence
after the other. Among the examples that fit what is left of it in every dimension, the one with the largest dot product
of its demand and the remaining room goes in, each dimension weighted by its total demand over its limit. Where nothing
fits as a whole, or one segment is left, the example with the largest product is cut to what the room holds. A sequence
that stays short of the limit is stored as sequences whose lengths are powers of two, which need no padding, so only the
padding of `fixed` lengths (power_of_two=False) depends on the limits. Without `cut`, only examples over a limit are cut.

Buckets follow from a hash of key and row, written with the ids before they are dealt: a hot source, a long example and
copies are spread alike, a lost task gives the same rows again, and nothing but the number of buckets depends on totals.

Null text is empty: one example that holds the end id. Repeated rows are packed once each. Columns other than the keys and
text (and role) are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import word_ids
from .common import saved, small_batches


@dataclass(frozen=True)
class VectorConfig:
    tokens: int = 4096
    segments: int = 256
    losses: int = 4096
    end_id: int = 2
    cut: bool = True
    power_of_two: bool = True
    path: str | None = None
    bucket_tokens: int = 4_000_000
    bucket_items: int = 10_000

    def __post_init__(self):
        if min(self.tokens, self.segments, self.losses) < 1:
            raise ValueError("every limit is at least 1")


def loss_below(bounds: list[int], at: int) -> int:
    """Loss-bearing ids before a place; bounds: start and end of each stretch, in order."""
    return sum(min(max(at - a, 0), z - a) for a, z in zip(bounds[::2], bounds[1::2]))


def longest(bounds: list[int], start: int, end: int, losses: int) -> int:
    """How many ids from start on, before end, bear at most `losses`."""
    left = losses
    for a, z in zip(bounds[::2], bounds[1::2]):
        a, z = max(a, start), min(z, end)
        if a < z:
            if z - a > left:
                return a + left - start
            left -= z - a
    return end - start


def place(sizes: list[int], bounds: list[list[int]], cfg: VectorConfig) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, first id, ids); every id of every item lies in one of them."""
    t = np.array(sizes, np.float64)
    loss = np.array([loss_below(b, n) for b, n in zip(bounds, sizes)], np.float64)
    item, done, out = np.arange(len(t)), np.zeros(len(t), np.int64), []
    weight = [x / limit**2 / limit for x, limit in ((t.sum(), cfg.tokens), (loss.sum(), cfg.losses))]
    alive, left = t > 0, int((t > 0).sum())
    while left:
        if 2 * left < len(t):
            t, loss, item, done = t[alive], loss[alive], item[alive], done[alive]
            alive = np.ones(left, bool)
        bin_, room, segments, losses = [], cfg.tokens, cfg.segments, cfg.losses
        while left and room and segments:
            # A segment is the same demand for every example, so its product decides nothing between them.
            score = t * (weight[0] * room) + loss * (weight[1] * losses)
            fits = alive & (t <= room) & (loss <= losses)
            if segments == 1 and cfg.cut:
                fits &= t == room
            if fits.any():
                i = int(np.argmax(np.where(fits, score, -1.0)))
                n = int(t[i])
            else:
                over = alive if cfg.cut else alive & ((t > cfg.tokens) | (loss > cfg.losses))
                if not over.any():
                    break
                i = int(np.argmax(np.where(over, score, -1.0)))
                n = longest(bounds[item[i]], int(done[i]), int(done[i] + min(t[i], room)), losses)
                if not n:
                    break
            k, a = int(item[i]), int(done[i])
            bears = loss_below(bounds[k], a + n) - loss_below(bounds[k], a)
            bin_.append((k, a, n))
            room, segments, losses = room - n, segments - 1, losses - bears
            t[i], loss[i], done[i] = t[i] - n, loss[i] - bears, a + n
            if not t[i]:
                alive[i] = False
                left -= 1
        out.append(bin_)
    return [s for b in out for s in (powers(b) if cfg.power_of_two and sum(n for *_, n in b) < cfg.tokens else [b])]


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of a sequence dealt to sequences of decreasing powers of two."""
    total, out, k, used = sum(n for *_, n in pieces), [], 0, 0
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out.append([])
        while room:
            i, a, n = pieces[k]
            m = min(room, n - used)
            out[-1].append((i, a + used, m))
            room, used = room - m, used + m
            if used == n:
                k, used = k + 1, 0
    return out


def examples(rows: DataFrame, keys: list[str], cfg: VectorConfig = VectorConfig(), bears: str | None = None) -> DataFrame:
    """keys, ids (of text, then the end id), loss: bounds of the stretches that bear loss. bears: a boolean column that tells
    whether a row's ids bear loss (null: no); all do where there is none."""
    path, end = cfg.path or word_ids.default_path(), cfg.end_id.to_bytes(4, "little")
    small_batches(rows.sparkSession)
    picked = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "text", (F.col(bears) if bears else F.lit(True)).alias("_bears"))

    def run(batches):
        import pyarrow as pa

        ids = word_ids.load(path).ids
        for b in batches:
            data = [ids(text) + end for text in b.column(len(keys)).to_pylist()]
            loss = [[0, len(x) // 4] if bears else [] for x, bears in zip(data, b.column(len(keys) + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(data, pa.binary()), pa.array(loss, pa.list_(pa.int64()))], [*keys, "ids", "loss"])

    own = [StructField(k, f.dataType) for k, f in zip(keys, picked.schema)]
    return picked.mapInArrow(run, StructType(own).add("ids", "binary").add("loss", ArrayType(LongType())))


def pack(given: DataFrame, keys: list[str], cfg: VectorConfig = VectorConfig()) -> DataFrame:
    """keys, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of the examples (keys, ids, loss)."""
    own = [StructField(k, given.schema[k].dataType) for k in keys]
    nk = len(keys)

    def cut(batches):
        """Full sequences are final; of the rest, the ids go on."""
        import pyarrow as pa

        row = TaskContext.get().partitionId() << 36
        for b in batches:
            out = []
            for i, (data, loss) in enumerate(zip(b.column(nk).to_pylist(), b.column(nk + 1).to_pylist())):
                n, at = len(data) // 4, 0
                while n - at > cfg.tokens or n - at == cfg.tokens and loss_below(loss, n) - loss_below(loss, at) <= cfg.losses:
                    m = longest(loss, at, at + cfg.tokens, cfg.losses)
                    whole = m == cfg.tokens
                    m = m or cfg.tokens
                    piece = data[4 * at : 4 * (at + m)]
                    out.append((i, at, m, zlib.crc32(piece), n, -1 - row if whole else 0, None if whole else piece, None if whole else _inside(loss, at, at + m)))
                    at, row = at + m, row + 1
                if at < n:
                    out.append((i, at, n - at, 0, n, row, data[4 * at :], _inside(loss, at, n)))
                    row += 1
            cols = list(zip(*out)) if out else [[]] * 8
            long = pa.int64()
            kinds = (long, long, long, long, long, pa.binary(), pa.list_(long))
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(cols[0], long)) for c in b.columns[:nk]], *[pa.array(c, t) for c, t in zip(cols[1:], kinds)]], [*keys, "start", "length", "ids_crc32", "doc_tokens", "row", "ids", "loss"])

    shape = StructType([*own, *[StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "row")]])
    pieces = saved(given.select(*keys, "ids", "loss").mapInArrow(cut, StructType([*shape]).add("ids", "binary").add("loss", ArrayType(LongType()))), "vector-pieces")
    rest = pieces.filter("ids is not null")
    total = rest.agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("items")).first()  # one row
    buckets = max(1, -(-int(total["n"] or 0) // cfg.bucket_tokens), -(-int(total["items"]) // cfg.bucket_items))
    result = StructType([*own, *[StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])

    def fill(t):
        import pyarrow as pa

        t = t.take(np.argsort(t.column("row").to_numpy(), kind="stable"))
        ids, base = t.column("ids").to_pylist(), t.column("start").to_numpy()
        first = int(t.column("bucket")[0].as_py()) << 32
        at, cols = [], [[] for _ in range(5)]
        for s, sequence in enumerate(place(t.column("length").to_pylist(), t.column("loss").to_pylist(), cfg)):
            offset = 0
            for i, a, n in sequence:
                at.append(i)
                for c, v in zip(cols, (int(base[i]) + a, n, zlib.crc32(ids[i][4 * a : 4 * (a + n)]), first + s, offset)):
                    c.append(v)
                offset += n
        held, at = t.combine_chunks(), pa.array(at, pa.int64())
        own_columns = [held.column(k).take(at) for k in range(nk)]
        number = lambda c: pa.array(c, pa.int64())
        return pa.table([*own_columns, *map(number, cols[:3]), held.column("doc_tokens").take(at), *map(number, cols[3:])], names=result.names)

    names = [*[f"_k{i}" for i in range(nk)], "start", "length", "doc_tokens", "row", "ids", "loss", "bucket"]
    dealt = rest.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *names[nk:])
    packed = dealt.groupBy("bucket").applyInArrow(fill, result)
    whole = pieces.filter("ids is null").select(*keys, "start", "length", "ids_crc32", "doc_tokens", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)


def _inside(loss: list[int], a: int, z: int) -> list[int]:
    """Bounds of the stretches within a piece, counted from its start."""
    return [x for s, e in zip(loss[::2], loss[1::2]) if max(s, a) < min(e, z) for x in (max(s, a) - a, min(e, z) - a)]


def pack_documents(docs: DataFrame, cfg: VectorConfig = VectorConfig()) -> DataFrame:
    """Pieces of whole documents, all of whose ids bear loss."""
    return pack(examples(docs, ["doc_id"], cfg), ["doc_id"], cfg)


def pack_turns(conversations: DataFrame, cfg: VectorConfig = VectorConfig(losses=2048), role: str = "assistant") -> DataFrame:
    """Pieces of turns of conversations; loss is borne by what one role says. A long conversation is many examples."""
    marked = conversations.select("conv_id", "turn", "text", (F.col("role") == role).alias("_role"))
    return pack(examples(marked, ["conv_id", "turn"], cfg, "_role"), ["conv_id", "turn"], cfg)
