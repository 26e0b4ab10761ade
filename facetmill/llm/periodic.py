"""Runs of repeated word sequences in texts, and texts with their repetitions collapsed.

A run of period p is a stretch of words in which words p apart are identical, that no neighbour extends, with p as its
smallest period and a length of at least max(least_words, least_periods * p).

The harmonic grid: for each period p, positions jp and (j+1)p are compared. The longest common extension (LCE) forward
comes from the suffix array of the words, the one backward from that of the reversed words; both are minima over ranges of
the array of common prefix lengths. A run holds more pairs of positions p apart than max(least_words, least_periods * p) -
p, so every j that is a multiple of a step with step * p <= that many words meets it, and pairs whose words differ have an
LCE of 0 and need no query. Forward and backward extension of a pair give its maximal stretch; of equal stretches the one
with the smallest period counts (longer periods of it are its multiples).

Words of many documents form one array with separators that occur once, so no extension crosses documents. Words count
as equal within their document only, which keeps copies of a document apart in the suffix array. Suffixes are sorted by
doubling; a boundary that a doubling finds gets its common prefix length from the shorter ones known before. Memory is a
few numbers for each word of some documents, or of the longest document.

Null text has no words; a null doc_id counts as the empty string where it is hashed. Rows are independent, repeated rows
get equal results, columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, small_batches

_WORD = re.compile(WORD)
#: Words of the documents that one suffix array holds (one document at least), and grid pairs looked at together.
HELD, PAIRS = 200_000, 1_000_000
_FAR = np.iinfo(np.int32).max


@dataclass(frozen=True)
class RunConfig:
    least_words: int = 24
    least_periods: int = 3

    def least(self, p):
        return np.maximum(self.least_words, self.least_periods * p)


class RangeMin:
    """Minimum of x[l..r] for arrays of l <= r: a sparse table over blocks, prefix and suffix minima within them."""

    BLOCK = 16

    def __init__(self, x: np.ndarray):
        n, b = len(x), self.BLOCK
        full = np.full(-(-n // b) * b, _FAR, x.dtype)
        full[:n] = x
        blocks = full.reshape(-1, b)
        self.x = full
        self.ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(blocks):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, z = left // self.BLOCK, right // self.BLOCK
        out = np.minimum(self.behind[left], self.ahead[right])
        same = np.flatnonzero(a == z)
        if len(same):
            i, end = left[same], right[same]
            least = self.x[i]
            for _ in range(1, self.BLOCK):
                i = np.minimum(i + 1, end)
                least = np.minimum(least, self.x[i])
            out[same] = least
        wide = np.flatnonzero(z - a > 1)
        if len(wide):
            a, z = a[wide] + 1, z[wide] - 1
            level = np.frexp((z - a + 1).astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                t = self.table[k]
                out[wide[at]] = np.minimum(out[wide[at]], np.minimum(t[a[at]], t[z[at] + 1 - (1 << k)]))
        return out


class Extensions:
    """Longest common extensions forward in an array of symbols whose last one occurs once."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        ranked, places = symbols[order], np.arange(n)
        first = np.ones(n + 1, bool)  # places where a group of equal beginnings begins
        first[1:n] = ranked[1:] != ranked[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(first[:n], places, 0))
        common = np.where(first[:n], 0, _FAR).astype(np.int32)
        k, at = 1, places
        while len(at := at[~(first[at] & first[at + 1])]):  # places of groups of several
            key = rank[order[at]] * (n + 1) + rank[order[at] + k]
            by = np.argsort(key)
            order[at], key = order[at][by], key[by]
            suffix = order[at]
            found = np.flatnonzero((key[1:] != key[:-1]) & ~first[at[1:]]) + 1
            if len(found):
                least = RangeMin(common)
                common[at[found]] = k + least(rank[suffix[found - 1] + k] + 1, rank[suffix[found] + k])
                first[at[found]] = True
                rank[suffix] = np.maximum.accumulate(np.where(first[at], at, 0))
            k *= 2
        self.rank, self.least = rank, RangeMin(common)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, z = self.rank[i], self.rank[j]
        return self.least(np.minimum(a, z) + 1, np.maximum(a, z))


def symbols_of(documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all documents as dense numbers with a separator before, between and after them; where each begins."""
    total = sum(map(len, documents)) + len(documents) + 1
    out, begins, at, used = np.empty(total, np.int64), np.empty(len(documents), np.int64), 0, 0
    for d, words in enumerate(documents):
        out[at] = used
        used, at = used + 1, at + 1
        begins[d] = at
        known: dict[str, int] = {}
        out[at : at + len(words)] = [known.setdefault(w, len(known)) for w in words]
        out[at : at + len(words)] += used
        used, at = used + len(known), at + len(words)
    out[at] = used
    return out, begins


def _grid(lengths: np.ndarray, begins: np.ndarray, cfg: RunConfig):
    """(i, p) of the grid pairs i, i + p of all documents, some at a time."""
    most = np.where(lengths >= cfg.least_words, lengths // cfg.least_periods, 0)
    offsets = np.cumsum(most) - most
    total = int(most.sum())
    for at in range(0, total, PAIRS // 8):
        flat = np.arange(at, min(total, at + PAIRS // 8))
        doc = np.searchsorted(offsets + most, flat, side="right")
        p = flat - offsets[doc] + 1
        step = p * ((cfg.least(p) - p) // p)
        count = -(-(lengths[doc] - p) // step)
        sums = np.cumsum(count)
        cuts = np.unique(np.append(np.searchsorted(sums, np.arange(0, sums[-1], PAIRS), side="right"), len(flat)))
        for a, z in zip(cuts, cuts[1:]):
            c = count[a:z]
            j = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            yield np.repeat(begins[doc[a:z]], c) + j * np.repeat(step[a:z], c), np.repeat(p[a:z], c)


def find_runs(documents: list[list[str]], cfg: RunConfig = RunConfig()) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, by start and period."""
    symbols, begins = symbols_of(documents)
    lengths = np.array([len(w) for w in documents], np.int64)
    pairs = []
    for i, p in _grid(lengths, begins, cfg):
        equal = symbols[i] == symbols[i + p]
        pairs.append((i[equal], p[equal]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    i, p = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 2
    if not len(i):
        return out
    ahead = Extensions(symbols)(i, i + p)
    last = len(symbols) - 1
    back = Extensions(symbols[::-1])(last - (i - 1), last - (i + p - 1))
    start, length = i - back, back + p + ahead
    real = length >= cfg.least(p)
    start, length, p = start[real], length[real], p[real]
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    one = np.ones(len(start), bool)
    one[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    doc = np.searchsorted(begins, start[one], side="right") - 1
    for d, s, n, q in zip(doc.tolist(), (start[one] - begins[doc]).tolist(), length[one].tolist(), p[one].tolist()):
        out[d].append((s, n, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period (ties: smallest start, then period)."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    drop = np.cumsum(edge[:-1]) > 0
    return [w for w, gone in zip(words, drop.tolist()) if not gone]


def planted(key: str | None, words: list[str]) -> list[str]:
    """A tenth of the documents, by a hash of the key, continue from some word on with what they begin there."""
    h = zlib.crc32((key or "").encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    part = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (part * (-(-(n - a) // len(part))))[: n - a]


def periodic_runs(docs: DataFrame, cfg: RunConfig = RunConfig(), change: Callable[[str | None, list[str]], list[str]] | None = None) -> DataFrame:
    """doc_id, n_runs, start, length, period of the strongest run (null without runs), runs, and text with every run
    collapsed to its first period (words joined by one space). change: applied to key and words first."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, held, n = [], [], 0
            keys, texts = b.column(1).to_pylist(), b.column(2).to_pylist()

            def flush(rows=rows, held=held):
                for words, runs in zip(held, find_runs(held, cfg)):
                    rows.append((len(runs), *(strongest(runs) or (None,) * 3), [dict(zip(("start", "length", "period"), r)) for r in runs], " ".join(collapsed(words, runs))))
                held.clear()

            for key, text in zip(keys, texts):
                words = _WORD.findall(text) if text else []
                held.append(change(key, words) if change else words)
                n += len(words)
                if n >= HELD:
                    flush()
                    n = 0
            if held:
                flush()
            long = pa.int64()
            kinds = (long, long, long, long, pa.list_(pa.struct([(c, long) for c in ("start", "length", "period")])), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]], ["doc_id", "n_runs", "start", "length", "period", "runs", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("_k"), "text").mapInArrow(run, f"doc_id {kind}, n_runs long, start long, length long, period long, runs array<struct<start: long, length: long, period: long>>, text string")
