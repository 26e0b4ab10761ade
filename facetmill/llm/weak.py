"""Quality classifier from weak labels: heuristic labellers, expectation-maximisation, and a hashed linear scorer.

Every labeller votes bad, good or abstains on a whole text; several of them look at the same kind of fault in different
ways.
ways. One pass over the texts writes each document's votes, as a pattern, and its hashed features (presence of words, and
levels of measures); no text is read after it. Votes are counted by pattern (at most 3 ** labellers of them, whatever the
input), and expectation-maximisation estimates from the counts how often each labeller votes what on good and on bad texts
and the posterior of each pattern. The posteriors are the soft labels on which a logistic scorer over the features is
fitted: on a sample chosen by a hash of doc_id, of `sample` documents and `sample_places` features in expectation at most.
It scores every document from the written features. A labelled table only teaches one measure the beginnings of toxic
words, from a bounded sample (see lexicon).

Null and empty texts abstain everywhere, keep the class prior as posterior and are scored like others. Repeated rows get
equal results. No labels: that measure is 0 everywhere.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexicon
from .common import saved, small_batches

_WORD = re.compile(r"[^\W_]+")
_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
BAD, GOOD, NONE = 0, 1, 2
#: Measure -> (lower bounds of levels). A measure's level is a feature; labellers cut at two of its values.
LEVELS = {"symbols": (0.02, 0.1, 0.3, 1.0), "bangs": (0.02, 0.1, 0.3, 1.0), "upper": (0.1, 0.2, 0.3, 0.5), "marked": (0.05, 0.2, 0.5), "length": (3.5, 4.0, 4.5, 5.7, 6.2, 7.0), "again": (0.02, 0.1, 0.2, 0.4), "words": (0.1, 0.3, 0.45, 0.6), "pairs": (0.3, 0.5, 0.8), "lines": (0.1, 0.3, 0.6), "stems": (0.001, 0.003, 0.006, 0.01, 0.02, 0.04), "stem_hits": (1.0, 2.0, 3.0, 5.0)}
#: Labeller -> (measure, votes bad from, votes good below); negative: bad below, good from.
LABELLERS = {"symbols": (0.2, 0.05), "bangs": (0.2, 0.05), "upper": (0.3, 0.15), "marked": (0.2, 0.05), "again": (0.15, 0.05), "words": (-0.25, -0.35), "pairs": (-0.45, -0.7), "lines": (0.5, 0.3), "stems": (0.01, 0.003), "stem_hits": (2.0, 0.5)}


@dataclass(frozen=True)
class WeakConfig:
    bits: int = 18
    #: Expected number of documents on which the scorer is fitted, and of features that they have together.
    sample: int = 12_000
    sample_places: int = 8_000_000
    #: Labelled documents from which the stem labeller learns (at most 30 % of them).
    lexicon_rows: int = 6_000
    #: A word that fewer sampled documents have gets no weight.
    least: int = 12
    rounds: int = 200
    em_rounds: int = 200
    decay: float = 1e-4
    cut: float = 0.5


def by_length(stems: list[str]) -> dict[int, frozenset[str]]:
    return {n: frozenset(s for s in stems if len(s) == n) for n in {len(s) for s in stems}}


def measures(text: str, stems: dict[int, frozenset[str]]) -> tuple[dict[str, float], list[str]]:
    """Measures of a text and its lower-case words without marks. stems: beginnings of toxic words by length."""
    raw = text.split()
    low = _WORD.findall(text.lower())
    n = max(1, len(raw))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    toxic = sum(sum(map(known.__contains__, map(operator.itemgetter(slice(k)), low))) for k, known in stems.items())
    return {
        "symbols": sum(map(text.count, "#*$%&|<>")) / n,
        "bangs": text.count("!") / n,
        "upper": len(_UPPER.findall(text)) / max(1, len(text) - text.count(" ")),
        "marked": sum(1 for w in raw if w[-1] in "#*$%&|<>!") / n,
        "length": sum(map(len, raw)) / n,
        "again": sum(map(operator.eq, raw, raw[1:])) / n,
        "words": len(set(low)) / max(1, len(low)) ** 0.85,
        "pairs": len(set(zip(low, low[1:]))) / max(1, len(low) - 1),
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "stems": toxic / n,
        "stem_hits": float(toxic),
    }, low


def votes(m: dict[str, float], n: int) -> list[int]:
    if not n:
        return [NONE] * len(LABELLERS)
    out = []
    for name, (bad, good) in LABELLERS.items():
        v = m[name]
        if n < 8 and name in ("again", "words", "pairs", "upper"):
            out.append(NONE)
        elif bad < 0 or good < 0:
            out.append(BAD if v < -bad else GOOD if v >= -good else NONE)
        else:
            out.append(BAD if v >= bad else GOOD if v < good else NONE)
    return out


def pattern(v: list[int]) -> int:
    return sum(x * 3**i for i, x in enumerate(v))


class Features(dict):
    """word -> its place in the weights; remembers up to `limit` words."""

    def __init__(self, bits: int, limit: int = 150_000):
        super().__init__()
        self.size, self.limit = 1 << bits, limit

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        at = self[word] = xxhash.xxh64_intdigest(word) % self.size
        return at

    def of(self, m: dict[str, float], low: list[str]) -> set[int]:
        levels = [f"\0{name}\0{sum(m[name] >= b for b in bounds)}" for name, bounds in LEVELS.items()]
        return set(map(self.__getitem__, set(low))) | set(map(self.__getitem__, levels))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns -> (posterior of bad for each, P(vote | class) [labeller, class, vote], P(bad)).

    Starts from "any bad vote is right"; pseudo-counts keep every rate inside (0, 1) and say that a labeller's bad votes
    are rare on good texts.
    """
    m = len(LABELLERS)
    v = patterns[:, None] // 3 ** np.arange(m)[None, :] % 3
    hot = (v[:, :, None] == np.arange(3)).astype(float)
    bad = np.where((v == BAD).any(axis=1), 0.95, 0.02)
    prior = np.array([[2.0, 2.0, 1.0], [0.2, 20.0, 1.0]])
    rates, share = np.zeros((m, 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack((counts * bad, counts * (1 - bad)))
        total = np.einsum("cp,pmv->mcv", weight, hot) + prior[None]
        rates = total / total.sum(axis=2, keepdims=True)
        share = float((weight[0].sum() + 1) / (counts.sum() + 2))
        log = np.einsum("pmv,mcv->pc", hot, np.log(rates)) + np.log([share, 1 - share])
        new = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -500, 500)))
        if np.abs(new - bad).max(initial=0) < 1e-9:
            break
        bad = new
    return bad, rates, share


def fit(rows: list[np.ndarray], good: np.ndarray, cfg: WeakConfig) -> np.ndarray:
    """Weights of the logistic scorer (the last one is the constant) by full-batch Adam on soft labels."""
    size = 1 << cfg.bits
    w = np.zeros(size + 1)
    if not rows:
        return w.astype(np.float32)
    idx, n = np.concatenate(rows).astype(np.int64), np.array([len(r) for r in rows])
    seen = np.bincount(idx, minlength=size)
    at = np.repeat(np.arange(len(rows)), n)
    use = seen[idx] >= min(cfg.least, len(rows))
    idx, at = idx[use], at[use]
    m, s = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, cfg.rounds + 1):
        z = np.bincount(at, weights=w[idx], minlength=len(rows)) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - good) / len(rows)
        g = np.append(np.bincount(idx, weights=err[at], minlength=size), err.sum()) + cfg.decay * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return w.astype(np.float32)


def classify(docs: DataFrame, labels: DataFrame, cfg: WeakConfig = WeakConfig()) -> DataFrame:
    """doc_id, posterior (of good, from the votes), score (of good, from the scorer), kept (score >= cut)."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    stems = by_length(lexicon.learn_stems(texts, labels, lexicon.sample_share(labels, cfg.lexicon_rows)))

    bits = cfg.bits

    def read(batches):
        import pyarrow as pa

        places = Features(bits)
        for b in batches:
            found, rows = [], []
            for t in b.column(1).to_pylist():
                m, low = measures(t or "", stems)
                found.append(pattern(votes(m, len(low))))
                rows.append(np.fromiter(places.of(m, low), np.int32))
                rows[-1].sort()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int32()), pa.array([len(r) for r in rows], pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "pattern", "n", "places"])

    facts = saved(texts.mapInArrow(read, f"doc_id {kind}, pattern int, n int, places binary"), "weak-facts")
    seen = facts.groupBy("pattern").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).collect()  # at most 3 ** labellers rows
    patterns, counts = np.array([r["pattern"] for r in seen], np.int64), np.array([r["docs"] for r in seen], float)
    bad, _, _ = estimate(patterns, counts, cfg.em_rounds)
    posterior = dict(zip(patterns.tolist(), (1 - bad).tolist()))
    share = min(1.0, cfg.sample / max(1.0, counts.sum()), cfg.sample_places / max(1, sum(r["n"] for r in seen)))
    sample = facts.filter(F.pmod(F.xxhash64("doc_id", F.lit("weak")), F.lit(1_000_000)) < int(1_000_000 * share)).select("places", "pattern").collect()
    sample.sort()
    weights = spark.sparkContext.broadcast(fit([np.frombuffer(r["places"], np.int32) for r in sample], np.array([posterior[r["pattern"]] for r in sample]), cfg))
    cut = cfg.cut

    def score(batches):
        import pyarrow as pa

        w = weights.value
        for b in batches:
            good = [posterior[p] for p in b.column(1).to_pylist()]
            z = np.array([w[np.frombuffer(x, np.int32)].sum(dtype=np.float64) + w[-1] for x in b.column(2).to_pylist()])
            scores = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(good, pa.float64()), pa.array(scores, pa.float64()), pa.array(scores >= cut, pa.bool_())], ["doc_id", "posterior", "score", "kept"])

    return facts.select("doc_id", "pattern", "places").mapInArrow(score, f"doc_id {kind}, posterior double, score double, kept boolean")
