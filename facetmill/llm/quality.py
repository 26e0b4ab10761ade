"""Quality rules whose cutoffs are chosen under a bound on false rejections.

A rule rejects a document when its signal is above a cutoff. Severity levels give all rules their cutoffs at once and are
nested: a higher level rejects what a lower one rejects and more. For each stratum the labelled good texts that pass the
base rule are the holdout, equal texts counted once: with k of n of them rejected at a level, the null hypothesis "more
than alpha of the good texts of this stratum that pass the base rule are rejected" is tested with the exact binomial tail
P(Bin(n, alpha) <= k). Levels are tested from the most lenient on and the walk stops before the first that is not
significant (a fixed sequence needs no further correction); strata are corrected for by Bonferroni. So with probability
1 - delta, in no stratum do the cutoffs reject more than alpha of the good texts that pass the base rule; what the base
rule rejects comes on top, as a rule that is given and not chosen. One rule's signal is the share of words that begin like
toxic words, which are learned from a part of the labels, bounded in expectation, that is left out of the holdout.

Null and empty texts have no words, zero counts and fail the base rule; a null stratum is a stratum of its own. Without
labels, or with too few of them, no cutoff is significant and only the base rule rejects. Repeated rows get equal results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon
from .common import let, saved, words_of

@dataclass(frozen=True)
class QualityConfig:
    stratum: str = "lang"
    alpha: float = 0.02
    delta: float = 0.05
    #: Signals, and their cutoffs at each level of severity, the most lenient first. Levels are nested.
    rules: tuple[str, ...] = ("symbol_ratio", "bang_ratio", "upper_ratio", "dup_line_ratio", "repeat_ratio", "stem_ratio")
    levels: tuple[tuple[float, ...], ...] = (
        (2.0, 1.5, 0.70, 0.95, 0.20, 0.500),
        (1.0, 1.0, 0.60, 0.90, 0.20, 0.200),
        (0.5, 0.5, 0.50, 0.85, 0.20, 0.100),
        (0.3, 0.3, 0.40, 0.80, 0.20, 0.050),
        (0.2, 0.2, 0.35, 0.75, 0.20, 0.030),
        (0.1, 0.1, 0.30, 0.70, 0.20, 0.020),
        (0.1, 0.1, 0.30, 0.70, 0.20, 0.015),
        (0.1, 0.1, 0.30, 0.65, 0.20, 0.010),
        (0.1, 0.1, 0.30, 0.65, 0.20, 0.007),
        (0.1, 0.1, 0.30, 0.60, 0.20, 0.005),
        (0.1, 0.1, 0.30, 0.60, 0.19, 0.003),
        (0.1, 0.1, 0.30, 0.60, 0.18, 0.002),
        (0.1, 0.1, 0.30, 0.60, 0.18, 0.001),
        (0.1, 0.1, 0.30, 0.60, 0.18, 0.000),
    )
    #: Labelled documents (in expectation, and at most 30 % of them) from which beginnings of toxic words are learned; they are no holdout.
    lexicon_rows: int = 4_000
    #: Up to so many strata the thresholds are broadcast; beyond, they are joined by shuffle.
    broadcast_strata: int = 10_000


def _repeat_words(words: Column, n: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text."""
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        def found(s: Column) -> Column:
            def again(e: Column, i: Column) -> Column:
                same = lambda j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
                return same(i - 1) | same(i + 1)

            at = F.sort_array(F.transform(F.filter(s, again), lambda e: e["at"]))
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end"))
            return F.aggregate(at, zero, lambda a, p: F.struct((a["n"] + (p + 5 - F.greatest(p, a["end"]))).cast("long").alias("n"), (p + 5).cast("int").alias("end")))["n"]

        return let(F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("at")))), found)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def signals(text: Column, stems: tuple[str, ...] = ()) -> Column:
    """A struct of the base counts and the signals of a whole text. stems: beginnings of toxic words."""
    whole = F.coalesce(text, F.lit(""))
    begins = rf"(?iu)(?<![\p{{L}}\p{{N}}])({'|'.join(stems)})"

    def of_words(w: Column) -> Column:
        n = F.size(w)
        return F.struct(n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w, n).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")

    def out(a: Column) -> Column:
        return let(let(lines, of_lines), lambda b: F.struct(
            a["n_words"].alias("n_words"), a["word_chars"].alias("word_chars"),
            F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            b["n_dup_lines"].alias("n_dup_lines"), a["n_repeat_words"].alias("n_repeat_words"), b["n_lines"].alias("n_lines"),
            F.regexp_count(whole, F.lit("!")).cast("long").alias("n_bangs"), F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            (F.regexp_count(whole, F.lit(begins)).cast("long") if stems else F.lit(0).cast("long")).alias("n_stems"),
        ))

    return let(let(words_of(text), of_words), out)


def with_signals(docs: DataFrame, stems: tuple[str, ...] = (), into: str = "_q") -> DataFrame:
    """docs with a struct column of counts, ratios, base_failed."""
    s = docs.withColumn(into, signals(F.col("text"), stems))
    q = lambda k: F.col(into)[k]
    ratio = lambda a, b: F.when(q(b) > 0, q(a) / q(b)).otherwise(F.lit(0.0))
    ratios = {"symbol_ratio": ("n_symbols", "n_words"), "bang_ratio": ("n_bangs", "n_words"), "upper_ratio": ("n_upper", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "stem_ratio": ("n_stems", "n_words")}
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = (q("n_words") < 10) | (100 * q("n_repeat_words") > 20 * q("n_words"))
    return s.withColumn(into, F.struct(*[q(c).alias(c) for c in counts], *[ratio(a, b).alias(k) for k, (a, b) in ratios.items()], failed.alias("base_failed")))


def _ln_factorial(n: Column) -> Column:
    """ln n! by the table of small factorials and Stirling's series (error below 1e-12)."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.ln(x) - x + F.ln(2 * F.lit(math.pi) * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for 0 <= k <= n.

    Terms are summed from the one at the cutoff away from the mean (above the mean: those beyond k, taken from 1). They
    fall at least as fast as a bell curve of the same deviation, so some 12 deviations hold all of them that count in
    double precision, and no array grows with n itself.
    """
    n, k = n.cast("long"), F.least(k.cast("long"), n.cast("long"))
    below = k <= n * p
    first = F.when(below, k).otherwise(k + 1)
    log = _ln_factorial(n) - _ln_factorial(first) - _ln_factorial(n - first) + first * math.log(p) + (n - first) * math.log1p(-p)
    reach = (40 + 12 * F.sqrt(n * p * (1 - p))).cast("long")
    many = F.when(below, F.least(first, reach)).otherwise(F.least(n - first, reach))
    odds = p / (1 - p)

    def add(a: Column, j: Column) -> Column:
        ratio = F.when(below, (first - j + 1) / ((n - first + j) * odds)).otherwise((n - first - j + 1) * odds / (first + j))
        t = a["t"] * ratio
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    steps = F.when(many >= 1, F.sequence(F.lit(1).cast("long"), many)).otherwise(F.array().cast("array<bigint>"))
    tail = F.exp(log + F.ln(F.aggregate(steps, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), add)["s"]))
    return F.when(below, F.least(F.lit(1.0), tail)).when(k >= n, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - tail))


def learned(docs: DataFrame, labels: DataFrame, cfg: QualityConfig) -> tuple[tuple[str, ...], DataFrame]:
    """Beginnings of toxic words, and the labels that were not used to find them."""
    share = lexicon.sample_share(labels, cfg.lexicon_rows)
    return tuple(lexicon.learn_stems(docs.select("doc_id", "text"), labels, share)), labels.filter(~F.coalesce(lexicon.in_sample(F.col("doc_id"), share), F.lit(False)))


def thresholds(measured: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """A row for each stratum with one cutoff for each rule (null: no level is significant there).

    measured: doc_id, _text (a hash of the text), _stratum and the signals in _q. labels: doc_id, quality, toxic; good is
    quality 1 and not toxic. A document with several labels is good only if all of them say so. Equal texts of a stratum are
    one trial of the holdout.
    """
    good = labels.groupBy("doc_id").agg(F.min((F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good")).filter("good").select("doc_id")
    held = measured.filter(~F.col("_q.base_failed")).join(good, "doc_id", "left_semi").dropDuplicates(["_stratum", "_text"])
    rejected = [F.sum(_above(cfg, [F.lit(float(c)) for c in level]).cast("long")) for level in cfg.levels]
    counts = saved(held.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n"), F.array(*rejected).alias("k")), "quality-counts")
    strata = max(1, counts.count())
    passed = F.transform("k", lambda k: binomial_tail(k, F.col("n"), cfg.alpha) <= cfg.delta / strata)
    stop = F.coalesce(F.array_position(passed, F.lit(False)), F.lit(0))
    level = F.when(stop == 0, F.lit(len(cfg.levels))).otherwise(stop - 1).cast("int")
    cuts = [F.get(F.array(*[F.lit(float(row[i])) for row in cfg.levels]), F.col("level") - 1).alias(rule) for i, rule in enumerate(cfg.rules)]
    return saved(counts.withColumn("level", level).select("_stratum", F.struct(*cuts).alias("_cut")), "quality-cuts")


def _above(cfg: QualityConfig, cuts: list[Column]) -> Column:
    """Whether any signal is above its cutoff (null: none)."""
    above = F.lit(False)
    for rule, cut in zip(cfg.rules, cuts):
        above = above | F.coalesce(F.col(f"_q.{rule}") > cut, F.lit(False))
    return above


def verdicts(measured: DataFrame, holdout: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """measured (doc_id, _text, _stratum, _q and others) with _cut and kept; the cutoffs come from it and the holdout labels."""
    cuts = thresholds(measured.select("doc_id", "_text", "_stratum", "_q"), holdout, cfg)
    if cuts.count() <= cfg.broadcast_strata:
        cuts = F.broadcast(cuts)
    cuts = cuts.withColumnRenamed("_stratum", "_s")
    out = measured.join(cuts, F.col("_stratum").eqNullSafe(F.col("_s")), "left").drop("_s")
    return out.withColumn("kept", ~F.col("_q.base_failed") & ~_above(cfg, [F.col(f"_cut.{rule}") for rule in cfg.rules]))


def _measured(docs: DataFrame, labels: DataFrame, cfg: QualityConfig, *more: Column) -> tuple[DataFrame, DataFrame]:
    """doc_id, _text, _stratum, _q and `more` of every document, written once, and the holdout labels. Each text is measured once."""
    stems, holdout = learned(docs, labels, cfg)
    stratum = F.col(cfg.stratum) if cfg.stratum in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", F.xxhash64("text", F.octet_length("text")).alias("_text"), stratum.alias("_stratum"), *more)
    return saved(with_signals(rows, stems).drop("text"), "quality-signals"), holdout


def quality_report(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the signals."""
    v = verdicts(*_measured(docs, labels, cfg), cfg)
    return v.select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], "kept", *[F.col(f"_q.{r}").alias(r) for r in cfg.rules])


def quality_filter(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """docs without those that the rules reject; its columns stay as they are, whatever their names.

    Rows are written with their signals and read again for the verdict: neither measured twice nor shuffled.
    """
    kept = verdicts(*_measured(docs, labels, cfg, F.struct("*").alias("_doc")), cfg).filter("kept")
    return kept.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
