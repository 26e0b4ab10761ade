"""Word beginnings that mark toxic texts, learned with DataFrame functions from a bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, words_of

#: Hash places out of which a share of the labelled documents is drawn for learning.
PLACES = 1_000_000


def in_sample(doc_id: Column, share: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("lexicon")), F.lit(PLACES)) < share


def sample_share(labels: DataFrame, rows: int, most: float = 0.3) -> int:
    """Hash places (of PLACES) that hold `rows` labelled documents in expectation, and at most this share of them."""
    return int(PLACES * min(most, rows / max(1, labels.count())))


def learn_stems(docs: DataFrame, labels: DataFrame, share: int, shortest: int = 3, longest: int = 8, least: int = 10, ratio: float = 10.0, most: int = 100) -> list[str]:
    """Beginnings of words that at least `least` different toxic sampled texts have, `ratio` times as often as clean ones.

    Of beginnings that continue each other the shortest stays; at most `most` with the highest counts are returned.
    No labels, no toxic ones or too few: an empty list.
    """
    marks = labels.filter(in_sample(F.col("doc_id"), share)).groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min(F.coalesce("quality", F.lit(0))).alias("quality"))
    marks = saved(marks.filter("toxic = 1 or quality = 1"), "stem-labels")
    totals = marks.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not totals["t"] or totals["t"] == totals["n"]:
        return []
    # The sampled texts are written first: a filter on their words would else move below the join and split every text.
    texts = saved(docs.join(F.broadcast(marks), "doc_id").select("toxic", "text"), "stem-texts")
    low = F.array_distinct(F.transform(words_of(F.col("text")), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+", ""))))
    words = saved(texts.select("toxic", low.alias("w")), "stem-words").filter(F.size("w") > 0)
    # Copies count once: texts are told apart by the smallest hash of their words, which near copies mostly share.
    words = words.withColumn("text", F.array_min(F.transform("w", lambda w: F.xxhash64(w))))

    def starts(df: DataFrame) -> DataFrame:
        cut = F.explode("w")
        each = df.select("text", cut.alias("w")).select("text", F.explode(F.array(*[F.when(F.length("w") >= n, F.substring("w", 1, n)) for n in range(shortest, longest + 1)])).alias("stem"))
        return each.filter(F.col("stem").isNotNull() & F.col("stem").rlike(r"^[\p{L}\p{N}]+$")).distinct().groupBy("stem").agg(F.count(F.lit(1)).alias("n"))

    toxic = starts(words.filter("toxic = 1")).filter(F.col("n") >= least).withColumnRenamed("n", "t")
    toxic = saved(toxic, "stem-toxic")
    clean = starts(words.filter("toxic = 0")).withColumnRenamed("n", "c")
    odds = F.col("t") / totals["t"] * (totals["n"] - totals["t"]) / (F.coalesce("c", F.lit(0)) + 0.5)
    found = toxic.join(clean, "stem", "left").filter(odds >= ratio).select("stem", "t").collect()  # bounded by the sample
    stems: list[tuple[int, str]] = []
    for r in sorted(found, key=lambda r: (len(r["stem"]), r["stem"])):
        if not any(r["stem"].startswith(s) for _, s in stems):
            stems.append((r["t"], r["stem"]))
    return sorted(s for _, s in sorted(stems, key=lambda x: (-x[0], x[1]))[:most])
