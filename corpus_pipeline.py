"""From raw documents to packed training sequences: each stage reads what its predecessor kept.

Rows may have nulls in any column, repeated doc_ids and further columns of any name: what each stage does with them stands
in its operator's docstring. Null and empty texts fail the base rule, so no stage but the first meets any of the input's;
an empty table gives an empty result. Without labels only the base rule rejects.
"""

from __future__ import annotations

import contextvars
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from facetmill.llm import mixing, near, packing, quality, suffixes
from facetmill.llm.common import saved, scope, table


#: Folders that the stage before wrote for itself; they go when the next stage gets that stage's written result. Every call of
#: run() has a list of its own, and so has every thread that calls stages one by one.
_FOLDERS: contextvars.ContextVar[list[str]] = contextvars.ContextVar("folders")


def _folders() -> list[str]:
    if _FOLDERS.get(None) is None:
        _FOLDERS.set([])
    return _FOLDERS.get()


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a cutoff rejects go."""
    _folders().clear()  # a new chain: results of an earlier one may still be read
    with scope(_folders(), docs):
        return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    with scope(_folders(), docs):
        return near.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings go; so do documents of which nothing remains."""
    with scope(_folders(), docs):
        return suffixes.strip_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, in training order."""
    with scope(_folders(), docs):
        return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their place in packed sequences."""
    with scope(_folders(), docs):
        return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Not expressible in SQL (learned stems, hashes of Spark, tokenization): tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextvars.copy_context().run(_run, spark, sf_dir)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    _FOLDERS.set([])
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
