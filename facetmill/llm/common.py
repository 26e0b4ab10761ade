"""Helpers that the text operators share."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, and the pattern of a word.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new temporary folder where it is unset and all is one machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="facetmill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Where the innermost `scope` collects the folders written inside it; threads and contexts have their own.
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs nothing of it.

    by: a column of few values; rows of each are written to a folder of their own, so that a filter on it reads no others.
    """
    path = new_folder(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    folders = _SCOPE.get()
    if folders is not None:
        folders.append(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._saved_at = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `saved` that no plan reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._saved_at)


def discard_part(df: DataFrame, part: str) -> None:
    """Delete one folder (column=value) of a table that `saved` has written by this column."""
    _delete(df.sparkSession, f"{df._saved_at}/{part}")


@contextlib.contextmanager
def scope(before: list[str], docs: DataFrame):
    """Collects in `before` the folders that are written inside.

    What it held from an earlier run goes, but for folders that docs still reads: its result has been written by now.
    """
    spark, old = docs.sparkSession, list(before)
    before.clear()
    if old:
        read = docs.inputFiles()
        for path in old:
            if any(f"{os.path.basename(path)}/" in f for f in read):
                before.append(path)
            else:
                _delete(spark, path)
    outer = _SCOPE.set(before)
    try:
        yield
    finally:
        _SCOPE.reset(outer)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4_000_000) -> None:
    """Texts can be long: hand fewer rows and bytes at a time to Python workers than Spark's defaults."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key) or "").lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for each row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null and for white space only."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
