"""Reading, label preparation, splits, idempotent appends, manifests and text scans."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_or_none(spark: SparkSession, path: str, kind: str = "csv", **options) -> DataFrame | None:
    """A table, or None if there is none or it can't be read."""
    try:
        return spark.read.format(kind).options(**options).load(path)
    except AnalysisException:
        return None


def _lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """row_id, <name>: the lines of a text file with their numbers, from counts of lines by partition."""
    lines = spark.read.text(path).select(F.col("value").alias(name), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), F.struct("_metadata.file_path", "_metadata.file_block_start").alias("at"))
    counts = lines.groupBy("p").agg(F.min("at").alias("at"), F.min("i").alias("least"), F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    return lines.join(F.broadcast(counts.select("p", "least", first.alias("first"))), "p").select((F.col("first") + F.col("i") - F.col("least")).alias("row_id"), name)


def matrix_csv(spark: SparkSession, stem: str, columns: int | None = None) -> DataFrame:
    """<stem>_X.csv and <stem>_Y.csv without headers -> (row_id, x, label, y), rows matched by their line; classes of one row are left out.

    A line of another length, a value that is no number and files of different lengths are errors.
    """
    x, y = _lines(spark, f"{stem}_X.csv", "line"), _lines(spark, f"{stem}_Y.csv", "label")
    if columns is None:
        columns = len(spark.read.text(f"{stem}_X.csv").first()["value"].split(","))
    fail = lambda text: F.raise_error(F.lit(text))
    cells = F.transform(F.split("line", ","), lambda v: F.trim(v).cast("double"))
    both = x.join(y, "row_id", "full_outer")
    row = F.when(F.col("line").isNull() | F.col("label").isNull(), fail(f"{stem}: X and Y have different numbers of lines").cast("array<double>")).when(F.size(F.split("line", ",")) != columns, fail(f"{stem}: a line of X does not have {columns} values").cast("array<double>")).otherwise(cells)
    return prepared(both.select("row_id", row.alias("x"), F.trim("label").alias("label")))


def dataset(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a dataset and one row that describes them: counts of rows before and after, features, rows by label."""
    df = matrix_csv(spark, f"{folder.rstrip('/')}/{name}")
    before = spark.read.text(f"{folder.rstrip('/')}/{name}_Y.csv").groupBy(F.trim("value").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    old = before.agg(F.sum("n").alias("original_rows"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("original_labels"))
    new = df.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("d")).agg(F.sum("n").alias("rows"), F.max("d").alias("features"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("y", "n")))).alias("labels"))
    return df, old.crossJoin(new).withColumn("dataset", F.lit(name)).withColumn("removed_rows", F.col("original_rows") - F.col("rows"))  # one row each


def datasets(spark: SparkSession, folder: str, names: str | None = None) -> list[str]:
    """The datasets of a folder: names that have both files. names: a list with commas that picks some; an unknown one is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_[XY].csv").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("f"))
    pairs = files.select(F.expr("substring(f, 1, length(f) - 6)").alias("name")).groupBy("name").count().filter("count = 2")
    found = sorted(r["name"] for r in pairs.collect())  # a row for each dataset
    picked = [n.strip() for n in names.split(",") if n.strip()] if names else found
    if set(picked) - set(found):
        raise ValueError(f"no such dataset: {', '.join(sorted(set(picked) - set(found)))}")
    return picked


def prepared(df: DataFrame, label: str = "label", least: int = 2) -> DataFrame:
    """Drop classes with fewer than `least` rows and add y, the dense code of the label."""
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    codes = classes.select(label, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int").alias("y"))  # one row a class
    few = codes.limit(10_001).collect()  # at most this many rows
    if len(few) > 10_000:
        return df.join(codes, label)
    return df.join(F.broadcast(df.sparkSession.createDataFrame(few, codes.schema)), label)  # counted once, not again by every plan


def no_nan(df: DataFrame, column: str = "x") -> DataFrame:
    """Fail on missing values of a feature array."""
    bad = F.col(column).isNull() | F.exists(column, lambda v: v.isNull() | F.isnan(v))
    return df.withColumn(column, F.when(bad, F.raise_error(F.lit("features must not be null or NaN"))).otherwise(F.col(column)))


def stratified(df: DataFrame, seed: int, test_size: float = 0.25, key: str = "row_id", label: str = "y") -> DataFrame:
    """Adds is_test: in every class the first rows in order of a hash of seed and key.

    The hash deals a class to 4096 stretches; counts say in which of them the last test row lies, and only rows of one
    stretch are ranked together.
    """
    df = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))).withColumn("_b", F.substring("_h", 1, 3))
    counts = df.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    of, upto = Window.partitionBy(label), Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(label).alias("_l"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(of).alias("_size"))
    out = df.join(counts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c")))
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h")) + F.col("_before")
    return out.withColumn("is_test", rank <= F.round(test_size * F.col("_size"))).drop("_h", "_b", "_l", "_c", "_before", "_size")


def split_record(rows: DataFrame, name: str, run: int, seed: int, key: str = "row_id", per_row: int = 100_000) -> DataFrame:
    """dataset, run, seed, part, train, test (sorted ids) of rows with is_test. Ids are dealt by hash to as many parts as give
    about `per_row` ids each, so that no row of the record grows with the data; a table without rows has none."""
    parts = -(-rows.count() // per_row)
    part = F.pmod(F.xxhash64(key), F.lit(max(1, parts))).cast("int").alias("part")
    ids = lambda test: F.sort_array(F.collect_list(F.when(F.col("is_test") == test, F.col(key))))
    of = rows.groupBy(part).agg(ids(False).alias("train"), ids(True).alias("test"))
    return of.select(F.lit(name).alias("dataset"), F.lit(run).alias("run"), F.lit(seed).cast("long").alias("seed"), "part", "train", "test")


def save_splits(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("dataset string, run int, seed long, part int, train array<long>, test array<long>").json(path)


def apply_split(rows: DataFrame, records: DataFrame, name: str, run: int, key: str = "row_id") -> DataFrame:
    """rows with is_test as a record of one run says; rows that the record does not name go."""
    own = records.filter((F.col("dataset") == name) & (F.col("run") == run))
    of = lambda c, test: own.select(F.explode(c).alias("_k"), F.lit(test).alias("is_test"))
    return rows.join(of("train", False).unionByName(of("test", True)), F.col(key) == F.col("_k")).drop("_k")


def append_new(stored: DataFrame, batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Rows of batch whose keys (as strings) are not stored; of repeats within the batch the first by `order`."""
    text = [F.col(k).cast("string").alias(k) for k in keys]
    first = batch.withColumn("_r", F.row_number().over(Window.partitionBy(*[F.col(k).cast("string") for k in keys]).orderBy(order))).filter("_r = 1").drop("_r")
    known = stored.select(*text).distinct().select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = [F.col(k).cast("string").eqNullSafe(F.col(f"_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return first.join(known, cond, "left_anti")


def append_rows(batch: DataFrame, path: str, keys: list[str], order: Column | None = None) -> int:
    """Append to a table the rows of batch whose keys it does not have; returns how many. Of repeats the first stays, by `order` or as given."""
    stored = read_or_none(batch.sparkSession, path, "parquet")
    given = batch.withColumn("_o", F.monotonically_increasing_id())
    new = append_new(batch.limit(0) if stored is None else stored, given, keys, F.col("_o") if order is None else order).drop("_o").cache()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def existing_keys(spark: SparkSession, path: str, keys: list[str]) -> set[tuple[str, ...]]:
    """The keys (as strings) of a table of results; empty if there is none. One for each finished unit of work."""
    stored = read_or_none(spark, path, "parquet")
    return set() if stored is None else {tuple(r) for r in stored.select(*[F.col(k).cast("string") for k in keys]).distinct().collect()}


def log_failure(spark: SparkSession, path: str, section: str, where: str, message: str) -> None:
    """Append one row to the failure log."""
    row = spark.createDataFrame([(section, where, message)], "section string, where string, message string")
    row.select(F.current_timestamp().alias("timestamp"), "*").write.mode("append").parquet(path)


def create_freeze(spark: SparkSession, path: str, store: str) -> int:
    """Store the manifest of all files below a path; returns how many."""
    file_manifest(spark, path).write.mode("overwrite").parquet(store)
    return spark.read.parquet(store).count()


def verify_freeze(spark: SparkSession, path: str, store: str) -> DataFrame:
    """status, n of the files below a path against the stored manifest; raises if any is not unchanged."""
    diff = manifest_diff(spark.read.parquet(store), file_manifest(spark, path))
    counts = diff.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    bad = {r["status"]: r["n"] for r in counts.collect() if r["status"] != "UNCHANGED"}  # four rows at most
    if bad:
        raise ValueError("frozen files differ: " + ", ".join(f"{n} {s}" for s, n in sorted(bad.items())))
    return counts


def manifest_diff(before: DataFrame, after: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """key, status: ADDED, MISSING, UNCHANGED or CHANGED."""
    b, a = before.select(F.col(key), F.col(digest).alias("_b")), after.select(F.col(key), F.col(digest).alias("_a"))
    status = F.when(F.col("_b").isNull(), "ADDED").when(F.col("_a").isNull(), "MISSING").when(F.col("_a") == F.col("_b"), "UNCHANGED").otherwise("CHANGED")
    return b.join(a, key, "full_outer").select(key, status.alias("status"))


def file_manifest(spark: SparkSession, path: str, chunk: int = 8_000_000) -> DataFrame:
    """path, sha256, size of every file below a path. Spark lists the files; tasks stream each through the digest, so a file
    of any size takes `chunk` bytes of memory."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).inputFiles()  # names only, empty files too

    def run(batches):
        import hashlib
        import urllib.parse

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            digests, sizes = [], []
            for where in b.column(0).to_pylist():
                if where.startswith("file:"):
                    store, name = fs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlparse(where).path)
                else:
                    store, name = fs.FileSystem.from_uri(where)
                digest, size = hashlib.sha256(), 0
                with store.open_input_stream(name) as f:
                    while data := f.read(chunk):
                        digest.update(data)
                        size += len(data)
                digests.append(digest.hexdigest())
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], ["path", "sha256", "size"])

    dealt = spark.createDataFrame([(n,) for n in names], "path string").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(run, "path string, sha256 string, size long")


def scan_text(df: DataFrame, key: str, text: str, patterns: dict[str, str], snippet: int = 200, unless: dict[str, str] | None = None, history: dict[str, Column] | None = None) -> DataFrame:
    """A row for each line and pattern that matches: key, pattern, line (from 1), snippet.

    Provenance: a line that matches the pattern's entry of `unless` names the phrase without using it (as superseded, removed)
    and is no hit; nor is any line of a row for which the pattern's entry of `history` is true (a log of what was).
    """
    unless, history = unless or {}, history or {}
    past = {n: f"_past{i}" for i, n in enumerate(history)}
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "t"), *[F.coalesce(history[n], F.lit(False)).alias(c) for n, c in past.items()])

    def hit(name: str, pattern: str) -> Column:
        found = F.col("t").rlike(pattern)
        if name in unless:
            found &= ~F.col("t").rlike(unless[name])
        return found & ~F.col(past[name]) if name in past else found

    hits = F.filter(F.array(*[F.when(hit(n, p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())
    return lines.select(key, F.explode(hits).alias("pattern"), (F.col("i") + 1).cast("long").alias("line"), F.substring(F.trim("t"), 1, snippet).alias("snippet"))


def lineage(manifest: DataFrame, rules: list[tuple[str, dict[str, str]]], columns: tuple[str, ...], path: str = "path", root: str = "") -> DataFrame:
    """Adds artifact_group (the first folder below root; empty for files in root) and the given columns, which the first rule whose pattern is found in the path
    below root (a pattern) sets; a rule leaves what it does not name to later rules, and what none sets is "unknown"."""
    below = F.regexp_replace(path, "^" + root, "")
    group = F.when(F.instr(below, "/") > 0, F.substring_index(below, "/", 1)).otherwise("")

    def value(column: str) -> Column:
        found = [F.when(below.rlike(p), F.lit(says[column])) for p, says in rules if column in says]
        return F.coalesce(*found, F.lit("unknown")).alias(column)

    return manifest.select("*", group.alias("artifact_group"), *[value(c) for c in columns])


def write_record(path: str, record: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(record, f, indent=2, sort_keys=True, default=str)
