"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, saved


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(a, b) links -> (node, root), root the smallest node of the component; nodes without links are left out.

    Alternates large-star and small-star steps: every node hands its neighbours to the smallest of them, until all links
    lead to a root. Each round is written to the shared folder.
    """
    spark = links.sparkSession
    e = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = None
    for _ in range(most):
        sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.filter("b > a").join(least, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct()
        before, e = e, saved(small, "links")
        discard(before)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
        if last == (now["n"], now["h"]):
            break
        last = (now["n"], now["h"])
    else:
        raise RuntimeError("components have not converged")
    release(spark)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
