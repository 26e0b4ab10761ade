"""Token counts of whole texts by the whole-token shortcut (see bpe).

Null text counts as empty: 0 bytes, 0 tokens. Rows are independent, so repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import small_batches


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    path = path or bpe.default_path()
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        count = bpe.load(path).count
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [count(t) if t else 0 for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
