"""The pipeline's stages against what they may and must do; run() against its stages."""

import collections
import zlib

import numpy as np

import corpus_pipeline
from facetmill.llm import bpe


def test_pipeline_end_to_end(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "source_mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count()
    packed = [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()]
    b = bpe.load(bpe.default_path())
    want = collections.Counter()
    for r in docs.collect():
        ids = np.append(np.frombuffer(b.ids(r["text"]), "<u4"), np.uint32(0)).astype("<u4")
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want.update((r["doc_id"], k, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(cut, cut[1:])))
    assert collections.Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed) == want


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, empty, labels, tmp_path):
    for name, docs in (("awkward", awkward), ("empty", empty)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.filter("doc_id is not null" if name == "awkward" else "false").write.parquet(str(tmp_path / name / "labels.parquet"))
    first = corpus_pipeline.run(spark, str(tmp_path / "awkward"))
    got, fill = first.collect(), collections.Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert got and all(n <= 2048 for n in fill.values())
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []
    assert first.count() == len(got)  # a later run leaves earlier results alone


def test_rejected_documents_are_those_of_the_report(spark, awkward, labels):
    from facetmill.llm import quality

    kept = collections.Counter(r["doc_id"] for r in quality.quality_report(awkward, labels).collect() if r["kept"])
    assert collections.Counter(r["doc_id"] for r in quality.quality_filter(awkward, labels).collect()) == kept
