"""The pipeline against its stages' own rules, and the registry."""

import re

import corpus_pipeline
from corpuslens.llm import decontamination, minhash_dedup, packing, quality_rules, registry, toxicity


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_pipeline_equals_its_stages_verdicts(spark):
    sf = "/root/testdata/sf0.001"
    docs = registry.read(spark, sf, "documents")
    labels, bench = registry.read(spark, sf, "labels"), registry.read(spark, sf, "benchmark")
    ids = {r.doc_id for r in docs.collect()}
    keep = docs
    verdicts = [
        lambda d: {r.doc_id for r in toxicity.score_toxicity(d, labels).filter("predicted = 0").collect()},
        lambda d: {r.doc_id for r in quality_rules.score_quality(d, labels).filter("kept").collect()},
        lambda d: {r.doc_id for r in minhash_dedup.near_duplicates(d).filter("kept").collect()},
        lambda d: {r.doc_id for r in decontamination.decontaminate(d, bench).filter("NOT contaminated").collect()},
    ]
    for (_, stage), verdict in zip(corpus_pipeline.STAGES, verdicts, strict=False):
        expect = verdict(keep)
        out = stage(spark, keep, sf)
        assert out.columns == docs.columns
        keep = spark.createDataFrame(out.collect(), docs.schema)
        assert {r.doc_id for r in keep.collect()} == expect <= ids
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert got == sorted(map(tuple, packing.pack(keep).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
