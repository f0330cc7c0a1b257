"""The pipeline's stages, each on what the one before it kept."""

import os

import pytest

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from causeway.llm import common, pii

    docs = common.read(spark, DIR, "documents")
    columns, kept = docs.columns, [docs.count()]
    assert len(pipeline.STAGES) == 5
    for name, stage in pipeline.STAGES:
        docs, _ = common.materialize(stage(spark, docs, DIR), "test")
        kept.append(docs.count())
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
        if name == "PII":
            assert pii.find(docs).where("exists(spans, s -> s.base)").count() == 0
    assert kept[1] < kept[0] and kept[2] < kept[1] and kept[3] == kept[2] and kept[5] == kept[4]
    assert docs.where("not round_trip").count() == 0
    assert pipeline.run(spark, DIR).count() == kept[-1]
