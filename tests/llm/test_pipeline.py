"""The stages of the pipeline on edge rows, and each stage's decision on the smallest tables."""

import corpus_pipeline as pipeline
from vigil.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_on_edge_rows_and_none(spark, edge, empty):
    for name, stage in pipeline.STAGES[:-1]:
        for docs in (edge, empty):
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
            assert out.count() <= 3 * docs.count()
    assert pipeline.STAGES[-1][1](spark, edge, SF).count() >= edge.count()
    assert pipeline.STAGES[-1][1](spark, empty, SF).count() == 0


def test_each_stage_takes_effect(spark):
    docs = pipeline.documents(spark, SF)
    stages = dict(pipeline.STAGES)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = written(stages["quality_rules"](spark, docs, SF), "test")
    kept = {r.doc_id for r in docs.collect()}
    assert not [i for i in kept if labels.get(i) == 0]
    groups = pipeline.simhash.simhash_groups(docs).collect()
    docs = written(stages["near_duplicates"](spark, docs, SF), "test")
    assert {r.doc_id for r in docs.collect()} == {r.component_id for r in groups}
    before = {r.doc_id: r.text for r in docs.collect()}
    docs = written(stages["repeated_passages"](spark, docs, SF), "test")
    after = {r.doc_id: r for r in docs.collect()}
    assert set(after) == set(before) and any(after[i].text != before[i] for i in before)
    assert all(r.n_chars == len(r.text) <= len(before[i]) for i, r in after.items())
    plan = {r.doc_id: r.copies for r in pipeline.mixing.mix(docs).collect()}
    docs = written(stages["source_mix"](spark, docs, SF), "test")
    taken = {}
    for r in docs.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert taken == {i: c for i, c in plan.items() if c}
    pieces = stages["packing"](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(taken)


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0
