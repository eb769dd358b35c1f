import corpus_pipeline
from shipcast.llm import common, packing, quality_classifier, quality_rules

from . import helpers
from .test_packing import _check
from .test_simhash import _groups

SF = "/root/testdata/sf0.001"


def test_each_stage_against_its_own_input(spark):
    docs = common.documents(spark, SF)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "simhash_near_dedup", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    one = common.stored(stages["quality_rules"](spark, docs, SF), "one")
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).collect() if r.kept}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept

    two = common.stored(stages["quality_classifier"](spark, one, SF), "two")
    model = quality_classifier.fit(docs, common.documents(spark, SF, "labels"))
    good = {r.doc_id for r in quality_classifier.quality_scores(one, model).collect() if r.score >= 0.3}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == good

    three = common.stored(stages["simhash_near_dedup"](spark, two, SF), "three")
    rows = [(r.doc_id, r.text) for r in two.collect()]
    assert three.columns == docs.columns
    assert sorted(r.doc_id for r in three.collect()) == sorted({c for _, _, c in _groups(rows)})

    four = stages["packing"](spark, three, SF).collect()
    left = [(r.doc_id, r.text) for r in three.collect()]
    assert {r.doc_id for r in four} == {d for d, _ in left}
    n = _check(four, left)
    assert n <= packing.CAPACITY and n >= -(-sum(r.length for r in four) // packing.CAPACITY)


def test_stages_take_awkward_and_empty_tables(spark):
    for docs in (helpers.awkward(spark), helpers.empty(spark)):
        columns = docs.dtypes
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.stored(stage(spark, docs, SF), "t")
            assert docs.dtypes == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0
        for _, stage in corpus_pipeline.STAGES[:-1]:  # each stage on the raw rows, too
            assert stage(spark, helpers.awkward(spark), SF).count() <= len(helpers.AWKWARD)


def test_run_is_the_chain_of_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"] and rows.count() > 0
