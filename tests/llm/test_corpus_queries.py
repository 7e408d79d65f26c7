import pytest
from oracle import assert_same, connection
from pyspark.sql import functions as F

import corpus_pipeline
from sparrowplan.llm import registry
from sparrowplan.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), connection(SF), registry.SQL[name])


def test_held_out_languages(spark):
    got = registry.QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count() > 0


def test_language_model_beats_its_base(spark):
    r = registry.QUERIES["op7_lm_scoring"](spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count() > 0
