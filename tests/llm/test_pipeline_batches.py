"""Stages of the pipeline get texts in small batches."""

import corpus_pipeline

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stages_take_small_batches_and_a_smaller_setting_stays(spark):
    docs = spark.createDataFrame([(1, "a b@c.de")], "doc_id long, text string")
    before = spark.conf.get(NAME)
    try:
        for stage in (corpus_pipeline.redact, corpus_pipeline.dedup_near, corpus_pipeline.pack):
            spark.conf.set(NAME, "10000")
            stage(spark, docs, "")
            assert spark.conf.get(NAME) == "1000"
        spark.conf.set(NAME, "0")  # no bound
        corpus_pipeline.redact(spark, docs, "")
        assert spark.conf.get(NAME) == "1000"
        spark.conf.set(NAME, "7")
        assert [r["text"] for r in corpus_pipeline.redact(spark, docs, "").collect()] == ["a [EMAIL]"]
        assert spark.conf.get(NAME) == "7"
    finally:
        spark.conf.set(NAME, before)
