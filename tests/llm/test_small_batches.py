import pyarrow as pa

from corpus_pipeline import BATCH_BYTES, STAGES, in_small_batches


def test_a_stage_hands_python_batches_bounded_by_bytes(spark):
    def _sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["size"])

    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text")
    stage = in_small_batches(lambda _, docs, __: docs.mapInArrow(_sizes, "size long"))
    sizes = [row.size for row in stage(spark, docs, "").collect()]
    assert sum(sizes) > 20_000_000 and max(sizes) <= BATCH_BYTES + 100_000
    assert all(hasattr(stage, "__wrapped__") for _, stage in STAGES)
