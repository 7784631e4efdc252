import corpus_pipeline
from tarnfell.llm.shared import written


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        if name != "packing":
            assert docs.columns == columns
            assert 0.7 * before <= docs.count() <= before
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
