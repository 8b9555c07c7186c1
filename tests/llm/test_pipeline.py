"""The pipeline's stages on the small tables: columns, order, and what each stage must leave."""

import collections

import corpus_pipeline
from quire.llm import dartminhash, toxicity
from quire.session import table


def test_stages(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    columns = docs.columns
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(now) <= ids and now
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "toxicity":
            scores = toxicity.scored(before, table(spark, data, "labels")).collect()
            assert sorted(now) == sorted(r.doc_id for r in scores if not r.predicted)
        if name == "minhash_near_dedup":
            first = [r.q_id for r in dartminhash.classes(before).filter("q_first").collect()]
            assert sorted(now) == sorted(set(first))
        if name == "source_mixing":
            assert max(collections.Counter(now).values()) <= 3
    assert {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)
    assert len(corpus_pipeline.STAGES) == 5 and set(corpus_pipeline.QUERIES) == {"pipeline"}
