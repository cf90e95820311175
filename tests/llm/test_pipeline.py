import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_over_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.settle(stage(spark, docs, sf), "test-stage")
        assert docs.columns == COLUMNS
        seen.append(docs.count())
    assert seen[0] > seen[1] == seen[2] >= seen[3] >= seen[4] > seen[0] / 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    whole = {}
    for r in pieces:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert {r.doc_id: r.doc_tokens for r in pieces} == whole and len(whole) == seen[4]
